"""Pages to people, attempts, marks and totals.

Tables are keyed by ``scan_id``. Every step that sees replies is an aggregation with a map-side
part; the only ordered step (names carried over pages) runs in blocks of pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import numbers
from gradelake.functions.replies import NOT_ATTEMPTED, UNREADABLE, bound, salvaged_object
from gradelake.functions.text import strip
from gradelake.operators.match import match_names
from gradelake.operators.ordered import block_of, carry_forward, rank_in_order

# Task names and prompts of the reply tables.
TASK_MC = "check_mc"
TASK_ANSWERS = "check_answers"
TASK_COUNT = "count_marks"
NO_CRITERIA = "(see mark scheme)"
ANSWER_FORMAT = '{"answer": "B"}'
MARKS_FORMAT = '{"answer": "…", "marks": 1.5}'
NAME_FORMAT = '{"name": "FirstName LastName"}'
COUNT_FORMAT = '{"marks": {"1": 2, "2a": 1}}'
ATTEMPT_FORMAT = '{"attempted": ["1", "2a"]}'


# ---- pages to students -------------------------------------------------------------------


def forward_filled(pages: DataFrame, name: str = "name", page_block: int = 1024) -> DataFrame:
    """Pages with the last matched name at or before them; pages before the first name drop out."""
    blocked = pages.withColumn("_b", block_of(F.col("page"), page_block))
    return (carry_forward(blocked, ["scan_id"], "_b", ["page"], name, "student").drop("_b")
            .filter(F.col("student").isNotNull()))


def students_of(assigned: DataFrame, name: str = "name") -> DataFrame:
    """First page, page count and confidence of every student.

    High confidence when the first page carries its own match.
    """
    first = F.min(F.struct("page", F.col(name).isNotNull().alias("own")))
    return (assigned.groupBy("scan_id", "student").agg(first.alias("_f"), F.count("*").alias("n_pages"))
            .select("scan_id", "student", F.col("_f.page").alias("first_page"), "n_pages",
                    F.when(F.col("_f.own"), "high").otherwise("low").alias("confidence")))


def page_lists(assigned: DataFrame) -> DataFrame:
    """Page numbers per student as text; a scan bounds the list."""
    listed = F.array_sort(F.collect_list("page"))
    return (assigned.groupBy("scan_id", "student")
            .agg(F.array_join(F.transform(listed, lambda p: p.cast("string")), ", ").alias("pages")))


def assign_pages(reads: DataFrame, roster: DataFrame, similarity: bool = True) -> DataFrame:
    """Raw name replies to ``scan_id, page, name, student`` rows."""
    named = reads.withColumn("read", strip(F.coalesce(F.get_json_object(salvaged_object(F.col("raw")), "$.name"), F.lit(""))))
    matched = match_names(named, roster, ["scan_id"], "read", similarity=similarity)
    pages = named.hint("merge").join(matched, ["scan_id", "read"], "left").select("scan_id", "page", F.col("matched").alias("name"))
    return forward_filled(pages)


def missing_from(roster: DataFrame, assigned: DataFrame) -> DataFrame:
    """Roster entries without a page, repeats kept."""
    return roster.join(assigned.select("scan_id", "student").distinct(), ["scan_id", "student"], "left_anti")


def filtered_students(students: DataFrame, requests: DataFrame) -> DataFrame:
    """Students of every request: all, by name without regard to case, or the first n by first page."""
    block = students.withColumn("_b", block_of(F.col("first_page"), 1024))
    ranked = rank_in_order(block, ["scan_id"], "_b", [F.col("first_page"), F.col("student")], "_r").drop("_b")
    named = requests.filter(F.col("mode") == "specific").select("scan_id", F.explode("names").alias("n"))
    named = named.select("scan_id", F.lower("n").alias("_low"), F.lit(True).alias("_hit")).distinct()
    return (ranked.withColumn("_low", F.lower("student")).join(requests.select("scan_id", "mode", "names", "n"), "scan_id")
            .join(named, ["scan_id", "_low"], "left")
            .filter(F.when((F.col("mode") == "specific") & (F.size("names") > 0), F.col("_hit").isNotNull())
                    .when((F.col("mode") == "first_n") & (F.col("n") > 0), F.col("_r") <= F.col("n"))
                    .otherwise(True))
            .drop("_low", "_hit", "_r", "mode", "names", "n"))


def valid_pages(assigned: DataFrame, scans: DataFrame) -> DataFrame:
    """Pages that exist in the scan; a student without any drops out."""
    return (assigned.join(scans.select("scan_id", "page_count"), "scan_id")
            .filter(F.col("page").between(1, F.col("page_count"))).drop("page_count"))


# ---- attempts ------------------------------------------------------------------------------


def attempted_ids(reads: DataFrame) -> DataFrame:
    """Distinct attempted question ids of every student, from raw page replies."""
    listed = F.from_json(F.get_json_object(salvaged_object(F.col("raw")), "$.attempted"), "array<string>")
    return (reads.select("scan_id", "student", F.explode(listed).alias("q_number"))
            .filter(F.col("q_number").isNotNull()).distinct())


def attempt_lists(assigned: DataFrame, scans: DataFrame, reads: DataFrame) -> DataFrame:
    """Attempted ids of every assigned student in order; an empty list where no valid page names any."""
    keys = ["scan_id", "student"]
    pages = valid_pages(assigned, scans).select(*keys, "page")
    listed = in_id_order(attempted_ids(reads.join(pages, [*keys, "page"], "left_semi")), keys)
    return (assigned.select(*keys).distinct().join(listed, keys, "left")
            .withColumn("questions", F.coalesce("questions", F.lit(""))))


def in_id_order(ids: DataFrame, keys: Sequence[str], out: str = "questions") -> DataFrame:
    """Ids joined in (length, text) order; ids are distinct, so a list is no longer than the exam."""
    ranked = F.array_sort(F.collect_list(F.struct(F.length("q_number").alias("l"), F.col("q_number").alias("q"))))
    return ids.groupBy(*keys).agg(F.array_join(F.transform(ranked, lambda s: s["q"]), ", ").alias(out))


def gradable(questions: DataFrame, task: Column) -> DataFrame:
    """Leaves of the tree; only multiple choice ones for the letter task."""
    return questions.filter(F.col("is_leaf") & ((task != TASK_MC) | (F.col("question_type") == "multiple_choice")))


def with_attempt_flag(pairs: DataFrame, attempts: DataFrame, seen: DataFrame) -> DataFrame:
    """Flag (student, question) pairs. A student outside the attempt map attempted everything."""
    keys = ["scan_id", "student"]
    flagged = attempts.select(*keys, "q_number", F.lit(True).alias("_hit")).distinct()
    known = seen.select(*keys, F.lit(True).alias("_seen")).distinct()
    return (pairs.join(known, keys, "left").join(flagged, [*keys, "q_number"], "left")
            .withColumn("attempted", F.col("_seen").isNull() | F.col("_hit").isNotNull()).drop("_seen", "_hit"))


def unattempted(flagged: DataFrame) -> DataFrame:
    """Answer and marks of flagged pairs that were not attempted; they never meet a reply."""
    return flagged.filter(~F.col("attempted")).select(
        "scan_id", "student", "q_number", F.lit(NOT_ATTEMPTED).alias("answer"), F.lit(0.0).alias("marks"))


def with_skipped(rows: DataFrame) -> DataFrame:
    """Unattempted rows with the number of students of the scan who left the same question out.

    A null is a key like any other, so every row keeps its place.
    """
    counted = rows.groupBy(F.col("scan_id").alias("_scan"), F.col("q_number").alias("_q")).agg(F.count("*").alias("skipped"))
    same = F.col("scan_id").eqNullSafe(F.col("_scan")) & F.col("q_number").eqNullSafe(F.col("_q"))
    return rows.join(counted, same).drop("_scan", "_q")


# ---- marks ---------------------------------------------------------------------------------


def first_readable(reads: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Answer and marks of the first page with a readable reply; ``?`` and 0 where there is none."""
    readable = F.col("answer").isNotNull() & ~F.col("answer").isin("", UNREADABLE)
    best = F.min(F.when(readable, F.struct(*order, "answer", "marks")))
    return (reads.groupBy(*keys).agg(best.alias("_b"))
            .select(*keys, F.coalesce("_b.answer", F.lit(UNREADABLE)).alias("answer"),
                    F.coalesce("_b.marks", F.lit(0.0)).alias("marks")))


def mc_answer(raw: Column) -> Column:
    """Answer of a letter reply as it is given, in capitals; ``?`` where the reply names none."""
    def said(record: Column) -> Column:
        absent = F.when(F.array_contains(F.json_object_keys(record), "answer"), "NONE").otherwise(UNREADABLE)
        return F.upper(strip(F.coalesce(F.get_json_object(record, "$.answer"), absent)))

    return bound(salvaged_object(raw), said)


def mc_marks(answer: Column, correct: Column, max_marks: Column) -> Column:
    """Full marks for the right letter, none otherwise."""
    return F.when(answer == F.upper(strip(F.coalesce(correct, F.lit("")))), max_marks.cast("double")).otherwise(F.lit(0.0))


def written_marks(value: Column, max_marks: Column) -> Column:
    """Read marks, limited from above only; texts that are no number give 0, NaN stays."""
    number = numbers.to_number(value)
    return F.when(number.isNull(), F.lit(0.0)).when(F.isnan(number), number).otherwise(
        F.least(number, max_marks.cast("double")))


def counted_marks(entries: DataFrame) -> DataFrame:
    """Red marks summed over the pages of a student; entries that are no number do not count."""
    return (entries.withColumn("_m", numbers.to_number(F.col("value"))).filter(F.col("_m").isNotNull())
            .groupBy("scan_id", "student", "q_number").agg(F.sum("_m").alias("marks")))


def student_totals(grades: DataFrame, leaves: DataFrame) -> DataFrame:
    """Total marks per student beside the marks the exam offers."""
    offered = leaves.groupBy("scan_id").agg(F.sum("max_marks").alias("max_marks"))
    return grades.groupBy("scan_id", "student").agg(F.sum("marks").alias("total")).join(offered, "scan_id", "left")


def class_stats(totals: DataFrame) -> DataFrame:
    """Mean, median, best and lowest total of every scan, with their share of the offered marks.

    Equal totals are counted first, so the median works on the few different totals of a class.
    """
    counted = totals.groupBy("scan_id", "total").agg(F.count("*").alias("n"), F.max("max_marks").alias("max_marks"))
    stats = counted.groupBy("scan_id").agg(
        F.sum("n").alias("students"), (F.sum(F.col("total") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("total", 0.5, F.col("n")).alias("median"), F.max("total").alias("highest"),
        F.min("total").alias("lowest"), F.max("max_marks").alias("max_marks"))
    metrics = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                        for n in ("mean", "median", "highest", "lowest")])
    return (stats.select("scan_id", "students", "max_marks", F.inline(metrics))
            .withColumn("pct", numbers.pct(F.col("value"), F.col("max_marks"))))


# ---- prompts -------------------------------------------------------------------------------


def name_prompt() -> Column:
    """Request for the name at the top of a page."""
    return F.lit(f"Whose name stands at the top of this page? Reply as {NAME_FORMAT}, with an empty name if there is none.")


def count_prompt() -> Column:
    """Request for the red marks of a page."""
    return F.lit(f"Which marks has the teacher written in red on this page? Reply as {COUNT_FORMAT}, with no entries if there are none.")


def mc_prompt(number: Column, correct: Column) -> Column:
    """Request for the letter marked in a multiple choice question."""
    hint = F.when(F.coalesce(correct, F.lit("")) != "", F.concat(F.lit(" Key: "), correct, F.lit("."))).otherwise("")
    return F.concat(F.lit("Question "), number, F.lit(": which of A, B, C, D is marked? Reply as "),
                    F.lit(ANSWER_FORMAT), F.lit("."), hint)


def written_prompt(number: Column, marks: Column, criteria: Column, correct: Column) -> Column:
    """Request for the marks of a written question; criteria, else the model answer, else a fixed text."""
    shown = F.coalesce(F.nullif(criteria, F.lit("")), F.nullif(correct, F.lit("")), F.lit(NO_CRITERIA))
    return F.concat(F.lit("Question "), number, F.lit(" (max "), marks.cast("string"), F.lit(" mark"),
                    F.when(marks != 1, "s").otherwise(""), F.lit("), criteria: "), shown,
                    F.lit(". Reply as "), F.lit(MARKS_FORMAT), F.lit("."))


def attempt_prompt(leaves: DataFrame) -> DataFrame:
    """One request per exam that lists its leaves in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf_no", "q_number"))),
                                   lambda s: s["q_number"]), ", ")
    return leaves.groupBy("exam_id").agg(F.concat(
        F.lit("Questions: "), ids, F.lit(". Which are attempted on this page? Reply as "),
        F.lit(ATTEMPT_FORMAT), F.lit(".")).alias("prompt"))
