"""Report tables: marks, pages, attempts, questions, accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import numbers
from gradelake.functions.text import strip, type_label
from gradelake.operators.grade import in_id_order, page_lists

# Cells of the printed tables.
ABSENT = "–"
NO_QUESTIONS = "none"
UPRIGHT_PAGES = "All pages already upright"
TURNED_PAGES = " page(s) rotated via Tesseract OSD"


def results_matrix(grades: DataFrame, leaves: Sequence[str]) -> DataFrame:
    """One row per student: a column per leaf in exam order, total, share and band.

    The pivot has a given list of columns, so it is one aggregation without a pass for the values.
    """
    keys = ["scan_id", "student"]
    cells = {f"q{q}": F.max(F.when(F.col("q_number") == q, F.col("marks"))) for q in leaves}
    wide = grades.groupBy(*keys).agg(*[c.alias(n) for n, c in cells.items()],
                                     F.sum("marks").alias("total"), F.sum("max_marks").alias("max_marks"))
    share = numbers.pct(F.col("total"), F.col("max_marks"))
    shown = [F.when(F.col(n).isNull(), ABSENT).otherwise(numbers.fixed(F.col(n), 1)).alias(n) for n in cells]
    return wide.select(*keys, *shown, "total", share.alias("pct"), numbers.pct_band(share).alias("band"))


def _in_leaf_order(cells: DataFrame, leaves: DataFrame, shown: Column) -> DataFrame:
    """``scan_id, student, cells``: a map from the leaves of the scan's own exam, in id order, to the shown values.

    ``leaves``: distinct ``scan_id, q_number``, the leaves of one paper; those without a value are :data:`ABSENT`.
    """
    ranked = F.array_sort(F.collect_list(F.struct(F.length("q_number").alias("l"), F.col("q_number").alias("q"))))
    order = leaves.groupBy("scan_id").agg(F.transform(ranked, lambda s: s["q"]).alias("_ids"))
    values = cells.groupBy("scan_id", "student").agg(F.map_from_entries(F.collect_list(F.struct("q_number", shown.alias("v")))).alias("_have"))
    entries = F.transform("_ids", lambda q: F.struct(q.alias("q"), F.coalesce(F.try_element_at("_have", q), F.lit(ABSENT)).alias("v")))
    return values.join(order, "scan_id").select("scan_id", "student", F.map_from_entries(entries).alias("cells"))


def results_map(grades: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per student: marks by leaf of the own exam, total, share and band; exams may have different leaves."""
    keys = ["scan_id", "student"]
    sums = grades.groupBy(*keys).agg(F.sum("marks").alias("total"), F.sum("max_marks").alias("max_marks"))
    share = numbers.pct(F.col("total"), F.col("max_marks"))
    shown = F.coalesce(numbers.fixed(F.col("marks"), 1), F.lit(ABSENT))
    return _in_leaf_order(grades, leaves, shown).join(sums, keys).select(*keys, "cells", "total", share.alias("pct"), numbers.pct_band(share).alias("band"))


def eval_map(cells: DataFrame, scores: DataFrame, leaves: DataFrame) -> DataFrame:
    """As :func:`eval_matrix`, with a map by leaf of the own exam in place of columns; students without any cell are kept."""
    keys = ["scan_id", "student"]
    shown = F.when(F.col("ok"), F.col("extracted")).otherwise(F.concat_ws("/", "extracted", "expected"))
    every = scores.select(*keys, F.lit("").alias("q_number"), F.lit("").alias("_v"))
    rows = cells.select(*keys, "q_number", shown.alias("_v")).unionByName(every)
    wide = _in_leaf_order(rows, leaves, F.col("_v"))
    return scores.join(wide, keys).select(*keys, "cells", numbers.pct_text(F.col("accuracy_pct")).alias("acc"),
                                          F.concat_ws("/", F.col("correct").cast("string"), F.col("total").cast("string")).alias("score"))


def map_text(cells: str) -> Column:
    return F.array_join(F.transform(F.map_entries(cells), lambda e: F.concat(F.lit("q"), e["key"], F.lit("="), e["value"])), " ")


def page_summary(assigned: DataFrame, students: DataFrame) -> DataFrame:
    return page_lists(assigned).join(students.select("scan_id", "student", "confidence"), ["scan_id", "student"])


def attempt_summary(students: DataFrame, attempts: DataFrame) -> DataFrame:
    keys = ["scan_id", "student"]
    return (students.join(in_id_order(attempts, keys), keys, "left")
            .withColumn("questions", F.coalesce("questions", F.lit(NO_QUESTIONS))))


def scaffold_table(leaves: DataFrame) -> DataFrame:
    """Leaf rows and the total row of every exam."""
    rows = leaves.select("exam_id", F.concat(F.lit("Q"), "number").alias("question"),
                         type_label(F.col("question_type")).alias("type"), F.col("marks").cast("bigint").alias("marks"),
                         F.coalesce(F.nullif(strip(F.col("correct_answer")), F.lit("")), F.lit(ABSENT)).alias("answer"))
    total = leaves.groupBy("exam_id").agg(F.sum("marks").alias("marks")).select(
        "exam_id", F.lit("Total").alias("question"), F.lit("").alias("type"), "marks", F.lit("").alias("answer"))
    return rows.unionByName(total)


def eval_matrix(cells: DataFrame, scores: DataFrame, leaves: Sequence[str]) -> DataFrame:
    """Read value per question, ``read/expected`` where wrong, with accuracy and score."""
    keys = ["scan_id", "student"]
    shown = F.when(F.col("ok"), F.col("extracted")).otherwise(F.concat_ws("/", "extracted", "expected"))
    wide = cells.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("q_number") == q, shown)), F.lit(ABSENT)).alias(f"q{q}") for q in leaves])
    acc = numbers.pct_text(F.col("accuracy_pct"))
    score = F.concat_ws("/", F.col("correct").cast("string"), F.col("total").cast("string"))
    return (scores.join(wide, keys, "left")
            .select(*keys, *[F.coalesce(f"q{q}", F.lit(ABSENT)).alias(f"q{q}") for q in leaves],
                    acc.alias("acc"), score.alias("score")))


def extraction_table(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    return records.select("page_number", F.coalesce("student_name", F.lit("UNKNOWN")).alias("student_name"),
                          *[F.coalesce(f, F.lit("?")).alias(f) for f in fields])


def detected_rotation_summary(kept: DataFrame) -> DataFrame:
    """Sentence per scan where a recogniser turned the kept pages ``scan_id, rotation``."""
    counted = kept.groupBy("scan_id").agg(F.count("*").alias("kept"), F.count_if(F.col("rotation") != 0).alias("turned"))
    text = F.when(F.col("turned") > 0, F.concat(F.col("turned").cast("string"), F.lit(TURNED_PAGES))).otherwise(UPRIGHT_PAGES)
    return counted.select("scan_id", "kept", text.alias("summary"))


def rotation_summary(kept: DataFrame) -> DataFrame:
    """Sentence per scan on the orientation of the kept pages ``scan_id, rotation, landscape``."""
    per_rotation = kept.groupBy("scan_id", "rotation").agg(
        F.count("*").alias("n"), F.count_if("landscape").alias("land"))
    # At most four rotations exist, so the collected list is short.
    summed = per_rotation.groupBy("scan_id").agg(
        F.sum("n").alias("kept"), F.sum("land").alias("land"),
        F.array_sort(F.collect_list(F.struct("rotation", "n"))).alias("rots"))
    n, land = F.col("kept").cast("string"), F.col("land").cast("string")
    only = F.get("rots", F.lit(0))["rotation"]
    parts = F.array_join(F.transform("rots", lambda r: F.format_string("%d at %d°", r["n"], r["rotation"])), ", ")
    text = (F.when(F.col("land") == F.col("kept"), F.concat(F.lit("All "), n, F.lit(" pages corrected from landscape to portrait")))
            .when(F.col("land") > 0, F.concat(land, F.lit(" of "), n, F.lit(" pages corrected from landscape to portrait")))
            .when((F.size("rots") == 1) & (only == 0), UPRIGHT_PAGES)
            .when(F.size("rots") == 1, F.format_string("All pages at %d°", only))
            .otherwise(F.concat(F.lit("Mixed orientation: "), parts)))
    return summed.select("scan_id", "kept", F.col("land").alias("landscape"), text.alias("summary"))
