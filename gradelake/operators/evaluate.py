"""Comparison of grades with reference answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.numbers import is_number, pct, to_number
from gradelake.functions.replies import UNREADABLE
from gradelake.functions.text import strip
from gradelake.operators.match import match_names

MARK_TOLERANCE = 0.01
KEYS = ["scan_id", "student"]


def shown_value(answer: Column, marks: Column, expected: Column) -> Column:
    """What was read: the mark for numeric columns, else the letter; ``?`` when absent."""
    letter = F.upper(strip(F.coalesce(F.nullif(answer, F.lit("")), F.lit(UNREADABLE))))
    return F.when(is_number(expected), F.coalesce(marks.cast("string"), F.lit(UNREADABLE))).otherwise(letter)


def cell_ok(answer: Column, marks: Column, expected: Column) -> Column:
    """Marks agree within the tolerance (absent counts as 0); letters agree and are readable."""
    close = F.abs(F.coalesce(marks, F.lit(0.0)) - to_number(expected)) < MARK_TOLERANCE
    close = close & ~F.isnan(to_number(expected))
    letter = F.upper(strip(F.coalesce(answer, F.lit(UNREADABLE))))
    same = (letter == F.upper(strip(expected))) & ~letter.isin("", UNREADABLE)
    return F.when(is_number(expected), close).otherwise(same)


def matched_students(results: DataFrame, truth: DataFrame, similarity: bool = True) -> DataFrame:
    """Students of the results with their name in the reference: ``scan_id, student, matched``."""
    names = truth.groupBy("scan_id", F.col("student").alias("gt")).agg(F.min("pos").alias("pos"))
    return match_names(results.select(*KEYS).distinct(), names, ["scan_id"], "student", "gt", "pos",
                       similarity).select(*KEYS, "matched")


def evaluated_cells(results: DataFrame, truth: DataFrame, matched: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per student and reference cell of a leaf.

    ``results``: ``scan_id, student, q_number, answer, marks``; ``truth``: ``scan_id, student,
    q_number, value``; ``leaves``: ``scan_id, q_number``. Two students may meet the same row.
    """
    expected = truth.filter(F.col("value").isNotNull()).select(
        "scan_id", F.col("student").alias("matched"), "q_number", F.col("value").alias("expected"))
    # Names and cells compress well, so files of them look small enough to send to every task; they are merged instead.
    cells = (matched.hint("merge").join(expected, ["scan_id", "matched"]).join(leaves.select("scan_id", "q_number").distinct(), ["scan_id", "q_number"])
             .join(results.hint("merge"), [*KEYS, "q_number"], "left"))
    args = (F.col("answer"), F.col("marks"), F.col("expected"))
    return cells.select(*KEYS, "matched", "q_number", "expected", shown_value(*args).alias("extracted"), cell_ok(*args).alias("ok"))


def student_scores(matched: DataFrame, cells: DataFrame) -> DataFrame:
    """Correct, total and accuracy of every matched student, also of those without any cell."""
    counts = cells.groupBy(*KEYS).agg(F.count_if("ok").alias("correct"), F.count("*").alias("total"))
    out = matched.hint("merge").join(counts, KEYS, "left").select(
        *KEYS, "matched", F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("total", F.lit(0)).alias("total"))
    return out.withColumn("accuracy_pct", pct(F.col("correct"), F.col("total")))


def overall_scores(scores: DataFrame) -> DataFrame:
    """Scores per scan and, with a NULL scan, over everything, in one aggregation."""
    out = scores.rollup("scan_id").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return out.withColumn("accuracy_pct", pct(F.col("correct"), F.col("total")))
