"""The full grading pass over many scans as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.operators import grade

KEYS = ["scan_id", "student"]


def grade_students(assigned: DataFrame, scans: DataFrame, questions: DataFrame, attempts: DataFrame,
                   seen: DataFrame, reads: DataFrame, red_marks: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Totals per student under the task of its scan.

    ``questions`` holds the questions put to each student, ``reads`` the replies per page,
    ``red_marks`` the marks a teacher wrote on a page, ``requests`` which students are wanted.
    Only pages that exist in the scan are graded. Unattempted questions never meet the replies;
    unknown tasks grade nothing.
    """
    pages = grade.valid_pages(assigned, scans).select(*KEYS, "page").distinct()
    if requests is not None:
        first = assigned.groupBy(*KEYS).agg(F.min("page").alias("first_page"))
        pages = pages.join(grade.filtered_students(first, requests).select(*KEYS), KEYS, "left_semi")
    students = pages.select(*KEYS).distinct()
    reads = reads.join(pages, [*KEYS, "page"], "left_semi")
    red_marks = red_marks.join(pages, [*KEYS, "page"], "left_semi")
    tasks = scans.select("scan_id", "task")
    asked = (questions.join(tasks.filter(F.col("task").isin(grade.TASK_MC, grade.TASK_ANSWERS)), "scan_id"))
    asked = grade.gradable(asked, F.col("task"))
    flagged = grade.with_attempt_flag(asked, attempts, seen)
    skipped = grade.unattempted(flagged)
    open_questions = flagged.filter("attempted").select(*KEYS, "q_number", "question_type", "correct_answer", "max_marks")
    marks = F.when(F.col("question_type") == "multiple_choice",
                   grade.mc_marks(F.col("answer"), F.col("correct_answer"), F.col("max_marks"))
                   ).otherwise(grade.written_marks(F.col("value"), F.col("max_marks")))
    read = open_questions.join(reads, [*KEYS, "q_number"], "left").withColumn("marks", marks)
    graded = grade.first_readable(read, [*KEYS, "q_number"], ["page"])
    counted = grade.counted_marks(red_marks.join(tasks.filter(F.col("task") == grade.TASK_COUNT), "scan_id"))
    rows = (skipped.unionByName(graded).select(*KEYS, "q_number", "marks")
            .unionByName(counted.select(*KEYS, "q_number", "marks")))
    totals = rows.groupBy(*KEYS).agg(F.sum("marks").alias("total"), F.count("*").alias("questions"))
    offered = (questions.filter("is_leaf").groupBy("scan_id", "q_number").agg(F.max("max_marks").alias("m"))
               .groupBy("scan_id").agg(F.sum("m").alias("max_marks")))
    return (students.join(totals, KEYS, "left").join(offered, "scan_id")
            .select(*KEYS, F.coalesce("total", F.lit(0.0)).alias("total"),
                    F.coalesce("questions", F.lit(0)).alias("questions"), "max_marks"))
