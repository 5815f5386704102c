"""Letter and roman sub-parts of written questions.

The lines of one question lie in one cell of one page, which bounds every window here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.functions.text import strip
from gradelake.session import staged

Q = ["exam_id", "qid"]

# Labels of sub-parts.
LETTER = r"(?is)^\s*\(?([a-z])\)\s*(.*)\z"
ROMAN = r"(?is)^\s*\(([ivxlcdm]+)\)\s*(.*)\z"
ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x",
          "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")


def label(text: Column, digits: Column) -> Column:
    """``struct(kind, label, rest)`` of a line that opens a sub-part, NULL otherwise.

    The margin number may stand before a letter. Romans are tried before letters, so ``(i)`` is
    the numeral.
    """
    body = F.ltrim(text)
    after = F.when((digits != "") & body.startswith(digits), F.substr(body, F.length(digits) + 1))
    roman = F.lower(F.regexp_extract(text, ROMAN, 1))
    make = lambda kind, src, pat, lab: F.struct(F.lit(kind).alias("kind"), lab.alias("label"), strip(F.regexp_extract(src, pat, 2)).alias("rest"))
    return (F.when(after.rlike(LETTER), make("letter", after, LETTER, F.lower(F.regexp_extract(after, LETTER, 1))))
            .when(roman.isin(*ROMANS), make("roman", text, ROMAN, roman))
            .when(text.rlike(LETTER), make("letter", text, LETTER, F.lower(F.regexp_extract(text, LETTER, 1)))))


def labelled_lines(lines: DataFrame) -> DataFrame:
    """Lines of every question with their label; a lone margin number joins the letter line after it.

    ``lines`` are clip lines: ``exam_id, page, qid, raw, x0 … y1, text``.
    """
    order = Window.partitionBy(*Q).orderBy("page", "y0", "x0", "block", "line")
    digits = F.col("raw").cast("string")
    df = lines.withColumn("a", label(F.col("text"), F.lit("")))
    follows = F.lead(F.struct("a", "text", "x0", "y0", "x1", "y1")).over(order)
    df = df.withColumn("_n", follows)
    df = df.withColumn("_join", F.coalesce((F.col("text") == digits) & (F.col("_n.a.kind") == "letter"), F.lit(False)))
    df = df.withColumn("_gone", F.coalesce(F.lag("_join").over(order), F.lit(False)))
    df = df.withColumn("_lines", F.count("*").over(Window.partitionBy(*Q))).filter(~F.col("_gone"))
    take = lambda c, f: F.when(F.col("_join"), f(c, f"_n.{c}")).otherwise(F.col(c))
    df = df.withColumns({"x0": take("x0", F.least), "y0": take("y0", F.least), "x1": take("x1", F.greatest), "y1": take("y1", F.greatest),
                         "text": F.when(F.col("_join"), F.concat_ws(" ", "text", "_n.text")).otherwise(F.col("text"))})
    return df.withColumn("a", label(F.col("text"), digits)).drop("_n", "_join", "_gone")


def slices(lines: DataFrame) -> DataFrame:
    """Lines from one label to the next: text, box, next label's top; ``slice_no`` 0 is the preamble.

    Questions of fewer than three lines or two labels are not split and give no row.
    """
    order = Window.partitionBy(*Q).orderBy("page", "y0", "x0", "block", "line")
    whole = Window.partitionBy(*Q)
    marked = F.col("a").isNotNull()
    df = lines.withColumns({"slice_no": F.sum(marked.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"),
                            "_labels": F.sum(marked.cast("int")).over(whole), "_i": F.row_number().over(order)})
    df = df.filter((F.col("_lines") >= 3) & (F.col("_labels") >= 2))
    own = F.when(marked, F.col("a.rest")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.when(own != "", F.struct("_i", own.alias("t")))))
    out = df.groupBy(*Q, "page", "slice_no").agg(
        F.max("a").alias("a"), strip(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n")).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.min_by("y0", "_i").alias("top"))
    return out


def parts(sliced: DataFrame) -> DataFrame:
    """Sub-parts with their id, parent letter, and a box that reaches the next label."""
    order = Window.partitionBy(*Q).orderBy("slice_no")
    labels = sliced.filter(F.col("slice_no") > 0).withColumn("_next", F.lead("top").over(order))
    labels = labels.withColumn("y1", F.greatest("y1", "_next"))
    kept = F.col("text") != ""
    is_letter = F.col("a.kind") == "letter"
    # The nearest letter above counts as the parent only if it has a text of its own.
    near = F.last(F.when(is_letter, F.struct("slice_no", F.col("a.label").alias("label"), kept.alias("kept"))), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    df = labels.withColumn("_p", near).filter(kept)
    below = ~is_letter & F.coalesce(F.col("_p.kept"), F.lit(False))
    number = F.concat("qid", F.when(below, F.col("_p.label")).otherwise(""), "a.label")
    df = df.withColumns({"number": number, "parent_slice": F.when(below, F.col("_p.slice_no"))})
    return df.withColumn("_tops", F.sum(F.col("parent_slice").isNull().cast("int")).over(Window.partitionBy(*Q))).filter(
        F.col("_tops") > 0).drop("_p", "_next", "_tops")


def split_questions(roots: DataFrame, lines: DataFrame) -> DataFrame:
    """Roots and their sub-parts as nodes ``exam_id, qid, path, number, …``.

    ``roots``: ``exam_id, qid, seg_no, page, question_type, text, marks, answer_options`` with box.
    Multiple choice questions stay whole; the text of a split question is its preamble.
    """
    written = roots.filter(F.col("question_type") != "multiple_choice").select(*Q, "seg_no")
    sliced = staged(slices(labelled_lines(lines.drop("seg_no").join(written, Q))))
    found = parts(sliced).join(written, Q)
    none = F.expr("cast(array() as array<struct<letter:string,text:string>>)")
    subs = found.select(
        *Q, "page", F.when(F.col("parent_slice").isNull(), F.array("seg_no", "slice_no")).otherwise(F.array("seg_no", "parent_slice", "slice_no")).alias("path"),
        "number", T.question_type(F.col("text")).alias("question_type"), "text", T.inferred_marks(F.col("text")).alias("marks"),
        none.alias("answer_options"), "x0", "y0", "x1", "y1")
    preamble = sliced.filter(F.col("slice_no") == 0).select(*Q, F.col("text").alias("_pre"))
    split = found.select(*Q).distinct().withColumn("_split", F.lit(True))
    tops = (roots.join(split, Q, "left").join(preamble, Q, "left")
            .withColumn("total", F.when(F.col("_split"), T.total_footer(F.col("text"))))
            .withColumn("text", F.when(F.col("_split"), F.coalesce("_pre", F.lit(""))).otherwise(F.col("text"))))
    tops = tops.select(*Q, "page", F.array("seg_no").alias("path"), F.col("qid").alias("number"), "question_type", "text", "marks", "answer_options",
                       "x0", "y0", "x1", "y1", "total")
    return tops.unionByName(subs.withColumn("total", F.lit(None).cast("bigint")))
