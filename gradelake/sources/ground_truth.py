"""Rosters and reference answers from decoded cells and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions.numbers import is_number
from gradelake.functions.text import LINE_BREAK, strip
from gradelake.session import staged

# Words of header rows, letters of answer columns, fixed-layout width.
ROSTER_HEADERS = ("name", "student", "students", "names", "no", "number", "#")
TRUTH_HEADERS = ("name", "student", "students", "names", "#")
ANSWER_LETTERS = ("A", "B", "C", "D", "?")
FIXED_ANSWERS = 6


def roster(cells: DataFrame) -> DataFrame:
    """First non-blank cell of every row, header rows dropped: ``scan_id, row, student``."""
    filled = cells.withColumn("val", strip(F.col("val"))).filter(F.col("val") != "")
    return (filled.groupBy("scan_id", "row").agg(F.min_by("val", "col").alias("student"))
            .filter(~F.lower("student").isin(*ROSTER_HEADERS)))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole text files: ``scan_id`` (file path), ``line_no``, ``line``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("scan_id"), "value")
    return files.select("scan_id", F.posexplode(F.split("value", LINE_BREAK)).alias("line_no", "line"))


def _tokens(body: Column, has_tab: Column) -> Column:
    """Non-empty values of a stripped line, cut at tabs or at white space."""
    parts = F.when(has_tab, F.split(body, r"(?U)\s*\t\s*")).otherwise(F.split(body, r"(?U)\s+"))
    return F.filter(parts, lambda t: t != "")


def ground_truth(lines: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Reference answers of every file: ``scan_id, student, q_number, value``.

    ``lines``: ``scan_id, line_no, line``. ``leaves``: ``scan_id, leaf_no, q_number`` names the
    columns of files without a header; without it they are numbered from 1.
    """
    kept = lines.select("scan_id", "line_no", strip(F.col("line")).alias("body"), F.col("line").contains("\t").alias("tab"))
    kept = kept.filter((F.col("body") != "") & ~F.col("body").startswith("#"))
    tabs = kept.groupBy("scan_id").agg(F.bool_or("tab").alias("has_tab"))
    rows = kept.join(tabs, "scan_id").select("scan_id", "line_no", _tokens(F.col("body"), F.col("has_tab")).alias("t"))
    rows = rows.withColumn("n", F.size("t"))
    value = lambda t: F.upper(t).isin(*ANSWER_LETTERS) | is_number(t)
    rows = rows.withColumn("data", (F.col("n") >= 2) & F.forall(F.slice("t", F.lit(2), F.greatest(F.col("n"), F.lit(1))), value))
    rows = staged(rows)
    header = (F.col("n") >= 2) & F.lower(F.get("t", F.lit(0))).isin(*TRUTH_HEADERS) & ~F.col("data")
    # The last header word line above the first data line names the columns. Two aggregates per
    # file are enough: the first data line, and the latest header above it.
    start = rows.groupBy("scan_id").agg(F.min(F.when(F.col("data"), F.col("line_no"))).alias("start"),
                                        F.max(F.when(F.col("data"), F.col("n") - 1)).alias("cols"))
    heads = (rows.filter(header).join(start, "scan_id").filter(F.col("line_no") < F.col("start"))
             .groupBy("scan_id").agg(F.max_by("t", "line_no").alias("t"))
             .select("scan_id", F.slice("t", F.lit(2), F.size("t")).alias("ids")))
    numbered = F.transform(F.sequence(F.lit(1), F.col("cols")), lambda i: i.cast("string"))
    named = start.filter(F.col("start").isNotNull()).join(heads, "scan_id", "left")
    if leaves is not None:
        listed = leaves.groupBy("scan_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("leaf_no", "q_number"))), lambda s: s["q_number"]).alias("leaf_ids"))
        named = named.join(listed, "scan_id", "left").withColumn(
            "ids", F.coalesce("ids", F.slice("leaf_ids", F.lit(1), F.col("cols")), F.expr("cast(array() as array<string>)")))
    else:
        named = named.withColumn("ids", F.coalesce("ids", numbered))
    last = (rows.filter("data").groupBy("scan_id", F.get("t", F.lit(0)).alias("student"))
            .agg(F.max_by("t", "line_no").alias("t")))
    width = F.least(F.size("ids"), F.size("t") - 1)
    cells = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(
        F.get("ids", i).alias("q_number"), F.get("t", i + 1).alias("value")))
    joined = last.join(named.select("scan_id", "ids"), "scan_id").filter(width >= 1).withColumn("cells", cells)
    # An id that occurs twice keeps its later value.
    unique = F.filter("cells", lambda c, i: ~F.exists(
        F.slice("cells", i + 2, F.size("cells")), lambda later: later["q_number"] == c["q_number"]))
    return joined.select("scan_id", "student", F.inline(unique))


def ground_truth_fixed(lines: DataFrame) -> DataFrame:
    """Fixed layout: the first line is skipped, a name and six answers per line, the last one wins."""
    tokens = F.filter(F.split("line", r"(?U)\s+"), lambda t: t != "")
    firsts = lines.groupBy("scan_id").agg(F.min("line_no").alias("first"))
    rows = (lines.join(firsts, "scan_id").filter(F.col("line_no") > F.col("first")).select("scan_id", "line_no", tokens.alias("t"))
            .filter(F.size("t") >= FIXED_ANSWERS + 1))
    return (rows.groupBy("scan_id", F.get("t", F.lit(0)).alias("student")).agg(F.max_by("t", "line_no").alias("t"))
            .select("scan_id", "student", F.slice("t", 2, FIXED_ANSWERS).alias("answers")))
