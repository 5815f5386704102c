"""Pieces that several of these operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words: space, and tab to carriage return.
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch where they carry whole texts; by bytes Spark bounds it besides.
TEXTS_PER_BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size, so that a Python worker holds few texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text in order; no words for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def remainder(key: Column, by: int) -> Column:
    """crc32 of a key written as text, modulo ``by``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def free_name(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
