"""Choice of one file per folder from a listing, and resumable record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.sources import store

# File names and words that mark the role of a file.
TRUTH_FILES = ("ground_truth.txt", "ground_truth.tsv", "Ground Truth ", "Ground Truth", "Ground Truth.txt", "answers.txt")
FOUR_UP_EXACT = "raw exam 4up.pdf"
FOUR_UP_WORD = "4up"
CLEANED_SCAN = "3_cleaned_scan.pdf"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``folder, name, mtime, size`` of the files below a path; contents stay unread."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
             .select("path", "modificationTime", "length"))
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
                        F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def preferred(files: DataFrame, rank: Column, order: Column | None = None) -> DataFrame:
    """The file of the lowest rank per folder; files of NULL rank do not take part."""
    order = F.lower("name") if order is None else order
    best = F.min(F.struct(F.col("_r"), order.alias("_o"), F.col("name").alias("_n")))
    return (files.withColumn("_r", rank).filter(F.col("_r").isNotNull()).groupBy("folder").agg(best["_n"].alias("name")))


def truth_rank() -> Column:
    """Candidate names in order of preference."""
    pos = F.array_position(F.array(*[F.lit(n) for n in TRUTH_FILES]), F.col("name"))
    return F.when(pos > 0, pos)


def keyword_rank(word: str, suffix: str) -> Column:
    low = F.lower("name")
    return F.when(low.endswith(suffix), F.when(low.contains(word), 0).otherwise(1))


def scan_rank(dpi: int) -> Column:
    """Scans other than the derived one; a name with the resolution comes first."""
    low = F.lower("name")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    is_scan = low.endswith(".pdf") & low.contains("scan") & (F.col("name") != CLEANED_SCAN)
    return F.when(is_scan, F.when(stem.contains(str(dpi)), 0).otherwise(1))


def four_up_rank() -> Column:
    low = F.lower("name")
    other = low.endswith(".pdf") & low.contains(FOUR_UP_WORD) & ~low.contains("answer") & ~low.contains("scan")
    return F.when(F.col("name") == FOUR_UP_EXACT, 0).when(other, 1)


def exam_rank() -> Column:
    """A four-up exam, else any raw or exam file that is neither key nor scan."""
    low = F.lower("name")
    plain = low.endswith(".pdf") & (low.contains("raw") | low.contains("exam")) & ~low.contains("answer") & ~low.contains("scan")
    return F.coalesce(four_up_rank(), F.when(plain, 2))


def newest(files: DataFrame, key: str = "folder") -> DataFrame:
    return files.groupBy(key).agg(F.max_by("name", F.struct("mtime", "name")).alias("name"), F.max("mtime").alias("mtime"))


# ---- resumable records ---------------------------------------------------------------------


def deduplicated(records: DataFrame, key: str = "page_number", order: str = "pos") -> DataFrame:
    """Last record per key; records without a key are left out."""
    cols = [c for c in records.columns if c != key]
    best = F.max_by(F.struct(*cols), F.col(order))
    return records.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def resumed(done: DataFrame, new: DataFrame, key: str = "page_number") -> DataFrame:
    """Existing records and the new ones that are not among them."""
    kept = deduplicated(done, key)
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)


def write_records(records: DataFrame, path: str, key: str = "page_number") -> None:
    """JSON lines in key order, absent keys first."""
    records.repartitionByRange(F.coalesce(key, F.lit(0))).sortWithinPartitions(F.coalesce(key, F.lit(0))).write.mode("overwrite").json(path)


def resume(new: DataFrame, folder: str, key: str = "page_number", version: int = 1) -> DataFrame:
    """Adds the records to the stored ones whose key isn't there yet, and returns the whole table as it is read back.

    Of repeated new keys the last by ``pos`` counts. A table of another version is built anew.
    """
    spark = new.sparkSession
    todo = deduplicated(new, key)
    if store.stored_version(spark, folder) == version:
        todo = todo.join(store.load(spark, folder, version).select(key), key, "left_anti")
    store.replace(todo, folder, [key], version)
    return store.load(spark, folder, version)
