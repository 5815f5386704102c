"""Tables that are replaced by ranges of keys and carry the version of their format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.session import staged, unstaged

#: Ranges into which keys are dealt; what is replaced is read and written again range by range.
RANGES = 64
#: Hidden from readers of the table itself.
FORMAT = "_format"


class WrongVersion(ValueError):
    """A table of another format version; it has to be built anew."""


def stored_version(spark: SparkSession, folder: str) -> int | None:
    """Format version of a table, None where no table is."""
    try:
        return spark.read.schema("version int").json(f"{folder}/{FORMAT}").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def load(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The table of a folder; raises :class:`WrongVersion` where its format is another, or where none is."""
    found = stored_version(spark, folder)
    if found != version:
        raise WrongVersion(f"{folder} has version {found}, wanted {version}")
    return spark.read.option("mergeSchema", "true").parquet(folder).drop("key_range")


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("key_range", F.pmod(F.xxhash64(*keys), F.lit(RANGES)).cast("int"))


def replace(df: DataFrame, folder: str, keys: Sequence[str], version: int) -> None:
    """Writes rows in place of the stored ones of the same keys; all other keys keep theirs.

    Only ranges with a new key are read and written again, by dynamic partition overwrite, so running the same
    replacement twice leaves the same table and a failed one leaves the old ranges. A table of another version is
    replaced as a whole. Rows with a null key form a key of their own.
    """
    spark, keys = df.sparkSession, list(keys)
    new = staged(_ranged(df, keys), "replace")
    if stored_version(spark, folder) == version:
        old = spark.read.option("mergeSchema", "true").parquet(folder)
        touched = new.select("key_range").distinct()
        known = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        kept = old.join(F.broadcast(touched), "key_range", "left_semi").join(known, same, "left_anti")  # at most RANGES numbers
        merged = staged(kept.unionByName(new, allowMissingColumns=True), "merged")
        merged.repartition("key_range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_range").parquet(folder)
        unstaged(merged)
    else:
        new.repartition("key_range").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("key_range").parquet(folder)
        spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{folder}/{FORMAT}")
    unstaged(new)
