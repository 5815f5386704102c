"""Resumable load of page records as they arrive.

Batch runs resume by page key: pages that already have a record are not loaded again. The same
rule as a stream: every batch of new files adds the pages that are not stored yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradelake.sources.files import deduplicated

RANGE, KEYS_PER_RANGE = "key_range", 100_000


def load_new_pages(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
                   key: str = "page_number", order: str = "pos"):
    """Start an ``availableNow`` query that appends unseen pages of JSON files to a Parquet table.

    A repeated batch adds nothing, because its pages are already stored. The table is partitioned by
    ranges of keys, and a batch reads only the ranges that it has pages of.
    """
    stored_schema = StructType([schema[key], *[f for f in schema if f.name != key], StructField(RANGE, LongType())])

    def append(batch: DataFrame, _epoch: int) -> None:
        fresh = deduplicated(batch, key, order).withColumn(RANGE, F.floor(F.col(key) / KEYS_PER_RANGE))
        ranges = [r[0] for r in fresh.select(RANGE).distinct().collect()]
        done = spark.read.schema(stored_schema).parquet(target).filter(F.col(RANGE).isin(ranges)).select(key)
        fresh.join(done, key, "left_anti").write.mode("append").partitionBy(RANGE).parquet(target)

    spark.createDataFrame([], stored_schema).write.mode("append").partitionBy(RANGE).parquet(target)
    stream = spark.readStream.schema(schema).json(source)
    return (stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
