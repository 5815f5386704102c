"""Session settings and small helpers that depend on them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are tuned for. Shuffle partitions stay at the cluster's own value:
# adaptive execution coalesces small ones and splits skewed joins at run time.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "gradelake",
                  memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_stages")
    return context.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Long pipelines reuse their intermediate tables in several branches. A written table is computed
    once, outlives lost executors, and gives the next stages its size and column pruning. The
    tables stay until the folder is emptied, as other checkpoints do. ``by``: a column by whose values the
    table is laid in folders, so that a filter on it reads nothing else.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Delete a table of :func:`staged` that nothing will read again."""
    bare = lambda path: re.sub("/+", "/", path.split(":", 1)[-1])
    shared = bare(shared_folder(df.sparkSession)) + "/"
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if bare(folder).startswith(shared):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
