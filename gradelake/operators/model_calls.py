"""Calls of a reading model per row, with retries inside the task."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from gradelake.session import staged

# Tries per row and pauses between them, for marking and for extraction.
TRIES = 3
MARKING_PAUSES = (2.0, 4.0)
EXTRACTION_PAUSES = (1.0, 2.0)


def call_model(df: DataFrame, client_factory: Callable[[], Callable[[dict], str]], inputs: Sequence[str],
               pauses: Sequence[float] = MARKING_PAUSES, out: str = "raw", max_concurrency: int | None = None) -> DataFrame:
    """Append ``out`` (reply, ``''`` after the last failure), ``attempts`` and ``error``.

    The client is built once per task. Filter rows before the call: nothing is pushed through it.
    ``max_concurrency`` limits the tasks that talk to the model at the same time.
    """
    schema = StructType([*df.schema.fields, StructField(out, StringType()), StructField("attempts", IntegerType()),
                         StructField("error", StringType())])
    tries = len(pauses) + 1

    def ask(client, row: dict) -> tuple[str, int, str | None]:
        problem = None
        for attempt in range(tries):
            try:
                return client(row) or "", attempt + 1, None
            except Exception as exc:  # noqa: BLE001 - any client failure is retried, then reported
                problem = str(exc)
                if attempt < len(pauses):
                    time.sleep(pauses[attempt])
        return "", tries, problem

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for part in parts:
            rows = part[list(inputs)].to_dict("records")
            part[[out, "attempts", "error"]] = pd.DataFrame([ask(client, r) for r in rows], columns=[out, "attempts", "error"], index=part.index)
            yield part

    if max_concurrency:
        df = df.repartition(max_concurrency)
    return df.mapInPandas(batches, schema)


#: Requests that one task asks before their replies are stored, and tasks of a batch.
ASKED_BY_TASK = 64
TASKS = 64


def call_once(df: DataFrame, client_factory: Callable[[], Callable[[dict], str]], inputs: Sequence[str], folder: str,
              pauses: Sequence[float] = MARKING_PAUSES, out: str = "raw", asked_by_task: int = ASKED_BY_TASK, tasks: int = TASKS) -> DataFrame:
    """As :func:`call_model`, but a request is asked once and its reply kept in ``folder``.

    Requests are told apart by a hash of their inputs, so equal rows share a reply. Those without a stored reply are asked in
    batches, and every batch is stored before the next begins: a lost task asks at most its ``asked_by_task`` requests
    again, a repeated run only what failed or is missing. Failures are stored too, but asked again by the next run.
    """
    spark, request = df.sparkSession, F.sha2(F.to_json(F.struct(*inputs)), 256)
    schema = StructType([StructField("request", StringType()), StructField(out, StringType()), StructField("attempts", IntegerType()), StructField("error", StringType())])
    keyed = df.withColumn("request", request)
    # Each run writes a folder of its own, so that a plan never takes an older listing of the replies for the present one.
    own = f"{folder}/run-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.mode("append").parquet(own)
    stored = lambda: spark.read.schema(schema).parquet(f"{folder}/run-*")
    answered = stored().filter(F.col("error").isNull()).select("request")
    todo = keyed.groupBy("request").agg(*[F.first(i).alias(i) for i in inputs]).join(answered, "request", "left_anti")
    todo = staged(todo.withColumn("part", F.xxhash64("request")), "requests")
    batches = -(-todo.count() // (asked_by_task * tasks))
    if batches > 1:
        # A batch lies in a folder of its own; else each would read all requests to find its part.
        todo = staged(todo.withColumn("batch", F.pmod("part", F.lit(batches))).repartition("batch"), "batches", by="batch")
    for batch in range(batches):
        due = (todo.filter(F.col("batch") == batch) if batches > 1 else todo).repartition(tasks, "request").select("request", *inputs)
        call_model(due, client_factory, inputs, pauses, out).select("request", out, "attempts", "error").write.mode("append").parquet(own)
    replies = stored()
    # A reply wins over a failure of an earlier run.
    best = replies.groupBy("request").agg(F.max(F.struct(F.col("error").isNull().alias("ok"), out, "attempts", "error")).alias("_b"))
    return keyed.join(best, "request").select(*df.columns, f"_b.{out}", "_b.attempts", "_b.error")


def unresolved(candidates: DataFrame, graded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that still need a call: those without a readable reply so far."""
    return candidates.join(graded.filter(F.col("answer") != "?").select(*keys).distinct(), list(keys), "left_anti")
