"""Stored tables and replies that outlive a run."""

import os

import pytest

from pyspark.sql import functions as F

from gradelake.operators.model_calls import call_once
from gradelake.sources import files, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replaced_keys_and_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    make = lambda r: spark.createDataFrame(r, "k long, v string")
    assert store.stored_version(spark, folder) is None
    with pytest.raises(store.WrongVersion):
        store.load(spark, folder, 1)
    store.replace(make([(i, "old") for i in range(200)] + [(None, "none")]), folder, ["k"], 1)
    for _ in range(2):
        store.replace(make([(3, "new"), (3, "twice"), (500, "new"), (None, "nil")]), folder, ["k"], 1)
        want = [(i, "old") for i in range(200) if i != 3] + [(3, "new"), (3, "twice"), (500, "new"), (None, "nil")]
        found = store.load(spark, folder, 1).collect()
        assert sorted(map(str, found)) == sorted(map(str, make(want).collect()))
    store.replace(make([]), folder, ["k"], 1)
    assert store.load(spark, folder, 1).count() == len(want)
    with pytest.raises(store.WrongVersion):
        store.load(spark, folder, 2)
    store.replace(make([(1, "rebuilt")]), folder, ["k"], 2)
    assert rows(store.load(spark, folder, 2)) == [(1, "rebuilt")]


def test_records_resume(spark, tmp_path):
    folder, schema = str(tmp_path / "r"), "page_number long, answer string, pos long"
    files.resume(spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2), (None, "lost", 3)], schema), folder)
    for _ in range(2):
        found = files.resume(spark.createDataFrame([(2, "late", 9), (3, "d", 0)], schema), folder)
        assert rows(found.select("page_number", "answer")) == [(1, "b"), (2, "c"), (3, "d")]


def counting(log, fail=()):
    def factory():
        def reply(row):
            with open(os.path.join(log, f"{row['q']}-{os.urandom(6).hex()}"), "w"):
                pass
            if row["q"] in fail:
                os._exit(1)
            if row["q"] % 10 == 7:
                raise RuntimeError("busy")
            return f"answer {row['q']}"

        return reply

    return factory


def asked(log):
    counts = {}
    for name in os.listdir(log):
        q = int(name.split("-")[0])
        counts[q] = counts.get(q, 0) + 1
    return counts


def test_a_killed_task_does_not_ask_again(spark, tmp_path):
    """One worker dies in the middle; the next run asks only the rest, and what had failed."""
    log, folder = tmp_path / "log", str(tmp_path / "replies")
    log.mkdir()
    df = spark.createDataFrame([(i, i % 40) for i in range(80)], "i long, q long")
    small = {"pauses": (), "asked_by_task": 2, "tasks": 2}
    with pytest.raises(Exception):
        call_once(df, counting(str(log), fail=(33,)), ["q"], folder, **small).collect()
    first = asked(log)
    found = call_once(df, counting(str(log)), ["q"], folder, **small).collect()
    second = asked(log)
    assert {r.i: r.raw for r in found} == {i: "" if i % 40 % 10 == 7 else f"answer {i % 40}" for i in range(80)}
    stored = [q for q in first if q % 10 != 7]
    again = [q for q in stored if second[q] > first[q]]
    # Only the batch of the lost task can be asked twice: two tasks of a few requests each.
    assert 33 in again and len(again) <= 8 and all(second[q] == 1 for q in range(40) if q not in again and q % 10 != 7)
    third = call_once(df, counting(str(log), fail=range(0, 7)), ["q"], folder, **small).collect()
    assert sorted(third) == sorted(found) and all(asked(log)[q] == second[q] for q in range(40) if q % 10 != 7)


def test_a_batch_reads_only_its_own_requests(spark, tmp_path, monkeypatch):
    """Each batch read all requests to find its part, which grew with the square of their number."""
    from gradelake.operators import model_calls

    plans, ask = [], model_calls.call_model
    monkeypatch.setattr(model_calls, "call_model", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or ask(df, *a))
    df = spark.range(40).select(F.col("id").alias("q"))
    found = call_once(df, lambda: lambda row: str(row["q"]), ["q"], str(tmp_path / "kept"), pauses=(), asked_by_task=5, tasks=2)
    assert {(r.q, r.raw) for r in found.collect()} == {(n, str(n)) for n in range(40)}
    assert len(plans) == 4 and all("PartitionFilters: [isnotnull(batch#" in p for p in plans)


def test_replies_are_read_once_before_a_vote(spark):
    from gradelake.plans import registry

    registry.load_all()
    plan = registry.QUERIES["mdl_extract_ensemble"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "get_json_object" not in plan and "events.parquet" not in plan
