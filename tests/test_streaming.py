"""Resumed stream of page records."""

import json

from pyspark.sql.types import StructType

from gradelake.streaming.incremental import load_new_pages

DDL = "page_number long, answer string, pos int"


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def test_pages_are_loaded_once(spark, tmp_path):
    schema = StructType.fromDDL(DDL)
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    write(source / "a.json", [{"page_number": 1, "answer": "A", "pos": 1}, {"page_number": 1, "answer": "B", "pos": 2}, {"answer": "x", "pos": 3}])
    load_new_pages(spark, str(source), schema, target, state).awaitTermination()
    write(source / "b.json", [{"page_number": 1, "answer": "C", "pos": 1}, {"page_number": 2, "answer": "D", "pos": 2}])
    load_new_pages(spark, str(source), schema, target, state).awaitTermination()
    got = {(r.page_number, r.answer) for r in spark.read.parquet(target).collect()}
    assert got == {(1, "B"), (2, "D")}
