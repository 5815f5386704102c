"""The stages of the pipeline, and the queries as they are registered."""

import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from gradelake.llm import bpe, queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages_keep_columns_and_rows_without_flaws(spark, tmp_path):
    rng = np.random.default_rng(0)
    speech = {"en": "the of and to ing er th".split(), "de": "der die und sch ung ein".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(speech[lang], 2)) for _ in range(n))
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, "common line here\n" + text(lang, int(rng.integers(30, 80))), lang, f"s{i % 2}", 0))
    rows += [(200, rows[0][1], "de", "s0", 0), (201, rows[1][1] + " more", "en", "s1", 0), (202, "12 34", "en", "s0", 0), (203, None, None, None, None), (None, text("en", 40), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
        if k < 4:
            assert seen[-1].dtypes == docs.dtypes
    known, lines, one, mixed, coded = ([r.asDict() for r in x.collect()] for x in seen[1:])
    assert {r["doc_id"] for r in known} == {None, *range(120), 200, 201}
    assert len(lines) == len(known) and not any("common line" in r["text"] for r in lines)
    assert all(r["n_chars"] == len(r["text"]) for r in lines if r["doc_id"] is not None)
    assert sorted(r["doc_id"] for r in one if r["doc_id"] is not None) == list(range(120))
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in one} and {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in one}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(coded) == len(mixed)
    for r in coded:
        assert r["decodes"] and np.frombuffer(r["ids"], "<u4").tolist() == encoder.encode_ordinary(texts[r["doc_id"]])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_many_near_copies_of_a_source_leave_one_whole_text(spark, tmp_path):
    rng = np.random.default_rng(1)
    line = lambda: " ".join(f"w{n}" for n in rng.integers(0, 10**6, 12))
    base = [line() for _ in range(40)]
    texts = ["\n".join([*base[:i], line(), *base[i + 1:]]) for i in range(6)] + ["\n".join(["menu of the site", line(), line()]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    corpus_pipeline.drop_site_lines(spark, docs, SF).write.parquet(str(tmp_path / "lines"))
    left = {r.doc_id: r.text for r in corpus_pipeline.keep_one_of_each_group(spark, spark.read.parquet(str(tmp_path / "lines")), SF).collect()}
    assert left == {i: t.replace("menu of the site\n", "") for i, t in enumerate(texts) if i == 0 or i > 5}


@needs_data
def test_native_plans_have_no_python(spark):
    for name in ("op1_fingerprints", "op2_site_lines"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(tuple, cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in queries.QUERIES[name](spark, SF).select(*names).collect()), key=repr) == want


def test_names():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in queries.QUERIES and set(queries.ORACLES) <= set(queries.QUERIES)
