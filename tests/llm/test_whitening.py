from math import floor

import numpy as np
import pytest

from gradelake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>"


def plain(vectors, wanted=32):
    """Whitening with Python's integers and numpy's own eigenvalues."""
    x = [[floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = [[n * c - s for c, s in zip(row, sums)] for row in x]
    real = np.array([[c / n for c in row] for row in centred])
    v = real.T @ real / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    return n, [sum(c * c for c in row) for row in centred], real @ vectors / np.sqrt(values), values / np.trace(v)


def compared(rows, vectors, wanted=32):
    n, deviation, whitened, explained = plain(vectors, wanted)
    found = np.zeros_like(whitened)
    for row in rows:
        assert row["n"] == n and row["deviation"] == deviation[row["vec_id"]]
        assert row["explained"] == pytest.approx(explained[row["component"] - 1], rel=1e-10)
        assert 0 <= row["identity_error"] < 1e-9
        found[row["vec_id"], row["component"] - 1] = row["whitened"]
    signs = np.sign((found * whitened).sum(0))
    assert len(rows) == whitened.size and np.abs(found * signs - whitened).max() < 1e-7


def test_query_equals_plain_numpy(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = {r["vec_id"]: i for i, r in enumerate(table)}
    rows = [r.asDict() | {"vec_id": ids[r["vec_id"]]} for r in queries.QUERIES["op12_whitening"](spark, sf).collect()]
    compared(rows, [r["embedding"] for r in table])


def test_small_dimension_and_any_partitions(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(200, 5)) * [1, 50, 3, 7, 0.5]).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA)
    one, many = (whitening.whiten(frame.repartition(p)).collect() for p in (1, 23))
    compared(one, vectors)
    known = {(r["vec_id"], r["component"]): r["whitened"] for r in one}
    assert all(known[r["vec_id"], r["component"]] == r["whitened"] for r in many)


def test_dropped_rows_repeats_names_and_nothing(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(40, 3)).tolist()
    bad = [None, [1.0, None, 2.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0], [1e300, 0.0, 0.0], [], [1.0, 2.0]]
    rows = [(i, v, "x", i) for i, v in enumerate(vectors)] + [(100 + i, v, "x", 0) for i, v in enumerate(bad)]
    schema = SCHEMA + ", component string, vector long"
    compared(whitening.whiten(spark.createDataFrame(rows, schema)).collect(), vectors)
    assert whitening.whiten(spark.createDataFrame([(0, [1.0, 2.0])] * 5, SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] * 2 + [(None, vectors[0])], SCHEMA))
    assert twice.count() == 81 * 3


def test_immense_entries_stay_exact(spark):
    vectors = [[1e12 * i, 3.0 * i * i, float(-i)] for i in range(12)]
    found = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA)).collect()
    n, deviation, _, _ = plain(vectors)
    assert {r["vec_id"]: r["deviation"] for r in found} == {i: d if d < 1 << 63 else None for i, d in enumerate(deviation)}


def test_rank_deficient(spark):
    rng = np.random.default_rng(6)
    vectors = rng.integers(-9, 9, size=(50, 2)) @ rng.integers(-3, 3, size=(2, 6))
    found = whitening.whiten(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert {r["component"] for r in found} == {1, 2}


@pytest.mark.parametrize("size", [1, 2, 3, 40, 120])
@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "decay"])
def test_eigenpairs(spark, size, kind):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    values = {"spread": rng.uniform(0.1, 5, size), "clustered": 1 + (np.arange(size) // 10) + 1e-9 * rng.uniform(size=size),
              "equal": np.ones(size), "decay": 0.7 ** np.arange(size)}[kind]
    v = q * values @ q.T
    v = (v + v.T) / 2
    diagonal, off = whitening.tridiagonal(v)
    assert all(whitening.above(diagonal, off, s) == (values > s).sum() for s in (0.05, 0.5555, 1.5, 2.5))
    wanted = min(size, 32)
    found, vectors = whitening.leading(spark, v, wanted)
    assert found == pytest.approx(np.sort(values)[::-1][:wanted], rel=1e-9, abs=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * found).max() < 1e-13 * size
