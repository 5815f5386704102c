"""The mix of sources against targets and rates worked out plainly."""

import collections
import math
import random

from pyspark.sql import functions as F

from gradelake.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Excess of the sources above their limit is shared anew until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def make(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "B", "é", None, "tiny"])
        if source == "tiny" and rng.random() < 0.9:
            source = "a"
        size = int(rng.lognormvariate(3, 1.2)) if rng.random() < 0.9 else 7
        rows.append((i, source, " ".join(["w"] * size) or None, 1))
    return rows + [(5, "a", "w w", 1), (5, "a", "w w", 1), (None, "B", "w", 1), (7000, "void", "", 1), (7001, "void", " \n\t", 1)]


def test_targets_rates_and_copies(spark, monkeypatch):
    for seed, dealt in ((1, 1024), (2, 5)):
        monkeypatch.setattr(mixing, "DEALT", dealt)
        rows = make(seed)
        frame = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
        got = mixing.taken(frame).collect()
        assert len(got) == len(rows)
        sizes, taken, targets = collections.Counter(), collections.Counter(), {}
        by = {}
        for i, s, t, _ in rows:
            sizes[s] += len((t or "").split())
            by.setdefault(i, []).append((s, len((t or "").split())))
        want = plain_targets(sizes)
        for r in got:
            assert any(n == r.size and r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-9 * want[s] for s, n in by[r.doc_id])
            assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
            s = next(s for s, n in by[r.doc_id] if n == r.size and r.source_size == sizes[s])
            taken[s] += r.taken
            targets[s] = r.target
        assert all(abs(taken[s] - t) <= max(10, 0.01 * t) for s, t in targets.items())
        again = mixing.taken(frame.repartition(5)).collect()
        assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_tilts_solve_the_dual(spark):
    rows = [("x", size, n) for size, n in ((1, 50), (10, 20), (300, 2))] + [("y", 5, 10), ("y", 50, 10), ("z", 4, 3)]
    histogram = spark.createDataFrame(rows, "source string, size long, n long")
    sums = {s: sum(n * k for t, k, n in rows if t == s) for s in "xyz"}
    documents = {s: sum(n for t, _, n in rows if t == s) for s in "xyz"}
    targets = {"x": 0.3 * sums["x"], "y": 2.2 * sums["y"], "z": 3.0 * sums["z"]}
    sources = spark.createDataFrame([(s, documents[s], sums[s], targets[s]) for s in "xyz"], "source string, documents long, source_size long, target double")
    tilt = {r.source: r.tilt for r in mixing.balance(histogram, sources).collect()}
    assert tilt["z"] is None
    for s in "xy":
        mean = sums[s] / documents[s]
        assert abs(sum(n * k * min(3, math.exp(tilt[s] * k / mean)) for t, k, n in rows if t == s) - targets[s]) < 1e-6 * targets[s]


def test_mix_repeats_documents(spark):
    rows = make(3, 200)
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    got = mixing.mix(frame)
    assert got.columns == frame.columns and set(map(tuple, got.collect())) <= set(rows)
    total = sum(len((r.text or "").split()) for r in got.collect())
    assert abs(total - sum(len((t or "").split()) for _, _, t, _ in rows)) <= 30
    empty = frame.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.taken(empty).count() == 0
    void = frame.where(F.col("source") == "void")
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.taken(void).collect()) == [(7000, 0, 0.0), (7001, 0, 0.0)]
