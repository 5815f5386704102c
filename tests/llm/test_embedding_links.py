"""Embedding links against all pairs."""

import numpy as np

from gradelake.llm import embedding_links as el


def brute(rows, cosine=0.98):
    import math

    def sound(label, v):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    comp, links = list(range(n)), [0] * n
    ok = [sound(x[2], x[1]) for x in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    low = {}
    for i in range(n):
        low[comp[i]] = min([x for x in (low.get(comp[i]), rows[i][0]) if x is not None], default=None)
    return sorted([(rows[i][0], links[i], low[comp[i]], rows[i][0] == low[comp[i]]) for i in range(n)], key=repr)


def test_links(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows, key = [], 1000
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=24)
            for _ in range(int(rng.integers(1, 9))):
                noise = rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.17])
                rows.append((key, [float(np.float32(x)) for x in base + noise], label))
                key -= 1
    dense = rng.normal(size=24)
    rows += [(2000 + i, [float(np.float32(x)) for x in dense + 0.1 * rng.normal(size=24)], 1) for i in range(40)]
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 24, 0), (4, [None] + [1.0] * 23, 0), (5, [float("nan")] * 24, 0), (6, [float("inf")] + [1.0] * 23, 0)]
    rows += [(7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), (9, [1.0, 2.0], 1), (8, [2.0, 4.0], 0), (None, [1.0, 2.0], 0), (None, None, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, root string")
    want = brute(rows)
    for block in (el.BLOCK, 4):
        monkeypatch.setattr(el, "BLOCK", block)
        assert sorted([tuple(r) for r in el.links(frame).collect()], key=repr) == want
    assert el.links(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    u, q = el.units(rng.normal(size=(2, 64)))
    errors = []
    for k in range(400):
        r = el.rotation(64, k)
        signs, f = el.codes((u @ r)[None])
        estimate = signs[0] @ (q @ r) / 8 / f[0]
        errors.append((estimate - u @ q) / np.sqrt((1 - f[0] ** 2) / f[0] ** 2 / 63))
    assert abs(np.mean(errors)) < 0.2 and np.max(np.abs(errors)) < el.CONFIDENCE
