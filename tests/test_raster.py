"""Raster operators against NumPy on drawn pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.operators import raster as R

SCHEMA = "u int, y int, hh int, px binary"


def rows(spark, *grids):
    data = [(u, y, g.shape[0], g[y].astype(np.uint8).tobytes()) for u, g in enumerate(grids) for y in range(g.shape[0])]
    return spark.createDataFrame(data, SCHEMA)


def white(h, w):
    return np.full((h, w), 255)


def test_stats_and_blank(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (40, 30)), 252 + rng.integers(0, 3, (40, 30))
    got = {r.u: r for r in R.with_blank_flag(R.page_stats(rows(spark, a, b), ["u"])).collect()}
    for u, g in enumerate((a, b)):
        assert got[u].mean == pytest.approx(g.mean()) and got[u].std == pytest.approx(g.std())
    assert [got[0].blank, got[1].blank] == [False, True]


def test_otsu_separates_two_levels(spark):
    g = white(20, 20)
    g[5:10] = 40
    g[12] = 60
    assert R.otsu(rows(spark, g), ["u"]).first().threshold == 60


@pytest.mark.parametrize("size,tolerance", [((400, 300), 3), ((200, 150), 3)])
def test_skew_of_three_lines(spark, size, tolerance):
    h, w = size
    g = white(h, w)
    t = np.tan(np.deg2rad(1.3))
    for x in (60, 90, 120):
        for y in range(h):
            g[y, int(round(x + t * (y - h // 2)))] = 0
    got = R.skew_angles(rows(spark, g), ["u"]).first()
    # The lines lean right going down; turning by -1.3 degrees makes them upright.
    assert abs(got.angle + 130) <= 20 and got.rotate


def test_runs_cross_chunks(spark, monkeypatch):
    g = white(700, 5)
    g[100:600, 2] = 0
    g[0:3, 4] = 0
    ink = R.ink_rows(rows(spark, g), R.otsu(rows(spark, g), ["u"]), ["u"])
    assert sorted((r.x, r.y0, r.y1) for r in R.vertical_runs(ink, ["u"]).collect()) == [(2, 100, 599), (4, 0, 2)]


def test_only_runs_at_a_border_meet(spark):
    """Short runs inside a chunk end in their task; what outlasts the openings is the same."""
    rng = np.random.default_rng(2)
    g = np.where(rng.random((700, 40)) < 0.5, 0, 255).astype(np.uint8)
    g[240:270, 3] = g[300:500, 4] = g[0:25, 5] = g[680:700, 6] = g[0:700, 7] = g[252:256, 8] = g[300:340, 9] = 0
    ink = R.ink_rows(rows(spark, g), R.otsu(rows(spark, g), ["u"]), ["u"])
    every = sorted((r.x, r.y0, r.y1) for r in R.vertical_runs(ink, ["u"]).collect())
    want = []
    for x in range(40):
        edge = np.diff(np.concatenate([[0], (g[:, x] == 0).astype(int), [0]]))
        want += [(x, int(a), int(b) - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    assert every == want
    few = R.vertical_runs(ink, ["u"], R.shortest_inside(R.MASK_MIN_KERNEL))
    assert few.count() < len(every) / 20
    size = spark.createDataFrame([(0, 700)], "u int, hh int")
    found = [sorted((r.x0, r.x1, r.y0, r.y1) for r in R.vline_rects(runs, size, ["u"]).collect()) for runs in (few, R.vertical_runs(ink, ["u"]))]
    assert found[0] == found[1] and {(r[0] + R.MASK_HALF) for r in found[0]} >= {4, 7}


def test_ruling_lines(spark):
    g = white(800, 200)
    for x in (50, 100, 150):
        g[100:700, x : x + 3] = 0
    g[300:310, 50:53] = 0
    g[20:60, 10] = 0
    r = rows(spark, g)
    ink = R.ink_rows(r, R.otsu(r, ["u"]), ["u"]).withColumn("hh", F.lit(800))
    got = sorted((x.x_center, x.y_start, x.y_end, x.lines) for x in R.ruling_lines(ink, ["u"]).collect())
    assert got == [(51, 100, 699, 3), (101, 100, 699, 3), (151, 100, 699, 3)]


def test_merge_and_endpoints(spark):
    df = spark.createDataFrame([(1, [116, 100, 108])], "u int, xs array<bigint>")
    assert df.select(R.merged_positions(F.col("xs"))).first()[0] == [104, 116]
    hits = [(1, y, 40, 10 <= y < 20 or y in (0, 1, 30)) for y in range(40)] + [(2, y, 40, False) for y in range(40)]
    got = {r.u: (r.y_start, r.y_end) for r in R.run_endpoints(spark.createDataFrame(hits, "u int, y int, hh int, hit boolean"), ["u"]).collect()}
    assert got == {1: (10, 19), 2: (0, 39)}


def brute_areas(bitmap):
    seen, areas = set(), []
    pts = {(int(y), int(x)) for y, x in zip(*np.nonzero(bitmap))}
    for p in sorted(pts):
        if p in seen:
            continue
        stack, n = [p], 0
        seen.add(p)
        while stack:
            y, x = stack.pop()
            n += 1
            for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if q in pts and q not in seen:
                    seen.add(q)
                    stack.append(q)
        areas.append(n)
    return sorted(areas)


def test_blobs_equal_flood_fill(spark):
    rng = np.random.default_rng(3)
    grids = [(rng.random((30, 40)) < p).astype(np.uint8) for p in (0.1, 0.3, 0.5)]
    data = [(u, y, g[y].tobytes()) for u, g in enumerate(grids) for y in range(30)]
    got = R.blob_areas(spark.createDataFrame(data, "u int, y int, ink binary"), ["u"]).collect()
    for u, g in enumerate(grids):
        assert sorted(r.area for r in got if r.u == u) == brute_areas(g)


def test_handwriting(spark):
    ruled, noisy, written = white(200, 60), white(200, 60), white(200, 60)
    ruled[:, 30:32] = 0
    noisy[50:53, 10:13] = 0
    written[:, 30:32] = 0
    written[100:106, 5:20] = 10
    got = {r.u: r.has_handwriting for r in R.detect_handwriting(rows(spark, ruled, noisy, written), ["u"]).collect()}
    assert got == {0: False, 1: False, 2: True}
    with pytest.raises(ValueError):
        R.detect_handwriting(rows(spark, ruled), ["u"], method="other")


def test_border_runs_survive_when_shorter(spark):
    df = spark.createDataFrame([(0, 148), (0, 147), (650, 799), (649, 799), (100, 397), (100, 398), (0, 799)], "y0 long, y1 long")
    got = {(r.y0, r.y1) for r in R.surviving(df, F.lit(150), F.lit(800)).collect()}
    assert got == {(0, 148), (649, 799), (100, 398), (0, 799)}


def test_separate_runs_are_no_line(spark):
    g = white(2000, 40)
    g[100:500, 10] = 0
    g[1200:1600, 11] = 0
    r = rows(spark, g)
    ink = R.ink_rows(r, R.otsu(r, ["u"]), ["u"]).withColumn("hh", F.lit(2000))
    assert R.ruling_lines(ink, ["u"]).count() == 0
    g[500:1201, 11] = 0
    r = rows(spark, g)
    ink = R.ink_rows(r, R.otsu(r, ["u"]), ["u"]).withColumn("hh", F.lit(2000))
    assert [(x.y_start, x.y_end) for x in R.ruling_lines(ink, ["u"]).collect()] == [(100, 1599)]


def test_one_blank_state_per_scan(spark):
    import json

    flags = spark.createDataFrame([(1, p, p == 999) for p in (998, 999, 1000)], "scan_id int, page long, blank boolean")
    (state,) = [json.loads(r.state) for r in R.blank_states(flags).collect()]
    assert (state["total_pages"], state["content_page_nums"], state["blank_page_nums"]) == (3, [998, 1000], [999])


def test_skew_is_found_in_small_batches(spark):
    """A Python worker gets few rows at a time, and a unit of several batches keeps its angle."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        g = white(240, 200)
        t = np.tan(np.deg2rad(1.3))
        for x in (60, 90, 120):
            for y in range(240):
                g[y, int(round(x + t * (y - 120)))] = 0
        many = R.skew_angles(rows(spark, g), ["u"]).first()
        assert int(spark.conf.get(name)) <= 1024
        spark.conf.set(name, "16")
        few = R.skew_angles(rows(spark, g), ["u"]).first()
        assert spark.conf.get(name) == "16" and few == many and many.rotate
    finally:
        spark.conf.set(name, before)
