"""Page rasters as rows of pixels: blank pages, thresholds, skew, ruling lines, handwriting.

Input rows are ``unit columns, y, w, px`` with one image row per table row, so a page is spread
over tasks. NumPy turns batches of rows into partial counts, Spark adds them up. Pixels are never
exploded: what leaves a task are sums, histograms, column counts or runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from gradelake.operators.components import component_roots
from gradelake.session import staged

# Blank pages, skew search (hundredths of a degree), ruling lines, handwriting, anchors.
BLANK_MEAN = 250
BLANK_STD = 6
MIN_OSD_CONFIDENCE = 2.0
SWEEP = 300
COARSE_STEP = 10
FINE_HALF = 15
MIN_SKEW = 5
PROXY_SCALE = 4
MIN_PROXY = 80
RULE_KERNEL = 150
RULE_MIN_SHARE = 0.3
RULE_MAX_WIDTH = 30
MERGE_X = 10
ENDPOINT_HALF = 4
ENDPOINT_RUN = 8
MASK_HALF = 4
MASK_MIN_KERNEL = 20
MIN_BLOB = 15
MIN_INK_SHARE = 0.0007
ANCHOR_ROWS = 350
ANCHOR_MIN_SCORE = 0.5
ROWS_PER_CHUNK = 256
#: Pixels whose ink is turned at once.
PIXELS_TOGETHER = 1 << 20
#: Image rows of an Arrow batch at most: a Python worker holds a batch several times over, as bytes, objects and results.
ROWS_PER_BATCH = 1024
#: Columns of a bin when runs on both sides of a chunk's border are compared.
BIN = 64


def _keyed(df: DataFrame, keys: Sequence[str], *fields: StructField) -> StructType:
    return StructType([df.schema[k] for k in keys] + list(fields))


def _long(name: str) -> StructField:
    return StructField(name, LongType())


# ---- statistics ------------------------------------------------------------------------------------


def row_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel count, sum and sum of squares of every image row."""
    keys = list(keys)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pixels = [np.frombuffer(b, np.uint8).astype(np.int64) for b in part["px"]]
            out = part[keys].copy()
            out["n"] = [p.size for p in pixels]
            out["s"] = [int(p.sum()) for p in pixels]
            out["q"] = [int((p * p).sum()) for p in pixels]
            yield out

    return rows.select(*keys, "px").mapInPandas(partial, _keyed(rows, keys, _long("n"), _long("s"), _long("q")))


def page_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the grey values."""
    n, s, q = F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    sums = row_sums(rows, keys).groupBy(*keys).agg(n, s, q)
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")
    return sums.select(*keys, F.col("n").alias("pixels"), (F.col("s") / F.col("n")).alias("mean"), (F.sqrt(spread) / F.col("n")).alias("std"))


def with_blank_flag(stats: DataFrame) -> DataFrame:
    return stats.withColumn("blank", (F.col("mean") >= BLANK_MEAN) & (F.col("std") <= BLANK_STD))


def all_blank_scans(flags: DataFrame) -> DataFrame:
    """Scans without any content page; nothing can be saved for them."""
    return flags.groupBy("scan_id").agg(F.bool_and("blank").alias("b")).filter("b").select("scan_id")


def rotations(meta: DataFrame, use_osd: bool = False) -> DataFrame:
    """Page rotation to store: landscape renders lose theirs, or the detected angle is added."""
    own = F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(360))
    landscape = F.col("w") > F.col("h")
    if use_osd:
        angle = F.when(F.coalesce("osd_conf", F.lit(0.0)) < MIN_OSD_CONFIDENCE, 0).otherwise(F.coalesce("osd_rotate", F.lit(0)))
        return meta.withColumns({"landscape": F.lit(False), "rotation": F.pmod(own + angle, F.lit(360))})
    return meta.withColumns({"landscape": landscape, "rotation": F.when(landscape, 0).otherwise(own)})


#: Version of the stored blank search.
BLANKS_VERSION = 1


def blank_states(flags: DataFrame, use_osd: bool | None = None, dpi: int | None = None) -> DataFrame:
    """Stored state of the blank search: totals and page lists of every scan.

    Render sizes are stored where ``flags`` carry ``w`` and ``h``, the rotation switch and the resolution where they are given.
    """
    pages = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("page"))))
    fields = [F.lit(BLANKS_VERSION).alias("schema_version"), F.count("*").alias("total_pages"), pages(~F.col("blank")).alias("content_page_nums"),
              pages(F.col("blank")).alias("blank_page_nums")]
    if {"w", "h"} <= set(flags.columns):
        sized = F.array_sort(F.collect_list(F.struct("page", F.array("w", "h").alias("s"))))
        fields.append(F.transform(sized, lambda p: p["s"]).alias("page_render_sizes"))
    fields += [F.lit(BLANK_MEAN).alias("blank_mean"), F.lit(BLANK_STD).alias("blank_std")]
    fields += [F.lit(v).alias(n) for n, v in (("use_tesseract_rotation", use_osd), ("analysis_dpi", dpi)) if v is not None]
    return flags.groupBy("scan_id").agg(F.to_json(F.struct(*fields)).alias("state"))


def read_blank_states(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages ``scan_id, page, blank, w, h`` of stored states, and the states of another version."""
    schema = "schema_version int, content_page_nums array<long>, blank_page_nums array<long>, page_render_sizes array<array<int>>"
    parsed = states.withColumn("_s", F.from_json("state", schema))
    known = F.coalesce(F.col("_s.schema_version") == BLANKS_VERSION, F.lit(False))
    listed = lambda name, blank: F.transform(F.col(f"_s.{name}"), lambda p: F.struct(p.alias("page"), F.lit(blank).alias("blank")))
    every = F.array_sort(F.concat(listed("content_page_nums", False), listed("blank_page_nums", True)))
    pages = parsed.filter(known).select("scan_id", "_s.page_render_sizes", F.posexplode(every).alias("_i", "_p"))
    size = F.get("page_render_sizes", F.col("_i"))
    return (pages.select("scan_id", "_p.page", "_p.blank", F.get(size, F.lit(0)).alias("w"), F.get(size, F.lit(1)).alias("h")),
            parsed.filter(~known).select("scan_id", F.col("_s.schema_version").alias("version")))


# ---- threshold -------------------------------------------------------------------------------------


def histograms(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grey value counts per unit: ``keys, v, c``; batches are counted before the shuffle."""
    keys = list(keys)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            groups = [(key, np.bincount(np.frombuffer(b"".join(g["px"]), np.uint8), minlength=256)) for key, g in part.groupby(keys, sort=False)]
            if not groups:
                continue
            counts = np.stack([c for _, c in groups])
            unit, value = np.nonzero(counts)
            out = pd.DataFrame({"v": value.astype(np.int64), "c": counts[unit, value].astype(np.int64)})
            for i, name in enumerate(keys):
                out[name] = np.array([key[i] for key, _ in groups], dtype=object)[unit]
            yield out[[*keys, "v", "c"]]

    return rows.select(*keys, "px").mapInPandas(partial, _keyed(rows, keys, _long("v"), _long("c"))).groupBy(*keys, "v").agg(F.sum("c").alias("c"))


def otsu(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold of the largest between-class variance; values at or below it are ink.

    The window covers the at most 256 grey values of a unit.
    """
    up = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = histograms(rows, keys).withColumn("m", F.col("v") * F.col("c"))
    h = h.select(*keys, "v", F.sum("c").over(up).alias("n1"), F.sum("m").over(up).alias("s1"), F.sum("c").over(whole).alias("n"), F.sum("m").over(whole).alias("s"))
    gap = (F.col("n") * F.col("s1") - F.col("n1") * F.col("s")).cast("double")
    score = F.when(F.col("n1") < F.col("n"), gap * gap / (F.col("n1").cast("double") * (F.col("n") - F.col("n1")).cast("double"))).otherwise(0.0)
    return h.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("v")).alias("o"), "v"))["v"].alias("threshold"))


def ink_rows(rows: DataFrame, thresholds: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of 0 and 1 bytes, 1 for ink: ``keys, y, ink`` and the columns of ``keep``."""
    keys, kept = list(keys), [*keys, "y", *keep]
    joined = rows.select(*kept, "px").join(thresholds, keys)

    def binarise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["ink"] = [(np.frombuffer(b, np.uint8) <= t).astype(np.uint8).tobytes() for b, t in zip(part["px"], part["threshold"], strict=True)]
            yield part[[*kept, "ink"]]

    return joined.mapInPandas(binarise, _keyed(rows, kept, StructField("ink", BinaryType())))


# ---- skew --------------------------------------------------------------------------------------------


def page_halves(rows: DataFrame, heights: DataFrame, keys: Sequence[str] = ("scan_id", "page")) -> DataFrame:
    """Rows of the upper and lower half of every page, with ``y`` from the top of the half and its size."""
    keys = list(keys)
    mid = F.floor(F.col("h") / 2).cast("int")
    top = F.col("y") < F.col("mid")
    df = rows.join(heights.select(*keys, "h"), keys).withColumn("mid", mid)
    return df.withColumns({"half": F.when(top, "top").otherwise("bot"), "hh": F.when(top, F.col("mid")).otherwise(F.col("h") - F.col("mid")),
                           "y": F.when(top, F.col("y")).otherwise(F.col("y") - F.col("mid"))}).drop("h", "mid")


def quarter_scale(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Proxy of a quarter of the width and height by block means; four rows meet in one task."""
    keys = list(keys)
    s = PROXY_SCALE
    blocks = (rows.withColumn("yq", F.floor(F.col("y") / s).cast("int")).groupBy(*keys, "yq", "hh")
              .agg(F.collect_list("px").alias("px")).filter(F.size("px") == s).filter(F.col("yq") < F.floor(F.col("hh") / s)))

    def shrink(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for block in part["px"]:
                grid = np.stack([np.frombuffer(b, np.uint8) for b in block])
                width = grid.shape[1] // s
                out.append(np.rint(grid[:, : width * s].reshape(s, width, s).mean(axis=(0, 2))).astype(np.uint8).tobytes())
            yield part[keys].assign(y=part["yq"], hh=part["hh"] // s, px=out)

    schema = _keyed(rows, keys, StructField("y", IntegerType()), StructField("hh", IntegerType()), StructField("px", BinaryType()))
    return blocks.mapInPandas(shrink, schema)


def column_counts(ink: DataFrame, keys: Sequence[str], angles: DataFrame | None = None) -> DataFrame:
    """Ink per column after turning the ink points by every angle: ``keys, angle, w, x, c``.

    ``ink`` carries ``hh``; ``angles``: ``keys, lo, hi`` in hundredths of a degree, every one from ``lo`` to ``hi``, or
    without them the coarse sweep. The points of a block of rows are turned at once and counted where they lie:
    the shuffle carries columns, not points or rows.
    """
    keys = list(keys)
    if angles is None:
        joined = ink.withColumns({"lo": F.lit(-SWEEP), "hi": F.lit(SWEEP)})
    else:
        joined = ink.join(angles, keys)
    step = COARSE_STEP if angles is None else 1

    def turned(g: pd.DataFrame) -> pd.DataFrame:
        """Column counts of one unit's rows at every angle."""
        first = g.iloc[0]
        w, h = len(first["ink"]), int(first["hh"])
        cx, cy, pad = w // 2, h // 2, w + h
        points = [np.flatnonzero(np.frombuffer(b, np.uint8)) for b in g["ink"]]
        dx = np.concatenate(points).astype(np.float64) - cx
        dy = np.repeat(g["y"].to_numpy() - cy, [p.size for p in points]).astype(np.float64)
        # Only points near the upper and lower edge can leave the page.
        reach = (w // 2 + 1) * np.sin(np.deg2rad(SWEEP / 100)) + (h // 2 + 1) * (1 - np.cos(np.deg2rad(SWEEP / 100))) + 2
        edge = (dy < reach - cy) | (dy > h - 1 - cy - reach)
        inner, outer = (dx[~edge], dy[~edge]), (dx[edge], dy[edge])
        angles = np.arange(int(first["lo"]), int(first["hi"]) + 1, step)
        found = []
        for a in np.deg2rad(angles / 100.0):
            c, s = np.cos(a), np.sin(a)
            y = outer[1] * c - outer[0] * s + (cy + 0.5)
            kept = (y >= 0) & (y < h)
            x = [inner[0] * c + inner[1] * s, (outer[0] * c + outer[1] * s)[kept]]
            # Columns left of the page are made positive, so that cutting the fraction rounds all of them down.
            counts = np.bincount((np.concatenate(x) + (cx + 0.5 + pad)).astype(np.int64), minlength=2 * pad + w)
            found.append(counts[pad : pad + w])
        return pd.DataFrame({k: first[k] for k in keys} | {"angle": angles.astype(np.int64), "columns": found})

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            points = part["ink"].map(len).cumsum() // PIXELS_TOGETHER
            for _, block in part.groupby([*keys, points.rename("_p")], sort=False):
                yield turned(block)

    schema = _keyed(ink, keys, _long("angle"), StructField("columns", ArrayType(LongType())))
    every = joined.mapInPandas(partial, schema).select(*keys, "angle", F.size("columns").alias("w"), F.posexplode("columns").alias("x", "c"))
    return every.filter("c > 0").groupBy(*keys, "angle", "w", "x").agg(F.sum("c").alias("c"))


def best_angles(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Angle whose column sums vary most, the first one among equals. Empty columns count as 0."""
    spread = counts.groupBy(*keys, "angle", "w").agg((F.col("w") * F.sum(F.col("c") * F.col("c")) - F.sum("c") * F.sum("c")).alias("v"))
    return spread.groupBy(*keys).agg(F.max(F.struct("v", (-F.col("angle")).alias("o"), "angle"))["angle"].alias("angle"))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size, so that a Python worker holds few image rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def skew_angles(rows: DataFrame, keys: Sequence[str], proxy: bool = True) -> DataFrame:
    """Skew of every unit in hundredths of a degree: coarse over the whole range, fine around it.

    ``rows`` carry ``hh``. Large units take the coarse pass on a quarter-scale proxy. Angles below
    the minimum are reported, ``rotate`` tells whether they are applied. The rows of ink are written once, for both passes.
    """
    keys = list(keys)
    small_batches(rows.sparkSession)
    ink = staged(ink_rows(rows, otsu(rows, keys), keys, ["hh"]), "ink")
    large = lambda px: (F.floor(F.length(px) / PROXY_SCALE) >= MIN_PROXY) & (F.floor(F.col("hh") / PROXY_SCALE) >= MIN_PROXY)
    first = ink
    if proxy:
        small_rows = staged(quarter_scale(rows.filter(large("px")), keys), "proxy")
        first = ink.filter(~large("ink")).unionByName(ink_rows(small_rows, otsu(small_rows, keys), keys, ["hh"]))
    coarse = best_angles(column_counts(first, keys), keys)
    window = coarse.select(*keys, F.greatest(F.lit(-SWEEP), F.col("angle") - FINE_HALF).alias("lo"), F.least(F.lit(SWEEP), F.col("angle") + FINE_HALF).alias("hi"))
    fine = best_angles(column_counts(ink, keys, window), keys)
    return fine.withColumn("rotate", F.abs("angle") >= MIN_SKEW)


# ---- vertical runs, ruling lines ----------------------------------------------------------------------


def vertical_runs(ink: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """Unbroken vertical ink runs: ``keys, x, y0, y1``; shorter ones than ``least`` may be left out unless they touch the image's border.

    Runs are found inside chunks of ``ROWS_PER_CHUNK`` rows and joined across the chunk borders;
    only the runs that touch a border, not the other ones or the pixels, take part in the second step.
    """
    keys = list(keys)
    chunked = ink.withColumn("chunk", F.floor(F.col("y") / ROWS_PER_CHUNK))

    def runs(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("y")
        y = part["y"].to_numpy()
        grid = np.stack([np.frombuffer(b, np.uint8) for b in part["ink"]])
        span = np.zeros((y[-1] - y[0] + 3, grid.shape[1]), np.int8)
        span[y - y[0] + 1] = grid
        edge = np.diff(span, axis=0).T
        x0, s = np.nonzero(edge == 1)
        _x1, e = np.nonzero(edge == -1)
        out = pd.DataFrame({"x": x0.astype(np.int64), "y0": (s + y[0]).astype(np.int64), "y1": (e + y[0] - 1).astype(np.int64)})
        out["border"] = (out["y0"] == y[0]) | (out["y1"] == y[-1])
        out = out[out["border"] | (out["y1"] - out["y0"] + 1 >= least)]
        for name in keys:
            out[name] = part[name].iloc[0]
        return out[[*keys, "x", "y0", "y1", "border"]]

    found = chunked.groupBy(*keys, "chunk").applyInPandas(runs, _keyed(ink, keys, _long("x"), _long("y0"), _long("y1"), StructField("border", BooleanType())))
    found = staged(found, "found")
    order = Window.partitionBy(*keys, "x").orderBy("y0")
    fresh = F.coalesce(F.lag("y1").over(order) + 1 < F.col("y0"), F.lit(True)).cast("int")
    marked = found.where("border").withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(order))
    joined = marked.groupBy(*keys, "x", "_g").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("_g")
    return joined.unionByName(found.where("not border").drop("border"))


def shortest_inside(kernel: int | Column) -> int | Column:
    """Length of the shortest run that :func:`surviving` keeps away from the image's border, for that kernel or a larger one."""
    return kernel * 2 - 1


def surviving(runs: DataFrame, kernel: Column, height: Column) -> DataFrame:
    """Runs that outlast two openings with a vertical kernel.

    Outside the image counts as ink when shrinking, so runs at a border may be shorter.
    """
    anchor = F.floor(kernel / 2)
    length = F.col("y1") - F.col("y0") + 1
    at_top, at_bottom = F.col("y0") == 0, F.col("y1") == height - 1
    need = (F.when(at_top & at_bottom, F.lit(1)).when(at_top, (kernel - 1 - anchor) * 2 + 1).when(at_bottom, anchor * 2 + 1).otherwise(shortest_inside(kernel)))
    return runs.filter(length >= need)


def vline_rects(runs: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rectangles to erase around printed vertical lines: ``keys, x0, x1, y0, y1``."""
    df = runs.join(sizes.select(*keys, "hh"), list(keys))
    kernel = F.greatest(F.floor(F.col("hh") / 10), F.lit(MASK_MIN_KERNEL))
    return surviving(df, kernel, F.col("hh")).select(*keys, (F.col("x") - MASK_HALF).alias("x0"), (F.col("x") + MASK_HALF).alias("x1"), "y0", "y1")


def without_rects(ink: DataFrame, rects: DataFrame, keys: Sequence[str], column: str = "ink", fill: int = 0) -> DataFrame:
    """Clear the rectangles in every row; use ``fill=255`` to whiten grey rows.

    A rectangle goes to the chunks of rows that it crosses; a chunk has no more of them than the image has columns and gaps.
    """
    keys = list(keys)
    chunk = lambda y: F.floor(F.col(y) / ROWS_PER_CHUNK)
    cuts = (rects.select(*keys, "x0", "x1", "y0", "y1", F.explode(F.sequence(chunk("y0"), chunk("y1"))).alias("_chunk"))
            .groupBy(*keys, "_chunk").agg(F.collect_set(F.struct("x0", "x1", "y0", "y1")).alias("cuts")))
    joined = ink.withColumn("_chunk", chunk("y")).join(cuts, [*keys, "_chunk"], "left")
    columns = list(ink.columns)

    def clear(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for y, row, cuts in zip(part["y"], part[column], part["cuts"], strict=True):
                if cuts is not None:
                    pixels = np.frombuffer(row, np.uint8).copy()
                    for cut in cuts:
                        if cut["y0"] <= y <= cut["y1"]:
                            pixels[max(cut["x0"], 0) : cut["x1"] + 1] = fill
                    row = pixels.tobytes()
                out.append(row)
            yield part[columns].assign(**{column: out})

    return joined.mapInPandas(clear, ink.schema)


def merged_positions(xs: Column) -> Column:
    """Sorted positions with near ones merged: the running value is the floor mean of both."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (x - last <= MERGE_X)
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when(near, F.concat(head, F.array(F.floor((last + x) / 2).cast("bigint")))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(xs), F.expr("cast(array() as array<bigint>)"), step)


def run_endpoints(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last row of runs of at least ``ENDPOINT_RUN`` inked rows, else the whole height.

    ``rows``: ``keys, y, hh, hit``. A key is one line of a half page.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("y")
    islands = rows.filter("hit").withColumn("_g", F.col("y") - F.row_number().over(order))
    runs = islands.groupBy(*keys, "_g").agg(F.min("y").alias("a"), F.max("y").alias("b")).filter(F.col("b") - F.col("a") + 1 >= ENDPOINT_RUN)
    ends = runs.groupBy(*keys).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    sizes = rows.groupBy(*keys).agg(F.max("hh").alias("hh"))
    return sizes.join(ends, keys, "left").select(*keys, F.coalesce("a", F.lit(0)).cast("bigint").alias("y_start"), F.coalesce("b", F.col("hh") - 1).cast("bigint").alias("y_end"))


def touching_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs with ``blob``, the first run ``(x, y0)`` that they are joined to by runs of neighbouring columns whose rows overlap or touch.

    Runs meet by column and by bins of rows, so no half page comes together in one task.
    """
    keys = list(keys)
    own = runs.withColumn("run", F.struct(*keys, "x", "y0"))
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / ROWS_PER_CHUNK), F.floor(high / ROWS_PER_CHUNK))).alias("bin")
    left = own.select(*keys, (F.col("x") + 1).alias("x"), F.col("run").alias("a"), F.col("y0").alias("a0"), F.col("y1").alias("a1"), bins(F.col("y0") - 1, F.col("y1") + 1))
    right = own.select(*keys, "x", F.col("run").alias("b"), "y0", "y1", bins(F.col("y0"), F.col("y1")))
    edges = left.join(right, [*keys, "x", "bin"]).filter((F.col("y0") <= F.col("a1") + 1) & (F.col("y1") >= F.col("a0") - 1)).select("a", "b")
    roots = component_roots(edges)
    return own.join(roots, F.col("run") == F.col("node"), "left").withColumn("blob", F.coalesce("root", "run")).drop("run", "node", "root")


def ruling_lines(ink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertical ruling lines of every half page: ``keys, x_center, y_start, y_end, lines``.

    Surviving runs that touch in neighbouring columns form one blob; tall and narrow blobs are lines. Three
    are expected per half.
    """
    keys = list(keys)
    sizes = ink.select(*keys, "hh").distinct()
    runs = surviving(vertical_runs(ink, keys, shortest_inside(RULE_KERNEL)).join(sizes, keys), F.lit(RULE_KERNEL), F.col("hh"))
    runs = staged(runs.select(*keys, "x", "y0", "y1", "hh"), "runs")
    blobs = (touching_runs(runs, keys).groupBy(*keys, "blob", "hh")
             .agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")))
    width = F.col("x1") - F.col("x0") + 1
    lines = blobs.filter((F.col("y1") - F.col("y0") + 1 > F.col("hh") * RULE_MIN_SHARE) & (width < RULE_MAX_WIDTH))
    centres = lines.groupBy(*keys).agg(merged_positions(F.collect_list((F.col("x0") + F.floor(width / 2)).cast("bigint"))).alias("xs"))
    xs = centres.select(*keys, F.size("xs").alias("lines"), F.explode("xs").alias("x_center"))
    strip = F.substring(F.col("ink").cast("string"), F.greatest(F.col("x_center") - ENDPOINT_HALF, F.lit(0)).cast("int") + 1,
                        (F.col("x_center") + ENDPOINT_HALF + 1 - F.greatest(F.col("x_center") - ENDPOINT_HALF, F.lit(0))).cast("int"))
    hits = ink.join(xs.drop("lines"), keys).select(*keys, "x_center", "y", "hh", (F.instr(strip, "\x01") > 0).alias("hit"))
    return run_endpoints(hits, [*keys, "x_center"]).join(xs, [*keys, "x_center"])


# ---- handwriting ----------------------------------------------------------------------------------------


def _row_runs(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every horizontal run, in order."""
    edge = np.diff(bitmap.astype(np.int8), prepend=0, append=0, axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _joined_runs(y: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For every run the number of the first run of its 8-connected blob; runs come by row and column."""
    label = np.arange(y.size)
    if not y.size:
        return label
    width = int(last.max()) + 4
    low = np.searchsorted(y * width + last + 1, (y + 1) * width + first)
    high = np.searchsorted(y * width + first + 1, (y + 1) * width + last + 2, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(y.size), n)
    b = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    while True:
        least = np.minimum(label[a], label[b])
        moved = label.copy()
        np.minimum.at(moved, label[a], least)
        np.minimum.at(moved, label[b], least)
        moved = moved[moved]
        if (moved == label).all():
            return label
        label = moved


def blob_areas(ink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Areas of the 8-connected ink blobs of every unit: ``keys, blob, area``.

    Blobs are found in chunks of ``ROWS_PER_CHUNK`` rows. What leaves a chunk are its blobs' areas and the runs of its first
    and last row; runs on both sides of a border meet by bins of columns, and the blobs that they join are summed. A blob's
    number is that of its first part, by chunk and order in it.
    """
    keys = list(keys)

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("y")
        top = int(part["chunk"].iloc[0]) * ROWS_PER_CHUNK
        at = part["y"].to_numpy() - top
        bitmap = np.zeros((ROWS_PER_CHUNK, max(len(b) for b in part["ink"])), np.uint8)
        for i, b in zip(at, part["ink"], strict=True):
            bitmap[i, : len(b)] = np.frombuffer(b, np.uint8)
        y, first, last = _row_runs(bitmap)
        blob = _joined_runs(y, first, last)
        start = int(part["chunk"].iloc[0]) << 32
        areas = np.bincount(blob, weights=last - first + 1).astype(np.int64)
        own = np.flatnonzero(areas)
        edge = np.flatnonzero((y == 0) | (y == ROWS_PER_CHUNK - 1))
        found = pd.DataFrame({"blob": start + np.concatenate([own, blob[edge]]), "area": np.concatenate([areas[own], np.zeros(edge.size, np.int64)]),
                              "y": pd.array(np.concatenate([np.full(own.size, -1), y[edge] + top]), "Int64"),
                              "x0": np.concatenate([np.zeros(own.size, np.int64), first[edge]]), "x1": np.concatenate([np.zeros(own.size, np.int64), last[edge]])})
        for name in keys:
            found[name] = part[name].iloc[0]
        return found[[*keys, "blob", "area", "y", "x0", "x1"]]

    chunked = ink.select(*keys, "y", "ink", F.floor(F.col("y") / ROWS_PER_CHUNK).alias("chunk"))
    found = staged(chunked.groupBy(*keys, "chunk").applyInPandas(label, _keyed(ink, keys, _long("blob"), _long("area"), _long("y"), _long("x0"), _long("x1"))), "blobs")
    node = F.struct(*keys, "blob")
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))).alias("bin")
    last = F.col("y") % ROWS_PER_CHUNK == ROWS_PER_CHUNK - 1
    edge = found.filter("y >= 0").withColumn("node", node)
    upper = edge.filter(last).select(*keys, (F.col("y") + 1).alias("y"), F.col("node").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), bins(F.col("x0") - 1, F.col("x1") + 1))
    lower = edge.filter(~last).select(*keys, "y", F.col("node").alias("b"), "x0", "x1", bins(F.col("x0"), F.col("x1")))
    pairs = upper.join(lower, [*keys, "y", "bin"]).filter((F.col("x0") <= F.col("a1") + 1) & (F.col("x1") >= F.col("a0") - 1)).select("a", "b")
    roots = component_roots(pairs).withColumnRenamed("node", "n")
    whole = found.filter("y < 0").withColumn("node", node).join(roots, F.col("node") == F.col("n"), "left")
    return whole.groupBy(*keys, F.coalesce("root.blob", "blob").alias("blob")).agg(F.sum("area").alias("area"))


def handwriting_flags(rows: DataFrame, keys: Sequence[str], min_blob: int = MIN_BLOB, min_share: float = MIN_INK_SHARE) -> DataFrame:
    """``has_handwriting`` of every strip: ink beyond ruling lines and specks. Rows carry ``hh``."""
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.sum(F.length("px")).alias("pixels"), F.max("hh").alias("hh"))
    ink = ink_rows(rows, otsu(rows, keys), keys)
    ink = staged(ink)
    cleaned = without_rects(ink, vline_rects(vertical_runs(ink, keys, shortest_inside(MASK_MIN_KERNEL)), sizes, keys), keys)
    kept = blob_areas(cleaned, keys).filter(F.col("area") >= min_blob).groupBy(*keys).agg(F.sum("area").alias("ink"))
    return (sizes.join(kept, keys, "left").withColumn("ink", F.coalesce("ink", F.lit(0)))
            .withColumn("has_handwriting", F.col("ink") / F.greatest("pixels", F.lit(1)) > min_share).drop("hh"))


def strip_rows(rows: DataFrame, strips: DataFrame, keys: Sequence[str] = ("scan_id", "page")) -> DataFrame:
    """Crops of page rows by pixel rectangles ``keys, box_id, px0, py0, px1, py1``."""
    keys = list(keys)
    inside = rows.join(strips.filter((F.col("px0") < F.col("px1")) & (F.col("py0") < F.col("py1"))), keys).filter(
        (F.col("y") >= F.col("py0")) & (F.col("y") < F.col("py1")))
    return inside.select(*keys, "box_id", (F.col("y") - F.col("py0")).cast("int").alias("y"), (F.col("py1") - F.col("py0")).cast("int").alias("hh"),
                         F.substring("px", F.col("px0").cast("int") + 1, (F.col("px1") - F.col("px0")).cast("int")).alias("px"))


def detect_handwriting(rows: DataFrame, keys: Sequence[str], method: str = "classical", flags: DataFrame | None = None) -> DataFrame:
    """Flags by ink share, or those of another recogniser given as a table."""
    if method == "classical":
        return handwriting_flags(rows, keys)
    if flags is None:
        raise ValueError(f"method {method!r} needs a table of flags")
    every = rows.select(*keys).distinct()
    return every.join(flags, list(keys), "left").withColumn("has_handwriting", F.coalesce("has_handwriting", F.lit(False)))


# ---- anchors ----------------------------------------------------------------------------------------------


def selected_anchors(candidates: DataFrame) -> DataFrame:
    """Best candidate of every page half and side near its top; weak ones are NULL.

    The centre lies half a template from the corner.
    """
    keys = ["scan_id", "page", "half", "side"]
    inside = F.col("y") + F.col("th") <= ANCHOR_ROWS
    best = F.max(F.when(inside, F.struct("score", (-F.col("y")).alias("oy"), (-F.col("x")).alias("ox"), "x", "y", "tw", "th"))).alias("b")
    df = candidates.groupBy(*keys).agg(best)
    ok = F.col("b.score") >= ANCHOR_MIN_SCORE
    centre = lambda c, t: F.when(ok, F.col(f"b.{c}") + F.floor(F.col(f"b.{t}") / 2)).cast("bigint")
    return df.select(*keys, centre("x", "tw").alias("x"), centre("y", "th").alias("y"), F.when(ok, F.round("b.score", 3)).alias("score"))


def template_boxes(words: DataFrame, marker: str = "IGCSE", padding: int = 8) -> DataFrame:
    """Padded box of the most certain word with the marker, first one among equals.

    ``words``: ``scan_id, word_no, text, conf, x, y, w, h, strip_w, strip_h``.
    """
    hit = words.filter(F.contains(F.upper("text"), F.lit(marker)))
    best = hit.groupBy("scan_id").agg(F.max(F.struct("conf", (-F.col("word_no")).alias("o"), "x", "y", "w", "h", "strip_w", "strip_h")).alias("b"))
    b = lambda c: F.col(f"b.{c}")
    return best.select("scan_id", F.greatest(b("x") - padding, F.lit(0)).alias("x0"), F.greatest(b("y") - padding, F.lit(0)).alias("y0"),
                       F.least(b("x") + b("w") + padding, b("strip_w")).alias("x1"), F.least(b("y") + b("h") + padding, b("strip_h")).alias("y1"))
