"""Projection of question boxes from the printed paper onto scanned pages.

Spaces: ``*_pt`` points on the paper, ``*_px`` pixels of a half page, ``*_spt`` points of the scan.
Boxes meet pages by ``(exam_id, half)``; one row per box and page is the result itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page middle of the paper, trims and nudges (pt).
MID_X = 297.6
MID_Y = 420.9
TRIM_LEFT = 22.0
RIGHT_COLUMN_UP = 2.0
MIN_WIDTH = 0.5
TOP_TRIM = 20.0
POINTS_PER_INCH = 72.0


def half_transforms(raw_anchors: DataFrame, scan_anchors: DataFrame) -> DataFrame:
    """Scale and shift of every half page from its left and right anchor; NULL where one is missing.

    ``raw_anchors``: ``exam_id, quadrant, x, y``; ``scan_anchors``: ``exam_id, scan_id, page,
    quadrant, x, y``. Quadrants are ``top_left`` … ``bot_right``.
    """
    raw = raw_anchors.select("exam_id", "quadrant", F.col("x").alias("rx"), F.col("y").alias("ry"))
    both = scan_anchors.join(raw, ["exam_id", "quadrant"]).withColumns(
        {"half": F.substring("quadrant", 1, 3), "side": F.substring("quadrant", 5, 5)})
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    cols = {f"{s[0]}_{c}": pick(s, c) for s in ("left", "right") for c in ("x", "y", "rx", "ry")}
    wide = both.groupBy("exam_id", "scan_id", "page", "half").agg(*[c.alias(n) for n, c in cols.items()])
    scale = (F.col("r_x") - F.col("l_x")) / (F.col("r_rx") - F.col("l_rx"))
    wide = wide.withColumn("scale", scale)
    return wide.select("exam_id", "scan_id", "page", "half", "scale", (F.col("l_x") - F.col("scale") * F.col("l_rx")).alias("tx"),
                       ((F.col("l_y") + F.col("r_y")) / 2.0 - F.col("scale") * F.col("l_ry")).alias("ty"))


def complete_scans(transforms: DataFrame, pages: DataFrame) -> DataFrame:
    """Transforms of the scans in which every page has both halves; other scans have none."""
    halves = pages.select("scan_id", "page", F.explode(F.array(F.lit("top"), F.lit("bot"))).alias("half"))
    ok = F.col("scale").isNotNull() & F.col("tx").isNotNull() & F.col("ty").isNotNull()
    whole = (halves.join(transforms, ["scan_id", "page", "half"], "left").groupBy("scan_id")
             .agg(F.bool_and(ok).alias("ok")).filter("ok").select("scan_id"))
    return transforms.join(whole, "scan_id", "left_semi")


def valid_boxes(boxes: DataFrame, paper_page: int = 1) -> DataFrame:
    """Boxes with an area on the projected page of the paper."""
    return boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("paper_page") == paper_page))


def adjusted_points(boxes: DataFrame) -> DataFrame:
    """Left trim and the small lift of the right column; ``half`` comes from the unadjusted top."""
    lift = F.when((F.col("x0") + F.col("x1")) / 2.0 >= MID_X, RIGHT_COLUMN_UP).otherwise(0.0)
    left = F.col("x0") + TRIM_LEFT
    return boxes.withColumns({
        "half": F.when(F.col("y0") < MID_Y, "top").otherwise("bot"),
        "x0": F.when(left >= F.col("x1"), F.col("x1") - MIN_WIDTH).otherwise(left), "y0": F.col("y0") - lift, "y1": F.col("y1") - lift})


def projected(boxes: DataFrame, transforms: DataFrame) -> DataFrame:
    """Every box on every page of the scans of its exam, in half-page pixels."""
    s, tx, ty = F.col("scale"), F.col("tx"), F.col("ty")
    return adjusted_points(boxes).join(transforms, ["exam_id", "half"]).withColumns({
        "x0": s * F.col("x0") + tx, "y0": s * F.col("y0") + ty, "x1": s * F.col("x1") + tx, "y1": s * F.col("y1") + ty}).drop("scale", "tx", "ty")


def page_rects(boxes: DataFrame, pages: DataFrame, dpi: int) -> DataFrame:
    """Half-page pixels to points of the scan page, cut to the page; empty ones drop out.

    ``pages``: ``scan_id, page, w, h`` in points.
    """
    f = POINTS_PER_INCH / dpi
    df = boxes.join(pages.select("scan_id", "page", "w", "h"), ["scan_id", "page"])
    shift = F.when(F.col("half") == "top", 0.0).otherwise(F.floor(F.bround(F.col("h") / f, 0) / 2).cast("double"))
    df = df.withColumn("_s", shift)
    lo = lambda a, b: F.least(a, b)
    hi = lambda a, b: F.greatest(a, b)
    df = df.withColumns({
        "x0": F.greatest(lo("x0", "x1") * f, F.lit(0.0)), "x1": F.least(hi("x0", "x1") * f, F.col("w")),
        "y0": F.greatest((lo("y0", "y1") + F.col("_s")) * f, F.lit(0.0)), "y1": F.least((hi("y0", "y1") + F.col("_s")) * f, F.col("h"))})
    return df.drop("_s").filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))


def margin_strips(rects: DataFrame) -> DataFrame:
    """Strip between the page edge and every exercise box, on the side of its column.

    Answer blanks have none. The strip keeps the ``box_id``.
    """
    df = rects.filter(~F.col("is_blank"))
    left = (F.col("x0") + F.col("x1")) / 2.0 < F.col("w") / 2.0
    df = df.withColumns({"sx0": F.when(left, 0.0).otherwise(F.col("x1")), "sx1": F.when(left, F.col("x0")).otherwise(F.col("w"))})
    return (df.filter((F.col("sx0") < F.col("sx1")) & (F.col("y0") < F.col("y1")))
            .select("scan_id", "page", "box_id", F.col("sx0").alias("x0"), "y0", F.col("sx1").alias("x1"), "y1"))


def trimmed_tops(rects: DataFrame, trim: float = TOP_TRIM) -> DataFrame:
    """``trimmed``: the topmost exercise box of a page quadrant, if it is higher than the trim.

    Ties go to the first box. One aggregate per quadrant finds it, no sort.
    """
    key = ["scan_id", "page"]
    quadrant = (F.when((F.col("x0") + F.col("x1")) / 2.0 < F.col("w") / 2.0, 0).otherwise(1)
                + F.when((F.col("y0") + F.col("y1")) / 2.0 < F.col("h") / 2.0, 0).otherwise(2))
    df = rects.filter(~F.col("is_blank")).withColumn("quadrant", quadrant)
    top = df.groupBy(*key, "quadrant").agg(F.min_by("box_id", F.struct("y0", "box_id")).alias("box_id")).withColumn("_t", F.lit(True))
    df = df.join(top, [*key, "quadrant", "box_id"], "left")
    hit = F.col("_t").isNotNull() & (F.col("y0") + trim < F.col("y1"))
    return df.withColumn("trimmed", hit).withColumn("y0", F.when(F.col("trimmed"), F.col("y0") + trim).otherwise(F.col("y0"))).drop("_t")


def trimmed_strips(strips: DataFrame, trimmed: DataFrame, trim: float = TOP_TRIM) -> DataFrame:
    """Strips follow the trim of their boxes, as long as something of them is left."""
    flags = trimmed.select("scan_id", "page", "box_id", "trimmed")
    cut = F.col("trimmed") & (F.col("y0") + trim < F.col("y1"))
    return strips.join(flags, ["scan_id", "page", "box_id"]).withColumn("y0", F.when(cut, F.col("y0") + trim).otherwise(F.col("y0"))).drop("trimmed")


def adjusted_boxes(rects: DataFrame, strips: DataFrame, flags: DataFrame) -> DataFrame:
    """Boxes with handwriting in their margin strip grow over it; the others stay.

    Box, strip and flag meet by ``(scan_id, page, box_id)``; boxes without a strip drop out.
    """
    key = ["scan_id", "page", "box_id"]
    s = strips.select(*key, *[F.col(c).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
    df = rects.join(s, key).join(flags.select(*key, "has_handwriting"), key)
    on = F.col("has_handwriting")
    grow = lambda c, f: F.when(on, f(c, f"s{c}")).otherwise(F.col(c)).alias(c)
    return df.select(*key, grow("x0", F.least), grow("y0", F.least), grow("x1", F.greatest), grow("y1", F.greatest), on.alias("expanded"))


def paired_pages(transforms: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that have a transform and a raster; the longer list is cut."""
    return pages.join(transforms.select("scan_id", "page").distinct(), ["scan_id", "page"], "left_semi")


def pixel_rect(df: DataFrame, dpi: int, w_px: Column, h_px: Column) -> DataFrame:
    """Whole-pixel crop of a rectangle in points, inside the raster."""
    f = POINTS_PER_INCH / dpi
    cut = lambda c: (F.col(c) / f).cast("bigint")
    return df.withColumns({"px0": F.greatest(cut("x0"), F.lit(0).cast("bigint")), "py0": F.greatest(cut("y0"), F.lit(0).cast("bigint")),
                           "px1": F.least(cut("x1"), w_px), "py1": F.least(cut("y1"), h_px)})
