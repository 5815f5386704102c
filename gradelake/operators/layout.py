"""Page cells, question anchors, regions and clips of printed papers.

Every range join carries ``(exam_id, page)`` as its equality key, and a page holds a bounded
number of lines, so no join grows beyond the lines of single pages. Windows are keyed by page or
cell; only the running number of a repeated question spans an exam, and it runs in page blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.functions.text import strip
from gradelake.operators.ordered import rank_in_order

PAGE = ["exam_id", "page"]
CELL = ["exam_id", "page", "cell_no"]

# Nominal page, page sizes that hold four sheets, footer texts and distances (pt).
A4_W = 595.276
A4_H = 841.89
FOUR_UP_MIN = (700.0, 950.0)
A3_LANDSCAPE_MIN = (1000.0, 600.0)
SECOND_COLUMN_AT = 0.42
DISCLAIMERS = ("permission to reproduce", "third-party owned material", "copyright acknowledgements booklet")
MIN_TRIM_GAP = 4.0
FOOTER_MARGIN = 15.0
SEPARATOR_MIN_WIDTH = 100.0


@dataclass(frozen=True)
class LayoutConfig:
    """Tunable distances in points and font limits."""

    margin_bottom: float = 790.0
    anchor_margin_top: float = 10.0
    question_x_max: float = 60.0
    font_size_min: float = 5.0
    font_size_max: float = 14.0
    padding_above: float = 8.0
    text_clip_pad_above: float = 2.0
    image_crop_pad: float = 5.0
    figure_min_area: float = 400.0
    figure_min_short_side: float = 20.0
    figure_max_aspect: float = 6.0
    label_h_pad: float = 32.0
    label_v_pad: float = 10.0
    label_max_chars: int = 56
    snap_top: float = 20.0
    snap_bottom: float = 24.0
    leaf_gap: float = 2.0
    blank_pad_above: float = 30.0
    blank_pad_below: float = 25.0
    blank_bottom_tol: float = 40.0
    blank_nudge: float = 5.0


CONFIG = LayoutConfig()


def first_text(df: DataFrame) -> Column:
    """Text of the first span where spans are given, else of the line."""
    return F.coalesce(F.get("spans", F.lit(0))["text"], F.col("text")) if "spans" in df.columns else F.col("text")


# ---- cells -------------------------------------------------------------------------------------


def page_cells(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells of every page in reading order: ``exam_id, page, cell_no, cx0, cy0, cx1, cy1``."""
    t = first_text(lines)
    facts = (lines.select(*PAGE, "x0", "y0", t.alias("t")).join(pages, PAGE).groupBy(*PAGE).agg(
        F.count_if((F.col("x0") >= F.col("w") * SECOND_COLUMN_AT) & T.looks_like_column_number(F.col("t"))).alias("right_numbers"),
        F.bool_or((F.col("y0") > F.col("h") / 2) & T.looks_like_anchor(F.col("t"))).alias("low_anchor")))
    df = pages.join(facts, PAGE, "left")
    w, h = F.col("w"), F.col("h")
    portrait = h >= w
    two_columns = F.coalesce(F.col("right_numbers") >= 2, F.lit(False))
    four = (F.when(portrait & (w >= FOUR_UP_MIN[0]) & (h >= FOUR_UP_MIN[1]), True)
            .when(portrait, two_columns & F.coalesce("low_anchor", F.lit(False)))
            .otherwise((w >= A3_LANDSCAPE_MIN[0]) & (h >= A3_LANDSCAPE_MIN[1])))
    mx, my, zero = w * 0.5, h * 0.5, F.lit(0.0)
    cell = lambda a, b, c, d: F.struct(a.alias("cx0"), b.alias("cy0"), c.alias("cx1"), d.alias("cy1"))
    quadrants = F.array(cell(zero, zero, mx, my), cell(mx, zero, w, my), cell(zero, my, mx, h), cell(mx, my, w, h))
    columns = F.array(cell(zero, zero, mx, h), cell(mx, zero, w, h))
    cells = F.when(four, quadrants).when(~portrait | two_columns, columns).otherwise(F.array(cell(zero, zero, w, h)))
    return df.select(*PAGE, F.posexplode(cells).alias("cell_no", "c")).select(*CELL, "c.*")


def with_margins(cells: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Scale of a cell against the nominal page, and its margin band."""
    sy = (F.col("cy1") - F.col("cy0")) / A4_H
    return cells.withColumns({
        "sx": (F.col("cx1") - F.col("cx0")) / A4_W, "sy": sy,
        "m_top": F.col("cy0") + F.lit(cfg.anchor_margin_top) * sy,
        "m_bottom": F.least(F.col("cy0") + F.lit(cfg.margin_bottom) * sy, F.col("cy1") - 1.0)})


def overlaps(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Two rectangles share an area."""
    ax0, ay0, ax1, ay1 = (F.col(c) for c in a)
    bx0, by0, bx1, by1 = (F.col(c) for c in b)
    return (ax0 < ax1) & (ay0 < ay1) & (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)


def common_area(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    ax0, ay0, ax1, ay1 = (F.col(c) for c in a)
    bx0, by0, bx1, by1 = (F.col(c) for c in b)
    return (F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
            * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0)))


BOX = ("x0", "y0", "x1", "y1")
CELL_BOX = ("cx0", "cy0", "cx1", "cy1")


def lines_in_cells(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """A line belongs to every cell it touches."""
    return lines.join(cells, PAGE).filter(overlaps(BOX, CELL_BOX))


def cell_of_point(df: DataFrame, cells: DataFrame, pages: DataFrame, x: Column, y: Column, keys: list[str]) -> DataFrame:
    """First cell with the point, the whole page where none has it. ``keys`` identify a row with its page."""
    pts = df.select(*keys, x.alias("_x"), y.alias("_y"))
    inside = ((F.col("_x") >= F.col("cx0")) & (F.col("_x") < F.col("cx1")) & (F.col("_y") >= F.col("cy0")) & (F.col("_y") < F.col("cy1")))
    first = F.min(F.when(inside, F.struct("cell_no", *CELL_BOX)))
    found = pts.join(cells, PAGE).groupBy(*keys).agg(first.alias("_c"))
    return (df.join(found, keys, "left").join(pages, PAGE, "left").withColumns({
        "cell_no": F.col("_c.cell_no"), "cx0": F.coalesce("_c.cx0", F.lit(0.0)), "cy0": F.coalesce("_c.cy0", F.lit(0.0)),
        "cx1": F.coalesce("_c.cx1", "w"), "cy1": F.coalesce("_c.cy1", "h")}).drop("_c", "w", "h"))


# ---- anchors and regions --------------------------------------------------------------------------


def question_anchors(lines: DataFrame, cells: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Printed question numbers in the margins, numbered by their occurrence in the exam.

    A number found again is ``n_2``, ``n_3`` … in the order page, cell, block, line.
    """
    df = lines_in_cells(lines.withColumn("_t", first_text(lines)), with_margins(cells, cfg))
    spans = F.get("spans", F.lit(0))["x1"] if "spans" in lines.columns else F.lit(None).cast("double")
    df = df.filter(F.col("y0").between(F.col("m_top"), F.col("m_bottom"))
                   & (F.col("x0") <= F.col("cx0") + F.lit(cfg.question_x_max) * F.col("sx"))
                   & F.col("font_size").between(cfg.font_size_min, cfg.font_size_max))
    df = df.withColumn("raw", T.question_number(F.col("_t"), F.col("y0"), F.col("cy1") - 2.0)).filter(F.col("raw").isNotNull())
    df = rank_in_order(df, ["exam_id", "raw"], "page", [F.col("cell_no"), F.col("block"), F.col("line")], "occ")
    qid = F.concat(F.col("raw").cast("string"), F.when(F.col("occ") > 1, F.concat(F.lit("_"), F.col("occ").cast("string"))).otherwise(""))
    return df.select("exam_id", "page", "cell_no", *CELL_BOX, "sx", "sy", "m_top", "m_bottom", "raw", "occ", qid.alias("qid"),
                     F.col("y0").alias("qy0"), F.coalesce(spans, "x1").alias("num_x1"), "block", "line")


def segments(anchors: DataFrame) -> DataFrame:
    """Region of every question from its number to the next one of the cell.

    ``seg_no`` grows in reading order (page, cell, top).
    """
    order = Window.partitionBy(*CELL).orderBy("qy0", "block", "line")
    rn = F.row_number().over(order)
    nxt = F.lead("qy0").over(order)
    df = anchors.withColumns({"_n": rn, "_next": nxt})
    return df.withColumns({
        "seg_no": (F.col("page").cast("bigint") * 1000000000000 + F.col("cell_no").cast("bigint") * 1000000 + F.col("_n")).cast("bigint"),
        "y_start": F.greatest("qy0", "m_top"),
        "y_end": F.when(F.col("_next").isNotNull(), F.least("_next", "m_bottom")).otherwise(F.least("m_bottom", F.col("cy1") - 1.0)),
        "snap_top": F.col("_n") == 1, "snap_bottom": F.col("_next").isNull()}).drop("_n", "_next")


def tightened(segs: DataFrame, lines: DataFrame, drawings: DataFrame) -> DataFrame:
    """End the last region of a cell above a disclaimer, else below the last thing printed in it."""
    key = ["exam_id", "page", "qid"]
    last = segs.filter("snap_bottom").select(*key, *CELL_BOX, "y_start", "y_end")
    blank = strip(F.col("text")) == ""
    blocks = lines.groupBy(*PAGE, "block").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), " ")).alias("flat"))
    notice = F.col("flat").contains(DISCLAIMERS[0])
    for d in DISCLAIMERS[1:]:
        notice = notice | F.col("flat").contains(d)
    above = (last.join(blocks.filter(notice), PAGE).filter(overlaps(BOX, CELL_BOX) & F.col("y0").between(F.col("y_start"), F.col("y_end")))
             .groupBy(*key).agg(F.min("y0").alias("notice_y")))
    last = last.join(above, key, "left")
    wide = F.col("x1") - F.col("x0")
    rules = (last.filter(F.col("notice_y").isNotNull()).join(drawings, PAGE)
             .filter(overlaps(BOX, CELL_BOX) & (wide >= SEPARATOR_MIN_WIDTH) & (F.col("y0") >= F.col("notice_y") - FOOTER_MARGIN) & (F.col("y0") < F.col("notice_y")))
             .groupBy(*key).agg(F.min("y0").alias("rule_y")))
    last = last.join(rules, key, "left").withColumn("footer", F.coalesce(F.least("notice_y", "rule_y"), "y_end"))
    last = last.withColumn("stop", F.least("y_end", F.col("footer") - 2.0))
    in_range = F.col("by0").between(F.col("y_start") - 5, F.col("stop"))
    frames = blocks.select(*PAGE, "block", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    frames = last.join(frames, PAGE).filter(overlaps(("bx0", "by0", "bx1", "by1"), CELL_BOX) & in_range)
    printed = (frames.join(lines.filter(~blank).select(*PAGE, "block", "line", "y0", "y1"), [*PAGE, "block"])
               .filter(F.col("y0") <= F.col("stop")).groupBy(*key, "block").agg(F.max_by(F.least("y1", "stop"), "line").alias("b"))
               .groupBy(*key).agg(F.max("b").alias("text_y")))
    drawn = (last.join(drawings, PAGE).filter(overlaps(BOX, CELL_BOX) & F.col("y0").between(F.col("y_start") - 5, F.col("stop")) & (wide >= 10))
             .groupBy(*key).agg(F.max(F.least("y1", "stop")).alias("draw_y")))
    last = last.join(printed, key, "left").join(drawn, key, "left")
    bottom = F.coalesce(F.greatest("text_y", "draw_y", "y_start"), "y_start")
    tight = F.least(bottom + 4.0, F.col("stop"))
    end = (F.when((bottom <= F.col("y_start")) & (F.col("footer") < F.col("y_end") - MIN_TRIM_GAP), F.greatest("y_start", "stop"))
           .when((bottom > F.col("y_start")) & (tight < F.col("y_end") - MIN_TRIM_GAP), tight).otherwise(F.col("y_end")))
    ends = last.select(*key, end.alias("_end"))
    return segs.join(ends, key, "left").withColumn("y_end", F.coalesce("_end", "y_end")).drop("_end")


def with_clips(segs: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Box of a region (``x0 … y1``) and the clip of its text (``tx0 … ty1``)."""
    pad = F.least(F.lit(cfg.padding_above) * F.col("sy"), F.lit(cfg.text_clip_pad_above) * F.col("sy"))
    left = F.greatest("cx0", "num_x1")
    return segs.withColumns({
        "x0": F.col("cx0"), "x1": F.col("cx1"),
        "y0": F.when(F.col("snap_top"), F.col("cy0")).otherwise(F.col("y_start")),
        "y1": F.when(F.col("snap_bottom"), F.col("cy1")).otherwise(F.col("y_end")),
        "tx0": F.when(left >= F.col("cx1") - 5.0, F.col("cx0")).otherwise(left), "tx1": F.col("cx1"),
        "ty0": F.greatest(F.col("y_start") - pad, "m_top"), "ty1": F.col("y_end")})


def clip_lines(lines: DataFrame, segs: DataFrame, share: float = 0.25) -> DataFrame:
    """Non-blank lines with at least a quarter of their area in the text clip of a region."""
    clip = ("tx0", "ty0", "tx1", "ty1")
    s = segs.select(*PAGE, "qid", "raw", "seg_no", *clip, F.col("y_end").alias("seg_y1"))
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    body = strip(F.col("text"))
    return (lines.join(s, PAGE).filter(overlaps(BOX, clip) & (common_area(BOX, clip) >= own * share) & (body != ""))
            .withColumn("text", body))


def leaf_tops(leaves: DataFrame, lines: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Move the top of all but the first leaf of a cell up to the last printed line above it.

    ``leaves``: ``exam_id, page, node`` with its box and cell columns. Totals and sheet labels do
    not count as printed lines; a top never moves down.
    """
    key = [*PAGE, "node"]
    rank = F.row_number().over(Window.partitionBy(*PAGE, *CELL_BOX).orderBy("y0", "x0", "node"))
    df = leaves.withColumn("_r", rank)
    t = strip(F.col("text"))
    counted = lines.filter((t != "") & ~t.rlike(r"(?i)^\[Total:") & ~t.rlike(T.SHEET_LABEL)).select(
        *PAGE, F.col("x0").alias("lx0"), F.col("y0").alias("ly0"), F.col("x1").alias("lx1"), F.col("y1").alias("ly1"))
    above = (df.filter(F.col("_r") > 1).select(*key, *CELL_BOX, F.col("y0").alias("_top")).join(counted, PAGE)
             .filter(overlaps(("lx0", "ly0", "lx1", "ly1"), ("cx0", "cy0", "cx1", "_top")) & (F.col("ly1") <= F.col("_top")))
             .groupBy(*key).agg(F.max("ly1").alias("_last")))
    new = F.greatest(F.coalesce("_last", "cy0"), "cy0") + cfg.leaf_gap
    return (df.join(above, key, "left")
            .withColumn("y0", F.when((F.col("_r") > 1) & (new < F.col("y0")), new).otherwise(F.col("y0"))).drop("_r", "_last"))


def edge_snapped(df: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Boxes of figures and writing areas that sit on a cell edge reach to that edge.

    ``df`` has the box, the cell box of the owning node, and ``m_top``.
    """
    return df.withColumns({
        "y0": F.when(F.col("y0") <= F.col("m_top") + cfg.snap_top, F.col("cy0")).otherwise(F.col("y0")),
        "y1": F.when(F.col("y1") >= F.col("cy1") - cfg.snap_bottom, F.col("cy1")).otherwise(F.col("y1"))})


def leaf_snapped(nodes: DataFrame, segs: DataFrame) -> DataFrame:
    """First leaf of the first region of a cell starts at the cell top, last leaf of the last ends at its bottom.

    ``nodes``: ``exam_id, qid, path, is_leaf`` with box; ``segs`` give the cell and the flags.
    """
    key = ["exam_id", "qid"]
    ends = nodes.filter("is_leaf").groupBy(*key).agg(F.min("path").alias("_first"), F.max("path").alias("_last"))
    s = segs.select(*key, F.col("cy0").alias("_cy0"), F.col("cy1").alias("_cy1"), "snap_top", "snap_bottom")
    return (nodes.join(ends, key).join(s, key).withColumns({
        "y0": F.when(F.col("snap_top") & (F.col("path") == F.col("_first")), F.col("_cy0")).otherwise(F.col("y0")),
        "y1": F.when(F.col("snap_bottom") & (F.col("path") == F.col("_last")), F.col("_cy1")).otherwise(F.col("y1"))})
        .drop("_first", "_last", "_cy0", "_cy1", "snap_top", "snap_bottom"))
