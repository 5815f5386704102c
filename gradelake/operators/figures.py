"""Figures, writing areas, answer blanks and sheet labels on pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.text import strip
from gradelake.operators.layout import BOX, CONFIG, PAGE, LayoutConfig, common_area, overlaps

# Answer-blank lines, figure captions, sheet marker, quadrant names.
BLANK_LINE = r"=\s*[\s.·•\-_]{3,}\s*\[\s*\d+\s*\]"
CAPTION = r"(?i)^Fig(?:\.|ure)?\b"
SHEET_MARKER = "IGCSE"
QUADRANTS = ("top_left", "top_right", "bot_left", "bot_right")


def union_box() -> list[Column]:
    """Aggregates of the rectangle around the rows of a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def figures_in_clips(clips: DataFrame, drawings: DataFrame, lines: DataFrame, pages: DataFrame, keys: Sequence[str],
                     cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Raster images of every clip, else its largest compact drawing with the short labels around it.

    ``clips``: ``keys`` (with the page) and ``kx0 … ky1``. Result: ``keys, kind, figure_no`` and the
    padded box, which stays inside page and clip. Captions are no labels.
    """
    keys = list(keys)
    clip = ("kx0", "ky0", "kx1", "ky1")
    joined = clips.join(drawings, PAGE).filter(overlaps(BOX, clip))
    cut = joined.select(*keys, *clip, "kind", F.col("y0").alias("oy0"), F.col("x0").alias("ox0"), F.greatest("x0", "kx0").alias("x0"), F.greatest("y0", "ky0").alias("y0"),
                        F.least("x1", "kx1").alias("x1"), F.least("y1", "ky1").alias("y1"))
    images = cut.filter(F.col("kind") == "raster")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    short, long = F.least(w, h), F.greatest(w, h)
    compact = (short >= F.greatest(F.lit(1.0), F.lit(cfg.figure_min_short_side))) & (w * h >= cfg.figure_min_area) & (long / short <= cfg.figure_max_aspect)
    best = (cut.filter((F.col("kind") != "raster") & compact).withColumn("area", w * h).groupBy(*keys, *clip)
            .agg(F.max(F.struct("area", (-F.col("y0")).alias("o1"), (-F.col("x0")).alias("o2"), *BOX)).alias("b")).select(*keys, *clip, "b.x0", "b.y0", "b.x1", "b.y1"))
    best = best.join(images.select(*keys).distinct(), keys, "left_anti")
    search = best.select(*keys, F.greatest("kx0", F.col("x0") - cfg.label_h_pad).alias("sx0"), F.greatest("ky0", F.col("y0") - cfg.label_v_pad).alias("sy0"),
                         F.least("kx1", F.col("x1") + cfg.label_h_pad).alias("sx1"), F.least("ky1", F.col("y1") + cfg.label_v_pad).alias("sy1"))
    t = strip(F.col("text"))
    labels = (search.join(lines, PAGE).filter(overlaps(BOX, ("sx0", "sy0", "sx1", "sy1")) & (t != "") & (F.length(t) <= cfg.label_max_chars) & ~t.rlike(CAPTION))
              .groupBy(*keys).agg(F.min("x0").alias("lx0"), F.min("y0").alias("ly0"), F.max("x1").alias("lx1"), F.max("y1").alias("ly1")))
    vector = best.join(labels, keys, "left").select(*keys, *clip, F.lit("vector").alias("kind"), F.col("y0").alias("oy0"), F.col("x0").alias("ox0"),
                                                     F.least("x0", "lx0").alias("x0"), F.least("y0", "ly0").alias("y0"), F.greatest("x1", "lx1").alias("x1"), F.greatest("y1", "ly1").alias("y1"))
    pad = cfg.image_crop_pad
    found = images.unionByName(vector).join(pages, PAGE)
    boxed = found.withColumns({
        "x0": F.greatest(F.lit(0.0), F.col("x0") - pad, F.col("kx0")), "y0": F.greatest(F.lit(0.0), F.col("y0") - pad, F.col("ky0")),
        "x1": F.least(F.col("w"), F.col("x1") + pad, F.col("kx1")), "y1": F.least(F.col("h"), F.col("y1") + pad, F.col("ky1"))})
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("oy0", "ox0", "x1", "y1")
    kept = boxed.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    return kept.withColumn("figure_no", F.row_number().over(order)).select(*keys, "kind", "figure_no", *BOX)


def assets_to_nodes(assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every asset goes to the deepest node of its question on its page that spans its centre, else to the root.

    ``assets``: ``exam_id, qid, page, asset_id`` with box; ``nodes``: ``exam_id, qid, page, path``
    with box. A node hidden below one of another page is out of reach.
    """
    a = assets.select("exam_id", "qid", "asset_id", F.col("page").alias("ap"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    pages = (nodes.groupBy("exam_id", "qid").agg(F.map_from_entries(F.collect_list(F.struct("path", "page"))).alias("_pages")))
    n = nodes.join(pages, ["exam_id", "qid"]).withColumn("_chain", F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("path")), lambda d: F.element_at("_pages", F.slice("path", F.lit(1), d)))))
    reach = n.filter(F.size("_chain") == 1).select("exam_id", "qid", "path", F.col("page").alias("np"), "y0", "y1")
    hits = (a.join(reach, ["exam_id", "qid"]).filter((F.col("np") == F.col("ap")) & F.col("cy").between(F.col("y0") - 1, F.col("y1") + 1))
            .groupBy("exam_id", "qid", "asset_id").agg(F.max(F.size("path")).alias("d"),
                                                       F.min(F.struct((-F.size("path")).alias("o"), "path"))["path"].alias("path")))
    roots = nodes.filter(F.size("path") == 1).select("exam_id", "qid", F.col("path").alias("_root"))
    return (assets.join(hits.drop("d"), ["exam_id", "qid", "asset_id"], "left").join(roots, ["exam_id", "qid"])
            .withColumn("path", F.coalesce("path", "_root")).drop("_root"))


def _char_x(spans: Column, pos: Column) -> Column:
    """x of the character at a position, interpolated inside its span."""
    start = F.struct(F.lit(0).alias("seen"), F.lit(None).cast("double").alias("x"))

    def step(acc, s):
        n = F.length(s["text"])
        local = pos - acc["seen"]
        here = acc["x"].isNull() & (local >= 0) & (local < n)
        at = F.when(n <= 1, s["x0"]).otherwise(s["x0"] + (s["x1"] - s["x0"]) * local / n)
        return F.struct((acc["seen"] + n).alias("seen"), F.when(here, at).otherwise(acc["x"]).alias("x"))

    return F.aggregate(spans, start, step, lambda acc: acc["x"])


def answer_blanks(nodes: DataFrame, lines: DataFrame, keys: Sequence[str], cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Box of the blank in every ``label = …… [n]`` line of written leaves.

    ``nodes``: ``keys`` (with the page), ``question_type``, ``is_leaf``, box and cell box;
    ``lines`` carry ``spans``.
    """
    keys = list(keys)
    n = nodes.filter(F.col("is_leaf") & (F.col("question_type") != "multiple_choice")).select(
        *keys, *[F.col(c).alias(f"n{c}") for c in ("y0", "y1")], "cx0", "cx1", "cy1")
    band = ("cx0", "ny0", "cx1", "ny1")
    inside = n.join(lines, PAGE).filter(overlaps(BOX, band) & (common_area(BOX, band) >= 0.5)).withColumn("t", strip(F.col("text")))
    # Tops of the printed lines of one node; a node lies on one page.
    tops = inside.filter(F.col("t") != "").groupBy(*keys).agg(F.array_sort(F.collect_set("y0")).alias("tops"))
    blanks = inside.filter(F.col("t").rlike(BLANK_LINE)).join(tops, keys)
    eq = F.instr("t", "=")
    after = F.substr("t", eq + 1)
    start = eq + F.length(after) - F.length(F.ltrim(after))
    bracket = F.length("t") - F.instr(F.reverse("t"), "[")
    blanks = blanks.withColumns({"_s": start, "_b": bracket}).filter(F.col("_b") > F.col("_s"))
    bx0 = F.greatest(F.coalesce(F.nullif(_char_x(F.col("spans"), F.col("_s")), F.lit(0.0)), "x0"), "cx0")
    bx1 = F.least(F.coalesce(F.nullif(_char_x(F.col("spans"), F.col("_b")), F.lit(0.0)), "x1"), "cx1")
    below = F.get(F.filter("tops", lambda y: y > F.col("y1")), F.lit(0))
    low = F.col("y1") + cfg.blank_pad_below
    free = F.when(F.col("cy1") - F.col("y1") <= cfg.blank_bottom_tol, low).otherwise(F.least("ny1", low))
    top = F.greatest(F.col("y0") - cfg.blank_pad_above + cfg.blank_nudge, F.col("ny0"))
    bottom = F.least(F.coalesce(below - 2.0, free) + cfg.blank_nudge, F.col("ny1"))
    out = blanks.select(*keys, F.col("y0").alias("line_y0"), bx0.alias("x0"), top.alias("y0"), bx1.alias("x1"), bottom.alias("y1"))
    return out.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0") + 2.0))


def label_centres(lines: DataFrame, marker: str = SHEET_MARKER) -> DataFrame:
    """Centres of marker lines, one per point of a rounded grid (the first in reading order)."""
    df = lines.filter(F.contains("text", F.lit(marker))).select(
        *PAGE, "block", "line", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    first = F.min(F.struct("block", "line", "cx", "cy"))
    return (df.groupBy(*PAGE, F.bround("cx", 0).alias("gx"), F.bround("cy", 0).alias("gy")).agg(first.alias("f"))
            .select(*PAGE, F.col("f.cx").alias("cx"), F.col("f.cy").alias("cy"), F.col("f.block").alias("block"), F.col("f.line").alias("line")))


def topmost_labels(centres: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topmost label of every page quadrant, and the ``missing`` quadrants per page."""
    df = centres.join(pages, PAGE)
    quadrant = F.concat_ws("_", F.when(F.col("cy") < F.col("h") / 2, "top").otherwise("bot"), F.when(F.col("cx") < F.col("w") / 2, "left").otherwise("right"))
    top = (df.groupBy(*PAGE, quadrant.alias("quadrant")).agg(F.min(F.struct("cy", "block", "line", "cx")).alias("m"))
           .select(*PAGE, "quadrant", F.col("m.cx").alias("x"), F.col("m.cy").alias("y")))
    wanted = pages.select(*PAGE, F.explode(F.array(*[F.lit(q) for q in QUADRANTS])).alias("quadrant"))
    return top, wanted.join(top, [*PAGE, "quadrant"], "left_anti")
