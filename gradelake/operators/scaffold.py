"""Whole exams in one plan: the question tree with figures and blanks, answers of the key, stored form and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.operators import build, figures, layout, tree
from gradelake.operators.layout import CONFIG, LayoutConfig
from gradelake.operators.ordered import rank_in_order
from gradelake.session import staged

NODE = ["exam_id", "path"]


def question_images(segs: DataFrame, cells: DataFrame, drawings: DataFrame, lines: DataFrame, pages: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Figures of all regions, numbered over the exam in reading order, as wide as their cell: ``…, image_no, file`` with box."""
    found = build.question_figures(segs, drawings, lines, pages, cfg).join(segs.select("exam_id", "qid", "seg_no"), ["exam_id", "qid"])
    found = rank_in_order(found, ["exam_id"], "page", [F.col("seg_no"), F.col("figure_no")], "image_no")
    wide = layout.cell_of_point(found, cells, pages, (F.col("x0") + F.col("x1")) * 0.5, (F.col("y0") + F.col("y1")) * 0.5, ["exam_id", "page", "image_no"])
    name = F.format_string("scaffold_images/q%s_p%d_%d.png", T.safe_stem(F.col("qid")), "page", "image_no")
    return wide.select("exam_id", "qid", "page", F.col("image_no").alias("asset_id"), name.alias("file"), F.col("cx0").alias("x0"), "y0", F.col("cx1").alias("x1"), "y1")


def _box() -> Column:
    return F.struct(*layout.BOX, "page").alias("bbox")


def attached(nodes: DataFrame, split: DataFrame, images: DataFrame, lines: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Placed ``nodes`` with the lists of :data:`tree.LISTS`.

    An image goes to the deepest node of ``split`` (the boxes of the printed lines) that spans its centre, and reaches to
    the edge of that node's cell where it sits on it. Blanks are those of the final boxes; ``lines`` carry spans. Both kinds
    meet the nodes in one join. Writing areas are never found on papers of this kind; their list is empty.
    """
    cell = nodes.select(*NODE, *layout.CELL_BOX)
    owned = figures.assets_to_nodes(images, split).join(layout.with_margins(cell, cfg), NODE)
    shown = layout.edge_snapped(owned, cfg).select(*NODE, F.col("asset_id").cast("double").alias("at"), _box(), "file")
    blanks = figures.answer_blanks(nodes, lines, ["exam_id", "page", "path"], cfg)
    empty = blanks.select(*NODE, F.col("line_y0").alias("at"), _box(), F.lit(None).cast("string").alias("file"))
    image, blank = F.col("file").isNotNull(), F.col("file").isNull()
    listed = lambda kind, item: F.transform(F.array_sort(F.collect_list(F.when(kind, F.struct("at", item.alias("v"))))), lambda s: s["v"])
    lists = shown.unionByName(empty).groupBy(*NODE).agg(
        listed(image, F.struct("bbox", F.col("file").alias("path"))).alias("images"), listed(blank, F.col("bbox")).alias("equation_blank_bboxes"))
    return tree.with_lists(nodes.join(lists, NODE, "left")).withColumn("bbox", _box())


def key_sources(lines: DataFrame, pages: DataFrame, drawings: DataFrame, cfg: LayoutConfig = CONFIG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(margin, table_rows, letters)`` of answer keys, all from the lines of their pages."""
    plain = lines.drop("spans")
    margin = build.margin_answers(plain, pages, drawings, cfg)
    order = [F.col("block"), F.col("line")]
    numbered = rank_in_order(plain.select("exam_id", "page", "block", "line", F.col("text").alias("t")), ["exam_id"], "page", order, "line_no")
    table_rows = build.table_answers(numbered.select("exam_id", "line_no", F.col("t").alias("line")))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda s: s["text"])
    paged = plain.groupBy("exam_id", "page").agg(F.array_join(shown, "\n").alias("text"))
    letters = rank_in_order(build.key_letters(paged), ["exam_id"], "page", [F.col("idx")], "pos").select("exam_id", "pos", "letter")
    return margin, table_rows, letters


def exams(lines: DataFrame, pages: DataFrame, drawings: DataFrame, key: tuple[DataFrame, DataFrame, DataFrame] | None = None,
          cfg: LayoutConfig = CONFIG) -> DataFrame:
    """The question tree of every exam with boxes, figures, blanks and, where a key is given, answers.

    ``lines`` carry spans; ``key``: what :func:`key_sources` tells of the answer keys, or without one all answers are NULL.
    """
    plain = lines.drop("spans")
    cells, segs, split = build.split_tree(plain, pages, drawings, cfg)
    split = staged(split, "split")
    placed = staged(build.placed_nodes(split, cells, segs, plain, pages, cfg), "placed")
    nodes = attached(placed, split, question_images(segs, cells, drawings, plain, pages, cfg), lines, cfg)
    none = F.lit(None).cast("string")
    nodes = nodes.withColumns({"correct_answer": none, "marking_criteria": none})
    if key is not None:
        nodes = tree.merge_answer_key(staged(nodes, "nodes"), *key)
    return tree.without_mc_areas(nodes, ["writing_areas", "equation_blank_bboxes"])


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("exam_id").agg(F.count("*").cast("int").alias("page_count"))
