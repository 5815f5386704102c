"""Question tables of exam papers and answer keys, from decoded text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.functions.text import strip
from gradelake.operators import figures, layout, subparts, tree
from gradelake.operators.layout import CONFIG, LayoutConfig
from gradelake.operators.ordered import block_of, running_total
from gradelake.session import staged

# Labels and section breaks of mark-scheme tables.
TABLE_LABEL = r"(?i)^(\d+)\((?:(c)\)\((i{1,3})|([a-z]))\)\s*$"
SECTION_BREAK = r"^IGCSE |(?i)^Answers\s+Q|(?i)^Question\s+\d+\s*\(\s*Answer\s*:"


def regions(lines: DataFrame, pages: DataFrame, drawings: DataFrame, cfg: LayoutConfig = CONFIG) -> tuple[DataFrame, DataFrame]:
    """``(cells, regions)`` of all pages."""
    cells = staged(layout.page_cells(lines, pages))
    segs = staged(layout.segments(layout.question_anchors(lines, cells, cfg)))
    return cells, staged(layout.with_clips(layout.tightened(segs, lines, drawings), cfg))


def region_texts(clip: DataFrame) -> DataFrame:
    """Text of every region. A region lies in one cell; its clip begins right of the printed number."""
    numbered = clip.withColumns({"_i": F.row_number().over(_lines_of_region()), "_t": F.col("text")})
    ordered = F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct("_i", "_t"))))
    return numbered.groupBy("exam_id", "qid").agg(strip(F.array_join(F.transform(ordered, lambda s: s["_t"]), "\n")).alias("text"))


def _lines_of_region():
    from pyspark.sql import Window

    return Window.partitionBy("exam_id", "qid").orderBy("page", "y0", "x0", "block", "line")


def split_tree(lines: DataFrame, pages: DataFrame, drawings: DataFrame, cfg: LayoutConfig = CONFIG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cells, regions, nodes)``: the question tree of every exam with the boxes of its printed lines."""
    cells, segs = regions(lines, pages, drawings, cfg)
    clip = staged(layout.clip_lines(lines, segs))
    texts = region_texts(clip)
    roots = segs.select("exam_id", "qid", "seg_no", "page", *layout.BOX).join(texts, ["exam_id", "qid"], "left")
    roots = roots.withColumn("text", F.coalesce("text", F.lit("")))
    roots = roots.withColumns({"question_type": T.question_type(F.col("text")), "marks": T.inferred_marks(F.col("text")),
                               "answer_options": F.expr("cast(array() as array<struct<letter:string,text:string>>)")})
    nodes = staged(subparts.split_questions(staged(tree.with_parsed_options(roots)), clip))
    nodes = tree.with_leaf_flag(nodes)
    return cells, segs, tree.clean_stems(tree.rolled_up_marks(nodes)).drop("total")


def placed_nodes(nodes: DataFrame, cells: DataFrame, segs: DataFrame, lines: DataFrame, pages: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Nodes with their final boxes: as wide as the cell, snapped to its edges, leaves up to the line above."""
    inner = F.size("path") > 1
    placed = layout.cell_of_point(nodes.drop("cell_no"), cells, pages, (F.col("x0") + F.col("x1")) * 0.5, (F.col("y0") + F.col("y1")) * 0.5,
                                  ["exam_id", "page", "path"])
    placed = staged(placed).withColumns({"x0": F.when(inner, F.col("cx0")).otherwise(F.col("x0")), "x1": F.when(inner, F.col("cx1")).otherwise(F.col("x1"))})
    snapped = layout.leaf_snapped(placed, segs).withColumn("node", F.col("path"))
    leaves = layout.leaf_tops(snapped.filter("is_leaf"), lines, cfg)
    return leaves.unionByName(snapped.filter(~F.col("is_leaf"))).drop("node")


def questions(lines: DataFrame, pages: DataFrame, drawings: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """The question tree of every exam: ``exam_id, qid, path, number, question_type, text, marks, …`` with boxes."""
    cells, segs, nodes = split_tree(lines, pages, drawings, cfg)
    return placed_nodes(nodes, cells, segs, lines, pages, cfg)


def question_figures(segs: DataFrame, drawings: DataFrame, lines: DataFrame, pages: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    clips = segs.select("exam_id", "page", "qid", F.col("x0").alias("kx0"), F.col("y0").alias("ky0"), F.col("x1").alias("kx1"), F.col("y1").alias("ky1"))
    return figures.figures_in_clips(clips, drawings, lines, pages, ["exam_id", "page", "qid"], cfg)


# ---- answer keys ----------------------------------------------------------------------------------


def table_answers(key_lines: DataFrame) -> DataFrame:
    """Model answers of the two-column table: a label line opens a row, its text runs to the next one.

    ``key_lines``: ``exam_id, line_no, line`` in reading order. The later of two equal labels wins.
    """
    t = strip(F.col("line"))
    part = lambda g: F.lower(F.regexp_extract(t, TABLE_LABEL, g))
    label = F.when(t.rlike(TABLE_LABEL), F.concat(F.regexp_extract(t, TABLE_LABEL, 1), part(2), part(3), part(4)))
    df = key_lines.select("exam_id", "line_no", t.alias("t"), label.alias("label"), block_of(F.col("line_no")).alias("_b"))
    opens = F.col("label").isNotNull() | F.col("t").rlike(SECTION_BREAK)
    df = running_total(df, ["exam_id"], "_b", [F.col("line_no")], opens.cast("int"), "row_no")
    ordered = F.array_sort(F.collect_list(F.when(F.col("label").isNull(), F.struct("line_no", "t"))))
    # Rows that start at a section break or before the first label carry no label and drop out.
    named = df.groupBy("exam_id", "row_no").agg(F.max("label").alias("number")).filter(F.col("number").isNotNull())
    rows = (df.join(named, ["exam_id", "row_no"]).groupBy("exam_id", "row_no", "number")
            .agg(T.science_text(strip(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n"))).alias("body")).filter(F.col("body") != ""))
    return rows.groupBy("exam_id", "number").agg(F.max_by("body", "row_no").alias("body"))


def key_letters(key_pages: DataFrame) -> DataFrame:
    """Printed letters of an answer key in page order: ``exam_id, page, idx, letter``; rank by ``(page, idx)``."""
    return key_pages.select("exam_id", "page", F.posexplode(T.printed_letters(F.col("text"))).alias("idx", "letter"))


def margin_answers(lines: DataFrame, pages: DataFrame, drawings: DataFrame, cfg: LayoutConfig = CONFIG) -> DataFrame:
    """Answer and remaining text beside every printed number of a key: ``exam_id, number, answer, criteria``."""
    _cells, segs = regions(lines, pages, drawings, cfg)
    texts = region_texts(layout.clip_lines(lines, segs)).withColumn("text", T.science_text(F.col("text")))
    answer, rest = T.answer_fields(F.col("text"))
    return texts.select("exam_id", F.col("qid").alias("number"), answer.alias("answer"), rest.alias("criteria"))
