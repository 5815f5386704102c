"""Layout rules on hand-made pages."""

import pytest
from pyspark.sql import functions as F

from gradelake.operators import build, figures, layout, subparts, tree

LINE = "exam_id int, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, font_size double, text string"
W, H = 595.276, 841.89


def lines(spark, rows, exam=1):
    """rows: (x0, y0, text[, page])"""
    out = []
    for i, r in enumerate(rows):
        page = r[3] if len(r) > 3 else 1
        out.append((exam, page, i, i, float(r[0]), float(r[1]), float(r[0]) + 5.0 * len(r[2]), float(r[1]) + 10.0, 10.0, r[2]))
    return spark.createDataFrame(out, LINE)


def pages(spark, n=1, w=W, h=H):
    return spark.createDataFrame([(1, p + 1, w, h) for p in range(n)], "exam_id int, page int, w double, h double")


def no_drawings(spark, rows=()):
    return spark.createDataFrame(list(rows), "exam_id int, page int, x0 double, y0 double, x1 double, y1 double, kind string")


@pytest.mark.parametrize("w,h,rows,cells", [
    (W, H, [(20, 100, "1 x")], 1), (800.0, 1000.0, [], 4), (1200.0, 842.0, [], 4), (842.0, 595.0, [], 2),
    (W, H, [(300, 100, "1 x"), (300, 200, "2 y")], 2), (W, H, [(300, 100, "1 x"), (300, 200, "2 y"), (20, 500, "3")], 4)])
def test_cells(spark, w, h, rows, cells):
    lined = lines(spark, rows or [(20, 10, "text")])
    assert layout.page_cells(lined, pages(spark, 1, w, h)).count() == cells


def test_repeated_numbers(spark):
    lined = lines(spark, [(20, 100, "39"), (20, 200, "40"), (20, 100, "39", 2)])
    a = layout.question_anchors(lined, layout.page_cells(lined, pages(spark, 2)))
    assert [r.qid for r in a.orderBy("page", "qy0").collect()] == ["39", "40", "39_2"]


def segs(spark, lined, drawn=None, n=1):
    return build.regions(lined, pages(spark, n), drawn or no_drawings(spark))[1]


def test_last_region_ends_at_text(spark):
    lined = lines(spark, [(20, 100, "1"), (80, 110, "stem"), (20, 200, "2"), (80, 230, "last words")])
    got = {r.qid: (r.y_start, r.y_end) for r in segs(spark, lined).collect()}
    assert got == {"1": (100.0, 200.0), "2": (200.0, 244.0)}


def test_last_region_ends_above_disclaimer_and_its_rule(spark):
    rows = [(20, 100, "1"), (80, 130, "stem"), (80, 400, "Permission to reproduce items")]
    assert segs(spark, lines(spark, rows)).first().y_end == 144.0
    drawn = no_drawings(spark, [(1, 1, 50.0, 390.0, 300.0, 391.0, "vector"), (1, 1, 60.0, 350.0, 90.0, 380.0, "vector")])
    # The figure above the rule is the last printed thing.
    assert segs(spark, lines(spark, rows), drawn).first().y_end == 384.0


def question_nodes(spark, rows, drawn=None):
    lined = lines(spark, rows)
    return {r.number: r for r in build.questions(lined, pages(spark), drawn or no_drawings(spark)).collect()}


SPLIT = [(20, 100, "7"), (80, 100, "Stars shine."), (80, 120, "(a) Name one."), (80, 140, "more [2]"), (80, 160, "(i) first [1]"),
         (80, 180, "(ii) second [3]"), (80, 200, "(b) Explain [4]"), (80, 220, "[Total: 12]"), (20, 300, "8"), (80, 300, "Calculate v"), (80, 320, "v = ........ [2]")]


def test_split_question(spark):
    got = question_nodes(spark, SPLIT)
    assert set(got) == {"7", "7a", "7ai", "7aii", "7b", "8"}
    assert got["7"].text == "Stars shine." and got["7"].marks == 12
    assert got["7a"].text == "Name one.\nmore" and got["7a"].marks == 4 and not got["7a"].is_leaf
    assert [got[k].marks for k in ("7ai", "7aii", "7b", "8")] == [1, 3, 4, 2]
    assert got["8"].question_type == "calculation"
    # Parts reach the next label and span the cell.
    assert got["7aii"].y1 == 200.0 and got["7aii"].x0 == 0.0 and got["7aii"].x1 == W
    # The first leaf of the cell snaps to its top, the last to its bottom.
    assert got["7ai"].y0 == 0.0 and got["8"].y1 == H
    # Tops only move up: 12 points below the last printed line above.
    assert got["7b"].y0 == 192.0


def test_roman_before_letter_and_orphans(spark):
    digits = F.lit("9")
    rows = spark.createDataFrame([(0, "(i) x"), (1, "(a) x"), (2, "b) x"), (3, "(iz) x"), (4, "9 (c) y"), (5, "9(d)"), (6, "plain")], "i int, t string")
    got = [r[0] and (r[0].kind, r[0].label, r[0].rest) for r in rows.orderBy("i").select(subparts.label(F.col("t"), digits)).collect()]
    assert got == [("roman", "i", "x"), ("letter", "a", "x"), ("letter", "b", "x"), None, ("letter", "c", "y"), ("letter", "d", ""), None]
    nodes = question_nodes(spark, [(20, 100, "5"), (80, 120, "(i) one"), (80, 140, "(ii) two"), (80, 160, "(a) three"), (80, 180, "(i) four")])
    assert set(nodes) == {"5", "5i", "5ii", "5a", "5ai"}


def test_margin_number_joins_letter_line(spark):
    # Printed as two spans: the clip of the text starts where the number ends.
    rows = [(20, 100, "3 (a) one"), (80, 120, "text"), (80, 140, "(b) two"), (80, 160, "more")]
    first = F.array(F.struct(F.lit("3").alias("text"), F.col("x0"), (F.col("x0") + 5).alias("x1")))
    lined = lines(spark, rows).withColumn("spans", F.when(F.col("line") == 0, first).otherwise(F.array(F.struct("text", "x0", "x1"))))
    nodes = {r.number: r for r in build.questions(lined, pages(spark), no_drawings(spark)).collect()}
    assert set(nodes) == {"3", "3a", "3b"} and nodes["3a"].text == "one\ntext"
    # A lone number line joins the letter line after it.
    digits = [(80, 100, "x"), (80, 120, "3"), (80, 140, "(a) one"), (80, 160, "(b) two")]
    clip = lines(spark, digits).withColumns({"qid": F.lit("3"), "raw": F.lit(3)})
    joined = subparts.labelled_lines(clip).orderBy("y0").collect()
    assert [(r.text, r.a and r.a.label) for r in joined] == [("x", None), ("3 (a) one", "a"), ("(b) two", "b")]
    assert (joined[1].y0, joined[1].y1) == (120.0, 150.0)


def test_too_few_labels_stay_whole(spark):
    nodes = question_nodes(spark, [(20, 100, "3"), (80, 120, "(a) one"), (80, 140, "two"), (80, 160, "three")])
    assert set(nodes) == {"3"} and nodes["3"].is_leaf


def test_answer_blank(spark):
    lined = lines(spark, SPLIT).withColumn("spans", F.array(F.struct("text", "x0", "x1")))
    plain = lined.drop("spans")
    nodes = build.questions(plain, pages(spark), no_drawings(spark))
    got = figures.answer_blanks(nodes, lined, ["exam_id", "page", "path"]).collect()
    assert len(got) == 1
    # 'v = ........ [2]' has 16 characters of 5 points: the blank runs from the 5th to the 14th; nothing
    # is printed below, so it ends 25 + 5 points below the line.
    assert (got[0].x0, got[0].x1, got[0].y0, got[0].y1) == (100.0, 145.0, pytest.approx(295.0), 360.0)


def test_figures(spark):
    clips = spark.createDataFrame([(1, 1, "7", 0.0, 100.0, W, 300.0)], "exam_id int, page int, qid string, kx0 double, ky0 double, kx1 double, ky1 double")
    lined = lines(spark, [(210, 150, "A"), (100, 210, "Fig. 1.2"), (100, 200, "Sun")])
    drawn = [(1, 1, 100.0, 140.0, 200.0, 200.0, "vector"), (1, 1, 50.0, 120.0, 400.0, 121.0, "vector"), (1, 1, 300.0, 140.0, 330.0, 170.0, "vector")]
    got = figures.figures_in_clips(clips, no_drawings(spark, drawn), lined, pages(spark), ["exam_id", "page", "qid"]).collect()
    assert [(r.kind, r.x0, r.y0, r.x1, r.y1) for r in got] == [("vector", 95.0, 135.0, 220.0, 215.0)]
    raster = [*drawn, (1, 1, 10.0, 90.0, 60.0, 130.0, "raster")]
    got = figures.figures_in_clips(clips, no_drawings(spark, raster), lined, pages(spark), ["exam_id", "page", "qid"]).collect()
    assert [(r.kind, r.x0, r.y0, r.x1, r.y1) for r in got] == [("raster", 5.0, 100.0, 65.0, 135.0)]


def test_assets_go_to_the_deepest_node(spark):
    nodes = spark.createDataFrame([(1, "7", 1, [1], 0.0, 100.0), (1, "7", 1, [1, 1], 10.0, 50.0), (1, "7", 2, [1, 2], 50.0, 90.0), (1, "7", 1, [1, 2, 1], 50.0, 90.0), (1, "7", 1, [1, 3], 10.0, 50.0)],
                                  "exam_id int, qid string, page int, path array<int>, y0 double, y1 double")
    assets = spark.createDataFrame([(1, "7", 1, 1, 20.0, 30.0), (1, "7", 1, 2, 60.0, 70.0), (1, "7", 1, 3, 300.0, 310.0)], "exam_id int, qid string, page int, asset_id int, y0 double, y1 double")
    got = {r.asset_id: list(r.path) for r in figures.assets_to_nodes(assets, nodes).collect()}
    assert got == {1: [1, 1], 2: [1], 3: [1]}


def test_mark_scheme_table(spark):
    rows = ["intro", "11(a)", "one", "two", "11(c)(ii)", "x 103", "IGCSE Physics", "noise", "11(a)", "later", "12(b)", "", "12(c)"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "exam_id int, line_no long, line string")
    got = {r.number: r.body for r in build.table_answers(df).collect()}
    assert got == {"11a": "later", "11cii": "x 10^3"}


def test_rolled_marks_equal_their_leaves(spark):
    rows = [(1, [1], "t", 1), (1, [1, 1], "a", 1), (1, [1, 1, 1], "x", 2), (1, [1, 1, 2], "y", 3), (1, [1, 2], "z", 4), (1, [2], "[Total: 9]", 5)]
    df = tree.with_leaf_flag(spark.createDataFrame(rows, "exam_id int, path array<int>, text string, marks long"))
    got = {tuple(r.path): r.marks for r in tree.rolled_up_marks(df).collect()}
    assert got == {(1,): 9, (1, 1): 5, (1, 1, 1): 2, (1, 1, 2): 3, (1, 2): 4, (2,): 5}
