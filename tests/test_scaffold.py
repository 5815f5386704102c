"""Exams from lines to the stored form and back, and components, on hand-made rows."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from gradelake.operators import raster, scaffold, tree
from gradelake.operators.components import component_roots
from tests.test_layout import SPLIT, H, W, lines, no_drawings, pages
from tests.test_raster import brute_areas


def with_spans(lined):
    return lined.withColumn("spans", F.array(F.struct("text", "x0", "x1")))


def stored(spark):
    lined, paged = with_spans(lines(spark, SPLIT)), pages(spark)
    drawn = no_drawings(spark, [(1, 1, 300.0, 165.0, 380.0, 178.0, "raster"), (1, 1, 100.0, 325.0, 190.0, 830.0, "raster")])
    key = [(20, 100, "7"), (80, 100, "see parts"), (80, 130, "7(b)"), (80, 150, "because x 103"), (20, 300, "8"), (80, 300, "Question 8 (Answer: C)"), (80, 320, "12 m")]
    sources = scaffold.key_sources(with_spans(lines(spark, key)), paged, no_drawings(spark))
    nodes = scaffold.exams(lined, paged, drawn, sources)
    return nodes, tree.exam_documents(nodes, scaffold.page_counts(paged))


def test_exam_goes_to_its_document_and_back(spark):
    nodes, docs = stored(spark)
    raw = docs.first()["raw"]
    doc = json.loads(raw)
    assert (doc["schema_version"], doc["page_count"], doc["total_marks"]) == (15, 1, 10)
    assert doc["raw_description"].startswith("2 top-level, 4 gradable parts, 10 marks; Q7ai(1m)")
    seven, eight = doc["questions"]
    assert [q["number"] for q in seven["subquestions"]] == ["7a", "7b"] and [q["number"] for q in seven["subquestions"][0]["subquestions"]] == ["7ai", "7aii"]
    # The table row of a part clears the parent's own answer; the figure belongs to the part that spans its middle.
    assert "correct_answer" not in seven and seven["subquestions"][1]["correct_answer"] == "because x 10^3\n8"
    figure = seven["subquestions"][0]["subquestions"][0]["images"][0]
    assert figure["path"] == "scaffold_images/q7_p1_1.png" and (figure["bbox"]["x0"], figure["bbox"]["x1"]) == (0.0, round(W, 1))
    # A figure at the foot of the cell reaches to its edge; the blank of question 8 is stored.
    assert eight["images"][0]["bbox"]["y1"] == round(H, 1) and len(eight["equation_blank_bboxes"]) == 1
    assert "writing_areas" not in raw and "answer_images" not in raw and "subquestions\":[]" not in raw
    back, rejected = tree.read_documents(docs)
    assert rejected.count() == 0
    want = {r["number"]: r for r in nodes.collect()}
    for row in back.collect():
        node = want.pop(row["number"])
        assert all(row[c] == node[c] for c in ("question_type", "text", "marks", "correct_answer"))
        assert [i["path"] for i in row["images"]] == [i["path"] for i in node["images"]] and len(row["equation_blank_bboxes"]) == len(node["equation_blank_bboxes"])
        assert row["writing_areas"] == [] and row["answer_images"] == []
    assert not want
    bare = docs.withColumn("raw", F.regexp_replace("raw", r'"total_marks":\d+', '"total_marks":0'))
    assert tree.read_envelopes(bare, back).first()["total_marks"] == 10
    old = docs.withColumn("raw", F.replace("raw", F.lit('"schema_version":15'), F.lit('"schema_version":14')))
    assert tree.read_documents(old)[0].count() == 0 and tree.read_documents(old)[1].first()["version"] == 14


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {a: root(a) for a in parent}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blobs_cross_many_chunks(spark):
    """A tall sheet with a line through all chunks, a blob on a border, and noise."""
    rng = np.random.default_rng(8)
    grid = (rng.random((3000, 24)) < 0.2).astype(np.uint8)
    grid[:, 20] = 1
    grid[250:260, 3:6] = 1
    rows = [(0, y, grid[y].tobytes()) for y in range(3000)]
    found = raster.blob_areas(spark.createDataFrame(rows, "u int, y int, ink binary"), ["u"]).collect()
    assert sorted(r["area"] for r in found) == brute_areas(grid)


def test_texts_are_cut_into_lines_once(spark):
    """Every branch read the documents and cut their texts again."""
    from gradelake.plans import registry

    registry.load_all()
    plan = registry.QUERIES["win_leaf_top_adjust"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(split(" not in plan and "documents.parquet" not in plan


def test_stored_documents_are_parsed_once_and_read_by_type(spark):
    rows = [(1, '{"schema_version":15,"questions":[{"number":"1","marks":"3","bbox":{"x0":1,"page":"2"},"text":7,"images":5,"subquestions":[{"number":"1a","bbox":4,'
                '"answer_options":[{"letter":"A","text":"x"},{"letter":""}]}]},{"number":"2","marks":[1],"content_summary":"old","answer_key_text":" B "}]}'),
            (2, '{"schema_version":14,"questions":[{"number":"9"}]}'), (3, "broken")]
    nodes, rejected = tree.read_documents(spark.createDataFrame(rows, "exam_id int, raw string"))
    got = {r["number"]: r for r in nodes.collect()}
    assert set(got) == {"1", "1a", "2"} and {(r.exam_id, r.version) for r in rejected.collect()} == {(2, 14), (3, None)}
    assert (got["1"].marks, got["1"].text, got["1"].bbox.x0, got["1"].bbox.page, got["1"].images) == (3, "7", 1.0, 2, [])
    assert (got["1a"].marks, got["1a"].bbox.x0, got["1a"].bbox.page, [o.letter for o in got["1a"].answer_options]) == (1, 0.0, 1, ["A"])
    assert (got["2"].marks, got["2"].text, got["2"].correct_answer) == (1, "old", "B")
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1


def test_nodes_of_an_order_lie_together(spark, tmp_path):
    """A question's nodes are made where its lines meet: grouping them shuffles nothing more; a head listed twice has its letters once."""
    from gradelake.plans import q_tree

    lines = [(1, n, 10 * n, n, "1998-01-01", "A", "O", 5.0) for n in (1, 2, 3, 7)] + [(2, 1, 4, 5, "1998-01-02", "N", "F", 6.0), (9, 1, 4, 5, "1998-01-02", "N", "F", 6.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    heads = [(1, 5, "O"), (2, 5, "F"), (2, 5, "F"), (3, 6, "P")]
    spark.createDataFrame(heads, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r.exam_id, r.number, r.is_leaf) for r in q_tree.nodes(spark, str(tmp_path)).collect())
    one = [(5, "1", False), (5, "1a", False), (5, "1ai", True), (5, "1aii", True), (5, "1b", False), (5, "1bi", True), (5, "1d", True)]
    assert got == sorted([*one, (5, "2", False), (5, "2", False), (5, "2a", False), (5, "2ai", True), (5, "2ai", True), (6, "3", True)])
    plan = q_tree.sink_scaffold_json(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_answers_meet_only_nodes_that_they_can_change(spark):
    nodes = spark.createDataFrame([
        (1, [1], "1", "long_answer", False, "whole", None), (1, [1, 1], "1a", "short_answer", False, None, None), (1, [1, 1, 1], "1ai", "short_answer", True, "x", "y"),
        (1, [2], "2", "long_answer", False, "keep", "c"), (1, [2, 1], "2a", "multiple_choice", True, None, None), (1, [3], "3", None, True, "z", None), (1, [4], "4", "essay", None, "n", None),
    ], "exam_id long, path array<long>, number string, question_type string, is_leaf boolean, correct_answer string, marking_criteria string")
    margin = spark.createDataFrame([(1, "3", "b", None)], "exam_id long, number string, answer string, criteria string")
    rows = spark.createDataFrame([(1, "1ai", " body ")], "exam_id long, number string, body string")
    letters = spark.createDataFrame([(1, 1, "D"), (1, 2, "A")], "exam_id long, pos long, letter string")
    got = {r.number: (r.question_type, r.correct_answer, r.marking_criteria) for r in tree.merge_answer_key(nodes, margin, rows, letters).collect()}
    assert got == {"1": ("long_answer", None, None), "1a": ("short_answer", None, None), "1ai": ("short_answer", "body", None), "2": ("long_answer", "keep", "c"),
                   "2a": ("multiple_choice", "D", None), "3": ("multiple_choice", "A", None), "4": ("essay", "n", None)}
