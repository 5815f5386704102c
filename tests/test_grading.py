"""Grading, evaluation and ordered steps on small tables; properties on seeded ones."""

import random

import pytest
from pyspark.sql import functions as F

from gradelake import tables
from gradelake.operators import evaluate, geometry, grade, ordered, request, vote
from gradelake.sources import files, ground_truth, records


def test_forward_fill(spark):
    rows = [(1, i + 1, n) for i, n in enumerate([None, "Ann", None, "Bob", None])]
    got = grade.forward_filled(spark.createDataFrame(rows, "scan_id int, page int, name string")).orderBy("page")
    assert [(r.page, r.student) for r in got.collect()] == [(2, "Ann"), (3, "Ann"), (4, "Bob"), (5, "Bob")]


def test_blocked_steps_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = [(k, p, rng.choice([None, "x", "y"]), rng.randint(0, 3)) for k in range(3) for p in range(1, 101) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k int, p int, v string, n int").withColumn("b", ordered.block_of(F.col("p"), 8))
    fill = {(r.k, r.p): r.o for r in ordered.carry_forward(df, ["k"], "b", ["p"], "v", "o").collect()}
    rank = {(r.k, r.p): r.o for r in ordered.rank_in_order(df, ["k"], "b", [F.col("p")], "o").collect()}
    total = {(r.k, r.p): r.o for r in ordered.running_total(df, ["k"], "b", [F.col("p")], F.col("n"), "o").collect()}
    for k in range(3):
        mine = sorted(r[1:] for r in rows if r[0] == k)
        last, seen = None, 0
        for i, (p, v, n) in enumerate(sorted(mine, key=lambda r: r[0])):
            last, seen = v if v is not None else last, seen + n
            assert fill[(k, p)] == last and rank[(k, p)] == i + 1 and total[(k, p)] == seen


def test_marks(spark):
    df = spark.createDataFrame([("3", 2), ("-1", 2), ("x", 2), (None, 2), ("1_0", 20)], "v string, m int")
    assert [r[0] for r in df.select(grade.written_marks(F.col("v"), F.col("m"))).collect()] == [2.0, -1.0, 0.0, 0.0, 10.0]
    reads = spark.createDataFrame([(1, "s", "q", 1, " ", 1.0), (1, "s", "q", 2, "B", 2.0), (1, "s", "q", 3, "C", 3.0), (1, "t", "q", 1, "?", 1.0)],
                                  "scan_id int, student string, q_number string, page int, answer string, marks double")
    got = grade.first_readable(reads.withColumn("answer", F.trim("answer")), ["scan_id", "student", "q_number"], ["page"]).collect()
    assert {(r.student, r.answer, r.marks) for r in got} == {("s", "B", 2.0), ("t", "?", 0.0)}


def test_class_stats(spark):
    df = spark.createDataFrame([(1, t, 10) for t in (1.0, 2.0, 2.0, 9.0)] + [(2, 0.0, 0)], "scan_id int, total double, max_marks int")
    got = {(r.scan_id, r.metric): (r.value, r.pct) for r in grade.class_stats(df).collect()}
    assert got[(1, "mean")] == (3.5, 35.0) and got[(1, "median")] == (2.0, 20.0) and got[(1, "highest")][0] == 9.0
    assert got[(1, "lowest")][0] == 1.0 and got[(2, "mean")] == (0.0, 0.0)


def test_ids_are_sorted_by_length(spark):
    df = spark.createDataFrame([(1, q) for q in ("38_2", "9a", "10", "9")], "s int, q_number string")
    assert grade.in_id_order(df, ["s"]).first().questions == "9, 10, 9a, 38_2"


def test_cell_comparison(spark):
    rows = [(None, None, "0"), ("b ", None, "B"), ("?", None, "?"), ("A", 2.0, "2.005"), ("A", 2.0, "2.02"), (None, None, "nan")]
    df = spark.createDataFrame(rows, "a string, m double, e string")
    args = (F.col("a"), F.col("m"), F.col("e"))
    got = [(r[0], r[1]) for r in df.select(evaluate.shown_value(*args), evaluate.cell_ok(*args)).collect()]
    assert got == [("?", True), ("B", True), ("?", False), ("2.0", True), ("2.0", False), ("?", False)]


def test_ground_truth_forms(spark):
    texts = {
        "tab": "Ground Truth\n\nName\tQ1\tQ2\nAnn Lee\tA\t2\n# note\nBob\t?\t1.5\nAnn Lee\tB\t3\n",
        "space": "Yuze A D B\nMia C",
        "late": "Ann 1 2\nName x y\nBob 3",
        "none": "just a label\nanother label here",
    }
    rows = [(s, i, ln) for s, t in texts.items() for i, ln in enumerate(t.splitlines())]
    df = spark.createDataFrame(rows, "scan_id string, line_no long, line string")
    got = {(r.scan_id, r.student, r.q_number): r.value for r in ground_truth.ground_truth(df).collect()}
    assert got == {("tab", "Ann Lee", "Q1"): "B", ("tab", "Ann Lee", "Q2"): "3", ("tab", "Bob", "Q1"): "?", ("tab", "Bob", "Q2"): "1.5",
                   ("space", "Yuze", "1"): "A", ("space", "Yuze", "2"): "D", ("space", "Yuze", "3"): "B", ("space", "Mia", "1"): "C",
                   ("late", "Ann", "1"): "1", ("late", "Ann", "2"): "2", ("late", "Bob", "1"): "3"}
    leaves = spark.createDataFrame([("space", 1, "9a"), ("space", 2, "9b"), ("space", 3, "10"), ("space", 4, "11")], "scan_id string, leaf_no int, q_number string")
    named = {(r.student, r.q_number): r.value for r in ground_truth.ground_truth(df.filter("scan_id = 'space'"), leaves).collect()}
    assert named == {("Yuze", "9a"): "A", ("Yuze", "9b"): "D", ("Yuze", "10"): "B", ("Mia", "9a"): "C"}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n", encoding="utf-8")
    got = ground_truth.text_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line for r in got] == ["one", "two", ""]
    listed = files.listing(spark, str(tmp_path)).collect()
    assert [r.name for r in listed] == ["a.txt"] and listed[0].folder.endswith(tmp_path.name)


def test_records_resume_and_write(spark, tmp_path):
    done = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "x", 3)], "page_number long, v string, pos int")
    fresh = spark.createDataFrame([(1, "again"), (2, "b")], "page_number long, v string")
    out = files.resumed(done, fresh)
    assert {(r.page_number, r.v) for r in out.collect()} == {(1, "new"), (2, "b")}
    files.write_records(out, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_profiles(spark):
    assert records.get("igcse_physics").fields[2] == "q38_left_top"
    with pytest.raises(ValueError):
        records.get("nothing")
    assert "questions" in tables.names() and tables.schema("raster_rows").fieldNames()[-1] == "px"
    with pytest.raises(ValueError):
        tables.schema("nothing")


def test_vote_ties_go_to_the_first(spark):
    rows = [(1, 1, "N", "high", "B"), (1, 2, "N", "low", "A"), (1, 3, "UNKNOWN", "low", "B"), (1, 4, "M", "low", "A")]
    df = spark.createDataFrame(rows, "page int, pass int, student_name string, confidence string, q1 string")
    r = vote.ensemble(df, ["q1"]).first()
    assert (r.q1, r.q1_confidence, r.student_name, r.confidence) == ("B", "medium", "N", "low")
    m = vote.multi_pass(df, ["student_name", "q1", "confidence"], ["q1"]).first()
    assert (m.q1, m.student_name, m.confidence) == ("B", "N", "medium")
    same = spark.createDataFrame([(1, p, "N", "low", "b") for p in (1, 2)], "page int, pass int, student_name string, confidence string, q1 string")
    assert vote.multi_pass(same, ["student_name", "q1", "confidence"], ["q1"]).first().q1 == "b"


def test_rejected_requests(spark):
    rows = spark.createDataFrame([(1, "skip the scan")], "i int, prompt string")
    df = request.keyword_request(rows).withColumns({"cli_skip_clean_scan": F.lit(False), "cli_force_clean_scan": F.lit(True), "cli_rescaffold": F.lit(False),
                                                    "cli_no_report": F.lit(False), "cli_through_step": F.lit(None).cast("int")})
    ok, bad = request.merged_flags(df)
    assert ok.count() == 0 and bad.count() == 1


def test_transform_inverse(spark):
    raw = spark.createDataFrame([(1, q, x, y) for q, x, y in (("top_left", 50.0, 30.0), ("top_right", 350.0, 30.0), ("bot_left", 50.0, 450.0), ("bot_right", 350.0, 450.0))], "exam_id int, quadrant string, x double, y double")
    scan = raw.select("exam_id", F.lit(9).alias("scan_id"), F.lit(1).alias("page"), "quadrant", (F.col("x") * 4 + 7).alias("x"), (F.col("y") * 4 + 3).alias("y"))
    got = geometry.half_transforms(raw, scan).collect()
    assert {(round(r.scale, 9), round(r.tx, 6), round(r.ty, 6)) for r in got} == {(4.0, 7.0, 3.0)}
    lost = scan.filter("quadrant <> 'top_left'")
    pages = scan.select("scan_id", "page").distinct()
    assert geometry.complete_scans(geometry.half_transforms(raw, lost), pages).count() == 0


def test_a_single_reading_stays_as_it_is(spark):
    rows = [(1, 1, "N", "medium", "B", "low", "x"), (2, 1, "N", "low", "B", "low", "y"), (2, 2, "N", "low", "B", "low", "z")]
    df = spark.createDataFrame(rows, "page int, pass int, student_name string, confidence string, q1 string, q1_confidence string, note string")
    got = {r.page: (r.q1, r.q1_confidence, r.confidence, r.note) for r in vote.ensemble(df, ["q1"]).collect()}
    assert got == {1: ("B", "low", "medium", "x"), 2: ("B", "high", "low", "y")}


def test_letter_answers(spark):
    raws = ['{"answer": " b "}', '{"answer": " B or b"}', '{"answer": ""}', '{"answer": null}', "{}", "no", 'so {"answer": "Z"} it is']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    assert [r[0] for r in df.select(grade.mc_answer(F.col("raw"))).collect()] == ["B", "B OR B", "", "NONE", "?", "?", "Z"]


def test_pages_outside_the_scan(spark):
    from gradelake.operators.grading_pass import grade_students

    assigned = spark.createDataFrame([(1, "s", 1), (1, "s", 9), (1, "t", 2), (1, "u", 9)], "scan_id int, student string, page int")
    scans = spark.createDataFrame([(1, 2, "check_answers")], "scan_id int, page_count int, task string")
    questions = spark.createDataFrame([(1, s, "1", "written", True, None, 5) for s in "stu"], "scan_id int, student string, q_number string, question_type string, is_leaf boolean, correct_answer string, max_marks int")
    reads = spark.createDataFrame([(1, "s", "1", 9, "x", "4"), (1, "t", "1", 2, "x", "3")], "scan_id int, student string, q_number string, page int, answer string, value string")
    none = spark.createDataFrame([], "scan_id int, student string, q_number string, page int, value string")
    seen = assigned.select("scan_id", "student").limit(0)
    got = grade_students(assigned, scans, questions, none.select("scan_id", "student", "q_number"), seen, reads, none)
    assert {(r.student, r.total, r.questions) for r in got.collect()} == {("s", 0.0, 1), ("t", 3.0, 1)}
    wanted = spark.createDataFrame([(1, "specific", ["T"], None)], "scan_id int, mode string, names array<string>, n int")
    got = grade_students(assigned, scans, questions, none.select("scan_id", "student", "q_number"), seen, reads, none, wanted)
    assert [r.student for r in got.collect()] == ["t"]
    replies_ = spark.createDataFrame([(1, "s", 1, '{"attempted": "none"}'), (1, "s", 9, '{"attempted": ["3"]}'), (1, "t", 2, '{"attempted": ["10", "2"]}')], "scan_id int, student string, page int, raw string")
    lists = {(r.student, r.questions) for r in grade.attempt_lists(assigned, scans, replies_).collect()}
    assert lists == {("s", ""), ("t", "2, 10"), ("u", "")}


def test_lists_are_whole(spark):
    pages = spark.createDataFrame([(1, "s", p) for p in (998, 999, 1000)], "scan_id int, student string, page int")
    assert [r.pages for r in grade.page_lists(pages).collect()] == ["998, 999, 1000"]


def test_deep_trees_survive(spark):
    from gradelake.operators import tree

    box = (0.0, 0.0, 1.0, 1.0, 1)
    rows = [("e", [1] * d, "n" * d, "short_answer", f"text {d}", 1, box, None, None, []) for d in range(1, 6)]
    schema = ("exam_id string, path array<bigint>, number string, question_type string, text string, marks bigint, bbox struct<x0:double,y0:double,x1:double,y1:double,page:int>, "
              "correct_answer string, marking_criteria string, answer_options array<struct<letter:string,text:string>>")
    docs = tree.question_documents(spark.createDataFrame(rows, schema))
    raw = docs.select("exam_id", F.concat(F.lit('{"schema_version":%d,"questions":[' % tree.SCHEMA_VERSION), "doc", F.lit("]}")).alias("raw"))
    back, rejected = tree.read_documents(raw)
    assert {(tuple(r.path), r.number, r.text) for r in back.collect()} == {(tuple(r[1]), r[2], r[4]) for r in rows} and rejected.count() == 0


def test_request_types(spark):
    raws = ['{"student_filter": {"mode": "first_n", "n": "3.7"}, "rescaffold": "false"}', '{"student_filter": {"mode": "first_n", "n": 3.7}, "rescaffold": false}',
            '{"student_filter": {"mode": "first_n", "n": " 4 "}, "rescaffold": 0, "no_report": "0"}', '{"rescaffold": [], "no_report": [1], "dpi": "200"}']
    df = request.keyword_request(spark.createDataFrame(list(enumerate(raws)), "i int, raw string").withColumn("prompt", F.lit("check")))
    got = request.validated_request(df).orderBy("i").collect()
    assert [(r.mode, r.n, r.rescaffold, r.no_report, r.dpi) for r in got] == [("all", 0, True, False, 400), ("first_n", 3, False, False, 400), ("first_n", 4, False, True, 400), ("all", 0, False, True, 200)]


def test_turned_pages(spark):
    from gradelake.operators.report import detected_rotation_summary

    kept = spark.createDataFrame([(1, 90), (1, 0), (2, 0)], "scan_id int, rotation int")
    assert {(r.scan_id, r.kept, r.summary) for r in detected_rotation_summary(kept).collect()} == {(1, 2, "1 page(s) rotated via Tesseract OSD"), (2, 1, "All pages already upright")}


def test_unattempted_rows_and_their_number(spark):
    flagged = spark.createDataFrame([(1, "a", "7", False), (1, "b", "7", False), (1, "b", "8", False), (1, "c", "7", True), (2, "a", "7", False)],
                                    "scan_id int, student string, q_number string, attempted boolean")
    got = {tuple(r) for r in grade.with_skipped(grade.unattempted(flagged)).select("scan_id", "student", "q_number", "answer", "marks", "skipped").collect()}
    assert got == {(1, "a", "7", "-", 0.0, 2), (1, "b", "7", "-", 0.0, 2), (1, "b", "8", "-", 0.0, 1), (2, "a", "7", "-", 0.0, 1)}


def test_unattempted_rows_without_a_scan_or_number_stay(spark):
    flagged = spark.createDataFrame([(None, "a", "7", False), (None, "b", "7", False), (None, "c", "7", True), (1, "a", None, False), (1, "a", "7", False)],
                                    "scan_id int, student string, q_number string, attempted boolean")
    got = {tuple(r) for r in grade.with_skipped(grade.unattempted(flagged)).select("scan_id", "student", "q_number", "answer", "marks", "skipped").collect()}
    assert got == {(None, "a", "7", "-", 0.0, 2), (None, "b", "7", "-", 0.0, 2), (1, "a", None, "-", 0.0, 1), (1, "a", "7", "-", 0.0, 1)}
