"""Registered queries: contract, twins on the smallest tables, plans."""

import os

import pytest

import __spark_entry__ as entry_points
from gradelake.plans import registry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

# Declared to run on built-in expressions only.
BUILT_IN = ("fn_infer_marks", "fn_normalize_mc_answer", "win_mc_option_split", "agg_class_stats", "rep_results_matrix", "win_first_readable_page",
            "agg_vote_ensemble", "src_ground_truth", "geo_project_bbox")
SAMPLE = ("mdl_grade_mc", "agg_class_stats", "win_forward_fill_name", "src_roster", "agg_total_marks", "win_segments", "geo_adjusted_boxes", "ras_otsu_threshold")


def test_contract():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert len(queries) > 120 and set(oracles) <= set(queries)


@needs_data
def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("key", SAMPLE)
def test_twin(spark, key):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    cur = con.execute(registry.ORACLES[key])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r) for r in registry.QUERIES[key](spark, SF).select(*names).collect()), key=repr)
    assert got == want


@needs_data
@pytest.mark.parametrize("key", BUILT_IN)
def test_no_python_in_the_plan(spark, key):
    plan = registry.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@needs_data
def test_scans_read_only_their_columns(spark):
    plan = registry.QUERIES["fn_normalize_mc_answer"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan


@needs_data
@pytest.mark.parametrize("key", ["mdl_grade_students", "rep_results_by_exam"])
def test_replies_are_read_from_one_written_table(spark, key):
    """All branches read the written replies, none the lines again."""
    files = registry.QUERIES[key](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_unattempted_questions_are_whole(spark, tmp_path):
    """Rows of lines without an order stay, and the counts per scan and question follow from the rows."""
    import duckdb

    from gradelake.plans.q_grade import MC_GRADES_SQL

    lines = [(None, 1, 1, 7, "A", "F"), (None, 1, 1, 6, "A", "F"), (31, 1, 1, 7, "N", "F"), (32, 2, 1, 7, "R", "F"), (32, 2, 1, 7, "R", "F"), (33, 1, 1, 7, "A", "O"), (61, 2, 1, 7, "A", "F")]
    lines = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string").selectExpr("*", "5.0D as l_quantity", "date'2000-01-01' as l_shipdate")
    con = duckdb.connect()
    for name, df in (("lineitem", lines), ("part", spark.createDataFrame([(1, 3, "SMALL"), (2, 4, "LARGE")], "p_partkey bigint, p_size int, p_type string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    rows = registry.QUERIES["mdl_unattempted"](spark, str(tmp_path)).select("scan_id", "student", "q_number", "answer", "marks", "skipped").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(con.execute(registry.ORACLES["mdl_unattempted"]).fetchall(), key=repr)
    counts = con.execute(f"select scan_id, q_number, count(*) from ({MC_GRADES_SQL}) where answer = '-' and marks = 0 group by 1, 2").fetchall()
    assert {(r.scan_id, r.q_number, r.skipped) for r in rows} == set(counts) == {(None, "7", 1), (1, "7", 2), (2, "7", 1)}
