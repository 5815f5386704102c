"""Reference answers and accuracy bound to orders, line items, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import evaluate, vote
from gradelake.operators.report import eval_map, eval_matrix, map_text
from gradelake.plans import sqlbits as S
from gradelake.plans.q_grade import LEAVES, MC_GRADES_SQL, mc_grades
from gradelake.plans.registry import query
from gradelake.session import staged, table
from gradelake.sources import ground_truth as gt

# ---- reference lines: one file per customer, one line per order ------------------------------------

GT_LINES_SQL = """
  select o_custkey as scan_id, o_orderkey + 10 as line_no, case when o_orderkey % 13 = 0 then '# note' when o_orderkey % 17 = 0 then 'Label only' when o_orderkey % 19 = 0 then '  '
    else 'S' || (o_orderkey % 5) || sep || case o_orderstatus when 'F' then 'a' when 'O' then 'B' else '?' end || sep || sep || (o_orderkey % 9) || sep || '1e1' ||
      case when o_orderkey % 3 = 0 then sep || 'D' else '' end end as line
  from (select *, case when o_custkey % 2 = 0 then chr(9) else ' ' end as sep from orders)
  union all select c_custkey, 1, 'Truth ' from customer where c_custkey % 4 = 1
  union all select c_custkey, 2, 'Name' || case when c_custkey % 2 = 0 then chr(9) else ' ' end || 'q1' || case when c_custkey % 2 = 0 then chr(9) else ' ' end || 'q2'
    || case when c_custkey % 2 = 0 then chr(9) else ' ' end || 'q1' from customer where c_custkey % 3 = 0"""


def gt_lines(spark, sf_dir):
    o, sep = F.col("o_orderkey"), F.when(F.col("o_custkey") % 2 == 0, "\t").otherwise(" ")
    answer = F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "B").otherwise("?")
    data = F.concat(F.lit("S"), (o % 5).cast("string"), sep, answer, sep, sep, (o % 9).cast("string"), sep, F.lit("1e1"),
                    F.when(o % 3 == 0, F.concat(sep, F.lit("D"))).otherwise(""))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("scan_id"), (o + 10).alias("line_no"),
        F.when(o % 13 == 0, "# note").when(o % 17 == 0, "Label only").when(o % 19 == 0, "  ").otherwise(data).alias("line"))
    k = F.col("c_custkey")
    csep = F.when(k % 2 == 0, "\t").otherwise(" ")
    customers = table(spark, sf_dir, "customer")
    titles = customers.filter(k % 4 == 1).select(k.alias("scan_id"), F.lit(1).cast("bigint").alias("line_no"), F.lit("Truth ").alias("line"))
    heads = customers.filter(k % 3 == 0).select(
        k.alias("scan_id"), F.lit(2).cast("bigint").alias("line_no"), F.concat_ws("", F.lit("Name"), csep, F.lit("q1"), csep, F.lit("q2"), csep, F.lit("q1")).alias("line"))
    return rows.unionByName(titles).unionByName(heads)


@query("src_ground_truth", rf"""
with l as (select scan_id, line_no, trim(line) as line from ({GT_LINES_SQL}) where trim(line) <> '' and trim(line) not like '#%'),
tb as (select scan_id, bool_or(contains(line, chr(9))) as tabs from l group by 1),
t as (select l.scan_id, line_no, list_filter(list_transform(case when tabs then string_split(line, chr(9)) else string_split_regex(line, '\s+') end, lambda x: trim(x)), lambda x: x <> '') as t
  from l join tb using (scan_id)),
d as (select *, len(t) >= 2 and len(list_filter(t[2:], lambda x: not (upper(x) in ('A', 'B', 'C', 'D', '?') or try_cast(x as double) is not null))) = 0 as data from t),
st as (select scan_id, min(line_no) filter (data) as start, max(len(t) - 1) filter (data) as cols from d group by 1),
h as (select d.scan_id, arg_max(t[2:], line_no) as ids from d join st using (scan_id) where line_no < start and not data and len(t) >= 2
    and lower(t[1]) in ('name', 'student', 'students', 'names', '#') group by 1),
n as (select st.scan_id, coalesce(ids, list_transform(range(1, cols + 1), lambda i: i::varchar)) as ids from st left join h using (scan_id) where start is not null),
r as (select scan_id, t[1] as student, arg_max(t[2:], line_no) as v from d where data group by 1, 2),
c as (select scan_id, student, unnest(range(1, least(len(ids), len(v)) + 1)) as i, ids, v from r join n using (scan_id))
select scan_id, student, ids[i] as q_number, arg_max(v[i], i) as value from c group by 1, 2, 3""")
def src_ground_truth(spark, sf_dir):
    return gt.ground_truth(gt_lines(spark, sf_dir))


FIXED_SQL = """select p_size as scan_id, p_partkey as line_no, case when p_partkey % 11 = 0 then p_brand || ' A B' else
    'S' || (p_partkey % 7) || '  ' || left(p_type, 1) || chr(9) || 'A B ' || (p_partkey % 9) || ' C D' || case when p_partkey % 2 = 0 then ' extra' else '' end end as line from part"""


@query("src_ground_truth_fixed", rf"""
select scan_id, student, array_to_string(a, ' ') as answers from (
  select scan_id, t[1] as student, arg_max(t[2:7], line_no) as a from (
    select scan_id, line_no, string_split_regex(trim(line), '\s+') as t from ({FIXED_SQL}) qualify line_no > min(line_no) over (partition by scan_id))
  where len(t) >= 7 group by 1, 2)""")
def src_ground_truth_fixed(spark, sf_dir):
    k = F.col("p_partkey")
    data = F.concat(F.lit("S"), (k % 7).cast("string"), F.lit("  "), F.left("p_type", F.lit(1)), F.lit("\tA B "), (k % 9).cast("string"), F.lit(" C D"),
                    F.when(k % 2 == 0, " extra").otherwise(""))
    lines = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("scan_id"), k.alias("line_no"), F.when(k % 11 == 0, F.concat("p_brand", F.lit(" A B"))).otherwise(data).alias("line"))
    return gt.ground_truth_fixed(lines).select("scan_id", "student", F.array_join("answers", " ").alias("answers"))


@query("src_roster", """
with c as (select n_regionkey as scan_id, n_nationkey as row, 2 as col, n_name as val from nation
  union all select n_regionkey, n_nationkey, 1, case when n_nationkey % 2 = 0 then ' ' when n_nationkey % 7 = 3 then 'Student' end from nation
  union all select s_nationkey + 100, s_suppkey, s_suppkey % 3, case when s_suppkey % 10 = 0 then 'NAME' else s_acctbal::varchar end from supplier
  union all select s_nationkey + 100, s_suppkey, 5, s_name from supplier)
select scan_id::bigint as scan_id, row::bigint as row, student from (select scan_id, row, arg_min(trim(val), col) as student from c where val is not null and trim(val) <> '' group by 1, 2)
where lower(student) not in ('name', 'student', 'students', 'names', 'no', 'number', '#')""")
def src_roster(spark, sf_dir):
    key = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("bigint").alias("scan_id"), key.cast("bigint").alias("row"), F.inline(F.array(
            F.struct(F.lit(2).cast("bigint").alias("col"), F.col("n_name").alias("val")),
            F.struct(F.lit(1).cast("bigint").alias("col"), F.when(key % 2 == 0, " ").when(key % 7 == 3, "Student").alias("val")))))
    s = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") + 100).cast("bigint").alias("scan_id"), s.alias("row"), F.inline(F.array(
            F.struct((s % 3).alias("col"), F.when(s % 10 == 0, "NAME").otherwise(F.col("s_acctbal").cast("string")).alias("val")),
            F.struct(F.lit(5).cast("bigint").alias("col"), F.col("s_name").alias("val")))))
    return gt.roster(nation.unionByName(supplier))


# ---- cell comparison ---------------------------------------------------------------------------------

CELLS_SQL = """select source as student, d.doc_id as question, quality::varchar as expected, case when d.doc_id % 3 = 0 then chr(65 + toxic) end as expected_letter,
    case when d.doc_id % 5 = 0 then null else (n_chars % 2)::double end as mark, case d.doc_id % 4 when 0 then ' a ' when 1 then 'B' when 2 then '?' end as answer
  from documents d join labels l on d.doc_id = l.doc_id"""


@query("mdl_eval_compare", f"""
select student, question, coalesce(expected_letter, expected) as expected, case when expected_letter is null then coalesce(mark::varchar, '?') else upper(trim(coalesce(answer, '?'))) end as extracted,
  case when expected_letter is null then abs(coalesce(mark, 0) - expected::double) < 0.01
    else upper(trim(coalesce(answer, '?'))) = expected_letter and upper(trim(coalesce(answer, '?'))) not in ('', '?') end as ok from ({CELLS_SQL})""")
def mdl_eval_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    answer = F.when(k % 4 == 0, " a ").when(k % 4 == 1, "B").when(k % 4 == 2, "?")
    mark = F.when(k % 5 != 0, (F.col("n_chars") % 2).cast("double"))
    expected = F.when(k % 3 == 0, F.char(65 + F.col("toxic"))).otherwise(F.col("quality").cast("string"))
    return d.select(F.col("source").alias("student"), k.alias("question"), expected.alias("expected"),
                    evaluate.shown_value(answer, mark, expected).alias("extracted"), evaluate.cell_ok(answer, mark, expected).alias("ok"))


# ---- students against reference rows: names differ in case or by a suffix, or only the most similar one is left ------------------------------

TRUTH_SQL = """select l_orderkey // 30 as scan_id, case when l_orderkey % 2 = 0 then 'STUDENT' || l_orderkey else 'student' || l_orderkey || ' x' end as student, l_orderkey as pos,
    l_linenumber::varchar as q_number, case min(l_partkey) % 3 when 0 then chr((65 + min(l_suppkey) % 2)::int) when 1 then (min(l_suppkey) % 4)::varchar end as value
  from lineitem where l_orderkey % 10 <> 9 group by l_orderkey, l_linenumber"""
EVAL_RESULTS_SQL = f"select scan_id, 'Student' || student as student, q_number, answer, marks from ({MC_GRADES_SQL})"
# Reading 'studentN' is part of every longer name that starts with it, and the earliest one counts.
MATCHED_SQL = f"""select * from (with s as (select distinct scan_id, student from ({EVAL_RESULTS_SQL})), g as (select distinct scan_id, student, pos from ({TRUTH_SQL})),
  p as materialized (select s.scan_id, s.student, g.student as gt, lower(s.student) as low, lower(g.student) as clow, g.pos from s join g on s.scan_id = g.scan_id),
  t as materialized (select scan_id, student, arg_min(gt, case when clow = low then 0 else 1000000000000 end + pos) as matched from p
    where contains(clow, low) or contains(low, clow) group by 1, 2),
  o as materialized (select p.* from p anti join t using (scan_id, student)),
  q as materialized ({S.ratios("select low as a, clow as b from o")})
  select * from t union all select scan_id, student, arg_max(gt, (ratio, -pos)) from o join q on low = a and clow = b where ratio >= 0.6 group by 1, 2)"""
EVAL_CELLS_SQL = f"""select m.scan_id, m.student, m.matched, t.q_number, t.value as expected,
    case when try_cast(t.value as double) is not null then coalesce(printf('%.1f', r.marks), '?') else upper(trim(coalesce(r.answer, '?'))) end as extracted,
    case when try_cast(t.value as double) is not null then abs(coalesce(r.marks, 0) - t.value::double) < 0.01
      else upper(trim(coalesce(r.answer, '?'))) = t.value and upper(trim(coalesce(r.answer, '?'))) not in ('', '?') end as ok
  from ({MATCHED_SQL}) m join ({TRUTH_SQL}) t on m.scan_id = t.scan_id and m.matched = t.student and t.value is not null
  left join ({EVAL_RESULTS_SQL}) r on r.scan_id = m.scan_id and r.student = m.student and r.q_number = t.q_number"""
SCORES_SQL = f"""select m.scan_id, m.student, m.matched, count(*) filter (c.ok)::bigint as correct, count(c.q_number)::bigint as total,
    case when count(c.q_number) > 0 then count(*) filter (c.ok)::double / count(c.q_number) * 100 else 0.0::double end as accuracy_pct
  from ({MATCHED_SQL}) m left join ({EVAL_CELLS_SQL}) c using (scan_id, student) group by 1, 2, 3"""


def evaluation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("STUDENT"), k.cast("string"))).otherwise(F.concat(F.lit("student"), k.cast("string"), F.lit(" x")))
    p, s = F.col("p"), F.col("s")
    truth = (lines.filter(k % 10 != 9).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
             .select(F.floor(k / 30).alias("scan_id"), name.alias("student"), k.alias("pos"), F.col("l_linenumber").cast("string").alias("q_number"),
                     F.when(p % 3 == 0, F.char(65 + s % 2)).when(p % 3 == 1, (s % 4).cast("string")).alias("value")))
    results = mc_grades(spark, sf_dir).withColumn("student", F.concat(F.lit("Student"), F.col("student").cast("string")))
    truth, results = staged(truth), staged(results)
    leaves = results.select("scan_id", "q_number").distinct()
    matched = staged(evaluate.matched_students(results, truth))
    cells = evaluate.evaluated_cells(results.select("scan_id", "student", "q_number", "answer", "marks"), truth, matched, leaves)
    return matched, cells


@query("join_eval", f"select scan_id, student, matched, q_number, expected, extracted, ok from ({EVAL_CELLS_SQL})")
def join_eval(spark, sf_dir):
    return evaluation(spark, sf_dir)[1]


@query("agg_eval_student", f"select scan_id, student, matched, correct, total, round(accuracy_pct, 6) as accuracy_pct from ({SCORES_SQL})")
def agg_eval_student(spark, sf_dir):
    return evaluate.student_scores(*evaluation(spark, sf_dir)).withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query("agg_eval_overall", f"""select scan_id, sum(correct)::bigint as correct, sum(total)::bigint as total,
  round(case when sum(total) > 0 then sum(correct)::double / sum(total) * 100 else 0.0 end, 6) as accuracy_pct from ({SCORES_SQL}) group by rollup(scan_id)""")
def agg_eval_overall(spark, sf_dir):
    scores = evaluate.student_scores(*evaluation(spark, sf_dir))
    return evaluate.overall_scores(scores).withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query("rep_eval_matrix", f"""
with c as (select scan_id, student, q_number, case when ok then extracted else extracted || '/' || expected end as shown from ({EVAL_CELLS_SQL})),
p as (pivot c on q_number in ('1', '2', '3', '4', '5', '6', '7') using max(shown) group by scan_id, student)
select s.scan_id, s.student, coalesce("1", '–') as q1, coalesce("2", '–') as q2, coalesce("3", '–') as q3, coalesce("4", '–') as q4, coalesce("5", '–') as q5,
  coalesce("6", '–') as q6, coalesce("7", '–') as q7, printf('%.0f', {S.half_even('accuracy_pct')}) || '%' as acc, correct || '/' || total as score
from ({SCORES_SQL}) s left join p using (scan_id, student)""")
def rep_eval_matrix(spark, sf_dir):
    matched, cells = evaluation(spark, sf_dir)
    return eval_matrix(cells, evaluate.student_scores(matched, cells), LEAVES)


@query("rep_eval_by_exam", f"""
with o as (select scan_id, string_agg(q_number, ',' order by length(q_number), q_number) as ids from (select distinct scan_id, q_number from ({EVAL_RESULTS_SQL})) group by 1),
c as (select scan_id, student, q_number, case when ok then extracted else extracted || '/' || expected end as shown from ({EVAL_CELLS_SQL})),
x as (select s.scan_id, s.student, unnest(string_split(ids, ',')) as q from ({SCORES_SQL}) s join o using (scan_id))
select x.scan_id, x.student, string_agg('q' || q || '=' || coalesce(shown, '–'), ' ' order by length(q), q) as cells from x left join c on x.scan_id = c.scan_id and x.student = c.student and x.q = c.q_number group by 1, 2""")
def rep_eval_by_exam(spark, sf_dir):
    """Every scan with the leaves of its own exam, as a map in their order."""
    matched, cells = evaluation(spark, sf_dir)
    leaves = mc_grades(spark, sf_dir).select("scan_id", "q_number").distinct()
    return eval_map(cells, evaluate.student_scores(matched, cells), leaves).select("scan_id", "student", map_text("cells").alias("cells"))


# ---- extraction records --------------------------------------------------------------------------------

ACC_SQL = """select p_partkey as page_number, case when upper(trim(left(p_name, 1))) = upper(left(p_brand, 1)) then 1 else 0 end
    + case when upper(left(p_type, 1)) = 'S' then 1 else 0 end as hits from part"""


@query("agg_record_accuracy", f"select page_number, round(hits / 4.0::double * 100, 6) as accuracy from ({ACC_SQL})")
def agg_record_accuracy(spark, sf_dir):
    one = F.lit(1)
    extracted = [F.left("p_name", one), F.left("p_type", one), F.lit("?"), F.lit("A")]
    expected = [F.lower(F.left("p_brand", one)), F.lit(" s "), F.lit("?")]
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_number"), F.round(vote.record_accuracy(extracted, expected), 6).alias("accuracy"))


@query("agg_extraction_summary", """
with r as (select event_id % 10 as scan_id, case when event_id % 9 = 0 then 'UNKNOWN' when event_id % 9 = 1 then 'EXTRACTION_ERROR' else upper(event_type) end as student_name,
    case event_id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'failed' end as confidence, chr((65 + event_id % 3)::int) as q1, chr((65 + user_id % 3)::int) as q2 from events),
t as (select event_id % 10 as scan_id, event_type as student, chr((65 + min(event_id) % 3)::int) as x1, chr((65 + max(event_id) % 3)::int) as x2 from events where event_type <> 'view' group by 1, 2)
select r.scan_id, count(*)::bigint as pages, count(*) filter (confidence = 'high')::bigint as high, count(*) filter (confidence = 'medium')::bigint as medium,
  count(*) filter (confidence = 'low')::bigint as low, count(*) filter (confidence = 'failed')::bigint as failed,
  count(*) filter (student_name in ('UNKNOWN', 'EXTRACTION_ERROR'))::bigint as unreadable, count(t.student)::bigint as matched,
  coalesce(sum(case when t.student is not null then (q1 = x1)::int + (q2 = x2)::int end), 0)::bigint as correct, (2 * count(t.student))::bigint as total,
  round(case when count(t.student) > 0 then coalesce(sum((q1 = x1)::int + (q2 = x2)::int), 0)::double / (2 * count(t.student)) * 100 else 0.0 end, 6) as accuracy_pct
from r left join t on r.scan_id = t.scan_id and lower(r.student_name) = t.student group by 1""")
def agg_extraction_summary(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    events = table(spark, sf_dir, "events").withColumn("scan_id", e % 10)
    records = events.select(
        "scan_id", F.when(e % 9 == 0, "UNKNOWN").when(e % 9 == 1, "EXTRACTION_ERROR").otherwise(F.upper("event_type")).alias("student_name"),
        F.when(e % 4 == 0, "high").when(e % 4 == 1, "medium").when(e % 4 == 2, "low").otherwise("failed").alias("confidence"),
        F.char(65 + e % 3).alias("q1"), F.char(65 + u % 3).alias("q2"))
    truth = (events.filter(F.col("event_type") != "view").groupBy("scan_id", F.col("event_type").alias("student"))
             .agg(F.char(65 + F.min(e) % 3).alias("q1"), F.char(65 + F.max(e) % 3).alias("q2"), F.min(e).alias("pos")))
    return vote.extraction_summary(records, truth, ["q1", "q2"]).withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query("rep_extraction_table", """
select p_partkey as page_number, case when p_size % 7 = 0 then 'UNKNOWN' else p_name end as student_name, case when p_size % 3 = 0 then '?' else left(p_type, 1) end as q1,
  left(p_brand, 1) as q2 from part""")
def rep_extraction_table(spark, sf_dir):
    from gradelake.operators.report import extraction_table

    size, one = F.col("p_size"), F.lit(1)
    records = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_number"), F.when(size % 7 != 0, F.col("p_name")).alias("student_name"),
        F.when(size % 3 != 0, F.left("p_type", one)).alias("q1"), F.left("p_brand", one).alias("q2"))
    return extraction_table(records, ["q1", "q2"])


# ---- votes -----------------------------------------------------------------------------------------------

PASSES_SQL = """select user_id as page, row_number() over (partition by user_id order by event_id) as pass, event_type as q1, chr((65 + event_id % 2)::int) as q2,
    case when value < 10 then 'high' when value < 40 then 'medium' else 'low' end as confidence, case when event_id % 3 = 0 then 'UNKNOWN' else 'N' || (event_id % 4) end as student_name from events"""


def passes(spark, sf_dir):
    """Repeated readings of a page: its events, in the order of their ids."""
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page"), e.alias("pass"), F.col("event_type").alias("q1"), F.char(65 + e % 2).alias("q2"),
        F.when(v < 10, "high").when(v < 40, "medium").otherwise("low").alias("confidence"),
        F.when(e % 3 == 0, "UNKNOWN").otherwise(F.concat(F.lit("N"), (e % 4).cast("string"))).alias("student_name"))


def _vote_sql(field: str, where: str = "true") -> str:
    return f"""(select page, arg_max(v, n * 1000000 - seen) as w, max(n) as n, sum(n)::bigint as votes from (
      select page, {field} as v, count(*) as n, min(pass) as seen from p where {where} group by 1, 2) group by 1)"""


@query("agg_vote_ensemble", f"""
with p as ({PASSES_SQL}), a as {_vote_sql('q1')}, b as {_vote_sql('q2')}, c as {_vote_sql('confidence')},
n as {_vote_sql('student_name', "student_name not in ('UNKNOWN', 'EXTRACTION_ERROR', '?')")}, f as (select page, arg_min(student_name, pass) as first_name from p group by 1)
select page, a.w as q1, b.w as q2, case when a.votes = 1 then null when a.n = a.votes then 'high' when a.n * 2 >= a.votes then 'medium' else 'low' end as q1_confidence,
  case when b.votes = 1 then null when b.n = b.votes then 'high' when b.n * 2 >= b.votes then 'medium' else 'low' end as q2_confidence, c.w as confidence, coalesce(n.w, first_name) as student_name
from a join b using (page) join c using (page) join f using (page) left join n using (page)""")
def agg_vote_ensemble(spark, sf_dir):
    return vote.ensemble(passes(spark, sf_dir), ["q1", "q2"])


@query("agg_vote_multipass", f"""
with p as (select page, pass, student_name, q2, confidence from ({PASSES_SQL})), a as {_vote_sql('student_name')}, b as {_vote_sql('q2')}, c as {_vote_sql('confidence')},
h as (select page, arg_min(student_name, pass) as hs, arg_min(q2, pass) as hq, arg_min(confidence, pass) as hc from p where confidence = 'high' group by 1),
s as (select page, count(distinct (student_name, q2, confidence)) as kinds, bool_and(confidence = 'high') as all_high, arg_min((student_name, q2, confidence), pass) as f from p group by 1)
select page, case when a.n * 2 >= a.votes then a.w else coalesce(hs, a.w) end as student_name, case when b.n * 2 >= b.votes then b.w else coalesce(hq, b.w) end as q2,
  case when all_high then case when c.n * 2 >= c.votes then c.w else coalesce(hc, c.w) end when kinds = 1 then c.w else 'medium' end as confidence
from a join b using (page) join c using (page) join s using (page) left join h using (page)""")
def agg_vote_multipass(spark, sf_dir):
    return vote.multi_pass(passes(spark, sf_dir), ["student_name", "q2", "confidence"], ["q2"])
