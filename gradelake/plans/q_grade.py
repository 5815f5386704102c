"""Grading pass bound to line items: student = order, question = line number, scan = 30 orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import numbers, replies
from gradelake.operators import grade
from gradelake.plans import sqlbits as S
from gradelake.plans.q_text import REPLY_TEXT_SQL, reply_text
from gradelake.plans.registry import query
from gradelake.session import staged, table

STUDENT = ["scan_id", "student"]
#: Numbers that a line of an order can have.
LEAVES = [str(n) for n in range(1, 8)]

# ---- bindings: one reply per (student, question), the key of its part ------------------------

REPLIES_SQL = f"""select l_orderkey // 30 as scan_id, l_orderkey as student, l_linenumber::varchar as q_number, raw, p_size as max_marks,
    chr((65 + l_partkey % 2)::int) as key_letter, l_linestatus as status, p_type, l_quantity from (
  select l_orderkey, l_linenumber, l_partkey, l_linestatus, l_quantity, {REPLY_TEXT_SQL} as raw,
    row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate) as rn from lineitem)
  join part on l_partkey = p_partkey where rn = 1"""


def reply_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity")).alias("f"))
    rows = first.select("l_orderkey", "l_linenumber", "f.*")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    return rows.join(part, rows.l_partkey == part.p_partkey).select(
        F.floor(F.col("l_orderkey") / 30).alias("scan_id"), F.col("l_orderkey").alias("student"),
        F.col("l_linenumber").cast("string").alias("q_number"), reply_text().alias("raw"),
        F.col("p_size").alias("max_marks"), F.char(65 + F.col("l_partkey") % 2).alias("key_letter"),
        F.col("l_linestatus").alias("status"), "p_type", "l_quantity")


def letter_reply():
    return F.to_json(F.struct(F.col("raw").alias("answer")))


MC_GRADES_SQL = f"""select scan_id, student, q_number, case when status = 'F' and q_number = '7' then '-' else upper(trim(raw)) end as answer,
    case when status = 'F' and q_number = '7' then 0.0::double when upper(trim(raw)) = key_letter then max_marks::double else 0.0::double end as marks,
    max_marks from ({REPLIES_SQL})"""


def unanswered():
    return (F.col("status") == "F") & (F.col("q_number") == "7")


def mc_grades(spark, sf_dir):
    """Letters graded against the key; line 7 of finished items stands for unattempted questions."""
    rows = reply_rows(spark, sf_dir)
    letter = grade.mc_answer(letter_reply())
    return rows.withColumn("answer", F.when(unanswered(), replies.NOT_ATTEMPTED).otherwise(letter)).select(
        *STUDENT, "q_number", "answer", grade.mc_marks(F.col("answer"), F.col("key_letter"), F.col("max_marks")).alias("marks"),
        "max_marks")


TOTALS_SQL = f"""select scan_id, student, sum(marks) as total, sum(max_marks)::bigint as max_marks from ({MC_GRADES_SQL}) group by 1, 2"""


def totals(spark, sf_dir):
    return mc_grades(spark, sf_dir).groupBy(*STUDENT).agg(
        F.sum("marks").alias("total"), F.sum("max_marks").alias("max_marks"))


# ---- marks -----------------------------------------------------------------------------------


@query("mdl_grade_mc", f"""select scan_id, student, q_number, upper(trim(raw)) as answer,
  case when upper(trim(raw)) = key_letter then max_marks::double else 0.0::double end as marks from ({REPLIES_SQL})""")
def mdl_grade_mc(spark, sf_dir):
    rows = reply_rows(spark, sf_dir).withColumn("answer", grade.mc_answer(letter_reply()))
    return rows.select(*STUDENT, "q_number", "answer",
                       grade.mc_marks(F.col("answer"), F.col("key_letter"), F.col("max_marks")).alias("marks"))


WRITTEN_SQL = """select l_orderkey // 30 as scan_id, l_orderkey as student, l_linenumber::varchar as q_number, l_shipdate, l_partkey, l_suppkey,
    case when l_returnflag = 'R' then ' ' else l_linestatus end as answer,
    case when l_suppkey % 10 = 0 then 'x' else (l_quantity - 5)::varchar end as value, p_size as max_marks
  from lineitem join part on l_partkey = p_partkey"""


def written_reads(spark, sf_dir):
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.floor(F.col("l_orderkey") / 30).alias("scan_id"), F.col("l_orderkey").alias("student"),
        F.col("l_linenumber").cast("string").alias("q_number"), "l_shipdate", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_linestatus")).alias("answer"),
        F.when(F.col("l_suppkey") % 10 == 0, "x").otherwise((F.col("l_quantity") - 5).cast("string")).alias("value"),
        F.col("p_size").alias("max_marks"))


WRITTEN_MARKS_SQL = f"""select *, case when try_cast(value as double) is null then 0.0::double else least(value::double, max_marks::double) end as marks from ({WRITTEN_SQL})"""


@query("mdl_grade_written", f"select scan_id, student, q_number, answer, marks from ({WRITTEN_MARKS_SQL})")
def mdl_grade_written(spark, sf_dir):
    marks = grade.written_marks(F.col("value"), F.col("max_marks"))
    return written_reads(spark, sf_dir).select("scan_id", "student", "q_number", "answer", marks.alias("marks"))


FIRST_READ_SQL = f"""with r as (select *, row_number() over (partition by student, q_number order by l_shipdate, l_partkey, l_suppkey, marks) as rn
    from ({WRITTEN_MARKS_SQL}) where trim(answer) not in ('', '?')),
  k as (select distinct scan_id, student, q_number from ({WRITTEN_SQL}))
  select k.scan_id, k.student, k.q_number, coalesce(r.answer, '?') as answer, coalesce(r.marks, 0.0::double) as marks
  from k left join r on k.student = r.student and k.q_number = r.q_number and r.rn = 1"""


@query("win_first_readable_page", FIRST_READ_SQL)
def win_first_readable_page(spark, sf_dir):
    reads = (written_reads(spark, sf_dir)
             .withColumn("marks", grade.written_marks(F.col("value"), F.col("max_marks")))
             .withColumn("answer", F.trim("answer")))
    # Ties inside one page are settled by the marks, so the order ends with them.
    return grade.first_readable(reads, [*STUDENT, "q_number"], ["l_shipdate", "l_partkey", "l_suppkey", F.col("marks").alias("m")])


@query("mdl_unattempted", f"""select scan_id, student, q_number, answer, marks, count(*) over (partition by scan_id, q_number)::bigint as skipped
  from ({MC_GRADES_SQL}) where answer = '-' and marks = 0""")
def mdl_unattempted(spark, sf_dir):
    """Every unattempted question with its answer and marks, and how many of the scan left it out."""
    flagged = reply_rows(spark, sf_dir).withColumn("attempted", ~unanswered())
    rows = grade.with_skipped(grade.unattempted(flagged))
    return rows.select(*STUDENT, "q_number", "answer", "marks", "skipped")


@query("join_attempts_default", """
with seen as (select o_orderkey as student, o_orderstatus as st from orders where o_orderstatus <> 'P'),
hit as (select distinct l_orderkey as student, l_linenumber::varchar as q_number from lineitem join orders on l_orderkey = o_orderkey
    where o_orderstatus <> 'P' and l_linestatus = o_orderstatus),
leaves as (select distinct l_orderkey // 30 % 4 as exam, l_linenumber as n from lineitem),
pairs as (select o_orderkey as student, n::varchar as q_number from orders join leaves on o_orderkey // 30 % 4 = exam)
select student // 30 as scan_id, q_number, count(*)::bigint as students,
  count(*) filter (seen.student is null or hit.student is not null)::bigint as attempted
from pairs left join seen using (student) left join hit using (student, q_number) group by 1, 2""")
def join_attempts_default(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 30).alias("scan_id"), F.col("o_orderkey").alias("student"),
        F.col("o_orderstatus").alias("st"))
    lines = table(spark, sf_dir, "lineitem")
    seen = orders.filter(F.col("st") != "P")
    hits = (lines.join(seen, (lines.l_orderkey == seen.student) & (lines.l_linestatus == seen.st))
            .select(*STUDENT, F.col("l_linenumber").cast("string").alias("q_number")))
    # A scan belongs to one of four exams; the leaves of an exam are a short table.
    leaves = lines.select((F.floor(F.col("l_orderkey") / 30) % 4).alias("exam"), F.col("l_linenumber").cast("string").alias("q_number")).distinct()
    pairs = orders.withColumn("exam", F.col("scan_id") % 4).join(leaves, "exam").select(*STUDENT, "q_number")
    flagged = grade.with_attempt_flag(pairs, hits, seen)
    return flagged.groupBy("scan_id", "q_number").agg(
        F.count("*").alias("students"), F.count_if("attempted").alias("attempted"))


@query("agg_student_totals", f"""select t.scan_id, t.student, t.total, m.max_marks from ({TOTALS_SQL}) t
  join (select scan_id, sum(mx)::bigint as max_marks from (select scan_id, q_number, max(max_marks) as mx from ({REPLIES_SQL}) group by 1, 2) group by 1) m
  using (scan_id)""")
def agg_student_totals(spark, sf_dir):
    grades = mc_grades(spark, sf_dir)
    leaves = grades.groupBy("scan_id", "q_number").agg(F.max("max_marks").alias("max_marks"))
    return grade.student_totals(grades, leaves).select(*STUDENT, "total", "max_marks")


@query("agg_class_stats", f"""
with t as ({TOTALS_SQL}),
s as (select scan_id, count(*)::bigint as students, max(max_marks) as max_marks, avg(total) as mean, median(total) as median,
    max(total) as highest, min(total) as lowest from t group by 1),
u as (unpivot s on mean, median, highest, lowest into name metric value value)
select scan_id, students, max_marks, metric, round(value, 6) as value,
  case when max_marks <> 0 then round(value / max_marks * 100, 6) else 0.0 end as pct from u""")
def agg_class_stats(spark, sf_dir):
    stats = grade.class_stats(totals(spark, sf_dir))
    return stats.select("scan_id", "students", "max_marks", "metric", F.round("value", 6).alias("value"), F.round("pct", 6).alias("pct"))


@query("agg_count_marks", """
select user_id // 25 as scan_id, user_id as student, event_type as q_number, round(sum(v), 4) as marks from (
  select user_id, event_type, try_cast(case when event_id % 7 = 0 then 'n/a' else value::varchar end as double) as v from events)
where v is not null group by 1, 2, 3""")
def agg_count_marks(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 25).alias("scan_id"), F.col("user_id").alias("student"), F.col("event_type").alias("q_number"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    return grade.counted_marks(entries).withColumn("marks", F.round("marks", 4))


# ---- attempts --------------------------------------------------------------------------------

ATTEMPTED_SQL = """select distinct l_orderkey // 30 as scan_id, l_orderkey as student,
    (l_linenumber * 3 + 3) || case l_returnflag when 'A' then 'a' when 'N' then 'b' else '' end as q_number from lineitem"""


def attempted(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 30).alias("scan_id"), F.col("l_orderkey").alias("student"),
        F.concat((F.col("l_linenumber") * 3 + 3).cast("string"), F.when(flag == "A", "a").when(flag == "N", "b").otherwise("")).alias("q_number"),
    ).distinct()


@query("agg_attempted_union", f"""select scan_id, student, string_agg(q_number, ', ' order by length(q_number), q_number) as questions
  from ({ATTEMPTED_SQL}) group by 1, 2""")
def agg_attempted_union(spark, sf_dir):
    return grade.in_id_order(attempted(spark, sf_dir), STUDENT)


@query("sort_question_ids", f"""select scan_id, q_number, row_number() over (partition by scan_id order by length(q_number), q_number)::bigint as pos
  from (select distinct scan_id, q_number from ({ATTEMPTED_SQL}))""")
def sort_question_ids(spark, sf_dir):
    from pyspark.sql import Window

    ids = attempted(spark, sf_dir).select("scan_id", "q_number").distinct()
    order = Window.partitionBy("scan_id").orderBy(F.length("q_number"), "q_number")
    return ids.withColumn("pos", F.row_number().over(order).cast("bigint"))


@query("mdl_detect_attempts", """
with d as (select l_orderkey // 30 as scan_id, l_orderkey as student, l_linenumber as n, l_returnflag as f from lineitem),
q as (select distinct scan_id, student, n::varchar as q from d where f <> 'R' and n <= 6 union select distinct scan_id, student, '10a' from d where f = 'A' and n <= 6)
select s.scan_id, s.student, coalesce(string_agg(q, ', ' order by length(q), q), '') as questions
from (select distinct scan_id, student from d) s left join q on s.scan_id = q.scan_id and s.student = q.student group by 1, 2""")
def mdl_detect_attempts(spark, sf_dir):
    """Scans of six pages; a reply of the seventh doesn't count."""
    n, flag = F.col("l_linenumber").cast("string"), F.col("l_returnflag")
    raw = (F.when(flag == "A", F.concat(F.lit('Sure: {"attempted": ["'), n, F.lit('", "10a", null]} ok')))
           .when(flag == "N", F.concat(F.lit('{"attempted": ['), n, F.lit("]}"))).otherwise('{"attempted": "none"}'))
    reads = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 30).alias("scan_id"), F.col("l_orderkey").alias("student"), F.col("l_linenumber").alias("page"), raw.alias("raw"))
    scans = reads.select("scan_id").distinct().withColumn("page_count", F.lit(6))
    return grade.attempt_lists(reads.select(*STUDENT, "page"), scans, reads)


@query("rep_attempt_summary", f"""
with a as (select student, string_agg(q_number, ', ' order by length(q_number), q_number) as questions from ({ATTEMPTED_SQL}) group by 1)
select o_orderkey // 30 as scan_id, o_orderkey as student, coalesce(questions, 'none') as questions from orders left join a on o_orderkey = student""")
def rep_attempt_summary(spark, sf_dir):
    from gradelake.operators.report import attempt_summary

    students = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 30).alias("scan_id"), F.col("o_orderkey").alias("student"))
    return attempt_summary(students, attempted(spark, sf_dir))


# ---- reports ---------------------------------------------------------------------------------


@query("rep_results_matrix", f"""
with p as (pivot (select scan_id, student, q_number, marks from ({MC_GRADES_SQL})) on q_number in ('1', '2', '3', '4', '5', '6', '7')
    using first(marks) group by scan_id, student)
select scan_id, student, coalesce(printf('%.1f', "1"), '–') as q1, coalesce(printf('%.1f', "2"), '–') as q2, coalesce(printf('%.1f', "3"), '–') as q3,
  coalesce(printf('%.1f', "4"), '–') as q4, coalesce(printf('%.1f', "5"), '–') as q5, coalesce(printf('%.1f', "6"), '–') as q6,
  coalesce(printf('%.1f', "7"), '–') as q7, total, case when max_marks <> 0 then round(total / max_marks * 100, 6) else 0.0 end as pct,
  {S.band("(case when max_marks <> 0 then total / max_marks * 100 else 0.0 end)")} as band
from p join ({TOTALS_SQL}) using (scan_id, student)""")
def rep_results_matrix(spark, sf_dir):
    from gradelake.operators.report import results_matrix

    grades = mc_grades(spark, sf_dir)
    return results_matrix(grades, LEAVES).withColumn("pct", F.round("pct", 6))


@query("rep_results_by_exam", f"""
with g as ({MC_GRADES_SQL}), o as (select scan_id, string_agg(q_number, ',' order by length(q_number), q_number) as ids from (select distinct scan_id, q_number from g) group by 1),
x as (select s.scan_id, s.student, unnest(string_split(ids, ',')) as q from (select distinct scan_id, student from g) s join o using (scan_id)),
m as (select x.scan_id, x.student, string_agg('q' || q || '=' || coalesce(printf('%.1f', marks), '–'), ' ' order by length(q), q) as cells
  from x left join g on x.scan_id = g.scan_id and x.student = g.student and x.q = g.q_number group by 1, 2)
select scan_id, student, cells, total, case when max_marks <> 0 then round(total / max_marks * 100, 6) else 0.0 end as pct, {S.band("(case when max_marks <> 0 then total / max_marks * 100 else 0.0 end)")} as band
from m join ({TOTALS_SQL}) using (scan_id, student)""")
def rep_results_by_exam(spark, sf_dir):
    """Every scan with the leaves of its own exam, as a map in their order."""
    from gradelake.operators.report import map_text, results_map

    # Cells, order and totals read the grades, so they are written once.
    grades = staged(mc_grades(spark, sf_dir), "grades")
    out = results_map(grades, grades.select("scan_id", "q_number").distinct())
    return out.select(*STUDENT, map_text("cells").alias("cells"), "total", F.round("pct", 6).alias("pct"), "band")


# ---- filters ---------------------------------------------------------------------------------


@query("filter_valid_pages", """
select l_orderkey // 30 as scan_id, l_orderkey as student, count(*)::bigint as pages from lineitem
where l_linenumber between 1 and 4 group by 1, 2""")
def filter_valid_pages(spark, sf_dir):
    assigned = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 30).alias("scan_id"), F.col("l_orderkey").alias("student"), F.col("l_linenumber").alias("page"))
    scans = assigned.select("scan_id").distinct().withColumn("page_count", F.lit(4))
    return grade.valid_pages(assigned, scans).groupBy(*STUDENT).agg(F.count("*").alias("pages"))


@query("filter_mc_questions", """
select p_partkey as question, case when p_type in ('SMALL', 'LARGE') then 'multiple_choice' else 'short_answer' end as question_type, task
from part, (values ('check_mc'), ('check_answers')) t(task)
where p_size % 5 <> 0 and (task <> 'check_mc' or p_type in ('SMALL', 'LARGE'))""")
def filter_mc_questions(spark, sf_dir):
    kind = F.when(F.col("p_type").isin("SMALL", "LARGE"), "multiple_choice").otherwise("short_answer")
    tasks = F.explode(F.array(F.lit(grade.TASK_MC), F.lit(grade.TASK_ANSWERS)))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question"), kind.alias("question_type"), (F.col("p_size") % 5 != 0).alias("is_leaf"), tasks.alias("task"))
    return grade.gradable(rows, F.col("task")).drop("is_leaf")


@query("prompt_columns", """
with leaves as (select p_partkey // 80 as exam_id, p_partkey as leaf_no, p_partkey::varchar as q_number from part),
e as (select exam_id, 'Questions: ' || string_agg(q_number, ', ' order by leaf_no) || '. Which are attempted on this page? Reply as {"attempted": ["1", "2a"]}.' as prompt
  from leaves group by 1)
select p_partkey as question, 'Question ' || p_partkey || ': which of A, B, C, D is marked? Reply as {"answer": "B"}.' ||
    case when p_size % 2 = 0 then ' Key: ' || left(p_name, 1) || '.' else '' end as mc,
  'Question ' || p_partkey || ' (max ' || (p_size % 3) || ' mark' || case when p_size % 3 <> 1 then 's' else '' end || '), criteria: ' ||
    case when p_size % 4 = 0 then p_name when p_size % 4 = 1 then p_type else '(see mark scheme)' end || '. Reply as {"answer": "…", "marks": 1.5}.' as written,
  md5(e.prompt) as attempts from part join e on p_partkey // 80 = exam_id""")
def prompt_columns(spark, sf_dir):
    size, number = F.col("p_size"), F.col("p_partkey").cast("string")
    part = table(spark, sf_dir, "part").withColumn("exam_id", F.floor(F.col("p_partkey") / 80))
    leaves = part.select("exam_id", F.col("p_partkey").alias("leaf_no"), number.alias("q_number"))
    per_exam = grade.attempt_prompt(leaves).select("exam_id", F.md5("prompt").alias("attempts"))
    return part.join(per_exam, "exam_id").select(
        F.col("p_partkey").alias("question"),
        grade.mc_prompt(number, F.when(size % 2 == 0, F.substring("p_name", 1, 1))).alias("mc"),
        grade.written_prompt(number, size % 3, F.when(size % 4 == 0, F.col("p_name")).otherwise(F.lit("")),
                             F.when(size % 4 == 1, F.col("p_type"))).alias("written"), "attempts")


# ---- the whole pass ----------------------------------------------------------------------------

TASK_SQL = "case scan_id % 4 when 0 then 'check_mc' when 1 then 'check_answers' when 2 then 'count_marks' else 'build_scaffold' end"


@query("mdl_grade_students", f"""
with r as (select *, {TASK_SQL} as task, p_type in ('SMALL', 'LARGE') as mc from ({REPLIES_SQL})),
asked as (select * from r where task = 'check_answers' or (task = 'check_mc' and mc)),
g as (select scan_id, student, q_number, case when status = 'F' and q_number = '7' then 0.0::double
    when q_number > '4' then 0.0::double
    when mc then case when upper(trim(raw)) = key_letter then max_marks::double else 0.0::double end
    when raw = 'a' then least(l_quantity - 5, max_marks::double) else 0.0::double end as marks from asked
  union all select scan_id, student, q_number, l_quantity as marks from r where task = 'count_marks' and raw <> 'a' and q_number <= '4'),
t as (select scan_id, student, sum(marks) as total, count(*)::bigint as questions from g group by 1, 2),
m as (select scan_id, sum(mx)::bigint as max_marks from (select scan_id, q_number, max(max_marks) as mx from r group by 1, 2) group by 1)
select s.scan_id, s.student, coalesce(total, 0.0::double) as total, coalesce(questions, 0)::bigint as questions, max_marks
from (select distinct scan_id, student from r where q_number between '1' and '4') s left join t using (scan_id, student) join m using (scan_id)""")
def mdl_grade_students(spark, sf_dir):
    from gradelake.operators.grading_pass import grade_students

    # Every branch of the pass reads the replies, so they are written once.
    rows = staged(reply_rows(spark, sf_dir), "replies")
    number = F.col("q_number").cast("int")
    assigned = rows.select(*STUDENT, number.alias("page"))
    scan = F.col("scan_id") % 4
    scans = rows.select("scan_id").distinct().select(
        "scan_id", F.lit(4).alias("page_count"),
        F.when(scan == 0, grade.TASK_MC).when(scan == 1, grade.TASK_ANSWERS).when(scan == 2, grade.TASK_COUNT)
        .otherwise("build_scaffold").alias("task"))
    kind = F.when(F.col("p_type").isin("SMALL", "LARGE"), "multiple_choice").otherwise("short_answer")
    questions = rows.select(*STUDENT, "q_number", kind.alias("question_type"), F.lit(True).alias("is_leaf"),
                            F.col("key_letter").alias("correct_answer"), "max_marks")
    unread = F.when((F.col("status") == "F") & (F.col("q_number") == "7"), F.lit(False)).otherwise(F.lit(True))
    attempts = rows.filter(unread).select(*STUDENT, "q_number")
    written = F.when(F.col("raw") == "a", "done").otherwise("?")
    reads = rows.select(
        *STUDENT, "q_number", number.alias("page"),
        F.when(kind == "multiple_choice", grade.mc_answer(letter_reply())).otherwise(written).alias("answer"),
        (F.col("l_quantity") - 5).cast("string").alias("value"))
    red = rows.filter(F.col("raw") != "a").select(*STUDENT, "q_number", number.alias("page"), F.col("l_quantity").cast("string").alias("value"))
    return grade_students(assigned, scans, questions, attempts, rows.select(*STUDENT).distinct(), reads, red)
