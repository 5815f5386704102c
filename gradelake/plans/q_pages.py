"""Names, pages and rosters bound to conversations: scan = conversation, page = turn + 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import grade, match
from gradelake.operators.report import page_summary
from gradelake.plans import sqlbits as S
from gradelake.plans.registry import query
from gradelake.session import table

PAGES_SQL = """select conv_id as scan_id, turn + 1 as page, case when role <> 'assistant' then role || (turn % 3) end as name from conversations"""


def named_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("scan_id"), (F.col("turn") + 1).alias("page"),
        F.when(F.col("role") != "assistant", F.concat("role", (F.col("turn") % 3).cast("string"))).alias("name"))


FILLED_SQL = f"""select * from (select scan_id, page, name, last_value(name ignore nulls) over (partition by scan_id order by page) as student
  from ({PAGES_SQL})) where student is not null"""
STUDENTS_SQL = f"""select scan_id, student, min(page) as first_page, count(*)::bigint as n_pages,
  case when arg_min(name is not null, page) then 'high' else 'low' end as confidence from ({FILLED_SQL}) group by 1, 2"""
ROSTER_SQL = """select c.scan_id, r.role || k.n as student from (select distinct conv_id as scan_id from conversations) c,
  (values ('system'), ('user')) r(role), (values (0), (1), (2)) k(n)"""


def filled(spark, sf_dir):
    return grade.forward_filled(named_pages(spark, sf_dir))


def roster(spark, sf_dir):
    names = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f"{r}{n}").alias("student"))
                      for i, (r, n) in enumerate((r, n) for r in ("system", "user") for n in range(3))])
    scans = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scan_id")).distinct()
    return scans.select("scan_id", F.inline(names))


@query("win_forward_fill_name", FILLED_SQL)
def win_forward_fill_name(spark, sf_dir):
    return filled(spark, sf_dir).select("scan_id", "page", "name", "student")


@query("win_confidence", f"select scan_id, student, confidence from ({STUDENTS_SQL})")
def win_confidence(spark, sf_dir):
    return grade.students_of(filled(spark, sf_dir)).select("scan_id", "student", "confidence")


@query("agg_pages_per_student", f"select scan_id, student, first_page, n_pages from ({STUDENTS_SQL})")
def agg_pages_per_student(spark, sf_dir):
    return grade.students_of(filled(spark, sf_dir)).select("scan_id", "student", "first_page", "n_pages")


@query("join_roster_missing", f"""select r.scan_id, r.student from ({ROSTER_SQL}) r
  where not exists (select 1 from ({STUDENTS_SQL}) s where s.scan_id = r.scan_id and s.student = r.student)""")
def join_roster_missing(spark, sf_dir):
    return grade.missing_from(roster(spark, sf_dir).drop("pos"), filled(spark, sf_dir))


@query("set_difference_roster", f"""select r.student, count(*)::bigint as scans from ({ROSTER_SQL}) r
  where not exists (select 1 from ({STUDENTS_SQL}) s where s.scan_id = r.scan_id and s.student = r.student) group by 1""")
def set_difference_roster(spark, sf_dir):
    missing = grade.missing_from(roster(spark, sf_dir).drop("pos"), filled(spark, sf_dir))
    return missing.groupBy("student").agg(F.count("*").alias("scans"))


@query("filter_students", f"""
with s as (select *, row_number() over (partition by scan_id order by first_page, student) as r from ({STUDENTS_SQL}))
select scan_id, student, first_page from s where case scan_id % 3 when 0 then lower(student) in ('user0', 'system0')
  when 1 then r <= 1 else true end""")
def filter_students(spark, sf_dir):
    students = grade.students_of(filled(spark, sf_dir))
    k = F.col("scan_id") % 3
    requests = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scan_id")).distinct().select(
        "scan_id", F.when(k == 0, "specific").when(k == 1, "first_n").otherwise("all").alias("mode"),
        F.when(k == 0, F.array(F.lit("USER0"), F.lit("System0"))).otherwise(F.expr("cast(array() as array<string>)")).alias("names"),
        F.when(k == 1, 1).otherwise(0).alias("n"))
    return grade.filtered_students(students, requests).select("scan_id", "student", "first_page")


@query("topk_first_n_students", f"""
select scan_id, student from (select *, row_number() over (partition by scan_id order by first_page, student) as r from ({STUDENTS_SQL})) where r <= 5""")
def topk_first_n_students(spark, sf_dir):
    from pyspark.sql import Window

    # Spark keeps only the first five per scan before the shuffle (group limit).
    order = Window.partitionBy("scan_id").orderBy("first_page", "student")
    return (grade.students_of(filled(spark, sf_dir)).withColumn("r", F.row_number().over(order))
            .filter(F.col("r") <= 5).select("scan_id", "student"))


@query("rep_page_summary", f"""select scan_id, student, string_agg(page::varchar, ', ' order by page) as pages, any_value(confidence) as confidence
  from ({FILLED_SQL}) join (select scan_id, student, confidence from ({STUDENTS_SQL})) using (scan_id, student) group by 1, 2""")
def rep_page_summary(spark, sf_dir):
    pages = filled(spark, sf_dir)
    return page_summary(pages, grade.students_of(pages))


ASSIGN_READS_SQL = """select conv_id as scan_id, turn + 1 as page, case role when 'assistant' then '' when 'system' then upper('system' || (turn % 3))
    else 'Name: user' || (turn % 3) || ' ' end as read from conversations"""


@query("mdl_assign_pages", f"""
with r as ({ASSIGN_READS_SQL}), roster as (select *, case when student like 'system%' then 0 else 3 end + right(student, 1)::int as pos from ({ROSTER_SQL})),
m as (select r.scan_id, r.page, arg_min(s.student, case when lower(s.student) = lower(trim(r.read)) then 0 else 100 end + s.pos) as name
  from r join roster s on r.scan_id = s.scan_id and trim(r.read) <> '' and (lower(s.student) = lower(trim(r.read)) or contains(lower(trim(r.read)), lower(s.student))
    or contains(lower(s.student), lower(trim(r.read)))) group by 1, 2),
f as (select r.scan_id, r.page, last_value(m.name ignore nulls) over (partition by r.scan_id order by r.page) as student from r left join m using (scan_id, page))
select * from f where student is not null""")
def mdl_assign_pages(spark, sf_dir):
    role, turn = F.col("role"), (F.col("turn") % 3).cast("string")
    raw = (F.when(role == "assistant", '{"name": ""}')
           .when(role == "system", F.concat(F.lit('Here: {"name": "SYSTEM'), turn, F.lit('"} done')))
           .otherwise(F.concat(F.lit('{"name": "Name: user'), turn, F.lit(" "))))
    reads = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scan_id"), (F.col("turn") + 1).alias("page"), raw.alias("raw"))
    return grade.assign_pages(reads, roster(spark, sf_dir)).select("scan_id", "page", "student")


# ---- names against rosters: scan = 40 customers in key order --------------------------------------

NAMES_SQL = """select c_custkey // 40 as scan_id, c_custkey as pos, c_name as student,
    case c_custkey % 4 when 0 then upper(c_name) when 1 then left(c_name, length(c_name) - 2) when 2 then 'x ' || c_name || ' (b)' else '+++' end as name from customer"""


def name_reads(spark, sf_dir):
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 40).alias("scan_id"), F.col("c_custkey").alias("pos"), n.alias("student"),
        F.when(k == 0, F.upper(n)).when(k == 1, F.left(n, F.length(n) - 2)).when(k == 2, F.concat(F.lit("x "), n, F.lit(" (b)")))
        .otherwise("+++").alias("name"))


@query("join_fuzzy_name", f"""
with r as ({NAMES_SQL}), p as (select a.scan_id, a.name, b.student, b.pos, case when lower(a.name) = lower(b.student) then 1 else 2 end as tier
  from (select distinct scan_id, name from r) a join r b on a.scan_id = b.scan_id
    and (contains(lower(a.name), lower(b.student)) or contains(lower(b.student), lower(a.name)))),
m as (select scan_id, name, arg_min(student, tier * 1000000000000 + pos) as matched, min(tier)::int as tier from p group by 1, 2)
select scan_id, name, matched, tier from m""")
def join_fuzzy_name(spark, sf_dir):
    rows = name_reads(spark, sf_dir)
    return match.match_names(rows.select("scan_id", "name"), rows.select("scan_id", "student", "pos"))


def swapped(name):
    """Two neighbouring characters changed over, and one letter misread."""
    n = F.length(name)
    return F.concat(F.left(name, n - 3), F.substr(name, n - 1, F.lit(1)), F.substr(name, n - 2, F.lit(1)), F.lit("o"))


SWAPPED_SQL = "left(c_name, length(c_name) - 3) || substr(c_name, (length(c_name) - 1)::int, 1) || substr(c_name, (length(c_name) - 2)::int, 1) || 'o'"
SIMILAR_SQL = f"""with r as (select c_custkey // 40 as scan_id, c_custkey as pos, c_name as student, {SWAPPED_SQL} as name from customer),
p as materialized (select distinct a.scan_id, a.name, lower(trim(a.name)) as low, b.student, lower(b.student) as clow, b.pos from r a join r b on a.scan_id = b.scan_id),
t as materialized (select scan_id, name, arg_min(student, case when low = clow then 0 else 1000000000000 end + pos) as matched, min(case when low = clow then 1 else 2 end) as tier
  from p where low = clow or contains(low, clow) or contains(clow, low) group by 1, 2),
o as materialized (select p.* from p anti join t using (scan_id, name)),
q as ({S.ratios("select low as a, clow as b from o")})
select scan_id, name, matched, tier::int as tier from t union all
select scan_id, name, arg_max(student, (ratio, -pos)), 3 from o join q on low = a and clow = b where ratio >= 0.6 group by 1, 2"""


@query("join_fuzzy_name_similar", SIMILAR_SQL)
def join_fuzzy_name_similar(spark, sf_dir):
    rows = name_reads(spark, sf_dir)
    reads = rows.select("scan_id", swapped(F.col("student")).alias("name"))
    return match.match_names(reads, rows.select("scan_id", "student", "pos"))


@query("fn_seq_ratio", f"""with n as (select c_custkey, lower(c_name) as a, lower({SWAPPED_SQL}) as b from customer),
q as materialized ({S.ratios("select b as a, a as b from n union all select a, b from n")})
select c_custkey, x.ratio as ratio, y.ratio as reverse_ratio from n join q x on x.a = n.b and x.b = n.a join q y on y.a = n.a and y.b = n.b""")
def fn_seq_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("a"), F.lower(swapped(F.col("c_name"))).alias("b"))
    return rows.select("c_custkey", match.seq_ratio("b", "a").alias("ratio"), match.seq_ratio("a", "b").alias("reverse_ratio"))


FOLDERS_SQL = """select n_regionkey as root, n_name || case when n_nationkey % 2 = 0 then ' Exam' else '' end as dir, n_nationkey::bigint as pos, n_nationkey * 7 % 10 as mtime from nation"""


@query("join_folder_hint", f"""
with d as ({FOLDERS_SQL}), q as (select s_suppkey as request_id, s_nationkey % 5 as root, case s_suppkey % 4 when 0 then ' nation_' || s_nationkey || case when s_nationkey % 2 = 0 then ' EXAM' else '' end
    when 1 then 'my nation_' || s_nationkey || case when s_nationkey % 2 = 0 then ' exam' else '' end || ' folder' when 2 then '####' end as hint,
    case when s_suppkey % 11 = 0 then '/data/' || s_suppkey end as explicit from supplier),
h as (select q.request_id, arg_min(d.dir, case when lower(d.dir) = trim(lower(hint)) then 0 else 1000000000 end + d.pos) as by_hint
  from q join d on q.root = d.root and (lower(d.dir) = trim(lower(hint)) or contains(trim(lower(hint)), lower(d.dir))) group by 1),
x as (select root, arg_max(dir, mtime * 1000 - pos) as newest from d where contains(lower(dir), 'exam') or contains(lower(dir), 'test') group by 1)
select q.root, q.request_id, coalesce(q.explicit, h.by_hint, x.newest) as folder from q left join h using (request_id) left join x on q.root = x.root""")
def join_folder_hint(spark, sf_dir):
    key = F.col("n_nationkey")
    exam = lambda k, word: F.when(k % 2 == 0, word).otherwise("")
    catalogue = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("root"), F.concat("n_name", exam(key, " Exam")).alias("dir"),
        key.cast("bigint").alias("pos"), (key * 7 % 10).alias("mtime"))
    s, nk = F.col("s_suppkey"), F.col("s_nationkey")
    own = F.concat(F.lit("nation_"), nk.cast("string"))
    requests = table(spark, sf_dir, "supplier").select(
        s.alias("request_id"), (nk % 5).alias("root"),
        F.when(s % 4 == 0, F.concat(F.lit(" "), own, exam(nk, " EXAM"))).when(s % 4 == 1, F.concat(F.lit("my "), own, exam(nk, " exam"), F.lit(" folder")))
        .when(s % 4 == 2, "####").alias("hint"),
        F.when(s % 11 == 0, F.concat(F.lit("/data/"), s.cast("string"))).alias("explicit"))
    return match.match_folders(requests, catalogue)


@query("agg_engine_comparison", """
with best as (select conv_id % 20 as scan_id, case turn % 3 when 0 then 'e1' when 1 then 'e2' else 'e3' end as engine, conv_id,
    arg_max(case when turn = 6 then '[e1 error: x]' else 'Student ' || role || (conv_id % 3) || '!' end, length(case when turn = 6 then '[e1 error: x]' else 'Student ' || role || (conv_id % 3) || '!' end) * 1000 - turn) as text,
    sum(length(text)) as ms from conversations group by 1, 2, 3),
m as (select b.*, text like '[%' and (contains(text, 'not installed') or contains(lower(text), 'error:')) as failed,
    exists (select 1 from (values ('user0'), ('user1'), ('system2')) r(n) where contains(lower(text), n)) as hit from best b)
select engine, count(*)::bigint as pages, count(*) filter (not failed and hit)::bigint as matched, count(*) filter (failed)::bigint as failed,
  round(avg(ms), 6) as avg_ms from m group by 1""")
def agg_engine_comparison(spark, sf_dir):
    from gradelake.operators.vote import engine_comparison

    turn, conv = F.col("turn"), F.col("conv_id")
    said = F.concat(F.lit("Student "), "role", (conv % 3).cast("string"), F.lit("!"))
    reads = table(spark, sf_dir, "conversations").select(
        conv.alias("scan_id"), F.lit(1).alias("page"), F.when(turn % 3 == 0, "e1").when(turn % 3 == 1, "e2").otherwise("e3").alias("engine"),
        turn.alias("config"), F.when(turn == 6, "[e1 error: x]").otherwise(said).alias("text"), F.length("text").alias("ms"))
    names = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("student")) for i, n in enumerate(("user0", "user1", "system2"))])
    roster_rows = reads.select("scan_id").distinct().select("scan_id", F.inline(names))
    return engine_comparison(reads, roster_rows).withColumn("avg_ms", F.round("avg_ms", 6))
