"""Requests, files, replies and model calls bound to customers, events, pages and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradelake.functions import replies
from gradelake.operators import providers, request
from gradelake.operators.model_calls import call_once
from gradelake.plans.registry import query
from gradelake.session import shared_folder, table
from gradelake.sources import files, records, store

PHRASES = ("count the marks", "check MC for first 5", " grade multiple choice quick", "skip the scan", "force clean", "reparse, no report",
           "skip clean and Re-Clean fast", "first 0 terminal only")
PROMPT_SQL = ("select c_custkey as request_id, c_mktsegment || ' ' || case c_custkey % 8 "
              + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PHRASES)) + " end as prompt from customer")


def prompts(spark, sf_dir):
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("c_custkey") % 8).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.concat_ws(" ", "c_mktsegment", phrase).alias("prompt"))


HEURISTIC_SQL = rf"""select request_id, task_type, case when n > 0 then 'first_n' else 'all' end as mode, n, dpi, skip and not force as skip_clean_scan, force and not skip as force_clean_scan,
    rescaffold, no_report from (
  select request_id, case when contains(p, 'count') and contains(p, 'mark') then 'count_marks' when contains(p, 'multiple choice') or contains(p, ' mc ') or contains(p, 'check mc') then 'check_mc'
      else 'check_answers' end as task_type, coalesce(try_cast(nullif(regexp_extract(p, 'first\s+(\d+)', 1), '') as int), 0) as n,
    case when contains(p, 'fast') or contains(p, 'quick') then 300 else 400 end as dpi,
    contains(p, 'skip') and (contains(p, 'clean') or contains(p, 'deskew') or contains(p, 'scan')) as skip,
    (contains(p, 'force') and contains(p, 'clean')) or contains(p, 're-clean') or contains(replace(p, ' ', ''), 'reclean') as force,
    contains(p, 'rescaffold') or contains(p, 'reparse') or contains(p, 'rebuild scaffold') as rescaffold, contains(p, 'no report') or contains(p, 'terminal only') as no_report
  from (select request_id, lower(prompt) as p from ({PROMPT_SQL})))"""
HEURISTIC_COLUMNS = ["request_id", "task_type", "mode", "n", "dpi", "skip_clean_scan", "force_clean_scan", "rescaffold", "no_report"]


@query("instruction_heuristic", HEURISTIC_SQL)
def instruction_heuristic(spark, sf_dir):
    return request.keyword_request(prompts(spark, sf_dir)).select(*HEURISTIC_COLUMNS)


@query("instruction_validate", f"""
with h as ({HEURISTIC_SQL})
select request_id, case request_id % 5 when 0 then 'check_mc' when 4 then 'count_marks' else task_type end as task_type,
  case request_id % 5 when 0 then 'specific' when 1 then 'first_n' when 2 then 'all' when 4 then 'all' else mode end as mode,
  case request_id % 5 when 0 then 'Ann,Bob' else '' end as names,
  case request_id % 5 when 1 then 3 when 3 then n else 0 end as n,
  case request_id % 5 when 0 then 600 when 1 then 400 when 2 then 400 when 4 then 200 else dpi end as dpi,
  case when request_id % 5 = 3 then skip_clean_scan else request_id % 5 = 1 end as skip_clean_scan,
  case when request_id % 5 = 3 then force_clean_scan else false end as force_clean_scan,
  case request_id % 5 when 3 then rescaffold when 0 then true else false end as rescaffold,
  case request_id % 5 when 0 then 12 end as through_step,
  case request_id % 5 when 2 then 'spring' end as folder_hint from h""")
def instruction_validate(spark, sf_dir):
    k = F.col("request_id") % 5
    raw = (F.when(k == 0, '{"task_type": "check_mc", "student_filter": {"mode": "Specific", "names": ["Ann", null, "Bob"], "n": 4}, "dpi": "600", "rescaffold": true, "through_step": 12}')
           .when(k == 1, 'ok {"student_filter": {"mode": "first-n", "n": "3"}, "dpi": null, "skip_clean_scan": true, "through_step": 19} bye')
           .when(k == 2, '{"student_filter": {"mode": "some"}, "dpi": "high", "folder_hint": " spring ", "skip_clean_scan": true, "force_clean_scan": true}')
           .when(k == 3, "no json").otherwise('{"task_type": "count_marks", "student_filter": {"mode": "first_n", "n": 0}, "dpi": 200, "folder_hint": ""'))
    rows = request.keyword_request(prompts(spark, sf_dir).withColumn("raw", raw))
    out = request.validated_request(rows)
    return out.select("request_id", "task_type", "mode", F.array_join("names", ",").alias("names"), "n", "dpi", "skip_clean_scan", "force_clean_scan",
                      "rescaffold", "through_step", "folder_hint")


@query("instruction_merge_flags", f"""
select request_id, skip_clean_scan, force_clean_scan, rescaffold, no_report, through_step from (
  select request_id, skip_clean_scan or request_id % 6 = 0 as skip_clean_scan, force_clean_scan, rescaffold or request_id % 9 = 0 as rescaffold, no_report,
    case when request_id % 4 = 0 then 7 when request_id % 3 = 0 then 11 end as through_step from ({HEURISTIC_SQL}))
where not (skip_clean_scan and force_clean_scan)""")
def instruction_merge_flags(spark, sf_dir):
    k = F.col("request_id")
    rows = request.keyword_request(prompts(spark, sf_dir)).withColumns({
        "through_step": F.when(k % 3 == 0, 11), "cli_skip_clean_scan": k % 6 == 0, "cli_force_clean_scan": F.lit(False),
        "cli_rescaffold": k % 9 == 0, "cli_no_report": F.lit(False), "cli_through_step": F.when(k % 4 == 0, 7)})
    accepted, _rejected = request.merged_flags(rows)
    return accepted.select("request_id", *request.SWITCHES, "through_step")


@query("project_cache_valid", """
with s as (select o_custkey as exam_id, max(o_orderdate) as newest from orders where o_orderstatus <> 'P' group by 1),
c as (select o_custkey as exam_id, max(o_orderdate) as cached from orders where o_orderstatus = 'P' group by 1)
select exam_id, newest <= cached as fresh from s join c using (exam_id)""")
def project_cache_valid(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("exam_id"), "o_orderstatus", F.col("o_orderdate").alias("mtime"))
    caches = o.filter(F.col("o_orderstatus") == "P").groupBy("exam_id").agg(F.max("mtime").alias("mtime"))
    return request.fresh_caches(o.filter(F.col("o_orderstatus") != "P"), caches, "exam_id").select("exam_id", "fresh")


REFRESH_SQL = """
with o as (select o_custkey as exam_id, o_orderdate as t, o_orderstatus as st, o_totalprice as price from orders),
s as (select exam_id, max(t) as newest from o group by 1), c as (select exam_id, max(t) as cached from o where st = 'P' group by 1)
select s.exam_id, coalesce(newest > cached, true) as rebuilt, count(*)::bigint as n, round(max(price), 2) as best
from s left join c using (exam_id) join o on o.exam_id = s.exam_id and (coalesce(newest > cached, true) or o.st = 'P') group by 1, 2"""


@query("project_cache_refresh", REFRESH_SQL)
def project_cache_refresh(spark, sf_dir):
    """Exams summed up as of their last open order, then those with newer orders built anew from all of theirs; the others keep what is stored."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("exam_id"), F.col("o_orderdate").alias("mtime"), "o_orderstatus", "o_totalprice")
    built = lambda df: df.groupBy("exam_id").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("best"), F.max("mtime").alias("mtime"))
    folder = f"{shared_folder(spark)}/exams-{uuid.uuid4().hex}"
    store.replace(built(rows.filter(F.col("o_orderstatus") == "P")), folder, ["exam_id"], 1)
    found = request.refreshed(rows, folder, "exam_id", built, 1)
    return found.select("exam_id", "rebuilt", "n", "best")


# ---- choice of files -----------------------------------------------------------------------------

FILES_SQL = """select o_custkey as folder, o_orderkey as id, o_orderdate as mtime, case o_orderkey % 9 when 0 then 'Ground Truth' when 1 then 'answers.txt' when 2 then 'Raw Exam 4UP.pdf'
    when 3 then 'raw exam 4up.pdf' when 4 then 'scan ' || (o_orderkey % 5 * 100) || '.pdf' when 5 then 'exam answers.pdf' when 6 then 'StudentList.xlsx' when 7 then 'exam.pdf' else 'b.xlsx' end as name from orders"""


def file_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    names = ["Ground Truth", "answers.txt", "Raw Exam 4UP.pdf", "raw exam 4up.pdf", None, "exam answers.pdf", "StudentList.xlsx", "exam.pdf", "b.xlsx"]
    scan = F.concat(F.lit("scan "), (k % 5 * 100).cast("string"), F.lit(".pdf"))
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), (k % 9).cast("int")), scan)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), k.alias("id"), F.col("o_orderdate").alias("mtime"), name.alias("name"))


def _pick(rule: str, rank: str) -> str:
    return f"""select folder, '{rule}' as rule, arg_min(name, (r, lower(name), name)) as name from (select folder, name, {rank} as r from f) where r is not null group by 1"""


@query("src_pick_preferred_file", f"""
with f as ({FILES_SQL})
{_pick('truth', "case name when 'Ground Truth' then 4 when 'answers.txt' then 6 end")}
union all {_pick('roster', "case when name like '%.xlsx' then case when contains(lower(name), 'student') then 0 else 1 end end")}
union all {_pick('scan', "case when contains(lower(name), 'scan') then case when contains(name, '300') then 0 else 1 end end")}
union all {_pick('four_up', "case when name = 'raw exam 4up.pdf' then 0 when contains(lower(name), '4up') then 1 end")}
union all {_pick('exam', "case when name = 'raw exam 4up.pdf' then 0 when contains(lower(name), '4up') then 1 when name = 'exam.pdf' then 2 end")}
union all select folder, 'newest', arg_max(name, (mtime, name)) from f group by 1""")
def src_pick_preferred_file(spark, sf_dir):
    rows = file_rows(spark, sf_dir)
    ranks = {"truth": files.truth_rank(), "roster": files.keyword_rank("student", ".xlsx"), "scan": files.scan_rank(300),
             "four_up": files.four_up_rank(), "exam": files.exam_rank()}
    out = files.newest(rows).select("folder", F.lit("newest").alias("rule"), "name")
    for rule, rank in ranks.items():
        out = out.unionByName(files.preferred(rows, rank).select("folder", F.lit(rule).alias("rule"), "name"))
    return out


@query("top1_argmax", """select user_id as page, arg_max(event_type, (value, -event_id)) as best, max(value) as score, arg_min(event_id, (ts, event_id)) as first_event from events group by 1""")
def top1_argmax(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(
        F.max_by("event_type", F.struct("value", -F.col("event_id"))).alias("best"), F.max("value").alias("score"),
        F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("sink_results_incremental", """
with done as (select o_custkey as page_number, arg_max(o_orderstatus, o_orderkey) as answer from orders where o_custkey % 3 > 0 group by 1),
new as (select c_custkey as page_number, left(c_mktsegment, 1) as answer from customer)
select page_number, answer from done union all select page_number, answer from new where page_number not in (select page_number from done)""")
def sink_results_incremental(spark, sf_dir):
    k = F.col("o_custkey")
    done = table(spark, sf_dir, "orders").select(F.when(k % 3 > 0, k).alias("page_number"), F.col("o_orderstatus").alias("answer"), F.col("o_orderkey").alias("pos"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_number"), F.left("c_mktsegment", F.lit(1)).alias("answer"), F.lit(0).cast("bigint").alias("pos"))
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    files.resume(done, folder)
    files.resume(new, folder)
    return files.resume(new.withColumn("answer", F.lit("late")), folder).select("page_number", "answer")


# ---- replies --------------------------------------------------------------------------------------


def damaged(spark, sf_dir):
    """Event properties intact, inside prose, without the last brace, and cut inside the key."""
    k, p = F.col("event_id") % 4, F.col("props")
    raw = (F.when(k == 0, p).when(k == 1, F.concat(F.lit("Sure, here: "), p, F.lit(" done"))).when(k == 2, F.left(p, F.length(p) - 1)).otherwise(F.left(p, F.lit(3))))
    return table(spark, sf_dir, "events").select("event_id", "user_id", raw.alias("raw"))


DAMAGED_SQL = r"""select event_id, case when event_id % 4 < 3 then regexp_extract(props, '(\d+)', 1)::bigint end as k, event_id % 4 < 3 as parsed from events"""


@query("fn_parse_json_safe", f"select event_id, k from ({DAMAGED_SQL})")
def fn_parse_json_safe(spark, sf_dir):
    value = F.get_json_object(replies.salvaged_object(F.col("raw")), "$.k").cast("bigint")
    return damaged(spark, sf_dir).select("event_id", value.alias("k"))


@query("fn_extract_json_partial", f"select event_id, k, parsed from ({DAMAGED_SQL})")
def fn_extract_json_partial(spark, sf_dir):
    rows = damaged(spark, sf_dir).withColumn("t", replies.salvaged_json(F.col("raw")))
    return rows.select("event_id", F.get_json_object("t", "$.k").cast("bigint").alias("k"), F.col("t").isNotNull().alias("parsed"))


EVENT_PROFILE = records.Profile("events", ("k",))


@query("src_extraction_records", f"""select event_id, parsed, null::varchar as student_name, null::varchar as student_name_confidence, k::varchar as k, null::varchar as k_confidence,
  null::varchar as confidence from ({DAMAGED_SQL})""")
def src_extraction_records(spark, sf_dir):
    return records.read_records(damaged(spark, sf_dir).drop("user_id"), EVENT_PROFILE)


@query("fn_failed_record", """select event_id, case when event_id % 4 = 3 then 'EXTRACTION_ERROR' end as student_name, case when event_id % 4 = 3 then 'failed' end as student_name_confidence,
  case when event_id % 4 = 3 then 'failed' end as confidence, case when event_id % 4 = 3 then case when event_id % 8 = 3 then 'unknown' else event_type end end as error,
  case when event_id % 4 = 3 then '?' else 'A' end as q1, case when event_id % 4 = 3 then 'failed' end as q1_confidence from events""")
def fn_failed_record(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("A").alias("q1"), F.when(e % 8 != 3, F.col("event_type")).alias("why"))
    out = replies.with_failed_record(rows, e % 4 != 3, ["q1"], F.col("why")).drop("why")
    return out


@query("mdl_batch_call", """select event_id, 'k=' || props as raw, case when event_id % 5 = 0 then 2 else 1 end as attempts, null::varchar as error from events where event_id % 35 > 0
  union all select event_id, '', 3, 'down' from events where event_id % 35 = 0""")
def mdl_batch_call(spark, sf_dir):
    def factory():
        seen = set()

        def reply(row):
            # Fails for good on every 35th row and once on every other 5th row.
            if row["event_id"] % 35 == 0:
                raise RuntimeError("down")
            if row["event_id"] % 5 == 0 and row["event_id"] not in seen:
                seen.add(row["event_id"])
                raise RuntimeError("busy")
            return "k=" + row["props"]

        return reply

    rows = table(spark, sf_dir, "events").select("event_id", "props")
    folder = f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}"
    big = {"asked_by_task": 4096, "tasks": 8}
    call_once(rows, factory, ["event_id", "props"], folder, pauses=(0.0, 0.0), **big)

    def down():
        def reply(row):
            raise RuntimeError("down")

        return reply

    # The second run asks only what failed, and fails again.
    return call_once(rows, down, ["event_id", "props"], folder, pauses=(0.0, 0.0), **big).drop("props")


# ---- providers: two stub models read every event, the second one differs on every third ---------------------

STUBS = records.Profile("stubs", ("q1", "q2"))


def _stub(model: str):
    def reply(row):
        shift = 1 if model.startswith("other") and row["event_id"] % 3 == 0 else 0
        if row["event_id"] % 10 == 9 and not shift:
            return "no reading"
        name = row["event_type"] if row["event_id"] % 4 else "UNKNOWN"
        return f'{{"student_name": "{name}", "q1": "{"ABCD"[(row["event_id"] + shift) % 4]}", "q2": "{"AB"[row["event_id"] % 2]}", "confidence": "{"low" if shift else "high"}"}}'

    return reply


providers.register(providers.Provider("stub", ("stub-",), _stub))
providers.register(providers.Provider("other", ("", "other-"), _stub))

STUB_SQL = """select event_id as page, event_id % 3 = 0 as shifted, event_id % 10 = 9 as bad, case when event_id % 4 > 0 then event_type else 'UNKNOWN' end as name,
  chr((65 + event_id % 4)::int) as q1, chr((65 + (event_id + 1) % 4)::int) as q1b, chr((65 + event_id % 2)::int) as q2 from events"""


@query("mdl_extract_provider", f"""select page, case when bad then 'EXTRACTION_ERROR' else name end as student_name, case when bad then '?' else q1 end as q1, case when bad then '?' else q2 end as q2,
  case when bad then 'failed' else 'high' end as confidence from ({STUB_SQL})""")
def mdl_extract_provider(spark, sf_dir):
    """One model, chosen by the prefix of its name, without a vote."""
    return stub_records(spark, sf_dir, voting=False)


@query("mdl_extract_ensemble", f"""select page, case when name = 'UNKNOWN' and bad then 'EXTRACTION_ERROR' when bad and not shifted then 'EXTRACTION_ERROR' else name end as student_name,
  case when bad then '?' else q1 end as q1, case when bad then '?' else q2 end as q2, case when bad then 'failed' else 'high' end as confidence from ({STUB_SQL})""")
def mdl_extract_ensemble(spark, sf_dir):
    """Both models with a vote; where they differ the first reading counts, and a name that one of them read wins over none."""
    return stub_records(spark, sf_dir, voting=True)


def stub_records(spark, sf_dir, voting):
    pages = table(spark, sf_dir, "events").select(F.col("event_id").alias("page"), "event_id", "event_type")
    folder = f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}"
    found = providers.extract(pages, ["stub-1", "other-2"], STUBS, ["event_id", "event_type"], folder, voting=voting, pauses=(), asked_by_task=8192, tasks=8)
    return found.select("page", "student_name", "q1", "q2", "confidence")
