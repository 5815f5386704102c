"""Text and number functions bound to parts, line items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import numbers, replies, text
from gradelake.plans import sqlbits as S
from gradelake.plans.registry import query
from gradelake.session import table

# ---- bindings --------------------------------------------------------------------------

STEMS_SQL = """select p_partkey as stem_id, p_name || case p_partkey % 4
    when 0 then ' [' || p_size || ']' when 1 then ' [' || p_size || ' marks]' || chr(10) || 'end'
    when 2 then chr(10) || 'work (' || p_size || ')' || chr(10) || 'out' else '' end
  || case when p_partkey % 5 = 0 then ' [Total: ' || p_size || ']' else '' end
  || case when p_partkey % 7 = 0 then ' [' || (p_size % 9) || '] ' || chr(10) || chr(10) || chr(10) || 'x' else '' end
  as stem from part"""


def stems(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    cue = (F.when(k % 4 == 0, F.concat(F.lit(" ["), n, F.lit("]")))
           .when(k % 4 == 1, F.concat(F.lit(" ["), n, F.lit(" marks]\nend")))
           .when(k % 4 == 2, F.concat(F.lit("\nwork ("), n, F.lit(")\nout"))).otherwise(""))
    total = F.when(k % 5 == 0, F.concat(F.lit(" [Total: "), n, F.lit("]"))).otherwise("")
    more = F.when(k % 7 == 0, F.concat(F.lit(" ["), (F.col("p_size") % 9).cast("string"),
                                       F.lit("] \n\n\nx"))).otherwise("")
    return table(spark, sf_dir, "part").select(
        k.alias("stem_id"), F.concat("p_name", cue, total, more).alias("stem"))


QUESTION_TEXTS_SQL = """select doc_id, case doc_id % 6
    when 1 then 'Calculate the speed.' || chr(10) || text
    when 2 then text || chr(10) || 'A' || chr(10) || lang || chr(10) || ' b ' || chr(10) || source
                || ' × 10–5' || chr(10) || 'C' || chr(10) || chr(10) || 'D' || chr(10) || 'last  one'
                || chr(10) || 'IGCSE Physics: s24' || chr(10) || 'tail'
    when 3 then 'Multiple choice' || chr(10) || text
    when 4 then lang || ' A 1' || chr(10) || ' b 2' else text end as text from documents"""


def question_texts(spark, sf_dir):
    d, t = F.col("doc_id") % 6, F.col("text")
    options = F.concat(t, F.lit("\nA\n"), "lang", F.lit("\n b \n"), "source",
                       F.lit(" × 10–5\nC\n\nD\nlast  one\nIGCSE Physics: s24\ntail"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d == 1, F.concat(F.lit("Calculate the speed.\n"), t)).when(d == 2, options)
        .when(d == 3, F.concat(F.lit("Multiple choice\n"), t))
        .when(d == 4, F.concat("lang", F.lit(" A 1\n b 2"))).otherwise(t).alias("text"))


# ---- marks -----------------------------------------------------------------------------


@query("fn_marks_from_brackets", f"select stem_id, {S.bracket_marks('stem')} as marks from ({STEMS_SQL})")
def fn_marks_from_brackets(spark, sf_dir):
    return stems(spark, sf_dir).select("stem_id", text.bracket_marks(F.col("stem")).alias("marks"))


@query("fn_infer_marks", f"select stem_id, ({S.infer_marks('stem')})::bigint as marks from ({STEMS_SQL})")
def fn_infer_marks(spark, sf_dir):
    return stems(spark, sf_dir).select("stem_id", text.inferred_marks(F.col("stem")).alias("marks"))


@query("fn_strip_mark_indicators", f"select stem_id, {S.strip_marks('stem')} as stem from ({STEMS_SQL})")
def fn_strip_mark_indicators(spark, sf_dir):
    return stems(spark, sf_dir).select("stem_id", text.without_mark_cues(F.col("stem")).alias("stem"))


POWERS_SQL = """select p_partkey as stem_id, '1.5 × 10' || p_size || ' m, 2 x 10–' || (p_size % 7) || ' and '
    || p_name || chr(61620) || '10N. x10 - 3 ' || chr(61614) || chr(61678) || chr(61623) || 'x 10^4 x 10k' as stem from part"""


def powers(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("stem_id"),
        F.concat(F.lit("1.5 × 10"), n.cast("string"), F.lit(" m, 2 x 10–"), (n % 7).cast("string"),
                 F.lit(" and "), "p_name",
                 F.lit("10N. x10 - 3 x 10^4 x 10k")).alias("stem"))


@query("fn_normalize_science_text", f"select stem_id, {S.science('stem')} as stem from ({POWERS_SQL})")
def fn_normalize_science_text(spark, sf_dir):
    return powers(spark, sf_dir).select("stem_id", text.science_text(F.col("stem")).alias("stem"))


# ---- type, answers, options --------------------------------------------------------------


@query("fn_infer_question_type",
       f"select doc_id, {S.question_type('text')} as question_type from ({QUESTION_TEXTS_SQL})")
def fn_infer_question_type(spark, sf_dir):
    return question_texts(spark, sf_dir).select("doc_id", text.question_type(F.col("text")).alias("question_type"))


KEY_TEXTS_SQL = """select doc_id, case doc_id % 6 when 0 then 'b' || chr(10) || text when 1 then '12 c  ' || chr(10) || text
    when 2 then '1 d.' || chr(10) || text when 3 then ' ' when 4 then 'B x' || chr(10) || text else text end as text
  from documents"""


def key_texts(spark, sf_dir):
    d, t = F.col("doc_id") % 6, F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d == 0, F.concat(F.lit("b\n"), t)).when(d == 1, F.concat(F.lit("12 c  \n"), t))
        .when(d == 2, F.concat(F.lit("1 d.\n"), t)).when(d == 3, F.lit(" "))
        .when(d == 4, F.concat(F.lit("B x\n"), t)).otherwise(t).alias("text"))


@query("fn_infer_answer_fields", rf"""
with k as (select doc_id, {S.strip('text')} as body from ({KEY_TEXTS_SQL})),
l as (select doc_id, body, {S.strip(S.lines('body') + '[1]')} as first,
    {S.strip("array_to_string(" + S.lines('body') + "[2:], chr(10))")} as rest from k),
c as (select *, case when regexp_matches(first, '^[A-Da-d]$') then upper(first)
    when regexp_matches(first, '^\d{{1,2}}\s+[A-Da-d]\s*$') then upper(regexp_extract(first, '([A-Da-d])\s*$', 1))
    when length(first) <= 4 and regexp_matches(first, '^[\d\sA-Da-d.]+$') and regexp_matches(first, '\b[A-Da-d]\b')
      then upper(regexp_extract(first, '\b([A-Da-d])\b', 1)) end as letter from l)
select doc_id, case when body <> '' then coalesce(letter, nullif(first, '')) end as correct_answer,
  case when body <> '' then nullif(rest, '') end as marking_criteria from c""")
def fn_infer_answer_fields(spark, sf_dir):
    answer, rest = text.answer_fields(F.col("text"))
    return key_texts(spark, sf_dir).select("doc_id", answer.alias("correct_answer"), rest.alias("marking_criteria"))


OPTION_BODY = S.science(S.strip(
    r"regexp_replace(coalesce(string_agg(case when not regexp_matches(u, '^[A-D]$') then " + S.strip("line")
    + r" end, ' ' order by n), ''), '\s+', ' ', 'g')"))


@query("win_mc_option_split", rf"""
with q as ({QUESTION_TEXTS_SQL}),
l as (select doc_id, unnest({S.lines('text')}) as line, generate_subscripts({S.lines('text')}, 1) as n from q),
m as (select *, upper({S.strip('line')}) as u from l),
s as (select doc_id, min(n) filter (u = 'A') as a, max(n) filter (u = 'B') as b, max(n) filter (u = 'C') as c from m group by 1),
st as (select doc_id, a as start from s where b > a and c > a),
ft as (select doc_id, min(n) as stop from m join st using (doc_id) where n >= start
    and (regexp_matches({S.strip('line')}, '(?i)^IGCSE\s+Physics') or contains(lower(line), 'permission to reproduce')) group by 1),
o as (select doc_id, n, line, u, sum(case when regexp_matches(u, '^[A-D]$') then 1 else 0 end) over (partition by doc_id order by n) as g
    from m join st using (doc_id) left join ft using (doc_id) where n >= start and (stop is null or n < stop)),
b as (select doc_id, g, max(case when regexp_matches(u, '^[A-D]$') then u end) as letter,
    {OPTION_BODY} as body
    from o group by 1, 2),
f as (select doc_id, count(*) as n_options, string_agg(letter || ': ' || body, '  ' order by g) as options
    from b where body <> '' group by 1 having count(*) >= 2)
select q.doc_id, coalesce(n_options, 0)::bigint as n_options, coalesce(options, '') as options,
  case when options is null then q.text else {S.science(S.strip("array_to_string(" + S.lines('q.text') + "[1:start-1], chr(10))"))} end as stem
from q left join f using (doc_id) left join st using (doc_id)""")
def win_mc_option_split(spark, sf_dir):
    df = text.with_options(question_texts(spark, sf_dir), "text", "stem", "opts")
    return df.select("doc_id", F.size("opts").cast("bigint").alias("n_options"),
                     text.options_display(F.col("opts")).alias("options"), "stem")


@query("fn_mc_options_display", """
select p_partkey as stem_id, 'A: ' || p_name || '  B: ' || p_brand || '  C: ' || p_type as shown from part""")
def fn_mc_options_display(spark, sf_dir):
    opts = F.array(*[F.struct(F.lit(x).alias("letter"), F.col(c).alias("text"))
                     for x, c in zip("ABC", ("p_name", "p_brand", "p_type"))])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem_id"),
                                               text.options_display(opts).alias("shown"))


@query("fn_content_summary", rf"""
with d as (select doc_id, {S.strip("string_split(" + S.strip('text') + ", chr(10))[1]")} as line from documents)
select doc_id, case when length(line) > 200 then left(line, 200) || '…' else line end as summary from d""")
def fn_content_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_summary(F.col("text")).alias("summary"))


BULLETS_SQL = r"""select doc_id, regexp_replace(text, '\. ', '.' || chr(10) || '•' || chr(13) || chr(10), 'g')
  || chr(10) || '- ' || chr(10) || chr(10) || '  first ' || chr(10) || '*' || chr(10) || '-' || chr(10) || 'second'
  || chr(10) || '▪' || chr(10) || '• third' as text from documents"""


def bullets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.regexp_replace("text", r"\. ", ".\n•\r\n"),
                 F.lit("\n- \n\n  first \n*\n-\nsecond\n▪\n• third")).alias("text"))


@query("fn_bullet_lines", rf"""
with b as (select doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') as t
  from ({BULLETS_SQL})),
c as (select doc_id, regexp_replace(t, '([•·▪‣])\s*\n([^\S\n]*[^\s•·▪‣])', '\1 \2', 'g') as t from b)
select doc_id, regexp_replace(t, '(^|\n)[^\S\n]*[•·▪‣*○-][^\S\n]*\n(?:[^\S\n]*\n)*[^\S\n]*([^\s•·▪‣*○-](?:[^\n]*[^\s])?|[•·▪‣*○-][^\S\n]*[^\s](?:[^\n]*[^\s])?)[^\S\n]*', '\1• \2', 'g') as shown
from c""")
def fn_bullet_lines(spark, sf_dir):
    return bullets(spark, sf_dir).select("doc_id", text.bullet_lines(F.col("text")).alias("shown"))


# ---- labels ------------------------------------------------------------------------------

MARGINS_SQL = r"""select doc_id, 12.0 * (n - 1) as y0, case n % 5 when 0 then (n % 100)::varchar when 1 then (n % 100) || ' (a) ' || line
    when 2 then (n % 100) || ' ' || line when 3 then (n % 100) || '.' || line else line end as line, n as line_no
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)"""


def margins(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    n = F.col("p").cast("bigint") + 1
    tag = (n % 100).cast("string")
    return lines.select(
        "doc_id", (F.lit(12.0) * (n - 1)).alias("y0"), n.alias("line_no"),
        F.when(n % 5 == 0, tag).when(n % 5 == 1, F.concat(tag, F.lit(" (a) "), "line"))
        .when(n % 5 == 2, F.concat(tag, F.lit(" "), "line")).when(n % 5 == 3, F.concat(tag, F.lit("."), "line"))
        .otherwise(F.col("line")).alias("line"))


@query("fn_question_raw_number", rf"""
with m as (select *, {S.strip('line')} as t from ({MARGINS_SQL})),
r as (select doc_id, line_no, coalesce(nullif(regexp_extract(t, '^(\d{{1,2}})$', 1), ''),
    nullif(regexp_extract(t, '^(\d{{1,2}})\s*\([a-zA-Z]\)', 1), ''),
    case when y0 <= 240.0 then nullif(regexp_extract(t, '^(\d{{1,2}})\s', 1), '') end)::int as raw_number from m)
select doc_id, line_no, raw_number from r where raw_number between 1 and 99""")
def fn_question_raw_number(spark, sf_dir):
    raw = text.question_number(F.col("line"), F.col("y0"), F.lit(240.0))
    return (margins(spark, sf_dir).select("doc_id", "line_no", raw.alias("raw_number"))
            .filter(F.col("raw_number").isNotNull()))


@query("fn_anchor_like", rf"""
with m as (select *, {S.strip('line')} as t from ({MARGINS_SQL}))
select doc_id, count(*) filter (regexp_matches(t, '^\d{{1,2}}$') or regexp_matches(t, '^\d{{1,2}}\s*\([a-zA-Z]\)')
    or regexp_matches(t, '^\d{{1,2}}\s'))::bigint as anchors,
  count(*) filter (regexp_matches(t, '^\d{{1,2}}(\s+|\()'))::bigint as column_numbers from m group by 1""")
def fn_anchor_like(spark, sf_dir):
    line = F.col("line")
    return margins(spark, sf_dir).groupBy("doc_id").agg(
        F.count_if(text.looks_like_anchor(line)).alias("anchors"),
        F.count_if(text.looks_like_column_number(line)).alias("column_numbers"))


@query("fn_root_digits", r"""
select p_partkey as stem_id, regexp_extract(p_size || '_' || p_brand, '^(\d{1,2})', 1) as root_digits from part""")
def fn_root_digits(spark, sf_dir):
    number = F.concat(F.col("p_size").cast("string"), F.lit("_"), "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem_id"),
                                               text.root_digits(number).alias("root_digits"))


@query("fn_safe_stem", r"""
select p_partkey as stem_id, regexp_replace(p_brand || '-' || p_name, '[^\w\-]', '_', 'g') as image_stem,
  translate(p_type || '/' || p_name, ' /', '__') as path_stem from part""")
def fn_safe_stem(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("stem_id"),
        text.safe_stem(F.concat_ws("-", "p_brand", "p_name")).alias("image_stem"),
        text.safe_path_stem(F.concat_ws("/", "p_type", "p_name")).alias("path_stem"))


@query("fn_printed_mc_letters", r"""
with d as (select doc_id, text || chr(10) || 'Question ' || (doc_id % 40) || ' (Answer: b)' || chr(10) || lang ||
    ' question  7_2( answer : D ) Question x (Answer: A)' as t from documents),
e as (select doc_id, unnest(regexp_extract_all(t, '(?i)Question\s+\d+(?:_\d+)?\s*\(\s*Answer\s*:\s*([A-Da-d])\s*\)', 1)) as x,
    generate_subscripts(regexp_extract_all(t, '(?i)Question\s+\d+(?:_\d+)?\s*\(\s*Answer\s*:\s*([A-Da-d])\s*\)', 1), 1) as p from d)
select doc_id, p::bigint as pos, upper(x) as letter from e""")
def fn_printed_mc_letters(spark, sf_dir):
    t = F.concat("text", F.lit("\nQuestion "), (F.col("doc_id") % 40).cast("string"), F.lit(" (Answer: b)\n"), "lang",
                 F.lit(" question  7_2( answer : D ) Question x (Answer: A)"))
    return (table(spark, sf_dir, "documents")
            .select("doc_id", F.posexplode(text.printed_letters(t)).alias("pos", "letter"))
            .select("doc_id", (F.col("pos").cast("bigint") + 1).alias("pos"), "letter"))


# ---- replies and numbers -------------------------------------------------------------------

REPLY_TEXT_SQL = "case l_returnflag when 'A' then 'a' when 'N' then ' B or b' else 'circle around B' end"


def reply_text():
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "a").when(flag == "N", " B or b").otherwise("circle around B")


@query("fn_normalize_mc_answer", f"""
select {S.mc_letter(REPLY_TEXT_SQL)} as letter, l_linestatus as status, count(*)::bigint as n from lineitem group by 1, 2""")
def fn_normalize_mc_answer(spark, sf_dir):
    return (table(spark, sf_dir, "lineitem")
            .groupBy(replies.mc_letter(reply_text()).alias("letter"), F.col("l_linestatus").alias("status"))
            .agg(F.count("*").alias("n")))


@query("fn_normalize_record", f"""
select p_partkey as page_number, {S.mc_letter('p_brand')} as q1, case when p_size % 3 > 0 then {S.mc_letter('p_type')} end as q2,
  case when p_size % 2 = 0 then {S.mc_letter("chr(65 + p_size % 6)")} end as q3 from part""")
def fn_normalize_record(spark, sf_dir):
    size = F.col("p_size")
    records = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_number"), F.col("p_brand").alias("q1"),
        F.when(size % 3 > 0, F.col("p_type")).alias("q2"),
        F.when(size % 2 == 0, F.char(65 + size % 6)).alias("q3"))
    return replies.normalized_record(records, ["q1", "q2", "q3"])


NUMBER_SQL = """select event_id, case event_id % 8 when 0 then value::varchar when 1 then ' ' || event_id || ' ' when 2 then event_type
    when 3 then event_id || 'e3' when 4 then 'nan' when 5 then '-Inf' when 6 then event_id || 'd' else '1_' || event_id end as t from events"""


def number_texts(spark, sf_dir):
    e = F.col("event_id")
    s = e.cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 8 == 0, F.col("value").cast("string")).when(e % 8 == 1, F.concat(F.lit(" "), s, F.lit(" ")))
        .when(e % 8 == 2, F.col("event_type")).when(e % 8 == 3, F.concat(s, F.lit("e3"))).when(e % 8 == 4, "nan")
        .when(e % 8 == 5, "-Inf").when(e % 8 == 6, F.concat(s, F.lit("d"))).otherwise(F.concat(F.lit("1_"), s)).alias("t"))


@query("fn_is_number", rf"""
select event_id, regexp_matches(lower({S.strip('t')}), '^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$') as is_number,
  case when event_id % 8 in (0, 1, 3, 7) then try_cast(replace({S.strip('t')}, '_', '') as double) end as finite_value from ({NUMBER_SQL})""")
def fn_is_number(spark, sf_dir):
    t = F.col("t")
    return number_texts(spark, sf_dir).select(
        "event_id", numbers.is_number(t).alias("is_number"),
        F.when((F.col("event_id") % 8).isin(0, 1, 3, 7), numbers.to_number(t)).alias("finite_value"))


@query("fn_pct_band", f"""
select event_id, {S.band("(event_id % 1000) / 10.0::double")} as band from events""")
def fn_pct_band(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", numbers.pct_band((F.col("event_id") % 1000) / F.lit(10.0)).alias("band"))


@query("fn_format_pct", f"""
with p as (select l_orderkey as student, count(*) as total, count(*) filter (l_returnflag <> 'R') as correct from lineitem group by 1)
select student, printf('%.0f', {S.half_even('100.0::double * correct / total')}) || '%' as acc,
  correct || '/' || total || ' (' || printf('%.0f', {S.half_even('100.0::double * correct / total')}) || '%)' as cell from p""")
def fn_format_pct(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("student")).agg(
        F.count("*").alias("total"), F.count_if(F.col("l_returnflag") != "R").alias("correct"))
    c, t = F.col("correct"), F.col("total")
    return p.select("student", numbers.pct_text(numbers.pct(c, t)).alias("acc"), numbers.score_text(c, t).alias("cell"))


@query("fn_pts_to_px", f"""
select p_partkey as box_id, {S.half_even('(p_retailprice * 300 / 72)')}::bigint as px, round(p_size * (72.0::double / 300), 6) as pt from part""")
def fn_pts_to_px(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("box_id"), numbers.points_to_pixels(F.col("p_retailprice"), 300).alias("px"),
        F.round(numbers.pixels_to_points(F.col("p_size"), 300), 6).alias("pt"))
