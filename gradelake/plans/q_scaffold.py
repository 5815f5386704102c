"""Whole exams bound to documents: from lines to the stored form and back, with the answer key of the same number.

A key is printed like its exam; its blocks have a row of the answer table, and every fourth line names a letter.
The twins put the steps of :mod:`q_layout` together in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import build, figures, layout, scaffold, tree
from gradelake.plans import sqlbits as S
from gradelake.plans.q_layout import (
    CELLS_SQL, CLIP_LINES_SQL, CLIPS_SQL, DRAWN_SQL, LINES_SQL, PAGES_SQL, PARTS_SQL, SEGMENTS_SQL, SLICES_SQL, TIGHT_ENDS_SQL, clip, drawings, pages, printed, with_spans,
)
from gradelake.plans.registry import query
from gradelake.session import staged

NL = "chr(10)"


def _tight(sql: str) -> str:
    """The same steps over regions whose last one of a cell is tightened."""
    ends = f"{TIGHT_ENDS_SQL} select seg.* exclude (y_end), coalesce(en.y, seg.y_end) as y_end from seg left join en on seg.exam_id = en.exam_id and seg.qid = en.qid"
    return sql.replace(f"({SEGMENTS_SQL})", f"({ends})")


TEXTS_SQL = f"""select exam_id, qid, {S.strip(f"string_agg(text, {NL} order by page, y0, x0, block, line)")} as text from ({_tight(CLIP_LINES_SQL)}) group by 1, 2"""

# Nodes as split, and their boxes as placed: x from the cell, then snaps, then tops of leaves.
TREE_SQL = rf"""
with sg as ({_tight(CLIPS_SQL)}),
rt as (select sg.*, coalesce(t.text, '') as text from sg left join ({TEXTS_SQL}) t using (exam_id, qid)),
ty as (select *, {S.question_type('text')} as question_type, {S.infer_marks('text')} as own from rt),
sl as (select s.* from ({_tight(SLICES_SQL)}) s join ty using (exam_id, qid) where ty.question_type <> 'multiple_choice'),
pr as (select p.*, ty.seg_no from ({_tight(PARTS_SQL)}) p join ty using (exam_id, qid) where ty.question_type <> 'multiple_choice'),
nd as (
  select exam_id, qid, page, [seg_no]::bigint[] as path, qid as number, question_type, own, x0, y0, x1, y1,
    case when split then coalesce((select text from sl where sl.exam_id = q.exam_id and sl.qid = q.qid and slice_no = 0), '') else text end as text,
    case when split then try_cast(nullif(regexp_extract(text, '(?i)\[Total:\s*(\d+)\s*\]', 1), '') as bigint) end as total
  from (select *, cx0 as x0, by0 as y0, cx1 as x1, by1 as y1, (exam_id, qid) in (select (exam_id, qid) from pr) as split from ty) q
  union all
  select exam_id, qid, page, case when below then [seg_no, p_slice, slice_no] else [seg_no, slice_no] end::bigint[], number, {S.question_type('text')}, {S.infer_marks('text')},
    x0, y0, x1, ny1, text, null from pr),
up as (select exam_id, path[1:len(path) - 1] as path, count(*) as n from nd where len(path) > 1 group by 1, 2),
lf as (select nd.*, up.n is null as is_leaf from nd left join up on nd.exam_id = up.exam_id and nd.path = up.path),
sm as (select a.exam_id, a.path, sum(b.own) as s from lf a join lf b on a.exam_id = b.exam_id and a.qid = b.qid and b.is_leaf and len(b.path) > len(a.path) and b.path[1:len(a.path)] = a.path group by 1, 2),
mk as (select lf.* exclude (text, x0, x1), x0 as sx0, x1 as sx1, {S.science(f"case when {S.strip('text')} = '' then text else {S.strip_marks('text')} end")} as text,
    (case when is_leaf then own else coalesce(total, s) end)::bigint as marks, (x0 + x1) * 0.5 as px, (y0 + y1) * 0.5 as py from lf left join sm on lf.exam_id = sm.exam_id and lf.path = sm.path),
ce as (select mk.exam_id, mk.path, arg_min({{'a': cx0, 'b': cy0, 'c': cx1, 'd': cy1}}, cell_no) as c from mk join ({CELLS_SQL}) c on mk.exam_id = c.exam_id and mk.page = c.page
  where px >= cx0 and px < cx1 and py >= cy0 and py < cy1 group by 1, 2),
pl as (select mk.*, coalesce(c.a, 0.0::double) as cx0, coalesce(c.b, 0.0::double) as cy0, coalesce(c.c, w) as cx1, coalesce(c.d, h) as cy1 from mk
  join ({PAGES_SQL}) g on mk.exam_id = g.exam_id and mk.page = g.page left join ce on mk.exam_id = ce.exam_id and mk.path = ce.path),
sn as (select pl.* exclude (y0, y1), pl.y0 as split_y0, pl.y1 as split_y1, case when len(pl.path) > 1 then pl.cx0 else sx0 end as x0, case when len(pl.path) > 1 then pl.cx1 else sx1 end as x1,
    case when snap_top and pl.path = min(case when is_leaf then pl.path end) over q then sg.cy0 else pl.y0 end as y0,
    case when snap_bottom and pl.path = max(case when is_leaf then pl.path end) over q then sg.cy1 else pl.y1 end as y1
  from pl join sg on pl.exam_id = sg.exam_id and pl.qid = sg.qid window q as (partition by pl.exam_id, pl.qid)),
rk as (select *, case when is_leaf then row_number() over (partition by exam_id, page, cx0, cy0, cx1, cy1, is_leaf order by y0, x0, path) else 1 end as r from sn),
tp as (select rk.exam_id, rk.path, max(l.y1) as last from rk join (select *, {S.strip('text')} as t from ({LINES_SQL})) l on rk.exam_id = l.exam_id and rk.page = l.page
  where r > 1 and l.x0 < l.x1 and l.y0 < l.y1 and l.x0 < rk.cx1 and rk.cx0 < l.x1 and l.y0 < rk.y0 and rk.cy0 < l.y1 and rk.cx0 < rk.cx1 and rk.cy0 < rk.y0 and l.y1 <= rk.y0
    and t <> '' and not regexp_matches(t, '(?i)^\[Total:') and not regexp_matches(t, '(?i)IGCSE\s+Physics') group by 1, 2)
select rk.* exclude (y0), case when r > 1 and greatest(coalesce(last, cy0), cy0) + 2 < y0 then greatest(coalesce(last, cy0), cy0) + 2 else y0 end as y0
from rk left join tp on rk.exam_id = tp.exam_id and rk.path = tp.path"""
PATH = "array_to_string(path, '.')"
BOX_SQL = ", ".join(f"round({c}, 6) as {c}" for c in layout.BOX)


def path_text():
    return F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("node")


def rounded_box():
    return [F.round(c, 6).alias(c) for c in layout.BOX]


def exam_nodes(spark, sf_dir, lined=None):
    lined = printed(spark, sf_dir) if lined is None else lined
    return build.questions(lined, pages(lined), drawings(spark, sf_dir, lined))


@query("win_split_subquestions", f"select exam_id, qid, {PATH} as node, number, is_leaf, marks, text, round(split_y0, 6) as y0, round(split_y1, 6) as y1 from ({TREE_SQL})")
def win_split_subquestions(spark, sf_dir):
    lined = printed(spark, sf_dir)
    _cells, _segs, nodes = build.split_tree(lined, pages(lined), drawings(spark, sf_dir, lined))
    return nodes.select("exam_id", "qid", path_text(), "number", "is_leaf", "marks", "text", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query("geo_build_questions", f"select exam_id, number, question_type, text, marks, page, {BOX_SQL} from ({TREE_SQL})")
def geo_build_questions(spark, sf_dir):
    return exam_nodes(spark, sf_dir).select("exam_id", "number", "question_type", "text", "marks", "page", *rounded_box())


# Blanks: lines of at least half their area within a written leaf, cut at '=' and '['.
BLANKS_SQL = rf"""
with tr as ({TREE_SQL}), n as (select * from tr where is_leaf and question_type <> 'multiple_choice'),
i as (select n.exam_id, n.page, n.path, n.y0 as ny0, n.y1 as ny1, cx0, cx1, cy1, l.x0, l.y0, l.x1, l.y1, l.text, {S.strip('l.text')} as t from n join ({LINES_SQL}) l on n.exam_id = l.exam_id and n.page = l.page
  where l.x0 < l.x1 and l.y0 < l.y1 and cx0 < cx1 and n.y0 < n.y1 and l.x0 < cx1 and cx0 < l.x1 and l.y0 < n.y1 and n.y0 < l.y1
    and greatest(least(l.x1, cx1) - greatest(l.x0, cx0), 0) * greatest(least(l.y1, n.y1) - greatest(l.y0, n.y0), 0) >= 0.5),
b as (select *, instr(t, '=') + length(substr(t, instr(t, '=') + 1)) - length(ltrim(substr(t, instr(t, '=') + 1))) as s, length(t) - instr(reverse(t), '[') as e
  from i where regexp_matches(t, '=\s*[\s.·•\-_]{{3,}}\s*\[\s*\d+\s*\]')),
m as (select b.*, (select min(o.y0) from i o where o.exam_id = b.exam_id and o.path = b.path and o.t <> '' and o.y0 > b.y1) as below from b where e > s),
z as (select exam_id, page, path, y0 as line_y0, greatest(coalesce(nullif(case when s < length(text) then x0 + (x1 - x0) * s / length(text) end, 0), x0), cx0) as x0, greatest(y0 - 30 + 5, ny0) as y0,
    least(coalesce(nullif(case when e < length(text) then x0 + (x1 - x0) * e / length(text) end, 0), x1), cx1) as x1,
    least(coalesce(below - 2, case when cy1 - y1 <= 40 then y1 + 25 else least(ny1, y1 + 25) end) + 5, ny1) as y1 from m)
select * from z where x1 > x0 and y1 > y0 + 2"""


@query("win_equation_blank", f"select exam_id, page, {PATH} as node, {BOX_SQL} from ({BLANKS_SQL})")
def win_equation_blank(spark, sf_dir):
    lined = printed(spark, sf_dir)
    found = figures.answer_blanks(exam_nodes(spark, sf_dir, lined), with_spans(lined), ["exam_id", "page", "path"])
    return found.select("exam_id", "page", path_text(), *rounded_box())


def figures_sql(clips: str) -> str:
    """Images of every clip, else its largest compact drawing with its labels: ``exam_id, page, qid, seg_no, kind, figure_no`` and box."""
    return rf"""
with k as (select exam_id, page, qid, seg_no, cx0 as kx0, by0 as ky0, cx1 as kx1, by1 as ky1 from ({clips})),
cut as (select k.*, kind, b.y0 as oy0, b.x0 as ox0, greatest(b.x0, kx0) as x0, greatest(b.y0, ky0) as y0, least(b.x1, kx1) as x1, least(b.y1, ky1) as y1 from k join ({DRAWN_SQL}) b using (exam_id, page)
  where b.x0 < b.x1 and b.y0 < b.y1 and ky0 < ky1 and b.x0 < kx1 and kx0 < b.x1 and b.y0 < ky1 and ky0 < b.y1),
big as (select exam_id, page, qid, seg_no, kx0, ky0, kx1, ky1, max({{'a': (x1 - x0) * (y1 - y0), 'b': -y0, 'c': -x0, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) as m from cut
  where kind = 'vector' and least(x1 - x0, y1 - y0) >= 20 and (x1 - x0) * (y1 - y0) >= 400 and greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) <= 6
    and (exam_id, page, qid) not in (select (exam_id, page, qid) from cut where kind = 'raster') group by all),
bst as (select * exclude (m), m.x0 as x0, m.y0 as y0, m.x1 as x1, m.y1 as y1 from big),
lab as (select s.exam_id, s.qid, min(l.x0) as lx0, min(l.y0) as ly0, max(l.x1) as lx1, max(l.y1) as ly1
  from (select *, greatest(kx0, x0 - 32) as sx0, greatest(ky0, y0 - 10) as sy0, least(kx1, x1 + 32) as sx1, least(ky1, y1 + 10) as sy1 from bst) s
  join (select *, {S.strip('text')} as t from ({LINES_SQL})) l on s.exam_id = l.exam_id and s.page = l.page
  where l.x0 < l.x1 and l.y0 < l.y1 and l.x0 < sx1 and sx0 < l.x1 and l.y0 < sy1 and sy0 < l.y1 and t <> '' and length(t) <= 56 and not regexp_matches(t, '(?i)^Fig(?:\.|ure)?\b') group by 1, 2),
fnd as (select exam_id, page, qid, seg_no, kx0, ky0, kx1, ky1, kind, oy0, ox0, x0, y0, x1, y1 from cut where kind = 'raster'
  union all select exam_id, page, qid, seg_no, kx0, ky0, kx1, ky1, 'vector', y0, x0, least(x0, coalesce(lx0, x0)), least(y0, coalesce(ly0, y0)), greatest(x1, coalesce(lx1, x1)), greatest(y1, coalesce(ly1, y1))
    from bst left join lab using (exam_id, qid)),
pad as (select exam_id, page, qid, seg_no, kind, oy0, ox0, greatest(0, x0 - 5, kx0) as x0, greatest(0, y0 - 5, ky0) as y0, least(w, x1 + 5, kx1) as x1, least(h, y1 + 5, ky1) as y1
  from fnd join ({PAGES_SQL}) using (exam_id, page))
select *, row_number() over (partition by exam_id, page, qid order by oy0, ox0, x1, y1) as figure_no from pad where x0 < x1 and y0 < y1"""


@query("agg_largest_figure", f"select exam_id, qid, {BOX_SQL} from ({figures_sql(CLIPS_SQL)}) where kind = 'vector'")
def agg_largest_figure(spark, sf_dir):
    lined, paged, _cells, segs, _clip = clip(spark, sf_dir)
    found = build.question_figures(segs, drawings(spark, sf_dir, lined), lined, paged).filter(F.col("kind") == "vector")
    return found.select("exam_id", "qid", *rounded_box())


# Figures numbered over the exam, as wide as their cell, at the deepest node that spans their centre, and snapped to that node's cell.
IMAGES_SQL = f"""
with fg as (select *, row_number() over (partition by exam_id order by page, seg_no, figure_no) as image_no from ({figures_sql(_tight(CLIPS_SQL))})),
tr as ({TREE_SQL}),
ce as (select f.exam_id, image_no, arg_min(cx0, cell_no) as a, arg_min(cx1, cell_no) as b from fg f join ({CELLS_SQL}) c on f.exam_id = c.exam_id and f.page = c.page
  where (x0 + x1) * 0.5 >= cx0 and (x0 + x1) * 0.5 < cx1 and (y0 + y1) * 0.5 >= cy0 and (y0 + y1) * 0.5 < cy1 group by 1, 2),
im as (select f.* exclude (x0, x1), coalesce(a, 0.0::double) as x0, coalesce(b, w) as x1 from fg f join ({PAGES_SQL}) p on f.exam_id = p.exam_id and f.page = p.page
  left join ce on f.exam_id = ce.exam_id and f.image_no = ce.image_no),
nd as (select a.exam_id, a.qid, a.path, a.page, a.split_y0, a.split_y1 from tr a where not exists (
  select 1 from tr b where b.exam_id = a.exam_id and b.qid = a.qid and len(b.path) < len(a.path) and a.path[1:len(b.path)] = b.path and b.page <> a.page)),
hit as (select i.exam_id, i.image_no, arg_min(n.path, (-len(n.path), n.path)) as path from im i join nd n on i.exam_id = n.exam_id and i.qid = n.qid and i.page = n.page
  where (i.y0 + i.y1) / 2 between n.split_y0 - 1 and n.split_y1 + 1 group by 1, 2),
own as (select i.*, coalesce(hit.path, r.path) as path from im i join tr r on i.exam_id = r.exam_id and i.qid = r.qid and len(r.path) = 1
  left join hit on i.exam_id = hit.exam_id and i.image_no = hit.image_no),
mt as (select own.*, n.cy0, n.cy1, n.cy0 + 10.0::double * ((n.cy1 - n.cy0) / 841.89::double) as m_top from own join tr n on own.exam_id = n.exam_id and own.path = n.path)
select exam_id, qid, page, path, image_no, 'scaffold_images/q' || regexp_replace(qid, '[^\\w\\-]', '_', 'g') || '_p' || page || '_' || image_no || '.png' as file,
  x0, case when y0 <= m_top + 20 then cy0 else y0 end as y0, x1, case when y1 >= cy1 - 24 then cy1 else y1 end as y1 from mt"""


def exam_images(spark, sf_dir):
    lined = printed(spark, sf_dir)
    paged, drawn = pages(lined), drawings(spark, sf_dir, lined)
    cells, segs, split = build.split_tree(lined, paged, drawn)
    return staged(split, "split"), scaffold.question_images(segs, cells, drawn, lined, paged), (lined, paged, cells, segs)


@query("join_asset_to_deepest", f"select exam_id, qid, {PATH} as node, file from ({IMAGES_SQL})")
def join_asset_to_deepest(spark, sf_dir):
    split, images, _parts = exam_images(spark, sf_dir)
    return figures.assets_to_nodes(images, split).select("exam_id", "qid", path_text(), "file")


# ---- answer keys ---------------------------------------------------------------------------------

KEY_PAGE_SQL = LINES_SQL.replace("when 8 then '[Total: 9]'", f"""when 2 then 'Question ' || (n // 10) || ' (Answer: ' || chr((65 + (n // 10) % 4)::int) || ')' when 4 then ((n // 10) % 12 + 1) || '(a)' when 8 then 'IGCSE Total'""")


def key_lines(lined):
    n = F.col("line")
    block = F.floor(n / 10)
    text = (F.when(n % 10 == 2, F.format_string("Question %d (Answer: %s)", block, F.char(65 + block % 4)))
            .when(n % 10 == 4, F.concat((block % 12 + 1).cast("string"), F.lit("(a)"))).when(n % 10 == 8, "IGCSE Total").otherwise(F.col("text")))
    return lined.withColumn("text", text).withColumn("x1", F.col("x0") + F.least(F.length("text") * 5.0, F.lit(400.0)))


_ANSWER, _REST = S.answer_fields("t")


def margin_sql(texts: str) -> str:
    return f"select exam_id, qid as number, {_ANSWER} as answer, {_REST} as criteria from (select exam_id, qid, {S.science('text')} as t from ({texts}))"


def on_key(sql: str) -> str:
    """The same steps over the pages of the key; they hold no drawings."""
    return sql.replace(f"({LINES_SQL})", f"({KEY_PAGE_SQL})").replace("from part)", "from part where false)")


TABLE_SQL = rf"""
with l as (select exam_id, page, block, line, {S.strip('text')} as t, row_number() over (partition by exam_id order by page, block, line) as no from ({KEY_PAGE_SQL})),
k as (select *, case when regexp_matches(t, '(?i)^\d+\(c\)\(i{{1,3}}\)\s*$') or regexp_matches(t, '(?i)^\d+\([a-z]\)\s*$') then regexp_replace(lower(t), '[()\s]', '', 'g') end as label,
  t like 'IGCSE %' or regexp_matches(t, '(?i)^Answers\s+Q') or regexp_matches(t, '(?i)^Question\s+\d+\s*\(\s*Answer\s*:') as stop from l),
g as (select *, sum(case when label is not null or stop then 1 else 0 end) over (partition by exam_id order by no) as row_no from k),
r as (select exam_id, row_no, max(label) as number, {S.science(S.strip("coalesce(string_agg(t, chr(10) order by no) filter (label is null), '')"))} as body from g group by 1, 2 having max(label) is not null)
select exam_id, number, arg_max(body, row_no) as body from r where body <> '' group by 1, 2"""
LETTERS_SQL = rf"""select exam_id, row_number() over (partition by exam_id order by page, block, line) as pos, upper(regexp_extract(text, '(?i)Question\s+\d+(?:_\d+)?\s*\(\s*Answer\s*:\s*([A-Da-d])\s*\)', 1)) as letter
  from ({KEY_PAGE_SQL}) where regexp_matches(text, '(?i)Question\s+\d+(?:_\d+)?\s*\(\s*Answer\s*:\s*[A-Da-d]\s*\)')"""


@query("geo_parse_answer_key", f"""select 'margin' as source, exam_id, number, answer, criteria from ({margin_sql(on_key(TEXTS_SQL))})
union all select 'table', exam_id, number, body, null from ({TABLE_SQL}) union all select 'letter', exam_id, pos::varchar, letter, null from ({LETTERS_SQL})""")
def geo_parse_answer_key(spark, sf_dir):
    lined = key_lines(printed(spark, sf_dir))
    margin, table_rows, letters = scaffold.key_sources(lined, pages(lined), drawings(spark, sf_dir, lined).filter("false"))
    none = F.lit(None).cast("string").alias("criteria")
    rows = margin.select(F.lit("margin").alias("source"), "exam_id", "number", "answer", "criteria")
    rows = rows.unionByName(table_rows.select(F.lit("table").alias("source"), "exam_id", "number", F.col("body").alias("answer"), none))
    return rows.unionByName(letters.select(F.lit("letter").alias("source"), "exam_id", F.col("pos").cast("string").alias("number"), F.col("letter").alias("answer"), none))


# ---- stored form and back -----------------------------------------------------------------------


def stored_exams(spark, sf_dir):
    """Documents of all exams with the answers of their keys, and the nodes they were made of."""
    plain = printed(spark, sf_dir)
    lined, keyed = with_spans(plain), key_lines(plain)
    key = scaffold.key_sources(keyed, pages(keyed), drawings(spark, sf_dir, keyed).filter("false"))
    paged = pages(lined)
    nodes = staged(scaffold.exams(lined, paged, drawings(spark, sf_dir, lined), key), "nodes")
    docs = tree.exam_documents(nodes, scaffold.page_counts(paged))
    # Every seventh document was stored without its total.
    bare = F.when(F.col("exam_id") % 7 == 0, F.regexp_replace("raw", r'"total_marks":\d+', '"total_marks":0')).otherwise(F.col("raw"))
    return nodes, staged(docs.withColumn("raw", bare), "scaffold")


# Answers on the tree: the table before the margin, nothing for parents of which only parts are listed, letters by position.
ANSWERED_SQL = f"""
with tr as ({TREE_SQL}), m as ({margin_sql(on_key(TEXTS_SQL))}), b as ({TABLE_SQL}),
j as (select tr.*, m.answer, m.criteria, m.number is not null as hit, trim(b.body) as body from tr left join m on tr.exam_id = m.exam_id and tr.number = m.number left join b on tr.exam_id = b.exam_id and tr.number = b.number),
c as (select distinct a.exam_id, a.path from j a join j d on a.exam_id = d.exam_id and a.qid = d.qid and d.body is not null and len(d.path) > len(a.path) and d.path[1:len(a.path)] = a.path),
r as (select j.* exclude (question_type), c.path is not null and body is null as lost, case when regexp_matches(answer, '^[A-Da-d]$') then 'multiple_choice' else question_type end as question_type
  from j left join c on j.exam_id = c.exam_id and j.path = c.path),
p as (select *, case when is_leaf and question_type = 'multiple_choice' then row_number() over (partition by exam_id, is_leaf and question_type = 'multiple_choice' order by path) end as pos from r)
select p.* exclude (answer, criteria), case when l.letter is not null then l.letter when not lost then coalesce(body, case when hit then answer end) end as correct_answer,
  case when not lost and body is null and hit then criteria end as marking_criteria from p left join ({LETTERS_SQL}) l on p.exam_id = l.exam_id and p.pos = l.pos"""


@query("src_scaffold_stored", f"""select exam_id, number, question_type, text, marks, coalesce(correct_answer, '') as correct_answer, coalesce(marking_criteria, '') as marking_criteria,
  page, {", ".join(f"({S.half_even(c, 1)})::double as {c}" for c in layout.BOX)} from ({ANSWERED_SQL})""")
def src_scaffold_stored(spark, sf_dir):
    """Exams composed from lines, stored with the answers of their keys, and read back."""
    _nodes, docs = stored_exams(spark, sf_dir)
    nodes, _rejected = tree.read_documents(docs)
    return nodes.select("exam_id", "number", "question_type", "text", "marks", F.coalesce("correct_answer", F.lit("")).alias("correct_answer"),
                        F.coalesce("marking_criteria", F.lit("")).alias("marking_criteria"), F.col("bbox.page").alias("page"), *[F.col(f"bbox.{c}").alias(c) for c in layout.BOX])


ROUNDED = ", ".join(f"({S.half_even(c, 1)})::double as {c}" for c in layout.BOX)


@query("src_scaffold_lists", f"""
with a as ({ANSWERED_SQL})
select a.exam_id, number, 'images' as list, file, {", ".join(f"i.{c}" for c in layout.BOX)} from (select exam_id, path, file, {ROUNDED} from ({IMAGES_SQL})) i join a on a.exam_id = i.exam_id and a.path = i.path
union all select a.exam_id, number, 'equation_blank_bboxes', '', {", ".join(f"b.{c}" for c in layout.BOX)} from (select exam_id, path, {ROUNDED} from ({BLANKS_SQL})) b
  join a on a.exam_id = b.exam_id and a.path = b.path where question_type <> 'multiple_choice'""")
def src_scaffold_lists(spark, sf_dir):
    """Figures and blanks of the stored exams, read back; lists that no paper fills are read as empty."""
    _nodes, docs = stored_exams(spark, sf_dir)
    nodes, _rejected = tree.read_documents(docs)
    item = lambda name, box, file: F.transform(name, lambda i: F.struct(F.lit(name).alias("list"), file(i).alias("file"), *[box(i)[c].alias(c) for c in layout.BOX]))
    every = F.concat(item("equation_blank_bboxes", lambda i: i, lambda i: F.lit("")), *[item(c, lambda i: i["bbox"], lambda i: i["path"]) for c in ("images", "answer_images")],
                     item("writing_areas", lambda i: i["bbox"], lambda i: i["kind"]))
    return nodes.select("exam_id", "number", F.explode(every).alias("i")).select("exam_id", "number", "i.*")


@query("src_scaffold_envelope", f"""
with a as ({ANSWERED_SQL}), n as (select exam_id, count(*) filter (len(path) = 1) as roots, count(*) filter (is_leaf) as leaves, sum(marks) filter (is_leaf) as total from a group by 1),
f as (select exam_id, string_agg('Q' || number || '(' || marks || 'm)', ', ' order by path) as shown from (select * from a where is_leaf qualify row_number() over (partition by exam_id order by path) <= 24) group by 1)
select exam_id, total::bigint as total_marks, (select count(*) from ({PAGES_SQL}) p where p.exam_id = n.exam_id)::int as page_count,
  roots || ' top-level, ' || leaves || ' gradable parts, ' || total || ' marks; ' || shown || case when leaves > 24 then ' …' else '' end as description from n join f using (exam_id)""")
def src_scaffold_envelope(spark, sf_dir):
    """Totals, pages and descriptions of the stored exams; totals that were stored as 0 are those of the leaves read back."""
    _nodes, docs = stored_exams(spark, sf_dir)
    nodes, _rejected = tree.read_documents(docs)
    return tree.read_envelopes(docs, nodes)


@query("win_leaf_top_adjust", f"select exam_id, {PATH} as node, round(y0, 6) as y0, round(y1, 6) as y1 from ({TREE_SQL}) where is_leaf")
def win_leaf_top_adjust(spark, sf_dir):
    return exam_nodes(spark, sf_dir).filter("is_leaf").select("exam_id", path_text(), F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query("win_snap_to_cell", f"select exam_id, {PATH} as node, file, round(y0, 6) as y0, round(y1, 6) as y1 from ({IMAGES_SQL})")
def win_snap_to_cell(spark, sf_dir):
    split, images, (lined, paged, cells, segs) = exam_images(spark, sf_dir)
    nodes = build.placed_nodes(split, cells, segs, lined, paged)
    shown = scaffold.attached(nodes, split, images, with_spans(lined)).select("exam_id", path_text(), F.explode("images").alias("i"))
    return shown.select("exam_id", "node", F.col("i.path").alias("file"), F.round("i.bbox.y0", 6).alias("y0"), F.round("i.bbox.y1", 6).alias("y1"))
