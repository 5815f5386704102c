"""Layout operators bound to documents: exam = document, 70 lines per page.

Every third document is printed four sheets to a page, every third in two columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import build, figures, layout, subparts
from gradelake.plans import sqlbits as S
from gradelake.plans.registry import query
from gradelake.session import staged, table

A4W, A4H = 595.276, 841.89

LINES_SQL = f"""select doc_id as exam_id, (n // 70 + 1)::int as page, (n // 10)::int as block, n::int as line, x0, y0, x0 + least(length(text) * 5.0::double, 400.0::double) as x1, y0 + 10.0::double as y1,
    10.0::double as font_size, text from (
  select doc_id, n, (case when doc_id % 3 = 0 then 0.0::double else (n % 70) // 35 * {A4W}::double end) + case when n % 10 in (0, 1, 3) then 20.0::double else 80.0::double end as x0,
    (case when doc_id % 3 = 0 then (n % 70) * 12.0::double else (n % 35) * 24.0::double end) as y0,
    case n % 10 when 0 then ((n // 10) % 12 + 1) || case when doc_id % 2 = 0 then ' ' || line else '' end when 1 then '(a) ' || line when 3 then '(i) ' || line when 5 then '(ii) v = ...... [2]'
      when 6 then '(b) ' || line when 7 then 'IGCSE Physics: s24' when 8 then '[Total: 9]' else line end as text
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents))"""
PAGES_SQL = f"""select distinct exam_id, page, case when exam_id % 3 = 0 then {A4W}::double when exam_id % 3 = 1 then {2 * A4W}::double else {A4W * 2}::double end as w,
    case when exam_id % 3 = 2 then 590.0::double else {A4H}::double end as h from ({LINES_SQL})"""


def lines(spark, sf_dir, spans=False):
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    d, n = F.col("doc_id"), F.col("n")
    third = d % 3 == 0
    m = n % 10
    number = (F.floor(n / 10) % 12 + 1).cast("string")
    text = (F.when(m == 0, F.when(d % 2 == 0, F.concat(number, F.lit(" "), "line")).otherwise(number)).when(m == 1, F.concat(F.lit("(a) "), "line"))
            .when(m == 3, F.concat(F.lit("(i) "), "line")).when(m == 5, "(ii) v = ...... [2]").when(m == 6, F.concat(F.lit("(b) "), "line"))
            .when(m == 7, "IGCSE Physics: s24").when(m == 8, "[Total: 9]").otherwise(F.col("line")))
    rows = raw.select(
        d.alias("exam_id"), (F.floor(n / 70) + 1).cast("int").alias("page"), F.floor(n / 10).cast("int").alias("block"), n.alias("line"),
        (F.when(third, 0.0).otherwise(F.floor((n % 70) / 35) * A4W) + F.when(m.isin(0, 1, 3), 20.0).otherwise(80.0)).alias("x0"),
        F.when(third, (n % 70) * 12.0).otherwise((n % 35) * 24.0).alias("y0"), text.alias("text"))
    out = rows.select("exam_id", "page", "block", "line", "x0", "y0", (F.col("x0") + F.least(F.length("text") * 5.0, F.lit(400.0))).alias("x1"),
                      (F.col("y0") + 10.0).alias("y1"), F.lit(10.0).alias("font_size"), "text")
    return with_spans(out) if spans else out


def with_spans(lined):
    return lined.withColumn("spans", F.array(F.struct("text", "x0", "x1")))


def printed(spark, sf_dir):
    """The lines of all exams, written once: a dozen branches read them, and each would cut all texts again."""
    return staged(lines(spark, sf_dir), "lines")


def pages(lined):
    k = F.col("exam_id") % 3
    return lined.select("exam_id", "page").distinct().select(
        "exam_id", "page", F.when(k == 0, A4W).otherwise(2 * A4W).alias("w"), F.when(k == 2, 590.0).otherwise(A4H).alias("h"))


def drawings(spark, sf_dir, lined):
    """Boxes of the parts laid over the pages: part k belongs to the document of the same number."""
    k = F.col("p_partkey")
    boxes = table(spark, sf_dir, "part").select(
        k.alias("exam_id"), F.lit(1).alias("page"), (F.col("p_size") * 3.0).alias("x0"), ((F.col("p_retailprice") - 900) % 300 + 50).alias("y0"),
        (F.col("p_size") * 3.0 + 60 + k % 90).alias("x1"), ((F.col("p_retailprice") - 900) % 300 + 90 + k % 60).alias("y1"),
        F.when(k % 5 == 0, "raster").otherwise("vector").alias("kind"))
    return boxes.join(lined.select("exam_id", "page").distinct(), ["exam_id", "page"], "left_semi")


ANCHOR = r"(?:\s*$|\s*\([a-zA-Z]\)|\s)"
CELLS_SQL = rf"""select exam_id, page, (c.no)::int as cell_no, c.cx0, c.cy0, c.cx1, c.cy1 from (
  select exam_id, page, unnest(case when four then [{{'no': 0, 'cx0': 0.0::double, 'cy0': 0.0::double, 'cx1': w * 0.5, 'cy1': h * 0.5}}, {{'no': 1, 'cx0': w * 0.5, 'cy0': 0.0::double, 'cx1': w, 'cy1': h * 0.5}},
      {{'no': 2, 'cx0': 0.0::double, 'cy0': h * 0.5, 'cx1': w * 0.5, 'cy1': h}}, {{'no': 3, 'cx0': w * 0.5, 'cy0': h * 0.5, 'cx1': w, 'cy1': h}}]
    when two then [{{'no': 0, 'cx0': 0.0::double, 'cy0': 0.0::double, 'cx1': w * 0.5, 'cy1': h}}, {{'no': 1, 'cx0': w * 0.5, 'cy0': 0.0::double, 'cx1': w, 'cy1': h}}]
    else [{{'no': 0, 'cx0': 0.0::double, 'cy0': 0.0::double, 'cx1': w, 'cy1': h}}] end) as c from (
    select exam_id, page, w, h, case when h >= w and w >= 700 and h >= 950 then true when h >= w then right_numbers >= 2 and low else w >= 1000 and h >= 600 end as four, h < w or right_numbers >= 2 as two
    from (select p.exam_id, p.page, p.w, p.h, count(*) filter (x0 >= w * 0.42 and regexp_matches(trim(text), '^\d{{1,2}}(\s+|\()')) as right_numbers,
        bool_or(y0 > h / 2 and regexp_matches(trim(text), '^\d{{1,2}}{ANCHOR}')) as low from ({PAGES_SQL}) p join ({LINES_SQL}) l using (exam_id, page) group by 1, 2, 3, 4)))"""


@query("geo_layout_cells", f"select exam_id, page, cell_no, cx0, cy0, cx1, cy1 from ({CELLS_SQL})")
def geo_layout_cells(spark, sf_dir):
    lined = lines(spark, sf_dir)
    return layout.page_cells(lined, pages(lined))


BAND_SQL = f"""select *, (cx1 - cx0) / {A4W}::double as sx, (cy1 - cy0) / {A4H}::double as sy, cy0 + 10.0::double * ((cy1 - cy0) / {A4H}::double) as m_top,
  least(cy0 + 790.0::double * ((cy1 - cy0) / {A4H}::double), cy1 - 1.0::double) as m_bottom from ({CELLS_SQL})"""


@query("geo_cell_margin_band", f"select exam_id, page, cell_no, round(sx, 9) as sx, round(sy, 9) as sy, round(m_top, 6) as m_top, round(m_bottom, 6) as m_bottom from ({BAND_SQL})")
def geo_cell_margin_band(spark, sf_dir):
    lined = lines(spark, sf_dir)
    band = layout.with_margins(layout.page_cells(lined, pages(lined)))
    return band.select("exam_id", "page", "cell_no", F.round("sx", 9).alias("sx"), F.round("sy", 9).alias("sy"), F.round("m_top", 6).alias("m_top"), F.round("m_bottom", 6).alias("m_bottom"))


IN_CELL = "x0 < x1 and y0 < y1 and x0 < cx1 and cx0 < x1 and y0 < cy1 and cy0 < y1"


@query("join_line_to_cell", f"""select exam_id, page, cell_no, count(*)::bigint as lines, min(line) as first_line from ({LINES_SQL}) join ({CELLS_SQL}) using (exam_id, page) where {IN_CELL} group by 1, 2, 3""")
def join_line_to_cell(spark, sf_dir):
    lined = lines(spark, sf_dir)
    hits = layout.lines_in_cells(lined, layout.page_cells(lined, pages(lined)))
    return hits.groupBy("exam_id", "page", "cell_no").agg(F.count("*").alias("lines"), F.min("line").alias("first_line"))


@query("join_point_to_cell", f"""
with l as (select exam_id, page, line, (x0 + x1) * 0.5 as px, (y0 + y1) * 0.5 as py from ({LINES_SQL})),
c as (select l.exam_id, l.page, l.line, min(cell_no) as cell_no, arg_min(cx0, cell_no) as x0, arg_min(cx1, cell_no) as x1 from l join ({CELLS_SQL}) using (exam_id, page)
  where px >= cx0 and px < cx1 and py >= cy0 and py < cy1 group by 1, 2, 3)
select l.exam_id, l.page, l.line, cell_no, coalesce(c.x0, 0.0::double) as x0, coalesce(c.x1, w) as x1 from l join ({PAGES_SQL}) using (exam_id, page) left join c using (exam_id, page, line)""")
def join_point_to_cell(spark, sf_dir):
    lined = lines(spark, sf_dir)
    paged = pages(lined)
    out = layout.cell_of_point(lined, layout.page_cells(lined, paged), paged, (F.col("x0") + F.col("x1")) * 0.5, (F.col("y0") + F.col("y1")) * 0.5, ["exam_id", "page", "line"])
    return out.select("exam_id", "page", "line", "cell_no", F.col("cx0").alias("x0"), F.col("cx1").alias("x1"))


ANCHORS_SQL = rf"""select *, raw || case when occ > 1 then '_' || occ else '' end as qid from (
  select exam_id, page, cell_no, cx0, cy0, cx1, cy1, sx, sy, m_top, m_bottom, raw, y0 as qy0, x1 as num_x1, block, line,
    row_number() over (partition by exam_id, raw order by page, cell_no, block, line) as occ from (
    select *, coalesce(nullif(regexp_extract(text, '^\s*(\d{{1,2}})(?:\s*$|\s*\([a-zA-Z]\))', 1), ''), case when y0 <= cy1 - 2 then nullif(regexp_extract(text, '^\s*(\d{{1,2}})\s+\S', 1), '') end)::int as raw
    from ({LINES_SQL}) join ({BAND_SQL}) using (exam_id, page) where {IN_CELL} and y0 between m_top and m_bottom and x0 <= cx0 + 60.0::double * sx and font_size between 5 and 14)
  where raw between 1 and 99)"""


def anchors(spark, sf_dir, lined=None):
    lined = lines(spark, sf_dir) if lined is None else lined
    paged = pages(lined)
    cells = layout.page_cells(lined, paged)
    return lined, paged, cells, layout.question_anchors(lined, cells)


@query("win_occurrence_id", f"select exam_id, page, cell_no, line, raw, qid from ({ANCHORS_SQL})")
def win_occurrence_id(spark, sf_dir):
    return anchors(spark, sf_dir)[3].select("exam_id", "page", "cell_no", "line", "raw", "qid")


@query("sort_reading_order", f"""select exam_id, qid, row_number() over (partition by exam_id order by page, cy0, cx0, qy0, cell_no)::bigint as pos from ({ANCHORS_SQL})""")
def sort_reading_order(spark, sf_dir):
    from gradelake.operators.ordered import rank_in_order

    a = anchors(spark, sf_dir)[3]
    ranked = rank_in_order(a, ["exam_id"], "page", [F.col("cy0"), F.col("cx0"), F.col("qy0"), F.col("cell_no")], "pos")
    return ranked.select("exam_id", "qid", "pos")


SEGMENTS_SQL = f"""select *, greatest(qy0, m_top) as y_start, case when nxt is not null then least(nxt, m_bottom) else least(m_bottom, cy1 - 1) end as y_end, rn = 1 as snap_top, nxt is null as snap_bottom,
    page::bigint * 1000000000000 + cell_no::bigint * 1000000 + rn as seg_no from (
  select *, row_number() over w as rn, lead(qy0) over w as nxt from ({ANCHORS_SQL}) window w as (partition by exam_id, page, cell_no order by qy0, block, line))"""


@query("win_segments", f"select exam_id, qid, seg_no::bigint as seg_no, round(y_start, 6) as y_start, round(y_end, 6) as y_end, snap_top, snap_bottom from ({SEGMENTS_SQL})")
def win_segments(spark, sf_dir):
    segs = layout.segments(anchors(spark, sf_dir)[3])
    return segs.select("exam_id", "qid", "seg_no", F.round("y_start", 6).alias("y_start"), F.round("y_end", 6).alias("y_end"), "snap_top", "snap_bottom")


CLIPS_SQL = f"""select *, case when greatest(cx0, num_x1) >= cx1 - 5 then cx0 else greatest(cx0, num_x1) end as tx0, cx1 as tx1, greatest(y_start - 2.0::double * sy, m_top) as ty0, y_end as ty1,
  case when snap_top then cy0 else y_start end as by0, case when snap_bottom then cy1 else y_end end as by1 from ({SEGMENTS_SQL})"""


@query("geo_text_clip", f"select exam_id, qid, round(tx0, 6) as tx0, round(ty0, 6) as ty0, round(tx1, 6) as tx1, round(ty1, 6) as ty1, round(by0, 6) as y0, round(by1, 6) as y1 from ({CLIPS_SQL})")
def geo_text_clip(spark, sf_dir):
    clips = layout.with_clips(layout.segments(anchors(spark, sf_dir)[3]))
    return clips.select("exam_id", "qid", *[F.round(c, 6).alias(c) for c in ("tx0", "ty0", "tx1", "ty1", "y0", "y1")])


CLIP_LINES_SQL = f"""select exam_id, page, qid, raw, line, block, x0, y0, x1, y1, {S.strip('text')} as text from (
  select l.exam_id, l.page, c.qid, c.raw, l.line, l.block, l.x0, l.y0, l.x1, l.y1, l.text, greatest(least(l.x1, tx1) - greatest(l.x0, tx0), 0) * greatest(least(l.y1, ty1) - greatest(l.y0, ty0), 0) as common,
    (l.x1 - l.x0) * (l.y1 - l.y0) as own from ({LINES_SQL}) l join ({CLIPS_SQL}) c on l.exam_id = c.exam_id and l.page = c.page
  where l.x0 < l.x1 and l.x0 < tx1 and tx0 < l.x1 and l.y0 < ty1 and ty0 < l.y1) where common >= own * 0.25 and {S.strip('text')} <> ''"""


def clip(spark, sf_dir):
    lined, paged, cells, a = anchors(spark, sf_dir)
    segs = staged(layout.with_clips(layout.segments(a)))
    return lined, paged, cells, segs, layout.clip_lines(lined, segs)


@query("join_lines_in_segment", f"select exam_id, qid, line, text from ({CLIP_LINES_SQL})")
def join_lines_in_segment(spark, sf_dir):
    return clip(spark, sf_dir)[4].select("exam_id", "qid", "line", "text")


@query("agg_bbox_union", f"select exam_id, page, qid, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from ({CLIP_LINES_SQL}) group by 1, 2, 3")
def agg_bbox_union(spark, sf_dir):
    return clip(spark, sf_dir)[4].groupBy("exam_id", "page", "qid").agg(*figures.union_box())


ROMAN_LIST = ", ".join(f"'{r}'" for r in subparts.ROMANS)
LABELLED_SQL = rf"""select *, case when margin_letter <> '' then 'letter' when roman in ({ROMAN_LIST}) then 'roman' when letter <> '' then 'letter' end as kind,
    case when margin_letter <> '' then margin_letter when roman in ({ROMAN_LIST}) then roman else letter end as label,
    trim(case when margin_letter <> '' then regexp_extract(text, '(?is)^\s*\d{{1,2}}\s*\(?[a-z]\)\s*(.*)$', 1) when roman in ({ROMAN_LIST}) then regexp_extract(text, '(?is)^\s*\([ivxlcdm]+\)\s*(.*)$', 1)
      else regexp_extract(text, '(?is)^\s*\(?[a-z]\)\s*(.*)$', 1) end) as rest from (
  select *, case when regexp_extract(text, '^\s*(\d{{1,2}})', 1) = raw::varchar then lower(regexp_extract(text, '(?is)^\s*\d{{1,2}}\s*\(?([a-z])\)', 1)) else '' end as margin_letter,
    lower(regexp_extract(text, '(?is)^\s*\(([ivxlcdm]+)\)', 1)) as roman, lower(regexp_extract(text, '(?is)^\s*\(?([a-z])\)', 1)) as letter from ({CLIP_LINES_SQL}))"""


@query("win_subpart_anchors", f"select exam_id, qid, line, kind, label, rest from ({LABELLED_SQL}) where kind is not null")
def win_subpart_anchors(spark, sf_dir):
    labelled = subparts.labelled_lines(clip(spark, sf_dir)[4]).filter(F.col("a").isNotNull())
    return labelled.select("exam_id", "qid", "line", "a.kind", "a.label", "a.rest")


SLICES_SQL = f"""select exam_id, qid, page, slice_no, max(case when kind is not null then kind end) as kind, max(case when kind is not null then label end) as label,
    {S.strip("coalesce(string_agg(nullif(case when kind is not null then rest else text end, ''), chr(10) order by i), '')")} as text,
    min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, arg_min(y0, i) as top from (
  select *, sum(case when kind is not null then 1 else 0 end) over w as slice_no, row_number() over w as i, count(*) over (partition by exam_id, qid) as n_lines,
    sum(case when kind is not null then 1 else 0 end) over (partition by exam_id, qid) as n_labels from ({LABELLED_SQL}) window w as (partition by exam_id, qid order by page, y0, x0, block, line))
  where n_lines >= 3 and n_labels >= 2 group by 1, 2, 3, 4"""


@query("win_subpart_slices", f"select exam_id, qid, slice_no::bigint as slice_no, text from ({SLICES_SQL}) where slice_no = 0 or text <> ''")
def win_subpart_slices(spark, sf_dir):
    sliced = subparts.slices(subparts.labelled_lines(clip(spark, sf_dir)[4]))
    return sliced.filter((F.col("slice_no") == 0) | (F.col("text") != "")).select("exam_id", "qid", "slice_no", "text")


PARTS_SQL = f"""select *, qid || case when kind = 'roman' and p_kept then p_label else '' end || label as number, kind = 'roman' and p_kept as below from (
  select *, last_value(case when kind = 'letter' then label end ignore nulls) over w as p_label, last_value(case when kind = 'letter' then slice_no end ignore nulls) over w as p_slice, coalesce(last_value(case when kind = 'letter' then text <> '' end ignore nulls) over w, false) as p_kept,
    greatest(y1, coalesce(lead(top) over (partition by exam_id, qid order by slice_no), y1)) as ny1 from ({SLICES_SQL}) where slice_no > 0
  window w as (partition by exam_id, qid order by slice_no rows between unbounded preceding and 1 preceding)) where text <> ''
  qualify count(*) filter (not (kind = 'roman' and p_kept)) over (partition by exam_id, qid) > 0"""


@query("win_subpart_parent", f"select exam_id, qid, slice_no::bigint as slice_no, number, below from ({PARTS_SQL})")
def win_subpart_parent(spark, sf_dir):
    found = subparts.parts(subparts.slices(subparts.labelled_lines(clip(spark, sf_dir)[4])))
    return found.select("exam_id", "qid", "slice_no", "number", F.col("parent_slice").isNotNull().alias("below"))


@query("win_extend_bbox_to_next", f"select exam_id, qid, slice_no::bigint as slice_no, x0, y0, x1, ny1 as y1 from ({PARTS_SQL})")
def win_extend_bbox_to_next(spark, sf_dir):
    found = subparts.parts(subparts.slices(subparts.labelled_lines(clip(spark, sf_dir)[4])))
    return found.select("exam_id", "qid", "slice_no", "x0", "y0", "x1", "y1")


# ---- composed steps; their rules are checked against hand-made rows in the tests -----------------------


DRAWN_SQL = f"""select * from (select p_partkey as exam_id, 1 as page, p_size * 3.0::double as x0, (p_retailprice - 900) % 300 + 50 as y0, p_size * 3.0::double + 60 + p_partkey % 90 as x1,
    (p_retailprice - 900) % 300 + 90 + p_partkey % 60 as y1, case when p_partkey % 5 = 0 then 'raster' else 'vector' end as kind from part) where exam_id in (select exam_id from ({LINES_SQL}))"""
TOUCH = "b.x0 < b.x1 and b.y0 < b.y1 and b.x0 < s.cx1 and s.cx0 < b.x1 and b.y0 < s.cy1 and s.cy0 < b.y1"
TIGHT_ENDS_SQL = f"""
with seg as (select * from ({SEGMENTS_SQL})), last as (select exam_id, page, qid, cx0, cy0, cx1, cy1, y_start, y_end from seg where snap_bottom),
blk as (select exam_id, page, block, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, lower(string_agg(text, ' ' order by line)) as flat from ({LINES_SQL}) group by 1, 2, 3),
nt as (select s.exam_id, s.qid, min(b.y0) as notice from last s join blk b on s.exam_id = b.exam_id and s.page = b.page where {TOUCH} and b.y0 between s.y_start and s.y_end
  and (contains(flat, 'permission to reproduce') or contains(flat, 'third-party owned material') or contains(flat, 'copyright acknowledgements booklet')) group by 1, 2),
ru as (select s.exam_id, s.qid, min(b.y0) as rule from last s join nt using (exam_id, qid) join ({DRAWN_SQL}) b on s.exam_id = b.exam_id and s.page = b.page
  where {TOUCH} and b.x1 - b.x0 >= 100 and b.y0 >= notice - 15 and b.y0 < notice group by 1, 2),
st as (select l.*, coalesce(least(notice, rule), notice, y_end) as footer, least(y_end, coalesce(least(notice, rule), notice, y_end) - 2) as stop from last l left join nt using (exam_id, qid) left join ru using (exam_id, qid)),
tx as (select s.exam_id, s.qid, b.block, arg_max(least(l.y1, s.stop), l.line) as b from st s join blk b on s.exam_id = b.exam_id and s.page = b.page
  join ({LINES_SQL}) l on l.exam_id = b.exam_id and l.page = b.page and l.block = b.block
  where {TOUCH} and b.y0 between s.y_start - 5 and s.stop and l.y0 <= s.stop and {S.strip('l.text')} <> '' group by 1, 2, 3),
dr as (select s.exam_id, s.qid, max(least(b.y1, s.stop)) as b from st s join ({DRAWN_SQL}) b on s.exam_id = b.exam_id and s.page = b.page where {TOUCH} and b.y0 between s.y_start - 5 and s.stop and b.x1 - b.x0 >= 10 group by 1, 2),
bt as (select st.*, greatest(y_start, coalesce((select max(b) from tx where tx.exam_id = st.exam_id and tx.qid = st.qid), y_start), coalesce((select max(b) from dr where dr.exam_id = st.exam_id and dr.qid = st.qid), y_start)) as bottom from st),
en as (select exam_id, qid, case when bottom <= y_start then case when footer < y_end - 4 then greatest(y_start, stop) else y_end end when least(bottom + 4, stop) < y_end - 4 then least(bottom + 4, stop) else y_end end as y from bt)"""
TIGHT_SQL = f"""{TIGHT_ENDS_SQL}
select seg.exam_id, seg.page, seg.qid, round(y_start, 6) as y_start, round(coalesce(en.y, y_end), 6) as y_end from seg left join en on seg.exam_id = en.exam_id and seg.qid = en.qid"""


@query("win_tight_end", TIGHT_SQL)
def win_tight_end(spark, sf_dir):
    lined, _paged, _cells, a = anchors(spark, sf_dir)
    segs = layout.tightened(staged(layout.segments(a)), lined, drawings(spark, sf_dir, lined))
    return segs.select("exam_id", "page", "qid", F.round("y_start", 6).alias("y_start"), F.round("y_end", 6).alias("y_end"))


@query("geo_image_clip", f"""
with k as (select exam_id, page, qid, cx0, by0 as ky0, cx1, by1 as ky1 from ({CLIPS_SQL})),
b as (select p_partkey as exam_id, 1 as page, p_size * 3.0::double as x0, (p_retailprice - 900) % 300 + 50 as y0, p_size * 3.0::double + 60 + p_partkey % 90 as x1, (p_retailprice - 900) % 300 + 90 + p_partkey % 60 as y1
  from part where p_partkey % 5 = 0)
select k.exam_id, qid, row_number() over (partition by k.exam_id, qid order by b.y0, b.x0)::int as figure_no, round(greatest(0, greatest(b.x0, cx0) - 5, cx0), 6) as x0, round(greatest(0, greatest(b.y0, ky0) - 5, ky0), 6) as y0,
  round(least(w, least(b.x1, cx1) + 5, cx1), 6) as x1, round(least(h, least(b.y1, ky1) + 5, ky1), 6) as y1
from k join b using (exam_id, page) join ({PAGES_SQL}) p using (exam_id, page) where b.x0 < cx1 and cx0 < b.x1 and b.y0 < ky1 and ky0 < b.y1 and ky0 < ky1""")
def geo_image_clip(spark, sf_dir):
    lined, paged, _cells, segs, _clip = clip(spark, sf_dir)
    found = build.question_figures(segs, drawings(spark, sf_dir, lined), lined, paged).filter(F.col("kind") == "raster")
    return found.select("exam_id", "qid", "figure_no", *[F.round(c, 6).alias(c) for c in layout.BOX])


LABEL_SQL = f"""select exam_id, page, arg_min(cx, (block, line)) as cx, arg_min(cy, (block, line)) as cy, min((block, line)) as bl from (
  select exam_id, page, block, line, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from ({LINES_SQL}) where contains(text, 'IGCSE')) group by exam_id, page, {S.half_even('cx')}, {S.half_even('cy')}"""


@query("set_dedupe_grid", f"select exam_id, page, cx, cy from ({LABEL_SQL})")
def set_dedupe_grid(spark, sf_dir):
    return figures.label_centres(lines(spark, sf_dir)).select("exam_id", "page", "cx", "cy")


@query("agg_topmost_anchor", f"""
with q as (select l.*, case when cy < h / 2 then 'top' else 'bot' end || '_' || case when cx < w / 2 then 'left' else 'right' end as quadrant from ({LABEL_SQL}) l join ({PAGES_SQL}) using (exam_id, page)),
t as (select exam_id, page, quadrant, arg_min(cx, (cy, bl)) as x, min(cy) as y from q group by 1, 2, 3)
select exam_id, page, quadrant, x, y from (select exam_id, page, quadrant from ({PAGES_SQL}) p, (values ('top_left'), ('top_right'), ('bot_left'), ('bot_right')) w(quadrant)) z left join t using (exam_id, page, quadrant)""")
def agg_topmost_anchor(spark, sf_dir):
    lined = lines(spark, sf_dir)
    found, missing = figures.topmost_labels(figures.label_centres(lined), pages(lined))
    none = F.lit(None).cast("double")
    return found.unionByName(missing.select("exam_id", "page", "quadrant", none.alias("x"), none.alias("y")))


KEY_LINES_SQL = """select doc_id as exam_id, n as line_no, case n % 6 when 1 then (n % 4 + 1) || '(a)' when 3 then (n % 5 + 1) || '(c)(ii) ' when 5 then case when doc_id % 2 = 0 then 'Answers Q1' else line end else line end as line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)"""


@query("win_mark_scheme_rows", rf"""
with l as (select exam_id, line_no, {S.strip('line')} as t from ({KEY_LINES_SQL})),
k as (select *, case when regexp_matches(t, '(?i)^\d+\(c\)\(i{{1,3}}\)\s*$') then regexp_replace(lower(t), '[()\s]', '', 'g') when regexp_matches(t, '(?i)^\d+\([a-z]\)\s*$') then regexp_replace(lower(t), '[()\s]', '', 'g') end as label,
  t like 'IGCSE %' or regexp_matches(t, '(?i)^Answers\s+Q') or regexp_matches(t, '(?i)^Question\s+\d+\s*\(\s*Answer\s*:') as stop from l),
g as (select *, sum(case when label is not null or stop then 1 else 0 end) over (partition by exam_id order by line_no) as row_no from k),
r as (select exam_id, row_no, max(label) as number, {S.science(S.strip("coalesce(string_agg(t, chr(10) order by line_no) filter (label is null), '')"))} as body from g group by 1, 2 having max(label) is not null)
select exam_id, number, arg_max(body, row_no) as body from r where body <> '' group by 1, 2""")
def win_mark_scheme_rows(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("exam_id"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    n = F.col("p") + 1
    line = (F.when(n % 6 == 1, F.concat((n % 4 + 1).cast("string"), F.lit("(a)"))).when(n % 6 == 3, F.concat((n % 5 + 1).cast("string"), F.lit("(c)(ii) ")))
            .when((n % 6 == 5) & (F.col("exam_id") % 2 == 0), "Answers Q1").otherwise(F.col("line")))
    return build.table_answers(raw.select("exam_id", n.cast("bigint").alias("line_no"), line.alias("line")))
