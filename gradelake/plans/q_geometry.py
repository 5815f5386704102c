"""Projection bound to parts (boxes, 80 per exam) and suppliers (scans, 4 per exam, 2 pages each)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import geometry as G
from gradelake.plans import sqlbits as S
from gradelake.plans.registry import query
from gradelake.session import shared_folder, staged, table
from gradelake.sources import store

DPI, W, H = 300, 595.0, 842.0
BOX = ("x0", "y0", "x1", "y1")

BOXES_SQL = """select p_partkey // 80 as exam_id, p_partkey as box_id, p_size * 10.0::double as x0, (p_retailprice - 900) * 8.2::double as y0,
    case when p_partkey % 17 = 0 then p_size * 10.0::double else p_size * 10.0::double + 15 + p_partkey % 120 end as x1, (p_retailprice - 900) * 8.2::double + 10 + p_partkey % 50 as y1,
    case when p_partkey % 13 = 0 then 2 else 1 end as paper_page, p_partkey % 4 = 0 as is_blank from part"""
VALID_SQL = f"select * from ({BOXES_SQL}) where x1 > x0 and y1 > y0 and paper_page = 1"
RAW_SQL = """select exam_id, half || '_' || side as quadrant, case side when 'left' then 60.0::double else 360.0::double end + exam_id % 7 as x, case half when 'top' then 30.0::double else 450.0::double end as y
  from (select distinct p_partkey // 80 as exam_id from part), (values ('top'), ('bot')) a(half), (values ('left'), ('right')) b(side)"""
SCAN_SQL = f"""select s_suppkey // 4 as exam_id, s_suppkey as scan_id, page, quadrant, case when s_suppkey % 7 = 0 and page = 2 and quadrant = 'top_left' then null else x * 4.1::double + s_suppkey % 10 end as x,
    case when s_suppkey % 7 = 0 and page = 2 and quadrant = 'top_left' then null else case when quadrant like 'top%' then y else y - 420.9::double end * 4.1::double + page * 3 end as y
  from supplier join ({RAW_SQL}) r on s_suppkey // 4 = r.exam_id, (values (1), (2)) p(page)"""
TRANSFORMS_SQL = f"""select exam_id, scan_id, page, half, scale, lx - scale * lrx as tx, (ly + ry) / 2.0::double - scale * lry as ty from (
  select exam_id, scan_id, page, half, (rx - lx) / (rrx - lrx) as scale, lx, ly, ry, lrx, lry from (
    select s.exam_id, s.scan_id, s.page, left(s.quadrant, 3) as half, max(s.x) filter (s.quadrant like '%left') as lx, max(s.x) filter (s.quadrant like '%right') as rx, max(s.y) filter (s.quadrant like '%left') as ly,
      max(s.y) filter (s.quadrant like '%right') as ry, max(r.x) filter (s.quadrant like '%left') as lrx, max(r.x) filter (s.quadrant like '%right') as rrx, max(r.y) filter (s.quadrant like '%left') as lry
    from ({SCAN_SQL}) s join ({RAW_SQL}) r using (exam_id, quadrant) group by 1, 2, 3, 4))"""
COMPLETE_SQL = f"""select * from ({TRANSFORMS_SQL}) where scan_id not in (select scan_id from ({TRANSFORMS_SQL}) where scale is null or tx is null or ty is null)"""
PROJECTED_SQL = f"""select scan_id, page, box_id, half, is_blank, scale * ax0 + tx as x0, scale * ay0 + ty as y0, scale * x1 + tx as x1, scale * ay1 + ty as y1 from (
  select exam_id, box_id, is_blank, case when y0 < 420.9 then 'top' else 'bot' end as half, case when x0 + 22 >= x1 then x1 - 0.5 else x0 + 22 end as ax0, x1,
    y0 - case when (x0 + x1) / 2 >= 297.6 then 2 else 0 end as ay0, y1 - case when (x0 + x1) / 2 >= 297.6 then 2 else 0 end as ay1 from ({VALID_SQL})) join ({COMPLETE_SQL}) using (exam_id, half)"""
RECTS_SQL = f"""select scan_id, page, box_id, is_blank, x0, y0, x1, y1 from (select scan_id, page, box_id, is_blank, greatest(least(x0, x1) * 0.24::double, 0) as x0, least(greatest(x0, x1) * 0.24::double, {W}::double) as x1,
    greatest((least(y0, y1) + case when half = 'top' then 0 else 1754 end) * 0.24::double, 0) as y0, least((greatest(y0, y1) + case when half = 'top' then 0 else 1754 end) * 0.24::double, {H}::double) as y1 from ({PROJECTED_SQL}))
  where x0 < x1 and y0 < y1"""


def boxes(spark, sf_dir):
    k, x0, y0 = F.col("p_partkey"), F.col("p_size") * 10.0, (F.col("p_retailprice") - 900) * 8.2
    return table(spark, sf_dir, "part").select(
        F.floor(k / 80).alias("exam_id"), k.alias("box_id"), x0.alias("x0"), y0.alias("y0"), F.when(k % 17 == 0, x0).otherwise(x0 + 15 + k % 120).alias("x1"),
        (y0 + 10 + k % 50).alias("y1"), F.when(k % 13 == 0, 2).otherwise(1).alias("paper_page"), (k % 4 == 0).alias("is_blank"))


def raw_anchors(spark, sf_dir):
    exams = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 80).alias("exam_id")).distinct()
    spots = F.array(*[F.struct(F.lit(f"{half}_{side}").alias("quadrant"), (F.lit(x) + F.col("exam_id") % 7).alias("x"), F.lit(y).alias("y"))
                      for half, y in (("top", 30.0), ("bot", 450.0)) for side, x in (("left", 60.0), ("right", 360.0))])
    return exams.select("exam_id", F.inline(spots))


def scan_pages(spark, sf_dir):
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.floor(s / 4).alias("exam_id"), s.alias("scan_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page")).withColumns({"w": F.lit(W), "h": F.lit(H)})


def scan_anchors(spark, sf_dir):
    s, top = F.col("scan_id"), F.col("quadrant").startswith("top")
    lost = (s % 7 == 0) & (F.col("page") == 2) & (F.col("quadrant") == "top_left")
    return scan_pages(spark, sf_dir).join(raw_anchors(spark, sf_dir), "exam_id").select(
        "exam_id", "scan_id", "page", "quadrant", F.when(~lost, F.col("x") * 4.1 + s % 10).alias("x"),
        F.when(~lost, F.when(top, F.col("y")).otherwise(F.col("y") - 420.9) * 4.1 + F.col("page") * 3).alias("y"))


def transforms(spark, sf_dir):
    return G.half_transforms(raw_anchors(spark, sf_dir), scan_anchors(spark, sf_dir))


def complete(spark, sf_dir):
    return G.complete_scans(transforms(spark, sf_dir), scan_pages(spark, sf_dir))


def projected(spark, sf_dir):
    return G.projected(G.valid_boxes(boxes(spark, sf_dir)), complete(spark, sf_dir))


def rects(spark, sf_dir):
    return G.page_rects(projected(spark, sf_dir), scan_pages(spark, sf_dir), DPI)


def rounded(df, cols=BOX):
    return df.withColumns({c: F.round(c, 5) for c in cols})


def _r(cols=BOX) -> str:
    return ", ".join(f"round({c}, 5) as {c}" for c in cols)


TF = ("scale", "tx", "ty")


@query("filter_degenerate_boxes", f"select box_id, exam_id, {_r()} from ({VALID_SQL})")
def filter_degenerate_boxes(spark, sf_dir):
    return rounded(G.valid_boxes(boxes(spark, sf_dir))).select("box_id", "exam_id", *BOX)


@query("geo_half_transform", f"select scan_id, page, half, {_r(TF)} from ({TRANSFORMS_SQL}) where scale is not null")
def geo_half_transform(spark, sf_dir):
    return rounded(transforms(spark, sf_dir), TF).filter(F.col("scale").isNotNull()).select("scan_id", "page", "half", *TF)


@query("join_transforms_anchor", f"select scan_id, page, half, scale is not null as usable from ({TRANSFORMS_SQL})")
def join_transforms_anchor(spark, sf_dir):
    return transforms(spark, sf_dir).select("scan_id", "page", "half", F.col("scale").isNotNull().alias("usable"))


@query("geo_page_transforms_all_or_none", f"select scan_id, page, half, {_r(TF)} from ({COMPLETE_SQL})")
def geo_page_transforms_all_or_none(spark, sf_dir):
    return rounded(complete(spark, sf_dir), TF).select("scan_id", "page", "half", *TF)


@query("join_boxes_to_pages", f"select scan_id, page, half, box_id from ({PROJECTED_SQL})")
def join_boxes_to_pages(spark, sf_dir):
    return projected(spark, sf_dir).select("scan_id", "page", "half", "box_id")


@query("geo_project_bbox", f"select scan_id, page, box_id, half, {_r()} from ({PROJECTED_SQL})")
def geo_project_bbox(spark, sf_dir):
    return rounded(projected(spark, sf_dir)).select("scan_id", "page", "box_id", "half", *BOX)


@query("join_pages_min_length", f"select distinct scan_id, page from ({COMPLETE_SQL}) where page <= 1 + scan_id % 2")
def join_pages_min_length(spark, sf_dir):
    pages = scan_pages(spark, sf_dir).filter(F.col("page") <= 1 + F.col("scan_id") % 2)
    return G.paired_pages(complete(spark, sf_dir), pages).select("scan_id", "page")


@query("geo_halfpx_to_page_rect", f"select scan_id, page, box_id, {_r()} from ({RECTS_SQL})")
def geo_halfpx_to_page_rect(spark, sf_dir):
    return rounded(rects(spark, sf_dir)).select("scan_id", "page", "box_id", *BOX)


STRIPS_SQL = f"""select * from (select scan_id, page, box_id, y0, y1, case when (x0 + x1) / 2 < {W / 2} then 0 else x1 end as x0, case when (x0 + x1) / 2 < {W / 2} then x0 else {W}::double end as x1
  from ({RECTS_SQL}) where not is_blank) where x0 < x1"""


@query("geo_margin_strips", f"select scan_id, page, box_id, {_r()} from ({STRIPS_SQL})")
def geo_margin_strips(spark, sf_dir):
    return rounded(G.margin_strips(rects(spark, sf_dir))).select("scan_id", "page", "box_id", *BOX)


TRIM_SQL = f"""select scan_id, page, box_id, x0, case when rn = 1 and y0 + 20 < y1 then y0 + 20 else y0 end as y0, x1, y1, rn = 1 and y0 + 20 < y1 as trimmed from (
  select *, row_number() over (partition by scan_id, page, (x0 + x1) / 2 < {W / 2}, (y0 + y1) / 2 < {H / 2} order by y0, box_id) as rn from ({RECTS_SQL}) where not is_blank)"""


@query("win_trim_first_in_quadrant", f"select scan_id, page, box_id, trimmed, {_r()} from ({TRIM_SQL})")
def win_trim_first_in_quadrant(spark, sf_dir):
    return rounded(G.trimmed_tops(rects(spark, sf_dir))).select("scan_id", "page", "box_id", "trimmed", *BOX)


ADJUSTED_SQL = f"""select t.scan_id, t.page, t.box_id, hw as expanded, case when hw then least(t.x0, s.x0) else t.x0 end as x0, case when hw then least(t.y0, sy0) else t.y0 end as y0,
    case when hw then greatest(t.x1, s.x1) else t.x1 end as x1, t.y1 from (select *, (box_id + scan_id) % 3 = 0 as hw from ({TRIM_SQL})) t
  join (select *, y0 as oy0 from ({STRIPS_SQL})) s on t.scan_id = s.scan_id and t.page = s.page and t.box_id = s.box_id, lateral (select case when t.trimmed and oy0 + 20 < s.y1 then oy0 + 20 else oy0 end as sy0)"""


def adjusted(spark, sf_dir):
    found = rects(spark, sf_dir)
    tops = G.trimmed_tops(found)
    strips = G.trimmed_strips(G.margin_strips(found), tops)
    flags = tops.select("scan_id", "page", "box_id", ((F.col("box_id") + F.col("scan_id")) % 3 == 0).alias("has_handwriting"))
    return G.adjusted_boxes(tops, strips, flags)


@query("join_strip_to_box", f"select scan_id, page, box_id, expanded from ({ADJUSTED_SQL})")
def join_strip_to_box(spark, sf_dir):
    return adjusted(spark, sf_dir).select("scan_id", "page", "box_id", "expanded")


@query("geo_adjusted_boxes", f"select scan_id, page, box_id, expanded, {_r()} from ({ADJUSTED_SQL})")
def geo_adjusted_boxes(spark, sf_dir):
    return rounded(adjusted(spark, sf_dir)).select("scan_id", "page", "box_id", "expanded", *BOX)


@query("set_union_pages", f"""select scan_id, page, box_id, kind from (select scan_id, page, box_id, case when is_blank then 'blank' else 'exercise' end as kind from ({RECTS_SQL})
  union all select scan_id, page, box_id, 'strip' from ({STRIPS_SQL}))""")
def set_union_pages(spark, sf_dir):
    found = rects(spark, sf_dir).select("scan_id", "page", "box_id", "is_blank", "w", *BOX)
    cols = ["scan_id", "page", "box_id"]
    kind = lambda df, name: df.select(*cols, F.lit(name).alias("kind"))
    plain, blank = kind(found.filter(~F.col("is_blank")), "exercise"), kind(found.filter("is_blank"), "blank")
    return plain.unionByName(blank).unionByName(kind(G.margin_strips(found), "strip"))


NUMBERS = ("a", "b", "c", "d")


def _stored(kind: str, sql: str, ref: str, cols=BOX, flag: str = "null::boolean") -> str:
    shown = [f"round({c}, 5)" for c in cols] + ["null::double"] * (4 - len(cols))
    return f"select '{kind}' as kind, scan_id, page, {ref} as ref, {', '.join(f'{v} as {n}' for v, n in zip(shown, NUMBERS, strict=True))}, {flag} as flag from ({sql})"


@query("sink_box_tables", " union all ".join((
    _stored("transform", COMPLETE_SQL, "half", TF), _stored("box", RECTS_SQL, "box_id::varchar", flag="is_blank"), _stored("strip", STRIPS_SQL, "box_id::varchar"),
    _stored("adjusted", ADJUSTED_SQL, "box_id::varchar", flag="expanded"))))
def sink_box_tables(spark, sf_dir):
    """Transforms, boxes, strips and adjusted boxes of every scan stored in one table, half of the scans again, and read back."""
    import uuid

    def rows(kind, df, ref, cols=BOX, flag=None):
        shown = [F.round(c, 5) for c in cols] + [F.lit(None).cast("double")] * (4 - len(cols))
        return df.select(F.lit(kind).alias("kind"), "scan_id", "page", F.col(ref).cast("string").alias("ref"), *[v.alias(n) for v, n in zip(shown, NUMBERS, strict=True)],
                         (F.col(flag) if flag else F.lit(None).cast("boolean")).alias("flag"))

    found = rects(spark, sf_dir)
    every = rows("transform", complete(spark, sf_dir), "half", TF).unionByName(rows("box", found, "box_id", flag="is_blank"))
    every = every.unionByName(rows("strip", G.margin_strips(found), "box_id")).unionByName(rows("adjusted", adjusted(spark, sf_dir), "box_id", flag="expanded"))
    folder = f"{shared_folder(spark)}/boxes-{uuid.uuid4().hex}"
    every = staged(every, "boxes")
    store.replace(every, folder, ["scan_id"], 1)
    store.replace(every.filter(F.col("scan_id") % 2 == 0), folder, ["scan_id"], 1)
    return store.load(spark, folder, 1)
