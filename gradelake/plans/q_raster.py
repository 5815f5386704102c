"""Raster operators: page statistics on embeddings (8 rows of 8 pixels, pages of a scan share ten ids), the others on sheets of the bytes of web pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradelake.operators import raster as R
from gradelake.operators.ordered import rank_in_order
from gradelake.operators.report import rotation_summary
from gradelake.plans.registry import query
from gradelake.session import shared_folder, staged, table
from gradelake.sources import store

PAGE = ["scan_id", "page"]
GREY_SQL = """select vec_id // 20 as scan_id, (vec_id % 20 + 1)::int as page, i, case when label = 0 then 250 + g % 6 else g end as g from (
  select vec_id, label, i, greatest(0, least(255, floor((e::double + 1) * 127.5::double)))::bigint as g from (
    select vec_id, label, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as i from embeddings))"""


def rows(spark, sf_dir):
    """Image rows; pages of label 0 are brightened to near white."""
    grey = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5))).cast("bigint"))
    shown = F.when(F.col("label") == 0, F.transform(grey, lambda g: 250 + g % 6)).otherwise(grey)
    pages = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("scan_id"), (F.col("vec_id") % 20 + 1).cast("int").alias("page"), shown.alias("g"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("g", y * 8 + 1, F.lit(8)))
    row = pages.select(*PAGE, F.posexplode(cut).alias("y", "g"))
    return row.select(*PAGE, "y", F.lit(8).alias("w"), F.lit(8).alias("hh"), F.unhex(F.array_join(F.transform("g", lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("px"))


STATS_SQL = f"""select scan_id, page, count(*)::bigint as pixels, sum(g)::double / count(*) as mean, sqrt((count(*) * sum(g * g) - sum(g) * sum(g))::double) / count(*) as std from ({GREY_SQL}) group by 1, 2"""
FLAGS_SQL = f"select *, mean >= 250 and std <= 6 as blank from ({STATS_SQL})"


def flags(spark, sf_dir):
    return R.with_blank_flag(R.page_stats(rows(spark, sf_dir), PAGE))


@query("agg_raster_stats", f"select scan_id, page, pixels, round(mean, 6) as mean, round(std, 6) as std from ({STATS_SQL})")
def agg_raster_stats(spark, sf_dir):
    return R.page_stats(rows(spark, sf_dir), PAGE).select(*PAGE, "pixels", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("ras_blank_pages", f"select scan_id, page, blank from ({FLAGS_SQL})")
def ras_blank_pages(spark, sf_dir):
    return flags(spark, sf_dir).select(*PAGE, "blank")


STATES_SQL = f"""select scan_id, '{{"schema_version":1,"total_pages":' || count(*) || ',"content_page_nums":[' || coalesce(string_agg(page::varchar, ',' order by page) filter (not blank), '')
  || '],"blank_page_nums":[' || coalesce(string_agg(page::varchar, ',' order by page) filter (blank), '') || '],"page_render_sizes":[' || string_agg('[8,' || (8 + page) || ']', ',' order by page)
  || '],"blank_mean":250,"blank_std":6,"use_tesseract_rotation":false,"analysis_dpi":150}}' as state from (select scan_id, page::bigint as page, blank from ({FLAGS_SQL})) group by 1"""


def blank_store(spark, sf_dir):
    """States written twice, as a repeated run does, and read from the table."""
    sized = flags(spark, sf_dir).select(*PAGE, "blank", F.lit(8).alias("w"), (F.col("page") + 8).alias("h"))
    states, folder = R.blank_states(sized, use_osd=False, dpi=150), f"{shared_folder(spark)}/blanks-{uuid.uuid4().hex}"
    store.replace(states, folder, ["scan_id"], R.BLANKS_VERSION)
    store.replace(states.filter(F.col("scan_id") % 2 == 0), folder, ["scan_id"], R.BLANKS_VERSION)
    return store.load(spark, folder, R.BLANKS_VERSION)


@query("sink_scan_blanks", STATES_SQL)
def sink_scan_blanks(spark, sf_dir):
    return blank_store(spark, sf_dir).select("scan_id", "state")


@query("src_scan_blanks", f"select scan_id, page::bigint as page, blank, 8::int as w, (8 + page)::int as h from ({FLAGS_SQL}) where scan_id % 3 <> 0")
def src_scan_blanks(spark, sf_dir):
    """Stored states back as pages; every third one is of another version and is rejected."""
    other = F.when(F.col("scan_id") % 3 == 0, F.replace("state", F.lit('"schema_version":1'), F.lit('"schema_version":2'))).otherwise(F.col("state"))
    return R.read_blank_states(blank_store(spark, sf_dir).withColumn("state", other))[0]


META_SQL = """select p_partkey // 25 as scan_id, (p_partkey % 25 + 1)::int as page, 600 + p_size as w, case when (p_partkey // 25) % 4 = 0 then 500 when (p_partkey // 25) % 4 = 1 then 900 else 620 end as h,
    case when (p_partkey // 25) % 4 = 1 then 90 * ((p_partkey // 25) % 3) else 90 * (p_size % 4) end as rotate from part"""


def meta(spark, sf_dir):
    k = F.col("p_partkey")
    scan = F.floor(k / 25)
    return table(spark, sf_dir, "part").select(
        scan.alias("scan_id"), (k % 25 + 1).cast("int").alias("page"), (F.col("p_size") + 600).alias("w"),
        F.when(scan % 4 == 0, 500).when(scan % 4 == 1, 900).otherwise(620).alias("h"),
        F.when(scan % 4 == 1, 90 * (scan % 3)).otherwise((90 * (F.col("p_size") % 4)).cast("bigint")).alias("rotate"),
        (90 * (k % 4)).alias("osd_rotate"), (F.col("p_size") / 10).alias("osd_conf"))


ROT_SQL = f"select *, w > h as landscape, case when w > h then 0 else rotate % 360 end as rotation from ({META_SQL})"


@query("ras_orientation", f"""select scan_id, page, rotation::bigint as rotation, osd_rotation::bigint as osd_rotation from (select r.scan_id, r.page, rotation,
  (rotate + case when p_size / 10.0::double < 2 then 0 else 90 * (p_partkey % 4) end) % 360 as osd_rotation from ({ROT_SQL}) r join part on p_partkey // 25 = r.scan_id and p_partkey % 25 + 1 = r.page)""")
def ras_orientation(spark, sf_dir):
    pages = meta(spark, sf_dir)
    plain = R.rotations(pages).select(*PAGE, F.col("rotation").cast("bigint").alias("rotation"))
    return plain.join(R.rotations(pages, use_osd=True).select(*PAGE, F.col("rotation").cast("bigint").alias("osd_rotation")), PAGE)


@query("agg_rotation_summary", f"""
with r as (select scan_id, rotation, count(*) as n, count(*) filter (landscape) as land from ({ROT_SQL}) group by 1, 2),
s as (select scan_id, sum(n)::bigint as kept, sum(land)::bigint as landscape, count(*) as kinds, min(rotation) as only_deg, string_agg(n || ' at ' || rotation || '°', ', ' order by rotation) as parts from r group by 1)
select scan_id, kept, landscape, case when landscape = kept then 'All ' || kept || ' pages corrected from landscape to portrait' when landscape > 0 then landscape || ' of ' || kept || ' pages corrected from landscape to portrait'
  when kinds = 1 and only_deg = 0 then 'All pages already upright' when kinds = 1 then 'All pages at ' || only_deg || '°' else 'Mixed orientation: ' || parts end as summary from s""")
def agg_rotation_summary(spark, sf_dir):
    kept = R.rotations(meta(spark, sf_dir)).select("scan_id", F.col("rotation").cast("bigint").alias("rotation"), "landscape")
    return rotation_summary(kept)


OTSU_SQL = f"""select scan_id, page, arg_max(g, (score, -g)) as threshold from (
  select *, case when n1 < n then (n * s1 - n1 * s)::double * (n * s1 - n1 * s)::double / (n1::double * (n - n1)::double) else 0.0::double end as score from (
    select scan_id, page, g, sum(c) over w as n1, sum(g * c) over w as s1, sum(c) over (partition by scan_id, page) as n, sum(g * c) over (partition by scan_id, page) as s
    from (select scan_id, page, g, count(*) as c from ({GREY_SQL}) group by 1, 2, 3) window w as (partition by scan_id, page order by g))) group by 1, 2"""


@query("ras_otsu_threshold", OTSU_SQL)
def ras_otsu_threshold(spark, sf_dir):
    return R.otsu(rows(spark, sf_dir), PAGE)


# ---- sheets: the bytes of the web pages of a hundred numbers below each other, 400 to a row; blanks and line ends are ink ----

WIDTH = 400
PER_SHEET = 100


def _sheet_px(shown: str) -> str:
    """Grey values ``sheet, y, x, g`` of all sheets; ``shown`` gives the grey at ``sheet, y, x`` from that of the text, ``g``."""
    return f"""select sheet, y, x, {shown} as g from (
      select sheet, y, i as x, case when length(h) >= 2 * i + 2 then ('0x' || substr(h, (2 * i + 1)::int, 2))::int else 255 end as g
      from (select sheet, y, h, unnest(range({WIDTH})) as i from (
        select page_id // {PER_SHEET} as sheet, row_number() over (partition by page_id // {PER_SHEET} order by page_id, p) - 1 as y, substr(t, (p * {2 * WIDTH} + 1)::int, {2 * WIDTH}) as h
        from (select page_id, t, unnest(range((length(t) + {2 * WIDTH - 1}) // {2 * WIDTH})) as p from (select page_id, hex(encode(html)) as t from pages)))))"""


def sheets(spark, sf_dir, lines=False):
    """Image rows ``sheet, y, hh, px``; with ``lines`` two printed lines stand on every second sheet, one of them broken."""
    text = F.col("html").cast("binary")
    piece = table(spark, sf_dir, "pages").where(F.octet_length("html") > 0).select(
        F.floor(F.col("page_id") / PER_SHEET).alias("sheet"), "page_id", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.octet_length("html") - 1) / WIDTH).cast("int")), lambda p: F.substring(text, p * WIDTH + 1, F.lit(WIDTH)))).alias("p", "px"))
    rows_ = rank_in_order(piece.withColumn("_b", F.floor(F.col("page_id") / 10)), ["sheet"], "_b", [F.col("page_id"), F.col("p")], "no")
    rows_ = rows_.select("sheet", (F.col("no") - 1).cast("int").alias("y"), F.rpad("px", WIDTH, F.lit(b"\xff")).alias("px"))
    if lines:
        black = lambda px, x, w: F.concat(F.substring(px, 1, x), F.lit(bytes(w)), F.substring(px, x + w + 1, WIDTH))
        one = black(F.col("px"), 200, 2)
        px = F.when(F.col("sheet") % 2 == 0, F.when(F.col("y") % 700 < 650, black(one, 100, 3)).otherwise(one)).otherwise(F.col("px"))
        rows_ = rows_.withColumn("px", px)
    rows_ = staged(rows_, "sheets")
    return rows_.join(rows_.groupBy("sheet").agg((F.max("y") + 1).cast("int").alias("hh")), "sheet")


LINES_SHOWN = "case when sheet % 2 = 0 and (x in (200, 201) or (y % 700 < 650 and x between 100 and 102)) then 0 else g end"


def _otsu_sql(px: str, unit: str) -> str:
    return f"""select {unit}, arg_max(g, (score, -g)) as t from (
      select *, case when n1 < n then (n * s1 - n1 * s)::double * (n * s1 - n1 * s)::double / (n1::double * (n - n1)::double) else 0.0::double end as score from (
        select {unit}, g, sum(c) over w as n1, sum(g * c) over w as s1, sum(c) over (partition by {unit}) as n, sum(g * c) over (partition by {unit}) as s
        from (select {unit}, g, count(*) as c from {px} group by all) window w as (partition by {unit} order by g))) group by {unit}"""


def _sweep_sql(ink: str, angles: str) -> str:
    """Best angle of every half over ``angles(sheet, half, a)`` for the points ``ink(sheet, half, x, y, w, h)``."""
    return f"""select sheet, half, arg_max(a, (v, -a)) as angle from (select sheet, half, a, any_value(w) * sum(c * c) - sum(c) * sum(c) as v from (
      select sheet, half, a, w, nx, count(*) as c from (
        select p.sheet, p.half, a, w, h, floor(w // 2 + cos(radians(a / 100.0::double)) * (x - w // 2) + sin(radians(a / 100.0::double)) * (y - h // 2) + 0.5::double) as nx,
          floor(h // 2 - sin(radians(a / 100.0::double)) * (x - w // 2) + cos(radians(a / 100.0::double)) * (y - h // 2) + 0.5::double) as ny
        from {ink} p join {angles} g on p.sheet = g.sheet and p.half = g.half)
      where nx >= 0 and nx < w and ny >= 0 and ny < h group by all) group by 1, 2, 3) group by 1, 2"""


@query("ras_deskew_angle", f"""
with px as materialized ({_sheet_px(LINES_SHOWN)}), hs as (select sheet, max(y) + 1 as hh from px group by 1),
hp as materialized (select sheet, case when y < hh // 2 then 'top' else 'bot' end as half, case when y < hh // 2 then y else y - hh // 2 end as y, x, g, {WIDTH} as w,
  case when y < hh // 2 then hh // 2 else hh - hh // 2 end as h from px join hs using (sheet)),
ink as materialized (select sheet, half, x, y, w, h from hp join ({_otsu_sql('hp', 'sheet, half')}) using (sheet, half) where g <= t),
qp as materialized (select sheet, half, x // 4 as x, y // 4 as y, w // 4 as w, h // 4 as h, (case when abs(avg(g) - floor(avg(g)) - 0.5) < 1e-9 then 2 * round(avg(g) / 2) else round(avg(g)) end)::bigint as g
  from hp where w // 4 >= 80 and h // 4 >= 80 and y // 4 < h // 4 group by 1, 2, 3, 4, 5, 6),
ci as materialized (select sheet, half, x, y, w, h from qp join ({_otsu_sql('qp', 'sheet, half')}) using (sheet, half) where g <= t
  union all select * from ink where not (w // 4 >= 80 and h // 4 >= 80)),
u as (select distinct sheet, half from ci), g1 as (select u.*, a from u, (select unnest(range(-300, 301, 10)) as a)),
c as ({_sweep_sql('ci', 'g1')}),
g2 as (select sheet, half, unnest(range(greatest(-300, angle - 15), least(300, angle + 15) + 1)) as a from c),
f as ({_sweep_sql('ink', 'g2')})
select sheet, half, angle::bigint as angle, abs(angle) >= 5 as rotate from f""")
def ras_deskew_angle(spark, sf_dir):
    rows_ = sheets(spark, sf_dir, lines=True)
    heights = rows_.select("sheet", F.col("hh").alias("h")).distinct()
    halved = R.page_halves(rows_.drop("hh"), heights, ["sheet"])
    return R.skew_angles(staged(halved, "halves"), ["sheet", "half"])


# ---- printed lines, blobs and handwriting on the sheets ----

INK_SQL = f"""px as materialized ({_sheet_px(LINES_SHOWN)}), hs as (select sheet, max(y) + 1 as hh from px group by 1),
ink as materialized (select sheet, y, x, hh from px join ({_otsu_sql('px', 'sheet')}) using (sheet) join hs using (sheet) where g <= t),
runs as materialized (select sheet, x, min(y) as y0, max(y) as y1, any_value(hh) as hh, max(y) - min(y) + 1 as len from (
  select *, y - row_number() over (partition by sheet, x order by y) as grp from ink) group by sheet, x, grp)"""


def _outlast(k: str) -> str:
    return f"len >= case when y0 = 0 and y1 = hh - 1 then 1 when y0 = 0 then ({k} - 1 - {k} // 2) * 2 + 1 when y1 = hh - 1 then {k} // 2 * 2 + 1 else 2 * {k} - 1 end"


def sheet_ink(spark, sf_dir, lines=True):
    grey = sheets(spark, sf_dir, lines)
    return R.ink_rows(grey, R.otsu(grey, ["sheet"]), ["sheet"], ["hh"])


@query("ras_vline_mask", f"""with {INK_SQL} select sheet, x - 4 as x0, x + 4 as x1, y0, y1 from (select *, greatest(hh // 10, 20) as k from runs) where {_outlast('k')}""")
def ras_vline_mask(spark, sf_dir):
    ink = staged(sheet_ink(spark, sf_dir), "ink")
    return R.vline_rects(R.vertical_runs(ink, ["sheet"], R.shortest_inside(R.MASK_MIN_KERNEL)), ink.select("sheet", "hh").distinct(), ["sheet"])


@query("ras_ruling_lines", f"""
with recursive {INK_SQL}, s as materialized (select * from runs where {_outlast(str(R.RULE_KERNEL))}),
t as materialized (select a.sheet, a.x, a.y0, b.x as bx, b.y0 as by0 from s a join s b on a.sheet = b.sheet and abs(a.x - b.x) = 1 and b.y0 <= a.y1 + 1 and b.y1 >= a.y0 - 1),
w as (select sheet, x, y0, x as rx, y0 as ry from s union select t.sheet, t.bx, t.by0, w.rx, w.ry from w join t on w.sheet = t.sheet and w.x = t.x and w.y0 = t.y0),
g as (select sheet, x, y0, min((rx, ry)) as grp from w group by 1, 2, 3),
b as (select s.sheet, hh, grp, min(s.x) as x0, max(s.x) as x1, min(s.y0) as y0, max(y1) as y1 from s join g on s.sheet = g.sheet and s.x = g.x and s.y0 = g.y0 group by 1, 2, 3),
l as (select sheet, hh, x0 + (x1 - x0 + 1) // 2 as xc, row_number() over (partition by sheet order by x0 + (x1 - x0 + 1) // 2) as i from b where y1 - y0 + 1 > hh * 0.3 and x1 - x0 + 1 < 30),
f as (select sheet, hh, 1::bigint as i, [xc] as xs from l where i = 1
  union all select f.sheet, f.hh, l.i, case when l.xc - f.xs[-1] <= 10 then list_append(f.xs[1:len(f.xs) - 1], (f.xs[-1] + l.xc) // 2) else list_append(f.xs, l.xc) end from f join l on l.sheet = f.sheet and l.i = f.i + 1),
m as (select sheet, any_value(hh) as hh, arg_max(xs, i) as xs from f group by 1), c as (select sheet, hh, len(xs) as lines, unnest(xs) as xc from m),
e as (select sheet, hh, lines, xc, y, y - row_number() over (partition by sheet, xc order by y) as grp from (select distinct c.*, y from c join ink using (sheet) where ink.x between xc - 4 and xc + 4)),
r as (select sheet, xc, min(y) as a, max(y) as b from (select sheet, xc, y, grp, count(*) over (partition by sheet, xc, grp) as n from e) where n >= 8 group by 1, 2)
select c.sheet, c.xc as x_center, coalesce(a, 0)::bigint as y_start, coalesce(b, hh - 1)::bigint as y_end, lines::int as lines from c left join r using (sheet, xc)""")
def ras_ruling_lines(spark, sf_dir):
    return R.ruling_lines(staged(sheet_ink(spark, sf_dir), "ink"), ["sheet"]).select("sheet", "x_center", "y_start", "y_end", "lines")


@query("win_run_endpoints", f"""
with {INK_SQL}, u as (select sheet, hh, unnest([101, 300]) as xc from hs),
e as (select sheet, xc, y, y - row_number() over (partition by sheet, xc order by y) as grp from (select distinct u.sheet, xc, y from u join ink using (sheet) where ink.x between xc - 1 and xc + 1)),
r as (select sheet, xc, min(y) as a, max(y) as b from (select sheet, xc, y, count(*) over (partition by sheet, xc, grp) as n from e) where n >= 8 group by 1, 2)
select u.sheet, u.xc::int as x_center, coalesce(a, 0)::bigint as y_start, coalesce(b, hh - 1)::bigint as y_end from u left join r using (sheet, xc)""")
def win_run_endpoints(spark, sf_dir):
    df = sheet_ink(spark, sf_dir).select("sheet", "y", "hh", "ink", F.explode(F.array(F.lit(101), F.lit(300))).alias("x_center"))
    hit = F.instr(F.substring(F.col("ink").cast("string"), F.col("x_center"), F.lit(3)), "\x01") > 0
    return R.run_endpoints(df.withColumn("hit", hit), ["sheet", "x_center"])


def _blobs_sql(ink: str, unit: str) -> str:
    """CTEs from points ``ink(unit, y, x)`` to 8-connected blobs ``blobs(unit, root, area)`` over horizontal runs."""
    on = " and ".join(f"a.{c} = b.{c}" for c in unit.split(", "))
    return f"""hr as materialized (select *, row_number() over (order by {unit}, y, a) as id from (select {unit}, y, min(x) as a, max(x) as b from (
      select *, x - row_number() over (partition by {unit}, y order by x) as grp from {ink}) group by {unit}, y, grp)),
    ed as materialized (select a.id as p, b.id as q from hr a join hr b on {on} and b.y = a.y + 1 and b.a <= a.b + 1 and b.b >= a.a - 1),
    bo as materialized (select p, q from ed union all select q, p from ed),
    cl as (select id, id as root from hr union select bo.q, cl.root from cl join bo on cl.id = bo.p where cl.root < bo.q),
    ro as materialized (select id, min(root) as root from cl group by 1),
    blobs as (select {", ".join("hr." + c for c in unit.split(", "))}, root, sum(b - a + 1) as area from hr join ro using (id) group by all)"""


@query("ras_blob_filter", f"""with recursive {INK_SQL.replace(LINES_SHOWN, 'g')}, {_blobs_sql('ink', 'sheet')}
select sheet, count(*)::bigint as blobs, sum(area)::bigint as ink from blobs where area >= {R.MIN_BLOB} group by 1""")
def ras_blob_filter(spark, sf_dir):
    blobs = R.blob_areas(sheet_ink(spark, sf_dir, lines=False), ["sheet"])
    return blobs.filter(F.col("area") >= R.MIN_BLOB).groupBy("sheet").agg(F.count("*").alias("blobs"), F.sum("area").alias("ink"))


STRIP_BOXES = [(0, 90, 20, 120, 300), (1, 190, 0, 210, 10_000), (2, 300, 100, 301, 130), (3, 500, 0, 600, 50)]


@query("ras_handwriting_flag", f"""
with recursive px as materialized ({_sheet_px(LINES_SHOWN)}),
bx as (select * from (values {", ".join(map(str, STRIP_BOXES))}) b(box_id, x0, y0, x1, y1)),
sp as materialized (select sheet, box_id, y - y0 as y, x - x0 as x, g, n from px join bx on x >= x0 and x < x1 and y >= y0 and y < y1 join (select sheet, max(y) + 1 as n from px group by 1) using (sheet)),
sz as (select sheet, box_id, count(*) as pixels, max(y) + 1 as hh from sp group by 1, 2),
ink as materialized (select sheet, box_id, y, x, hh from sp join sz using (sheet, box_id) join ({_otsu_sql('sp', 'sheet, box_id')}) using (sheet, box_id) where g <= t),
runs as (select sheet, box_id, x, min(y) as y0, max(y) as y1, any_value(hh) as hh, max(y) - min(y) + 1 as len, greatest(any_value(hh) // 10, 20) as k from (
  select *, y - row_number() over (partition by sheet, box_id, x order by y) as grp from ink) group by sheet, box_id, x, grp),
cut as (select * from runs where {_outlast('k')}),
cleaned as materialized (select i.* from ink i anti join cut c on i.sheet = c.sheet and i.box_id = c.box_id and i.x between c.x - 4 and c.x + 4 and i.y between c.y0 and c.y1),
{_blobs_sql('cleaned', 'sheet, box_id')},
kept as (select sheet, box_id, sum(area) as ink from blobs where area >= {R.MIN_BLOB} group by 1, 2)
select sheet, box_id::int as box_id, pixels::bigint as pixels, coalesce(ink, 0)::bigint as ink, coalesce(ink, 0) / pixels > {R.MIN_INK_SHARE} as has_handwriting from sz left join kept using (sheet, box_id)""")
def ras_handwriting_flag(spark, sf_dir):
    """Flags of strips cut from the sheets; a strip that ends below its sheet is as high as the sheet lets it be."""
    rows_ = sheets(spark, sf_dir, lines=True)
    boxes = rows_.groupBy("sheet").agg(F.max("hh").alias("h")).select("sheet", "h", F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("box_id", "px0", "py0", "px1", "py1"), b, strict=True)]) for b in STRIP_BOXES])).alias("b"))
    boxes = boxes.select("sheet", "b.box_id", "b.px0", "b.py0", F.least("b.px1", F.lit(WIDTH)).alias("px1"), F.least("b.py1", "h").alias("py1"))
    strips = staged(R.strip_rows(rows_.drop("hh"), boxes, ["sheet"]), "strips")
    return R.detect_handwriting(strips, ["sheet", "box_id"]).select("sheet", "box_id", "pixels", "ink", "has_handwriting")


@query("win_merge_close_lines", """
with recursive s as (select p_partkey // 20 as unit, row_number() over (partition by p_partkey // 20 order by p_size * 6, p_partkey) as i, (p_size * 6)::bigint as x from part),
f as (select unit, 1::bigint as i, [x] as xs from s where i = 1
  union all select f.unit, s.i, case when s.x - f.xs[-1] <= 10 then list_append(f.xs[1:len(f.xs) - 1], (f.xs[-1] + s.x) // 2) else list_append(f.xs, s.x) end from f join s on s.unit = f.unit and s.i = f.i + 1)
select unit, array_to_string(arg_max(xs, i), ',') as xs from f group by 1""")
def win_merge_close_lines(spark, sf_dir):
    # A unit is the half page of a scan; it shows a handful of lines.
    units = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("unit")).agg(F.collect_list((F.col("p_size") * 6).cast("bigint")).alias("xs"))
    return units.select("unit", F.array_join(F.transform(R.merged_positions(F.col("xs")), lambda x: x.cast("string")), ",").alias("xs"))


@query("ras_anchor_select", """
with c as (select p_partkey // 16 as scan_id, (p_partkey // 8) % 2 as page, case when p_size % 2 = 0 then 'top' else 'bot' end as half, case when p_partkey % 2 = 0 then 'left' else 'right' end as side,
    p_size * 30 as x, (p_partkey * 37) % 400 as y, 51 as tw, 21 as th, (p_retailprice - 900) % 1 as score from part),
b as (select scan_id, page, half, side, arg_max({'x': x, 'y': y, 's': score}, (score, -y, -x)) filter (y + th <= 350) as b from c group by 1, 2, 3, 4)
select scan_id, page, half, side, case when b.s >= 0.5 then b.x + 25 end::bigint as x, case when b.s >= 0.5 then b.y + 10 end::bigint as y, case when b.s >= 0.5 then round(b.s, 3) end as score from b""")
def ras_anchor_select(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    found = table(spark, sf_dir, "part").select(
        F.floor(k / 16).alias("scan_id"), (F.floor(k / 8) % 2).alias("page"), F.when(size % 2 == 0, "top").otherwise("bot").alias("half"),
        F.when(k % 2 == 0, "left").otherwise("right").alias("side"), (size * 30).alias("x"), (k * 37 % 400).alias("y"), F.lit(51).alias("tw"), F.lit(21).alias("th"),
        ((F.col("p_retailprice") - 900) % 1).alias("score"))
    return R.selected_anchors(found)
