"""Boilerplate lines by their share of a site's pages; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import free_name
from gradelake.session import staged

RATIO = 0.02
MIN_PAGES = 3
#: Largest share of its characters in lines that a page may lose where whole pages are spared.
SPARED = 0.5
#: Groups of a site's pages in a join.
SALTS = 8

_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_BLOCKS = r"(?i)</?(?:p|br|hr|div|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|article|aside|header|footer|main|nav|section|title|head|body|html|blockquote|pre)\b[^<>]*>"
_TAGS = r"<[^<>]*>"


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(found, F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible lines of a page: text between block tags, trimmed, without empty ones; none for null."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCKS, "\n"), _TAGS, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def text_lines(text: Column) -> Column:
    """Lines of a plain text as they are; one empty line for null."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit("line"), line).alias("y"))


def boilerplate(pages: DataFrame, site: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site, common``: digests of the lines on more than ``ratio`` of a site's pages, and on ``min_pages`` at least.

    A page counts once for a line, however often it has it. Lines are told apart by 128-bit digests, so no
    text is shuffled, and counts are summed before the shuffle. The list of a site holds fewer than its mean
    number of lines per page divided by ``ratio``, whatever the number of its pages. Blank lines and pages
    without a site take no part.
    """
    each = pages.select(site.alias("site"), lines.alias("lines")).where("site is not null")
    totals = each.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    digests = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _digest))
    seen = each.select("site", F.explode(digests).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    often = seen.where(F.col("n") >= min_pages).join(totals, "site").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("site").agg(F.collect_list("line").alias("common"))


def _characters(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(F.trim(x)))


def drop_lines(
    pages: DataFrame, site: Column, lines: Column, out: str = "lines", ratio: float = RATIO, min_pages: int = MIN_PAGES, spare_whole: bool = False
) -> DataFrame:
    """The pages with two more columns: ``out``, the lines that stay in order, and ``<out>_dropped``, how many went.

    Repeated pages count each. A page without a site keeps all lines; with ``spare_whole`` so does a page that
    would lose more than ``SPARED`` of the characters of its trimmed lines, as near copies of one text would
    that are many on a site. Columns that the names would hide are replaced; an empty table gives no rows.
    """
    key, salt = free_name(pages, "__site"), free_name(pages, "__salt")
    # Written, so that Spark knows its size and sends it to all tasks where its limit allows; else the pages of a site are dealt to SALTS groups.
    found = staged(boilerplate(pages, site, lines, ratio, min_pages), "boilerplate")
    found = found.select(F.col("site").alias(key), F.col("common").alias("__common"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    all_, kept = F.col("__lines"), F.col("__kept")
    rows = pages.withColumns({key: site, salt: (F.monotonically_increasing_id() % SALTS).cast("int")}).join(found, [key, salt], "left").withColumn("__lines", lines)
    rows = rows.withColumn("__kept", F.when(F.col("__common").isNull(), all_).otherwise(F.filter(all_, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__common"), _digest(x)))))
    if spare_whole:
        rows = rows.withColumn("__kept", F.when(_characters(kept) >= (1 - SPARED) * _characters(all_), kept).otherwise(all_))
    rows = rows.withColumns({out: kept, f"{out}_dropped": F.size(all_) - F.size(kept)})
    return rows.drop(key, salt, "__common", "__lines", "__kept")


def site_relative_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB twin over ``pages``."""
    return rf"""
    with page as (select page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '') as host,
        regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', chr(10), 'g'), '{_BLOCKS}', chr(10), 'g'), '{_TAGS}', '', 'g') as plain,
        row_number() over () as r from pages),
      split as (select *, list_filter(list_transform(string_split(plain, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as lines from page),
      total as (select host, count(*) as pages from page group by 1),
      seen as (select host, line, count(*) as n from (select distinct r, host, unnest(lines) as line from split) group by 1, 2),
      common as (select s.host, list(s.line) as common from seen s join total t on s.host = t.host where n >= {min_pages} and n > {ratio}::double * pages group by 1),
      kept as (select s.*, case when c.common is null then lines else list_filter(lines, lambda x: not list_contains(c.common, x)) end as kept
        from split s left join common c on s.host = c.host)
    select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped, array_to_string(kept, chr(10)) as kept_text from kept"""
