"""Fixity audit of archive replicas by Merkle trees over offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.session import staged

#: Bytes of a lowest range, and ranges under one node.
SPAN, FAN = 1 << 16, 16
#: Records of one archive file.
RECORDS = 256


def record(url: Column, body: Column) -> Column:
    """Bytes of a response record: header, body, end; null parts are empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).cast("binary")


def manifest(records: DataFrame, key: str, content: Column, records_per_file: int = RECORDS) -> DataFrame:
    """``key, file, offset, length, digest`` of records laid out in files of consecutive keys.

    Contents are hashed where they are read; only digests and lengths are shuffled. Records of a file follow
    by key, repeated keys by digest; records without a key form files -1, -2, ... by their digest, so that
    no file grows with the table.
    """
    hashed = records.select(F.col(key).alias("key"), F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("digest"))
    spare = -1 - F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
    hashed = hashed.withColumn("file", F.coalesce(F.floor(F.col("key") / records_per_file).cast("long"), spare))
    before = Window.partitionBy("file").orderBy(F.col("key").asc_nulls_last(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select(F.col("key").alias(key), "file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")


def _ranges(leaves: DataFrame) -> DataFrame:
    """Hash of every lowest offset range that has records: over its records in order."""
    lines = F.array_sort(F.collect_list(F.struct("offset", "length", "digest")))
    joined = F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["digest"])), ",")
    return leaves.groupBy("file", F.floor(F.col("offset") / SPAN).alias("node")).agg(F.sha2(joined, 256).alias("hash"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels ``file, node, hash`` of the trees of all files, lowest first; the last has one node to a file.

    ``leaves`` has ``file, offset, length, digest``. A node hashes the numbers and hashes of the nodes under
    it in order, at most ``FAN``. Levels are written, each about a sixteenth of the one below.
    """
    levels = [staged(_ranges(leaves), "tree")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        parts = F.array_sort(F.collect_list(F.struct("node", "hash")))
        joined = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ",")
        above = levels[-1].groupBy("file", F.floor(F.col("node") / FAN).alias("parent")).agg(F.sha2(joined, 256).alias("hash"))
        levels.append(staged(above.withColumnRenamed("parent", "node"), "tree"))
    return levels


def _different(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("hash", "one").join(b.withColumnRenamed("hash", "two"), ["file", "node"], "full")
    return both.where(~F.col("one").eqNullSafe(F.col("two"))).select("file", "node")


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """``file, offset, length, state`` of the records in which two manifests differ.

    Trees of both are compared at their roots; only the branches under differing nodes are descended, level
    by level, down to the records of differing ranges. State: ``altered`` where both have a record at the
    offset but with another length or digest, ``missing`` where the replica has none, ``extra`` where only
    it has one. Repeated rows count once. An empty replica misses everything; equal manifests give no rows.
    """
    columns = ["file", "offset", "length", "digest"]
    leaves = [staged(x.select(*columns).distinct(), "leaves") for x in (original, replica)]
    trees = [tree(x) for x in leaves]
    while len(trees[0]) != len(trees[1]):  # the shorter tree goes on with single nodes
        short = min(trees, key=len)
        short.append(staged(short[-1].select("file", "node", F.sha2(F.concat_ws(":", F.col("node").cast("string"), "hash"), 256).alias("hash")), "tree"))
    differing = staged(_different(trees[0][-1], trees[1][-1]), "differing")
    for one, two in zip(trees[0][-2::-1], trees[1][-2::-1], strict=True):
        under = [x.withColumn("parent", F.floor(F.col("node") / FAN)).join(differing.withColumnRenamed("node", "parent"), ["file", "parent"], "left_semi").drop("parent") for x in (one, two)]
        differing = staged(_different(*under), "differing")
    found = [x.withColumn("node", F.floor(F.col("offset") / SPAN)).join(differing, ["file", "node"], "left_semi").drop("node") for x in leaves]
    one, two = (x.select("file", "offset", F.struct("length", "digest").alias(name)) for x, name in zip(found, ("one", "two"), strict=True))
    both = one.join(two, ["file", "offset"], "full").where(~F.col("one").eqNullSafe(F.col("two")))
    state = F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("altered")
    return both.select("file", "offset", F.coalesce("one.length", "two.length").alias("length"), state.alias("state")).distinct()


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``page_id, url, html`` with damage chosen by the MD5 of the key: bytes changed, cut off, or zeroed away."""
    pick = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    return pages.withColumn("damage", F.when(pick.isin("00", "01", "02", "03"), "changed").when(pick == "04", "cut").when(pick == "05", "gone"))


DAMAGE_SQL = r"""
    with page as (select page_id, strlen('WARC/1.0' || e'\r\n' || 'WARC-Type: response' || e'\r\n' || 'WARC-Target-URI: ' || coalesce(url, '') || e'\r\n' || 'Content-Length: '
          || strlen(coalesce(html, ''))::varchar || e'\r\n\r\n' || coalesce(html, '') || e'\r\n\r\n') as length, page_id // 256 as file, substr(md5(page_id::varchar), 1, 2) as pick from pages),
      laid as (select *, coalesce(sum(length) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from page)
    select page_id, file::bigint as file, "offset", length::bigint as length, case when pick = '05' then 'missing' else 'altered' end as state from laid where pick in ('00', '01', '02', '03', '04', '05')"""
