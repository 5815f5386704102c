"""Near-duplicate texts by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.components import components
from gradelake.llm.shared import small_batches
from gradelake.session import staged

SEED = 42
SEGMENT = 32
#: Index entries of a segment value from which its links are found over common neighbours instead of pairs.
CROWDED = 64
_BLOCK = 1 << 15


def text_fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the word shingles of a text as a signed 64-bit number; zero without words."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if len(tokens) >= shingle:
        grams = tokens if shingle == 1 else map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
    else:
        grams = [b" ".join(tokens)] if tokens else []
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        part = hashes[start:start + _BLOCK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """64-bit SimHash of lower-cased word shingles, repeats included; null and empty texts give zero."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return simhash(text)


def links(codes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``a, b`` of distinct 64-bit ``code`` that connect all codes differing in one or two bits.

    Multi-index hashing with two segments of 32 bits: a pair at distance two or less agrees on the low
    segment but for one bit, or else on the whole high segment. The low segment's ball of radius one and
    the high segment's own value are looked up in tables by segment value, and the whole distance is
    verified. From a pair that differs in one low bit, only the code with the zero there looks it up.

    Segment values with more than ``crowded`` codes would give pairs in the square of their number. All
    codes that look up such a value, or stand under it, meet over common neighbours instead: two codes
    differ in two bits or less just when some third value is within one bit of either, so the 65 values
    near each code form groups of which every member is linked to the smallest one. That is exact and
    linear, and leaves out only pairs that the smallest member already connects.
    """
    low, high = F.expr("code & 4294967295"), F.expr("shiftrightunsigned(code, 32)")
    ball = F.expr(
        "transform(filter(sequence(0, 31), b -> shiftright(code, b) & 1 = 0), b -> (code & 4294967295) | shiftleft(1L, b))"
    )
    own = F.array(F.struct(F.lit(0).alias("segment"), low.alias("value")), F.struct(F.lit(1).alias("segment"), high.alias("value")))
    table = codes.select("code", F.explode(own).alias("k")).select("code", "k.*")
    near = F.transform(ball, lambda v: F.struct(F.lit(0).alias("segment"), v.alias("value")))
    probes = codes.select("code", F.explode(F.concat(own, near)).alias("k")).select("code", "k.*")
    hot = staged(table.groupBy("segment", "value").count().where(F.col("count") > crowded).select("segment", "value"), "crowded")

    key = ["segment", "value"]
    other = table.join(hot, key, "left_anti").withColumnRenamed("code", "other")
    found = probes.join(hot, key, "left_anti").join(other, key).where("code <> other and bit_count(code ^ other) <= 2")
    pairs = found.select(F.greatest("code", "other").alias("a"), F.least("code", "other").alias("b"))

    dense = probes.join(hot, key, "left_semi").select("code").distinct()
    around = dense.select("code", F.explode(F.expr("concat(array(code), transform(sequence(0, 63), b -> code ^ shiftleft(1L, b)))")).alias("value"))
    first = around.groupBy("value").agg(F.min("code").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "b")
    stars = around.join(first, "value").where("code <> b").select(F.col("code").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def _members(documents: DataFrame, key: str, text: str, shingle: int, crowded: int) -> DataFrame:
    """``key, code, root, reached`` of each row; the root is some code of its component."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(key).cast("long").alias("key"), fingerprint(F.col(text), shingle).alias("code"))
    rows = staged(rows, "fingerprints")
    codes = staged(rows.groupBy("code").agg(F.min("key").alias("least")), "codes")
    member = staged(components(links(codes.select("code"), crowded)).withColumnRenamed("node", "code"), "members")
    least = member.join(codes, "code").groupBy("root").agg(F.min("least").alias("reached"))
    reached = member.join(least, "root")
    whole = codes.join(reached, "code", "left").select("code", F.coalesce("root", "code").alias("root"), F.coalesce("reached", "least").alias("reached"))
    return rows.join(whole, "code")


def groups(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, crowded: int = CROWDED) -> DataFrame:
    """``key, fingerprint, component_id`` of each row: the smallest key that links of two bits or less reach.

    Equal fingerprints are folded before any pairing. Null and empty texts have fingerprint zero, which
    links like any other; a null key is never the smallest, and stands alone only where a component has no
    other key; repeated keys and rows each keep their row. An empty table gives no rows; further columns of
    the input, whatever their names, aren't read.
    """
    found = _members(documents, key, text, shingle, crowded)
    return found.select(F.col("key").alias(key), F.col("code").alias("fingerprint"), F.col("reached").alias("component_id"))


def hexadecimal(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))
