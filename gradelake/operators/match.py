"""Matching of read names to rosters and of folder hints to catalogues.

A scan of up to ``LISTED`` names meets each of its reads with the list of them, in one join. In larger scans no pair of
a read and a candidate is formed before a shared key has been found:

* equal names join on the name,
* containment joins on the rarest three characters of the shorter text,
* similarity joins on the rare part of the numbered characters (prefix filter of a set join).
  A ratio of at least ``MIN_RATIO`` needs that many common characters, so no match is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gradelake.functions.replies import FAILED_NAME, NO_NAME
from gradelake.functions.text import strip
from gradelake.session import staged

# Acceptance of a similar name, floor for containment, words of exam folders.
MIN_RATIO = 0.6
CONTAINED_RATIO = 0.75
EXAM_WORDS = ("test", "exam")
LISTED = 256


@F.pandas_udf(DoubleType())
def seq_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; not symmetric, the read or hint goes left."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def _ratio(a: str, b: str) -> float:
    """The ratio where it can reach ``MIN_RATIO``, else 0; both quick ratios are bounds from above."""
    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= MIN_RATIO and m.quick_ratio() >= MIN_RATIO else 0.0


@F.pandas_udf(ArrayType(DoubleType()))
def _list_ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([[_ratio(a, b) for b in many] for a, many in zip(left, right, strict=True)], dtype="object")


# A filter on the ratios would else be moved below them and compute them twice.
list_ratios = _list_ratios.asNondeterministic()

GRAM = 3


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct substrings of the given few lengths, and the empty one."""
    def of_size(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of_size(n) for n in sizes]))


def _merged(df: DataFrame) -> DataFrame:
    """Joined by shuffle and merge alone: Spark takes exploded rows for as few as their source's and would send them to every task."""
    return df.hint("merge")


def _holding(needles: DataFrame, hay: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs ``keys, n, h`` of texts of which the second contains the first.

    A needle is looked up by the one of its grams (of three characters, or all of a shorter needle) that the fewest texts
    have, so grams grow with the length of the texts and common ones make no pairs. Shorter grams are cut only where a
    shorter needle asks for them.
    """
    keys = list(keys)
    brief = needles.filter(F.length("n") < GRAM).select(*keys).distinct()
    whole = hay.select(*keys, "h", F.explode(_grams(F.col("h"), [GRAM])).alias("g")).filter(F.length("g") == GRAM)
    parts = (_merged(hay).join(brief, keys, "left_semi").select(*keys, "h", F.explode(_grams(F.col("h"), range(1, GRAM))).alias("g"))
             .filter(F.length("g") < GRAM))
    found = whole.unionByName(parts)
    often = found.groupBy(*keys, "g").agg(F.count("*").alias("df"))
    size = F.least(F.length("n"), F.lit(GRAM))
    own = F.filter(_grams(F.col("n"), range(1, GRAM + 1)), lambda g: F.length(g) == size)
    rarest = (_merged(needles.select(*keys, "n", F.explode(own).alias("g"))).join(often, [*keys, "g"], "left")
              .groupBy(*keys, "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r")))
    keyed = rarest.filter(F.col("r.df") > 0).select(*keys, "n", F.col("r.g").alias("g"))
    return _merged(keyed).join(found, [*keys, "g"]).filter(F.contains("h", "n")).select(*keys, "n", "h")


def _numbered_chars(text: Column) -> Column:
    """Characters with their running number (``e1``, ``e2`` …), so that sets count repeats."""
    chars = F.split(text, "")
    return F.transform(chars, lambda c, i: F.concat(
        c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def contained(reads: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earliest candidate of which the read is a part, or which is a part of the read.

    ``reads`` has ``keys, low``; ``names`` has ``keys, clow, first`` with ``first`` =
    ``struct(pos, cand)``, one row per name.
    """
    keys = list(keys)
    as_read, as_name = reads.select(*keys, "low"), names.select(*keys, "clow")
    inside = _holding(as_read.withColumnRenamed("low", "n"), as_name.withColumnRenamed("clow", "h"), keys)
    inside = _merged(inside.withColumnsRenamed({"n": "low", "h": "clow"})).join(names, [*keys, "clow"]).groupBy(*keys, "low").agg(F.min("first").alias("inside"))
    around = _holding(as_name.withColumnRenamed("clow", "n"), as_read.withColumnRenamed("low", "h"), keys)
    around = _merged(around.withColumnsRenamed({"h": "low", "n": "clow"})).join(names, [*keys, "clow"]).groupBy(*keys, "low").agg(F.min("first").alias("around"))
    return _merged(inside).join(around, [*keys, "low"], "full").select(*keys, "low", F.least("inside", "around").alias("first"))


def similar(reads: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs ``keys, low, clow, first, ratio`` with a ratio of at least ``MIN_RATIO``."""
    keys = list(keys)
    left = reads.select(*keys, F.col("low").alias("s")).withColumn("toks", _numbered_chars(F.col("s")))
    right = names.select(*keys, F.col("clow").alias("s"), "first").withColumn("toks", _numbered_chars(F.col("s")))
    freq = (right.select(*keys, F.explode("toks").alias("t")).groupBy(*keys, "t").agg(F.count("*").alias("df")))

    def prefixed(side: DataFrame, extra: Sequence[str]) -> DataFrame:
        # Common characters >= 3/7 of either length, so the rarest 4/7 (+1) must share one.
        keep = F.size("toks") - F.ceil(F.size("toks") * F.lit(3.0) / 7 - 1e-9).cast("int") + 1
        ranked = (_merged(side.select(*keys, "s", *extra, "toks", F.explode("toks").alias("t"))).join(freq, [*keys, "t"], "left")
                  .groupBy(*keys, "s").agg(
                      F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("r"),
                      F.first("toks").alias("toks"), *[F.first(c).alias(c) for c in extra]))
        return ranked.select(*keys, "s", *extra, "toks", F.slice(F.col("r.t"), F.lit(1), keep).alias("pre"))

    a = prefixed(left, []).select(*keys, F.col("s").alias("low"), F.col("toks").alias("ta"), F.col("pre").alias("pa"),
                                  F.explode("pre").alias("t"))
    b = prefixed(right, ["first"]).select(*keys, F.col("s").alias("clow"), "first", F.col("toks").alias("tb"),
                                          F.col("pre").alias("pb"), F.explode("pre").alias("t"))
    both = F.size("ta") + F.size("tb")
    pairs = (_merged(a).join(b, [*keys, "t"])
             .filter(F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("t"))
             .filter(F.size(F.array_intersect("ta", "tb")) * 2 >= both * MIN_RATIO - 1e-9)
             .select(*keys, "low", "clow", "first"))
    # The ratio costs far more than moving two short strings, so the pairs are spread first.
    ratio = F.get(list_ratios("low", F.array("clow")), F.lit(0))
    return pairs.repartition(_tasks(pairs)).withColumn("ratio", ratio).filter(F.col("ratio") >= MIN_RATIO)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _candidates(roster: DataFrame, keys: Sequence[str], name: str, pos: str) -> DataFrame:
    return (roster.groupBy(*keys, F.lower(name).alias("clow"))
            .agg(F.min(F.struct(F.col(pos).alias("pos"), F.col(name).alias("cand"))).alias("first")))


def _by_lists(usable: DataFrame, names: DataFrame, keys: Sequence[str], similarity: bool) -> DataFrame:
    """Every usable read (``keys, read, low``) beside the listed names of its scan; for scans of at most ``LISTED`` names."""
    listed = names.groupBy(*keys).agg(F.collect_list(F.struct("first.pos", "first.cand", "clow")).alias("cands"))
    low = F.col("low")
    hits = F.filter("cands", lambda c: F.contains(c["clow"], low) | F.contains(low, c["clow"]))
    sure = F.array_min(F.transform(hits, lambda c: F.struct(F.when(c["clow"] == low, 1).otherwise(2).alias("tier"), c["pos"], c["cand"])))
    met = _merged(usable).join(listed, keys).withColumn("sure", sure)
    first = met.select(*keys, "read", F.col("sure.cand").alias("matched"), F.col("sure.tier").alias("tier"))
    if not similarity:
        return first.filter(F.col("tier").isNotNull())
    # The ratio costs far more than moving short strings, so the open reads are spread first.
    near = F.filter("cands", lambda c: 2 * F.least(F.length(c["clow"]), F.length(low)) >= (F.length(c["clow"]) + F.length(low)) * MIN_RATIO - 1e-9)
    tried = met.withColumn("cands", F.when(F.col("sure").isNull(), near).otherwise(F.slice("cands", F.lit(1), F.lit(0))))
    tried = tried.filter(F.col("sure").isNotNull() | (F.size("cands") > 0))
    tried = tried.repartition(_tasks(tried)).withColumn("ratios", list_ratios("low", F.transform("cands", lambda c: c["clow"])))
    scored = F.transform("cands", lambda c, i: F.struct(F.get("ratios", i).alias("ratio"), (-c["pos"]).alias("o"), c["cand"]))
    best = F.array_max(F.filter(scored, lambda c: c["ratio"] >= MIN_RATIO))
    return (tried.withColumn("best", best).filter(F.col("sure").isNotNull() | F.col("best").isNotNull())
            .select(*keys, "read", F.coalesce("sure.cand", "best.cand").alias("matched"), F.coalesce("sure.tier", F.lit(3)).alias("tier")))


def _by_keys(usable: DataFrame, names: DataFrame, keys: Sequence[str], similarity: bool) -> DataFrame:
    """As :func:`_by_lists` for scans of any number of names, tier by tier over shared keys."""
    usable = staged(usable, "reads")
    low = usable.select(*keys, "low").distinct()
    equal = _merged(low).join(names.withColumnRenamed("clow", "low"), [*keys, "low"]).select(
        *keys, "low", F.col("first.cand").alias("matched"), F.lit(1).alias("tier"))
    rest = _merged(low).join(equal, [*keys, "low"], "left_anti")
    parts = staged(contained(rest, names, keys).select(
        *keys, "low", F.col("first.cand").alias("matched"), F.lit(2).alias("tier")), "parts")
    found = equal.unionByName(parts)
    if similarity:
        open_reads = _merged(rest).join(parts, [*keys, "low"], "left_anti")
        best = (similar(open_reads, names, keys)
                .groupBy(*keys, "low").agg(F.max(F.struct("ratio", (-F.col("first.pos")).alias("o"),
                                                          F.col("first.cand").alias("cand"))).alias("b"))
                .select(*keys, "low", F.col("b.cand").alias("matched"), F.lit(3).alias("tier")))
        found = found.unionByName(best)
    return _merged(usable).join(found, [*keys, "low"]).select(*keys, "read", "matched", "tier")


def match_names(reads: DataFrame, roster: DataFrame, keys: Sequence[str] = ("scan_id",), read: str = "name",
                name: str = "student", pos: str = "pos", similarity: bool = True) -> DataFrame:
    """``keys, read, matched, tier`` for every distinct usable read that has a match.

    Tier 1 equal, tier 2 contained either way, tier 3 most similar; the first roster entry wins
    inside tiers 1 and 2 and among equal ratios. The distinct names are written once, as they are
    counted before they are met.
    """
    keys = list(keys)
    names = staged(_candidates(roster, keys, name, pos), "candidates")
    usable = (reads.select(*keys, F.col(read).alias("read")).distinct()
              .filter(F.col("read").isNotNull() & (F.col("read") != "") & ~F.col("read").isin(NO_NAME, FAILED_NAME))
              .withColumn("low", strip(F.lower("read"))))
    crowded = names.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > LISTED).select(*keys)
    if crowded.isEmpty():
        found = _by_lists(usable, names, keys, similarity)
    else:
        of_few = [_merged(df).join(crowded, keys, "left_anti") for df in (usable, names)]
        of_many = [_merged(df).join(crowded, keys, "left_semi") for df in (usable, names)]
        found = _by_lists(*of_few, keys, similarity).unionByName(_by_keys(*of_many, keys, similarity))
    return found.withColumnRenamed("read", read)


def match_folders(requests: DataFrame, catalogue: DataFrame, keys: Sequence[str] = ("root",)) -> DataFrame:
    """Folder of every request ``keys, request_id, explicit, hint`` in a catalogue ``keys, dir, pos, mtime``.

    An explicit path wins, then an equal name, then the most similar one with a floor for
    containment, then the newest folder that names a test or an exam. Hidden folders are no candidates.
    """
    keys = list(keys)
    catalogue = catalogue.filter(~F.col("dir").startswith("."))
    names = _candidates(catalogue, keys, "dir", "pos")
    hints = (requests.filter(F.col("hint").isNotNull() & (F.col("hint") != ""))
             .select(*keys, strip(F.lower("hint")).alias("low")).distinct())
    equal = hints.join(names.withColumnRenamed("clow", "low"), [*keys, "low"]).select(
        *keys, "low", F.struct(F.lit(2.0).alias("score"), (-F.col("first.pos")).alias("o"), F.col("first.cand").alias("dir")).alias("b"))
    open_hints = hints.join(equal, [*keys, "low"], "left_anti")
    floor = contained(open_hints, names, keys).select(
        *keys, "low", F.struct(F.lit(CONTAINED_RATIO).alias("score"), (-F.col("first.pos")).alias("o"), F.col("first.cand").alias("dir")).alias("b"))
    holds = F.contains("low", "clow") | F.contains("clow", "low")
    near = similar(open_hints, names, keys).select(
        *keys, "low", F.struct(F.when(holds, F.greatest("ratio", F.lit(CONTAINED_RATIO))).otherwise(F.col("ratio")).alias("score"),
                               (-F.col("first.pos")).alias("o"), F.col("first.cand").alias("dir")).alias("b"))
    best = equal.unionByName(floor).unionByName(near).groupBy(*keys, "low").agg(F.max("b")["dir"].alias("by_hint"))
    is_exam = F.lower("dir").contains(EXAM_WORDS[0]) | F.lower("dir").contains(EXAM_WORDS[1])
    newest = (catalogue.filter(is_exam).groupBy(*keys)
              .agg(F.max(F.struct("mtime", (-F.col("pos")).alias("o"), "dir"))["dir"].alias("newest")))
    return (requests.withColumn("low", strip(F.lower("hint"))).join(best, [*keys, "low"], "left")
            .join(newest, keys, "left")
            .withColumn("folder", F.coalesce(F.nullif(strip(F.col("explicit")), F.lit("")), "by_hint", "newest"))
            .select(*keys, "request_id", "folder"))
