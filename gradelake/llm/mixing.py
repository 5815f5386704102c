"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.shared import WORD, free_name
from gradelake.session import staged

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents that are ranked together when a group's extra copies are dealt out.
DEALT = 1024


def size_of(text: Column) -> Column:
    """Number of words; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, documents, source_size, target`` from rows ``source, size, n``.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target
    stops at ``most`` times the source's size and the others share the excess by weight: target = min(most *
    size, level * weight), where the level is read off sources ordered by the level that fills them. One row
    per source passes the two ordered windows.
    """
    sums = histogram.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sums = staged(sums.withColumn("weight", weight).withColumn("full", most * F.col("source_size") / F.col("weight")), "sources")
    size, heft = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    if not size:
        return sums.select("source", "documents", "source_size", F.lit(0.0).alias("target"))
    before = Window.orderBy("full", "weight").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(size)) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    open_ = F.lit(heft) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = sums.select("full", (left / open_).alias("level")).where("full >= level").agg(F.min_by("level", "full")).first()[0]
    target = F.least(most * F.col("source_size").cast("double"), F.lit(level) * F.col("weight"))
    return sums.select("source", "documents", "source_size", target.alias("target"))


def balance(histogram: DataFrame, sources: DataFrame, most: float = MOST, tolerance: float = 1e-9, rounds: int = 80) -> DataFrame:
    """``source, tilt``: the multiplier of each source's token constraint.

    Rates of documents that stay closest to one in relative entropy, meet the source's token target and stop
    at ``most`` are min(most, exp(tilt * size / mean size)). The convex dual has the derivative sum(size *
    rate) - target, increasing in the tilt. Each round sums it and its slope over the histogram for all
    sources at once and takes a Newton step, or halves the bracket if the step leaves it. A source that has
    to be taken ``most`` times throughout has no finite tilt: null.
    """
    spread = histogram.where("size > 0").groupBy("source").agg(F.min("size").alias("shortest"))
    start = sources.where("source_size > 0").alias("s").join(spread.alias("h"), F.col("s.source").eqNullSafe(F.col("h.source")))
    share = F.log(F.col("target") / F.col("source_size"))
    mean = F.col("source_size") / F.col("documents")
    far = share * mean / F.col("shortest")
    state = start.select(
        F.col("s.source").alias("source"), mean.alias("mean"), "target", share.alias("tilt"),
        F.least(far, F.lit(0.0)).alias("low"), F.greatest(far, F.lit(0.0)).alias("high"),
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
    )
    state = staged(state.withColumn("error", F.lit(math.inf)), "tilts")
    for _ in range(rounds):
        open_ = state.where(~F.col("full") & (F.col("error") > tolerance))
        if open_.isEmpty():
            break
        rate = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(most))))
        mass = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, mass * F.col("size") / F.col("mean")).otherwise(0.0)
        at = histogram.where("size > 0").alias("h").join(open_.alias("o"), F.col("h.source").eqNullSafe(F.col("o.source")))
        sums = at.groupBy(F.col("o.source").alias("of")).agg(F.sum(mass).alias("mass"), F.sum(slope).alias("slope"))
        new = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        over = F.col("mass") - F.col("target")
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(over, F.col("slope"))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        error = F.abs(over) / F.col("target")
        moved = F.col("mass").isNotNull() & (error > tolerance)
        state = staged(new.select(
            "source", "mean", "target", F.when(moved, step).otherwise(F.col("tilt")).alias("tilt"), F.when(moved, low).otherwise(F.col("low")).alias("low"),
            F.when(moved, high).otherwise(F.col("high")).alias("high"), "full", F.coalesce(error, F.col("error")).alias("error"),
        ), "tilts")
    return state.select("source", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def _rounded(sizes: pd.DataFrame) -> pd.DataFrame:
    """Copies that every document of a size gets, and extra ones, for the sizes of a source.

    From the longest documents to the shortest, each size takes its part of copies in whole numbers, and the
    tokens that rounding leaves over go on to the next. What is left at the end goes through the sizes again,
    which may then take copies more or less within ``most`` a document, until it fits none.
    """
    sizes = sizes.sort_values("size", ascending=False)
    length, n, most = sizes["size"].tolist(), sizes["n"].tolist(), int(sizes["most"].iloc[0])
    base = [b * m for b, m in zip(sizes["base"], n, strict=True)]
    number = list(base)
    wanted = (sizes["n"] * sizes["part"] * sizes["size"]).tolist()
    bounds = [(b, min(b + m, most * m)) for b, m in zip(base, n, strict=True)]
    left, moved = 0.0, True
    while moved:
        moved = False
        for i, size in enumerate(length):
            left += wanted[i]
            if size:
                low, high = bounds[i]
                k = min(high, max(low, number[i] + round(left / size))) - number[i]
                number[i] += k
                left -= k * size
                moved |= k != 0
        moved |= any(wanted)
        wanted, bounds = [0.0] * len(n), [(0, most * m) for m in n]
    number, n = np.array(number), np.array(n)
    return sizes.assign(base=number // n, extra=number % n)[["source", "size", "n", "base", "extra"]]


def copies(sized: DataFrame, key: str, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The rows ``key, source, size`` with ``copies``, and the table of :func:`targets`.

    ``sized`` is read several times and should be a written table. A document of no words has rate one. Rates
    depend on source and size alone, so the histogram of both (per source, as many rows as there are different
    sizes) carries the solver and the rounding: each size gets the whole part of its rate for every document
    and a number of extra copies, which go to documents by the hash of their key. Groups above ``DEALT``
    documents are split by that hash first and share the extra copies by their number, so no task ranks more.
    """
    histogram = staged(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = staged(targets(histogram, weights, most), "targets")
    tilts = balance(histogram, sources, most)
    joined = histogram.alias("h").join(sources.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")))
    joined = joined.join(tilts.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source")), "left")
    mean = F.col("t.source_size") / F.col("t.documents")
    rate = F.when(F.col("h.size") == 0, 1.0).when(F.col("b.tilt").isNull(), float(most)).otherwise(
        F.exp(F.least(F.col("b.tilt") * F.col("h.size") / mean, F.lit(math.log(most)))))
    whole = F.floor(rate + 1e-9)
    parts = joined.select(
        F.col("h.source").alias("source"), F.col("h.size").alias("size"), F.col("h.n").alias("n"), whole.alias("base"),
        F.greatest(rate - whole, F.lit(0.0)).alias("part"), F.lit(most).alias("most"),
    )
    dealt = parts.groupBy("source").applyInPandas(_rounded, "source string, size long, n long, base long, extra long")
    dealt = staged(dealt, "dealt")

    same = ["source", "size"]
    match = F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.size"))
    slot = F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.ceil(F.col("n") / DEALT).cast("long"))
    rows = sized.select(key, *same).alias("r").join(dealt.alias("d"), match).select(F.col(f"r.{key}"), "r.source", "r.size", "n", "base", "extra", slot.alias("slot"))
    slots = rows.where("extra > 0 and n > 0").groupBy(*same, "slot", "n", "extra").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*same).orderBy("slot"))
    share = F.expr("(upto * extra) div n - ((upto - m) * extra) div n")
    slots = slots.withColumn("upto", upto).select(*same, "slot", share.alias("share"))
    place = F.row_number().over(Window.partitionBy(*same, "slot").orderBy(F.xxhash64(F.lit("place"), F.col(key)), key))
    ranked = rows.withColumn("place", place).alias("r")
    match = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size")) & (F.col("r.slot") == F.col("s.slot"))
    ranked = ranked.join(slots.alias("s"), match, "left")
    number = F.col("r.base") + F.when(F.col("r.place") <= F.col("s.share"), 1).otherwise(0)
    return ranked.select(F.col(f"r.{key}"), "r.source", "r.size", number.cast("long").alias("copies")), sources


def mix(documents: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The documents, each as often as the mix takes it; all columns stay, repeated rows count each."""
    names, row, number = documents.columns, free_name(documents, "__row"), free_name(documents, "__copies")
    rows = staged(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    sized = staged(rows.select(F.col(row).alias("row"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), "sizes")
    taken, _ = copies(sized, "row")
    often = rows.join(taken.where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(number)), row)
    return often.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(number))).alias(row)).drop(row)


def taken(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``key, size, source_size, target, taken, copies`` of each document.

    Null texts and texts of white space have size zero and take nothing; a null source is a source, the last
    one; repeated keys keep their rows; an empty table gives no rows. Other columns aren't read.
    """
    sized = staged(documents.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), "sizes")
    often, sources = copies(sized, "key")
    out = often.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")))
    return out.select(F.col("o.key").alias(key), "o.size", "s.source_size", "s.target", (F.col("o.size") * F.col("o.copies")).alias("taken"), "o.copies")
