"""Votes over repeated readings, record accuracy, recogniser comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.numbers import pct
from gradelake.functions.replies import FAILED_NAME, NO_NAME, UNREADABLE, mc_letter
from gradelake.functions.text import strip
from gradelake.operators.match import match_names

MIN_FRAGMENT_CONFIDENCE = 0.3


def _winners(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent value per key; among equals the one seen first (``pass``)."""
    counted = votes.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("pass").alias("seen"))
    top = F.max(F.struct("n", (-F.col("seen")).alias("o"), "value"))
    return (counted.groupBy(*keys).agg(top.alias("_t"), F.sum("n").alias("votes"))
            .select(*keys, F.col("_t.value").alias("winner"), F.col("_t.n").alias("n"), "votes"))


def _long(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(UNREADABLE)).alias("value")) for f in fields])
    return records.select("page", "pass", F.inline(entries))


def _wide(winners: DataFrame, fields: Sequence[str], value: Column, suffix: str = "") -> list[Column]:
    return [F.max(F.when(F.col("field") == f, value)).alias(f + suffix) for f in fields]


def ensemble(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Vote of several readings of a page, with the share of agreement as confidence.

    ``records``: ``page, pass, student_name, confidence`` and one column per answer field. A single
    reading stays as it is. Further columns are those of the first reading.
    """
    voted = _winners(_long(records, fields), ["page", "field"])
    share = F.col("n") / F.col("votes")
    level = F.when(share == 1.0, "high").when(share >= 0.5, "medium").otherwise("low")
    answers = voted.groupBy("page").agg(*_wide(voted, fields, F.col("winner")), *_wide(voted, fields, level, "_confidence"))
    usable = records.select("page", "pass", F.coalesce("student_name", F.lit(NO_NAME)).alias("value")).filter(
        ~F.col("value").isin(NO_NAME, FAILED_NAME, UNREADABLE))
    names = _winners(usable, ["page"]).select("page", F.col("winner").alias("voted_name"))
    overall = _winners(records.select("page", "pass", F.coalesce("confidence", F.lit("low")).alias("value")), ["page"])
    own = [c for c in records.columns if c not in ("page", "pass")]
    first = records.groupBy("page").agg(F.min_by(F.struct(*own), "pass").alias("_f"), F.count("*").alias("_n"))
    overall = overall.select("page", F.col("winner").alias("confidence"))
    joined = answers.join(overall, "page").join(first, "page").join(names, "page", "left")
    voted = {c: F.col(c) for f in fields for c in (f, f + "_confidence")} | {"confidence": F.col("confidence"), "student_name": F.coalesce("voted_name", "_f.student_name")}
    kept = {c: F.col(f"_f.{c}") if c in own else F.lit(None).cast("string") for c in [*voted, *own]}
    return joined.select("page", *[F.when(F.col("_n") == 1, kept[c]).otherwise(voted.get(c, kept[c])).alias(c) for c in kept])


def multi_pass(records: DataFrame, schema_fields: Sequence[str], answer_fields: Sequence[str]) -> DataFrame:
    """Majority over passes; without one the first pass of high confidence decides.

    Passes that agree in everything are taken as they are. ``confidence`` is part of the schema.
    """
    sames = records.groupBy("page").agg(
        F.count_distinct(F.struct(*[F.coalesce(F.col(f), F.lit("\0")) for f in schema_fields])).alias("kinds"),
        F.bool_and(F.coalesce(F.col("confidence") == "high", F.lit(False))).alias("all_high"),
        F.min(F.struct("pass", *schema_fields)).alias("first"))
    votes = _long(records, schema_fields)
    voted = _winners(votes, ["page", "field"])
    sure = records.filter(F.col("confidence") == "high")
    high = (_long(sure, schema_fields).groupBy("page", "field")
            .agg(F.min(F.struct("pass", "value"))["value"].alias("high_value")))
    picked = voted.join(high, ["page", "field"], "left").withColumn(
        "value", F.when(F.col("n") >= F.col("votes") / 2, F.col("winner")).otherwise(F.coalesce("high_value", "winner")))
    wide = picked.groupBy("page").agg(*_wide(picked, schema_fields, F.col("value")))
    joined = wide.join(sames, "page")
    same = F.col("kinds") == 1
    out = {}
    for f in schema_fields:
        mixed = F.col(f)
        if f == "confidence":
            mixed = F.when(F.col("all_high"), mixed).otherwise("medium")
        if f in answer_fields:
            mixed = mc_letter(mixed)
        out[f] = F.when(same, F.col("first")[f]).otherwise(mixed)
    return joined.select("page", *[c.alias(f) for f, c in out.items()])


def matches(extracted: Column, expected: Column) -> Column:
    """Equal after trimming and case; empty and unreadable never count."""
    got = F.upper(strip(F.coalesce(extracted, F.lit(UNREADABLE))))
    return (got == F.upper(strip(F.coalesce(expected, F.lit(""))))) & ~got.isin("", UNREADABLE)


def record_accuracy(extracted: Sequence[Column], expected: Sequence[Column]) -> Column:
    """Share of matching fields in percent; fields without an expected value count as missed."""
    if not extracted:
        return F.lit(0.0)
    padded = list(expected)[: len(extracted)] + [F.lit(None)] * max(0, len(extracted) - len(expected))
    hits = sum((matches(a, b).cast("int") for a, b in zip(extracted, padded, strict=True)), F.lit(0))
    return hits / F.lit(len(extracted)) * 100


def extraction_summary(records: DataFrame, truth: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Pages by confidence, unreadable names, matched students and accuracy per key.

    ``truth``: ``keys, student, pos`` and one expected column per field, in field order.
    """
    keys = list(keys)
    matched = match_names(records.select(*keys, "student_name"), truth.select(*keys, "student", "pos"), keys, "student_name")
    expected = truth.select(*keys, F.col("student").alias("matched"), *[F.col(f).alias(f"x_{f}") for f in fields])
    joined = records.join(matched.drop("tier"), [*keys, "student_name"], "left").join(expected, [*keys, "matched"], "left")
    hit = sum((matches(F.col(f), F.col(f"x_{f}")).cast("bigint") for f in fields), F.lit(0).cast("bigint"))
    known = F.col("matched").isNotNull()
    level = {c: F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low", "failed")}
    out = joined.groupBy(*keys).agg(
        F.count("*").alias("pages"), *level.values(),
        F.count_if(F.col("student_name").isin(NO_NAME, FAILED_NAME)).alias("unreadable"),
        F.count_if(known).alias("matched"), F.coalesce(F.sum(F.when(known, hit)), F.lit(0)).alias("correct"),
        (F.count_if(known) * len(fields)).alias("total"))
    return out.withColumn("accuracy_pct", pct(F.col("correct"), F.col("total")))


def joined_fragments(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fragments ``pos, text, conf`` of one reading joined in order; weak ones dropped.

    A reading covers one name strip, which bounds the number of fragments.
    """
    kept = F.array_sort(F.collect_list(F.when(F.col("conf") >= MIN_FRAGMENT_CONFIDENCE, F.struct("pos", "text"))))
    return fragments.groupBy(*keys).agg(F.array_join(F.transform(kept, lambda s: s["text"]), " ").alias("text"))


def engine_comparison(reads: DataFrame, roster: DataFrame) -> DataFrame:
    """Matches, failures and mean time per engine over pages.

    ``reads``: ``scan_id, page, engine, config, text, ms``; the longest text of several
    configurations counts, the first one among equals.
    """
    text = F.col("text")
    best = (reads.groupBy("scan_id", "page", "engine")
            .agg(F.max(F.struct(F.length("text").alias("l"), (-F.col("config")).alias("o"), "text"))["text"].alias("text"),
                 F.sum("ms").alias("ms")))
    failed = text.startswith("[") & (text.contains("not installed") | F.lower("text").contains("error:"))
    best = best.withColumn("failed", failed).withColumn("name", F.when(~F.col("failed"), strip(text)))
    matched = match_names(best.select("scan_id", "name"), roster)
    return (best.join(matched, ["scan_id", "name"], "left").groupBy("engine").agg(
        F.count("*").alias("pages"), F.count_if(F.col("matched").isNotNull()).alias("matched"),
        F.count_if("failed").alias("failed"), F.avg("ms").alias("avg_ms")))
