"""Document fingerprints by winnowing; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.shared import ascii_lower, words

#: Words of a k-gram, and k-grams of a window: any run of GRAM + WINDOW - 1 words that two texts share is found.
GRAM, WINDOW = 5, 4
_PLACES = (1 << 31) - 1


def _let(value: Column, then) -> Column:
    """``then(value)``, in which the value is computed once however often it stands there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _ahead(values: Column, by: int, join) -> Column:
    """Each value joined with the one ``by`` places on; as many values less."""
    n = F.size(values) - by
    return F.zip_with(F.slice(values, 1, n), F.slice(values, by + 1, n), join)


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _rolled(hashes: Column, k: int) -> Column:
    """k-gram hashes h[i], ..., h[i+k-1] from word hashes: runs of doubled length roll up from two shorter ones."""
    many = F.size(hashes) - k + 1

    def step(run: Column, length: int, done: int, parts: Column | None) -> Column:
        if k & length:
            parts = F.slice(run, done + 1, many) if parts is None else F.zip_with(parts, F.slice(run, done + 1, many), _hash)
            done += length
        if 2 * length > k:
            return parts
        return _let(_ahead(run, length, _hash), lambda longer: step(longer, 2 * length, done, parts))

    return step(hashes, 1, 0, None)


def _least(values: Column, window: int) -> Column:
    """Minimum of every window, by doubling."""

    def step(run: Column, length: int) -> Column:
        if length == window:
            return run
        by = min(length, window - length)
        return _let(_ahead(run, by, lambda a, b: F.least(a, b)), lambda wider: step(wider, length + by))

    return step(values, 1)


def marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Winnowed k-grams of a text as ``hash << 31 | (2^31 - 1 - position)``, in text order.

    The text is lower-cased in ASCII and split into words; each k-gram of words has a 31-bit hash and the
    position of its first word. Every window of consecutive k-grams gives its least number: the least hash,
    and of equal ones the rightmost; a k-gram that several windows choose stands once. A text with fewer
    words is one k-gram, one with fewer k-grams one window; null and empty texts have no marks.
    """
    hashes = F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))
    return _let(hashes, lambda h: _let(_packed(h, gram), lambda p: _chosen(p, window)))


def _packed(hashes: Column, gram: int) -> Column:
    n = F.size(hashes)
    grams = F.when(n >= gram, _rolled(hashes, gram)).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<long>"))
    return F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 31).bitwiseOR(F.lit(_PLACES) - i.cast("long")))


def _chosen(packed: Column, window: int) -> Column:
    n = F.size(packed)
    return F.when(n >= window, F.array_distinct(_least(packed, window))).when(n > 0, F.array(F.array_min(packed))).otherwise(packed)


def hash_of(mark: Column) -> Column:
    return F.shiftright(mark, 31)


def position_of(mark: Column) -> Column:
    """Number of the word at which the k-gram of a mark begins."""
    return F.lit(_PLACES) - mark.bitwiseAND(F.lit(_PLACES))


def digest(mark: Column) -> Column:
    """SHA-256 over the hashes and positions of a fingerprint."""
    return F.sha2(F.array_join(F.transform(mark, lambda m: m.cast("string")), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Share of hashes in common among all hashes of two fingerprints; 1 if both have none."""
    def share(x: Column, y: Column) -> Column:
        return _let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(n / F.greatest(F.size(x) + F.size(y) - n, F.lit(1))))

    distinct = [F.array_distinct(F.transform(m, hash_of)) for m in (a, b)]
    return _let(distinct[0], lambda x: _let(distinct[1], lambda y: share(x, y)))


def matches(documents: DataFrame, others: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``hash, key, position, other, other_position``: k-grams that texts of two tables share.

    For a stated set of query texts against a table; texts with a common run of ``GRAM + WINDOW - 1`` words
    have at least one row.
    """
    def placed(df: DataFrame, name: str, place: str) -> DataFrame:
        found = df.select(F.col(key).alias(name), F.explode(marks(F.col(text))).alias("m"))
        return found.select(name, hash_of(F.col("m")).alias("hash"), position_of(F.col("m")).alias(place))

    return placed(documents, "key", "position").join(placed(others, "other", "other_position"), "hash")


def _splits(spark: SparkSession, keys: DataFrame, parts: int) -> list[int]:
    """Up to ``parts`` keys that divide the table into ranges, the largest last."""
    shares = [i / parts for i in range(1, parts)]
    row = keys.agg(F.percentile_approx("key", shares, 10_000) if shares else F.array(), F.max("key")).first()
    return sorted({*(row[0] or []), row[1]} - {None})


def with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, marks, next_text, next_marks`` of each document and the one that follows by descending key.

    The first follows the last. Equal keys are ordered by text, null keys come last, and a single document
    follows itself. Texts are shuffled once, by ranges of keys, as many as there are shuffle partitions; the
    last key of a range is an existing one, so the row that continues the next range is sent to both.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = _splits(spark, rows, parts)
    if len(ends) > 1:
        table, steps = F.lit(ends), [1 << i for i in reversed(range(len(ends).bit_length()))]
        # Number of ends below the key, by bisection.
        below = F.aggregate(
            F.lit(steps), F.lit(0),
            lambda at, step: F.when((at + step <= len(ends)) & (F.element_at(table, F.least(at + step, F.lit(len(ends)))) < F.col("key")), at + step).otherwise(at),
        )
        part = F.coalesce(below, F.lit(0))
        first = F.element_at(table, F.least(part + 1, F.lit(len(ends)))) == F.col("key")
        # The largest key of a range opens it; it also closes the range above, the largest key of all the lowest range.
        closes = F.when(F.coalesce(first, F.lit(False)), (part + 1) % len(ends))
        places = F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.struct(closes.alias("part"), F.lit(True).alias("guest")))
        rows = rows.select("key", "text", F.explode(F.filter(places, lambda p: p["part"].isNotNull())).alias("p")).select("key", "text", "p.part", "p.guest")
    else:
        rows = rows.select("key", "text", F.lit(0).alias("part"), F.lit(False).alias("guest"))
    order = [F.col("guest"), F.col("key").desc_nulls_last(), F.col("text")]
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", *order)
    rows = rows.withColumn("marks", marks(F.col("text")))
    window = Window.partitionBy("part").orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = F.coalesce(F.lead(F.struct("text", "marks")).over(window), F.first(F.struct("text", "marks")).over(whole)) if len(ends) <= 1 else F.lead(F.struct("text", "marks")).over(window)
    return rows.withColumn("next", follow).where("not guest").select("key", "text", "marks", F.col("next.text").alias("next_text"), F.col("next.marks").alias("next_marks"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third, in code points and rounded down, replaced by the start of the following one."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))
