"""Near copies of whole texts: candidates by wide SimHash fingerprints, multi-index hashing and vote margins, links by exact Jaccard."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.components import components
from gradelake.llm.shared import free_name, small_batches
from gradelake.session import staged, unstaged

SEED = 42
WIDTH = 256
SEGMENTS, SEGMENT = 14, 18
#: Bits of a segment, those with the closest votes, that lookups try both ways.
DOUBTFUL = 2
#: Longer texts are also looked up by bands: smallest shingle hashes in so many parts of the hashes' range, a few together.
BANDS, BAND = 16, 4
SIMILARITY = 0.8
#: Texts with as many different shingles at most are also looked up by their smallest shingle hashes; bits in which such candidates may differ, as votes of few shingles often tie.
SHORT, SHORT_REACH = 256, 80
#: Where more texts than this stand in a slot, they aren't compared with all that look them up there: all these meet by their rarest shingles.
CROWDED = 16
#: Negative slots lie in three ranges: of smallest shingle hashes, below them of rarest shingles, below these of bands.
_RAREST, _BANDED = 1 << 61, 1 << 62
#: Bits of the fixed table that keeps most texts which are not wanted out of a join.
SIEVE = 1 << 24
#: Parts of the hashes' range in which a text's shingles are counted, to bound from above how many two texts share.
PARTS = 256
_BLOCK = 1 << 14
_FLIPS = np.array(sorted(product((0, 1), repeat=DOUBTFUL)))
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_MASK = (1 << 64) - 1
CODE = ["c0", "c1", "c2", "c3"]


def segment(rows: int) -> int:
    """Bits of a segment: with each doubling of the table by one more, so that texts meet by chance as often at any size."""
    return min(62, max(SEGMENT, math.ceil(math.log2(max(rows, 1))) + 2))


def reach(similarity: float = SIMILARITY) -> int:
    """Bits in which candidates may differ: the mean at that Jaccard similarity of equal sizes, and four deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(WIDTH * share + 4 * math.sqrt(WIDTH * share * (1 - share)))


def _votes(text: str | None, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bit, in how many of the different shingles it is set; the sorted hashes of the shingles."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False)) if len(tokens) >= shingle else [b" ".join(tokens)] if tokens else []
    digest = xxhash.xxh64_intdigest
    hashes = np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64))
    votes = np.zeros(WIDTH, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        part = hashes[start:start + _BLOCK]
        words = np.empty((len(part), len(CODE)), np.uint64)
        for i in range(len(CODE)):
            z = part + np.uint64((i + 1) * _ODD[0] & _MASK)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(_ODD[1])
            z = (z ^ (z >> np.uint64(27))) * np.uint64(_ODD[2])
            words[:, i] = z ^ (z >> np.uint64(31))
        votes += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return votes, hashes


def _bands(hashes: np.ndarray) -> np.ndarray:
    """Negative numbers of a text's bands; of sorted hashes, the first one of each part of the range is the smallest there."""
    parts = BANDS * BAND
    edges = np.searchsorted(hashes, np.arange(parts, dtype=np.uint64) * np.uint64((1 << 64) // parts))
    ends = np.append(edges[1:], len(hashes))
    least = np.where(edges < ends, hashes[np.minimum(edges, len(hashes) - 1)], np.uint64(0)).reshape(BANDS, BAND)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_ODD[0])
    for i in range(BAND):
        mixed = (mixed ^ least[:, i]) * np.uint64(_ODD[1])
        mixed ^= mixed >> np.uint64(31)
    return -1 - _BANDED - (mixed >> np.uint64(2)).astype(np.int64)


def text_code(text: str | None, shingle: int = 5, similarity: float = SIMILARITY, width: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprint as four signed numbers, the table slots where a text is looked up, and its shingles' hashes.

    A slot is a segment's number and a value of its ``width`` bits: of each segment first the own value, then those
    with one to ``DOUBTFUL`` of its bits flipped. The flipped bits are the ones whose vote was closest; a
    copy with small changes differs there first. All texts have negative slots besides, by shingle hashes. A short
    text, in which doubtful bits are many, has them of n shingles for the n - ceil(similarity n) + 1 with the
    smallest hashes, of which two texts with that Jaccard similarity always share one. A longer text has one for each
    band of ``BAND`` smallest hashes, each of which two texts share with the probability of their similarity.
    Short texts so long that a text beyond ``SHORT`` may be as similar have bands too.
    """
    votes, hashes = _votes(text, shingle)
    n = len(hashes)
    bits = 2 * votes > n
    code = np.packbits(bits, bitorder="little").view(np.int64)
    places = (np.arange(SEGMENTS)[:, None] * WIDTH // SEGMENTS + np.arange(width)) % WIDTH
    weights = 1 << np.arange(width, dtype=np.int64)
    own = (bits[places] * weights).sum(axis=1)
    doubt = np.argsort(np.abs(2 * votes - n)[places], axis=1, kind="stable")[:, :DOUBTFUL]
    flips = (_FLIPS[None] * weights[doubt][:, None]).sum(axis=2)
    slots = [((own[:, None] ^ flips) * SEGMENTS + np.arange(SEGMENTS)[:, None]).ravel()]
    if 0 < n <= SHORT:
        first = hashes[: n - math.ceil(similarity * n - 1e-9) + 1]
        slots.append(-1 - (first >> np.uint64(3)).astype(np.int64))
    if n > similarity * SHORT:
        slots.append(_bands(hashes))
    return code, np.concatenate(slots).astype(np.int64), hashes.view(np.int64)


def spread(grams: np.ndarray) -> np.ndarray | None:
    counts = np.bincount((grams.view(np.uint64) // np.uint64((1 << 64) // PARTS)).astype(np.int64), minlength=PARTS)
    return counts.astype(np.int8) if counts.max() < 128 else None


def coded(text: Column, shingle: int = 5, similarity: float = SIMILARITY, width: int = SEGMENT, grams: bool = False) -> Column:
    """Struct of the fingerprint's four numbers, the lookup slots and the number of shingles, with ``grams`` the shingles' hashes and their ``spread`` in place of these.

    The spread counts the hashes in each of the ``PARTS`` of their range; it is null where a count is above 127.
    """

    @F.pandas_udf("c0 long, c1 long, c2 long, c3 long, " + ("grams array<long>, spread array<tinyint>" if grams else "slots array<long>, n int"))
    def code(texts: pd.Series) -> pd.DataFrame:
        found = [text_code(t, shingle, similarity, width) for t in texts]
        codes = np.array([c for c, _, _ in found], dtype=np.int64).reshape(-1, len(CODE))
        lists = pd.Series([g if grams else s for _, s, g in found], dtype=object)
        out = pd.DataFrame({name: codes[:, i] for i, name in enumerate(CODE)} | {"grams" if grams else "slots": lists})
        if grams:
            return out.assign(spread=pd.Series([spread(g) for g in lists], dtype=object))
        return out.assign(n=np.array([len(g) for _, _, g in found], np.int32))

    return code(text)


def _distance(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in CODE))


def sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key, none`` may be among the wanted ones: all of these, and a few others whose hash sets the same bit.

    Whole texts would be shuffled to meet the wanted keys; so most that aren't wanted end here. The table has a fixed size.
    """
    place = F.pmod(F.xxhash64("key", "none"), F.lit(SIEVE))
    each = 1 << 15  # bits of one of Spark's bitmaps
    parts = wanted.select(place.alias("place")).groupBy(F.expr(f"place div {each}").alias("part")).agg(F.bitmap_construct_agg(F.col("place") % each).alias("bits"))
    table = np.zeros(SIEVE // 8, np.uint8)
    for part, bits in parts.collect():
        table[part * each // 8:(part + 1) * each // 8] = np.frombuffer(bits, np.uint8)

    @F.pandas_udf("boolean")
    def may(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return rows.where(may(place))


def gram_sets(ids: DataFrame, codes: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The staged ``id, n, spread, grams`` of codes, with the number of shingles. Only texts under their keys are read again."""
    # Written, so that Spark knows its size before it would shuffle the texts.
    wanted = staged(ids.join(codes.select("id", "least", *CODE), "id").select("id", *_keyed("least"), *CODE), "wanted")
    fresh = sieved(texts.select(*_keyed("key"), "text"), wanted).join(wanted.select("key", "none"), ["key", "none"], "left_semi")
    fresh = fresh.select(coded(F.col("text"), shingle, similarity, grams=True).alias("f")).select(*(f"f.{c}" for c in CODE), F.struct(F.size("f.grams").alias("n"), "f.spread", "f.grams").alias("s"))
    fresh = staged(fresh, "grams")  # else the join's test for nulls would be pushed down and fingerprint all texts
    sets = staged(fresh.join(wanted.select("id", *CODE), CODE).groupBy("id").agg(F.min(F.struct("s.grams", "s.n", "s.spread")).alias("s")).select("id", "s.*"), "sets")
    for done in (wanted, fresh):
        unstaged(done)
    return sets


def alike(pairs: DataFrame, codes: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, sets: DataFrame | None = None) -> DataFrame:
    """Labels ``la, lb`` of those of the ``pairs`` of ids ``a, b`` whose shingle sets have that Jaccard similarity, counted exactly.

    ``sets``: those of :func:`gram_sets` that are there already; only texts of other ids in a pair are read again. Two texts share
    at most the smaller count in each part of the hashes' range; pairs which that already rules out never carry their shingles.
    """
    pairs = staged(pairs.distinct(), "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    more = gram_sets(ids if sets is None else ids.join(sets.select("id"), "id", "left_anti"), codes, texts, shingle, similarity)
    every = more if sets is None else sets.unionByName(more)
    of = lambda end, *names: every.select(F.col("id").alias(end), *(F.col(n).alias(f"{n}{end}") for n in names))
    enough = lambda common: common >= similarity * (F.col("na") + F.col("nb") - common) - 1e-9
    least = F.aggregate(F.zip_with("spreada", "spreadb", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    sized = pairs.join(of("a", "n"), "a").join(of("b", "n"), "b").where(enough(F.least("na", "nb")))
    spreads = sized.join(of("a", "spread"), "a").join(of("b", "spread"), "b")
    close = staged(spreads.where(F.coalesce(enough(least), F.lit(True))).drop("spreada", "spreadb"), "close")
    both = close.join(of("a", "grams"), "a").join(of("b", "grams"), "b")
    links = staged(both.where(enough(F.size(F.array_intersect("gramsa", "gramsb")))).select("la", "lb").distinct(), "confirmed")
    for done in (pairs, close, more):
        unstaged(done)
    return links


def _keyed(key: str | Column) -> tuple[Column, Column]:
    """A key that joins rows without one too."""
    return F.coalesce(key, F.lit(0)).alias("key"), F.isnull(key).alias("none")


def _looked_up(n: Column, similarity: float) -> Column:
    """The first shingles of n, in an order that all texts share, of which a text with that similarity has one too."""
    return n - F.ceil(similarity * n - 1e-9) + 1


def _standing(n: Column, similarity: float) -> Column:
    """The first shingles of n that a text of at least as many shingles looks up, if it is as similar: one of them is common."""
    return _looked_up(n, 2 * similarity / (1 + similarity))


def meetings(codes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The staged ``id, slot, own, pivot, n`` of lookups that meet another code: in slots with two rows or more and an entry.

    Every code stands in the table under its ``own`` values and looks up all its slots; the ``pivot`` is the smallest id that
    stands in a slot, ``n`` how many do. Most lookups meet nothing and end here, before they carry anything but their id.
    Of two short texts the longer one looks the other up, which therefore stands under about half of its smallest hashes.
    """
    flipped = SEGMENTS * len(_FLIPS)
    own = lambda x, i: F.when(x >= 0, i % len(_FLIPS) == 0).otherwise((x < -_BANDED) | (i - flipped < _standing(F.col("n"), similarity)))
    return _meeting(codes.select("id", F.inline(F.transform("slots", lambda x, i: F.struct(x.alias("slot"), own(x, i).alias("own"))))))


def _meeting(lookups: DataFrame) -> DataFrame:
    here = Window.partitionBy("slot")
    stands = F.when(F.col("own"), F.col("id"))
    rows = lookups.withColumns({"pivot": F.min(stands).over(here), "n": F.count(stands).over(here), "rows": F.count(F.lit(1)).over(here)})
    return staged(rows.where("pivot is not null and rows > 1").drop("rows"), "met")


def rare_meetings(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """:func:`meetings` of texts in slots of their rarest shingles; ``sets`` are those of :func:`gram_sets`.

    In any order of shingles that all texts share, two texts with that similarity have one of their first in common. By hash, texts which only have a passage in common meet in its smallest shingles, all of them with
    each other; in the order of how many of these texts have a shingle, a passage comes last, and only texts alike on the whole meet.
    ``size`` and ``left``: a text's shingles, and those from the slot's one on, to which what two texts share is bounded where they meet first.
    """
    rows = sets.select("id", "n", F.explode("grams").alias("gram")).withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("texts", "gram")))
    rarest = rows.where((F.col("place") <= _looked_up(F.col("n"), similarity)) & (F.col("texts") > 1))
    own = F.col("place") <= _standing(F.col("n"), similarity)
    left = (F.col("n") - F.col("place") + 1).alias("left")
    return _meeting(rarest.select("id", (F.lit(-1 - _RAREST) - F.shiftrightunsigned("gram", 3)).alias("slot"), own.alias("own"), F.col("n").alias("size"), left))


def roots(codes: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The staged ``id, least, c0..c3`` with the ``root`` of what links at that similarity connect; the given table is deleted.

    Pairs that meet in a slot (:func:`meetings`) are candidates if the complete distance is within reach, and links if the shingles of
    the ``key, text`` of ``texts`` confirm it; ``least`` is a key of the code. First, codes are linked to the closest of their pivots,
    and the components of these links give labels, so that most of a crowded group has one label; then
    to their other pivots of another label. What remains are lookups of entries that don't have their pivot's
    label, and lookups without their pivot's label of all other entries; pairs of one label are connected.
    Crowded slots only link texts to their pivot, those of smallest shingle hashes not even that: whatever meets there meets by its
    rarest shingles as well, where no two texts as similar miss each other.
    As two short texts always meet in a slot of shingles, only these connect them at last; the other slots connect longer texts.
    """
    met = meetings(codes, similarity)
    slim = staged(codes.select("id", "least", *CODE, F.col("n").between(1, SHORT).alias("brief")), "slim")
    unstaged(codes)
    prints = slim.select("id", "brief", *CODE)
    within = lambda short: _distance("x", "p") <= F.when(short, SHORT_REACH).otherwise(reach(similarity))

    def closest_by(met: DataFrame) -> DataFrame:
        # One partitioning by id serves the folding of repeated meetings and the join with the fingerprints.
        pairs = met.where("id <> pivot").repartition("id").groupBy("id", "pivot").agg(F.max(F.col("slot") < 0).alias("short"))
        pairs = pairs.join(prints.alias("x"), "id").join(prints.withColumnRenamed("id", "pivot").alias("p"), "pivot")
        return staged(pairs.where(within(F.col("short"))).select("id", "pivot", _distance("x", "p").alias("far")), "near")

    given_up = F.col("slot").between(-_RAREST, -1) & (F.col("n") > CROWDED)
    dense = staged(met.where(F.col("n") > CROWDED).select("id").distinct(), "dense")
    plain = met.where(~given_up)
    found = [closest_by(plain)]
    ends = found[0].select(F.explode(F.array("id", "pivot")).alias("id"))
    sets = gram_sets(ends.unionByName(dense).distinct(), slim, texts, shingle, similarity)
    rare = rare_meetings(sets.join(dense, "id", "left_semi"), similarity)
    found.append(closest_by(rare))
    near = staged(found[0].unionByName(found[1]).distinct(), "near")
    every = plain.where(F.col("n") <= CROWDED).unionByName(rare, allowMissingColumns=True)
    for done in (*found, dense):
        unstaged(done)

    def relabelled(labels: DataFrame, candidates: DataFrame) -> DataFrame:
        links = alike(candidates, slim, texts, shingle, similarity, sets)
        found = components(links, "la", "lb").select(F.col("node").alias("label"), "root")
        new = staged(labels.join(found, "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels")
        for done in (links, labels):
            unstaged(done)
        return new

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """``la, lb``: labels of the rows' id and pivot."""
        of = lambda key, name: labels.select(F.col("id").alias(key), F.col("label").alias(name))
        return rows.join(of("id", "la"), "id").join(of("pivot", "lb"), "pivot")

    labels = staged(slim.select("id", F.col("id").alias("label")), "labels")
    closest = near.groupBy("id").agg(F.min(F.struct("far", "pivot")).alias("best")).select("id", "best.pivot")
    closest = staged(closest, "closest")
    ends = lambda rows: rows.select(F.col("id").alias("a"), F.col("pivot").alias("b"), "la", "lb")
    labels = relabelled(labels, ends(labelled(closest, labels)))
    rest = near.join(closest, ["id", "pivot"], "left_anti")
    labels = relabelled(labels, ends(labelled(rest, labels).where("la <> lb")))
    for done in (near, closest):
        unstaged(done)

    # A slot whose rows all have the pivot's label connects nothing more, nor does a slot of short texts only that isn't one of shingles.
    crowded = labelled(every.where("n > 1"), labels).join(prints, "id").withColumn("open", F.col("slot").between(-_BANDED, -1) | ~F.col("brief"))
    here = Window.partitionBy("slot")
    crowded = crowded.withColumns({"other": F.max(F.col("la") != F.col("lb")).over(here), "open": F.max("open").over(here)}).where("other and open")
    crowded = staged(crowded.select("id", "slot", "own", "pivot", F.col("la").alias("label"), (F.col("la") != F.col("lb")).alias("other"), "size", "left", "brief", *CODE), "crowded")
    for done in (met, rare):
        unstaged(done)
    entries = crowded.where("own and id <> pivot")
    outside, inside, stray = entries.where("other"), entries.where("not other"), crowded.where("other")
    apart = (F.col("x.slot") == F.col("p.slot")) & (F.col("x.label") != F.col("p.label")) & within(F.col("x.slot") < 0)
    apart = apart & (F.col("x.slot").between(-_BANDED, -1) | ~F.col("x.brief") | ~F.col("p.brief"))
    common = similarity / (1 + similarity) * (F.col("x.size") + F.col("p.size")) - 1e-9
    apart = apart & F.coalesce(F.least("x.left", "p.left") >= common, F.lit(True))
    further = [rows.alias("x").join(others.alias("p"), apart) for rows, others in ((crowded, outside), (stray, inside))]
    further = [rows.select(F.col("x.id").alias("a"), F.col("p.id").alias("b"), F.col("x.label").alias("la"), F.col("p.label").alias("lb")) for rows in further]
    labels = relabelled(labels, further[0].unionByName(further[1]))
    grouped = staged(slim.join(labels.withColumnRenamed("label", "root"), "id"), "grouped")
    for done in (crowded, sets, slim, labels):
        unstaged(done)
    return grouped


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies: the one with the smallest key; all columns stay.

    Texts are similar if the Jaccard similarity of their sets of word shingles is ``similarity`` or more; a
    text of fewer words is one shingle. Fingerprints only find the candidates. Groups are what links reach. Equal
    fingerprints, null and empty texts among them, are folded before any pairing. A row without a key stays
    only where its whole group has none; of repeated keys in a group the row with the smallest fingerprint
    stays, then the one with the smallest digest. Texts are fingerprinted once; afterwards their key and digest stand
    for them. An empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    width = segment(documents.count())
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    rows = documents.select(F.col(key).cast("long").alias("key"), digest.alias("digest"), coded(F.col(text), shingle, similarity, width).alias("f"))
    rows = staged(rows.select("key", "digest", "f.*"), "wide")
    codes = rows.groupBy(*CODE).agg(F.min("key").alias("least"), F.min(F.struct("slots", "n")).alias("s")).select(*CODE, "least", "s.*")
    codes = staged(codes.withColumn("id", F.monotonically_increasing_id()), "codes")
    prints = staged(rows.select(*_keyed("key"), "digest", *CODE), "prints")
    unstaged(rows)
    grouped = roots(codes, documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), shingle, similarity)
    best = grouped.groupBy("root").agg(F.min(F.struct(F.isnull("least"), "least", *CODE)).alias("best"))
    best = best.select("best.*").select(*_keyed("least"), *CODE)
    best = prints.join(best, ["key", "none", *CODE]).groupBy("key", "none", *CODE).agg(F.min("digest").alias("digest"))
    best = staged(best.select("key", "none", "digest"), "best")
    for done in (grouped, prints):
        unstaged(done)
    names = [free_name(documents, f"__{name}") for name in ("key", "none", "digest", "place")]
    fresh = documents.withColumns(dict(zip(names, (*_keyed(F.col(key).cast("long")), digest), strict=False)))
    order = Window.partitionBy(*names[:3]).orderBy(F.col(text).asc_nulls_last())
    one = fresh.join(best.toDF(*names[:3]), names[:3], "left_semi").withColumn(names[3], F.row_number().over(order))
    return one.where(F.col(names[3]) == 1).select(*documents.columns)
