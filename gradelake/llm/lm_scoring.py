"""Scoring texts by a hashed maximum-entropy model trained on the corpus itself."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm import maxent
from gradelake.llm.shared import remainder, small_batches
from gradelake.session import staged, unstaged

FOLDS, HELD_OUT = 7, 2
#: Tokens of a chunk: the texts that share a local vocabulary. A longer text is a chunk of its own.
CHUNK = 5 << 19
#: Rows in which a task hands on its sums.
SLICES = 16
#: Groups of tasks whose sums meet first.
TOGETHER = 256

_CHUNKS = "keys array<long>, sums array<long>, lengths array<int>, ids binary, words array<string>, counts array<int>"
_READY = "keys array<long>, sums array<long>, lengths array<int>, ids binary, info binary"
_INFO = np.dtype([("hash", "<u4"), ("class", "<i2"), ("member", "<i2"), ("inner", "<f4"), ("count", "<i8")])


def _packed(data: np.ndarray) -> bytes:
    """Compressed values; first all lowest bytes, then the next ones, so that small numbers take little room."""
    planes = np.ascontiguousarray(data).view(np.uint8).reshape(len(data), data.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def _held(sums: np.ndarray) -> np.ndarray:
    return sums % FOLDS == HELD_OUT


def _chunked(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as numbers of a local vocabulary; number 0 ends each text. Words are counted where they may be learned from.

    Frequent words have small numbers.
    """
    keys: list = []
    sums: list[int] = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = lambda: len(numbers) + 1
    size = 0

    def chunk() -> pd.DataFrame:
        ids = np.concatenate(parts)
        order = np.argsort(-np.bincount(ids, minlength=len(numbers) + 1)[1:], kind="stable")
        rank = np.zeros(len(numbers) + 1, np.int32)
        rank[1 + order] = np.arange(1, len(numbers) + 1)
        ids = rank[ids]
        learn = np.repeat(~_held(np.array(sums)), lengths)
        counts = np.bincount(ids[learn], minlength=len(numbers) + 1)[1:].astype(np.int32)
        words = list(numbers)
        row = [keys[:], sums[:], lengths[:], _packed(ids), [words[i].decode("utf-8") for i in order.tolist()], counts]
        for x in (keys, sums, lengths, parts, numbers):
            x.clear()
        return pd.DataFrame([row], columns=["keys", "sums", "lengths", "ids", "words", "counts"])

    for batch in batches_:
        for key, crc, text in zip(batch["key"], batch["sum"], batch["text"], strict=True):
            words = (text or "").encode("utf-8").lower().split()
            ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            keys.append(None if pd.isna(key) else int(key))
            sums.append(int(crc))
            lengths.append(len(words) + 1)
            parts += [ids, np.zeros(1, np.int32)]
            size += len(words) + 1
            if size >= CHUNK:
                yield chunk()
                size = 0
    if keys:
        yield chunk()


@dataclass
class Vocabulary:
    """What tasks need of the whole vocabulary: totals, the frequent words, and shares inside the other classes."""

    tokens: int
    kinds: int
    ends: int
    head: dict[bytes, int]
    rare: dict[int, tuple[float, dict[int, float]]]
    mass: dict[int, int]

    def info(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Hash, class, member, log10 share inside the class and count of each word, after those of the text end."""
        out = np.zeros(len(words) + 1, _INFO)
        out[maxent.END] = (maxent.word_hash(b"\n"), 0, 0, 0.0, self.ends)
        n = len(words)
        out["hash"][1:] = np.fromiter(map(maxent.word_hash, words), np.uint32, n)
        out["count"][1:] = counts
        place = np.fromiter((self.head.get(w, 0) for w in words), np.int64, n)  # place 0 is the text end's
        bands = np.searchsorted(np.array(maxent.BANDS), counts)
        ends = np.fromiter(map(maxent.ending, words), np.int64, n)
        cls = maxent.HEAD_CLASSES + bands * maxent.ENDINGS + ends
        share = np.ones(n)
        # Words of the first band have the shares of their ending's counts, the others one by their class's mass.
        rare = np.array([[unknown, *(known[c] for c in range(1, maxent.BANDS[0] + 1))] for end in range(maxent.ENDINGS) for unknown, known in [self.rare.get(end) or maxent.spread({})]])
        low = (place == 0) & (bands == 0)
        share[low] = rare[ends[low], counts[low]]
        high = (place == 0) & (bands > 0)
        mass = np.array([self.mass.get(c, 1) for c in range(maxent.CLASSES)])
        share[high] = counts[high] / mass[cls[high]]
        head = place > 0
        out["class"][1:] = np.where(head, place // maxent.MEMBERS, cls)
        out["member"][1:] = np.where(head, place % maxent.MEMBERS, -1)
        out["inner"][1:] = np.log10(share)
        return out


def _vocabulary(chunks: DataFrame, counted: DataFrame) -> Vocabulary:
    ends = chunks.select(F.sum(F.size(F.filter("sums", lambda s: s % FOLDS != HELD_OUT)))).first()[0] or 0
    total, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counted.orderBy(F.col("c").desc(), "word").limit(maxent.HEAD - 1).collect()
    head = {r["word"].encode("utf-8"): i for i, r in enumerate(top, 1)}
    # Of the other words, how many there are and how often they stand, by ending and count; few rows, as counts beyond the first band fold.
    least = (top[-1]["c"], top[-1]["word"]) if top else (0, "")
    others = counted.where((F.col("c") < least[0]) | ((F.col("c") == least[0]) & (F.col("word") > least[1])))
    end = F.crc32(F.expr("substring(cast(word as binary), -2, 2)")) % maxent.ENDINGS
    band = F.lit(0)
    for edge in maxent.BANDS:
        band = band + F.when(F.col("c") > edge, 1).otherwise(0)
    groups = others.groupBy(end.alias("end"), band.alias("band"), F.when(F.col("c") <= maxent.BANDS[0], F.col("c")).alias("r"))
    rare: dict[int, dict[int, int]] = {}
    mass: dict[int, int] = {}
    for r in groups.agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("mass")).collect():
        if r["band"]:
            mass[maxent.HEAD_CLASSES + r["band"] * maxent.ENDINGS + r["end"]] = r["mass"]
        else:
            rare.setdefault(r["end"], {})[r["r"]] = r["n"]
    return Vocabulary(int(total + ends), int(kinds + (ends > 0)), int(ends), head, {k: maxent.spread(v) for k, v in rare.items()}, mass)


def _asked(vocabulary):
    """For each chunk, its words with their counts in the corpus in place of the words; those without an answer stand in no other chunk."""

    def ready(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[["keys", "sums", "lengths", "ids"]]
        info = []
        for words, own in zip(left["words"], left["counts"], strict=True):
            counts = np.array(own, dtype=np.int64)
            counts[right["place"].to_numpy()] = right["c"].to_numpy()
            info.append(_packed(vocabulary.value.info([w.encode("utf-8") for w in words], counts)))
        return out.assign(info=info)

    return ready


def _tokens(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the word at each place, what is known of the words, checksums and lengths of the texts."""
    return _unpacked(row.ids, np.int32), _unpacked(row.info, _INFO), np.asarray(row.sums, dtype=np.int64), np.asarray(row.lengths, dtype=np.int64)


def _chosen(ids: np.ndarray, lengths: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of some of the texts, and where each begins among them."""
    own = lengths[mask]
    return ids[np.repeat(mask, lengths)], (np.cumsum(own) - own).astype(np.int64)


def _sums(ready: DataFrame, add) -> np.ndarray:
    """Sum over all tasks of what ``add(row, tables)`` collects; one set of tables per task, of fixed size.

    Tasks' tables are summed in two levels, :data:`TOGETHER` groups of tasks first, so that no group has all of them.
    """

    def collect(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, some = maxent.Tables.zeros(np.float32), False
        for batch in batches_:
            for row in batch.itertuples(index=False):
                add(row, tables)
                some = True
        if some:
            parts = np.array_split(tables.flat(), SLICES)
            group = TaskContext.get().partitionId() % TOGETHER
            yield pd.DataFrame({"slice": np.arange(SLICES), "tasks": group, "values": [_packed(p.astype(np.float32)) for p in parts]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        value = sum(_unpacked(v, np.float32).astype(np.float64) for v in rows["values"])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "tasks": rows["tasks"].iloc[:1], "values": [_packed(value)]})

    def all_of(rows: pd.DataFrame) -> pd.DataFrame:
        value = sum(_unpacked(v, np.float64) for v in rows["values"])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "values": [value.tobytes()]})

    schema = "slice int, tasks int, values binary"
    groups = ready.mapInPandas(collect, schema).groupBy("slice", "tasks").applyInPandas(total, schema)
    rows = groups.groupBy("slice").applyInPandas(all_of, "slice int, values binary").collect()
    if not rows:
        return np.zeros(maxent.SIZE)
    return np.concatenate([np.frombuffer(r["values"], np.float64) for r in sorted(rows, key=lambda r: r["slice"])])


def _train(ready: DataFrame) -> maxent.Tables:
    """Weights from the counts of all training texts, then gradient steps, each over another part of these texts."""

    def count(row, tables: maxent.Tables) -> None:
        ids, info, sums, lengths = _tokens(row)
        some, starts = _chosen(ids, lengths, ~_held(sums))
        here = info[some]
        for _, batch in maxent.batches(here["hash"], here["class"].astype(np.int32), here["member"].astype(np.int32), starts):
            maxent.observe(batch, tables)

    counts = maxent.Tables.shaped(_sums(ready, count))
    weights = maxent.start(counts)
    tokens = max(1.0, float(counts.class_bias.sum()))
    for step in range(maxent.STEPS):
        shared = ready.sparkSession.sparkContext.broadcast(weights)

        def climb(row, tables: maxent.Tables, step: int = step, shared=shared) -> None:
            ids, info, sums, lengths = _tokens(row)
            rng = np.random.default_rng([maxent.SEED, step, *np.atleast_1d(sums)[:1]])
            some, starts = _chosen(ids, lengths, ~_held(sums) & (sums // FOLDS % maxent.STEPS == step))
            here = info[some]
            for _, batch in maxent.batches(here["hash"], here["class"].astype(np.int32), here["member"].astype(np.int32), starts):
                maxent.gradient(shared.value, batch, tables, rng)
        part = ready.select(F.sum(F.aggregate(F.arrays_zip("sums", "lengths"), F.lit(0).cast("long"), lambda n, x: n + F.when((x["sums"] % FOLDS != HELD_OUT) & (F.floor(x["sums"] / FOLDS) % maxent.STEPS == step), x["lengths"]).otherwise(0)))).first()[0]
        weights = maxent.stepped(weights, maxent.Tables.shaped(_sums(ready, climb)), counts, (part or 0) / tokens)
        shared.unpersist()
    return weights


def score(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each whole text.

    Texts whose key has the remainder ``HELD_OUT`` are never learned from. Each text is cut into its words in
    lower case and an end. Texts are read once into chunks of numbered words, which are written; every word
    count of the corpus then reaches the chunks that have the word by a join, so no vocabulary is held in
    one place but the ``maxent.HEAD`` most frequent words and fixed tables of weights. A null or empty text
    has its end alone; repeated keys keep their rows; no other column is read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col(key).cast("long").alias("key"), F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("sum"), F.col(text).alias("text"))
    chunks = staged(rows.mapInPandas(_chunked, _CHUNKS).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    seen = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").cast("long").alias("c")).where("c > 0")
    counted = staged(seen.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    vocabulary = _vocabulary(chunks, counted)
    own = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    own = own.select(F.col("chunk").alias("of"), "place", F.col("w.words").alias("word"), F.col("w.counts").alias("own"))
    asked = own.join(counted, "word").where("c <> own").select("of", "place", "c")
    shared = spark.sparkContext.broadcast(vocabulary)  # of fixed size
    ready = chunks.groupBy("chunk").cogroup(asked.groupBy("of")).applyInPandas(_asked(shared), _READY)
    ready = staged(ready, "ready")
    unstaged(chunks)
    weights = spark.sparkContext.broadcast(_train(ready))
    tokens, symbols = vocabulary.tokens, vocabulary.kinds + 1

    def scored(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches_:
            for row in batch.itertuples(index=False):
                ids, info, sums, lengths = _tokens(row)
                _, starts = _chosen(ids, lengths, np.ones(len(lengths), bool))
                here = info[ids]
                base = np.log10((info["count"] + 1.0) / (tokens + symbols))[ids]
                value = here["inner"].astype(np.float64)
                for where, part in maxent.batches(here["hash"], here["class"].astype(np.int32), here["member"].astype(np.int32), starts):
                    value[where] += maxent.log10_shares(weights.value, part)
                yield pd.DataFrame({
                    "key": pd.array(row.keys, dtype="Int64"), "held_out": _held(sums), "n_tokens": lengths, "n_known": np.add.reduceat(here["count"] > 0, starts, dtype=np.int64),
                    "train_tokens": tokens, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(value, starts),
                })

    found = ready.mapInPandas(scored, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    return remainder(key, FOLDS) == HELD_OUT
