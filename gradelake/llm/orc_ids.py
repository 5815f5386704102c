"""Token ids in ORC files: run-length coded integers, row indexes and Bloom filters on document ids.

Documents lie in ascending id order over the files. A file's rows hold ``doc_id``, ``part`` (the file's place in that
order), ``position`` (ids of the part before the document), ``n_tokens`` and ``ids``. A document's place in the whole
stream is its part's start plus its position, and the starts are one row per part, so nothing is counted through one task.
Spark cuts the files at stripes; its filters on ``doc_id``, ``part`` and ``position`` skip stripes and row groups.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gradelake.llm.shared import small_batches

#: Id that ends a document.
END = 0
#: Characters that are encoded at once; a longer text makes a call of its own.
CHARS = 1 << 18
STRIPE_BYTES = 16 << 20
#: Rows between two entries of a row index, the least that ORC allows.
STRIDE = 1000
FALSE_POSITIVES = 0.01

#: Different pieces of text that a worker process remembers the ids of, about 200 bytes each.
PIECES = 600_000

# White space, letters and numbers among the first 256 characters.
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"

_encoders: dict = {}


class Encoder:
    """The vocabulary's encoder; strings of special tokens are ordinary text.

    The library's time goes to cutting texts, so texts are cut here by its own pattern, and its model encodes every
    different piece once while the process remembers it. Characters that Unicode has not assigned may be letters to one of the
    two patterns only: texts with one go to the library whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        classes = {r"\p{L}": f"[{_LETTER}]", r"\p{N}": f"[{_NUMBER}]", r"[^\s\p{L}\p{N}]": f"[^{_SPACE}{_LETTER}{_NUMBER}]", r"\s": f"[{_SPACE}]", r"\S": f"[^{_SPACE}]"}
        plain = re.sub(r"\[\^\\s\\p{L}\\p{N}\]|\\p{L}|\\p{N}|\\s|\\S", lambda m: classes[m[0]], public_tokenizers.PATTERN)
        self.cut_latin = re.compile(plain).findall
        shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]  # the others stand for 256 and on
        hidden = (b for b in range(256) if b not in shown)
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str] | None:
        """The text cut by the pattern, None where only the library can tell."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None if any(unicodedata.category(c) == "Cn" for c in set(text)) else self.cut(text)
        return self.cut_latin(text)

    def _piece(self, piece: str) -> bytes:
        return self._packed(t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    @staticmethod
    def _packed(ids: Iterable[int]) -> bytes:
        return array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as 32-bit integers of this machine."""
        for text in texts:
            pieces = self._pieces(text)
            if pieces is None:
                yield self._packed(self.whole.encode(text, add_special_tokens=False).ids)
                continue
            if len(self.known) > PIECES:
                self.known.clear()
            known = self.known
            ids = list(map(known.get, pieces))
            if None in ids:
                for at, piece in enumerate(pieces):
                    if ids[at] is None:
                        ids[at] = known[piece] = known.get(piece) or self._piece(piece)
            yield b"".join(ids)


def _encoder(path: str) -> Encoder:
    """Made once in a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _calls(texts: list[str]) -> Iterator[list[str]]:
    call, chars = [], 0
    for text in texts:
        if call and chars + len(text) > CHARS:
            yield call
            call, chars = [], 0
        call.append(text)
        chars += len(text)
    if call:
        yield call


def _lists(encoded: Iterable[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one end id after each list, and the bounds of the lists."""
    last = array("i", [end]).tobytes()
    pieces = [ids + last for ids in encoded]
    return np.frombuffer(b"".join(pieces), np.int32), np.cumsum([0] + [len(p) // 4 for p in pieces])


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Encodes every whole text, ends it with ``end`` and writes all documents in ascending key order.

    ``vocabulary`` is a file of the tokenizers library that every machine can read. A null text counts as empty and has the
    end id alone. Documents with a null key come first; equal keys follow each other by the hash of their texts, repeated
    rows as often as they are there, and may lie in different files. Other columns are not written. An empty table makes files without rows.
    The sort reads ranges of keys, so a key that holds many rows is dealt by its texts' hashes; only repeats of one
    text under one key stay together.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, position = TaskContext.get().partitionId(), 0
        encoder = _encoder(vocabulary)
        for batch in batches:
            done = 0
            for call in _calls(batch.column(1).to_pylist()):
                ids, bounds = _lists(encoder.encode(call), end)
                columns = [
                    batch.column(0).slice(done, len(call)), pa.array(np.full(len(call), part, np.int32)),
                    pa.array(position + bounds[:-1]), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "position", "n_tokens", "ids"])
                done += len(call)
                position += int(bounds[-1])

    schema = f"doc_id {kind.simpleString()}, part int, position long, n_tokens long, ids array<int>"
    options = {
        "compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(STRIDE), "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES),
    }
    rows.mapInArrow(encode, schema).write.options(**options).orc(path)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """``part, start, n_tokens, n_docs, first_id, last_id`` of every part with rows; ids themselves are not read."""
    rows = spark.read.orc(path)
    ends = rows.groupBy("part").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    return ends.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"), "n_tokens", "n_docs", "first_id", "last_id")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files; ``start`` counts the ids of all documents before it."""
    starts = F.broadcast(parts(spark, path).select("part", F.col("start").alias("before")))  # one row a part
    rows = spark.read.orc(path).join(starts, "part")
    return rows.select("doc_id", (F.col("before") + F.col("position")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """``doc_id, part, position, n_tokens, ids`` of the documents named; stripes whose ranges or Bloom filters exclude them all are not read.

    Unknown ids give no rows, repeated ones no more rows; null finds nothing.
    """
    return spark.read.orc(path).where(F.col("doc_id").isin(sorted({i for i in ids if i is not None})))


def token_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``doc_id, start, ids`` of the documents that have any of the stream's ids ``first`` to ``last`` (exclusive), whole.

    The parts' starts tell which parts and positions can hold them; other stripes are not read.
    """
    near = parts(spark, path).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first)).select("part", "start")
    bounds = near.agg(F.min("part"), F.max("part")).first()
    if last <= first or bounds[0] is None:
        return read(spark, path).where("false").select("doc_id", "start", "ids")
    rows = spark.read.orc(path).where(F.col("part").between(*bounds)).join(F.broadcast(near.withColumnRenamed("start", "before")), "part")
    rows = rows.select("doc_id", (F.col("before") + F.col("position")).alias("start"), "n_tokens", "ids")
    return rows.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first)).select("doc_id", "start", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of :func:`read`'s rows, lengths and checksums (little-endian, 32 bits an id) from the ids themselves."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            flat, bounds = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = rows.schema["doc_id"].dataType if "doc_id" in rows.columns else LongType()
    schema = f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long"
    return rows.select("doc_id", "start", "ids").mapInArrow(check, schema)
