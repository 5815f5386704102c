"""Byte-level BPE with a queue of merge ranks in hierarchical bitmaps."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from itertools import pairwise
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import small_batches

#: Longest pre-token and most pre-tokens of one generation that a worker remembers.
REMEMBERED_CHARS, REMEMBERED = 48, 200_000
#: Characters of texts that are cut together, and of unknown pre-tokens that are merged together.
TOGETHER, LOT = 1 << 18, 1 << 12


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern; pieces that it has met are remembered, not sent along."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        # Bits of a bitmap word; a summary word of as many bits covers all ranks.
        self.shift = max(1, -(-max(ranks.values(), default=0).bit_length() // 2))
        self.bitmap = [0] * (1 << self.shift)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __reduce__(self):
        return Codec, (self.ranks, self.split.pattern)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each of some pre-tokens: merges by lowest rank, leftmost first, over a linked list of their parts.

        The pieces lie behind each other with fences between them, and share one queue. It has a bucket of
        positions for each merge rank that waits. A bitmap marks the ranks whose bucket isn't empty, a summary
        the words of the bitmap that aren't zero, so two find-first-set operations give the next rank, however
        many positions wait. A rank's positions are taken together, from left to right, up to a merge that makes
        a pair of the same or a lower rank. An entry is stale, and skipped, once its left part has gone or the
        pair that starts there has another rank by now. The bitmap is empty again at the end.
        """
        whole = b"".join(pieces)
        find, bitmap, shift, summary, end = self.ranks.get, self.bitmap, self.shift, 0, len(whole)
        low, none = (1 << shift) - 1, 1 << 2 * shift
        until = list(range(1, end + 1))  # where the part that starts here ends
        before = list(range(-1, end))  # start of the part to the left
        fence = bytearray(end + 1)
        pair = [find(whole[at:at + 2], -1) for at in range(end)]  # rank of the part with the one to its right, else -1
        fence[0] = 1
        at = 0
        for piece in pieces:
            at += len(piece)
            fence[at] = 1
            pair[at - 1] = -1
        buckets: dict[int, list[int]] = {}
        for at, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    bitmap[rank >> shift] |= 1 << (rank & low)
                    summary |= 1 << (rank >> shift)
        while summary:
            word = (summary & -summary).bit_length() - 1
            bits = bitmap[word]
            rank = word << shift | (bits & -bits).bit_length() - 1
            bucket = buckets.pop(rank)
            bitmap[word] = bits = bits & (bits - 1)
            if not bits:
                summary &= summary - 1
            bucket.sort(reverse=True)
            while bucket:
                at = bucket.pop()
                if pair[at] != rank:
                    continue
                middle = until[at]
                stop = until[at] = until[middle]
                pair[middle] = -1
                least = none
                if fence[stop]:
                    pair[at] = -1
                else:
                    before[stop] = at
                    pair[at] = new = find(whole[at:until[stop]], -1)
                    if new >= 0:
                        least = new
                        if new in buckets:
                            buckets[new].append(at)
                        else:
                            buckets[new] = [at]
                            bitmap[new >> shift] |= 1 << (new & low)
                            summary |= 1 << (new >> shift)
                if not fence[at]:
                    left = before[at]
                    pair[left] = new = find(whole[left:stop], -1)
                    if new >= 0:
                        if new < least:
                            least = new
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            bitmap[new >> shift] |= 1 << (new & low)
                            summary |= 1 << (new >> shift)
                if least <= rank and bucket:  # a new pair comes before the rest
                    bucket += buckets.get(rank, ())
                    buckets[rank] = bucket
                    bitmap[rank >> shift] |= 1 << (rank & low)
                    summary |= 1 << (rank >> shift)
                    break
        ids, ends, at = [], [0], 0
        while at < end:
            stop = until[at]
            ids.append(self.ranks[whole[at:stop]])
            if fence[stop]:
                ends.append(4 * len(ids))
            at = stop
        packed = pack(f"<{len(ids)}I", *ids)
        return [packed[a:b] for a, b in pairwise(ends)]

    def _learn(self, pieces: set[str]) -> None:
        """Makes the ids of pieces known: from the older generation, the vocabulary, or by merges in lots."""
        young, lot, size = self.young, [], 0

        def merged() -> None:
            young.update(zip(lot, self.merge([p.encode("utf-8") for p in lot]), strict=True))

        for piece in pieces:
            found = self.old.get(piece)
            if found is None and (rank := self.ranks.get(piece.encode("utf-8"))) is not None:
                found = pack("<I", rank)
            if found is not None:
                young[piece] = found
                continue
            lot.append(piece)
            size += len(piece)
            if size >= LOT:
                merged()
                lot, size = [], 0
        if lot:
            merged()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers; nothing for null."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, as :meth:`encode` gives them; texts are cut, and their unknown pieces merged, in lots."""
        out: list[bytes] = []
        cut: list[list[str]] = []
        size = 0

        def done() -> None:
            unknown = set().union(*cut).difference(self.young)
            self._learn(unknown)
            ids = self.young.__getitem__
            out.extend(b"".join(map(ids, pieces)) for pieces in cut)
            for piece in unknown:
                if len(piece) > REMEMBERED_CHARS:
                    del self.young[piece]
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}

        for text in texts:
            cut.append(self.split.findall(text or ""))
            size += len(text or "")
            if size >= TOGETHER:
                done()
                cut, size = [], 0
        done()
        return out

    def decode(self, ids: bytes | None) -> bytes:
        """Bytes of the tokens; an id outside of the vocabulary raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


class Tokenizer:
    """Column functions for a vocabulary file that the driver can read; the codec goes to executors once.

    The vocabulary is a file of fixed size and doesn't grow with the corpus. A Python worker keeps its codec,
    and the pieces that it remembers, from one task to the next.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        small_batches(spark)
        self.codec: Broadcast = spark.sparkContext.broadcast(Codec(read_ranks(path), pattern))

    def encode(self, text: Column) -> Column:
        """Ids as bytes, four to an id, little-endian; empty for null and empty texts."""
        shared = self.codec

        @F.pandas_udf("binary")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series(shared.value.encode_all(texts), dtype=object)

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of the tokens of such ids."""
        shared = self.codec

        @F.pandas_udf("binary")
        def decode(ids: pd.Series) -> pd.Series:
            return pd.Series([shared.value.decode(x) for x in ids], dtype=object)

        return decode(ids)

    def round_trip(self, text: Column) -> Column:
        """Struct of the ``ids`` of :meth:`encode` and the bytes ``decoded`` from them, in one pass of one worker."""
        shared = self.codec

        @F.pandas_udf("ids binary, decoded binary")
        def round_trip(texts: pd.Series) -> pd.DataFrame:
            ids = shared.value.encode_all(texts)
            return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([shared.value.decode(x) for x in ids], dtype=object)})

        return round_trip(text)


def count(ids: Column) -> Column:
    """Number of ids."""
    return (F.length(ids) / 4).cast("long")
