"""Hashed maximum-entropy language model with class-factored softmax: features, classes and batches in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

SEED = 42
#: Frequent words, which get classes of MEMBERS each, and classes of the other words: bands of counts, each cut by word ending.
MEMBERS, HEAD_CLASSES = 32, 24
BANDS, ENDINGS = (4, 31), 8
TAIL_CLASSES = (len(BANDS) + 1) * ENDINGS
CLASSES = HEAD_CLASSES + TAIL_CLASSES
HEAD = MEMBERS * HEAD_CLASSES
#: Rows of a hashed feature table. Class templates: each of the three words before, and the two before together; member templates: each of the three with the class.
ROWS = 1 << 12
CLASS_TEMPLATES, MEMBER_TEMPLATES = 4, 3
END = 0
#: Weight of each feature's own log ratio at the start, pseudo-counts, rate of the gradient steps and their number.
START, PRIOR, RATE, STEPS = 0.45, 20.0, 0.6, 3
BATCH, BLOCK = 1 << 15, 1 << 12
#: Scores up to here have exponentials, and sums of them, well inside the range of single precision.
FAR = 80.0
_PAIR, _CLASS = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def word_hash(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word, SEED)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def tail_class(count, end):
    """Class of a word that isn't among the frequent ones."""
    return HEAD_CLASSES + np.searchsorted(np.array(BANDS), count) * ENDINGS + end


@dataclass
class Tables:
    """Weights: a bias for each class and member, and for each template a table of rows by hashed feature."""

    class_bias: np.ndarray
    classes: np.ndarray
    member_bias: np.ndarray
    members: np.ndarray

    @classmethod
    def zeros(cls, kind: type = np.float32) -> Tables:
        return cls(np.zeros(CLASSES, kind), np.zeros((CLASS_TEMPLATES, ROWS, CLASSES), kind), np.zeros((HEAD_CLASSES, MEMBERS), kind), np.zeros((MEMBER_TEMPLATES, ROWS, MEMBERS), kind))

    def parts(self) -> list[np.ndarray]:
        return [self.class_bias, self.classes, self.member_bias, self.members]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def shaped(cls, flat: np.ndarray) -> Tables:
        out, at = [], 0
        for p in cls.zeros().parts():
            out.append(flat[at:at + p.size].reshape(p.shape))
            at += p.size
        return cls(*out)


SIZE = Tables.zeros().flat().size


@dataclass
class Batch:
    """Tokens in running order: class and member (-1 for words of tail classes), and rows of their features."""

    cls: np.ndarray
    member: np.ndarray
    rows: np.ndarray

    def member_rows(self, at: np.ndarray) -> np.ndarray:
        mixed = (self.cls[at].astype(np.uint32) + np.uint32(1)) * _CLASS
        return ((self.rows[:MEMBER_TEMPLATES, at].astype(np.uint32) * _PAIR + mixed[None]) >> np.uint32(7)) % np.uint32(ROWS)


def batches(hashes: np.ndarray, cls: np.ndarray, member: np.ndarray, starts: np.ndarray, size: int = BATCH) -> Iterator[tuple[slice, Batch]]:
    """Batches over token arrays of texts that begin at ``starts``; before its start a text has no words. No tokens make no batch."""
    n = len(hashes)
    if not n:
        return
    first = np.zeros(n, np.int64)
    first[starts] = starts
    offset = np.arange(n) - np.maximum.accumulate(first)  # place in the text
    for low in range(0, n, size):
        at = np.arange(low, min(n, low + size))
        back = []
        for k in range(1, MEMBER_TEMPLATES + 1):
            back.append(np.where(offset[at] >= k, hashes[np.maximum(at - k, 0)], np.uint32(k)))
        both = (back[0] * _PAIR) ^ back[1]
        rows = np.stack([*back, both * _CLASS >> np.uint32(3)]) % np.uint32(ROWS)
        yield slice(low, at[-1] + 1), Batch(cls[at], member[at], rows)


def _scores(tables: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Exponentials of each token's scores, up to a factor of its own."""
    z = np.take(tables[0], rows[0], axis=0)
    for table, at in zip(tables[1:], rows[1:], strict=True):
        z += np.take(table, at, axis=0)
    z += bias
    if len(z) and max(z.max(), -z.min()) > FAR:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _blocks(n: int) -> Iterator[slice]:
    """Parts of a batch whose scores fit a core's cache."""
    return (slice(low, low + BLOCK) for low in range(0, n, BLOCK))


def _class_scores(w: Tables, b: Batch) -> Iterator[tuple[slice, np.ndarray]]:
    for part in _blocks(len(b.cls)):
        yield part, _scores(w.classes, b.rows[:, part], w.class_bias)


def _member_scores(w: Tables, b: Batch, at: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    rows = b.member_rows(at)
    for part in _blocks(len(at)):
        yield part, _scores(w.members, rows[:, part], w.member_bias[b.cls[at[part]]])


def _shares(scores: Iterator[tuple[slice, np.ndarray]], chosen: np.ndarray) -> np.ndarray:
    """Share of the chosen outcome of each token."""
    out = np.empty(len(chosen), np.float32)
    for part, z in scores:
        out[part] = z[np.arange(len(z)), chosen[part]] / (z @ np.ones(z.shape[1], np.float32))
    return out


def log10_shares(w: Tables, b: Batch) -> np.ndarray:
    """log10 of each token's class probability, and for frequent words times the member's."""
    share = _shares(_class_scores(w, b), b.cls)
    at = np.flatnonzero(b.member >= 0)
    share[at] *= _shares(_member_scores(w, b, at), b.member[at])
    return np.log10(share.astype(np.float64))


def observe(b: Batch, into: Tables, cls: np.ndarray | None = None, member: np.ndarray | None = None, sign: int = 1) -> None:
    """Adds the batch's feature counts, with its own classes and members or those given."""
    cls = b.cls if cls is None else cls
    into.class_bias += sign * np.bincount(cls, minlength=CLASSES)
    for t in range(CLASS_TEMPLATES):
        into.classes[t] += sign * np.bincount(b.rows[t].astype(np.int64) * CLASSES + cls, minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)
    at = np.flatnonzero(b.member >= 0)
    if not len(at):
        return
    rows, member = b.member_rows(at), b.member[at] if member is None else member
    into.member_bias += sign * np.bincount(b.cls[at].astype(np.int64) * MEMBERS + member, minlength=HEAD).reshape(HEAD_CLASSES, MEMBERS)
    for t in range(MEMBER_TEMPLATES):
        into.members[t] += sign * np.bincount(rows[t].astype(np.int64) * MEMBERS + member, minlength=ROWS * MEMBERS).reshape(ROWS, MEMBERS)


def _drawn(scores: Iterator[tuple[slice, np.ndarray]], n: int, rng: np.random.Generator) -> np.ndarray:
    """One outcome for each token, drawn by its shares."""
    out, dice = np.empty(n, np.int64), rng.random((n, 1), dtype=np.float32)
    for part, z in scores:
        total = z @ np.triu(np.ones((z.shape[1], z.shape[1]), np.float32))  # running sums
        out[part] = (total >= dice[part] * total[:, -1:]).argmax(axis=1)
    return out


def gradient(w: Tables, b: Batch, into: Tables, rng: np.random.Generator) -> None:
    """Adds observed minus expected feature counts; the expectation is estimated without bias by one draw per token."""
    observe(b, into)
    at = np.flatnonzero(b.member >= 0)
    member = _drawn(_member_scores(w, b, at), len(at), rng) if len(at) else None
    observe(b, into, _drawn(_class_scores(w, b), len(b.cls), rng), member, -1)


def start(counts: Tables) -> Tables:
    """Weights from counts: biases are log shares, and a feature's weight is part of the log ratio of its own shares to these."""
    def ratio(table: np.ndarray, base: np.ndarray) -> np.ndarray:
        rows = table.sum(axis=-1, keepdims=True)
        return START * np.log((table + PRIOR * base) / ((rows + PRIOR) * base))

    base = (counts.class_bias + 0.1) / (counts.class_bias + 0.1).sum()
    inner = (counts.member_bias + 0.1) / (counts.member_bias + 0.1).sum(axis=1, keepdims=True)
    # A row of the member tables holds features of several classes; its own shares are the base.
    tables = []
    for table in counts.members:
        every = table.sum(axis=0) + 0.1
        tables.append(ratio(table, every / every.sum()))
    classes = np.stack([ratio(t, base) for t in counts.classes])
    return Tables(*(x.astype(np.float32) for x in (np.log(base), classes, np.log(inner), np.stack(tables))))


def stepped(w: Tables, grad: Tables, counts: Tables, share: float, rate: float = RATE) -> Tables:
    """One step along the gradient of a ``share`` of the tokens, scaled by how often each feature and outcome occur."""
    out = []
    for x, g, c in zip(w.parts(), grad.parts(), counts.parts(), strict=True):
        total = c.sum(axis=-1, keepdims=True)
        mean = c.reshape(-1, c.shape[-1]).sum(axis=0)
        expected = share * (0.5 * c + 0.5 * total * mean / max(1.0, mean.sum()))
        out.append((x + rate * np.clip(g / (expected + PRIOR), -1, 1)).astype(np.float32))
    return Tables(*out)


def spread(most_common: dict[int, int]) -> tuple[float, dict[int, float]]:
    """Shares inside a class of rare words: of the unknown word, and of one with each count, by the number of words with each count.

    By Good and Turing, words seen r times weigh as the ones seen r + 1 times do, and the unknown as those seen once.
    """
    top = BANDS[0]
    weight = {0: max(0.1, float(most_common.get(1, 0)))}
    for r in range(1, top + 1):
        n = most_common.get(r, 0)
        above = (r + 1) * most_common.get(r + 1, 0) if r < top else 0.9 * r * n
        weight[r] = max(0.1, above / n if n else 0.1)
    total = weight[0] + sum(weight[r] * most_common.get(r, 0) for r in range(1, top + 1))
    return weight[0] / total, {r: weight[r] / total for r in range(1, top + 1)}
