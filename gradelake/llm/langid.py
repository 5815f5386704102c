"""Language identification by a byte convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import remainder, small_batches

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
STEP = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"
#: Training takes about so many documents of each language, chosen by the hash of their keys, and so many evenly spaced windows of each.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 600, 6
STEPS, BATCH, RATE, SEED = 700, 128, 0.01, 11
_BLOCK = 128


def windows(text: str | None) -> np.ndarray:
    """All windows of a text's UTF-8 bytes, lower case in ASCII; they overlap so that no filter position is lost."""
    data = (text or "").encode("utf-8").lower()
    n = max(1, -(-(len(data) - WINDOW + STEP) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


@dataclass
class Network:
    """Filters over one to four bytes, the maximum of each over a window, and a softmax layer.

    ``filters[k][j]`` holds, for a filter width and an offset in it, a weight for each byte and filter: the
    convolution of one-hot bytes. Bytes at the same offset are looked up instead of multiplied.
    """

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    @classmethod
    def random(cls, languages: list[str]) -> Network:
        rng = np.random.default_rng(SEED)
        filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        many = FILTERS * len(WIDTHS)
        return cls(languages, filters, np.zeros(many, np.float32), rng.normal(0, 0.1, (many, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over each window, and the position where it stands."""
        best, where = [], []
        for w, table in zip(WIDTHS, self.filters, strict=True):
            values = table[0][block[:, :WINDOW - w + 1]]
            for j in range(1, w):
                values = values + table[j][block[:, j:WINDOW - w + 1 + j]]
            at = values.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(values, at[:, None], axis=1)[:, 0])
        return np.concatenate(best, axis=1), np.concatenate(where, axis=1)

    def lookups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same filters by byte pairs: one table for all widths, and what widths three and four add to it."""
        two, three, four = self.filters
        pairs = np.concatenate([t[0][:, None] + t[1][None] for t in (two, three, four)], axis=2).reshape(65536, -1)
        return pairs, three[2], (four[2][:, None] + four[3][None]).reshape(65536, -1)

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.weights + self.offsets
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(data: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """Network fitted by Adam to windows and the numbers of their languages."""
    net, rng = Network.random(languages), np.random.default_rng(SEED)
    params = [*net.filters, net.bias, net.weights, net.offsets]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = np.arange(FILTERS)
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(data), BATCH)
        block, truth = data[pick], labels[pick]
        pooled, where = net.pooled(block)
        hidden = np.maximum(pooled + net.bias, 0)
        delta = np.exp(net.log_odds(pooled))
        delta[np.arange(BATCH), truth] -= 1
        delta /= BATCH
        back = (delta @ net.weights.T) * (hidden > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            grad = np.zeros((w, 256, FILTERS), np.float32)
            for j in range(w):
                byte = np.take_along_axis(block, where[:, part] + j, axis=1)
                np.add.at(grad[j], (byte, rows[None]), back[:, part])
            grads.append(grad)
        grads += [back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Predictor:
    """Applies a network to whole texts, in blocks of windows that may belong to several texts."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.pairs, self.third, self.last = net.lookups()

    def windows_log_odds(self, data: np.ndarray) -> np.ndarray:
        out = []
        for start in range(0, len(data), _BLOCK):
            block = data[start:start + _BLOCK]
            pair = block[:, :-1].astype(np.int32) * 256 + block[:, 1:]
            values = self.pairs[pair]  # window, position, the filters of all widths
            values[:, :-1, FILTERS:2 * FILTERS] += self.third[block[:, 2:]]
            values[:, -1, FILTERS:2 * FILTERS] = -np.inf
            values[:, :-2, 2 * FILTERS:] += self.last[pair[:, 2:]]
            values[:, -2:, 2 * FILTERS:] = -np.inf
            out.append(self.net.log_odds(values.max(axis=1)))
        return np.concatenate(out)

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        """``lang, score`` of each text: the language of the highest mean log probability over its windows."""
        found: list[tuple[str, float]] = []
        held: list[np.ndarray] = []
        spans: list[tuple[int, int]] = []

        def flush() -> None:
            if not held:
                return
            odds = self.windows_log_odds(np.concatenate(held))
            at = 0
            for place, n in spans:
                mean = odds[at:at + n].mean(axis=0)
                share = np.exp(mean - mean.max())
                share /= share.sum()
                k = int(share.argmax())
                found[place] = (self.net.languages[k], float(share[k]))
                at += n
            held.clear()
            spans.clear()

        waiting = 0
        for text in texts:
            found.append((UNKNOWN, 0.0))
            if self.net.languages and has_letter(text):
                part = windows(text)
                held.append(part)
                spans.append((len(found) - 1, len(part)))
                waiting += len(part)
                if waiting >= 8 * _BLOCK:
                    flush()
                    waiting = 0
        flush()
        return pd.DataFrame(found, columns=["lang", "score"])


def learn(documents: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Network trained on a bounded sample of the labelled documents for which ``usable`` holds.

    About ``SAMPLE_DOCUMENTS`` of each language are chosen by the hash of their key, and ``SAMPLE_WINDOWS``
    windows spread over the whole of each text; only these reach the driver. Null texts, texts without a
    letter and null labels are left out; without any label the network knows no language.
    """
    small_batches(documents.sparkSession)
    labelled = documents.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Network.random([])
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCUMENTS / n)))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("key"), F.col("text")), F.lit(1_000_003)) / 1_000_003.0

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, lang in zip(batch["key"], batch["text"], batch["lang"], strict=True):
                if has_letter(text):
                    all_ = windows(text)
                    rows += [(key, int(i), lang, all_[int(i)].tobytes()) for i in np.unique(np.linspace(0, len(all_) - 1, SAMPLE_WINDOWS).astype(int))]
            yield pd.DataFrame(rows, columns=["key", "part", "lang", "bytes"])

    chosen = labelled.where(draw < F.element_at(share, F.col("lang")))
    kind = dict(chosen.dtypes)["key"]
    sample = chosen.mapInPandas(cut, f"key {kind}, part long, lang string, bytes binary").toPandas().sort_values(["key", "part", "bytes"])
    languages = sorted(sample["lang"].unique())
    if not languages:
        return Network.random([])
    data = np.frombuffer(b"".join(sample["bytes"]), np.uint8).reshape(-1, WINDOW)
    return train(data, np.searchsorted(languages, sample["lang"].to_numpy(dtype=object)), languages)


def predict(documents: DataFrame, net: Network, text: str = "text", out: str = "language") -> DataFrame:
    """The documents with a column ``out``, a struct of ``lang`` and ``score`` from the whole text.

    The text alone decides. A null text, or one without a letter, is ``und`` with score zero; equal texts get
    equal results; other columns stay. An existing column of that name is replaced.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.pandas_udf("lang string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for batch in batches:
            yield predictor(batch)

    return documents.withColumn(out, identify(F.col(text)))


def held_out(key: Column) -> Column:
    return remainder(key, 5) == 0
