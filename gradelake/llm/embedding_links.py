"""Near-duplicate embeddings by randomly rotated binary codes with correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.components import components
from gradelake.session import staged

COSINE = 0.98
SEED = 7
#: Sign bits of a band, and bands: a pair at cosine 0.98 agrees on some band but for one in ten thousand.
BAND, BANDS = 12, 16
#: Standard errors of an inner-product estimate beyond which a pair isn't computed exactly.
CONFIDENCE = 4.0
#: Vectors that meet in one step of a task at most, on each side, and about how many go to one task.
BLOCK, TASK = 1024, 8192


@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """Random orthogonal matrix, the same wherever it is computed."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def band_keys(unit: np.ndarray) -> np.ndarray:
    """Sign bits of enough rotations, ``BAND`` to a key."""
    dim, need = unit.shape[1], BAND * BANDS
    signs = np.concatenate([unit @ rotation(dim, k) > 0 for k in range(-(-need // dim))], axis=1)[:, :need]
    return (signs.reshape(len(unit), BANDS, BAND) * (1 << np.arange(BAND))).sum(axis=2).astype(np.int16)


def codes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary code of rotated unit vectors as signs, and its inner product with the vector itself.

    With x the code at unit length and f that product, <x, q> / f estimates the inner product of the vector
    with any q without bias over rotations; its standard error is sqrt((1 - f^2) / f^2 / (dim - 1)) at most.
    """
    signs = np.where(rotated > 0, 1.0, -1.0)
    return signs, (signs * rotated).sum(axis=1) / math.sqrt(rotated.shape[1])


def linked_pairs(unit: np.ndarray, keys: np.ndarray, bucket: np.ndarray, band: np.ndarray, block: np.ndarray, cross: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs among rows sorted by bucket, each found in the first band the pair agrees on.

    In a cross bucket only rows of different blocks are compared. A pair is computed exactly if the upper
    confidence bound of its estimate reaches the threshold.
    """
    dim = unit.shape[1]
    rotated = unit @ rotation(dim, 0)
    signs, factor = codes(rotated)
    error = np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, dim - 1))
    left, right = [], []
    at, d = np.arange(len(unit)), 0
    while True:
        d += 1
        at = at[at + d < len(unit)]
        at = at[bucket[at] == bucket[at + d]]
        if not len(at):
            break
        i = at[~cross[at] | (block[at] != block[at + d])]
        j = i + d
        first = (keys[i] == keys[j]).argmax(axis=1) == band[i]
        i, j = i[first], j[first]
        estimate = np.einsum("ij,ij->i", signs[i], rotated[j]) / (math.sqrt(dim) * factor[i])
        near = estimate + CONFIDENCE * error[i] >= cosine
        i, j = i[near], j[near]
        exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        left.append(i[exact])
        right.append(j[exact])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions a position of its component, by falling labels."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    return label


def _meet(cosine: float, kind: type):
    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dim", "label", "band", "key", "one", "two", "id"])
        change = (rows[["dim", "label", "band", "key", "one", "two"]] != rows[["dim", "label", "band", "key", "one", "two"]].shift()).any(axis=1)
        rows = rows.assign(bucket=change.cumsum().to_numpy())
        ids, copies = rows["id"].to_numpy(), rows["n"].to_numpy()
        out = []
        for dim, part in rows.groupby("dim", sort=False):
            place = np.searchsorted(rows["bucket"].to_numpy(), part["bucket"].iloc[0])
            here = slice(place, place + len(part))
            unit = units(np.frombuffer(b"".join(part["vector"]), kind).reshape(-1, dim).astype(np.float64))
            keys = np.frombuffer(b"".join(part["keys"]), np.int16).reshape(-1, BANDS)
            cross = (part["one"] != part["two"]).to_numpy()
            a, b = linked_pairs(unit, keys, part["bucket"].to_numpy(), part["band"].to_numpy(), part["block"].to_numpy(), cross, cosine)
            own, many = ids[here], copies[here]
            links = np.bincount(a, many[b], len(own)) + np.bincount(b, many[a], len(own))
            root = own[local_roots(len(own), a, b)]
            some = links > 0
            out.append(pd.DataFrame({"id": own[some], "root": root[some], "links": links[some].astype(np.int64)}))
        return pd.concat(out)

    return meet


def links(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``key, n_links, component_id, kept`` of each row: links join vectors of equal label at that cosine or more.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without a label, link
    with nothing; so do vectors of different length. Equal vectors of a label are folded into one with their
    number. The others are compared where a band of sign bits agrees; a bucket above ``BLOCK`` vectors is
    split into blocks that meet two at a time, so no task holds a whole one. Tasks give sums of links and, for
    the components, one edge per vector instead of the pairs. Repeated keys keep their rows and count as
    vectors; a null key is never the smallest. No other column is read; an empty table gives no rows.
    """
    item = dict(vectors.dtypes)[embedding].removeprefix("array<").removesuffix(">")
    kind = np.float32 if item == "float" else np.float64
    shape = "array<float>" if item == "float" else "array<double>"
    rows = vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(shape).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = staged(rows.withColumn("sound", sound), "vectors")
    folded = rows.where("sound").groupBy("label", "v").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    folded = staged(folded.withColumn("id", F.monotonically_increasing_id()), "folded")

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                data = np.stack(part["v"].to_numpy()).astype(kind)
                keys = band_keys(units(data.astype(np.float64)))
                n = len(part)
                yield pd.DataFrame({
                    "label": np.repeat(part["label"].to_numpy(), BANDS), "dim": dim, "band": np.tile(np.arange(BANDS), n), "key": keys.ravel().astype(np.int64),
                    "id": np.repeat(part["id"].to_numpy(), BANDS), "n": np.repeat(part["n"].to_numpy(), BANDS),
                    "keys": np.repeat(np.array([k.tobytes() for k in keys], dtype=object), BANDS), "vector": np.repeat(np.array([x.tobytes() for x in data], dtype=object), BANDS),
                })

    bands = folded.select("id", "label", "n", "v").mapInPandas(banded, "label string, dim int, band int, key long, id long, n long, keys binary, vector binary")
    cell = ["label", "dim", "band", "key"]
    sizes = staged(bands.groupBy(*cell).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    met = bands.join(sizes, cell).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    tasks = max(1, math.ceil((folded.count() * BANDS) / TASK))
    met = met.withColumn("task", F.pmod(F.xxhash64(*cell, "one", "two"), F.lit(tasks)))
    found = met.groupBy("task").applyInPandas(_meet(cosine, kind), "id long, root long, links long")
    found = staged(found, "links")
    member = components(found.select("id", "root"), "id", "root").withColumnRenamed("node", "id")
    reached = member.join(folded.select("id", "least"), "id").groupBy("root").agg(F.min("least").alias("reached"))
    member = member.join(reached, "root").select("id", "reached")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = folded.join(member, "id", "left").join(sums, "id", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("reached", "least").alias("component_id"))
    sound_rows = rows.where("sound").join(whole, ["label", "v"]).select("key", "n_links", "component_id")
    others = rows.where("not sound").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    every = sound_rows.unionByName(others)
    return every.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
