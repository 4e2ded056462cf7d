"""Toxicity by a factorization machine over hashed terms.

Terms are words and the first letters of longer words (stems), hashed to 30 bits.  Fitting takes a bounded sample of labelled
rows: it picks the terms that go with either label, and learns a weight and K factors for each, so that a pair of
terms (an insult with a mention of a group) can count for more than the sum of both.  Scoring reads each text whole,
in Arrow batches, and looks its distinct terms up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: At most so many labelled rows are used for fitting, those with the least hash of their id.
TRAIN_ROWS = 6_000
#: Terms kept, factors per term, letters of a word's beginnings, words a task remembers.
TERMS, FACTORS, BEGINNINGS, CACHED = 4096, 4, (4, 5), 150_000
#: Texts taken out of a batch at once.
TOGETHER = 256
#: Frequent terms among which pairs are looked at in fitting.
PAIRED = 512
EDGES = re.compile(r"^\W+|\W+$")


def terms(word: str) -> tuple[int, ...]:
    """Hashes of a word without its outer punctuation, and of its beginnings where it is longer."""
    import xxhash

    word = EDGES.sub("", word.lower())
    if not word:
        return ()
    return tuple(xxhash.xxh32_intdigest(x) >> 2 for x in (word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]))


@dataclass
class Machine:
    """bias + sum of weights + pairwise products of factors over the distinct kept terms of a text."""

    hashes: np.ndarray  # ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        v = self.factors[found]
        z = self.bias + self.weights[found].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: list[np.ndarray], toxic: np.ndarray, factors: int = FACTORS, rounds: int = 150, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Learns from each document's distinct term hashes.  Without both labels: the share of toxic ones alone."""
    y = np.asarray(toxic, float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    flat, row = np.concatenate(docs).astype(np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    order = np.argsort(flat, kind="stable")
    every, start = np.unique(flat[order], return_index=True)
    n = np.diff(np.append(start, len(flat)))
    t = np.add.reduceat(y[row[order]], start)
    # Log odds of a term against the rate, in standard errors.
    pos, neg = y.sum(), len(y) - y.sum()
    odds = np.log((t + 0.5) / (pos - t + 0.5)) - np.log((n - t + 0.5) / (neg - (n - t) + 0.5))
    z = odds / np.sqrt(1 / (t + 0.5) + 1 / (n - t + 0.5))
    z[n < 3] = 0
    kept = np.sort(np.argsort(-np.abs(z), kind="stable")[:TERMS])
    kept = kept[np.abs(z[kept]) > 3]
    kept = np.union1d(kept, _pairs(np.searchsorted(every, flat), row, y, n, kept))
    at = np.full(len(every), -1)
    at[kept] = np.arange(len(kept))
    col = at[np.searchsorted(every, flat)]
    row, col = row[col >= 0], col[col >= 0]
    rng, m = np.random.default_rng(seed), len(kept)
    p = {"b": np.array([bias]), "w": np.zeros(m), "v": rng.normal(0, 0.05, (m, factors))}
    moment = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in p.items()}
    for r in range(1, rounds + 1):
        s = np.stack([np.bincount(row, p["v"][col, f], len(y)) for f in range(factors)], 1)
        square = np.bincount(row, (p["v"][col] ** 2).sum(1), len(y))
        out = p["b"][0] + np.bincount(row, p["w"][col], len(y)) + 0.5 * ((s * s).sum(1) - square)
        g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)
        grad = {"b": np.array([g.sum()]), "w": np.bincount(col, g[row], m) + decay * p["w"]}
        grad["v"] = np.stack([np.bincount(col, g[row] * (s[row, f] - p["v"][col, f]), m) for f in range(factors)], 1) + decay * p["v"]
        for k, (a, b) in moment.items():
            a += 0.1 * (grad[k] - a)
            b += 0.01 * (grad[k] ** 2 - b)
            p[k] -= 0.08 * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-9)
    return Machine(every[kept], float(p["b"][0]), p["w"], p["v"])


def _pairs(term: np.ndarray, row: np.ndarray, y: np.ndarray, n: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Terms that say nothing alone but do beside another such term: of the most frequent PAIRED that are not kept, those of pairs far from the rate."""
    free = np.setdiff1d(np.flatnonzero((n >= 10) & (n <= len(y) / 2)), kept)
    free = np.sort(free[np.argsort(-n[free], kind="stable")[:PAIRED]])
    if len(free) < 2:
        return free[:0]
    at = np.full(len(n), -1)
    at[free] = np.arange(len(free))
    a = np.zeros((len(y), len(free)), np.float32)
    mine = at[term] >= 0
    a[row[mine], at[term[mine]]] = 1
    both, toxic = a.T @ a, a.T @ (a * y[:, None].astype(np.float32))
    rate = y.mean()
    far = np.abs(toxic - rate * both) / np.sqrt(np.maximum(both, 1) * rate * (1 - rate))
    far[both < 10] = 0
    np.fill_diagonal(far, 0)
    return free[(far > 6).any(1)]


def _texts(column: pa.Array) -> Iterator[str | None]:
    for at in range(0, len(column), TOGETHER):
        yield from column.slice(at, TOGETHER).to_pylist()


def distinct_terms(texts: DataFrame) -> DataFrame:
    """`texts` (toxic, text) as (toxic, hashes: binary of int32)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for b in batches:
            out = []
            for text in _texts(b.column(1)):
                found: set[int] = set()
                for w in set((text or "").split()):
                    if (x := seen.get(w)) is None:
                        x = seen[w] = terms(w)
                    found.update(x)
                out.append(np.array(sorted(found), np.int32).tobytes())
                if len(seen) > CACHED:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["toxic", "hashes"])

    return texts.mapInArrow(hashed, "toxic int, hashes binary")


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = TRAIN_ROWS) -> Machine:
    """Fits on `rows` labelled rows at most (id, toxic), where `usable` holds.  Null labels and ids are left out; of several labels of an id each counts."""
    picked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if usable is not None:
        picked = picked.where(usable)
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    small_batches(docs.sparkSession)
    # `rows` rows at most: may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text")
    # An id may stand in `docs` more than once: what reaches the driver is bounded again.
    got = distinct_terms(texts).orderBy(F.xxhash64("hashes"), "toxic").limit(rows).collect()
    got.sort(key=lambda r: (bytes(r["hashes"]), r["toxic"]))  # the same order each time
    return fit([np.frombuffer(r["hashes"], np.int32) for r in got], np.array([r["toxic"] for r in got]))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` (any columns, text among them) with score: 0 to 1, the likelier toxic the higher.

    A null or empty text gets what the bias alone gives.  A column score that is there already gives way.  Repeated
    rows are each scored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    place = {int(h): i for i, h in enumerate(machine.hashes)}
    text_at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        none: tuple[int, ...] = ()
        for b in batches:
            out = []
            for text in _texts(b.column(text_at)):
                found: set[int] = set()
                for w in set((text or "").split()):
                    x = seen.get(w)
                    if x is None:
                        x = seen[w] = tuple(place[h] for h in terms(w) if h in place) or none
                    if x:
                        found.update(x)
                out.append(machine.score(np.array(sorted(found), np.int64)))
                if len(seen) > CACHED:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def held_out(doc_id: Column | None = None) -> Column:
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.crc32(doc_id.cast("string")) % 3 == 1
