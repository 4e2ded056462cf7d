"""Exact k-means over integer vectors, with adaptive distance bounds.

Each vector keeps its nearest centroid with an upper bound of its distance, its next nearest ones with a lower bound
each, and one lower bound (`rest`) for all the others.  When centroids move, bounds widen by the moves.  The first place
in a vector's list from which on every bound lies above the upper one says how many of its listed centroids must be
measured again and put in order; where there is none, the vector is measured against all.  So every assignment is exact.
The list starts at a quarter of the centroids and shrinks, an eighth at least, to what the last round needed.

Vectors are never shuffled: each round reads a table of vectors and bounds and writes the next.  What moves are sums of
vectors that changed their centroid, at most a row for each task, centroid and component.  The driver holds the
centroids, k rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, discard, durable

#: Bounds are widened by this share, far beyond the error of their square roots and sums.
SLACK = 1e-9
#: Rows measured at once; bytes of vectors sent to Python at once.
ROWS, BATCH_BYTES = 2048, 16_000_000
STATE = "id long, vec array<long>, was int, near array<smallint>, low array<double>, rest double, high double, used int, measured long"
DONE = "id long, cluster int, distance long, measured long"


def integers(vectors: DataFrame, dim: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vec (array<long>: floor(scale * x), x as double) of vectors of `dim` components, none of them null or not finite."""
    v = vectors[vector_col]
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(v.isNotNull() & fine, F.lit(False))).select(vectors[id_col].cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))


def hash_order(prefix: str) -> Column:
    """Ascending by the lowercase-hex sha256 of prefix and id; rows without id last."""
    return F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256).asc_nulls_last()


def _kind(*arrays: np.ndarray):
    """The number type in which squared distances between rows of these are exact."""
    high = max((max(-int(x.min()), int(x.max())) for x in arrays if x.size), default=0)
    worst = 4 * high * high * arrays[0].shape[-1]
    return np.float64 if worst < 2**53 else np.int64 if worst < 2**63 else object


def all_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre, exact."""
    kind = _kind(x, centres)
    x, centres = x.astype(kind), centres.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]


def distances(x: np.ndarray, centres: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each of its own centres, (rows, m) as `which`; exact."""
    kind = _kind(x, centres)
    x, centres = x.astype(kind), centres.astype(kind)
    out = np.empty(which.shape, kind)
    for j in range(which.shape[1]):
        apart = x - centres[which[:, j]]
        out[:, j] = (apart * apart).sum(1)
    return out


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def _ordered(squared: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centres and distances by distance, ties to the smaller number."""
    by = np.argsort(which, 1, kind="stable")
    which, squared = np.take_along_axis(which, by, 1), np.take_along_axis(squared, by, 1)
    by = np.argsort(squared, 1, kind="stable")
    return np.take_along_axis(which, by, 1), np.take_along_axis(squared, by, 1)


class Bounds:
    """Lists and bounds of some vectors: near (rows, b), low (rows, b - 1), rest and high (rows)."""

    def __init__(self, near: np.ndarray, low: np.ndarray, rest: np.ndarray, high: np.ndarray):
        self.near, self.low, self.rest, self.high = near, low, rest, high
        self.measured = np.zeros(len(near), np.int64)
        self.used = np.zeros(len(near), np.int64)

    @classmethod
    def scanned(cls, x: np.ndarray, centres: np.ndarray, b: int) -> Bounds:
        out = cls(np.zeros((len(x), b), np.int64), np.zeros((len(x), b - 1)), np.zeros(len(x)), np.zeros(len(x)))
        out.scan(x, centres, np.arange(len(x)))
        return out

    def scan(self, x: np.ndarray, centres: np.ndarray, rows: np.ndarray) -> None:
        """Measures `rows` against all centres."""
        b = self.near.shape[1]
        for part in np.split(rows, range(ROWS, len(rows), ROWS)):
            squared = all_distances(x[part], centres)
            by = np.argsort(squared, 1, kind="stable")
            far = _root(np.take_along_axis(squared, by[:, : b + 1], 1))
            self.near[part], self.high[part] = by[:, :b], far[:, 0] * (1 + SLACK)
            self.low[part] = far[:, 1:b] * (1 - SLACK)
            self.rest[part] = far[:, b] * (1 - SLACK) if far.shape[1] > b else np.inf
        self.measured[rows] += len(centres)

    def shortened(self, b: int) -> Bounds:
        """Lists of b centres: the others fall under `rest`."""
        if b < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, b - 1 :].min(1))
            self.near, self.low = self.near[:, :b].copy(), self.low[:, : b - 1].copy()
        return self

    def places(self) -> np.ndarray:
        """How many of a row's listed centres, beside its own, may be nearer than its own; b where `rest` may hold such too."""
        beyond = np.minimum.accumulate(np.column_stack([self.low, self.rest])[:, ::-1], 1)[:, ::-1]
        sure = self.high[:, None] < beyond
        return np.where(sure.any(1), sure.argmax(1), sure.shape[1])

    def move(self, x: np.ndarray, centres: np.ndarray, moves: np.ndarray) -> None:
        """The centres have moved, by `moves` each: every row's first listed centre is its nearest again."""
        self.high = self.high + moves[self.near[:, 0]]
        self.low = self.low - moves[self.near[:, 1:]]
        self.rest = self.rest - moves.max()
        doubtful = np.flatnonzero(self.places() > 0)
        if len(doubtful):
            own = distances(x[doubtful], centres, self.near[doubtful, :1])
            self.high[doubtful] = _root(own[:, 0]) * (1 + SLACK)
            self.measured[doubtful] += 1
        self.used = self.places()
        b = self.near.shape[1]
        for m in np.unique(self.used):
            rows = np.flatnonzero(self.used == m)
            if m == b:
                self.scan(x, centres, rows)
            elif m > 0:
                which = self.near[rows, : m + 1]
                which, squared = _ordered(distances(x[rows], centres, which), which)
                far = _root(squared)
                self.near[rows, : m + 1], self.high[rows], self.low[rows, :m] = which, far[:, 0] * (1 + SLACK), far[:, 1:] * (1 - SLACK)
                self.measured[rows] += m + 1


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(x).ravel()).cast(kind))


def _state(ids: pa.Array, vecs: pa.Array, was: np.ndarray, bounds: Bounds, measured: np.ndarray) -> pa.RecordBatch:
    columns = [ids, vecs, pa.array(was, pa.int32()), _lists(bounds.near, pa.int16()), _lists(bounds.low, pa.float64()), pa.array(bounds.rest), pa.array(bounds.high), pa.array(bounds.used, pa.int32()), pa.array(measured, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "vec", "was", "near", "low", "rest", "high", "used", "measured"])


def _first(centres: np.ndarray, b: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bounds = Bounds.scanned(_matrix(batch.column(1), batch.num_rows), centres, b)
                yield _state(batch.column(0), batch.column(1), np.full(batch.num_rows, -1), bounds, bounds.measured)

    return of


def _moved(batch: pa.RecordBatch, centres: np.ndarray, moves: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, Bounds]:
    """Vectors, their centroids before, and their bounds after the move."""
    n = batch.num_rows
    x, near = _matrix(batch.column(1), n), _matrix(batch.column(3), n).astype(np.int64)
    # Lists of one centroid have no bounds of their own.
    low = _matrix(batch.column(4), n).copy() if near.shape[1] > 1 else np.zeros((n, 0))
    bounds = Bounds(near.copy(), low, batch.column(5).to_numpy(), batch.column(6).to_numpy()).shortened(b)
    bounds.move(x, centres, moves)
    return x, near[:, 0], bounds


def _next(centres: np.ndarray, moves: np.ndarray, b: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, was, bounds = _moved(batch, centres, moves, b)
                yield _state(batch.column(0), batch.column(1), was, bounds, batch.column(8).to_numpy() + bounds.measured)

    return of


def _last(centres: np.ndarray, moves: np.ndarray, b: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, _, bounds = _moved(batch, centres, moves, b)
                far = distances(x, centres, bounds.near[:, :1])[:, 0]
                measured = batch.column(8).to_numpy() + bounds.measured
                # A distance beyond a long is an error, as the result could not hold it.
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bounds.near[:, 0], pa.int32()), pa.array([int(d) for d in far], pa.int64()), pa.array(measured, pa.int64())], names=["id", "cluster", "distance", "measured"])

    return of


def _changes(k: int, dim: int):
    """Of each task: by centroid, how many more vectors it has than before, and by how much their sums grow."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, was, now = _matrix(batch.column(0), n), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            wide = max(-int(x.min()), int(x.max())) * n >= 2**62
            some = np.zeros((k, dim), object if wide else np.int64)
            x = x.astype(some.dtype)
            np.add.at(some, now, x)
            np.add.at(counts, now, 1)
            left = was >= 0
            np.subtract.at(some, was[left], x[left])
            np.subtract.at(counts, was[left], 1)
            sums += some.astype(object)
        seen = [c for c in range(k) if counts[c] or any(sums[c])]
        if seen:
            flat = pa.array([Decimal(int(v)) for c in seen for v in sums[c]], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * dim), flat)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64()), lists], names=["cluster", "n", "sums"])

    return of


def drake_kmeans(vectors: DataFrame, order: Column, k: int = 40, rounds: int = 5) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid (array<long>) and measured of each of `vectors` (id; vec, integers, all of one length).

    Centroids 0, 1, ... start as the first k vectors by `order`, equals by their components.  Each round assigns every
    vector to the nearest centroid (squared Euclidean distance; ties: the smaller number), then replaces each centroid
    that has vectors by their componentwise floor(sum / count).  After the last, vectors are assigned once more.
    measured is the number of distances computed for the vector, k (rounds + 1) at most without bounds.

    Repeated rows count each; a null id is carried along.  Fewer than k vectors: as many centroids.  No vectors: an
    empty result.  Sums are exact at any size; a distance or inertia beyond a long is an error.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("id", "vec")
    # k rows.
    start = [r["vec"] for r in vectors.orderBy(order, "vec").limit(k).collect()]
    kind = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, measured long"
    if not start:
        return spark.createDataFrame([], kind)
    centres = np.array(start, np.int64).reshape(len(start), -1)
    k, dim = centres.shape
    b = min(k, max(2, -(-k // 4)))
    counts, sums = [0] * k, np.zeros((k, dim), object)
    moves = np.zeros(k)
    state = vectors
    with arrow_bytes(spark, BATCH_BYTES):
        for i in range(rounds):
            before, state = state, durable(state.mapInArrow(_next(centres, moves, b) if i else _first(centres, b), STATE))
            if i:
                discard(before)
                # The longest list that a vector needed.
                b = min(b, max(2, -(-k // 8), state.agg(F.max("used")).first()[0] + 1))
            changed = state.select("vec", "was", F.get("near", F.lit(0)).cast("int").alias("now")).where("was <> now").mapInArrow(_changes(k, dim), "cluster int, n long, sums array<decimal(38,0)>")
            grown = changed.select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
            # k rows for each component.
            for r in grown.collect():
                sums[r["cluster"], r["at"]] += int(r["sum"])
                if r["at"] == 0:
                    counts[r["cluster"]] += r["n"]
            new = np.array([[int(v) // counts[c] for v in sums[c]] if counts[c] else centres[c] for c in range(k)], np.int64).reshape(k, dim)
            apart = new.astype(object) - centres.astype(object)
            moves, centres = _root((apart * apart).sum(1)) * (1 + SLACK), new
        if rounds:
            done = durable(state.mapInArrow(_last(centres, moves, b), DONE))
            discard(state)
        else:
            first = vectors.mapInArrow(_first(centres, b), STATE)
            done = durable(first.mapInArrow(_last(centres, moves, b), DONE))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    # A row for each centroid, k at most.
    by = {r["cluster"]: int(r["total"]) for r in done.groupBy("cluster").agg(total.alias("total")).collect()}
    every = sum(by.values())
    rows = [(c, by[c], every, [int(v) for v in centres[c]]) for c in sorted(by)]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(clusters), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "measured")
