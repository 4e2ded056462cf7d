"""Exact top-k by inner product over a pivot-distance index.

Vectors are lifted onto a sphere (one more component makes all norms equal), where the largest inner product is the
least angle.  Each vector is keyed by its nearest pivot and by its distance to it, an angle, cut into annuli; an annulus
with many rows is split into parts.  A query sorts the annuli by the best score that the triangle inequality leaves
them, and opens them in that order, round by round: a few in the first, four times as many in each further one.  Each
round raises the query's k-th score so far, and it stops once the next annulus cannot reach that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable

#: The index is fitted on this many rows, those with the least hash of their id; all rows are indexed.
SAMPLE = 2048
#: Rows of a part, queries of a block, annuli that a query opens in the first round.
PART_ROWS, BLOCK_QUERIES, FIRST = 4096, 256, 8
#: Inner products below the first are exact in doubles, below the second in longs; others are computed in integers of any size.
DOUBLES, LONGS = 2.0**53, 2.0**63
#: Rows found that a task holds before it keeps the k best of each query.
HELD = 200_000
STATE = "block long, qids binary, qvecs binary, scores binary, ids binary, opened binary, next int, waiting int"
FOUND = "block long, query int, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vec (array<long>: floor(scale * x), x as double).  Vectors null, or holding null or non-finite components, are left out."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, opened: of each row where `is_query` holds (on id), the k other rows of largest inner product, ties to smaller ids.

    opened is the number of rows whose score was computed for the query.  `vectors` has id and vec, integers (see
    `quantized`).  A row is a candidate of all queries of its length but those with its id; rows without components
    score 0.  Repeated ids are candidates each, and a repeated query gets the best of all its rows.  Fewer rows than
    k: all of them.  No rows or no queries: an empty result.  Scores are exact, however long a vector; an error where
    one of the result does not fit a long.
    """
    spark = vectors.sparkSession
    # One row per vector length: each length is a space of its own.
    lengths = [r["n"] for r in vectors.select(F.size("vec").alias("n")).distinct().collect()]
    parts = [_top_k(vectors.where(F.size("vec") == n), is_query, k, n) for n in sorted(lengths)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, opened long")
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "opened")


#: Stands for scores from here on, of either sign.
FAR = 2**63 - 1


def _products(q: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Inner products, exact; those that do not fit a long are FAR or -FAR."""
    longest = [float((x.astype(np.float64) ** 2).sum(1).max(initial=0)) ** 0.5 for x in (q, vecs)]
    # A norm bounds the partial sums of products of any order.
    most = longest[0] * longest[1] * (1 + 1e-9)
    if most < DOUBLES:
        return (q.astype(np.float64) @ vecs.astype(np.float64).T).astype(np.int64)
    if most < LONGS:
        return q @ vecs.T
    wide = q.astype(object) @ vecs.astype(object).T
    return np.clip(wide, -FAR, FAR).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    near = np.arange(len(scores))
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _pivots(rows: np.ndarray, many: int) -> np.ndarray:
    """Points of the unit sphere: a few rounds of spherical k-means over the sample."""
    at = np.unique(rows, axis=0)
    at = at[:: max(1, len(at) // many)][:many]
    for _ in range(5):
        near = (rows @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, rows)
        size = np.sqrt((sums * sums).sum(1))
        at = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], at)
    return at


class _Sphere:
    """Pivots, and the angles to them, of vectors of squared norm `high` at most."""

    def __init__(self, sample: np.ndarray, high: float, rows: int):
        self.r = high**0.5 or 1.0
        # Half the square root of the number of rows: as many pivots as rows a pivot, up to a factor; the sample bounds them.
        self.pivots = _pivots(self.lift(sample), int(min(max(8, rows**0.5 / 2), max(1, len(sample)))))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.r
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], 1)

    def angles(self, on_sphere: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(on_sphere @ self.pivots.T, -1, 1))

    def bounds(self, q: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query and annulus (its pivot, least and largest distance): no row of it has a larger score."""
        size = np.sqrt((q * q).sum(1))
        to = self.angles(np.concatenate([q / np.where(size > 0, size, 1)[:, None], np.zeros((len(q), 1))], 1))[:, pivot]
        apart = np.maximum(0, np.maximum(low - to, to - high) - 1e-6)
        return size[:, None] * self.r * np.cos(apart) + 1e-6 * (1 + size * self.r)[:, None]


def _top_k(vectors: DataFrame, is_query: Column, k: int, dim: int) -> DataFrame:
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # SAMPLE rows at most come to the driver.
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    total, high = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    sphere = _Sphere(np.array([r["vec"] for r in sample], np.float64).reshape(len(sample), dim), high, total)
    width = np.pi / 32

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = sphere.angles(sphere.lift(np.stack(b["vec"].to_numpy()).astype(np.float64)))
                near = d.argmin(1)
                d = d[np.arange(len(d)), near]
                yield pd.DataFrame({"id": b["id"], "vec": b["vec"], "pivot": near.astype(np.int32), "annulus": np.floor(d / width).astype(np.int32), "dist": d})

    keyed = durable(vectors.select("id", "vec").mapInPandas(key, "id long, vec array<long>, pivot int, annulus int, dist double"))
    # One row for each annulus, SAMPLE pivots of 33 annuli at most: may be broadcast, and listed by the driver.
    cells = keyed.groupBy("pivot", "annulus").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    listed = np.array(sorted((r["pivot"], r["annulus"], r["low"], r["high"]) for r in cells.collect()), np.float64).reshape(-1, 4)
    pivot, low, far = listed[:, 0].astype(np.int64), listed[:, 2], listed[:, 3]
    salted = keyed.join(F.broadcast(cells.select("pivot", "annulus", "parts")), ["pivot", "annulus"]).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id", "dist"), F.col("parts")).cast("int"))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pivot": g["pivot"].iloc[:1], "annulus": g["annulus"].iloc[:1], "ids": [g["id"].to_numpy(np.int64).tobytes()], "vecs": [np.stack(g["vec"].to_numpy()).astype("<i8").tobytes()]})

    index = durable(salted.groupBy("pivot", "annulus", "part").applyInPandas(packed, "pivot int, annulus int, ids binary, vecs binary"))
    discard(keyed)
    asking = vectors.where(is_query)
    block = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(max(1, -(-asking.count() // BLOCK_QUERIES))))

    def begun(g: pd.DataFrame) -> pd.DataFrame:
        n, none = len(g), np.zeros((len(g), k), np.int64)
        return pd.DataFrame({"block": [g["block"].iloc[0]], "qids": [g["id"].to_numpy(np.int64).tobytes()], "qvecs": [np.stack(g["vec"].to_numpy()).astype("<i8").tobytes()], "scores": [none.tobytes()], "ids": [(none - 1).tobytes()], "opened": [np.zeros((n, 2), np.int64).tobytes()], "next": [0], "waiting": [n]})

    state = durable(asking.select("id", "vec", block.alias("block")).groupBy("block").applyInPandas(begun, STATE))

    def read(x) -> tuple[np.ndarray, ...]:
        """ids and vectors of queries; scores and ids found so far; how many were found, and rows opened."""
        own = np.frombuffer(x.qids, np.int64)
        n = len(own)
        return own, np.frombuffer(x.qvecs, "<i8").reshape(n, dim), *(np.frombuffer(y, np.int64).reshape(n, k).copy() for y in (x.scores, x.ids)), np.frombuffer(x.opened, np.int64).reshape(n, 2).copy()

    def floors(scores: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Each query's k-th score so far: annuli below it stay shut."""
        last = scores[:, k - 1].astype(np.float64)
        # Beyond 2**53 a double may lie above the score.
        return np.where(counted[:, 0] >= k, np.where(np.abs(last) < DOUBLES, last, np.nextafter(last, -np.inf)), -np.inf)

    def order(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annuli of each query, the most promising first, and their bounds."""
        bound = sphere.bounds(q.astype(np.float64), pivot, low, far)
        by = np.argsort(-bound, 1, kind="stable")
        return by, np.take_along_axis(bound, by, 1)

    def ask(many: int):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for x in b.itertuples():
                    own, q, scores, _, counted = read(x)
                    by, bound = order(q)
                    part = slice(x.next, x.next + many)
                    floor = floors(scores, counted)
                    rows, at = np.nonzero(bound[:, part] >= floor[:, None])
                    cell = by[:, part][rows, at]
                    turn = np.argsort(cell, kind="stable")
                    rows, cell = rows[turn], cell[turn]
                    for c, some in zip(cell[np.append(0, np.flatnonzero(np.diff(cell)) + 1)] if len(cell) else [], np.split(rows, np.flatnonzero(np.diff(cell)) + 1)):
                        yield pd.DataFrame({"pivot": [int(listed[c, 0])], "annulus": [int(listed[c, 1])], "block": [x.block], "which": [some.astype(np.int64).tobytes()], "qids": [own[some].tobytes()], "qvecs": [q[some].tobytes()], "floors": [floor[some].tobytes()]})

        return state.mapInPandas(of, "pivot int, annulus int, block long, which binary, qids binary, qvecs binary, floors binary")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        looked: dict[tuple[int, int], int] = {}

        def kept() -> pd.DataFrame:
            """Of all that the task holds, the k best rows of each query, and how many were looked at for it: there the id is no id."""
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
            new = np.append(True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))[: len(rows)]
            at = np.arange(len(rows))
            rows = rows[at - np.maximum.accumulate(np.where(new, at, 0)) < k]
            counts = np.array([(block, query, 0, n) for (block, query), n in looked.items()], np.int64)
            held.clear()
            looked.clear()
            out = pd.DataFrame(np.concatenate([rows, counts]), columns=["block", "query", "vec_id", "score"]).astype({"vec_id": "Int64"})
            out.loc[len(rows) :, "vec_id"] = None
            return out

        for b in batches:
            for x in b.itertuples():
                got, own, which = (np.frombuffer(y, np.int64) for y in (x.ids, x.qids, x.which))
                vecs, q = (np.frombuffer(y, "<i8").reshape(n, dim) for y, n in ((x.vecs, len(got)), (x.qvecs, len(own))))
                scores, floor = _products(q, vecs), np.frombuffer(x.floors)
                found = []
                for i, row in enumerate(scores):
                    other = np.flatnonzero(got != own[i])
                    near = other[row[other] >= floor[i]]
                    best = near[_best(row[near], got[near], k)]
                    # A first row says how many were looked at: its id is no id.
                    looked[x.block, which[i]] = looked.get((x.block, which[i]), 0) + len(other)
                    found += [(x.block, which[i], got[j], row[j]) for j in best]
                held.append(np.array(found, np.int64).reshape(-1, 4))
                if sum(map(len, held)) + len(looked) > HELD:
                    yield kept()
        if looked:
            yield kept()

    def merged(many: int):
        def of(old: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            x = next(old.itertuples())
            own, q, scores, ids, counted = read(x)
            looked = found["vec_id"].isna().to_numpy()
            np.add.at(counted[:, 1], found["query"].to_numpy(np.int64)[looked], found["score"].to_numpy(np.int64)[looked])
            found = found[~looked]
            place, slot = np.nonzero(np.arange(k)[None, :] < counted[:, :1])
            row = np.append(place, found["query"].to_numpy(np.int64))
            score, vec = np.append(scores[place, slot], found["score"].to_numpy(np.int64)), np.append(ids[place, slot], found["vec_id"].to_numpy(np.int64))
            turn = np.lexsort((vec, -score, row))
            row, score, vec = row[turn], score[turn], vec[turn]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < k
            scores[row[top], rank[top]], ids[row[top], rank[top]] = score[top], vec[top]
            counted[:, 0] = np.bincount(row[top], minlength=len(own))
            _, bound = order(q)
            reached = x.next + many
            waiting = int((bound[:, reached] >= floors(scores, counted)).sum()) if reached < bound.shape[1] else 0
            return pd.DataFrame({"block": [x.block], "qids": [x.qids], "qvecs": [x.qvecs], "scores": [scores.tobytes()], "ids": [ids.tobytes()], "opened": [counted.tobytes()], "next": [reached], "waiting": [waiting]})

        return of

    many, done = FIRST, []
    while not state.isEmpty():
        # What an annulus and its queries weigh is not seen in the size of the input: never broadcast.
        found = ask(many).hint("merge").join(index.hint("merge"), ["pivot", "annulus"]).select("block", "ids", "vecs", "which", "qids", "qvecs", "floors").mapInPandas(search, FOUND)
        before, state = state, durable(state.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(merged(many), STATE))
        discard(before)
        done.append(state.where("waiting = 0"))
        state = durable(state.where("waiting > 0"))
        many *= 4
    discard(index)

    def result(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples():
                own, _, scores, ids, counted = read(x)
                place, slot = np.nonzero(np.arange(k)[None, :] < counted[:, :1])
                if np.isin(scores[place, slot], (FAR, -FAR)).any():
                    raise OverflowError("a score of the result does not fit a long")
                yield pd.DataFrame({"query_id": own[place], "vec_id": ids[place, slot], "score": scores[place, slot], "opened": counted[place, 1]})

    out = done[0] if done else state
    for x in done[1:]:
        out = out.unionByName(x)
    return out.mapInPandas(result, "query_id long, vec_id long, score long, opened long")
