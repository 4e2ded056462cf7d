"""Exact k-means with adaptive bounds against plain rounds."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from clauselake.llm import centroids, queries

from . import brute

VECTORS = "id long, vec array<long>"


def plain(rows, k, rounds):
    placed, inertia, centres = brute.kmeans(rows, k, rounds)
    own = [sum(d for c, d in placed.values() if c == n) for n in range(len(centres))]
    return {i: (c, d, own[c], inertia, centres[c]) for i, (c, d) in placed.items()}


def clustered(spark, rows, k, rounds):
    out = centroids.drake_kmeans(spark.createDataFrame(rows, VECTORS), centroids.hash_order("2:"), k, rounds).collect()
    return {r.id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in out}, sum(r.measured for r in out)


@pytest.mark.parametrize("k, rounds, high, middle", [(7, 5, 4, 0), (1, 3, 100, 0), (30, 5, 1000, 0), (5, 0, 50, 0), (9, 4, 2**26, 0), (6, 3, 900, 2**40)])
def test_equals_plain_rounds(spark, k, rounds, high, middle):
    rng = np.random.default_rng(k)
    rows = [(i, rng.integers(middle - high, middle + high, 3).tolist()) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(40)]
    assert clustered(spark, rows, k, rounds)[0] == plain(rows, k, rounds)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [3, 4]), (2, [3, 4]), (3, [0, 0])]
    assert clustered(spark, rows, 40, 5)[0] == plain(rows, 40, 5)
    assert clustered(spark, [], 40, 5)[0] == {}


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(5)
    middle = rng.integers(-4000, 4000, (40, 8))
    rows = [(i, (middle[i % 40] + rng.integers(-60, 60, 8)).tolist()) for i in range(4000)]
    got, measured = clustered(spark, rows, 40, 5)
    assert measured < 0.5 * len(rows) * 40 * 6
    x, centre = np.array([v for _, v in rows]), {c: m for c, *_, m in got.values()}
    far = ((x[:, None, :] - np.array([centre[c] for c in sorted(centre)])[None]) ** 2).sum(2)
    assert [sorted(centre)[j] for j in far.argmin(1)] == [got[i][0] for i, _ in rows]


def test_what_takes_part(spark):
    good = [float(i) / 7 for i in range(64)]
    rows = [(1, good), (2, None), (3, good[:63]), (4, [None, *good[1:]]), (5, [float("nan"), *good[1:]]), (6, [math.inf, *good[1:]]), (None, good), (1, good), (7, [-x for x in good])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id int")
    kept = centroids.integers(vectors, 64)
    got = sorted((r.id or 0, r.cluster, r.distance) for r in centroids.drake_kmeans(kept, centroids.hash_order("2:"), 2, 2).collect())
    assert [i for i, *_ in got] == [0, 1, 1, 7] and {v for v in kept.where("id = 7").first().vec} == {math.floor(-256 * x) for x in good}
    assert len({c for i, c, _ in got if i != 7}) == 1
    assert centroids.drake_kmeans(kept.limit(0), centroids.hash_order("2:")).count() == 0


def test_op11(spark, small):
    t = pq.read_table(f"{small}/embeddings.parquet").to_pydict()
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in zip(t["vec_id"], t["embedding"])]
    want = {i: (c, d, own, inertia, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for i, (c, d, own, inertia, m) in plain(rows, 40, 5).items()}
    got = {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in queries.op11_drake_kmeans(spark, small).collect()}
    assert got == want
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{small}/embeddings.parquet'")
    assert {r[0]: r[1:] for r in con.sql(queries.ORACLES["op11_drake_kmeans"]).fetchall()} == want
