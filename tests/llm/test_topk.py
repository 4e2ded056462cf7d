"""The pivot-distance index against all scores: ties across parts, empty and mixed vectors, large components, and what is opened."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import exact_topk


def want(rows, k=5, every=50):
    out = []
    for q, v in rows:
        if q % every == 0:
            scores = [(-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def got(spark, rows, **options):
    vectors = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "id long, vec array<long>")
    found = exact_topk.top_k(vectors, F.col("id") % 50 == 0, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found), found


@pytest.mark.parametrize("seed", range(3))
def test_clusters(spark, monkeypatch, seed):
    monkeypatch.setattr(exact_topk, "PART_ROWS", 20)
    monkeypatch.setattr(exact_topk, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 400, (12, 6))
    rows = [(i, np.floor(centres[i % 12] + rng.normal(0, 15, 6))) for i in range(1200)]
    rows += [(2000 + i, rows[0][1]) for i in range(90)]  # a third of one annulus is one vector: ties across parts
    found, raw = got(spark, rows)
    assert found == want(rows)
    # Well parted clusters: most rows are never looked at.
    assert np.mean([r.opened for r in raw]) < 0.5 * len(rows)


def test_empty_mixed_and_zero(spark):
    rows = [(0, []), (50, []), (7, []), (100, [0, 0]), (101, [3, 4]), (102, [-3, 4]), (150, [1, 0]), (200, [5])]
    assert got(spark, rows)[0] == want(rows)
    assert got(spark, rows, k=1)[0] == want(rows, 1)
    assert got(spark, [(1, [1, 2])])[0] == []


def test_large_components(spark):
    big = 2_560_000_000 // 2
    rows = [(0, [big, 1]), (1, [big, 2]), (2, [big, 3]), (3, [-big, 0]), (4, [big - 1, 7])]
    assert got(spark, rows)[0] == want(rows)
    # One vector whose square passes 2**63: the scores asked for do not.
    rows = [(0, [4_000_000_000, 0]), (1, [1, 1]), (50, [-3, 2]), (2, [4_000_000_000, 5])]
    assert got(spark, [rows[0], rows[1], rows[2]])[0] == want(rows[:3])
    rng = np.random.default_rng(3)
    rows = [(0, [2_560_000_000] * 64), *((i, rng.integers(-128, 128, 64).tolist()) for i in range(1, 400))]
    assert got(spark, rows)[0] == want(rows)
    with pytest.raises(Exception, match="does not fit a long"):
        got(spark, [(0, [4_000_000_000, 0]), (1, [4_000_000_000, 0])])


def test_ties_beyond_doubles(spark):
    rows = [(i, [2**30 + 1, 2**25 + i // 3]) for i in range(60)]
    assert got(spark, rows)[0] == want(rows)


def test_found_rows_are_merged_in_their_task(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "PART_ROWS", 5)
    monkeypatch.setattr(exact_topk, "HELD", 7)
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-9, 9, 3).tolist()) for i in range(300)]
    assert got(spark, rows)[0] == want(rows)
