"""Resamples by digests against a plain version, and what they take."""

import hashlib
import time
from collections import Counter

import numpy as np

from clauselake.functions import digests
from clauselake.operators import metrics


def digest(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_digests():
    for seed, a, b in [(1, [1, 9, 10, 1000], [0, 99_999, 100, 7]), (-12, [5] * 3, [1, 2, 3]), (2**63 - 1, [10**9, 10**10], [999_999_999, 1_000_000_000])]:
        assert digests.leading(seed, np.array(a), np.array(b)).tolist() == [digest(seed, x, y) for x, y in zip(a, b)]
    assert len(digests.leading(1, np.array([], np.int64))) == 0


def test_draws_are_those_of_the_digests(spark):
    cells = spark.createDataFrame([(0, 1, 700), (2, 0, 40), (0, 0, 1), (1, 1, 0), (1, 2, 259)], "gold int, pred int, n long")
    ordered = [(0, 0)] + [(0, 1)] * 700 + [(1, 2)] * 259 + [(2, 0)] * 40
    want = Counter((boot, *ordered[digest(3, boot, j) % 1000]) for boot in range(1, 91) for j in range(1000))  # more than a lot
    assert {(r.boot, r.gold, r.pred): r.n for r in metrics.exact_draws(cells, 90, seed=3).collect()} == want


def test_each_draw_is_digested_once(spark):
    cells = spark.createDataFrame([(g, p, 40 + g - p) for g in range(9) for p in range(9)], "gold int, pred int, n long")
    metrics.exact_draws(cells, 2).collect()
    began = time.monotonic()
    drawn = metrics.exact_draws(cells, 1000).collect()
    assert time.monotonic() - began < 45 and sum(r.n for r in drawn) == 1000 * 81 * 40


def test_both_sides_share_one_table_of_draws(spark):
    rows = spark.createDataFrame([(n % 9, n % 7, (n + n // 50) % 7) for n in range(300)], "gold int, a int, b int")
    got = metrics.paired_bootstrap(rows, "a", "b", 40)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    cells = sorted(Counter((r.gold, r.a, r.b) for r in rows.collect()).items())
    ordered = [c for c, n in cells for _ in range(n)]

    def macro(drawn, at):
        f1 = []
        for cls in {d[0] for d in drawn}:
            tp = sum(d[0] == d[at] == cls for d in drawn)
            f1.append(2 * tp / (sum(d[0] == cls for d in drawn) + sum(d[at] == cls for d in drawn)))
        return sum(f1) / len(f1)

    deltas = []
    for boot in range(1, 41):
        drawn = [ordered[digest(1, boot, j) % 300] for j in range(300)]
        deltas.append(macro(drawn, 2) - macro(drawn, 1))
    r = got.first()
    assert abs(r.delta - np.mean(deltas)) < 1e-12 and abs(r.low - np.quantile(deltas, 0.025)) < 1e-12 and abs(r.high - np.quantile(deltas, 0.975)) < 1e-12
    assert r.b_better == np.mean([d > 0 for d in deltas])
