"""Maximal runs against a plain search, and op13 against its contract."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clauselake.llm import periodic, queries

from . import brute


def digest(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_runs_of_small_alphabets():
    rng = np.random.default_rng(7)
    kinds = (
        lambda n: rng.integers(0, rng.integers(2, 5), n),
        lambda n: np.resize(rng.integers(0, 50, rng.integers(1, 20)), n),
        lambda n: np.concatenate([rng.integers(0, 30, 9), np.resize(rng.integers(0, 9, rng.integers(1, 9)), n), rng.integers(0, 30, 5)]),
        lambda n: np.array([int(x) for x in "abaababaabaab".translate({97: 48, 98: 49})] * (n // 13), np.int64),
    )
    found = 0
    for turn in range(400):
        texts = [np.asarray(kinds[rng.integers(4)](int(rng.integers(0, 70))), np.int64) for _ in range(rng.integers(1, 4))]
        least = int(rng.choice([2, 3, 5, 12]))
        start, length, period = periodic.maximal_runs(np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts]), least)
        want, at = [], 0
        for x in texts:
            want += [(a + at, n, q) for a, n, q in brute.runs(x.tolist(), least)]
            at += len(x)
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want
        found += len(want)
    assert found > 1000


@pytest.mark.parametrize("block", [1, 50])
def test_leaves_in_blocks(monkeypatch, block):
    monkeypatch.setattr(periodic, "LEAVES", block)
    x = np.resize(np.array([1, 2, 1, 1, 3]), 203)
    assert [v.tolist() for v in periodic.maximal_runs(x, np.zeros(len(x), np.int64))] == [[0], [203], [5]]


def test_odd_texts(spark):
    again = "la la la " * 5000
    texts = ["", None, " \t\n", "one", "ab ab " * 6, again, "x " + again + "y", "ab ab " * 6, "\x1c    " * 12]
    rows = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, runs int, collapsed int")
    rows = rows.unionByName(spark.range(1).select(F.lit(99).cast("long").alias("doc_id"), F.expr("cast(unhex(repeat('FF20FE20', 9)) as string)").alias("text"), F.lit(1).alias("runs"), F.lit(1).alias("collapsed")))
    rows = rows.unionByName(rows.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], bytes(r.c)) for r in periodic.with_runs(rows).withColumn("c", F.col("collapsed").cast("binary")).collect()}
    assert got == {
        0: (0, [], b""), 1: (0, [], b""), 2: (0, [], b""), 3: (1, [], b"one"), 4: (12, [(0, 12, 1)], b"ab"), 5: (15000, [(0, 15000, 1)], b"la"),
        6: (15002, [(1, 15000, 1)], b"x la y"), 7: (12, [(0, 12, 1)], b"ab"), 8: (24, [(0, 24, 2)], "\x1c   ".encode()), 99: (18, [(0, 18, 2)], b"\xff \xfe"), None: (12, [(0, 12, 1)], b"ab"),
    }
    assert periodic.with_runs(rows.limit(0)).count() == 0


def test_op13(spark, small):
    t = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, small).collect()}
    assert len(got) == len(t["doc_id"])
    many = 0
    for i, text in zip(t["doc_id"], t["text"]):
        words, h = brute.words(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = brute.runs(words, 12)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (len(runs), *(best and (*best, 1000 * best[1] // best[2]) or (None,) * 4), digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for j, w in enumerate(words) if j not in gone)))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
        many += len(runs)
    assert many > 50
