"""Limits in batch and over a stream, changes and caches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clauselake.streaming import changes, limits

COLUMNS = "key string, at_ms double, flag boolean, ord long"


def judged(spark, rule, rows):
    df = spark.createDataFrame([(k, float(t), f, n) for n, (k, t, f) in enumerate(rows)], COLUMNS)
    return [(r.allowed, r.wait_ms) for r in limits.in_batch(df, rule).orderBy("ord").collect()]


def test_token_bucket(spark):
    rows = [("a", 0, False), ("a", 0, False), ("a", 0, False), ("b", 0, False), ("a", 29_999, False), ("a", 30_000, False), ("a", 600_000, False), ("a", 600_001, False), ("a", 600_002, False)]
    # Two a minute: half a minute makes one.
    assert judged(spark, limits.token_bucket(2, 60_000), rows) == [
        (True, 0), (True, 0), (False, 30_000), (True, 0), (False, 1), (True, 0), (True, 0), (True, 0), (False, 29_998),
    ]


def test_lockout(spark):
    rule = limits.lockout(3, 1000)
    rows = [("a", t, False) for t in (0, 10, 20, 30)] + [("a", 999, True), ("a", 1000, True), ("a", 1001, False), ("b", 5, False)]
    assert judged(spark, rule, rows) == [(True, 0), (True, 0), (True, 0), (False, 970), (False, 1), (True, 0), (True, 0), (True, 0)]


@pytest.mark.parametrize("gap", [3, 40, 2000])  # never at rest, now and then, always
@pytest.mark.parametrize("rule", [limits.token_bucket(5, 500), limits.once_per(100), limits.lockout(3, 200)])
def test_slices_of_time_are_one_sequence(spark, rule, gap):
    draw = random.Random(gap)
    times, at = [], 0
    for _ in range(300):
        at += draw.choice([0, 0, draw.randrange(gap)])
        times.append(at)
    rows = spark.createDataFrame([("all", float(t), draw.random() < 0.1, n) for n, t in enumerate(times)], COLUMNS)
    want = {r.ord: (r.allowed, r.wait_ms) for r in limits.in_batch(rows, rule).collect()}
    for slices in (1, 7):
        assert {r.ord: (r.allowed, r.wait_ms) for r in limits.in_slices(rows.drop("key"), rule, slices).collect()} == want


def test_once_per_and_two_levels(spark):
    day = 86_400_000
    assert [x for x, _ in judged(spark, limits.once_per(day), [("a", 0, False), ("a", day - 1, False), ("a", day, False), ("a", 2 * day - 1, False)])] == [True, False, True, False]
    df = spark.createDataFrame([("a", 0.0, False, 0), ("a", 1.0, False, 1), ("b", 2.0, False, 2), ("c", 3.0, False, 3)], COLUMNS)
    got = limits.two_levels(df, limits.token_bucket(1, 1e9), limits.token_bucket(2, 1e9)).orderBy("ord").collect()
    assert [r.allowed for r in got] == [True, False, True, False]
    assert limits.two_levels(df.limit(0), limits.once_per(5), limits.once_per(5)).count() == 0
    assert limits.in_batch(df.limit(0), limits.once_per(5)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rule = limits.token_bucket(3, 1000)
    rows = [(f"k{i % 3}", float(i * 37), False, i) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], COLUMNS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    q = limits.in_stream(stream, rule, 1000).writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = limits.in_batch(spark.createDataFrame(rows, COLUMNS), rule)
    assert sorted(spark.table("judged").collect()) == sorted(want.collect())


def test_idle_keys_leave_the_state(spark, tmp_path):
    """Keys come once each, later ones later: only recent ones stay, and what is judged does not change; very late requests are dropped."""
    rule = limits.token_bucket(1, 5_000)
    batches = [[(f"k{b}-{i}", b * 100_000.0 + i, False, b * 10 + i) for i in range(5)] for b in range(4)]
    batches[3].append(("k3-0", 3 * 100_000.0 + 9, False, 99))
    batches.append([("late", 5.0, False, 500), ("new", 400_000.0, False, 501)])
    stream_in, where = str(tmp_path / "in"), str(tmp_path / "c")
    seen, kept = 0, []
    for rows in batches:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").json(stream_in)
        stream = spark.readStream.schema(COLUMNS).json(stream_in)
        q = limits.in_stream(stream, rule, 5_000, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", where).trigger(availableNow=True).start()
        q.awaitTermination(120)
        kept.append(q.recentProgress[-1].stateOperators[0].numRowsTotal if q.recentProgress else 0)
        seen += len(rows)
    out = {r.ord: (r.allowed, r.wait_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(out) == seen - 1 and 500 not in out
    assert out[99] == (False, 4_991) and all(ok for n, (ok, _) in out.items() if n != 99)
    assert max(kept) <= 11, kept


def test_changes(spark):
    t0 = datetime(2026, 1, 1)
    at = lambda ms: t0 + timedelta(milliseconds=ms)
    rows = spark.createDataFrame([("p", at(0), "x"), ("p", at(100), "y"), ("p", at(600), "y"), ("p", at(1200), "z"), ("q", at(0), "x")], "page string, ts timestamp, print string")
    assert sorted((r.page, r["print"], r.ts) for r in changes.changed(rows, "page", "ts", "print").collect()) == [("p", "y", at(100)), ("p", "z", at(1200)), ("q", "x", at(0))]
    assert sorted(r.ts for r in changes.throttled(rows.where("page = 'p'"), "page", "ts", 300).collect()) == [at(100), at(600), at(1200)]
    jobs = spark.createDataFrame([("t", 1), ("t", 3), ("u", 2)], "tab string, job long")
    assert sorted((r.tab, r.job) for r in changes.of_newest(jobs, jobs, "tab", "job").collect()) == [("t", 3), ("u", 2)]
    sent = spark.createDataFrame([("p", "b.com", "fetch", at(2)), ("p", "a.com", "beacon", at(1)), ("p", "a.com", "fetch", at(9)), ("p", "c.com", "img", at(0))], "page string, host string, kind string, ts timestamp")
    assert changes.distinct_hosts(sent, "page", "host", "kind", "ts").first().hosts == ["a.com", "b.com"]
    row = spark.createDataFrame([(at(0), at(1000))], "saved timestamp, now timestamp")
    assert row.select(changes.fresh(F.col("saved"), F.col("now"), 1001), changes.fresh(F.col("saved"), F.col("now"), 1000), changes.fresh(F.col("saved"), F.col("now"), 5000, F.lit(None).cast("boolean"))).first()[:] == (True, False, False)


@pytest.mark.parametrize("rule", [limits.lockout(), limits.once_per(10.0)])
def test_hot_key_needs_little_memory(rule):
    memory = []
    for t in range(5000):
        memory, _, _ = rule(memory, float(t), False)
    assert len(memory) <= 10


def test_slices_are_judged_a_few_times(spark):
    """A bucket that is never at rest: rounds over all slices that still differ would judge half of their number squared."""
    slices, n = 24, 480
    calls = spark.sparkContext.accumulator(0)
    bucket = limits.token_bucket(5, 100_000)

    def rule(memory, at, flag):
        calls.add(1)
        return bucket(memory, at, flag)

    rows = spark.createDataFrame([("all", float(t * 37), False, t) for t in range(n)], COLUMNS)
    got = {r.ord: (r.allowed, r.wait_ms) for r in limits.in_slices(rows.drop("key"), rule, slices).collect()}
    assert n < calls.value <= 5 * n
    assert got == {r.ord: (r.allowed, r.wait_ms) for r in limits.in_batch(rows, bucket).collect()}
    one = {r.ord: (r.allowed, r.wait_ms) for r in limits.in_slices(rows.withColumn("at_ms", F.lit(7.0)), bucket, slices).collect()}
    assert sum(ok for ok, _ in one.values()) == 5 and all(one[i][0] for i in range(5))
