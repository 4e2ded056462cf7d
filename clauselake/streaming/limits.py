"""Limits over requests in order of time: token buckets, lockouts, one count per period.

Each is a rule for one key: what it remembers, the time of a request and a flag give what it remembers next, whether the
request is allowed, and how long to wait.  The same rule runs over a finished table (`in_batch`) and over a stream
(`in_stream`).  A key's requests depend on each other and are seen in order by one task; what a task holds is one key's
memory, however many requests it has.  A rule over all requests runs in slices of time (`in_slices`).
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (remembered, milliseconds, flag) -> (remembered, allowed, milliseconds to wait)
Rule = Callable[[list[float], float, bool], tuple[list[float], bool, int]]


def token_bucket(capacity: float, per_ms: float) -> Rule:
    """Bursts of `capacity`, which refill in `per_ms`; a request takes one token where there is a whole one."""
    rate = capacity / per_ms

    def rule(memory: list[float], at: float, flag: bool) -> tuple[list[float], bool, int]:
        tokens, before = memory or (capacity, at)
        tokens = min(capacity, tokens + (at - before) * rate)
        if tokens < 1:
            return [tokens, at], False, math.ceil((1 - tokens) / rate)
        return [tokens - 1, at], True, 0

    return rule


def once_per(period_ms: float) -> Rule:
    """Allowed (counted) if the last one that was lies `period_ms` back at least."""

    def rule(memory: list[float], at: float, flag: bool) -> tuple[list[float], bool, int]:
        if memory and at - memory[0] < period_ms:
            return memory, False, int(memory[0] + period_ms - at)
        return [at], True, 0

    return rule


def lockout(failures: int = 10, window_ms: float = 15 * 60_000) -> Rule:
    """Refused while `failures` attempts failed within the window; a success (the flag) forgets them."""

    def rule(memory: list[float], at: float, flag: bool) -> tuple[list[float], bool, int]:
        recent = [x for x in memory if at - x < window_ms]
        if len(recent) >= failures:
            return recent, False, int(recent[0] + window_ms - at)
        return ([] if flag else [*recent, at]), True, 0

    return rule


def _judged(rows: pd.DataFrame, memory: list[float], rule: Rule) -> tuple[pd.DataFrame, list[float]]:
    allowed, wait = [], []
    for at, flag in _requests(rows):
        memory, ok, ms = rule(memory, at, flag)
        allowed.append(ok)
        wait.append(ms)
    return rows.assign(allowed=allowed, wait_ms=wait), memory


def _requests(rows: pd.DataFrame) -> Iterator[tuple[float, bool]]:
    return zip(rows["at_ms"].astype(float).tolist(), rows["flag"].astype(bool).tolist())


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("wait_ms", T.LongType())])


def _walked(rows: DataFrame, by: str, rule: Rule, starts: dict[int, list[float]]) -> DataFrame:
    """`rows` judged group after group; a group begins with what `starts` has for it, else with nothing."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, memory = None, []
        for b in batches:
            allowed, wait = [], []
            # Row by row: most groups are small, and one frame for each would cost more than its requests.
            for group, (at, flag) in zip(b[by].tolist(), _requests(b)):
                if group != last:
                    last, memory = group, starts.get(group, [])
                memory, ok, ms = rule(memory, at, flag)
                allowed.append(ok)
                wait.append(ms)
            if allowed:
                yield b.assign(allowed=allowed, wait_ms=wait)

    return rows.repartition(by).sortWithinPartitions(by, "at_ms", "ord").mapInPandas(walk, _schema(rows))


def in_batch(rows: DataFrame, rule: Rule) -> DataFrame:
    """`rows` (key, at_ms, flag, ord and others; no nulls in these) with allowed and wait_ms; `ord` orders requests of one time."""
    return _walked(rows, "key", rule, {})


def _kept(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder that the cluster shares; a temporary one in local mode where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="clauselake-"))
    return df.checkpoint()


#: Requests of a slice, about, and slices at most.
SLICE, GRID = 500_000, 2_000


def _slice(cuts: list[float], first: int = 0) -> Column:
    """How many of the sorted `cuts` lie at or before a request, and `first`: a search by halves."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(F.col("at_ms") < cuts[half], _slice(cuts[:half], first)).otherwise(_slice(cuts[half + 1 :], first + half + 1))


def in_slices(rows: DataFrame, rule: Rule, slices: int | None = None) -> DataFrame:
    """`rows` (at_ms, flag, ord and others; no key) under one rule over all of them, with allowed and wait_ms: as `in_batch` with one key, but in slices of time.

    Each of the `slices` (of about SLICE requests, if not given) is judged as if nothing had come before it, then once
    more from what the one before it ends with.  Slices agree then where the rule forgets within a slice (a bucket fills
    up, a window passes).  Where it does not, the first of each run of slices that still begin with another memory is
    judged again, until all agree: under a limit that is never at rest one after the other, each a job of one task over
    that slice's times.  So a slice is judged a few times, however many there are, and no task holds more than a batch.
    The driver holds one memory a slice.  `rows` are read a few times, hence should be stored.
    """
    n, grid = rows.agg(F.count(F.lit(1)), F.percentile_approx("at_ms", [i / GRID for i in range(1, GRID)])).first()
    slices = min(slices or -(-n // SLICE), GRID) if n else 1
    cuts = sorted({grid[i * GRID // slices - 1] for i in range(1, slices)})
    placed = rows.withColumn("_slice", _slice(cuts))
    last = len(cuts)
    starts: dict[int, list[float]] = {i: [] for i in range(last + 1)}
    if not last:
        return _walked(placed, "_slice", rule, starts).drop("_slice")
    # Slice i is partition i.
    times = _kept(placed.select("_slice", "at_ms", "flag", "ord").repartitionById(last + 1, "_slice").sortWithinPartitions("at_ms", "ord").drop("ord"))

    def ends(some: list[int]) -> dict[int, list[float]]:
        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            here, memory = None, []
            for b in batches:
                if here is None and len(b):
                    here = b["_slice"].iloc[0]
                    memory = starts[here]
                for at, flag in _requests(b):
                    memory, _, _ = rule(memory, at, flag)
            if here is not None:
                yield pd.DataFrame({"_slice": [here], "memory": [memory]})

        done = times.mapInPandas(walk, "_slice int, memory array<double>").rdd
        seen = {r["_slice"]: r["memory"] for r in rows.sparkSession.sparkContext.runJob(done, list, some)}
        return {i: seen.get(i, starts[i]) for i in some}  # a slice without rows passes on what it gets

    stale, rounds = set(range(last)), 0  # what the last slice ends with is of no use
    while stale:
        todo = sorted(i for i in stale if rounds < 2 or i - 1 not in stale)
        stale -= set(todo)
        for i, memory in ends(todo).items():
            if memory != starts[i + 1]:
                starts[i + 1] = memory
                stale |= {i + 1} - {last}
        rounds += 1
    return _walked(placed, "_slice", rule, starts).drop("_slice")


def in_stream(rows: DataFrame, rule: Rule, idle_ms: int, late: str = "1 minute") -> DataFrame:
    """The same over a stream, in append mode: requests of one micro-batch in order of time, batches as they come.

    A key that rests for `idle_ms` of the requests' own time is forgotten, so the state holds recent keys alone.  That
    changes nothing where a rule remembers no longer: a bucket is full again after its refill, a window is over.
    Requests that come more than `late` after the newest of the stream are dropped.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = list(state.get[0]) if state.exists else []
        some = pd.concat(list(batches)).sort_values(["at_ms", "ord"])
        done, memory = _judged(some.drop(columns="_at"), memory, rule)
        state.update((memory,))
        # A timer must lie after the watermark.
        state.setTimeoutTimestamp(max(int(some["at_ms"].iloc[-1]) + 1 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield done

    # A stream's watermark begins at 0, and what lies there would be late: times count from 1.
    timed = rows.withColumn("_at", F.timestamp_millis(F.col("at_ms").cast("long") + 1)).withWatermark("_at", late)
    return timed.groupBy("key").applyInPandasWithState(walk, _schema(rows), "memory array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def two_levels(rows: DataFrame, per_key: Rule, overall: Rule, slices: int | None = None) -> DataFrame:
    """First each key's rule, then, for what that allows, one rule over all keys (see `in_slices`); a key's token is spent either way."""
    first = _kept(in_batch(rows, per_key))
    second = in_slices(first.where("allowed").drop("allowed", "wait_ms"), overall, slices)
    return first.where("not allowed").unionByName(second)
