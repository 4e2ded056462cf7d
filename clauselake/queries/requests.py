"""Limits over users' events, as if each event were a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import changes, limits
from .store import table

DAY = 86_400_000


def requests(spark, sf_dir):
    """A failed attempt is an event of small value."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    return e.select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("at_ms"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("flag"), F.col("event_id").alias("ord"))


def shown(rows):
    return rows.select(F.col("ord").alias("event_id"), "allowed", "wait_ms")


def rate_limited_events(spark, sf_dir):
    """Two requests a day, bursts of two."""
    return shown(limits.in_batch(requests(spark, sf_dir), limits.token_bucket(2, DAY)))


def twice_limited_events(spark, sf_dir):
    """Two a day for each user, then ten a day over all."""
    return shown(limits.two_levels(requests(spark, sf_dir), limits.token_bucket(2, DAY), limits.token_bucket(10, DAY)))


def counted_reports(spark, sf_dir):
    """One report of a user in 24 hours counts, from the last that did."""
    return shown(limits.in_batch(requests(spark, sf_dir), limits.once_per(DAY)))


def lockouts(spark, sf_dir):
    """Three failures within four days lock a user out."""
    return shown(limits.in_batch(requests(spark, sf_dir), limits.lockout(3, 4 * DAY)))


def changed_events(spark, sf_dir):
    """Events after which a user is quiet for an hour, where their type differs from the one before."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return changes.changed(e, "user_id", "at", "event_type", 3_600_000).select("event_id")


def newest_events(spark, sf_dir):
    return changes.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


QUERIES = {f.__name__: f for f in (rate_limited_events, twice_limited_events, counted_reports, lockouts, changed_events, newest_events)}

EVENTS = "e as (select user_id as key, cast((epoch_us(ts) // 1000) as double) as t, value > 20 as flag, event_id, row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as n from events where user_id is not null and ts is not null)"


def bucket(name: str, source: str, capacity: int) -> str:
    """A walk over each key's requests: x is what the bucket holds before the request."""
    rate = f"({capacity}::double / {DAY}::double)"
    return f"""
  {name} as (
    select key, n, event_id, t, {capacity}::double as x from {source} where n = 1
    union all
    select s.key, s.n, s.event_id, s.t, least({capacity}::double, case when w.x < 1 then w.x else w.x - 1 end + (s.t - w.t) * {rate}) from {name} w join {source} s on s.key = w.key and s.n = w.n + 1
  ), {name}_out as (select key, t, event_id, x >= 1 as allowed, cast(case when x >= 1 then 0 else ceil((1 - x) / {rate}) end as bigint) as wait_ms from {name})
"""


ORACLES = {
    "rate_limited_events": f"with recursive {EVENTS}, {bucket('w', 'e', 2)} select event_id, allowed, wait_ms from w_out",
    "twice_limited_events": f"""with recursive {EVENTS}, {bucket('w', 'e', 2)}, p as (select 'all' as key, t, event_id, row_number() over (order by t, event_id) as n from w_out where allowed), {bucket('o', 'p', 10)}
        select event_id, allowed, wait_ms from w_out where not allowed union all select event_id, allowed, wait_ms from o_out""",
    "counted_reports": f"""with recursive {EVENTS}, w as (
        select key, n, event_id, t, t as last, true as allowed, 0::bigint as wait_ms from e where n = 1
        union all
        select e.key, e.n, e.event_id, e.t, case when e.t - w.last < {DAY} then w.last else e.t end, e.t - w.last >= {DAY}, cast(case when e.t - w.last < {DAY} then w.last + {DAY} - e.t else 0 end as bigint) from w join e on e.key = w.key and e.n = w.n + 1)
        select event_id, allowed, wait_ms from w""",
    "lockouts": f"""with recursive {EVENTS}, w as (
        select key, n, event_id, t, flag, []::double[] as recent from e where n = 1
        union all
        select e.key, e.n, e.event_id, e.t, e.flag, list_filter(case when len(w.recent) >= 3 then w.recent when w.flag then []::double[] else list_append(w.recent, w.t) end, lambda x: e.t - x < {4 * DAY}) from w join e on e.key = w.key and e.n = w.n + 1)
        select event_id, len(recent) < 3 as allowed, cast(case when len(recent) < 3 then 0 else recent[1] + {4 * DAY} - t end as bigint) as wait_ms from w""",
    "changed_events": """with s as (select *, (epoch_us(ts) // 1000) as m, lead((epoch_us(ts) // 1000)) over (partition by user_id order by ts) as next from events),
        q as (select *, lag(event_type) over (partition by user_id order by ts) as before from s where next is null or next - m >= 3600000)
        select event_id from q where before is null or event_type is distinct from before""",
    "newest_events": "select user_id, max(event_id) as event_id from events group by 1",
}
