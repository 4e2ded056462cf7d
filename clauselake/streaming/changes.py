"""Changes and caches: what differs from before, the newest of a key, what is still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(rows: DataFrame, key: str, time: str, print_: str, quiet_ms: int = 400) -> DataFrame:
    """Rows after which a key is quiet for `quiet_ms`, and whose fingerprint differs from the one sent before."""
    by = Window.partitionBy(key).orderBy(time)
    settled = rows.withColumn("_next", F.lead(F.unix_millis(time)).over(by)).where(F.col("_next").isNull() | (F.col("_next") - F.unix_millis(time) >= quiet_ms))
    before = settled.withColumn("_before", F.lag(print_).over(by))
    return before.where(~F.col(print_).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_next", "_before")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest `order`: a newer job takes the place of the others."""
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return top.select("_row.*")


def of_newest(progress: DataFrame, jobs: DataFrame, key: str, job: str) -> DataFrame:
    """Progress of each key's newest job; that of others is not wanted any more."""
    return progress.join(newest(jobs.select(key, job), key, job), [key, job], "left_semi")


def throttled(rows: DataFrame, key: str, time: str, every_ms: int = 300) -> DataFrame:
    """The last row of each key in each stretch of `every_ms`."""
    stretch = F.floor(F.unix_millis(time) / every_ms)
    return rows.groupBy(key, stretch.alias("_at")).agg(F.max_by(F.struct(*rows.columns), time).alias("_row")).select("_row.*")


def distinct_hosts(requests: DataFrame, page: str, host: str, kind: str, time: str, most: int = 50) -> DataFrame:
    """page, hosts: the first `most` different hosts that a page's scripts send to."""
    first = requests.where(F.col(kind).isin("fetch", "xmlhttprequest", "beacon")).groupBy(page, host).agg(F.min(time).alias("_first"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy("_first", host))).where(F.col("_n") <= most)
    return ranked.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", host))), lambda x: x[host]).alias("hosts"))


def fresh(saved_at: Column, now: Column, ttl_ms: int, same: Column | None = None) -> Column:
    """Whether a cached value still holds: younger than `ttl_ms`, and made from the same thing."""
    young = F.unix_millis(now) - F.unix_millis(saved_at) < ttl_ms
    return F.coalesce(young if same is None else young & same, F.lit(False))
