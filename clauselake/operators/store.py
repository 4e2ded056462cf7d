"""The results store: temporal reads, rankings, upserts and purges, as plans over DataFrames.

`results` has id, url, domain, created_at, expires_at, passage_count, unfair_count and others.  `now` is always an
argument.  A row is live while expires_at > now; of the live rows of a url the newest (then the largest id) is current.
Rows with a null url or expiry are never live.  Repeated rows count as they are; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..labels import MOST_PASSAGES, TTL_DAYS, UNFAIR

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def as_time(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def live(results: DataFrame, now) -> DataFrame:
    return results.where(F.col("expires_at") > as_time(now))


def current(results: DataFrame, now) -> DataFrame:
    """One row per url.  One shuffle by url, whose top row per key is kept before it too."""
    newest = Window.partitionBy("url").orderBy(F.desc("created_at"), F.desc("id"))
    return live(results, now).where("url is not null").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def lookup(results: DataFrame, url: str, now) -> DataFrame:
    """The current row of a url: at most one; the filter reaches the scan."""
    return live(results, now).where(F.col("url") == url).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def get(results: DataFrame, id_: int, now) -> DataFrame:
    return live(results, now).where(F.col("id") == id_)


def site(results: DataFrame, domain: str, now) -> DataFrame:
    """Current rows of a domain by url."""
    return current(results.where(F.col("domain") == domain.lower()), now).orderBy("url")


def history(results: DataFrame, now, url: str | None = None) -> DataFrame:
    """Live rows with `current` set on the newest of each url."""
    rows = live(results, now).where("url is not null")
    rows = rows if url is None else rows.where(F.col("url") == url)
    newest = Window.partitionBy("url").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("current", F.row_number().over(newest) == 1)


def recent(results: DataFrame, now, limit: int = 20) -> DataFrame:
    return current(results, now).orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(100, limit)))


def ranked_domains(results: DataFrame, now) -> DataFrame:
    sums = current(results, now).groupBy("domain").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("unfair_count").cast("long").alias("unfair"), F.sum("passage_count").cast("long").alias("passages"), F.max("created_at").alias("latest")
    )
    return sums.where("unfair > 0").withColumn("share", F.coalesce(F.try_divide(F.col("unfair").cast("double"), F.col("passages")), F.lit(0.0)))


def rankings(results: DataFrame, now, by: str = "count", limit: int = 20) -> DataFrame:
    """Domains by unfair clauses of their current documents, or by their share; ties by domain."""
    order = (F.desc("share"), F.desc("unfair"), F.asc("domain")) if by == "share" else (F.desc("unfair"), F.asc("domain"))
    return ranked_domains(results, now).orderBy(*order).limit(max(1, min(100, limit)))


def stats(results: DataFrame, now) -> DataFrame:
    return live(results, now).agg(F.count(F.lit(1)).alias("results"), F.count_distinct("url").alias("urls"), F.count_distinct("domain").alias("domains"))


def has_results(domains: DataFrame, results: DataFrame, now) -> DataFrame:
    """Those of `domains` (domain) with any live row."""
    return domains.join(live(results, now).select("domain"), "domain", "left_semi")


def purge(tables: dict[str, DataFrame], children: dict[str, DataFrame], now) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays of `tables` (with expires_at) and of the children (result_id) of `results`, and how many rows of each table go."""
    kept = {name: live(t, now) for name, t in tables.items()}
    if "results" in kept:
        ids = kept["results"].select(F.col("id").alias("result_id"))
        kept |= {name: c.join(ids, "result_id", "left_semi") for name, c in children.items()}
    gone = [t.agg(F.count_if(~F.coalesce(F.col("expires_at") > as_time(now), F.lit(False))).alias("purged")).select(F.lit(name).alias("table"), "purged") for name, t in tables.items()]
    counts = gone[0]
    for g in gone[1:]:
        counts = counts.unionByName(g)
    return kept, counts


def histogram(passages: DataFrame) -> DataFrame:
    """result_id and its counts by category, as a map."""
    n = passages.groupBy("result_id", "category").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.groupBy("result_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))


def insert(uploads: DataFrame, now, first_id: int = 1) -> dict[str, DataFrame]:
    """Validated uploads (url, domain, passages, money, ..., and `seq`, their order) as rows of the four tables."""
    at = as_time(now)
    rows = uploads.withColumn("id", F.col("seq") + F.lit(first_id)).withColumn("domain", F.lower("domain"))
    results = rows.withColumn("created_at", at).withColumn("expires_at", at + F.expr(f"INTERVAL {TTL_DAYS} DAYS")).withColumn("unfair_count", F.size("passages"))
    passages = rows.select(F.col("id").alias("result_id"), F.explode("passages").alias("p")).select("result_id", "p.*")
    money = rows.select(F.col("id").alias("result_id"), F.explode(F.coalesce("money", F.array().cast(rows.schema["money"].dataType))).alias("m")).select("result_id", "m.*")
    return {"results": results.drop("passages", "money", "seq"), "passages": passages, "money_clauses": money}


def views(results: DataFrame, passages: DataFrame, now) -> DataFrame:
    """Live results with their passages in order (null where there are none), fair count, ISO times and whether they are current."""
    nested = passages.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("idx", "category", "text"))).alias("passages"))
    rows = history(results, now).join(nested, F.col("id") == F.col("result_id"), "left").drop("result_id")
    known = F.map_filter("categories", lambda k, _: k.isin(*UNFAIR)) if "categories" in results.columns else None
    rows = rows.withColumn("fair_count", F.col("passage_count") - F.col("unfair_count")).withColumn("created_at", F.date_format("created_at", ISO)).withColumn("expires_at", F.date_format("expires_at", ISO))
    return rows if known is None else rows.withColumn("categories", known)


def upload_faults(uploads: DataFrame) -> DataFrame:
    """`uploads` with `faults`: names of the rules that a row breaks; an empty array means that it may be stored."""
    p = "passages"
    probs_off = F.exists(p, lambda x: F.abs(F.aggregate(x["probs"], F.lit(0.0), lambda a, y: a + y) - 1) >= 0.02)
    not_top = F.exists(p, lambda x: F.get(x["probs"], F.array_position(F.array(*[F.lit(c) for c in UNFAIR[:6]], F.lit("other"), *[F.lit(c) for c in UNFAIR[6:]]), x["category"]).cast("int") - 1) < F.array_max(x["probs"]))
    other = F.exists(p, lambda x: F.get(x["probs"], F.lit(6)) >= 0.5)
    text = F.exists(p, lambda x: (F.length(x["text"]) < 1) | (F.length(x["text"]) > 2000) | (x["index"] < 0) | (x["index"] > 100_000))
    host = urls.host(F.col("url"))
    rules = {
        "url": ~urls.clean_upload_url(F.col("url")),
        "public_host": ~urls.is_public_host(host),
        "domain": urls.registrable(host) != F.lower("domain"),
        "text_hash": ~F.col("text_hash").rlike("^[0-9a-f]{64}$"),
        "too_many": (F.size(p) > MOST_PASSAGES) | (F.size(p) > F.col("passage_count")),
        "passage": text,
        "probs_sum": probs_off,
        "not_likeliest": not_top,
        "other_likely": other,
    }
    return uploads.withColumn("faults", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in rules.items()])))


def counted_reports(reports: DataFrame, key: str = "domain", ttl_days: int = TTL_DAYS) -> DataFrame:
    """Reports (key, ts) folded into one row per key: the last run whose gaps stay below the ttl, with reports, first_at, last_at, expires_at."""
    by = Window.partitionBy(key).orderBy("ts")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by))
    fresh = F.coalesce((gap >= ttl_days * 86_400_000_000).cast("int"), F.lit(1))
    runs = reports.where(F.col("ts").isNotNull()).withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    folded = runs.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("reports"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    last = folded.groupBy(key).agg(F.max_by(F.struct("reports", "first_at", "last_at"), "_run").alias("r")).select(key, "r.*")
    return last.withColumn("expires_at", F.col("last_at") + F.expr(f"INTERVAL {ttl_days} DAYS"))


def most_reported(folded: DataFrame, now, limit: int = 20) -> DataFrame:
    return live(folded, now).orderBy(F.desc("reports"), F.desc("last_at"), folded.columns[0]).limit(limit)


def newest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: the last row of each key."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def saved_sites(saved: DataFrame, now, most: int = 50, days: int = TTL_DAYS) -> DataFrame:
    """What a reader's own store holds after these saves (domain, saved_at): the last of each site, under `days` old, the newest `most`.

    Saves that are older than another of their site, or without a site, are gone; ties go to the lesser domain.
    """
    fresh = saved.where(F.col("domain").isNotNull() & (F.col("saved_at") > as_time(now) - F.make_interval(days=F.lit(days))))
    return newest_by_key(fresh, "domain", "saved_at").orderBy(F.desc("saved_at"), "domain").limit(most)
