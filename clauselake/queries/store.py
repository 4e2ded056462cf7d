"""The results store over orders and line items: an order is a result, its customer the url, the nation the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as S

NOW = "2001-03-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("passage_count"), F.count_if(F.col("l_returnflag") == "R").alias("unfair_count"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("url"),
        F.col("c_nationkey").cast("string").alias("domain"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        "passage_count",
        "unfair_count",
    )


RESULTS = """
  results as (
    select o_orderkey as id, cast(o_custkey as varchar) as url, cast(c_nationkey as varchar) as domain, o_orderdate as created_at,
           o_orderdate + interval 30 day as expires_at, l.passage_count, l.unfair_count
    from orders
    join (select l_orderkey, count(*) as passage_count, count(*) filter (where l_returnflag = 'R') as unfair_count from lineitem group by 1) l on l_orderkey = o_orderkey
    join customer on c_custkey = o_custkey
  ), live as (select * from results where expires_at > timestamp '2001-03-01'),
  ordered as (select *, row_number() over (partition by url order by created_at desc, id desc) as rn from live),
  cur as (select * exclude (rn) from ordered where rn = 1),
  ranked as (
    select domain, count(*) as documents, cast(sum(unfair_count) as bigint) as unfair, cast(sum(passage_count) as bigint) as passages, max(created_at) as latest,
           cast(sum(unfair_count) as double) / sum(passage_count) as share
    from cur group by domain having sum(unfair_count) > 0
  )
"""


def current_results(spark, sf_dir):
    return S.current(results(spark, sf_dir), NOW)


def rankings_by_count(spark, sf_dir):
    return S.rankings(results(spark, sf_dir), NOW, "count", 20)


def rankings_by_share(spark, sf_dir):
    return S.rankings(results(spark, sf_dir), NOW, "share", 20)


def results_history(spark, sf_dir):
    return S.history(results(spark, sf_dir), NOW).select("id", "url", "created_at", "current")


def recent_results(spark, sf_dir):
    return S.recent(results(spark, sf_dir), NOW, 20).select("id", "url", "domain", "created_at")


def store_stats(spark, sf_dir):
    return S.stats(results(spark, sf_dir), NOW)


def purged_results(spark, sf_dir):
    """Lines whose order is still live: children of the purge."""
    r = results(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result_id"), "l_linenumber")
    kept, _ = S.purge({"results": r}, {"passages": lines}, NOW)
    return kept["passages"]


def purge_counts(spark, sf_dir):
    return S.purge({"results": results(spark, sf_dir)}, {}, NOW)[1]


def domains_with_results(spark, sf_dir):
    domains = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("domain"))
    return S.has_results(domains, results(spark, sf_dir), NOW)


def category_histogram(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.col("l_returnflag").alias("category"))
    h = S.histogram(lines)
    n = lambda k: F.coalesce(F.try_element_at("categories", F.lit(k)), F.lit(0)).cast("long")
    return h.select("result_id", n("R").alias("n_r"), n("A").alias("n_a"), n("N").alias("n_n"))


def missing_reports(spark, sf_dir):
    """Views as reports of a site without terms (the user stands for the site), with a life of two days."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("domain"), F.col("ts").cast("timestamp").alias("ts"))
    return S.counted_reports(views, "domain", 2)


def newest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return S.newest_by_key(e, "user_id", "event_id")


def saved_sites(spark, sf_dir):
    """Orders as saves; the customer stands for the site."""
    saves = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain"), F.col("o_orderdate").cast("timestamp").alias("saved_at")).distinct()
    return S.saved_sites(saves, NOW, 50, 90)


QUERIES = {
    f.__name__: f
    for f in (current_results, rankings_by_count, rankings_by_share, results_history, recent_results, store_stats, purged_results, purge_counts, domains_with_results, category_histogram, missing_reports, newest_event, saved_sites)
}
ORACLES = {
    "current_results": f"with {RESULTS} select * from cur",
    "rankings_by_count": f"with {RESULTS} select * from ranked order by unfair desc, domain limit 20",
    "rankings_by_share": f"with {RESULTS} select * from ranked order by share desc, unfair desc, domain limit 20",
    "results_history": f"with {RESULTS} select id, url, created_at, rn = 1 as current from ordered",
    "recent_results": f"with {RESULTS} select id, url, domain, created_at from cur order by created_at desc, id desc limit 20",
    "store_stats": f"with {RESULTS} select count(*) as results, count(distinct url) as urls, count(distinct domain) as domains from live",
    "purged_results": f"with {RESULTS} select l_orderkey as result_id, l_linenumber from lineitem where l_orderkey in (select id from live)",
    "purge_counts": f"with {RESULTS} select 'results' as \"table\", count(*) as purged from results where not expires_at > timestamp '2001-03-01'",
    "domains_with_results": f"with {RESULTS} select distinct domain from live",
    "category_histogram": "select l_orderkey as result_id, count(*) filter (where l_returnflag = 'R') as n_r, count(*) filter (where l_returnflag = 'A') as n_a, count(*) filter (where l_returnflag = 'N') as n_n from lineitem group by 1",
    "missing_reports": """
        with v as (select user_id as domain, ts, lag(ts) over (partition by user_id order by ts) as before from events where event_type = 'view'),
        r as (select *, sum(case when before is null or ts - before >= interval 2 day then 1 else 0 end) over (partition by domain order by ts rows unbounded preceding) as run from v),
        f as (select domain, run, count(*) as reports, min(ts) as first_at, max(ts) as last_at from r group by 1, 2)
        select domain, reports, first_at, last_at, last_at + interval 2 day as expires_at from f qualify row_number() over (partition by domain order by run desc) = 1
    """,
    "saved_sites": """
        with s as (select o_custkey as domain, max(o_orderdate) as saved_at from orders group by 1)
        select domain, cast(saved_at as timestamp) as saved_at from s where saved_at > timestamp '2001-03-01' - interval 90 day order by saved_at desc, domain limit 50
    """,
    "newest_event": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
}
