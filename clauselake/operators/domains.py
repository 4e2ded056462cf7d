"""Sites of hosts by a list of public suffixes, with wildcards and exceptions.

A list is a table of rules (see `rules`).  A host meets it on its own suffixes, a row each, and of the rules that fit,
exceptions first, the longest wins; without one, the last label is the suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

#: Rules up to this many, in a small row each, are sent to every task; beyond that, a shuffle brings both sides together.
BROADCAST_RULES = 100_000
PRIVATE = "===BEGIN PRIVATE DOMAINS==="


def rules(lines: DataFrame) -> DataFrame:
    """suffix, labels, kind (plain; wildcard: any one label before it; exception: no suffix itself) and icann of a list in the public suffix format.

    `lines` has line, and private: whether it stands in the list's private part.  Comments begin with //.
    """
    rule = F.lower(F.regexp_extract("line", r"^\s*(\S+)", 1))
    rows = lines.select(rule.alias("rule"), (~F.col("private")).alias("icann")).where("rule <> '' and not startswith(rule, '//')")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("plain")
    return rows.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind"), "icann").withColumn("labels", F.size(F.split("suffix", r"\."))).distinct()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a list file.  It is small (some ten thousand lines) and read whole, as the order of its lines tells its parts apart."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.array(F.substring_index("value", PRIVATE, 1), F.when(F.contains("value", F.lit(PRIVATE)), F.substring_index("value", PRIVATE, -1)))
    return rules(whole.select(F.posexplode(parts).alias("part", "text")).select((F.col("part") == 1).alias("private"), F.explode(F.split("text", r"\r?\n")).alias("line")))


def sites(hosts: DataFrame, suffixes: DataFrame, host_col: str = "host") -> DataFrame:
    """host, suffix, site (the suffix and one label more; null where the host has no more), label (that one) and public of each distinct host.

    public: the site lies under an ICANN suffix of the list.  Numeric addresses have neither suffix nor site; a null
    host is left out.
    """
    distinct = hosts.select(F.lower(F.col(host_col)).alias("host")).where("host is not null").distinct()
    labels = F.split("host", r"\.")
    # Each suffix of the host, with one row for wildcards as well: a host of n labels has n of them.
    tails = distinct.where(~U.is_address(F.col("host"))).select("host", labels.alias("ls")).select("host", "ls", F.explode(F.sequence(F.lit(1), F.size("ls"))).alias("n"))
    tails = tails.select("host", "n", F.size("ls").alias("all"), F.array_join(F.slice("ls", F.col("all") - F.col("n") + 1, F.col("n")), ".").alias("suffix"))
    known = F.broadcast(suffixes) if suffixes.count() <= BROADCAST_RULES else suffixes
    fits = tails.join(known.select("suffix", "kind", "icann"), "suffix")
    # How many labels of the host the rule makes its suffix.
    taken = F.when(F.col("kind") == "exception", F.col("n") - 1).when(F.col("kind") == "wildcard", F.col("n") + 1).otherwise(F.col("n"))
    fits = fits.withColumn("taken", taken).where("taken <= all")
    best = fits.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("x"), "taken", "icann")).alias("b"))
    rows = distinct.join(best, "host", "left").withColumn("ls", labels)
    number = F.when(~U.is_address(F.col("host")), F.coalesce("b.taken", F.lit(1)))
    last = lambda n: F.array_join(F.slice("ls", F.size("ls") - n + 1, n), ".")
    rows = rows.withColumn("k", number).withColumn("site", F.when(F.size("ls") > F.col("k"), last(F.col("k") + 1)))
    return rows.select("host", F.when(F.col("k").isNotNull(), last(F.col("k"))).alias("suffix"), "site", F.substring_index("site", ".", 1).alias("label"), F.coalesce(F.col("b.icann") & F.col("site").isNotNull(), F.lit(False)).alias("public"))


def same_site_only(addresses: DataFrame, suffixes: DataFrame, most: int = 20) -> DataFrame:
    """`addresses` (report, domain, place, url) whose site is the report's domain, the first `most` of each report, in order of place."""
    hosts = addresses.withColumn("_host", U.host(F.col("url")))
    named = sites(hosts.select(F.col("_host").alias("host")), suffixes).select(F.col("host").alias("_host"), F.coalesce("site", "host").alias("_site"))
    own = hosts.join(named, "_host").where(F.col("_site") == F.lower("domain"))
    firsts = own.groupBy("report").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "domain", "url"))), 1, most).alias("kept"))
    return firsts.select("report", F.explode("kept").alias("k")).select("report", "k.domain", "k.place", "k.url")


def checked(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """`rows` (url, domain, others) with consistent: whether the url's site is the domain, and public: whether the host is one of the public internet."""
    hosts = rows.withColumn("_host", U.host(F.col("url")))
    named = sites(hosts.select(F.col("_host").alias("host")), suffixes).select(F.col("host").alias("_host"), F.coalesce("site", "host").alias("_site"), F.col("public").alias("_public"))
    out = hosts.join(named, "_host", "left")
    return out.select(*rows.columns, F.coalesce(F.col("_site") == F.lower("domain"), F.lit(False)).alias("consistent"), F.coalesce("_public", F.lit(False)).alias("public"))
