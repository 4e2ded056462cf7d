"""What one document's findings say: a risk summary, totals by family, the strip of marks, reading lists.

`findings` rows are (doc, index, kind, confidence, text, fee): flagged clauses and fee clauses of documents; each operator
groups by doc, so documents spread over the cluster and none needs another's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import labels as L

TICKS = 240


def findings(passages: DataFrame, fees: DataFrame) -> DataFrame:
    """Flagged `passages` (doc, index, category, confidence, text) and `fees` (doc, index, kind, text) as one table; fees have the rules' confidence."""
    flagged = passages.where(L.is_unfair(F.col("category"))).select("doc", "index", F.col("category").alias("kind"), "confidence", "text", F.lit(False).alias("fee"))
    return flagged.unionByName(fees.select("doc", "index", "kind", F.lit(L.RULE_CONFIDENCE).alias("confidence"), "text", F.lit(True).alias("fee")))


def summaries(found: DataFrame, most: int = L.MOST_POINTS) -> DataFrame:
    """doc, score, level, points: of each kind its count and most confident text (the first of equals); the `most` severest, then surest."""
    order = F.struct(F.col("confidence"), (~F.col("fee")).alias("clause"), (-F.col("index")).alias("early"))
    kinds = found.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("count"), F.max_by("text", order).alias("quote"), F.max("confidence").alias("confidence"), F.min(F.struct("fee", "index")).alias("first"))
    kinds = kinds.withColumn("points", L.severity_points(L.severity(F.col("kind"))))
    # By severity and confidence, then by which kind came up first.
    ranked = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("p"), (-F.col("confidence")).alias("c"), "first", "kind", "count", "quote"))),
        lambda x: F.struct(x["kind"].alias("kind"), x["count"].alias("count"), x["quote"].alias("quote")),
    )
    one = kinds.groupBy("doc").agg(F.least(F.lit(100), F.sum("points")).cast("long").alias("score"), F.slice(ranked, 1, most).alias("points"))
    return one.select("doc", "score", L.level(F.col("score")).alias("level"), "points")


def family_totals(found: DataFrame) -> DataFrame:
    """doc, rank, family, n: clauses by family, in the fixed order of families; families without any are left out."""
    rank = F.array_position(F.array(*[F.lit(f) for f in L.FAMILIES]), L.family(F.col("kind"))).cast("int")
    rows = found.withColumn("family", L.family(F.col("kind"))).where("family is not null")
    return rows.groupBy("doc", "family", rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def strip(found: DataFrame, totals: DataFrame, ticks: int = TICKS) -> DataFrame:
    """doc, bin, index, kind: the first clause of each bin of a document's `totals` (doc, total) sentences; a fee only where no clause is."""
    total = F.greatest(F.col("total"), F.lit(1))
    bins = F.least(total, F.lit(ticks))
    at = F.least(bins - 1, F.floor(F.col("index") / total * bins)).cast("int")
    rows = found.join(totals, "doc").withColumn("bin", at)
    first = F.min(F.struct("fee", "index", "kind")).alias("x")
    return rows.groupBy("doc", "bin").agg(first).select("doc", "bin", "x.index", "x.kind")


def nearest(found: DataFrame, targets: DataFrame) -> DataFrame:
    """doc, index: the finding nearest to each document's target (doc, target); of equals the clause first, then the earlier."""
    rows = found.join(targets, "doc")
    return rows.groupBy("doc").agg(F.min(F.struct(F.abs(F.col("index") - F.col("target")).alias("away"), "fee", "index")).alias("x")).select("doc", "x.index")


def reading_list(found: DataFrame, most: int = 60) -> DataFrame:
    """doc, place, index, kind: the `most` surest findings of each document, back in reading order (clauses before fees at one index)."""
    best = Window.partitionBy("doc").orderBy(F.desc("confidence"), "fee", "index", "kind")
    order = Window.partitionBy("doc").orderBy("index", "fee", "kind")
    taken = found.withColumn("_best", F.row_number().over(best)).where(F.col("_best") <= most)
    return taken.withColumn("place", F.row_number().over(order)).select("doc", "place", "index", "kind")


def folded(listed: DataFrame, first: int = 6, last: int = 3) -> DataFrame:
    """`listed` (doc, place, ...) with shown: whether it is among the first or last few of its document."""
    return listed.withColumn("shown", (F.col("place") <= first) | (F.col("place") > F.count(F.lit(1)).over(Window.partitionBy("doc")) - last))


def capped(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def upload(passages: Column, has_personal: Column, most: int = L.MOST_PASSAGES) -> Column:
    """What may leave the device: passages (array) whose flag in `has_personal` (array of booleans) is false, `most` at most."""
    kept = F.filter(F.arrays_zip(passages.alias("p"), has_personal.alias("h")), lambda x: ~F.coalesce(x["h"], F.lit(False)))
    return F.slice(F.transform(kept, lambda x: x["p"]), 1, most)


def personal_indexes(passages: Column, fees: Column, test) -> Column:
    """Indexes of texts that hold personal data, over both arrays of struct (index, text)."""
    return F.transform(F.filter(F.concat(passages, fees), lambda x: test(x["text"])), lambda x: x["index"])


def positioned(rows: DataFrame, marks: DataFrame, key: str, at: str, position: str = "position") -> DataFrame:
    """`rows` (key, at, others) with the number of the next of `marks` (key, at) from there on, counted from 0 in each key; after the last mark, the last's.

    A forward as-of join: both sides meet in one window in order of `at`, a mark before a row at the same place.  A
    key without marks gives 0; rows whose key or place is null give null.
    """
    has_place = F.col(key).isNotNull() & F.col(at).isNotNull()
    both = rows.where(has_place).select(F.struct(*rows.columns).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_mark"))
    both = both.unionByName(marks.where(has_place).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_mark")), allowMissingColumns=True)
    # Marks strictly before: all earlier places, none of the row's own.
    earlier = Window.partitionBy("_key").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_key")
    counted = both.select("_row", F.coalesce(F.count_if(F.col("_mark") == 0).over(earlier), F.lit(0)).alias("_before"), F.count_if(F.col("_mark") == 0).over(every).alias("_all"))
    placed = counted.where("_row is not null").select("_row.*", F.least("_before", F.greatest(F.col("_all") - 1, F.lit(0))).cast("long").alias(position))
    return placed.unionByName(rows.where(~F.coalesce(has_place, F.lit(False))).withColumn(position, F.lit(None).cast("long")))


def failure_message(failures: DataFrame) -> DataFrame:
    """site, message: one sentence out of the reasons (site, reason) why no terms could be read."""
    n = F.count(F.lit(1))
    of = lambda reason: F.count_if(F.col("reason") == reason)
    links = F.concat(F.lit("Found "), n.cast("string"), F.lit(" link"), F.when(n == 1, "").otherwise("s"))
    # The sentences.
    message = (
        F.when(of("needs-javascript") > 0, F.concat(links, F.lit(", but the text only appears once the site's own scripts run. A hidden tab was tried and still could not read enough (it may be behind a sign-in). Open the terms yourself and analyse from that page.")))
        .when(of("fetch-failed") == n, F.concat(links, F.lit(", but none could be reached. Check your connection.")))
        .when(of("http-error") == n, F.concat(links, F.lit(", but every one returned an error (a sign-in wall, or the page moved).")))
        .when(of("not-terms") > 0, F.concat(links, F.lit(", but "), F.when(n == 1, "it does").otherwise("none"), F.lit(" not read like terms of service.")))
        .otherwise(F.concat(links, F.lit(", but what came back was too short to be a terms document.")))
    )
    return failures.groupBy("site").agg(message.alias("message"))
