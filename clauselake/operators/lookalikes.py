"""Hosts that pass for a known brand, and icons that pass for a brand's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hosts as H
from ..functions import probability as P
from ..functions import urls as U


def brand_index(brands: DataFrame) -> DataFrame:
    """`brands` (ord, name, domain) with label and folded: one row for each label, rather one that is its own registrable domain, then the first."""
    own = U.registrable(F.col("domain")) == F.col("domain")
    rows = brands.withColumn("label", F.split(U.registrable(F.col("domain")), r"\.")[0]).where("label <> ''")
    best = F.row_number().over(Window.partitionBy("label").orderBy((~own).cast("int"), "ord"))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n").withColumn("folded", H.folded(F.col("label")))


def lookalikes(hosts: DataFrame, index: DataFrame) -> DataFrame:
    """host, name, kind, distance, matched of distinct `hosts` (host) that read like a brand of `index` (see `brand_index`) but are not its own.

    First equal in look, then within the edit budget, then the brand as a word of the host; of equals the first brand.
    Equality and words are joins on the folded label; only hosts without these are compared by edit distance, with the
    brands that share one of three parts of their label: with two edits one part at least is whole, somewhere within
    two places.
    """
    h = hosts.select("host").where("host is not null").distinct().withColumn("_d", F.lower(H.decoded(F.col("host"))))
    h = h.withColumn("_site", U.registrable(F.col("_d"))).withColumn("_label", F.split("_site", r"\.")[0]).where("_label <> ''")
    h = h.join(index.select(F.col("domain").alias("_site")).distinct(), "_site", "left_anti").withColumn("_folded", H.folded(F.col("_label")))
    brands = index.select("ord", "name", "label", "folded")
    found = lambda df, rank, kind, distance, matched: df.select("host", "ord", "name", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), distance.cast("int").alias("distance"), matched.alias("matched"))
    alike = found(h.join(brands, F.col("_folded") == F.col("folded")), 0, "homoglyph", F.lit(0), F.col("_label"))
    words = h.withColumn("_word", F.explode(F.array_distinct(F.transform(H.tokens(F.col("_d")), lambda t: t)))).withColumn("_word", H.folded(F.col("_word")))
    named = words.join(brands.where((F.length("folded") >= 3) & ~F.col("folded").isin(*H.GENERIC)), F.col("_word") == F.col("folded"))
    impersonated = found(named, 2, "impersonation", F.lit(0), F.col("label"))
    # Parts of a brand's label and the places where they stand.
    third = F.ceil(F.length("folded") / 3).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((i * third).alias("at"), F.substr("folded", i * third + 1, third).alias("part")))
    long_ = index.where(F.length("folded") > 5).select("ord", "name", "label", "folded", F.explode(parts).alias("p")).where("p.part <> ''").select("ord", "name", "label", "folded", "p.part", "p.at")
    # One number for the whole index.
    longest = long_.agg(F.max(F.length("part"))).first()[0] or 1
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.length("_folded") - n, F.lit(0))), lambda i: F.struct(F.substr("_folded", i + 1, n).alias("part"), i.alias("place")))))
    near = h.select("host", "_label", "_folded", F.explode(pieces).alias("q")).select("host", "_label", "_folded", "q.part", "q.place")
    met = near.join(long_, "part").where(F.abs(F.col("place") - F.col("at")) <= 2).select("host", "_label", "_folded", "ord", "name", "label", "folded").distinct()
    met = met.withColumn("_far", H.distance_within(F.col("_folded"), F.col("folded"), 2)).where(F.col("_far") <= H.edit_budget(F.length("folded")))
    typed = found(met, 1, "typo", F.col("_far"), F.col("_label"))
    every = alike.unionByName(typed).unionByName(impersonated)
    return every.groupBy("host").agg(F.min(F.struct("rank", "ord", "name", "kind", "distance", "matched")).alias("x")).select("host", "x.name", "x.kind", "x.distance", "x.matched")


def icon_matches(icons: DataFrame, known: DataFrame, most: int = 6) -> DataFrame:
    """icon, brand, distance: the one brand whose icons (brand, hash) lie within `most` bits of an icon's hash (icon, hash); none where several do.

    A hash of 16 hex digits that differs in six bits has a digit pair in common at its place, so both sides meet on pairs.
    """
    pairs = lambda df, *keep: df.select(*keep, "hash", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substr("hash", i * 2 + 1, F.lit(2))))).alias("pair"))
    met = pairs(icons, "icon").alias("a").join(pairs(known, "brand").alias("b"), "pair").select("icon", "brand", F.col("a.hash").alias("x"), F.col("b.hash").alias("y")).distinct()
    near = met.withColumn("distance", P.hamming(F.col("x"), F.col("y"))).where(F.col("distance") <= most)
    best = near.groupBy("icon", "brand").agg(F.min("distance").alias("distance"))
    return best.groupBy("icon").agg(F.count(F.lit(1)).alias("n"), F.first("brand").alias("brand"), F.first("distance").alias("distance")).where("n = 1").drop("n")


def icon_collisions(known: DataFrame, most: int = 6) -> DataFrame:
    """Pairs of different brands (brand, hash) whose icons lie within `most` bits of each other."""
    found = known.select(F.col("brand").alias("icon"), "hash")
    pairs = lambda df, name: df.select(F.col(name).alias(name), F.col("hash").alias(f"{name}_hash"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substr("hash", i * 2 + 1, F.lit(2))))).alias("pair"))
    met = pairs(found, "icon").join(pairs(known, "brand"), "pair").where("icon < brand").select("icon", "brand", "icon_hash", "brand_hash").distinct()
    near = met.withColumn("distance", P.hamming(F.col("icon_hash"), F.col("brand_hash"))).where(F.col("distance") <= most)
    return near.groupBy(F.col("icon").alias("brand_a"), F.col("brand").alias("brand_b")).agg(F.min("distance").alias("distance"))
