"""Preparation of labelled sentences: rarest label, class weights, splits, replay, and comparisons of two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rarest_label(rows: DataFrame, id_col: str = "id", labels: str = "labels", default: str = "other") -> DataFrame:
    """id, label: of each row's labels the rarest over all rows (the first of equals); `default` without any."""
    each = rows.select(id_col, F.posexplode(labels).alias("at", "label"))
    counts = each.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    picked = each.join(counts, "label").groupBy(id_col).agg(F.min(F.struct("n", "at", "label")).alias("x")).select(id_col, F.col("x.label").alias("label"))
    return rows.select(id_col).join(picked, id_col, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def class_weights(rows: DataFrame, label: str = "label", power: float = 0.25) -> DataFrame:
    """label, n, weight: n ** -power, scaled so that the mean weight of a row is 1."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    raw = F.pow(F.col("n"), F.lit(-power))
    # One row per class.
    mean = counts.agg((F.sum(F.col("n") * raw) / F.sum("n")).alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).select(label, "n", (raw / F.col("mean")).alias("weight"))


def in_order(key: Column, seed: int) -> Column:
    """A random but fixed order."""
    return F.md5(F.concat_ws(":", F.lit(seed), key))


def stratified_split(rows: DataFrame, key: str, label: str, one_in: int = 10, seed: int = 0) -> DataFrame:
    """`rows` with split: of each label the share 1 / one_in (rounded) is val, the rest train, by the hash of a unique key.

    The order is cut by a count over ranges of the hash first, so that no label's rows meet in one task.
    """
    h = rows.withColumn("_h", in_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(label).agg(F.round(F.sum("_n") / one_in).cast("long").alias("_wanted"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").join(total, label)
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    return h.join(starts, [label, "_b"]).withColumn("split", F.when(rank <= F.col("_wanted"), "val").otherwise("train")).select(*rows.columns, "split")


def replay(rows: DataFrame, key: str, label: str, size: int, other: str = "other", seed: int = 0) -> DataFrame:
    """All rows that are not `other`, and as many others, by the hash of their key, as make `size`."""
    unfair = rows.where(F.col(label) != other)
    rest = rows.where(F.col(label) == other).orderBy(in_order(F.col(key), seed), key).limit(max(0, size - unfair.count()))
    return unfair.unionByName(rest)


def previous_text(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (id, key) with prev: the text before the first row of `known` (ord, key, prev) with that key."""
    first = known.groupBy("key").agg(F.min_by("prev", "ord").alias("prev"))
    return rows.join(first, "key", "left")


def blank_context(rows: DataFrame, test_keys: DataFrame) -> DataFrame:
    """`rows` (key, prev, prev_key, ...) without those whose key is in `test_keys` (key); prev is blank where its key is."""
    hit = test_keys.select(F.col("key").alias("prev_key")).distinct().withColumn("_hit", F.lit(True))
    left = rows.join(test_keys, "key", "left_anti").join(hit, "prev_key", "left")
    return left.withColumn("prev", F.when(F.col("_hit"), "").otherwise(F.coalesce("prev", F.lit("")))).drop("_hit")


def sizes(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, median, longest: of the lengths of a key's texts; the median is the upper one, by counts of lengths."""
    lengths = sentences.groupBy(key, F.length(text).alias("len")).agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(key).orderBy("len")
    upto = lengths.withColumn("upto", F.sum("c").over(by)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    return upto.groupBy(key).agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("len"))).alias("median"), F.max("len").alias("longest"))


def agreement_cells(rows: DataFrame, a: str, b: str, other: int) -> DataFrame:
    """share_a, share_b, both, only_a, only_b, same: how two models' classes of the same rows go together."""
    x, y = F.col(a) != other, F.col(b) != other
    return rows.agg(
        F.avg(x.cast("double")).alias("share_a"),
        F.avg(y.cast("double")).alias("share_b"),
        F.count_if(x & y).alias("both"),
        F.count_if(x & ~y).alias("only_a"),
        F.count_if(~x & y).alias("only_b"),
        F.avg(F.when(x & y, (F.col(a) == F.col(b)).cast("double"))).alias("same"),
    )


def drop_reasons(rows: DataFrame, key: str, *reasons: tuple[str, Column]) -> DataFrame:
    """reason, n: why rows go, the first reason that holds; null for those that stay.  A repeated key is a duplicate but for its least row."""
    case = F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        case = F.when(holds, name).otherwise(case)
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*rows.columns)))
    return rows.withColumn("_n", first).groupBy(F.when(F.col("_n") > 1, "duplicate").otherwise(case).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def best_epoch(epochs: DataFrame, score: str, recall: str, floor: float) -> DataFrame:
    """The row of largest score, the earliest of equals, among epochs whose recall is `floor` at least."""
    return epochs.where(F.col(recall) >= floor).orderBy(F.desc(score), "epoch").limit(1)


def identity_rate(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("rate"))
