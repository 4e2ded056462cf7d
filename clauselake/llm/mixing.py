"""Mixing sources to target weights.

Each row gets a hash-random key.  Equal ranges of the key range cut each source into small buckets (a range sort whose
bounds need no sampling, so that a rerun or a recomputed task deals rows the same way).  Sums of the buckets give each
bucket's offset, a window inside a bucket gives each row's, and the source's exact budget cuts there.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, range_bucket, word_count

#: Rows of a bucket, on average: what one window sorts at once.
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets of sources.

    `sizes` has `_null`, `_src` (the source; '' and `_null` = 1 for null) and `_source_size`.  Sources by code point,
    null last, weigh `weights`, repeating, and share the sum of all sizes.  A target stops at `max_epochs` times its
    source's size; the excess is shared again by weight until none is above.  That ends at one level per unit of
    weight, which running sums over the sources in the order of cap / weight give at once.  One row per source goes
    through one task.
    """
    order, every = Window.orderBy("_null", "_src"), Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    ws = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("_weight", F.element_at(ws, (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("_source_size") * max_epochs).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    zero = F.lit(0.0)
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum("_weight").over(by_ratio), zero).alias("_w0"),
        F.coalesce(F.sum(F.col("_cap").cast("double")).over(by_ratio), zero).alias("_c0"),
        F.sum("_source_size").over(every).cast("double").alias("_total"),
        F.sum("_weight").over(every).alias("_weights"),
    )
    ranked = ranked.withColumn("_full", F.col("_ratio") * (F.col("_weights") - F.col("_w0")) + F.col("_c0") < F.col("_total"))
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap").cast("double"))).over(every), zero)
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(every)
    level = (F.col("_total") - taken) / open_weight
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.least(level * F.col("_weight"), F.col("_cap").cast("double")))
    return ranked.select("_null", "_src", "_source_size", F.coalesce(target, zero).alias("_target"))


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 20,
    keep: Sequence[str] = ("doc_id",),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The `keep` columns of each row with size, source_size, target (its source's, in words) and taken.

    taken = whole epochs times size, plus what the last, partial epoch takes: rows in key order up to the budget, the
    row at the cut in part.  So each source's taken words are its target, rounded.
    Null text or size counts 0; a null source is a source of its own, last; rows without words take 0; repeated rows
    each count, and a hash of the text tells rows of one id and size apart; an empty table gives an empty one.  Columns outside `keep` don't matter, whatever their names.
    """
    size = F.coalesce(size.cast("long"), F.lit(0)) if size is not None else word_count(docs[text_col])
    n = buckets_for(docs.count(), BUCKET_ROWS)
    source = docs[source_col].cast("string")
    rows = docs.select(
        F.struct(*[docs[c].alias(c) for c in keep]).alias("_row"),
        source.isNull().cast("int").alias("_null"),
        F.coalesce(source, F.lit("")).alias("_src"),
        size.alias("_size"),
        docs[id_col].alias("_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("_text"),
    )
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), "_id", "_size", "_text")).withColumn("_bucket", range_bucket(F.col("_key"), n))
    sums = rows.groupBy("_null", "_src", "_bucket").agg(F.sum("_size").alias("_sum"))
    sources = source_targets(sums.groupBy("_null", "_src").agg(F.sum("_sum").alias("_source_size")), weights, max_epochs)
    budget = F.least(F.round("_target").cast("long"), F.col("_source_size") * max_epochs)
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.greatest(F.col("_source_size"), F.lit(1)))).otherwise(0)
    sources = sources.withColumn("_budget", budget).withColumn("_epochs", epochs).withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("_source_size"))
    before = Window.partitionBy("_null", "_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(sources, ["_null", "_src"])
    inside = Window.partitionBy("_null", "_src", "_bucket").orderBy("_key", "_id", "_size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.join(offsets, ["_null", "_src", "_bucket"])
    start = F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_start")))
    return dealt.withColumn("_start", start).select("_row.*", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_epochs") * F.col("_size") + part).alias("taken"))


#: A word with the white space before it.
SPACED_WORD = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of `docs`: a document once per epoch taken, the one at the cut in its first words."""
    rows = mix_sources(docs.select(F.struct(*docs.columns).alias("_doc"), *[docs[c] for c in ("doc_id", "source", "text")]), keep=("_doc",), **options)
    epochs = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    words = F.transform(epochs, lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")))
    rows = rows.where((F.col("taken") > 0) & (F.col("size") > 0)).withColumn("_words", F.explode(words))
    head = F.array_join(F.slice(F.regexp_extract_all("_doc.text", F.lit(SPACED_WORD), F.lit(1)), 1, F.col("_words").cast("int")), "")
    text = F.when(F.col("_words") >= F.col("size"), F.col("_doc.text")).otherwise(head)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
