"""Evaluation of classifiers: confusion, F1, calibration, bootstrap, temperature and threshold searches.

`scored` has id, gold (class index) and probs or logits.  Rows with null gold or null arrays are left out.  Every search
over a grid is one explode of that grid (of fixed size) and one aggregation with map-side sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests
from ..functions import probability as P
from ..labels import OTHER


def ratio(a: Column, b: Column) -> Column:
    """0 for 0 / 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    return rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 of each class that is gold or predicted, from confusion cells."""
    one = cells.select(*by, F.explode(F.array(F.struct(F.col("gold").alias("cls"), F.lit(1).alias("g")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("g")))).alias("x"), "gold", "pred", "n")
    s = one.groupBy(*by, F.col("x.cls").alias("cls")).agg(
        F.sum(F.when((F.col("x.g") == 1) & (F.col("gold") == F.col("pred")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.g") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.g") == 0, F.col("n")).otherwise(0)).alias("predicted"),
    )
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return s.select(*by, "cls", "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def macro_f1(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro-F1 over the classes that are gold."""
    return per_class(cells, by).where("support > 0").groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def summary(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro-F1, accuracy, and F1 of unfair against other."""
    macro = macro_f1(cells, by)
    u, v = F.col("gold") != OTHER, F.col("pred") != OTHER
    s = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"), F.sum(F.when(u & v, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(u, F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(v, F.col("n")).otherwise(0)).alias("p"))
    s = s.select(*by, ratio(F.col("right"), F.col("n")).alias("accuracy"), ratio(2 * F.col("tp"), F.col("g") + F.col("p")).alias("unfair_f1"))
    return s.join(macro, list(by)) if by else s.crossJoin(macro)  # one row each


def binary(rows: DataFrame, gold: Column, pred: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn and what follows from them."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    s = rows.groupBy(*by).agg(n(gold & pred).alias("tp"), n(~gold & pred).alias("fp"), n(gold & ~pred).alias("fn"), n(~gold & ~pred).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return s.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(fp, fp + tn).alias("fpr"))


def calibration(scored: DataFrame, bins: int = 15) -> DataFrame:
    """Bins of the likeliest class's probability, open below and closed above: n, confidence, accuracy."""
    top = scored.where("gold is not null and probs is not null").select(F.array_max("probs").alias("conf"), (P.argmax(F.col("probs")) == F.col("gold")).cast("int").alias("hit"))
    return top.groupBy(F.greatest(F.ceil(F.col("conf") * bins), F.lit(1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("confidence"), F.avg("hit").alias("accuracy"))


def expected_calibration_error(scored: DataFrame, bins: int = 15) -> DataFrame:
    return calibration(scored, bins).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def brier(scored: DataFrame) -> DataFrame:
    one = F.transform("probs", lambda p, i: F.pow(p - (i == F.col("gold")).cast("double"), F.lit(2.0)))
    return scored.where("gold is not null and probs is not null").agg(F.avg(F.aggregate(one, F.lit(0.0), lambda a, x: a + x)).alias("brier"))


def log_loss(probs: Column, gold: Column) -> Column:
    return -F.log(F.get(probs, gold) + F.lit(1e-12))


def temperature(scored: DataFrame, grid: list[float]) -> DataFrame:
    """Temperatures with the mean log loss of logits over them; the least is the fit (ties: the smaller)."""
    rows = scored.where("gold is not null and logits is not null").select("gold", "logits", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature"))
    return rows.groupBy("temperature").agg(F.avg(log_loss(P.softmax(F.col("logits"), F.col("temperature")), F.col("gold"))).alias("nll"))


def fit_temperature(scored: DataFrame, low: float = 0.05, high: float = 10.0, rounds: int = 4, points: int = 16) -> float:
    """Grid searches, each over the two neighbours of the last one's best; `points` rows reach the driver each time."""
    best = 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        found = temperature(scored, grid).orderBy("nll", "temperature").first()
        if found is None:
            return best
        best, step = found["temperature"], (high - low) / (points - 1)
        low, high = max(low, best - step), min(high, best + step)
    return best


def thresholds(scored: DataFrame, grid: list[float]) -> DataFrame:
    """threshold, macro_f1, accuracy, unfair_f1 of decisions with each threshold on `other`."""
    rows = scored.where("gold is not null and probs is not null").select("gold", "probs", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold"))
    return summary(confusion(rows.withColumn("pred", P.decide(F.col("probs"), F.col("threshold"))), by=("threshold",)), by=("threshold",))


def plateau(curve: DataFrame, value: str = "macro_f1", within: float = 0.002) -> DataFrame:
    """The run of thresholds around the best whose value stays `within` of it: low, centre, high.  `curve` is a grid of fixed size."""
    every, up = Window.partitionBy(), Window.orderBy("threshold")
    best = F.max(value).over(every)
    rows = curve.withColumn("_near", (F.col(value) >= best - within).cast("int")).withColumn("_is", F.col(value) == best)
    rows = rows.withColumn("_run", F.sum(1 - F.col("_near")).over(up)).where("_near = 1")
    runs = rows.groupBy("_run").agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"), F.max("_is").alias("_best"))
    return runs.where("_best").orderBy("low").limit(1).select("low", ((F.col("low") + F.col("high")) / 2).alias("centre"), "high")


def other_bias(scored: DataFrame, low: float = -3.0, high: float = 3.0, step: float = 0.25) -> DataFrame:
    """bias, macro_f1: decisions with the score of `other` shifted."""
    grid = [low + step * i for i in range(int(round((high - low) / step)) + 1)]
    rows = scored.where("gold is not null and logits is not null").select("gold", "logits", F.explode(F.array(*[F.lit(b) for b in grid])).alias("bias"))
    return summary(confusion(rows.withColumn("pred", P.argmax(P.with_bias(F.col("logits"), F.col("bias")))), by=("bias",)), by=("bias",)).select("bias", "macro_f1")


#: Draws that are judged at once, and such lots of a task.
LOT, LOTS = 1 << 15, 64


def exact_draws(cells: DataFrame, boots: int, seed: int = 1, by: str = "boot") -> DataFrame:
    """`cells` (n and others) of each resample: n rows drawn with replacement, as many as there are.

    A resample of rows changes no metric beyond the counts of their cells, so what is drawn are places among all rows,
    cell after cell in the order of their other columns: a digest of seed, resample and draw (its first 60 bits) modulo
    the number of rows.  Draws are dealt over tasks in lots, each digest is computed once, by arrays, and draws are added
    up before they move; reruns and other systems draw alike.  The driver sees the cells, one for each pair (or triple)
    of classes.
    """
    spark, names = cells.sparkSession, [c for c in cells.columns if c != "n"]
    rows = sorted(cells.select(*names, F.col("n").cast("long").alias("n")).where("n > 0").collect(), key=lambda r: tuple(r[c] for c in names))
    schema = f"{by} long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cells.schema if f.name in names)}, n long"
    total = sum(r["n"] for r in rows)
    if not total:
        return spark.createDataFrame([], schema)
    named, ends = pd.DataFrame([r[:-1] for r in rows], columns=names), np.cumsum([r["n"] for r in rows])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            first = b["id"].min() * LOT // total
            n = np.zeros(((b["id"].max() + 1) * LOT // total - first + 1) * len(ends), np.int64)  # as many as draws, about
            for lot in b["id"]:
                ids = np.arange(lot * LOT, min((lot + 1) * LOT, boots * total))
                boot = ids // total
                place = (digests.leading(seed, boot + 1, ids % total) % np.uint64(total)).astype(np.int64)
                found = np.bincount((boot - boot[0]) * len(ends) + np.searchsorted(ends, place, side="right"))
                at = (boot[0] - first) * len(ends)
                n[at : at + len(found)] += found
            seen = np.flatnonzero(n)
            yield named.iloc[seen % len(ends)].assign(**{by: first + 1 + seen // len(ends), "n": n[seen]})

    lots = -(-boots * total // LOT)
    tasks = max(1, -(-lots // LOTS), min(lots, spark.sparkContext.defaultParallelism))
    return spark.range(0, lots, 1, tasks).mapInPandas(draw, schema).groupBy(by, *names).agg(F.sum("n").alias("n"))


def bootstrap(scored: DataFrame, boots: int = 1000, seed: int = 1, pred: str = "pred") -> DataFrame:
    """metric, low, high: 95 % intervals of macro-F1 and accuracy over resamples of as many rows (see `exact_draws`)."""
    cells = exact_draws(confusion(scored, pred=pred), boots, seed)
    s = summary(cells, ("boot",)).select("boot", F.explode(F.array(F.struct(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("v")), F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("v")))).alias("x"))
    return s.groupBy("x.metric").agg(F.percentile("x.v", 0.025).alias("low"), F.percentile("x.v", 0.975).alias("high"))


def paired_bootstrap(scored: DataFrame, a: str, b: str, boots: int = 1000, seed: int = 1) -> DataFrame:
    """Difference of macro-F1 (b - a) on the same resamples: delta (mean), low, high, b_better (share of resamples where b is better), verdict.

    verdict: b or a where the interval lies on one side of nought, else neither.
    """
    rows = scored.where(F.col("gold").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    drawn = exact_draws(rows.groupBy("gold", F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("n")), boots, seed)
    # Both sides from one table of draws, read once, or they would be drawn again.
    sides = drawn.select("boot", "gold", "n", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("_a").alias("pred")), F.struct(F.lit("b").alias("side"), F.col("_b").alias("pred")))).alias("x"))
    f = macro_f1(sides.groupBy("boot", "x.side", "gold", "x.pred").agg(F.sum("n").alias("n")), ("boot", "side"))
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("macro_f1")))
    d = f.groupBy("boot").agg((at("b") - at("a")).alias("d"))
    s = d.agg(F.avg("d").alias("delta"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("b_better"))
    return s.withColumn("verdict", F.when(F.col("low") > 0, "b").when(F.col("high") < 0, "a").otherwise("neither"))


def agreement(rows: DataFrame, a: str = "logits_a", b: str = "logits_b") -> DataFrame:
    """Share of equal decisions, and largest and mean difference of two score arrays."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    mean = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.size(apart)
    return rows.agg(F.avg((P.argmax(F.col(a)) == P.argmax(F.col(b))).cast("double")).alias("same"), F.max(F.array_max(apart)).alias("largest"), F.avg(mean).alias("mean"))


def flagged_shares(rows: DataFrame, kind: str, run: str, flagged: str, runs: list[str]) -> DataFrame:
    """Of each kind, the share flagged by each of the named runs, one column a run; null where a run lacks the kind."""
    return rows.groupBy(kind).pivot(run, runs).agg(F.avg(F.col(flagged).cast("double")))
