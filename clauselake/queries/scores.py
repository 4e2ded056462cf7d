"""Class scores and evaluation over embeddings: the first nine components are logits, label % 9 the class."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as P
from ..labels import OTHER
from ..operators import metrics as M
from .store import table


def scored(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 9), lambda x: F.round(x.cast("double") * 4, 3))
    rows = v.select(F.col("vec_id").alias("id"), (F.col("label") % 9).alias("gold"), logits.alias("logits"))
    return rows.withColumn("probs", P.softmax(F.col("logits"))).withColumn("pred", P.argmax(F.col("logits")))


def class_decisions(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.col("pred").cast("long").alias("pred"), P.decide(F.col("probs"), 0.2).cast("long").alias("flagged"), F.round(F.array_max("probs"), 6).alias("confidence"))


def class_confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir)).select(F.col("gold").cast("long").alias("gold"), F.col("pred").cast("long").alias("pred"), "n")


def class_f1(spark, sf_dir):
    c = M.per_class(M.confusion(scored(spark, sf_dir)))
    return c.select(F.col("cls").cast("long").alias("cls"), F.col("support").cast("long").alias("support"), *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


def score_summary(spark, sf_dir):
    return M.summary(M.confusion(scored(spark, sf_dir))).select(*[F.round(x, 9).alias(x) for x in ("macro_f1", "accuracy", "unfair_f1")])


def calibration_error(spark, sf_dir):
    return M.expected_calibration_error(scored(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


def brier_score(spark, sf_dir):
    return M.brier(scored(spark, sf_dir)).select(F.round("brier", 9).alias("brier"))


def temperature_curve(spark, sf_dir):
    return M.temperature(scored(spark, sf_dir), [0.5, 1.0, 2.0, 4.0]).select("temperature", F.round("nll", 9).alias("nll"))


def threshold_curve(spark, sf_dir):
    return M.thresholds(scored(spark, sf_dir), [i / 100 for i in range(10, 100)]).select("threshold", *[F.round(x, 9).alias(x) for x in ("macro_f1", "accuracy", "unfair_f1")])


def threshold_plateau(spark, sf_dir):
    return M.plateau(threshold_curve(spark, sf_dir)).select("low", F.round("centre", 9).alias("centre"), "high")


def bias_curve(spark, sf_dir):
    return M.other_bias(scored(spark, sf_dir)).select("bias", F.round("macro_f1", 9).alias("macro_f1"))


def bootstrap_intervals(spark, sf_dir):
    return M.bootstrap(scored(spark, sf_dir), 1000).select("metric", *[F.round(c, 9).alias(c) for c in ("low", "high")])


def paired_bootstrap(spark, sf_dir):
    """The decision by threshold against the likeliest class, on the same 200 resamples."""
    rows = scored(spark, sf_dir).withColumn("strict", P.decide(F.col("probs"), 0.6))
    return M.paired_bootstrap(rows, "pred", "strict", 200).select(*[F.round(c, 9).alias(c) for c in ("delta", "low", "high", "b_better")], "verdict")


def label_agreement(spark, sf_dir):
    """The toxic label against the quality label, as a binary confusion."""
    return M.binary(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 0).select("tp", "fp", "fn", "tn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1", "accuracy", "fpr")])


def sign_hash_distances(spark, sf_dir):
    """Sign bits of 64 components as a perceptual hash, against that of the vector with id 0."""
    v = table(spark, sf_dir, "embeddings")
    nibble = lambda i: sum((F.when(F.get("embedding", i * 4 + j) > 0, 8 >> j).otherwise(0) for j in range(4)), F.lit(0))
    h = v.select("vec_id", F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.hex(nibble(i).cast("bigint"))), "")).alias("hash"))
    base = h.where("vec_id = 0").select(F.col("hash").alias("base")).limit(1)
    return h.crossJoin(F.broadcast(base)).select("vec_id", "hash", P.hamming(F.col("hash"), F.col("base")).cast("long").alias("distance"))  # one row on that side


def imputed_scores(spark, sf_dir):
    """Components of zero or less stand for scores that a model did not give."""
    seen = F.transform(F.slice("embedding", 1, 9), lambda x: F.when(x > 0, F.round(x.cast("double"), 4)))
    v = table(spark, sf_dir, "embeddings").select("vec_id", seen.alias("seen"))
    missing = F.size(F.filter("seen", lambda x: x.isNull())) / F.size("seen")
    return v.select("vec_id", F.round(missing, 9).alias("missing"), F.posexplode(P.imputed(F.col("seen"))).alias("class", "score")).select("vec_id", F.col("class").cast("long").alias("class"), F.round("score", 4).alias("score"), "missing")


def flagged_by_run(spark, sf_dir):
    """Two thresholds as two runs, the gold class as the kind of page."""
    runs = {"low": 0.2, "high": 0.6}
    judged = scored(spark, sf_dir).select("gold", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), (P.decide(F.col("probs"), t) != OTHER).alias("flagged")) for r, t in runs.items()])).alias("x"))
    shares = M.flagged_shares(judged.select("gold", "x.*"), "gold", "run", "flagged", list(runs))
    return shares.select(F.col("gold").cast("long").alias("gold"), *[F.round(r, 9).alias(r) for r in runs])


QUERIES = {
    f.__name__: f
    for f in (class_decisions, class_confusion, class_f1, score_summary, calibration_error, brier_score, temperature_curve, threshold_curve, threshold_plateau, bias_curve, bootstrap_intervals, paired_bootstrap, label_agreement, sign_hash_distances, imputed_scores, flagged_by_run)
}

SCORED = """
  z as (select vec_id as id, label % 9 as gold, list_transform(embedding[1:9], lambda x: round(cast(x as double) * 4, 3)) as logits from embeddings),
  e as (select *, list_transform(logits, lambda x: exp(x - list_max(logits))) as ex, list_position(logits, list_max(logits)) - 1 as pred from z),
  s as (select *, list_transform(ex, lambda x: x / list_sum(ex)) as probs from e),
  cells as (select gold, pred, count(*) as n from s group by all)
"""
CLASSES = """
  c as (select cls, sum(case when g = 1 and gold = pred then n else 0 end) as tp, sum(case when g = 1 then n else 0 end) as support, sum(case when g = 0 then n else 0 end) as predicted
        from (select gold as cls, 1 as g, * from cells union all select pred as cls, 0 as g, * from cells) group by cls),
  f as (select cls, cast(support as bigint) as support, case when predicted = 0 then 0 else tp / cast(predicted as double) end as precision, case when support = 0 then 0 else tp / cast(support as double) end as recall,
               case when support + predicted = 0 or tp = 0 then 0 else 2.0 * tp / (support + predicted) end as f1 from c)
"""
def curve(name: str, grid: str, pred: str) -> str:
    """Metrics by a parameter: each value's decisions, their cells, and the summary over them."""
    return f"""
  d as (select {name}, gold, {pred} as p from s, (select unnest({grid}) as {name})),
  dc as (select {name}, gold, p, count(*) as n from d group by all),
  k as (select {name}, unnest(range(0, 9)) as cls from (select distinct {name} from dc)),
  pc as (select k.{name}, k.cls, sum(case when gold = cls and p = cls then n else 0 end) as tp, sum(case when gold = cls then n else 0 end) as support, sum(case when p = cls then n else 0 end) as predicted
         from k join dc on dc.{name} = k.{name} group by k.{name}, k.cls),
  m as (select {name}, avg(2.0 * tp / (support + predicted)) as macro_f1 from pc where support > 0 group by 1),
  a as (select {name}, sum(case when gold = p then n else 0 end) / cast(sum(n) as double) as accuracy,
               coalesce(2.0 * sum(case when gold <> 6 and p <> 6 then n else 0 end) / nullif(sum(case when gold <> 6 then n else 0 end) + sum(case when p <> 6 then n else 0 end), 0), 0) as unfair_f1 from dc group by 1),
  curve as (select {name}, round(macro_f1, 9) as macro_f1, round(accuracy, 9) as accuracy, round(unfair_f1, 9) as unfair_f1 from m join a using ({name}))
"""


def draws(names: str, boots: int) -> str:
    """Resamples of the rows behind `cells`: places by digests, cell after cell."""
    return f"""
  o as (select {names}, sum(n) over (order by {names}) as high, sum(n) over (order by {names}) - n as low from cells), tot as (select cast(sum(n) as bigint) as total from cells),
  j as (select boot, cast('0x' || substr(md5('1:' || boot || ':' || j), 1, 15) as bigint) % total as place from tot, (select unnest(range(1, {boots} + 1)) as boot), (select unnest(range(0, (select total from tot))) as j)),
  dc as (select boot, {names}, count(*) as n from j join o on place >= low and place < high group by all)"""


def resampled(pred: str, name: str) -> str:
    return f"""
  {name}_k as (select boot, unnest(range(0, 9)) as cls from (select distinct boot from dc)),
  {name}_c as (select k.boot, k.cls, sum(case when gold = cls and {pred} = cls then n else 0 end) as tp, sum(case when gold = cls then n else 0 end) as support, sum(case when {pred} = cls then n else 0 end) as predicted
     from {name}_k k join dc on dc.boot = k.boot group by k.boot, k.cls),
  {name} as (select * from (select boot, avg(2.0 * tp / (support + predicted)) as macro_f1 from {name}_c where support > 0 group by 1)
     join (select boot, sum(case when gold = {pred} then n else 0 end) / cast(sum(n) as double) as accuracy from dc group by 1) using (boot))"""


AT_THRESHOLD = "case when probs[7] >= threshold then 6 else list_position(list_concat(probs[1:6], [-1.0], probs[8:9]), list_max(list_concat(probs[1:6], [-1.0], probs[8:9]))) - 1 end"
WITH_BIAS = "list_position(list_concat(logits[1:6], [logits[7] + bias], logits[8:9]), list_max(list_concat(logits[1:6], [logits[7] + bias], logits[8:9]))) - 1"
THRESHOLDS = curve("threshold", "list_transform(range(10, 100), lambda i: i / 100.0::double)", AT_THRESHOLD)
ORACLES = {
    "class_decisions": f"with {SCORED} select id, cast(pred as bigint) as pred, cast(case when probs[7] >= 0.2 then 6 else list_position(list_concat(probs[1:6], [-1.0], probs[8:9]), list_max(list_concat(probs[1:6], [-1.0], probs[8:9]))) - 1 end as bigint) as flagged, round(list_max(probs), 6) as confidence from s",
    "class_confusion": f"with {SCORED} select cast(gold as bigint) as gold, cast(pred as bigint) as pred, n from cells",
    "class_f1": f"with {SCORED}, {CLASSES} select cast(cls as bigint) as cls, support, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from f",
    "score_summary": f"""with {SCORED}, {CLASSES}
        select round((select avg(f1) from f where support > 0), 9) as macro_f1, round(sum(case when gold = pred then n else 0 end) / cast(sum(n) as double), 9) as accuracy,
               round(2.0 * sum(case when gold <> 6 and pred <> 6 then n else 0 end) / (sum(case when gold <> 6 then n else 0 end) + sum(case when pred <> 6 then n else 0 end)), 9) as unfair_f1 from cells""",
    "calibration_error": f"""with {SCORED}, b as (select greatest(ceil(list_max(probs) * 15), 1) as bin, count(*) as n, avg(list_max(probs)) as conf, avg(case when pred = gold then 1.0 else 0.0 end) as acc from s group by 1)
        select round(sum(n * abs(conf - acc)) / sum(n), 9) as ece from b""",
    "brier_score": f"with {SCORED} select round(avg(list_sum(list_transform(probs, lambda p, i: pow(p - case when i - 1 = gold then 1 else 0 end, 2)))), 9) as brier from s",
    "temperature_curve": f"""with {SCORED}, t as (select temperature, gold, list_transform(logits, lambda x: exp((x - list_max(logits)) / temperature)) as ex from z, (select unnest([0.5, 1.0, 2.0, 4.0]::double[]) as temperature))
        select temperature, round(avg(-ln(ex[gold + 1] / list_sum(ex) + 1e-12)), 9) as nll from t group by 1""",
    "threshold_curve": f"with {SCORED}, {THRESHOLDS} select * from curve",
    "threshold_plateau": f"""with {SCORED}, {THRESHOLDS}, n as (select *, macro_f1 >= max(macro_f1) over () - 0.002 as near, macro_f1 = max(macro_f1) over () as best from curve),
        r as (select *, sum(case when near then 0 else 1 end) over (order by threshold) as run from n), g as (select min(threshold) as low, max(threshold) as high, bool_or(best) as best from r where near group by run)
        select low, round((low + high) / 2, 9) as centre, high from g where best order by low limit 1""",
    "bias_curve": f"with {SCORED}, {curve('bias', 'list_transform(range(0, 25), lambda i: -3 + 0.25::double * i)', WITH_BIAS)} select bias, macro_f1 from curve",
    "bootstrap_intervals": f"""with {SCORED}, {draws("gold, pred", 1000)}, {resampled("pred", "f")}, v as (select boot, macro_f1, accuracy from f)
        select 'macro_f1' as metric, round(quantile_cont(macro_f1, 0.025), 9) as low, round(quantile_cont(macro_f1, 0.975), 9) as high from v union all select 'accuracy', round(quantile_cont(accuracy, 0.025), 9), round(quantile_cont(accuracy, 0.975), 9) from v""",
    "paired_bootstrap": f"""with {SCORED.replace("cells as", "old as")}, strict as (select gold, pred, case when probs[7] >= 0.6 then 6 else list_position(list_concat(probs[1:6], [-1.0], probs[8:9]), list_max(list_concat(probs[1:6], [-1.0], probs[8:9]))) - 1 end as strict from s),
        cells as (select gold, pred, strict, count(*) as n from strict group by all), {draws("gold, pred, strict", 200)}, {resampled("pred", "fa")}, {resampled("strict", "fb")}, d as (select fb.macro_f1 - fa.macro_f1 as d from fa join fb using (boot))
        select round(avg(d), 9) as delta, round(quantile_cont(d, 0.025), 9) as low, round(quantile_cont(d, 0.975), 9) as high, round(avg(case when d > 0 then 1.0 else 0 end), 9) as b_better,
          case when quantile_cont(d, 0.025) > 0 then 'b' when quantile_cont(d, 0.975) < 0 then 'a' else 'neither' end as verdict from d""",
    "imputed_scores": """
        with s as (select vec_id, list_transform(embedding[1:9], lambda x: case when x > 0 then round(cast(x as double), 4) end) as seen from embeddings)
        select vec_id, class, round(coalesce(seen[class + 1], list_min(seen) - 1, -21), 4) as score, round(len(list_filter(seen, lambda x: x is null)) / cast(len(seen) as double), 9) as missing
        from s, (select unnest(range(0, 9)) as class)
    """,
    "flagged_by_run": f"""with {SCORED}, d as (select gold, threshold, {AT_THRESHOLD} <> 6 as flagged from s, (select unnest([0.2, 0.6]) as threshold))
        select cast(gold as bigint) as gold, round(avg(cast(flagged as double)) filter (where threshold = 0.2), 9) as low, round(avg(cast(flagged as double)) filter (where threshold = 0.6), 9) as high from d group by 1
    """,
    "sign_hash_distances": """
        with b as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as b from embeddings), o as (select b as o from b where vec_id = 0)
        select vec_id, array_to_string(list_transform(range(0, 16), lambda i: lower(to_hex(b[4 * i + 1] * 8 + b[4 * i + 2] * 4 + b[4 * i + 3] * 2 + b[4 * i + 4]))), '') as hash,
               cast(list_sum(list_transform(range(1, 65), lambda i: abs(b[i] - o[i]))) as bigint) as distance from b, o""",
    "label_agreement": """
        with c as (select count(*) filter (where toxic = 1 and quality = 0) as tp, count(*) filter (where toxic <> 1 and quality = 0) as fp, count(*) filter (where toxic = 1 and quality <> 0) as fn, count(*) filter (where toxic <> 1 and quality <> 0) as tn from labels)
        select tp, fp, fn, tn, round(coalesce(tp / nullif(cast(tp + fp as double), 0), 0), 9) as precision, round(coalesce(tp / nullif(cast(tp + fn as double), 0), 0), 9) as recall,
               round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1, round((tp + tn) / cast(tp + fp + fn + tn as double), 9) as accuracy, round(coalesce(fp / nullif(cast(fp + tn as double), 0), 0), 9) as fpr from c
    """,
}
