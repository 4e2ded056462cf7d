"""Summaries of documents and preparation of labels: a line item is a passage, its order the document."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import labels as L
from ..functions import display as D
from ..operators import prepare, reading
from .store import table


def passages(spark, sf_dir):
    kinds = F.array(*[F.lit(c) for c in L.CATEGORIES])
    fees = F.array(*[F.lit(c) for c in L.MONEY_KINDS])
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("index"), "l_partkey", "l_suppkey", "l_returnflag",
        (F.lit(0.5) + F.round(F.col("l_discount") * 4, 2)).alias("confidence"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("text"),
    )
    clauses = lines.select("doc", "index", F.element_at(kinds, (F.col("l_partkey") % 9 + 1).cast("int")).alias("category"), "confidence", "text")
    return clauses, lines.where("l_returnflag = 'A'").select("doc", "index", F.element_at(fees, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("kind"), "text")


def found(spark, sf_dir):
    return reading.findings(*passages(spark, sf_dir))


def document_summaries(spark, sf_dir):
    s = reading.summaries(found(spark, sf_dir))
    points = F.array_join(F.transform("points", lambda p: F.concat_ws("/", p["kind"], p["count"], p["quote"])), " ")
    return s.select("doc", "score", "level", points.alias("points"))


def family_totals(spark, sf_dir):
    return reading.family_totals(found(spark, sf_dir)).select("doc", F.col("rank").cast("long").alias("rank"), "family", "n")


def document_strips(spark, sf_dir):
    """As if sentences lay a hundred apart, so that several share a tick."""
    rows = found(spark, sf_dir).withColumn("index", F.col("index") * 100)
    totals = rows.select("doc").distinct().withColumn("total", F.lit(700))
    return reading.strip(rows, totals).select("doc", F.col("bin").cast("long").alias("bin"), F.col("index").cast("long").alias("index"), "kind")


def nearest_findings(spark, sf_dir):
    rows = found(spark, sf_dir)
    return reading.nearest(rows, rows.select("doc", (F.col("doc") % 7).alias("target")).distinct()).select("doc", F.col("index").cast("long").alias("index"))


def reading_lists(spark, sf_dir):
    rows = reading.folded(reading.reading_list(found(spark, sf_dir), 5), 2, 1)
    return rows.select("doc", F.col("place").cast("long").alias("place"), F.col("index").cast("long").alias("index"), "kind", "shown")


def failure_messages(spark, sf_dir):
    """Users' events stand for candidate pages: a click was not reached, a view an error, a purchase not terms."""
    reason = F.when(F.col("event_type") == "click", "fetch-failed").when(F.col("event_type") == "view", "http-error").when(F.col("event_type") == "purchase", "not-terms").otherwise("too-short")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.col("event_id") % 7).alias("site"), reason.alias("reason"))
    return reading.failure_message(rows)


def shown_orders(spark, sf_dir):
    """Counts, shares, ages, sizes and keys as text."""
    o = table(spark, sf_dir, "orders")
    at, now = F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-03 12:34:56").cast("timestamp")
    n = (F.col("o_orderkey") % 13).cast("long")
    price = F.col("o_totalprice")
    return o.select(
        "o_orderkey",
        D.counted(F.col("o_custkey") * 17, "clause").alias("counted"),
        D.share(n / 100).alias("share"),
        D.flagged_headline(n, F.col("o_custkey")).alias("headline"),
        D.badge(n).alias("badge"),
        D.rounded_age(at, now).alias("age"),
        D.floored_age(at, now).alias("floored_age"),
        D.byte_size(price * price * 7).alias("size"),
        D.integrity(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("integrity"),
        D.composite_key("o_orderstatus", "o_orderpriority").alias("key"),
        D.retry_after_ms(n / 20, 30, 3_600_000).alias("retry_ms"),
        D.is_domain(F.concat("o_orderstatus", F.lit(".example"))).alias("upper_domain"),
        D.is_domain(F.lower(F.concat("o_orderstatus", F.lit(".example")))).alias("lower_domain"),
    )


def prepared(spark, sf_dir):
    """Documents with the labels that they have, and the rarest of them."""
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    names = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor"), F.when(F.col("quality") == 1, "good")))
    return prepare.rarest_label(flags.select(F.col("doc_id").alias("id"), names.alias("labels")))


def rarest_labels(spark, sf_dir):
    return prepared(spark, sf_dir)


def class_weights(spark, sf_dir):
    return prepare.class_weights(prepared(spark, sf_dir)).select("label", "n", F.round("weight", 9).alias("weight"))


def label_split(spark, sf_dir):
    return prepare.stratified_split(prepared(spark, sf_dir), "id", "label")


def replayed_labels(spark, sf_dir):
    return prepare.replay(prepared(spark, sf_dir), "id", "label", 40, "good")


def turn_lengths(spark, sf_dir):
    s = prepare.sizes(table(spark, sf_dir, "conversations").where("text is not null"), "conv_id", "text")
    return s.select("conv_id", "n", F.col("median").cast("long").alias("median"), F.col("longest").cast("long").alias("longest"))


def model_agreement(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select((F.col("label") % 9).alias("a"), F.pmod(F.col("label") + F.col("vec_id") % 3, F.lit(9)).alias("b"))
    return prepare.agreement_cells(v, "a", "b", 6).select(*[F.round(c, 9).alias(c) if c in ("share_a", "share_b", "same") else c for c in ("share_a", "share_b", "both", "only_a", "only_b", "same")])


QUERIES = {
    f.__name__: f
    for f in (document_summaries, family_totals, document_strips, nearest_findings, reading_lists, failure_messages, shown_orders, rarest_labels, class_weights, label_split, replayed_labels, turn_lengths, model_agreement)
}

_array = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_case = lambda values, key: f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"
FOUND = f"""
  l as (select l_orderkey as doc, l_linenumber - 1 as index, {_array(L.CATEGORIES)}[l_partkey % 9 + 1] as category, {_array(L.MONEY_KINDS)}[l_suppkey % 4 + 1] as fee_kind,
               l_returnflag, 0.5 + round(l_discount * 4, 2) as confidence, l_orderkey || ':' || l_linenumber as text from lineitem),
  found as (select doc, index, category as kind, confidence, text, false as fee from l where category <> 'other'
            union all select doc, index, fee_kind, {L.RULE_CONFIDENCE}, text, true from l where l_returnflag = 'A')
"""
FAMILY = f"coalesce({_case(L.FAMILY_OF, 'kind')}, 'money')"
LABELLED = """
  f as (select doc_id as id, max(toxic) as toxic, min(quality) as quality from labels group by 1),
  e as (select id, 1 as ord, 'toxic' as label from f where toxic = 1 union all select id, 2, 'poor' from f where quality = 0 union all select id, 3, 'good' from f where quality = 1),
  c as (select label, count(*) as n from e group by 1),
  p as (select id, label from e join c using (label) qualify row_number() over (partition by id order by n, ord) = 1),
  r as (select f.id, coalesce(p.label, 'other') as label from f left join p using (id))
"""
AGO = "{n}::bigint || ' {unit}' || case when {n} = 1 then '' else 's' end || ' ago'"
LINKS = "'Found ' || n || ' link' || case when n = 1 then '' else 's' end"
ORACLES = {
    "document_summaries": f"""with {FOUND},
        k as (select doc, kind, count(*) as n, max(confidence) as conf, arg_max(text, (confidence, case when fee then 0 else 1 end, -index)) as quote, min((case when fee then 1 else 0 end, index)) as first,
                     case {_case(L.SEVERITY_OF, 'kind')} when 'high' then 25 when 'medium' then 12 else 4 end as points from found group by doc, kind),
        r as (select *, row_number() over (partition by doc order by points desc, conf desc, first, kind) as rn from k)
        select doc, cast(least(100, sum(points)) as bigint) as score, case when least(100, sum(points)) >= 50 then 'high' when least(100, sum(points)) >= 20 then 'medium' else 'low' end as level,
               string_agg(kind || '/' || n || '/' || quote, ' ' order by rn) filter (where rn <= 5) as points from r group by doc""",
    "family_totals": f"with {FOUND} select doc, list_position({_array(L.FAMILIES)}, {FAMILY})::bigint as rank, {FAMILY} as family, count(*) as n from found group by 1, 2, 3",
    "document_strips": f"""with {FOUND}, b as (select *, cast(least(239, floor(index * 100 / 700.0::double * 240)) as bigint) as bin from found)
        select doc, bin, cast(index * 100 as bigint) as index, kind from b qualify row_number() over (partition by doc, bin order by fee, index, kind) = 1""",
    "nearest_findings": f"with {FOUND} select doc, cast(index as bigint) as index from found qualify row_number() over (partition by doc order by abs(index - doc % 7), fee, index) = 1",
    "reading_lists": f"""with {FOUND}, t as (select * from found qualify row_number() over (partition by doc order by confidence desc, fee, index, kind) <= 5),
        q as (select doc, row_number() over (partition by doc order by index, fee, kind) as place, cast(index as bigint) as index, kind, count(*) over (partition by doc) as many from t)
        select doc, place, index, kind, place <= 2 or place > many - 1 as shown from q""",
    "failure_messages": f"""with s as (select user_id * 1000 + event_id % 7 as site, count(*) as n, count(*) filter (where event_type = 'click') as f, count(*) filter (where event_type = 'view') as h, count(*) filter (where event_type = 'purchase') as t from events group by 1)
        select site, {LINKS} || case when f = n then ', but none could be reached. Check your connection.' when h = n then ', but every one returned an error (a sign-in wall, or the page moved).'
          when t > 0 then ', but ' || case when n = 1 then 'it does' else 'none' end || ' not read like terms of service.' else ', but what came back was too short to be a terms document.' end as message from s""",
    "shown_orders": f"""with o as (select *, o_orderkey % 13 as n, greatest(0, epoch(timestamp '1998-08-03 12:34:56') - epoch(o_orderdate)) as s, o_totalprice * o_totalprice * 7 as b from orders),
        a as (select *, floor(s + 0.5) as rs, floor(floor(s + 0.5) / 60 + 0.5) as rm, floor(floor(floor(s + 0.5) / 60 + 0.5) / 60 + 0.5) as rh from o)
        select o_orderkey, format('{{:,}}', o_custkey * 17) || case when o_custkey * 17 = 1 then ' clause' else ' clauses' end as counted,
               case when n >= 10 then n || '%' else printf('%.1f', n::double) || '%' end as share,
               case when n = 0 then 'No potentially unfair clauses found' else n || ' potentially unfair clause' || case when n = 1 then '' else 's' end || ' in ' || o_custkey || ' read' end as headline,
               case when n = 0 then 'clean' when n < 8 then 'some' else 'many' end as badge,
               case when rs < 90 then 'just now' when rm < 90 then rm::bigint || ' minutes ago' when rh < 36 then {AGO.format(n="rh", unit="hour")} else {AGO.format(n="floor(rh / 24 + 0.5)", unit="day")} end as age,
               case when s < 90 then 'just now' when s >= 86400 then {AGO.format(n="floor(s / 86400)", unit="day")} when s >= 3600 then {AGO.format(n="floor(s / 3600)", unit="hour")} else {AGO.format(n="floor(s / 60)", unit="minute")} end as floored_age,
               case when b >= 1e9 then printf('%.1f', b / 1e9) || ' GB' when b >= 1e6 then floor(b / 1e6 + 0.5)::bigint || ' MB' else greatest(1, floor(b / 1e3 + 0.5))::bigint || ' kB' end as size,
               'sha256-' || base64(from_hex(sha256(o_orderkey::varchar))) as integrity, o_orderstatus || '|' || o_orderpriority as key,
               cast(ceil((1 - n / 20.0::double) * 3600000 / 30) as bigint) as retry_ms, regexp_matches(o_orderstatus || '.example', '{D.DOMAIN}') as upper_domain, regexp_matches(lower(o_orderstatus || '.example'), '{D.DOMAIN}') as lower_domain from a""",
    "rarest_labels": f"with {LABELLED} select * from r",
    "class_weights": f"with {LABELLED}, w as (select label, count(*) as n from r group by 1) select label, n, round(pow(n, -0.25) / (select sum(n * pow(n, -0.25)) / sum(n) from w), 9) as weight from w",
    "label_split": f"""with {LABELLED} select id, label, case when row_number() over (partition by label order by md5('0:' || id), id) <= round(count(*) over (partition by label) / 10.0) then 'val' else 'train' end as split from r""",
    "replayed_labels": f"""with {LABELLED} select id, label from r where label <> 'good' union all
        select id, label from (select *, row_number() over (order by md5('0:' || id), id) as rn from r where label = 'good') where rn <= greatest(0, 40 - (select count(*) from r where label <> 'good'))""",
    "turn_lengths": "select conv_id, count(*) as n, cast(list_sort(list(length(text)))[count(*) // 2 + 1] as bigint) as median, cast(max(length(text)) as bigint) as longest from conversations where text is not null group by 1",
    "model_agreement": """with v as (select label % 9 as a, (label + vec_id % 3) % 9 as b from embeddings)
        select round(avg(case when a <> 6 then 1.0 else 0.0 end), 9) as share_a, round(avg(case when b <> 6 then 1.0 else 0.0 end), 9) as share_b, count(*) filter (where a <> 6 and b <> 6) as both,
               count(*) filter (where a <> 6 and b = 6) as only_a, count(*) filter (where a = 6 and b <> 6) as only_b, round(avg(case when a <> 6 and b <> 6 then case when a = b then 1.0 else 0.0 end end), 9) as same from v""",
}
