"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, exact_topk, mixing, ngram_join, packing, periodic, quality_lm, secret_scan, suffix_dedup, toxicity, url_filters, winnowing
from .common import table
from .native import let, words


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, sf_dir, "documents"), 400)
    # A cut may fall inside a character: what is left of one is written as U+FFFD in `text`, which is the kept text to read.
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("removed"), spans.alias("removed_spans"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


#: The rules of op4.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secret_scan.KINDS[k]}")
    return found.select("doc_id", of(0), of(1), of(2), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return quality_lm.judged(table(spark, sf_dir, "documents"), F.col("quality") == 1, labels=labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    rows = toxicity.scored(docs, machine)
    return rows.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", winnowing.edited(F.col("text"), F.col("next_text"))).withColumn("edited_fp", winnowing.fingerprint(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.written(F.col("fp")).alias("fingerprint"),
        winnowing.written(F.col("edited_fp")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        winnowing.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048, 1)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(exact_topk.quantized(table(spark, sf_dir, "embeddings"), 256), F.col("id") % 50 == 0, 5).drop("opened")


def op11_drake_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.integers(table(spark, sf_dir, "embeddings"), 64, 256)
    rows = centroids.drake_kmeans(vectors, centroids.hash_order("2:"), k=40, rounds=5)
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


#: The conversation that op12 adds.
ADDED = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    # Each conversation is formatted once; what follows reads the output.
    out = chat.formatted(rows.unionByName(added)).withColumn("formatted", chat.joined(F.col("segments")))
    out = out.withColumn("read", chat.read_back(F.col("formatted")))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("learned", chat.learned(F.col("segments")))
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        (F.col("valid") & F.col("complete")).alias("complete"),
    )


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text of op13: for each tenth document, from a word on, its words repeat with a period."""
    g = F.floor(F.crc32(doc_id.cast("string")) / 10)

    def periodic_from(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(a, lambda x: let(p, lambda y: F.transform(ws, lambda w, i: F.when(i >= x, F.get(ws, x + (i - x) % y)).otherwise(w))))

    new = let(words(text), lambda ws: F.when(F.size(ws) > 0, F.array_join(periodic_from(ws), " ")).otherwise(""))
    return F.when(F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False)), new).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic.with_runs(docs.withColumn("text", repeated_tail(F.col("doc_id"), F.col("text"))), least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_mix_sources, op3_suffix_dedup, op4_url_filters, op5_secret_scan, op6_quality_lm, op7_toxicity, op8_winnowing, op9_packing, op10_exact_topk, op11_drake_kmeans, op12_chat_format, op13_periodic_runs)}


def _kmeans_sql(k: int, rounds: int) -> str:
    """Assignments and centroids, round after round."""
    nearest = """a{i} as materialized (
          select v.row, any_value(v.vec_id) as vec_id, any_value(v.vec) as vec,
            min(struct_pack(d := cast(list_sum(list_transform(list_zip(v.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint), number := c.number)) as best
          from v cross join c{i} c group by v.row
        )"""
    replaced = """c{j} as materialized (
          select c.number, coalesce(m.vec, c.vec) as vec from c{i} c left join (
            select number, list(cast((s - ((s % n) + n) % n) // n as bigint) order by pos) as vec
            from (select number, pos, sum(x) as s, count(*) as n from (select best.number as number, unnest(range(1, len(vec) + 1)) as pos, unnest(vec) as x from a{i}) group by number, pos)
            group by number
          ) m using (number)
        )"""
    steps = [x.format(i=i, j=i + 1) for i in range(rounds) for x in (nearest, replaced)] + [nearest.format(i=rounds)]
    return f"""
        with v as materialized (
          select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vec
          from embeddings
          where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), c0 as materialized (
          select cast(row_number() over (order by sha256('2:' || vec_id) nulls last, vec) - 1 as integer) as number, vec from v order by number limit {k}
        ), {", ".join(steps)}
        select a.vec_id, a.best.number as cluster, a.best.d as distance,
          cast(sum(a.best.d) over (partition by a.best.number) as bigint) as cluster_inertia, cast(sum(a.best.d) over () as bigint) as inertia,
          sha256(array_to_string(c.vec, ',')) as centroid_sha256
        from a{rounds} a join c{rounds} c on c.number = a.best.number
    """


ORACLES = {
    "op10_exact_topk": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vec
          from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
          select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
          from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
        ), r as (
          select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
        )
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op11_drake_kmeans": _kmeans_sql(40, 5),
    "op12_chat_format": r"""
        with t as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all
          select -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' from range(2) r(i)
        ), m as (
          select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
            row_number() over (partition by conv_id order by turn desc, role desc, text desc) as from_end,
            length(text) + length(text) - length(replace(text, '\', ''))
              + list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)) as body,
            (length(text) - length(replace(text, '</turn>', ''))) // 7 as ends
          from t
        ), f as (
          select *, length('###  ') + length(role) + length(':') + coalesce(body, length(text) + length(text) - length(replace(text, '\', ''))) + ends + length('</turn>') + 1 as chars,
            case role when 'system' then before is null when 'user' then before is null or before in ('system', 'assistant') when 'assistant' then before = 'user' else false end as fine
          from m
        )
        select conv_id, count(*) as n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
          cast(sum(chars) as bigint) as formatted_chars,
          bool_and(fine) as valid,
          bool_and(fine) and bool_or(from_end = 1 and role = 'assistant') as complete
        from f group by conv_id
    """,
}
