"""Text, personal-data, likeness and address operators over documents, benchmark and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import html as H
from ..functions import pii as P
from ..functions import sentences as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import domains, similar
from .store import table


def first_documents(spark, sf_dir):
    """One document of each normal key: the least id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normal_key(F.coalesce("text", F.lit(""))), 256).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def significant_word_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.significant_words(F.coalesce("text", F.lit(""))).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("words"), F.array_join(T.longest_words(F.col("w"), 3), " ").alias("longest"))


def benchmark_overlap(spark, sf_dir):
    """Documents that hold half of the trigrams of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similar.contained(docs, items, 0.5).select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "share")


def near_duplicate_turns(spark, sf_dir):
    """Turns of conversations that are near copies of an edited turn: one that begins with two words more."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    edited = c.select("id", F.concat(F.lit("Well then, "), F.col("text")).alias("text"))
    return similar.near_duplicates(c, edited, 0.3, 2)


def near_duplicate_documents(spark, sf_dir):
    """Pairs of different documents that share most of their word trigrams."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similar.near_duplicates(d, d, 0.7).where("left_id < right_id").select("left_id", "right_id", "shared", F.round("similarity", 9).alias("similarity"))


def legal_and_fee_cues(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.legal_cues(F.col("text")).cast("long").alias("cues"), T.money_kind(F.col("text")).alias("money"))


def personal_data_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", P.counts(F.col("text")).alias("c"))
    return d.select("doc_id", "c.*")


def page_addresses(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.host(u).alias("host"), U.path(u).alias("path"), U.strip_query(u).alias("bare"), U.registrable(U.host(u)).alias("site"), U.address_key(u).alias("key"), U.policy_key(u).alias("policy")
    )


def guessed_addresses(spark, sf_dir):
    """Where the terms of each page's site may lie."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(U.guessed_terms(F.col("url"))).alias("place", "address"))
    return p.select("page_id", F.col("place").cast("long").alias("place"), "address")


def page_texts(spark, sf_dir):
    """What a reader sees of each page, and what was left out of it."""
    p = table(spark, sf_dir, "pages").select("page_id", H.read(F.col("html")).alias("p"))
    main = H.main_text(F.col("p"))
    return p.select("page_id", main.alias("text"), "p.hidden", "p.markup", "p.comments", H.is_shell(F.col("p")).alias("shell"), T.legal_cues(main).cast("long").alias("cues"))


def previous_turns(spark, sf_dir):
    """Each turn with the one before it."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lag("text").over(by), F.lit("")).alias("prev"))


def quotes_in_documents(spark, sf_dir):
    """Benchmark items that a document quotes word for word."""
    return similar.quoting(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def document_sentences(spark, sf_dir):
    """Sentences of documents in reading order, at most 1,500 of each, with the one before."""
    found = S.with_previous(F.slice(S.sentences(F.col("text")), 1, 1500))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("s"))
    return d.select("doc_id", F.col("s.index").cast("long").alias("index"), "s.sentence", "s.prev")


#: What a document begins with, by its number: the given ones say nothing of fees.
OPENINGS = (
    "All sales are final. We may change our prices at any time without notice. No refunds. Thanks for reading these terms of ours.",
    "Welcome to the service, please read on. Your plan renews automatically unless you cancel it. All fees are non-refundable once paid.",
    "",
)


def opened(spark, sf_dir):
    opening = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (F.pmod("doc_id", F.lit(len(OPENINGS))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", opening, "text").alias("text"))


def fee_sentences(spark, sf_dir):
    """Sentences (ten characters and two words at least) that speak of fees, at most 200 of each document, with the number of the next sentence that is classified."""
    d = opened(spark, sf_dir).select("doc_id", F.explode(S.fee_clauses(F.col("text"))).alias("c"))
    return d.select("doc_id", F.col("c.index").cast("long").alias("index"), "c.kind", "c.text")


def ranked_clauses(spark, sf_dir):
    """The 80 best documents of another source for each benchmark item, by the words they share: an item asks for one language, and two of three documents are current."""
    items = table(spark, sf_dir, "benchmark")
    category = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.pmod("item_id", F.lit(len(LANGUAGES))) + 1).cast("int"))
    asked = items.select(F.col("item_id").alias("ask_id"), F.lit("web").alias("domain"), category.alias("category"), "text")
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clause"), F.coalesce("source", F.lit("")).alias("domain"), F.col("lang").alias("category"), (F.pmod("doc_id", F.lit(3)) != 0).alias("current"), "text")
    return similar.bm25_candidates(asked, stored).select("ask_id", "clause", F.round("score", 6).alias("score"), "rank")


#: Suffix rules that the hosts of `sites_of_hosts` are judged by, in the format of the public list; the last is private.
RULES = ("com", "net", "org", "uk", "co.uk", "jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "hk", "com.hk")
PRIVATE_RULES = ("github.io",)
LANGUAGES = ("en", "fr", "de", "es")
ENDS = ("", ".co.uk", ".kobe.jp", ".city.kobe.jp", ".ck", ".www.ck", ".github.io", ".com.hk")


def hosts_of_pages(spark, sf_dir):
    """Each page's host, as it is or under one of a few ends."""
    end = F.element_at(F.array(*[F.lit(x) for x in ENDS]), (F.pmod("page_id", F.lit(len(ENDS))) + 1).cast("int"))
    host = U.host(F.col("url"))
    own = F.when(end == "", host).otherwise(F.concat(F.regexp_replace(F.substring_index(host, ".", 2), r"\.", "."), end))
    return table(spark, sf_dir, "pages").select("page_id", own.alias("host"))


def sites_of_hosts(spark, sf_dir):
    """Suffix and site of every page's host by a list of rules."""
    lines = spark.createDataFrame([(x, False) for x in RULES] + [(x, True) for x in PRIVATE_RULES], "line string, private boolean")
    return domains.sites(hosts_of_pages(spark, sf_dir), domains.rules(lines))


def model_answers(spark, sf_dir):
    """What is left of an answer about each turn: a model is given the turn and quotes its beginning and words that it lacks, in one of six shapes."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    point = lambda severity, quote: F.struct(F.lit("arbitration").alias("category"), F.lit(severity).alias("severity"), F.lit("A title").alias("title"), F.lit("A detail").alias("detail"), quote.alias("quote"))
    json = F.to_json(F.struct(F.array(point("high", F.substring("text", 1, 40)), point("low", F.lit("words that no turn says"))).alias("points")))
    shapes = (
        F.concat(F.lit("```json\n"), json, F.lit("\n```")), F.concat(F.lit("Here it is: "), json, F.lit(" Done.")), F.concat(json, F.lit(" "), json), F.substring(json, F.lit(1), F.length(json) - 3),
        F.concat(F.lit('<think>{"points": []}</think>'), json), F.concat(F.lit("<think>never ends "), json),
    )
    answer = F.element_at(F.array(*shapes), (F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(len(shapes))) + 1).cast("int"))
    rows = t.withColumn("points", A.summary_points(answer)).withColumn("f", A.finalised(F.col("points"), F.array("text")))
    number = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    return rows.select("conv_id", "turn", F.col("points").isNotNull().alias("valid"), number(F.col("f.risk_score")).alias("risk_score"), number(F.size(F.coalesce("f.points", F.array()))).alias("kept"), number(F.col("f.dropped")).alias("dropped"))


def normalised_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.normalised(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (first_documents, significant_word_counts, benchmark_overlap, near_duplicate_turns, near_duplicate_documents, legal_and_fee_cues, personal_data_counts, page_addresses, guessed_addresses, page_texts, previous_turns, quotes_in_documents, document_sentences, fee_sentences, normalised_turns, model_answers, ranked_clauses, sites_of_hosts)}

KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
GRAMS = """list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)"""
STOP = ", ".join(f"'{w}'" for w in T.STOP)

TOKENS = r"""list_filter(string_split(regexp_replace(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"""
list_of = lambda xs: ", ".join(f"'{x}'" for x in xs)

CANON = r"""lower(trim(regexp_replace(translate(regexp_replace(text, '[\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'), '‘’“”', '''''""'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')))"""


def grams(table_: str, id_: str) -> str:
    return f"select id, unnest(g) as gram, len(g) as n from (select id, {GRAMS} as g from (select {id_} as id, list_filter(string_split({KEY.format('text')}, ' '), lambda x: x <> '') as w from {table_}))"


def cues(text: str) -> str:
    return " + ".join(f"cast(regexp_matches({text}, '(?i){c}') as bigint)" for c in T.LEGAL_CUES)


def money(text: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '(?i){'|'.join(ps)}') then '{kind}'" for kind, ps in T.MONEY) + " end"


ORACLES = {
    "first_documents": f"select sha256({KEY.format('coalesce(text, chr(32))')}) as key, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "benchmark_overlap": f"""
        with a as ({grams("documents", "doc_id")}), b as ({grams("benchmark", "item_id")})
        select a.id as doc_id, b.id as item_id, cast(count(*) as double) / b.n as share from a join b using (gram) group by a.id, b.id, b.n having cast(count(*) as double) / b.n >= 0.5
    """,
    "near_duplicate_turns": f"""
        with t as (select conv_id || ':' || turn as id, text from conversations), e as (select id, 'Well then, ' || text as text from t),
        w as (select 0 as side, id, {KEY.format('text')} as k from t union all select 1, id, {KEY.format('text')} from e),
        v as (select side, id, list_filter(string_split(k, ' '), lambda x: x <> '') as w from w),
        s as (select side, id, list_distinct(case when len(w) = 0 then [] when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from v),
        g as (select side, id, unnest(g) as gram, len(g) as n from s), p as (
          select a.id as left_id, b.id as right_id, count(*) as shared, a.n as an, b.n as bn from g a join g b on a.gram = b.gram and a.side = 0 and b.side = 1 group by all)
        select left_id, right_id, shared, cast(shared as double) / (an + bn - shared) as similarity from p where cast(shared as double) / (an + bn - shared) >= 0.3
    """,
    "near_duplicate_documents": f"""
        with g as ({grams("documents", "doc_id")}), p as (
          select a.id as left_id, b.id as right_id, count(*) as shared, a.n as an, b.n as bn from g a join g b on a.gram = b.gram and a.id < b.id group by all)
        select left_id, right_id, shared, round(cast(shared as double) / (an + bn - shared), 9) as similarity from p where cast(shared as double) / (an + bn - shared) >= 0.7
    """,
    "significant_word_counts": f"""
        with w as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]{{2,}}'), lambda x: not list_contains([{STOP}], x)) as w from documents),
        u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as ord from w), f as (select doc_id, word, min(ord) as ord from u group by all),
        r as (select *, row_number() over (partition by doc_id order by length(word) desc, ord) as rn from f)
        select doc_id, count(word) as words, coalesce(string_agg(word, ' ' order by rn) filter (where rn <= 3), '') as longest from documents left join r using (doc_id) group by doc_id
    """,
    "quotes_in_documents": f"""
        with d as (select doc_id, {CANON} as t from documents), i as (select item_id, {CANON} as q from benchmark)
        select distinct doc_id, item_id from d join i on contains(t, q) where length(q) >= 8
    """,
    "legal_and_fee_cues": f"select doc_id, {cues('coalesce(text, chr(32))')} as cues, {money('text')} as money from documents",
    "page_addresses": r"""
        with p as (select page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)', ['s', 'h', 'p', 'path']) as x from pages),
        q as (select page_id, url, lower(x.s) as s, nullif(lower(x.h), '') as host, case when x.p = '' then '' else ':' || x.p end as port, case when lower(x.h) = '' then null when x.path = '' then '/' else x.path end as path from p)
        select page_id, host, path, coalesce(s || '://' || host || port || path, url) as bare, regexp_extract(host, '[^.]+\.[^.]+$') as site,
               regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') as key, s || '://' || host || port || path as policy from q
    """,
    "guessed_addresses": f"""
        with p as (select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:\\d+)?', ['s', 'h', 'p']) as x from pages),
        t as (select {list(U.TERMS_PATHS)} as paths)
        select page_id, cast(i as bigint) as place, lower(x.s) || '://' || lower(x.h) || x.p || paths[i + 1] as address from p, t, (select unnest(range(0, {len(U.TERMS_PATHS)})) as i) where x.h <> ''
    """,
    "fee_sentences": """
        with f(kind_, index, kind, text) as (values
          (0, 0, 'no_refund', 'All sales are final.'), (0, 0, 'price_change', 'We may change our prices at any time without notice.'), (0, 1, 'no_refund', 'No refunds.'),
          (1, 1, 'auto_renewal', 'Your plan renews automatically unless you cancel it.'), (1, 2, 'no_refund', 'All fees are non-refundable once paid.'))
        select doc_id, cast(index as bigint) as index, kind, f.text as text from documents join f on doc_id % 3 = kind_
    """,
    "model_answers": f"""
        with t as (select conv_id, turn, coalesce(text, '') as text, (conv_id * 8 + turn) % 6 in (0, 1, 4) and coalesce(text, '') <> '' as valid from conversations),
        q as (select conv_id, turn, valid, length({CANON.replace("(text,", "(substr(text, 1, 40),")}) >= 8 as quoted from t)
        select conv_id, turn, valid, cast(case when valid and quoted then 25 else 0 end as bigint) as risk_score, cast(case when valid and quoted then 1 else 0 end as bigint) as kept, cast(case when not valid then 0 when quoted then 1 else 2 end as bigint) as dropped from q
    """,
    "ranked_clauses": f"""
        with d as (select doc_id as clause, coalesce(source, '') as domain, lang as category, doc_id % 3 <> 0 as current, {TOKENS} as w from documents),
        p as (select clause, len(w) as n, unnest(w) as word from d), t as (select clause, n, word, count(*) as tf from p group by all),
        f as (select word, count(*) as df from t group by 1), a as (select count(*) as c, avg(len(w)) as mean from d),
        i as (select item_id, [{list_of(LANGUAGES)}][item_id % 4 + 1] as category, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]{{2,}}'), lambda x: not list_contains([{STOP}], x)) as w from benchmark),
        u as (select item_id, category, unnest(w) as word, generate_subscripts(w, 1) as ord from i), g as (select item_id, category, word, min(ord) as ord from u group by all),
        h as (select *, row_number() over (partition by item_id order by length(word) desc, ord) as rn, count(*) over (partition by item_id) as many from g),
        q as (select distinct item_id, category, unnest(list_filter(string_split(regexp_replace(word, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) as word from h where rn <= 12 and many >= 3),
        s as (
          select q.item_id as ask_id, t.clause, sum(greatest(ln((a.c - f.df + 0.5) / (f.df + 0.5)), 1e-6) * (t.tf * 2.2) / (t.tf + 1.2 * (0.25 + 0.75 * t.n / a.mean))) as score
          from q join t using (word) join f using (word) join d on d.clause = t.clause and d.category = q.category and d.current and lower(d.domain) <> 'web', a group by 1, 2
        ), r as (select ask_id, clause, score, cast(row_number() over (partition by ask_id order by round(score, 9) desc, clause) as integer) as rank from s)
        select ask_id, clause, round(score, 6) as score, rank from r where rank <= 80
    """,
    "sites_of_hosts": f"""
        with p as (select page_id, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as h, [{list_of(ENDS)}][page_id % {len(ENDS)} + 1] as e from pages),
        o as (select distinct case when e = '' then h else array_to_string(string_split(h, '.')[1:2], '.') || e end as host from p where h <> ''),
        t as (select host, string_split(host, '.') as ls, unnest(range(1, len(string_split(host, '.')) + 1)) as n from o),
        r(suffix, kind, icann) as (values {", ".join(f"('{x.lstrip('!').removeprefix('*.')}', {2 if x[0] == '!' else 1 if x[0] == '*' else 0}, {str(x in RULES).lower()})" for x in (*RULES, *PRIVATE_RULES))}),
        f as (select host, ls, kind, icann, n + case kind when 2 then -1 when 1 then 1 else 0 end as taken from t join r on array_to_string(ls[len(ls) - n + 1:], '.') = suffix),
        b as (select host, max(struct_pack(x := kind = 2, taken := taken, icann := icann)) as b from f where taken <= len(ls) group by 1),
        k as (select host, string_split(host, '.') as ls, coalesce(b.b.taken, 1) as k, coalesce(b.b.icann, false) as icann from o left join b using (host)),
        s as (select host, array_to_string(ls[len(ls) - k + 1:], '.') as suffix, case when len(ls) > k then array_to_string(ls[len(ls) - k:], '.') end as site, icann from k)
        select host, suffix, site, string_split(site, '.')[1] as label, icann and site is not null as public from s
    """,
    "previous_turns": "select conv_id, turn, coalesce(lag(text) over (partition by conv_id order by turn), '') as prev from conversations",
}
