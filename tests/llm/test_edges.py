"""Nulls, empty and repeated rows, empty tables and clashing column names, for each operator; aliases; the language model."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauselake.llm import exact_topk, mixing, ngram_join, packing, quality_lm, queries, secret_scan, suffix_dedup, url_filters, winnowing

from . import brute

#: Extra columns have names that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, bucket int"
TEXTS = ["one two three four five six seven", None, "", "one two three four five six seven", " \t\n", "wörter über alles " * 3000, "a"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i + 1, t, None if i == 2 else "en", None if i % 3 == 0 else "web", len(t or ""), 7, None, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[0]], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_ngram_join(odd, none):
    rows = ngram_join.jaccard_classes(odd, 3, 90).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(TEXTS) + 1
    assert got == brute.components(list(enumerate(TEXTS, 1)), 3, 90)
    assert ngram_join.jaccard_classes(none, 3, 90).count() == 0
    kept = ngram_join.without_near_copies(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 6, 7}


def test_links_through_rows_without_id(spark):
    words = [f"w{i}" for i in range(41)]
    a, b, c = (" ".join(words[:n]) for n in (37, 39, 41))
    docs = lambda b_id: spark.createDataFrame([(1, a), (b_id, b), (3, c), (None, "all by itself here"), (None, b)], "doc_id long, text string")
    got = lambda b_id: sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(docs(b_id), 3, 93).collect()), key=str)
    assert got(2) == sorted([(None, 1), (None, None), (1, 1), (2, 1), (3, 1)], key=str)
    assert got(None) == sorted([(None, None), (None, 1), (None, 1), (1, 1), (3, 1)], key=str)


def test_mixing_spreads_rows_without_id(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"), F.lit("web").alias("source"))
    rows = mixing.mix_sources(docs, keep=("text",))
    assert rows.count() == 20_000 and rows.agg(F.sum("taken")).first()[0] == 60_000
    key = mixing.range_bucket(F.xxhash64(F.lit(20), F.lit(None).cast("long"), F.lit(3).cast("long"), F.xxhash64("text")), 5)
    assert docs.groupBy(key).count().agg(F.max("count")).first()[0] < 4500


def test_bytes_that_are_no_utf8(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(unhex(concat('61', repeat('20FFFE62', 40))) as string)").alias("text"), F.lit("web").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"))
    assert {r.component_id for r in ngram_join.jaccard_classes(docs, 3, 90).collect()} == {0}
    assert mixing.mix_sources(docs).count() == 3
    assert suffix_dedup.dedup(docs, 400).count() == 3
    assert secret_scan.scan(docs).count() == 3
    assert quality_lm.judged(docs, F.lit(True)).count() == 3
    assert winnowing.with_next(docs).count() == 3
    pieces = packing.pack_documents(docs, queries.tokenizer_path(), 2048, 1).collect()
    assert len({(r.length, r.ids_crc32) for r in pieces}) == 1 and len(pieces) == 3


def test_tokenizer_that_joins_over_spaces(spark):
    from tokenizers import Tokenizer

    path, texts = queries.tokenizer_path("byte_bpe_50k.json"), ["two  spaces and a\nline", "", "one", "Don't  stop. "]
    assert not packing.WordTokens(path).by_word and packing.WordTokens(queries.tokenizer_path()).by_word
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.pack_documents(docs, path, 2048, 1).collect()}
    assert got == {i: brute.token_pieces(t, Tokenizer.from_file(path))[0] for i, t in enumerate(texts)}


def test_words_share_tokens(spark, monkeypatch):
    """Words that differ in case or closing marks are encoded once, plain ones by the model alone; odd ones as the tokenizer reads them whole."""
    from tokenizers import Tokenizer

    tokens = packing.WordTokens(queries.tokenizer_path())
    asked, encode = [], packing.WordTokens.encode
    monkeypatch.setattr(packing.WordTokens, "encode", lambda self, parts: (asked.extend(parts), encode(self, parts)))
    plain = ["onhe", "onhe***", "Onhe,&&&", "queí.", "QUEÍ", "queí%%%", "queí"]
    odd = ["<|endoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>***", "<|endoftext|", "don't***", "DON'S'", "'s.", "a'***", "***", "e\u0301a!", "straße", "STRASSE", "ẞ.", "İx.", "µm.", "ﬁn.", "Σας.", "漢字.", "×.", "a×", "ÿ--", "Ÿ--", "x\x1cy.", "x\u0338.", "<\u0338", "555-4564", "½x", "a\u200b.", "\xa0a."]
    texts = [" ".join(plain), *odd, " ".join(odd), " \t" + "\n\x0b".join(odd) + "\r\n", None, "", " ", "tail "]
    for _ in range(2):
        flat, first = tokens.texts(pa.array(["left out", *texts], pa.string()).slice(1))
        whole = Tokenizer.from_file(queries.tokenizer_path())
        assert [flat[a:z].tolist() for a, z in zip(first[:-1], first[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert {a for a in asked if b"onhe" in a.lower() or b"que" in a.lower()} == {b"onhe", "queí".encode()}
    assert len(asked) == len(set(asked))
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.pack_documents(docs, queries.tokenizer_path(), 2048, 1).collect()}
    assert got == {i: brute.token_pieces(t, whole)[0] for i, t in enumerate(odd)}


def test_plain_words_need_no_patterns():
    tokens = packing.WordTokens(queries.tokenizer_path())
    words = ["onhe", "ciónieción", "verschätete", "the"]
    want = [tokens.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    tokens.tokenizer = None
    flat, first = tokens.texts(pa.array(words))
    assert [flat[a:z].tolist() for a, z in zip(first[:-1], first[1:])] == want


def test_mixing(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert {r.taken for r in rows if r.doc_id in (2, 3, 5)} == {0}
    assert sum(r.taken for r in rows) == sum(r["size"] for r in rows)
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(len(brute.words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_suffix_dedup(odd, none):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.dedup(odd, 400).collect()}
    texts = [(t or "").encode() for t in [*TEXTS, TEXTS[0]]]
    want = [brute.digest(t, m) for t, m in zip(texts, brute.removed(texts, 400))]
    assert {k: (r.n_removed, r.n_spans) for k, r in got.items()} == {(i % len(TEXTS) + 1, w[0]): w[1:3] for i, w in enumerate(want)}
    assert suffix_dedup.dedup(none, 400).count() == 0


PAGES = "page_id long, url string, html string, host string, node string"


def test_url_filters(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "https://a.net/es/x", "", None, None),  # blocked by its rule
        (2, "https://b.org/x", link("https://a.net/es/x"), None, None),  # blocked by its alias
        (3, "https://c.org/y", link("https://b.org/x"), None, None),  # blocked by an alias's alias
        (4, "https://d.org/z", link("https://e.com/"), None, None),  # allowed by an alias
        (5, "https://f.net/fr/", '<meta http-equiv="refresh" content="0; url=https://e.com/">', None, None),  # its rule wins
        (6, "https://g.org/w", None, None, None),
        (7, None, link("https://a.net/es/x"), None, None),
        (8, "no scheme", "", None, None),
        (9, "https://h.org/a/b", link("../es/"), None, None),
        (9, "https://h.org/a/b", link("../es/"), None, None),
        (10, "https://i.org/q", link("https://never.net/es/fetched"), None, None),
        (11, "https://j.org/q", link("https://never.net/fr/fetched") + link("https://www.example.com/en/"), None, None),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    got = [(r.page_id, r.rule, r.verdict) for r in url_filters.judge(pages, queries.URL_RULES).collect()]
    verdicts = {i: v for i, _, v in got}
    assert len(got) == len(rows)
    assert {i for i, v in verdicts.items() if v == "block"} == {1, 2, 3, 5, 10}
    assert dict((i, r) for i, r, _ in got if r) == {1: "net/es/", 5: "net/fr/"}
    assert url_filters.judge(pages.limit(0), queries.URL_RULES).count() == 0
    moved = spark.createDataFrame([("https://g.org/w", "https://a.net/es/x"), (None, "https://a.net/es/x")], "source string, target string")
    again = {r.page_id: r.verdict for r in url_filters.judge(pages, queries.URL_RULES, redirects=moved).collect()}
    assert again == verdicts | {6: "block"}


def test_secret_scan(odd, none):
    rows = secret_scan.scan(odd).collect()
    assert len(rows) == len(TEXTS) + 1 and all(not r.spans for r in rows if r.doc_id in (2, 3, 5, 7))
    assert secret_scan.scan(none).count() == 0
    masked = secret_scan.redacted_documents(odd.withColumn("text", F.concat("text", F.lit(" password=hunter2hunter2"))))
    assert masked.columns == odd.columns
    assert all("hunter2hunter2" not in (r.text or "") for r in masked.collect())


def test_winnowing(odd, none):
    rows = winnowing.with_next(odd).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        n, want = brute.winnow(TEXTS[r.id - 1], winnowing.K, winnowing.W)
        assert r.fp.grams == n and len(r.fp.marks) == len(want)
    assert winnowing.with_next(none).count() == 0


@pytest.mark.parametrize("broadcast", [0, 65_536])
def test_next_of_rows_without_id_and_of_one_id(spark, monkeypatch, broadcast):
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(winnowing, "BROADCAST_BUCKETS", broadcast)
    rows = [(i, f"text {i}") for i in range(300)] + [(150, f"same id {i}") for i in range(400)] + [(None, f"no id {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = winnowing.parted(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")), winnowing.bucketed(docs.withColumnRenamed("doc_id", "id"), "id")[0])
    assert buckets.groupBy("bucket", "part").count().agg(F.max("count")).first()[0] < 130
    hashed = {r.text: r.h & (1 << 64) - 1 for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = sorted((t, order[(n + 1) % len(order)][1]) for n, (_, t) in enumerate(order))
    assert sorted((r.text, r.next_text) for r in winnowing.with_next(docs).collect()) == want


def test_packing(odd, none):
    rows = packing.pack_documents(odd, queries.tokenizer_path(), 2048, 1).collect()
    assert {r.doc_id for r in rows} == set(range(1, len(TEXTS) + 1))
    assert {(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3)} == {(1, 1)}
    assert packing.pack_documents(none, queries.tokenizer_path(), 2048, 1).count() == 0


def test_exact_topk(spark):
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [0.0, 0.0], 1), (50, [-1.0, 0.25], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, pivot int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_topk.top_k(exact_topk.quantized(vectors, 256), F.col("id") % 50 == 0, 5).collect()}
    half = 128 * 128 * 2
    assert got == {
        (0, 1): (1, half), (0, 2): (2, half), (0, 3): (7, 0), (0, 4): (50, 128 * -256 + 128 * 64),
        (50, 1): (7, 0), (50, 2): (0, -24576), (50, 3): (1, -24576), (50, 4): (2, -24576),
    }
    assert exact_topk.top_k(exact_topk.quantized(vectors.limit(0), 256), F.col("id") % 50 == 0, 5).count() == 0


def test_quality_lm(spark, odd, none):
    trusted = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "über den log"]
    texts = [*trusted, "the cat sat on the log", "qzx jjk vvw", "", None, "the cat sat on the mat"]
    docs = spark.createDataFrame([(i, t, i < len(trusted)) for i, t in enumerate(texts)], "doc_id long, text string, good boolean")
    score = brute.kneser_ney([t.encode() for t in trusted], 5)
    got = {r.doc_id: r.perplexity for r in quality_lm.perplexities(docs, F.col("good")).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        if not t:
            assert got[i] is None
        else:
            logs = score(t.encode())
            assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
    assert got[5] > 5 * got[4] and got[0] == got[8]
    rows = quality_lm.judged(odd, F.col("doc_id") == 1).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.kept == 0 for r in rows if r.doc_id in (2, 3))
    assert quality_lm.judged(none, F.lit(True)).count() == 0
