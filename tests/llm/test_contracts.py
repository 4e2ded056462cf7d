"""Each numbered query against a plain version of its contract."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from clauselake.llm import packing, queries, secret_scan, winnowing

from . import brute


def documents(sf_dir, *columns):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=list(columns)).to_pydict()
    return list(zip(*[t[c] for c in columns]))


@pytest.fixture(scope="module")
def docs(tiny):
    return documents(tiny, "doc_id", "text", "source")


def test_op1(spark, small):
    rows = documents(small, "doc_id", "text")
    want = brute.components(rows, 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_join(spark, small).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_op2(spark, tiny, docs):
    got = queries.op2_mix_sources(spark, tiny).collect()
    assert sorted(got) == sorted(queries.op2_mix_sources(spark, tiny).collect())
    source, size = {i: s for i, _, s in docs}, {i: len(brute.words(t)) for i, t, _ in docs}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want, taken = brute.targets(sizes), Counter()
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_op3(spark, tiny, docs):
    texts = [(t or "").encode() for _, t, _ in docs]
    want = {i: brute.digest(t, m) for (i, _, _), t, m in zip(docs, texts, brute.removed(texts, 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op3_suffix_dedup(spark, tiny).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


def test_op4(spark, small):
    pages = pq.read_table(f"{small}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in queries.op4_url_filters(spark, small).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r, (host, path) = got[p["page_id"]], brute.url_parts(p["url"])
        rule = brute.url_rule(host, path, queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")


def test_op5(spark, small):
    got = {r.doc_id: r for r in queries.op5_secret_scan(spark, small).collect()}
    rows = documents(small, "doc_id", "text")
    assert len(got) == len(rows)
    hits = 0
    for i, text in rows:
        base = brute.secrets(text)
        names = [f"{kind}:{a}:{z}" for a, _, z, kind in base]
        r, n = got[i], Counter(kind for *_, kind in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        listed = r.spans.split(",") if r.spans else []
        assert [x for x in listed if not x.startswith("random:")] == names
        assert listed == sorted(listed, key=lambda x: (int(x.split(":")[1]), secret_scan.KINDS.index(x.split(":")[0])))
        hits += len(names)
    assert hits


def test_op7(spark):
    # A sixth of the toxic labels is noise: those texts hold nothing that clean ones don't.
    small = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{small}/labels.parquet").to_pylist()}
    rows = queries.op7_toxicity(spark, small).collect()
    assert len(rows) == len(documents(small, "doc_id"))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for y, p in judged if y == 1]
    clean = [p for y, p in judged if y == 0]
    assert len(toxic) >= 100 and sum(toxic) >= 0.8 * len(toxic)
    assert sum(clean) <= 0.005 * len(clean)


def test_op8(spark, tiny, docs):
    got = {r.doc_id: r for r in queries.op8_winnowing(spark, tiny).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    written = lambda marks: ",".join(f"{h:X}@{p}" for h, p in marks)
    k, w = winnowing.K, winnowing.W
    sizes = lambda n: max(x for x in (1, 2, 4, 8) if x == 1 or n >= 16 * x)
    differ = 0

    def like(x, y):
        nonlocal differ
        a, b = sizes(brute.winnow(x, k, w)[0]), sizes(brute.winnow(y, k, w)[0])
        differ += a != b
        a, b = ({h for h, _ in brute.winnow(t, k, w, max(a, b))[1]} for t in (x, y))
        return 1.0 if not a | b else len(a & b) / len(a | b)

    words = written_bytes = text_bytes = 0
    for at, (i, text, _) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        own, edited = brute.winnow(text, k, w)[1], brute.winnow(new, k, w)[1]
        assert (r.fingerprint, r.edited_fingerprint) == (written(own), written(edited))
        assert r.near_edited == pytest.approx(like(text, new)) and r.near_next == pytest.approx(like(text, after))
        # One word over and over is one gram over and over, and the rightmost of equals is another in each window.
        if len(set(brute.words(text))) > 300:
            assert len(own) < len(brute.words(text)) / 3
            written_bytes, text_bytes = written_bytes + len(r.fingerprint), text_bytes + len(text.encode())
            words += 1
    assert differ > 20 and words > 10 and written_bytes < text_bytes


def check_packed(rows, tokens, size=2048):
    """Pieces lie gapless in their sequences; little room is left."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length >= 1
            at += length
        assert at <= size
    assert len(by) <= tokens / size * 1.02 + 2
    assert sorted(by) == list(range(len(by)))


def test_op9(spark, tiny, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op9_packing(spark, tiny).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    want = {i: brute.token_pieces(t, tokenizer) for i, t, _ in docs}
    assert got == want
    check_packed(rows, sum(x[0][3] for x in want.values()))


def test_plan_places_every_length():
    rng = np.random.default_rng(3)
    histogram = Counter(rng.integers(1, 2049, 5000).tolist()) + Counter({7: 40_000, 2048: 11, 1025: 900})
    placed = Counter()
    for pattern, count in packing.plan(dict(histogram)):
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] += count
    assert placed == histogram


@pytest.mark.parametrize("sf", ["tiny", "small"])
def test_op10(spark, request, sf):
    sf_dir = request.getfixturevalue(sf)
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    ids, vecs = np.array(t["vec_id"]), np.floor(256 * np.array(t["embedding"], np.float64)).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        scores = vecs @ vecs[q]
        best = [j for j in np.lexsort((ids, -scores)) if j != q][:5]
        want += [(ids[q], n + 1, ids[j], scores[j]) for n, j in enumerate(best)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op10_exact_topk(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
