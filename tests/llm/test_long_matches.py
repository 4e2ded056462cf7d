"""The run-length index and the splitting of hot anchors, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import suffix_dedup
from clauselake.llm.run_index import RunIndex

from . import brute


def longest_elsewhere(blocks):
    """At each place of each block, the longest match that starts at another place of any block; at most the rest of the block."""
    every = [(b, i) for b in blocks for i in range(len(b))]
    out = []
    for n, (b, i) in enumerate(every):
        best = 0
        for m, (c, j) in enumerate(every):
            if m != n:
                z = 0
                while i + z < len(b) and j + z < len(c) and b[i + z] == c[j + z]:
                    z += 1
                best = max(best, z)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    blocks = list({bytes(rng.choice(b"ab" if seed % 2 else b"abcd") for _ in range(rng.randint(1, 14))) for _ in range(6)})
    times = np.array([rng.choice([1, 1, 3]) for _ in blocks])
    index = RunIndex(blocks, times)
    got = np.concatenate([index.statistics()[f : f + len(b)] for f, b in zip(index.first, blocks)])
    copies = [b for b, n in zip(blocks, times) for _ in range(n)]
    want, at = longest_elsewhere(copies), 0
    for f, b, n in zip(index.first, blocks, times):
        assert index.statistics()[f : f + len(b)].tolist() == want[at : at + len(b)]
        at += n * len(b)
    assert len(got) == sum(map(len, blocks))
    # The runs say how often each symbol stands in the transform: once for each byte of each copy, and once for its end.
    assert index.length.sum() == sum(n * (len(b) + 1) for b, n in zip(blocks, times))


@pytest.mark.parametrize("most", [1, 3])
def test_hot_anchors_are_split(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_BLOCKS", most)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    near, long_ = letters(39), letters(120)  # one passage just too short to match alone, one long enough
    texts = [letters(rng.randint(0, 50)) + rng.choice([near, long_, near + letters(1), long_[:60]]) + letters(rng.randint(0, 50)) for _ in range(60)] + ["", None, "ü" * 50, "a" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    masks = brute.removed(raw, 40)
    for r in suffix_dedup.dedup(docs, 40, 10).collect():
        mask = masks[r.doc_id]
        assert (r.n_removed, r.kept) == (sum(mask), bytes(b for b, m in zip(raw[r.doc_id], mask) if not m))
        assert sum(x.end - x.start for x in r.removed) == r.n_removed and len(r.removed) == r.n_spans


def test_repeated_rows_and_ids(spark):
    text = "x" * 10 + "".join(chr(97 + i * i % 26) for i in range(500))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + "!"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(docs.withColumn("key", F.lit("k")), 400).collect())
    masks = brute.removed([t.encode() for t in (text, text, text + "!", "")], 400)
    assert got == sorted((len(m), sum(m)) for m in masks)
