"""The toxicity machine and the quality model's thresholds, by formula and by planted cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import quality_lm, toxicity

from . import brute


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    found = np.array([0, 2, 3, 5])
    z = 0.3 + sum(m.weights[i] for i in found) + sum(float(m.factors[i] @ m.factors[j]) for n, i in enumerate(found) for j in found[n + 1 :])
    assert m.score(found) == pytest.approx(1 / (1 + math.exp(-z)))


def test_a_pair_that_no_weight_shows():
    """Words a and b are as common in clean rows as in toxic ones; both at once, or neither, is toxic: no sum of weights tells that."""
    rng = random.Random(3)
    docs, y = [], []
    for n in range(3000):
        a, b = rng.random() < 0.45, rng.random() < 0.45
        docs.append(np.array(sorted({1000 + rng.randrange(40) for _ in range(6)} | ({1} if a else set()) | ({2} if b else set()))))
        y.append(int(a == b))
    machine = toxicity.fit(docs, np.array(y))
    place = {int(h): i for i, h in enumerate(machine.hashes)}
    assert {1, 2} <= set(place)
    score = lambda *terms: machine.score(np.array([place[t] for t in terms]))
    assert score(1, 2) > 0.7 and score(1) < 0.4 and score(2) < 0.4


def test_toxicity_edges(spark):
    texts = ["zork you", "nice day", None, "", "zork zork zork", "ü " * 20_000]
    rows = [(i, texts[i % len(texts)], 9.0) for i in range(60)] + [(None, "zork", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int("zork" in (texts[i % len(texts)] or ""))) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.scored(docs, machine)
    assert got.columns.count("score") == 1 and got.count() == len(rows)
    by = {r.text: r.score for r in got.collect()}
    assert by["zork you"] > 0.7 > 0.3 > by["nice day"] and by[None] == by[""]
    assert toxicity.scored(docs.limit(0), machine).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, nothing).collect()} == {0.5}


def test_thresholds_and_verdicts(spark):
    """Perplexities by a plain model over the training fold, and each language's limit by the fold that is left out."""
    rng = random.Random(2)
    words = "the cat dog sat on mat log and ran far".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 12))) for _ in range(80)]
    rows = [(i % 50 if i else None, t, "en" if i % 3 else None, True) for i, t in enumerate(texts)] + [(100, "qqx zzj", "en", False), (101, None, "en", True), (102, "", "xx", False), (103, "the cat", "xx", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean")
    out = {r.text: r.out for r in docs.select("text", (F.pmod(F.xxhash64("text"), F.lit(quality_lm.FOLDS)) == 0).alias("out")).collect()}
    score = brute.kneser_ney([t.encode() for _, t, _, good in rows if good and t and not out[t]], quality_lm.ORDER)
    want = {t: math.exp(-sum(x := score(t.encode())) / len(x)) for _, t, _, _ in rows if t}
    got = quality_lm.judged(docs, F.col("good"), quantile=0.9).collect()
    assert len(got) == len(rows)
    assert sorted(r.perplexity for r in got if r.perplexity) == pytest.approx(sorted(want[t] for _, t, _, _ in rows if t), rel=1e-4)
    level = lambda values: sorted(values)[math.ceil(0.9 * len(values)) - 1]
    left_out = [(lang, want[t]) for _, t, lang, good in rows if good and t and out[t]]
    every, english = level([p for _, p in left_out]), level([p for lang, p in left_out if lang == "en"])
    for r in got:
        limit = english if r.lang == "en" else every
        assert r.threshold == pytest.approx(limit, rel=1e-4)
        assert r.kept == int(r.perplexity is not None and r.perplexity <= r.threshold)
