"""Sentence splitting and normalising against a plain walk over the text and known pairs."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clauselake.functions import sentences as S

ENDS = re.compile(r"""([.!?])[.!?]*(["')\]”’]*)\s+(?=["'(“‘\[]?[A-Z0-9•\-–—])""")


def walk(block):
    out, start = [], 0
    for m in ENDS.finditer(block):
        before = block[start : m.start() + 1]
        word = re.search(r"([A-Za-z.]+)\.$", before)
        word = word[1].lower() if word else ""
        if not m[2] and (word in S.ABBREVIATIONS or re.fullmatch("[a-z]", word) or re.fullmatch(r"\d+(\.\d+)*\.", before.strip())):
            continue
        out.append(block[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, block[start:].strip()] if s]


def capped(s, most):
    parts = []
    while len(s) > most:
        cut = s[:most].rfind(" ")
        at = cut + 1 if cut > most / 2 else most
        parts.append(s[:at].strip())
        s = s[at:].strip()
    return parts + [s] if s else parts


def plain(text, chars=25, words=5, most=1200):
    found = [p for b in re.split(r"\n+", text or "") for s in walk(re.sub(r"\s+", " ", b).strip()) for p in capped(s, most)]
    return [s for s in found if len(s) >= chars and len(s.split(" ")) >= words]


BLOCKS = [
    "Acme Inc. owns it. See e.g. section 5. Fine.", "Governed by U.S. law. J. Smith agrees.", 'He said "no." Then he left.', "5. Termination We may end it. 6.1. Fees Apply here.",
    "1. 2. Foo bar. Baz!", "Wait... What? Yes!! No.", "", "   ", "etc. The end. (See it.) Now", "It costs no. 5 Dollars. No. The rest", "a.m. Then p.m. Now", "“Quoted.” Next one. ‘Inner.’ Last",
]


def test_blocks(spark):
    rows = spark.createDataFrame([(i, re.sub(r"\s+", " ", b).strip()) for i, b in enumerate(BLOCKS)], "i int, b string")
    got = {r.i: r.s for r in rows.select("i", S.split_sentences(F.col("b")).alias("s")).collect()}
    for i, b in enumerate(BLOCKS):
        assert got[i] == walk(re.sub(r"\s+", " ", b).strip()), b


@pytest.mark.parametrize("most", [40, 400])
def test_documents(spark, tiny, most):
    t = pq.read_table(f"{tiny}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts = dict(zip(t["doc_id"], t["text"])) | {-1: "part, with, commas " * 90, -2: "x" * 1000, -3: None, -4: "\n\nOne of the short lines here. " + "word " * 60}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.s for r in rows.select("doc_id", S.sentences(F.col("text"), most=most).alias("s")).collect()}
    assert {i for i in texts if got[i] != plain(texts[i], most=most)} == set()


@pytest.mark.parametrize(
    "given, tokens",
    [
        ("We may terminate your account, at any time.", "we may terminate your account , at any time ."),
        ("Users' rights (see section 5.4) don't change.", "users ' rights ( see section 5.4 ) do n't change ."),
        ('They "cannot" sell; see https://example.com/a,b. Now', "they `` can not '' sell ; see https://example.com/a,b. now"),
        ("Mail legal@example.com, or www.example.com!", "mail legal@example.com , or www.example.com !"),
    ],
)
def test_normalised(spark, given, tokens):
    assert spark.range(1).select(S.normalised(F.lit(given)).alias("x")).first()["x"] == tokens
