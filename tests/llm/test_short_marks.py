"""Half-edited short texts, and texts without spaces, still share marks with what they were."""

import random

from pyspark.sql import functions as F

from clauselake.llm import winnowing

from . import brute


def likenesses(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    edited = winnowing.edited(F.col("a"), F.col("b"))
    near = winnowing.likeness(winnowing.fingerprint(F.col("a")), winnowing.fingerprint(edited))
    other = winnowing.likeness(winnowing.fingerprint(F.col("a")), winnowing.fingerprint(F.col("b")))
    return [(r.near, r.other) for r in rows.select("i", near.alias("near"), other.alias("other")).orderBy("i").collect()]


def text(rng, n, start):
    return " ".join(start + "".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def test_short_and_unspaced(spark):
    rng = random.Random(2)
    draw = lambda first, count, n: "".join(chr(first + rng.randrange(count)) for _ in range(n))
    pairs = [(text(rng, n, "x"), text(rng, n, "y")) for n in range(8, 40)]
    pairs += [(draw(0x4E00, 3000, n), draw(0x6E00, 3000, n)) for n in (16, 40, 400)]  # Han
    pairs += [(draw(0x3042, 40, 60), draw(0x30A2, 40, 60))]  # kana
    pairs += [(draw(0x1D400, 50, 300), draw(0x61, 26, 300))]  # one long block, outside the basic plane
    for n, (near, other) in enumerate(likenesses(spark, pairs)):
        assert 0 < near < 1 and other == 0, (n, near, other)


def test_insertion(spark):
    """An insertion in a long block changes the marks around it alone."""
    rng = random.Random(4)
    block = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=600))
    rows = spark.createDataFrame([(block, block[:200] + "__" + block[200:])], "a string, b string")
    near = rows.select(winnowing.likeness(winnowing.fingerprint(F.col("a")), winnowing.fingerprint(F.col("b"))).alias("x")).first().x
    assert 0.9 < near < 1


def test_grams_of_any_length(spark):
    texts = [" ".join(f"w{i % 7}" for i in range(n)) for n in (0, 1, 2, 3, 6, 7, 8, 40)]
    for k in (1, 2, 3, 5, 6, 8):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", winnowing.grams(winnowing.units(F.col("t")), k).alias("g")).orderBy("i").collect()
        for r, t in zip(rows, texts):
            assert [g & (1 << 64) - 1 for g in r.g] == [h for h, _ in brute.winnow(t, k, 1)[1]]
