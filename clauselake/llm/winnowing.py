"""Winnowing fingerprints, and their likeness between documents.

Each gram of K words has a rolling hash, a cyclic polynomial: the exclusive-or of its words' hashes, each rotated by its
distance from the gram's end.  A word is hashed once; grams of all places roll together by doubling, so that a gram of 2 m
words is one of m, rotated by m, with the next.  Of each window of grams the least hash is kept, the rightmost of
equals, with its position.

A window holds W grams in a text of 16 W grams or more, and in shorter texts the largest power of two that is a 16th of
the grams or less, one at least.  So any run of W + K - 1 words (nine) that two texts share leaves a common mark, in
texts of under 32 grams any K words do, and long texts keep two marks for W + 1 grams.  The marks of a wide window are
among those of a narrower one, and are found from them by their positions: `likeness` compares at the wider window of the two.

In scripts without spaces, and in words of more than LONG code points, each run of PIECE code points takes the place of
a word.  All in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import indices, let, words

K, W = 2, 8
#: Windows of a gram's length in a text: one of w grams needs so many times w.
GRAMS_A_WINDOW = 16
LONG, PIECE = 64, 3
#: What is written without spaces: Han, kana, Thai, Lao, Khmer, Burmese.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Ranges in which all of these lie.
MAY_BE_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u19E0-\u19FF\u2E80-\uFFFF\x{10000}-\x{10FFFF}]"
#: Documents of a bucket on average; up to this many buckets, the table of their first documents is broadcast, beyond that it is joined by a shuffle.
BUCKET_ROWS, BROADCAST_BUCKETS, QUANTILES = 1000, 65_536, 256
#: An id of more rows than so many buckets hold is dealt out by the hash of the text.
FULL = 4


def _where_wider(values: Column, wide: Column, step: int) -> Column:
    """In texts of windows wider than `step`, each value or the one `step` after it, whichever is less."""
    return let(values, lambda v: F.when(wide > step, F.transform(v, lambda x, i: F.least(x, F.get(v, i + step)))).otherwise(v))


def units(text: Column) -> Column:
    """The words of a text; of one without spaces inside, all its runs of PIECE code points."""
    runs = lambda cs: F.transform(indices(F.size(cs) - (PIECE - 1)), lambda i: F.concat(*[F.get(cs, i + j) for j in range(PIECE)]))
    whole = lambda w: (F.length(w) < PIECE) | ~((F.length(w) > LONG) | w.rlike(UNSPACED))
    cut = lambda w: F.when(whole(w), F.array(w)).otherwise(let(F.filter(F.split(w, ""), lambda c: c != ""), runs))
    # Plain ranges are looked for first: a script is a costly question of each character.
    long = text.rlike(r"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D]{%d}" % (LONG + 1))
    some = long | text.rlike(MAY_BE_UNSPACED) & text.rlike(UNSPACED)
    return F.when(some, F.flatten(F.transform(words(text), cut))).otherwise(words(text))


def _rotated(x: Column, by: int) -> Column:
    """The 64 bits of x turned left."""
    by %= 64
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _rolled(left: Column, right: Column, m: int, r: int) -> Column:
    """Hashes of m + r words in a row, from those of m words and of the r after them."""
    both = lambda a, b: F.transform(F.slice(a, F.lit(1), F.greatest(F.size(b) - m, F.lit(0))), lambda x, i: _rotated(x, r).bitwiseXOR(F.get(b, i + m)))
    return let(left, lambda a: both(a, a)) if left is right else let(left, lambda a: let(right, lambda b: both(a, b)))


def grams(ws: Column, k: int) -> Column:
    """Rolling hash of each k words in a row; of all words where there are fewer."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        power, size, out, done = hashes, 1, None, 0
        while True:
            if k & size:
                out, done = (power, size) if out is None else (_rolled(out, power, done, size), done + size)
            if done == k:
                break
            power, size = _rolled(power, power, size, size), 2 * size
        short = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: _rotated(a, 1).bitwiseXOR(x))
        return F.when(n >= k, out).when(n > 0, F.array(short)).otherwise(F.array().cast("array<long>"))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def window(count: Column, w: int) -> Column:
    """Grams of a window in a text of `count` grams."""
    out, step = F.lit(1), 2
    while step <= w:
        out, step = F.when(count >= GRAMS_A_WINDOW * step, step).otherwise(out), step * 2
    return out


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """struct<grams: int, marks: array<struct<hash: long, pos: int>>>: the number of grams, and the marks by position; w is a power of two.

    Fewer than k words (or units): the whole sequence is one gram; no words or a null text: no grams and no marks.
    """
    if w & (w - 1) or w < 1:
        raise ValueError("w must be a power of two")
    last = 2**31 - 1

    def of(hashes: Column) -> Column:
        wide = window(F.size(hashes), w)
        # 32 bits of hash above the reversed position: the least of a window is its rightmost least hash.
        least = F.transform(hashes, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR((F.lit(last) - i).cast("long")))
        step = 1
        while step < w:
            least = _where_wider(least, wide, step)
            step *= 2
        least = let(least, lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - (wide - 1), F.lit(0))))
        pos = F.transform(F.array_distinct(least), lambda v: (F.lit(last) - v.bitwiseAND(F.lit(last))).cast("int"))
        marks = F.transform(pos, lambda p: F.named_struct(F.lit("hash"), F.get(hashes, p), F.lit("pos"), p))
        return F.named_struct(F.lit("grams"), F.size(hashes), F.lit("marks"), marks)

    return let(grams(units(text), k), of)


def written(fp: Column) -> Column:
    """hash@position of each mark, comma-joined."""
    return F.array_join(F.transform(fp["marks"], lambda m: F.concat(F.hex(m["hash"]), F.lit("@"), m["pos"].cast("string"))), ",")


def widened(fp: Column, wide: Column) -> Column:
    """The marks that windows of `wide` grams leave of a fingerprint with windows of as many or fewer.

    A mark is the rightmost least of a window if one fits between the nearest lesser mark before it and the nearest
    lesser or equal one after it.
    """
    low = lambda m: m["hash"].bitwiseAND(F.lit(0xFFFFFFFF))

    def of(marks: Column) -> Column:
        def stays(m: Column, i: Column) -> Column:
            # Marks further away leave room in any case.
            near = F.slice(marks, F.greatest(i - wide, F.lit(0)) + 1, 2 * wide + 1)
            places = lambda keep: F.transform(F.filter(near, keep), lambda x: x["pos"])
            before = F.coalesce(F.array_max(places(lambda x: (x["pos"] < m["pos"]) & (low(x) < low(m)))), F.lit(-1))
            after = F.coalesce(F.array_min(places(lambda x: (x["pos"] > m["pos"]) & (low(x) <= low(m)))), fp["grams"])
            return after - before - 1 >= F.least(wide, fp["grams"])

        return F.filter(marks, stays)

    return let(fp["marks"], of)


def likeness(a: Column, b: Column, w: int = W) -> Column:
    """Jaccard of the hashes of two fingerprints, at the wider window of the two: 1 where both are empty, 0 where one is."""

    def of(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x, y)).cast("double")
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(common / (F.size(x) + F.size(y) - common))

    def at(fps: Column) -> Column:
        one, two = F.get(fps, 0), F.get(fps, 1)
        wide = F.greatest(window(one["grams"], w), window(two["grams"], w))
        marks = lambda fp: F.when(window(fp["grams"], w) == wide, fp["marks"]).otherwise(widened(fp, wide))
        hashes = F.transform(F.array(marks(one), marks(two)), lambda ms: F.array_distinct(F.transform(ms, lambda m: m["hash"])))
        return let(hashes, lambda h: of(F.get(h, 0), F.get(h, 1)))

    # Both are used many times: each is computed once.
    return let(F.array(a, b), at)


def bucketed(docs: DataFrame, id_col: str) -> tuple[Column, int]:
    """A bucket of each row, ascending with its id (quantiles, then equal parts of each); null ids lowest."""
    n, low, high, marks = docs.agg(F.count(F.lit(1)), F.min(id_col), F.max(id_col), F.percentile_approx(id_col, [i / QUANTILES for i in range(1, QUANTILES)], 10_000)).first()
    if low is None:
        return F.lit(-1).cast("long"), 1
    edges = sorted({low, *marks}) + [high + 1]
    parts = max(1, -(-(-(-n // BUCKET_ROWS)) // (len(edges) - 1)))
    firsts = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    at = let(firsts, lambda f: let(F.size(F.filter(f, lambda e: e <= F.col(id_col))), lambda q: (q - 1) * parts + F.floor((F.col(id_col) - F.get(f, q - 1)) * parts / (F.get(f, q) - F.get(f, q - 1)))))
    return F.coalesce(at.cast("long"), F.lit(-1).cast("long")), parts * (len(edges) - 1)


def parted(docs: DataFrame, bucket: Column) -> DataFrame:
    """`docs` (id, hash of the text, others) with `bucket` and, where one id (or none) has very many rows, its `part` of the range of hashes."""
    docs = docs.withColumn("bucket", bucket)
    full = docs.groupBy("bucket").count().where(F.col("count") > FULL * BUCKET_ROWS).select("bucket")
    if full.isEmpty():
        return docs.withColumn("part", F.lit(0).cast("long"))
    # An id of more than FULL buckets of rows: a 4,000th of all ids at most.
    many = docs.join(full, "bucket", "left_semi").groupBy(F.col("id").alias("_id")).agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("_parts")).where(F.col("_parts") > FULL)
    many = F.broadcast(many) if many.count() <= BROADCAST_BUCKETS else many
    place = F.floor((F.shiftrightunsigned(F.col("hash"), 11).cast("double") / 2.0**53) * F.coalesce("_parts", F.lit(1)))
    return docs.join(many, F.col("id").eqNullSafe(F.col("_id")), "left").withColumn("part", place.cast("long")).drop("_id", "_parts")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and fp of each document with next_text and next_fp of the next by descending id (after the last: the first).

    Texts move once, to the bucket of their id.  The first document of each bucket is also sent to the bucket before
    it, so no bucket needs another.  Null ids come last, equal ids by a hash of their text, and an id (or none) of very
    many rows has a bucket for each part of the range of hashes.  One document is its own
    next; a null text is empty.
    """
    docs = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    bucket, buckets = bucketed(docs, "id")
    # The unsigned hash, for ranges; ascending order needs the sign bit turned.
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    turned = F.col("hash").bitwiseXOR(F.lit(-(2**63)))
    keys = parted(hashed.drop("text"), bucket)
    heads = keys.groupBy("bucket", "part").agg(F.min(F.struct(F.bitwise_not("id").alias("down"), turned.alias("turned"))).alias("head"))
    down = Window.orderBy(F.desc("bucket"), "part")
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct("bucket", "part")
    heads = heads.withColumn("to", F.coalesce(F.lag(at).over(down), F.last(at).over(whole)))
    heads = heads.select(F.col("bucket").alias("_b"), F.col("part").alias("_p"), F.col("head.down").alias("_down"), F.col("head.turned").alias("_turned"), "to")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_BUCKETS else heads
    here = (F.col("bucket") == F.col("_b")) & (F.col("part") == F.col("_p"))
    rows = parted(hashed, bucket)
    rows = rows.join(heads, here & F.bitwise_not("id").eqNullSafe(F.col("_down")) & (turned == F.col("_turned")), "left")
    place = lambda extra, at: F.named_struct(F.lit("extra"), F.lit(extra), F.lit("bucket"), at["bucket"], F.lit("part"), at["part"])
    places = F.array_compact(F.array(place(0, at), F.when(F.col("to").isNotNull(), place(1, F.col("to")))))
    rows = rows.select("id", "text", "hash", places.alias("places")).select("id", "text", "hash", F.explode("places").alias("at")).select("id", "text", "hash", "at.*")
    # Fingerprints are made where the texts arrive, as they take more room than the words they are of.
    rows = rows.repartition("bucket", "part").withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket", "part").orderBy("extra", F.desc_nulls_last("id"), turned)
    return rows.select("id", "text", "fp", "extra", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).where("extra = 0").drop("extra")


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by as many of the next text's first, or all."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))
