"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is its set of word shingles.  Equal sets form a class, so exact copies cost one row.  Shingles are put in
one order for all documents, rarest first: by how common the shingle is, then its words, as two count sketches of the
whole corpus tell (added up in two steps, and of fixed size, so that they may be broadcast; their error changes the order, never the result),
then by hash.  Two sets of the wanted similarity share a shingle among the first n - ceil(t n) + 1 of each.

Links are wanted for what they connect, and a group of near copies may hold a third of all rows.  So each prefix shingle
first links its classes to one centre, the class that has it earliest; pairs that pass the length, positional and
suffix filters are verified on the whole sets.  Then, for exactness, all pairs that share a prefix shingle but are in
different components so far go through the same filters, and the rest of them are verified, once per pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import arrow_bytes, discard, durable, small_batches
from .components import connected_components

#: Counters of each sketch, in how many rows a task sends its own, and into how many rows of each of these they are first added up.
SLOTS, BLOCKS, FAN = 1 << 20, 16, 8
#: Cells of the suffix filter; bytes of texts sent to Python at once.
CELLS, BATCH_BYTES = 64, 8_000_000


def _sketches(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How common words and shingles are, in quarters of a doubling over the mean of their sketch: one byte for each counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            for _, data, at in S.chunks(b.column(0)):
                w = S.words(data, at)
                both[0] += np.bincount((w.hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
                both[1] += np.bincount((S.shingles(w, k)[0] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        yield from rows(enumerate(both.reshape(2 * BLOCKS, -1)), TaskContext.get().partitionId() % FAN)

    def rows(totals: Iterable[tuple[int, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
        for block, x in totals:
            packed = zstandard.compress(x.astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["block", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for block, part, counts in zip(*[c.to_pylist() for c in b.columns]):
                x = np.frombuffer(zstandard.decompress(counts), "<i8")
                total[block, part] = total[block, part] + x if (block, part) in total else x
        for (block, part), x in total.items():
            yield from rows([(block, x)], part)

    kind = "block int, part int, counts binary"
    per_task = docs.select("text").mapInArrow(count, kind)
    # Counters are added up by block and part, then by block.
    parts = per_task.repartition("block", "part").mapInArrow(add, kind).withColumn("part", F.lit(0))
    # 2 * BLOCKS rows of 8 bytes a counter reach the driver, whatever the corpus.
    summed = {r["block"]: np.frombuffer(zstandard.decompress(r["counts"]), "<i8") for r in parts.repartition("block").mapInArrow(add, kind).collect()}
    out = []
    for first in (0, BLOCKS):
        c = np.concatenate([summed.get(i, np.zeros(SLOTS // BLOCKS, np.int64)) for i in range(first, first + BLOCKS)])
        out.append(np.clip(4 * np.log2(np.maximum(c, 1) / max(1.0, c.mean())), 0, 255).astype(np.uint8))
    return out[0], out[1]


SETS = "doc_id long, t long, n long, c binary, prefix array<long>, cells array<tinyint>"


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of each document: size and signature of its set, its prefix in rare-first order, and counts of its shingles by cell."""
    common_word, common = _sketches(docs, k)
    sketch = docs.sparkSession.sparkContext.broadcast((common_word, common))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_word, common = sketch.value
        slots = np.uint64(SLOTS)
        for b in batches:
            for row, data, at in S.chunks(b.column(2)):
                docs_here = len(at) - 1
                w = S.words(data, at)
                h, doc, first = S.shingles(w, k)
                rank = common_word[(w.hashes % slots).astype(np.int64)].astype(np.uint64)
                last = np.minimum(first + k, (w.first + w.count)[doc]) if len(first) else first
                run = np.append(np.uint64(0), np.cumsum(rank))
                key = (common[(h % slots).astype(np.int64)].astype(np.uint64) << np.uint64(16)) + (run[last] - run[first])
                u = S.distinct(h, doc, key)
                h, doc = h[u], doc[u]
                n = np.bincount(doc, minlength=docs_here)
                start = np.cumsum(n) - n
                sums = np.zeros((docs_here, 2), np.uint64)  # 128 bits tell sets apart
                if len(h):
                    sums[n > 0, 0] = np.add.reduceat(S.mix(h ^ S.ODD), start[n > 0])
                    sums[n > 0, 1] = np.add.reduceat(S.mix(S.mix(h) + S.ODD), start[n > 0])
                c = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), docs_here, [None, pa.py_buffer(S.mix(sums + n.astype(np.uint64)[:, None]).tobytes())]).cast(pa.binary())
                cells = np.bincount(doc * CELLS + (h >> np.uint64(58)).astype(np.int64), minlength=docs_here * CELLS)
                cells = np.minimum(cells, 127).astype(np.int8)  # what is cut off makes sets look nearer, never farther
                taken = np.where(n > 0, n + (-percent * n // 100) + 1, 0)
                keep = np.arange(len(h)) - start[doc] < taken[doc]
                lists = lambda flat, size: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, docs_here), b.column(1).slice(row, docs_here), pa.array(n, pa.int64()), c, lists(pa.array(h[keep].view(np.int64)), taken), lists(pa.array(cells), np.full(docs_here, CELLS))],
                    names=["doc_id", "t", "n", "c", "prefix", "cells"],
                )

    return docs.select("doc_id", "t", "text").mapInArrow(of, SETS)


def _may_overlap(n_a: Column, n_b: Column, most: Column, percent: int) -> Column:
    """Length filter, and whether an intersection of `most` is enough."""
    sizes = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
    return sizes & (most * (100 + percent) >= (n_a + n_b) * percent)


def _suffix_filter(n_a: Column, n_b: Column, cells_a: Column, cells_b: Column, percent: int) -> Column:
    """Whether counts by cell leave room for enough of an intersection."""
    apart = F.aggregate(F.zip_with(cells_a, cells_b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, x: t + x)
    return _may_overlap(n_a, n_b, F.floor((n_a + n_b - apart) / 2), percent)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that pass the suffix filter."""
    side = lambda x: classes.select(F.col("c").alias(x), *[F.col(y).alias(f"{y}_{x}") for y in ("n", "cells")])
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    return sized.where(_suffix_filter(F.col("n_a"), F.col("n_b"), F.col("cells_a"), F.col("cells_b"), percent)).select("a", "b")


#: Keys of rows up to this many, in 40 bytes each at most, are sent to every task to pick or drop rows where their texts lie; beyond that, a shuffle brings both together.
BROADCAST_KEYS = 500_000
#: Stands for a null doc_id where rows are told apart by id and text: it sorts last.
NO_ID = 2**63 - 1


def _sent(keys: DataFrame) -> DataFrame:
    """`keys`, broadcast where they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """`pairs` (a, b; each once) of linked sets: texts of the classes in question alone are moved, and compared whole."""
    asked = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    asked = durable(classes.select("c", "one.doc_id", "one.t").join(asked, "c"))
    picked = _sent(asked)
    # The text of a class is that of its least row; repeated rows are one.
    texts = durable(docs.join(picked, ["doc_id", "t"]).dropDuplicates(["doc_id", "t", "c"]).select("c", "text"))
    text = lambda x: texts.select(F.col("c").alias(x), F.col("text").alias(f"text_{x}"))
    whole = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[bytes, np.ndarray] = {}

            def of(i: int, name: int, text: int) -> np.ndarray:
                c = b.column(name)[i].as_py()
                if c not in known:
                    if len(known) > 500:
                        known.clear()
                    known[c] = S.set_of((b.column(text)[i].as_py() or "").encode(), k)
                return known[c]

            linked = []
            for i in range(b.num_rows):
                x, y = of(i, 0, 2), of(i, 1, 3)
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        links = durable(whole.mapInArrow(compare, "a binary, b binary"))
    discard(asked, texts)
    return links


def _linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of each row of `docs` (doc_id not null): doc_id, t (a hash of its text), n (size of its set), c (its class); of each class: c, one (its least doc_id and t), least (that id), component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    small_batches(docs.sparkSession)
    sets = durable(_sets(docs, k, percent))
    members = durable(sets.select("doc_id", "t", "n", "c"))
    one = F.min(F.struct("doc_id", "t"))
    grouped = durable(sets.where("n > 0").groupBy("c").agg(one.alias("one"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("cells").alias("cells")))
    discard(sets)
    classes = durable(grouped.select("c", "one", F.col("one.doc_id").alias("least"), "n", "cells"))
    rows = grouped.select("c", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("token")
    # Shingles of one class alone can't be common: `seen` counts the others before.
    shared = durable(shared)
    hot = rows.join(shared, "token")
    hot = durable(hot.withColumn("seen", F.row_number().over(Window.partitionBy("c").orderBy("pos")) - 1))
    discard(grouped, shared)

    def possible(a: str, b: str) -> Column:
        x = lambda name: F.col(f"{a}.{name}")
        y = lambda name: F.col(f"{b}.{name}")
        most = F.least(x("seen"), y("seen")) + 1 + F.least(x("n") - x("pos") - 1, y("n") - y("pos") - 1)
        return _may_overlap(x("n"), y("n"), most, percent)

    centre = hot.groupBy("token").agg(F.min(F.struct("pos", "n", "c", "seen")).alias("at")).select("token", "at.*")
    stars = hot.alias("x").join(centre.alias("y"), "token").where((F.col("x.c") != F.col("y.c")) & possible("x", "y"))
    stars = durable(stars.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct())
    near = durable(_near(stars, classes, percent))
    links = _verified(near, classes, docs, k, percent)
    discard(near)
    parts = connected_components(links, "a", "b")
    placed = hot.join(classes.select("c", "cells"), "c").join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    placed = durable(placed.join(mixed, "token"))
    discard(hot)
    # The smaller set (ties: the lesser class) needs the shingle early: its intersection with a set as large is larger.
    early = placed.where((F.col("n") - F.col("pos") + F.col("seen")) * (100 + percent) >= F.col("n") * 2 * percent)
    rest = early.alias("x").join(placed.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.struct("x.n", "x.c") < F.struct("y.n", "y.c")) & (F.col("x.component") != F.col("y.component")) & possible("x", "y") & _suffix_filter(F.col("x.n"), F.col("y.n"), F.col("x.cells"), F.col("y.cells"), percent))
    rest = durable(rest.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"))
    discard(stars, placed)
    more = _verified(rest, classes, docs, k, percent)
    discard(rest)
    parts = durable(connected_components(links.unionByName(more), "a", "b"))
    return members, classes.select("c", "one", "least").join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))


def jaccard_classes(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of each row of `docs` (doc_id, text).

    class_id marks equal sets, component_id is the least doc_id reachable over links of `percent` / 100 or more.
    A null or empty text has an empty set and is linked with nothing: its component is itself.  Repeated rows are
    copies.  A row with a null doc_id is linked as any other but names no component: that of rows without ids alone is
    null.  (2**63 - 1 stands for no id.)  Columns but doc_id and text don't matter; an empty table gives an empty one.
    Sets are told apart by 128-bit hashes, the shingles of two sets that are compared by 64-bit ones.
    """
    members, named = _linked(docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), docs["text"]), k, percent)
    members = members.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    ids = named.groupBy("component").agg(F.nullif(F.min("least"), F.lit(NO_ID)).alias("component_id"))
    by_class = named.join(ids, "component").select("c", "component_id")
    out = members.join(by_class, (members["c"] == by_class["c"]) & (members["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), members["c"].alias("class_id"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with exactly one row of each component: that of its least doc_id (nulls last), then text hash.

    Rows are told apart by doc_id and text, so two texts with one id are two documents, and a repeated row is one.  A
    row with a null id is linked as any other.  Empty texts are linked with nothing: they all stay, but repeated rows
    with an id count once.  Of repeated rows that differ in other columns, the one with the least hash stays.
    """
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("t")]
    members, named = _linked(docs.select(key[0], docs["text"]), k, percent)
    first = named.groupBy("component").agg(F.min("one").alias("one")).select("one.*")
    gone = durable(members.where("n > 0").select("doc_id", "t").distinct().join(first, ["doc_id", "t"], "left_anti"))
    repeated = members.where((F.col("n") > 0) | (F.col("doc_id") != NO_ID)).groupBy("doc_id", "t").count().where("count > 1")
    repeated = durable(repeated.select("doc_id", "t").join(gone, ["doc_id", "t"], "left_anti"))
    rows = docs.select(*key, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # Texts are not moved for the sake of a few keys.
    kept = rows.join(_sent(gone.unionByName(repeated)), ["doc_id", "t"], "left_anti")
    if not repeated.isEmpty():
        # Each task first drops all but one row of a key, so a row repeated everywhere is moved once a task.
        order = Window.partitionBy("doc_id", "t").orderBy("h")
        once = rows.join(_sent(repeated), ["doc_id", "t"], "left_semi").withColumn("h", F.xxhash64("row"))
        kept = kept.unionByName(once.withColumn("at", F.row_number().over(order)).where("at = 1").select("doc_id", "t", "row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
