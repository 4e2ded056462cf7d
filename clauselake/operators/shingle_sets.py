"""Texts as sets of hashed word n-grams, whole batches at a time, and what near-duplicate joins need of them.

Every step reads texts and makes their sets anew: a set has eight bytes a word, more than the text it comes from has when
stored, so sets themselves are neither moved nor kept.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Counters of all shingles, and parts in which tasks pass them on.
SLOTS, BLOCKS = 1 << 22, 64


def words(text: Column) -> Column:
    """Hashes of the words of the normal key."""
    return F.transform(T.split_words(T.normal_key(text)), lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def sets(column: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text and the shingle, distinct and sorted by both, of texts given as hashes of words: runs of `n` words; all words as one where there are fewer."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    row, end = np.repeat(np.arange(len(size)), size), np.cumsum(size)
    at = np.arange(len(flat))
    left = end[row] - at if len(flat) else at
    begins = (left >= n) | (left == size[row]) if len(flat) else at.astype(bool)
    at, row, left = at[begins], row[begins], left[begins]
    gram = np.zeros(len(at), np.uint64)
    for k in range(n):
        more = k < left
        gram[more] = _mixed(gram[more] * np.uint64(0x9E3779B97F4A7C15) + flat[at[more] + k] + np.uint64(k + 1))
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[fresh], gram[fresh]


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(8)).astype(np.int64) & (SLOTS - 1)


def _short(row: np.ndarray, gram: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64-bit hash of each text's set."""
    size = np.bincount(row, minlength=texts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(gram + np.uint64(1)), dtype=np.uint64)])
    ends = np.cumsum(size)
    return size, _mixed(sums[ends] - sums[ends - size] + size.astype(np.uint64)).view(np.int64)


def named_sets(texts: DataFrame, n: int, keep: str) -> DataFrame:
    """`keep`, and of each text's set a digest (key), a 64-bit hash (k, which sets of different keys may share) and the size (m); texts without words are left out."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, gram = sets(b.column("words"), n)
            m, k = _short(row, gram, len(b))
            ends = np.cumsum(m)
            key = [hashlib.md5(gram[e - s : e].tobytes()).digest() for s, e in zip(m.tolist(), ends.tolist())]
            out = pa.RecordBatch.from_arrays([b.column(keep), pa.array(key, pa.binary()), pa.array(k), pa.array(m.astype(np.int32))], [keep, "key", "k", "m"])
            yield out.filter(pa.array(m > 0))

    return texts.select(keep, words(F.col("text")).alias("words")).mapInArrow(name, f"{keep} {texts.schema[keep].dataType.simpleString()}, key binary, k long, m int")


def frequencies(texts: list[DataFrame], n: int) -> np.ndarray:
    """How many texts have the shingles of each of the SLOTS, 65,535 at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for b in batches:
            total += np.bincount(_slot(sets(b.column("words"), n)[1]), minlength=SLOTS).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(total, BLOCKS)], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in rows["counts"])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "counts": [zlib.compress(np.minimum(total, 65_535).astype(np.uint16).tobytes())]})

    each = [t.select(words(F.col("text")).alias("words")).mapInArrow(count, "block int, counts binary") for t in texts]
    both = each[0].unionByName(each[1]) if len(each) > 1 else each[0]
    found = {r["block"]: zlib.decompress(r["counts"]) for r in both.groupBy("block").applyInPandas(add, "block int, counts binary").collect()}
    none = bytes(SLOTS // BLOCKS * 2)
    return np.frombuffer(b"".join(found.get(i, none) for i in range(BLOCKS)), np.uint16)


def prefixes(texts: DataFrame, n: int, threshold: float, times, part: int, parts: int) -> DataFrame:
    """gram, k, m, rest: of each set of m shingles, those of its first m - ceil(threshold * m) + 1 by how often they occur that belong to this part of all shingles; rest counts a shingle and those after it.

    `times` is a broadcast of `frequencies`.  A shingle of one text brings nothing together, but takes its place.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = times.value
        for b in batches:
            row, gram = sets(b.column("words"), n)
            m, k = _short(row, gram, len(b))
            seen = often[_slot(gram)]
            order = np.lexsort((gram, seen, row))
            row, gram, seen = row[order], gram[order], seen[order]
            place = np.arange(len(row)) - (np.cumsum(m) - m)[row]
            taken = m - np.ceil(m * threshold - 1e-9) + 1
            kept = (place < taken[row]) & (seen > 1) & (gram % np.uint64(parts) == part)
            row, gram, place = row[kept], gram[kept], place[kept]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(k[row]), *[pa.array(x.astype(np.int32)) for x in (m[row], m[row] - place)]], ["gram", "k", "m", "rest"])

    return texts.select(words(F.col("text")).alias("words")).mapInArrow(cut, "gram long, k long, m int, rest int")


#: Bits of a signature: four to eight for each shingle of the set, a power of two of these at least and at most.
LEAST_BITS, MOST_BITS = 64, 8192


def signatures(texts: DataFrame, n: int) -> DataFrame:
    """k, m, bits: for each slot, whether an odd number of the set's shingles fall into it."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, gram = sets(b.column("words"), n)
            m, k = _short(row, gram, len(b))
            bits = np.clip(2 ** np.ceil(np.log2(np.maximum(4 * m, 1))), LEAST_BITS, MOST_BITS).astype(np.int64)
            ends = np.cumsum(bits // 8)
            place, times = np.unique((ends - bits // 8)[row] * 8 + (gram.view(np.int64) & (bits[row] - 1)), return_counts=True)
            place = place[times % 2 == 1]
            out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
            np.bitwise_or.at(out, place // 8, (1 << (place % 8)).astype(np.uint8))
            column = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m.astype(np.int32)), column], ["k", "m", "bits"]).filter(pa.array(m > 0))

    return texts.select(words(F.col("text")).alias("words")).mapInArrow(sign, "k long, m int, bits binary")


def _bits(column: pa.BinaryArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def perhaps(pairs: DataFrame, threshold: float) -> DataFrame:
    """left_k, right_k of pairs (with left_m, left_bits and the like) that may reach `threshold`: slots of different parity are shingles that the two do not share, one each at least."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l, r = _bits(b.column("left_bits")), _bits(b.column("right_bits"))
            size = np.array([(len(x), len(y)) for x, y in zip(l, r)]).reshape(-1, 2)
            apart = np.zeros(len(b), np.int64)
            for x, y in {tuple(s) for s in size.tolist()}:
                some = np.flatnonzero((size[:, 0] == x) & (size[:, 1] == y))
                # The longer one folds to the shorter: its slots are those modulo fewer bits.
                fold = [np.bitwise_xor.reduce(np.stack([side[i] for i in some]).reshape(len(some), -1, min(x, y)), axis=1) for side in (l, r)]
                apart[some] = np.bitwise_count(fold[0] ^ fold[1]).sum(axis=1, dtype=np.int64)
            both = sum(b.column(c).to_numpy().astype(np.int64) for c in ("left_m", "right_m"))
            kept = apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-6
            yield pa.RecordBatch.from_arrays([b.column("left_k"), b.column("right_k")], ["left_k", "right_k"]).filter(pa.array(kept))

    return pairs.select("left_k", "right_k", "left_m", "right_m", "left_bits", "right_bits").mapInArrow(judge, "left_k long, right_k long")


def compared(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """left_key, right_key, shared, similarity of pairs of texts (left_text, right_text) whose Jaccard reaches `threshold`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (rl, gl), (rr, gr) = sets(b.column("left_words"), n), sets(b.column("right_words"), n)
            row, gram = np.concatenate([rl, rr]), np.concatenate([gl, gr])
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            shared = np.bincount(row[1:][(row[1:] == row[:-1]) & (gram[1:] == gram[:-1])], minlength=len(b))
            every = np.bincount(row, minlength=len(b)) - shared
            share = shared / np.maximum(every, 1)
            out = pa.RecordBatch.from_arrays([b.column("left_key"), b.column("right_key"), pa.array(shared.astype(np.int64)), pa.array(share)], ["left_key", "right_key", "shared", "similarity"])
            yield out.filter(pa.array(share >= threshold))

    sides = [words(F.col(f"{s}_text")).alias(f"{s}_words") for s in ("left", "right")]
    return pairs.select("left_key", "right_key", *sides).mapInArrow(compare, "left_key binary, right_key binary, shared long, similarity double")


#: Inside `thrifty`: the files of a job's shuffles go when it ends, and batches of texts to Python are small.
THRIFTY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8000000"}


@contextmanager
def thrifty(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in THRIFTY}
    for name, value in THRIFTY.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(df: DataFrame) -> DataFrame:
    """The rows read back from the folder that the cluster shares (spark.checkpoint.dir; a temporary one in local mode where it is unset)."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clauselake-"))
        shared = spark.sparkContext.getCheckpointDir()
    path = f"{shared}/clauselake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote; nothing may read them any more."""
    for df in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
