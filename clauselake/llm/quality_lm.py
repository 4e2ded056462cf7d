"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The symbols are UTF-8 bytes, so nothing is out of vocabulary and an n-gram of up to seven is an exact integer key.
Counts come from all trusted documents but for a fold of them, which sets the thresholds; lower orders count distinct
left neighbours.  Documents that a task reads in a row form a chunk, which is written compressed to a bucketed table.
A chunk asks for its distinct n-grams only; these are joined shard by shard with the counts of each order, and the
answers go to the bucket where the chunk lies, where its documents are scored.  Texts are not shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles as S
from .common import arrow_bytes, bucketed, discard, durable, scratch

ORDER = 5
#: Bytes of a chunk, but for one long text.
CHUNK_BYTES = 16_000_000
#: Bytes sent to Python at once.
BATCH_BYTES = 8_000_000
#: One in FOLDS trusted documents is kept from training, and sets the thresholds: this share of them stays.
FOLDS, QUANTILE = 5, 0.99
#: What stands before a text.
START = 10


def _grams(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each byte of texts side by side; START bytes stand before each text."""
    sizes = np.diff(at)
    padded = np.full(len(data) + (n - 1) * len(sizes), START, np.uint8)
    place = np.arange(len(data)) + np.repeat((np.arange(len(sizes)) + 1) * (n - 1), sizes)
    padded[place] = data
    key = np.zeros(len(data), np.int64)
    for j in range(n):
        key = key << 8 | padded[place - (n - 1 - j)]
    return key


def _counted(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, by pieces that fit a cache."""
    parts = [np.unique(_grams(data, at, n), return_counts=True) for _, data, at in S.chunks(texts)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, counts, len(u)).astype(np.int64)


#: What a chunk asks and says: its n-grams ascending, how often each occurs in its trusted documents, and its rows as an Arrow stream.
PACKED = "chunk long, grams binary, counts binary, rows binary"


def _packed(docs: DataFrame, n: int) -> DataFrame:
    """`docs` (text and trusted among its columns) in chunks of a task's rows in a row."""
    text_at, trusted_at = docs.columns.index("text"), docs.columns.index("trusted")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            asked = []
            for b in held:
                good = b.column(trusted_at).fill_null(False)
                for wanted, times in ((good, 1), (pc.invert(good), 0)):
                    u, k = _counted(b.column(text_at).filter(wanted), n)
                    asked.append((u, k * times))
            u, k = _summed(np.concatenate([x for x, _ in asked]), np.concatenate([x for _, x in asked]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            gaps = zstandard.compress(np.diff(u, prepend=0).tobytes(), 1), zstandard.compress(k.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), *[pa.array([x], pa.binary()) for x in gaps], pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "grams", "counts", "rows"])
            held.clear()

        for b in batches:
            for part in _cut(b, text_at):
                if held and sum(x.nbytes for x in held) + part.nbytes > CHUNK_BYTES:
                    yield from flush()
                held.append(part)
        if held:
            yield from flush()

    return docs.mapInArrow(of, PACKED)


def _cut(b: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of CHUNK_BYTES of text or little more, or of a single longer text; each owns its bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < b.num_rows:
        done = size[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(size, done + CHUNK_BYTES, "right")))
        yield b.take(pa.array(range(row, end), pa.int64())) if end - row < b.num_rows else b
        row = end


def _asked(packed: DataFrame) -> DataFrame:
    """chunk, gram, n of each n-gram that a chunk asks for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, grams, counts in zip(*[c.to_pylist() for c in b.columns]):
                u = np.cumsum(np.frombuffer(zstandard.decompress(grams), np.int64))
                k = np.frombuffer(zstandard.decompress(counts), np.int64)
                for i in range(0, len(u), 200_000):
                    part = u[i : i + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(k[i : i + len(part)])], names=["chunk", "gram", "n"])

    return packed.select("chunk", "grams", "counts").mapInArrow(rows, "chunk long, gram long, n long")


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers of n-grams that have 1 to 4."""
    n = [0, *(int(x or 0) for x in table.agg(*[F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]).first())]
    if not (n[1] and n[2]):
        return 0.5, 0.5, 0.5
    y = n[1] / (n[1] + 2 * n[2])
    d = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * 0.5, 0.05), i - 0.05) for i in (1, 2, 3)]
    return d[0], d[1], d[2]


def _log_p(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """gram, logp of each distinct wanted n-gram: `counts` (gram, n) joined order by order, from one byte upwards."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        # Distinct left neighbours: one row of the higher order each.
        tables[k] = durable(tables[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    p = wanted.select("gram").withColumn("p", F.lit(1 / 256))
    for k in range(1, order + 1):
        one, two, more = _discounts(tables[k])
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        known = tables[k].select(F.col("gram").alias("_t"), F.col("n").alias("_n"))
        context = tables[k].groupBy(F.shiftrightunsigned("gram", 8).alias("_c")).agg(
            F.sum("n").alias("_sum"),
            (one * F.sum((F.col("n") == 1).cast("long")) + two * F.sum((F.col("n") == 2).cast("long")) + more * F.sum((F.col("n") > 2).cast("long"))).alias("_free"),
        )
        # Few keys for very many rows, and 256 ** k at most: 65,536 rows are broadcast, so that none is a hot key.
        known, context = F.broadcast(known) if k <= 2 else known, F.broadcast(context) if k <= 3 else context
        off = F.when(F.col("_n") == 1, one).when(F.col("_n") == 2, two).otherwise(more)
        p = p.withColumn("_k", tail).join(known, F.col("_k") == F.col("_t"), "left").drop("_t")
        p = p.withColumn("_k", F.shiftrightunsigned("_k", 8)).join(context, F.col("_k") == F.col("_c"), "left").drop("_c")
        seen = F.coalesce((F.col("_n") - off) / F.col("_sum"), F.lit(0.0))
        p = p.select("gram", F.when(F.col("_sum").isNull(), F.col("p")).otherwise(seen + F.col("_free") / F.col("_sum") * F.col("p")).alias("p"))
    return p.select("gram", F.log("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, trusted: Column, order: int = ORDER) -> DataFrame:
    """`docs` (text and others) with perplexity: exp of the mean negative log-probability per byte; null without text.

    `trusted` marks the rows that the model is trained on, all of them; a null there is false.  Rows may repeat, and
    no column but text has a meaning; one must not be named perplexity.
    """
    if "perplexity" in docs.columns:
        raise ValueError("docs already has a column perplexity")
    spark, columns = docs.sparkSession, docs.columns
    text = F.col("text").cast("string")
    shown = docs.select(F.coalesce(trusted, F.lit(False)).alias("trusted"), text.alias("text"), *[docs[c].alias(f"_{c}") for c in columns if c != "text"])
    # A bucketed table: answers come to where their chunk lies, and texts move no more.
    with arrow_bytes(spark, BATCH_BYTES):
        packed = bucketed(_packed(shown, order), "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = _asked(packed)
    counts = durable(asked.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")))
    with scratch(spark) as keep:
        logp = keep(durable(_log_p(asked.select("gram").distinct(), counts, order)))
    discard(counts)
    answers = asked.select("chunk", "gram").join(logp, "gram").select("chunk", "gram", "logp")

    def answer(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        known, logp = answers["gram"].to_numpy(), answers["logp"].to_numpy().astype(np.float64)
        by = known.argsort()
        known, logp, parts = known[by], logp[by], []
        for stream in chunk["rows"].to_pylist():
            for b in pa.ipc.open_stream(stream):
                out = np.full(b.num_rows, np.nan)
                for row, data, at in S.chunks(b.column("text")):
                    sums = np.append(0.0, np.cumsum(logp[np.searchsorted(known, _grams(data, at, order))]))
                    size = np.diff(at)
                    out[row : row + len(size)] = np.where(size > 0, np.exp(-(sums[at[1:]] - sums[at[:-1]]) / np.maximum(size, 1)), np.nan)
                kept = [b.column(i) for i in range(2, b.num_columns)]
                parts.append(pa.Table.from_arrays([*kept, pa.array(out, from_pandas=True)], names=[*b.schema.names[2:], "perplexity"]))
        return pa.concat_tables(parts)

    schema = T.StructType([*shown.drop("trusted", "text").schema.fields, T.StructField("perplexity", T.DoubleType())])
    scored = packed.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answer, schema)
    return scored.select(*[F.col(f"_{c}").alias(c) for c in columns if c != "text"], "perplexity")


#: Labels up to this many rows of two small columns are sent to every task; beyond that, they are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def judged(docs: DataFrame, trusted: Column, order: int = ORDER, quantile: float = QUANTILE, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of each row of `docs` (doc_id, lang, text).

    `trusted` is a column of `docs`, or of `labels` (one row per doc_id) where these are given.

    A language's threshold is the `quantile` of perplexity of the trusted documents that were kept from training (by
    a hash of the text, so that copies stay together); without any, or with a null language, that of all languages;
    without those, none, and all stay.  A null or empty text has no
    perplexity and isn't kept.  Repeated rows are each judged; an empty table gives an empty one.
    """
    good = F.coalesce(trusted, F.lit(False)).alias("good")
    if labels is None:
        marked = docs.select("doc_id", "lang", "text", good)
    else:
        marks = labels.select("doc_id", good)
        marks = F.broadcast(marks) if labels.count() <= BROADCAST_LABELS else marks
        marked = docs.select("doc_id", "lang", "text").join(marks, "doc_id", "left").select("doc_id", "lang", "text", F.coalesce("good", F.lit(False)).alias("good"))
    marked = marked.withColumn("out", F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0)
    scored = perplexities(marked, F.col("good") & ~F.col("out"), order)
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        rows = durable(scored)
    good = rows.where("good and out and perplexity is not null")
    level = F.percentile_approx("perplexity", quantile, 10_000)
    every = good.agg(level).first()[0]
    limits = good.where("lang is not null").groupBy("lang").agg(level.alias("threshold"))
    out = rows.join(limits, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(every).cast("double")))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull() & F.col("threshold").isNull())
    return out.select("doc_id", "lang", "perplexity", "threshold", kept.cast("int").alias("kept"))
