"""Suffix-array dedup: bytes covered by a long string that starts anywhere else in the corpus are removed.

Equal windows name equal anchors (see `anchors`), so the corpus falls into groups by anchor that can be judged apart.
In a group, equal blocks (all bytes of a run of windows that name one anchor) are counted with map-side sums; one of
each, with its count, goes to a shard of bounded size.  Each shard gets a run-length index (see `run_index`), whose
matching statistics mark long matches; these go back to every run with that block.  The blocks of an anchor with more
than a shard may hold are split by further context: windows are told apart by where the anchor lies in them and by the
bytes that all windows with such a place have in common, in halving ranges of places, until every group fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import shingles as S
from .common import discard, durable
from .run_index import RunIndex

#: Bytes of the k-grams among which windows choose; bytes of a shard, on average; different blocks that a group may have in a shard.
GRAM, SHARD_BYTES, GROUP_BLOCKS = 100, 1_000_000, 1024


def _runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = A.Powers()
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for row, data, at in S.chunks(b.column(1)):
                r = A.runs(data, at, powers, length, k)
                base = at[r.doc]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[row + r.doc], r.gram.view(np.int64), r.block.view(np.int64), (r.start - base).astype(np.int32), (r.end - base).astype(np.int32))], names=["key", "gram", "block", "first", "last"])

    return docs.select("key", "text").mapInArrow(scan, "key long, gram long, block long, first int, last int")


def _blocks(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, block, n, hot, bytes: the text of wanted runs (key, runs: array of gram, block, n, hot, first, last)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, runs in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                for r in runs:
                    for column, value in zip(out, (r["gram"], r["block"], r["n"], r["hot"], text[r["first"] : r["last"] + length])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["gram", "block", "n", "hot", "bytes"])

    return docs.join(wanted, "key").select("text", "runs").mapInArrow(cut, "gram long, block long, n long, hot boolean, bytes binary")


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive window starts: first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [(int(a), int(z)) for a, z in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)])]


MATCHES = "gram long, block long, first int, last int"


def _indexed(blocks: DataFrame, length: int) -> DataFrame:
    """gram, block, first, last: runs of window starts in each block (gram, block, n, bytes; no two alike) that match elsewhere."""
    shards = max(1, (blocks.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) // SHARD_BYTES)

    def search(g: pd.DataFrame) -> pd.DataFrame:
        # The order of rows in a group is not fixed, and does not matter: each block is judged against all others.
        found = RunIndex(g["bytes"].tolist(), g["n"].to_numpy(np.int64)).long_matches(length)
        rows = [(gram, block, *s) for gram, block, at in zip(g["gram"], g["block"], found) for s in _spans(at)]
        return pd.DataFrame(rows, columns=["gram", "block", "first", "last"])

    dealt = blocks.select("gram", "block", "n", "bytes").withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, MATCHES)


def _split(blocks: DataFrame, width: int, length: int, k: int) -> DataFrame:
    """Parts of blocks by where the anchor lies in their windows, in ranges of `width` places.

    `gram` and `block` of a part stand for what its windows have in common and for all its bytes; `of_gram` and
    `of_block` name the block that it is part of, and `at` the window where it begins there.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = A.Powers()
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for gram, block, n, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
                data = np.frombuffer(text, np.uint8)
                anchor = int(A.runs(data, np.array([0, len(data)]), powers, length, k).anchor[0])
                up, down = powers.upto(len(data) + 1)
                prefix = np.append(np.uint64(0), np.cumsum(S.BYTE_VALUE[data] * up[: len(data)]))
                last = len(data) - length
                place = np.arange((anchor - last) // width, anchor // width + 1)  # of the anchor in a window, by ranges
                start, end = np.maximum(0, anchor - (place + 1) * width + 1), np.minimum(last, anchor - place * width)
                common = anchor - place * width, anchor - (place + 1) * width + 1 + length
                hashes = lambda x, y: (prefix[y] - prefix[x]) * down[x]
                own = S.mix(hashes(*common) + S.mix(place.astype(np.uint64) + np.uint64(1)) * S.ODD)
                whole = S.mix(hashes(start, end + length) + S.mix((anchor - start).astype(np.uint64) << np.uint64(20) ^ (end - start).astype(np.uint64)))
                for i in range(len(place)):
                    for column, value in zip(out, (gram, block, int(start[i]), own.view(np.int64)[i], whole.view(np.int64)[i], n, text[start[i] : end[i] + length])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["of_gram", "of_block", "at", "gram", "block", "n", "bytes"])

    return blocks.select("gram", "block", "n", "bytes").mapInArrow(cut, "of_gram long, of_block long, at int, gram long, block long, n long, bytes binary")


def _marked(counts: DataFrame) -> DataFrame:
    """Of `counts` (gram, block, n and others) those whose group holds more than one, with hot: whether it has too many blocks for a shard."""
    groups = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("total")).where("total > 1")
    return counts.join(groups, "gram").withColumn("hot", F.col("blocks") > GROUP_BLOCKS).drop("blocks", "total")


def _matches(blocks: DataFrame, width: int, length: int, k: int) -> DataFrame:
    """gram, block, first, last as `_indexed` gives them, of `blocks` (gram, block, n, hot, bytes); hot groups are split by `width` and less."""
    found = _indexed(blocks.where("not hot"), length)
    hot = blocks.where("hot")
    if hot.isEmpty():
        return found
    parts = durable(_split(hot, width, length, k))
    counts = parts.groupBy("gram", "block").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
    # At a width of one, a group is a single window: the last round.
    inner = _matches(durable(_marked(counts)), max(1, width // 2), length, k)
    back = parts.drop("n", "bytes").join(inner, ["gram", "block"])
    return found.unionByName(back.select(F.col("of_gram").alias("gram"), F.col("of_block").alias("block"), (F.col("first") + F.col("at")).alias("first"), (F.col("last") + F.col("at")).alias("last")))


def repeated_windows(docs: DataFrame, length: int = 400, k: int = GRAM) -> DataFrame:
    """key, spans (array of first, last): window starts of each `docs` row (key, text: binary) whose `length` bytes start anywhere else too."""
    runs = durable(_runs(docs, length, k))
    counts = durable(runs.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last")).alias("one")))
    one_each = durable(_marked(counts).groupBy("one.key").agg(F.collect_list(F.struct("gram", "block", "n", "hot", "one.first", "one.last")).alias("runs")))
    discard(counts)
    blocks = durable(_blocks(docs, one_each, length))
    discard(one_each)
    found = durable(_matches(blocks, max(1, (length - k + 1) // 2), length, k))
    discard(blocks)
    spans = runs.withColumnRenamed("first", "start").drop("last").join(found, ["gram", "block"])
    return durable(spans.groupBy("key").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))).alias("spans")))


def dedup(docs: DataFrame, length: int = 400, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (array of start, end in bytes), kept (binary): texts as UTF-8 without the bytes covered by a `length`-byte string that also starts anywhere else.

    Matches never cross documents; overlaps in one document count; strings are judged on the input.  A null or empty
    text has nothing to remove; a text shorter than `length` is kept; repeated rows remove each other's bytes; ids may
    be null or repeated; other columns don't matter; an empty table gives an empty one.
    """
    if not 0 < k <= length:
        raise ValueError("k must be between 1 and length")
    docs = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found = repeated_windows(docs, length, k)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                runs: list[dict] = []
                for first, last in sorted((x["first"], x["last"]) for x in spans or []):
                    if runs and first <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], last + length)
                    else:
                        runs.append({"start": first, "end": last + length})
                kept = b"".join(text[a:z] for a, z in zip([0, *(r["end"] for r in runs)], [*(r["start"] for r in runs), len(text)]))
                for column, value in zip(out, (len(text), len(text) - len(kept), len(runs), runs, kept)):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(out, types)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(found, "key", "left").select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, removed array<struct<start: int, end: int>>, kept binary")
