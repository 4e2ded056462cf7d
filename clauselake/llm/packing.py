"""Packing token sequences by the length histogram: shortest pack first.

Documents are tokenised once, in Arrow batches, and cut every `size` ids.  The histogram of piece lengths (at most
`size` rows, whatever the corpus) is all that planning sees: lengths are placed longest first, always into the packs
with most room, as counts of packing patterns.  Pieces then find their place by their rank within their length; the
rank comes from counts of hash buckets, so that a common length is never sorted in one task.
"""

from __future__ import annotations

import os
import re
import string
import sys
import types
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bytes, buckets_for, durable, range_bucket

SIZE = 2048
#: Words of a generation whose ids a worker remembers; of the generation before, those that come again are taken over,
#: and the rest is forgotten.  Texts whose words it learns at once.
CACHED_WORDS, TOGETHER = 240_000, 256
#: Text bytes that go to a worker at once.
BATCH_BYTES = 8_000_000
#: What a tokenizer is tried on: words of several scripts, marks, digits and symbols, with white space between and punctuation after them.
PROBES = ("the", "Words", "McDonald", "don't", "x", "ABC123", "12,5", "3.14", "e-mail", "a/b", "(see", "end)", "https://a.net/b?c=d", "über", "éa", "naïve", "Ωμέγα", "привет", "漢字かな", "한국어", "ไทย", "हिन्दी", "🙂", "👩‍👩‍👧", "e\u0301", "_", "##", "$5", "--", "…", "\u200b", "\xa0", "<s>", "[UNK]", "\\n", "'s", "n't", "I'll", "\ufffd")
SPACES = (" ", "\n", "  ", "\t", "\r\n", " \n\n", "\x0b", "\x0c")
#: Marks that may close a word: ASCII punctuation but for the apostrophe, which "'s" and the like begin with.  Letters that they may close.
ENDS, LETTERS = string.punctuation.replace("'", ""), string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
LATIN, LOWER = (re.compile(f"[{x}]+").fullmatch for x in (LETTERS, "".join(c for c in LETTERS if c.islower())))
BUCKET_ROWS = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Where white space never joins two tokens, words are encoded, and remembered, one by one; new words go to the
    tokenizer in one call, joined by blanks, and token offsets tell them apart.  Where closing ASCII punctuation after
    a Latin letter is never part of the letters' tokens, and where case is folded, such words share what is known.
    Where the last token of a word says so by its suffix, words of lower-case Latin letters go to the tokenizer's model
    without its normalizer and patterns, and the suffix tells them apart.
    Each of the four is tried on PROBES when the file is read; a tokenizer that fails the first gets whole texts.
    Bytes that are no UTF-8 are read as U+FFFD.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words, self.old = Tokenizer.from_file(path), {}, {}
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        alone = {w: ids(w) for w in PROBES}
        pairs = [(v, space, w) for n, v in enumerate(PROBES) for m, w in enumerate(PROBES) for space in SPACES[(n + m) % len(SPACES) :][:2]]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(re.escape(t.encode().lower()) for t in added) or rb"(?!)").search
        self.by_word = all(ids(v + space + w) == alone[v] + alone[w] for v, space, w in pairs) and ids(" \n\t ") == [] and not any(t.isalpha() or t.split() != [t] for t in added)
        plain = [w for w in PROBES if w[-1] in LETTERS]
        lone = {end: ids(end) for end in (*ENDS, "...", "?!", ",.", ",***", "&&&", ".)", "!--")}
        self.ends_apart = all(ids(w + end) == alone[w] + lone[end] for w in plain for end in lone) and all(ids(c + end) == ids(c) + lone[end] for c in LETTERS for end in lone)
        self.folds = all(ids(v) == alone[w] for w in PROBES if w.isascii() for v in (w.lower(), w.upper(), w.title())) and all(ids(v) == ids(v.lower()) for c in LETTERS for v in (c, f"A{c}b"))
        self.lean, suffix = Tokenizer(self.tokenizer.model), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        lower = [w for w in (*(p.lower() for p in PROBES), *(v for c in LETTERS for d in "aeé" for v in (c, c + d, d + c, f"th{c}{d}ntion"))) if LOWER(w)]
        if not all((few := self.lean.encode(w, add_special_tokens=False).ids) == ids(w) and self.last[few].tolist() == [False] * (len(few) - 1) + [True] for w in lower):
            self.lean = None

    @classmethod
    def of_worker(cls, path: str) -> WordTokens:
        """One for all tasks of a Python worker."""
        kept = sys.modules.setdefault("_clauselake_worker", types.ModuleType("_clauselake_worker")).__dict__
        if ("tokens", path) not in kept:
            kept["tokens", path] = cls(path)
        return kept["tokens", path]

    def encode(self, parts: list[bytes]) -> None:
        both: tuple[list, list] = ([], [])
        for p in parts:
            text = p.decode(errors="replace")
            both[self.lean is not None and LOWER(text) is not None].append((p, text))
        for plain, group in enumerate(both):
            for i in range(0, len(group), 4096):
                keys, texts = zip(*group[i : i + 4096], strict=True)
                if plain:
                    ids = np.array(self.lean.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
                    cuts = np.append(0, np.flatnonzero(self.last[ids]) + 1)
                else:
                    e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
                    ids, at = np.array(e.ids, "<u4"), np.array([x for x, _ in e.offsets], np.int64)
                    cuts = np.searchsorted(at, np.cumsum([0] + [len(t) + 1 for t in texts]))
                data, cuts = ids.tobytes(), (cuts * 4).tolist()
                self.words.update((k, data[x:y]) for k, x, y in zip(keys, cuts[:-1], cuts[1:], strict=True))

    def unknown(self, words: Iterable[bytes]) -> list[bytes]:
        """Those not in `words`, after what the generation before knows has been taken from there."""
        known, old = self.words, self.old
        out = []
        for w in words:
            if w not in known:
                ids = old.get(w)
                if ids is None:
                    out.append(w)
                else:
                    known[w] = ids
        return out

    def parts(self, word: bytes) -> tuple[bytes, bytes]:
        """What of a word is encoded, and the marks that close it; a word with an added token in it, in whatever case, is left as it is."""
        if not word.isalpha() and self.added(word.lower()):
            return word, b""
        core = word.rstrip(ENDS.encode()) if self.ends_apart else word
        if not core[-1:].isalpha() and (core.isascii() or core.decode(errors="replace")[-1:] not in LETTERS):
            core = word
        tail = word[len(core) :]
        if self.folds:
            core = core.lower() if core.isascii() or not LATIN(text := core.decode(errors="replace")) else text.lower().encode()
        return core, tail

    def learn(self, words: list[bytes]) -> None:
        """Makes these words known."""
        if len(self.words) > CACHED_WORDS:
            self.old, self.words = self.words, {}
        self.words[b""] = b""
        new = self.unknown(words)
        parts = list(map(self.parts, new))
        self.encode(self.unknown({x for both in parts for x in both}))
        ids = self.words
        ids.update(zip(new, [ids[core] + ids[tail] if tail else ids[core] for core, tail in parts], strict=True))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings), and where each text begins among them, with the end of the last."""
        if not self.by_word:
            each = [np.array(self.tokenizer.encode((t or b"").decode(errors="replace"), add_special_tokens=False).ids, "<u4") for t in texts.cast(pa.large_binary()).to_pylist()]
            return np.concatenate(each or [np.zeros(0, "<u4")]), np.cumsum([0] + [len(x) for x in each])
        words = pc.ascii_split_whitespace(texts.fill_null(""))  # at the same characters as bytes.split
        first = words.offsets.to_numpy()
        coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        ids = list(map(self.words.__getitem__, distinct))
        size = np.array([len(x) for x in ids], np.int64) // 4
        word = coded.indices.to_numpy()
        n = size[word]
        end = np.cumsum(n)
        # The ids of the word that a place belongs to begin `shift` before it.
        shift = (np.cumsum(size) - size)[word] - (end - n)
        every = np.frombuffer(b"".join(ids), "<u4")
        return every[np.arange(n.sum()) + np.repeat(shift, n)], np.append(0, end)[first - first[0]]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; a null text is empty and has just the end id; bytes that are no UTF-8 are read as U+FFFD."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of_worker(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                out: list[list] = [[], [], [], [], []]
                some = batch.slice(at, TOGETHER)
                flat, first = tokens.texts(some.column(1))
                data, first = flat.tobytes(), (first * 4).tolist()
                for doc, x, y in zip(some.column(0).to_pylist(), first[:-1], first[1:], strict=True):
                    ids = data[x:y] + end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how many sequences follow each.  Longest lengths first, each into the packs with most room; where none has room, new packs are stacked with as many as fit."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    most = 0  # no pack has more room
    done: list[tuple[tuple[int, ...], int]] = []

    def put(left: int, count: int, pattern: tuple[int, ...]) -> None:
        nonlocal most
        if left == 0:
            done.append((pattern, count))
        elif count:
            room.setdefault(left, []).append((count, pattern))
            most = max(most, left)

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            while most and not room.get(most):
                most -= 1
            if most < length:
                fit = size // length
                if count >= fit:
                    put(size - fit * length, count // fit, (length,) * fit)
                if count % fit:
                    put(size - count % fit * length, 1, (length,) * (count % fit))
                count = 0
            else:
                left = most
                packs, pattern = room[left].pop()
                n = min(packs, count)
                if packs > n:
                    put(left, packs - n, pattern)
                put(left - length, n, (*pattern, length))
                count -= n
    return done + [(p, c) for packs in room.values() for c, p in packs]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int, list[int]]]]:
    """For each length, in rank order: (first rank, ranks, slots in a sequence, first sequence, offsets of the slots)."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        at: dict[int, list[int]] = {}
        offset = 0
        for length in pattern:
            at.setdefault(length, []).append(offset)
            offset += length
        for length, offsets in at.items():
            first = ranks.get(length, 0)
            out.setdefault(length, []).append((first, count * len(offsets), len(offsets), sequence, offsets))
            ranks[length] = first + count * len(offsets)
        sequence += count
    return out


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """`cut` (with doc_id, start, length from 1 to `size`) with sequence_id and offset.

    The driver sees the histogram of lengths alone: `size` rows at most.  Repeated pieces each get a place; an empty
    table gives an empty one; a null doc_id is an id like others.
    """
    spark = cut.sparkSession
    with arrow_bytes(spark, BATCH_BYTES):
        cut = durable(cut)
    rows = cut.count()
    key = F.xxhash64("doc_id", "start", "ids_crc32") if "ids_crc32" in cut.columns else F.xxhash64("doc_id", "start")
    dealt = cut.withColumn("_key", key).withColumn("_bucket", range_bucket(F.col("_key"), buckets_for(rows, BUCKET_ROWS)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = spark.createDataFrame(
        [(length, [tuple(x) for x in xs]) for length, xs in slots(plan(histogram, size)).items()],
        "length long, _slots array<struct<first: long, ranks: long, each: long, sequence: long, offsets: array<long>>>",
    )
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("_key", "doc_id", "start")
    ranked = dealt.join(firsts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    # `places` has one row per length: at most `size` rows, so it may be broadcast.
    placed = ranked.join(F.broadcast(places), "length")
    placed = placed.withColumn("_slot", F.filter("_slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["first"] + s["ranks"]))[0])
    at = F.col("_rank") - F.col("_slot.first")
    return placed.select(
        *cut.columns,
        (F.col("_slot.sequence") + F.floor(at / F.col("_slot.each"))).cast("long").alias("sequence_id"),
        F.element_at("_slot.offsets", (at % F.col("_slot.each") + 1).cast("int")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """One row per piece of a document, with its sequence and its offset there; see `pieces` and `pack`."""
    return pack(pieces(docs, tokenizer_path, size, end_id), size)
