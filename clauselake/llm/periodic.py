"""Maximal periodic runs of words, by branching tandem repeats of a suffix tree.

A tandem repeat (a stretch of words twice in a row) is branching if the word after it breaks its period.  In the suffix
tree the two halves of such a repeat start at leaves below one node whose depth is the period, and below different
children of it.  So for each node the leaves of its smaller child are looked through, and for each of them whether the
leaf one period before or after lies in the other: every leaf is looked at a logarithmic number of times at most.  A
branching repeat ends its run; rotated to the left as far as the words agree, it gives the run's start.  Repeats of
several periods together have the same start and end and are merged under the least period.

Texts are independent, so nothing is shuffled.  The tree of many texts is built at once, with numpy: suffixes sorted by
doubling, longest common prefixes from the ranks of the doublings, nodes as splits of intervals of the suffix array.
Before, stretches that can't be in a run are left out: a run of w words or more holds, everywhere, (w + 1) / 2 words in
a row that occur twice in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .shingles import ODD, mix

#: Bytes of texts whose tree is built at once (a longer text alone); leaves looked at together.
CHUNK, LEAVES = 2_000_000, 1_000_000
#: Rounds of leaving out; more would only leave out more.
ROUNDS = 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Stretches:
    """Parts of texts that may hold runs, one after the other: tokens, the number of the part, and the place in the texts."""

    def __init__(self, tokens: np.ndarray, part: np.ndarray, place: np.ndarray):
        self.tokens, self.part, self.place = tokens, part, place

    def narrowed(self, least: int) -> Stretches:
        gram, n = (least + 1) // 2, len(self.tokens)
        at = np.flatnonzero(self.part[: max(0, n - gram + 1)] == self.part[gram - 1 :]) if n >= gram else np.zeros(0, np.int64)
        key = mix(self.part[at].astype(np.uint64) + ODD)
        for j in range(gram):
            key = mix(key * ODD + self.tokens[at + j].astype(np.uint64))
        by = np.argsort(key)
        same = key[by[1:]] == key[by[:-1]]
        twice = at[by[np.append(same, False) | np.append(False, same)]] if len(at) else at
        cover = np.bincount(twice, minlength=n + 1)[: n + 1] - np.bincount(twice + gram, minlength=n + 1)[: n + 1]
        kept = np.flatnonzero(np.cumsum(cover[:n]) > 0)
        new = np.append(True, (np.diff(kept) > 1) | (np.diff(self.part[kept]) > 0))[: len(kept)]
        part = np.cumsum(new) - 1
        long = (np.bincount(part, minlength=1) >= least)[part] if len(part) else np.zeros(0, bool)
        kept = kept[long]
        part = np.unique(part[long], return_inverse=True)[1]
        return Stretches(self.tokens[kept], part, self.place[kept])


class SuffixTree:
    """Suffixes of the parts, sorted; a suffix ends with its part, and suffixes of different parts share nothing."""

    def __init__(self, tokens: np.ndarray, part: np.ndarray):
        n = self.n = len(tokens)
        self.begin = np.searchsorted(part, part)
        end = np.searchsorted(part, part, "right")
        #: Of each doubling, the rank of the stretch of that many words at each place: equal ranks, equal stretches.
        self.levels: list[np.ndarray] = []
        key = part.astype(np.int64) * (int(tokens.max()) + 1) + tokens
        rank, active = self._ranked(np.zeros(n, np.int64), np.arange(n), key)
        h = 1
        while True:
            self.levels.append(rank.astype(np.int32))
            if not len(active):
                break
            after = active + h
            second = np.where(after < end[active], rank[np.minimum(after, n - 1)] + 1, 0)
            rank, active = self._ranked(rank, active, second)
            h *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.shared = self._shared(self.order[:-1], self.order[1:])

    @staticmethod
    def _ranked(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that share a rank are told apart by key; a rank is the number of suffixes before its first.  Also those that still share one."""
        by = np.lexsort((key, rank[active]))
        active, key = active[by], key[by]
        old = rank[active]
        first = np.append(True, old[1:] != old[:-1])
        new = first | np.append(True, key[1:] != key[:-1])
        at = np.arange(len(active))
        group, own = np.maximum.accumulate(np.where(first, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[active] = old + own - group
        alone = new & np.append(new[1:], True)
        return rank, active[~alone]

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, place by place."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            x, y = a + out, b + out
            inside = np.maximum(x, y) < self.n
            same = inside & (self.levels[level][np.minimum(x, self.n - 1)] == self.levels[level][np.minimum(y, self.n - 1)])
            out[same] += 1 << level
        return out

    def shared_before(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before `at` equal those a period later, in a row."""
        out = np.zeros(len(at), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            x = at - out - (1 << level)
            inside = x >= self.begin[at]
            x = np.maximum(x, 0)
            same = inside & (self.levels[level][x] == self.levels[level][np.minimum(x + period, self.n - 1)])
            out[same] += 1 << level
        return out

    def splits(self) -> tuple[np.ndarray, ...]:
        """depth, left, at, right: leaves left .. at - 1 and at .. right, by rank, lie below a node of that depth and on two sides of it."""
        depth = np.append(-1, self.shared)
        n = len(depth)
        least = [depth]
        while 2 << (len(least) - 1) <= n:
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        at = np.flatnonzero(depth > 0)
        d = depth[at]
        left, right = at - 1, at.copy()
        for level in range(len(least) - 1, -1, -1):
            h, low = 1 << level, least[level]
            # left: depths from left + 1 to at - 1 are d or more; right: those from at + 1 to right are more than d.
            from_ = left - h + 1
            ok = (from_ >= 0) & (low[np.clip(from_, 0, len(low) - 1)] >= d)
            left[ok] -= h
            from_ = right + 1
            ok = (from_ + h <= n) & (low[np.clip(from_, 0, len(low) - 1)] > d)
            right[ok] += h
        return d, left, at, right

    def branching(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of all branching tandem repeats, of one period or several."""
        depth, left, at, right = self.splits()
        small_left = at - left <= right - at + 1
        size = np.where(small_left, at - left, right - at + 1)
        first, low, high = np.where(small_left, left, at), np.where(small_left, at, left), np.where(small_left, right, at - 1)
        ends = np.cumsum(size)
        starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cut = 0
        while cut < len(size):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + LEAVES, "right")))
            some = slice(cut, stop)
            node = np.repeat(np.arange(cut, stop), size[some])
            leaf = self.order[first[node] + np.arange(len(node)) - np.repeat(ends[some] - size[some] - (ends[cut] - size[cut]), size[some])]
            d = depth[node]
            for other, start in ((leaf + d, leaf), (leaf - d, leaf - d)):
                inside = (other >= 0) & (other < self.n)
                rank = self.rank[np.clip(other, 0, self.n - 1)]
                found = inside & (rank >= low[node]) & (rank <= high[node])
                starts.append(start[found])
                periods.append(d[found])
            cut = stop
        return np.concatenate(starts), np.concatenate(periods)


def maximal_runs(tokens: np.ndarray, text: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (place in `tokens`), length and period of the maximal runs of `least` words and two periods or more, by start, then period.

    `text` numbers the text of each token, ascending; runs lie in one text.
    """
    s = Stretches(tokens, text, np.arange(len(tokens)))
    for _ in range(ROUNDS):
        before, s = len(s.tokens), s.narrowed(least)
        if len(s.tokens) in (0, before):
            break
    if not len(s.tokens):
        none = np.zeros(0, np.int64)
        return none, none, none
    tree = SuffixTree(s.tokens, s.part)
    start, period = tree.branching()
    end = start + 2 * period
    start = start - tree.shared_before(start, period)
    keep = end - start >= least
    start, end, period = start[keep], end[keep], period[keep]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return s.place[start[by]], (end - start)[by], period[by]


def _chunks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _found(texts: Sequence[bytes], least: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[bytes]]:
    """Of each text: number of words, runs, and the words left of it."""
    words = [t.split() for t in texts]  # bytes: at ASCII white space alone
    count = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(count) - count
    flat = pa.array(chain.from_iterable(words), pa.large_binary(), size=int(count.sum()))
    tokens = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), count)
    start, length, period = maximal_runs(tokens, text, least)
    cover = np.bincount(start + period, minlength=len(tokens) + 1) - np.bincount(start + length, minlength=len(tokens) + 1) if len(start) else None
    keep = np.cumsum(cover[:-1]) <= 0 if cover is not None else None
    at = np.searchsorted(text[start], np.arange(len(texts) + 1)) if len(start) else np.zeros(len(texts) + 1, np.int64)
    runs, left = [], []
    for i, w in enumerate(words):
        some = slice(at[i], at[i + 1])
        runs.append((start[some] - first[i], length[some], period[some]))
        left.append(b" ".join(w if at[i] == at[i + 1] else compress(w, keep[first[i] : first[i] + count[i]])))
    return count, runs, left


def with_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", least: int = 12) -> DataFrame:
    """The `keep` columns of each row with n_words, runs (start, length, period; by start, then period) and collapsed, the text without what repeats.

    Words are runs of anything but ASCII white space, numbered from 0.  A run is a stretch of `least` words and two of its
    smallest periods, or more, that no neighbouring word extends.  collapsed holds the words that no run has after its
    first period, joined by one space.  A null or empty text has no words, no runs and an empty collapsed; bytes that
    are no UTF-8 are words like others.  Repeated rows get theirs each, columns outside `keep` don't matter, an empty
    table gives an empty one.  Memory follows the longest text, some 200 bytes a word of those parts that may hold runs.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in keep]).alias("_row"), docs[text_col].cast("string").cast("binary").alias("_text"))
    row = rows.schema["_row"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for first, stop in _chunks(texts):
                count, runs, left = _found(texts[first:stop], least)
                at = pa.array(np.append(0, np.cumsum([len(r[0]) for r in runs])), pa.int32())
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([r[i] for r in runs]), pa.int64()) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, stop - first), pa.array(count), pa.ListArray.from_arrays(at, flat), pa.array(left, pa.binary())], names=["_row", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    found = rows.mapInArrow(of, f"_row {row}, n_words long, runs {RUNS}, collapsed binary")
    return found.select("_row.*", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
