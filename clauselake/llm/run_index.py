"""A run-length index of a bounded set of byte blocks, with numpy.

What is kept of the blocks' Burrows-Wheeler transform is its runs: the symbol of each, how often it stands there, the
text positions of its first and last row, and the length of the match across each border between two runs.  Inside a
run a match only loses its first byte from one text position to the next, so streaming over the text from sampled end
to sampled end gives, at each position, the length of its longest match elsewhere: its matching statistic.

A block that occurs several times is sorted once.  Its copies would stand right beside it in every row and lengthen
runs; only the rows of the blocks' beginnings, before which nothing stands, would be runs of their own, with a match
of the whole block across their border.  Lengths and samples say just that.
"""

from __future__ import annotations

import numpy as np

from .anchors import Powers
from .shingles import mix

#: Symbols in a 63-bit word: 9 bits each, 0 closes a block.
PACKED = 7


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the `depth` symbols that begin there, by prefix doubling; only what is still tied is sorted again."""
    n = len(text)
    padded = np.append(text, np.zeros(PACKED, np.uint16)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(PACKED):
        key = key << np.uint64(9) | padded[j : n + j]
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[n] = -1
    width = PACKED
    while width < depth:
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        at = order[tied]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(at + width, n)] + 1).astype(np.uint64)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[tied] = at
        differs = np.append(True, key[1:] != key[:-1])
        new[tied] = differs | new[tied]
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        width *= 2
    return order


class RunIndex:
    """`blocks` differ from each other; `times` says how often each occurs."""

    def __init__(self, blocks: list[bytes], times: np.ndarray):
        sizes = np.array([len(b) for b in blocks], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(b"\0".join(blocks) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
        self.ends = self.first + sizes
        raw[self.ends] = 0
        self.n = len(raw)
        order = suffix_order(raw, int(sizes.max()) + 1)
        before = raw[order - 1].astype(np.int64)  # the transform
        starts = np.zeros(self.n, bool)
        starts[self.first] = True
        before[starts[order]] = -1 - np.arange(int(starts.sum()))  # nothing stands before a block: a run of its own
        head = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        tail = np.append(head[1:], self.n) - 1
        self.symbol = before[head]
        self.length = np.add.reduceat(np.repeat(times, sizes + 1)[order], head)
        self.head, self.tail = order[head], order[tail]
        self._hash(raw)
        self.border = self._match(self.tail[:-1], self.head[1:])
        # The beginnings of blocks that occur again.
        self.again = self.first[times > 1], sizes[times > 1]

    def _hash(self, raw: np.ndarray) -> None:
        self.up, self.down = Powers().upto(self.n + 1)
        self.prefix = np.append(np.uint64(0), np.cumsum(mix(raw.astype(np.uint64) + np.uint64(7)) * self.up[: self.n]))
        self.rest = self.ends[np.searchsorted(self.ends, np.arange(self.n))] - np.arange(self.n)

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at a and b inside their blocks, by bisection on hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.rest[a], self.rest[b])
        while (open_ := np.flatnonzero(low < high)).size:
            x, y, mid = a[open_], b[open_], (low[open_] + high[open_] + 1) // 2
            same = (self.prefix[x + mid] - self.prefix[x]) * self.down[x] == (self.prefix[y + mid] - self.prefix[y]) * self.down[y]
            low[open_], high[open_] = np.where(same, mid, low[open_]), np.where(same, high[open_], mid - 1)
        return low

    def statistics(self) -> np.ndarray:
        """At each position, the length of its longest match that starts anywhere else."""
        reach = np.zeros(self.n, np.int64)
        at = np.concatenate([self.head[1:], self.tail[:-1], self.again[0]])
        np.maximum.at(reach, at, at + np.concatenate([self.border, self.border, self.again[1]]))
        return np.maximum.accumulate(reach) - np.arange(self.n)

    def long_matches(self, length: int) -> list[np.ndarray]:
        """For each block, where matches of `length` or more start in it."""
        found = np.flatnonzero(self.statistics() >= length)
        cuts = np.searchsorted(np.searchsorted(self.ends, found), np.arange(len(self.first) + 1))
        return [found[x:y] - f for x, y, f in zip(cuts, cuts[1:], self.first, strict=False)]
