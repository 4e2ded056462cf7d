"""Word and shingle hashes of whole Arrow batches, with numpy.

Words are runs of anything but ASCII white space, with A-Z lower-cased; a shingle hashes `k` of them in order.  All
hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 500_000
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    hashes: np.ndarray  # of each word
    doc: np.ndarray  # index of its document
    count: np.ndarray  # words of each document
    first: np.ndarray  # index of each document's first word


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows with about CHUNK bytes; a null text is empty."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray) -> Words:
    n = len(at) - 1
    if not len(data):
        zero = np.zeros(n, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), zero, zero)
    inside = WORD_BYTE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    start[firsts] = inside[firsts]  # a word ends where its document does
    starts = np.flatnonzero(start)
    letters = np.flatnonzero(inside)
    place = np.searchsorted(letters, starts)
    length = np.diff(np.append(place, len(letters)))
    within = np.arange(len(letters)) - np.repeat(place, length)
    power = np.cumprod(np.full(int(length.max(initial=0)) + 1, ODD))
    value = BYTE_VALUE[LOWER[data[letters]]] * power[within]
    hashes = mix(np.add.reduceat(value, place) + length.astype(np.uint64)) if len(place) else np.zeros(0, np.uint64)
    doc = np.searchsorted(at, starts, "right") - 1
    count = np.bincount(doc, minlength=n)
    return Words(hashes, doc, count, np.cumsum(count) - count)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of each shingle in order of documents; one of all words where there are fewer than k."""
    n = len(w.hashes)
    at = np.flatnonzero(w.doc[: max(0, n - k + 1)] == w.doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    parts, places = [_run(w.hashes, at, k)], [at]
    for m in range(1, k):
        short = w.first[w.count == m]
        if len(short):
            parts.append(_run(w.hashes, short, m))
            places.append(short)
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    return np.concatenate(parts)[order], w.doc[at[order]], at[order]


def _run(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = mix(out * ODD + hashes[at + j])
    return out


def distinct(h: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Indices of each document's distinct hashes, ascending by key, then hash."""
    order = np.lexsort((h, key, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return order[new]


def needed_overlap(n_a, n_b, percent: int):
    """Least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return (percent * (n_a + n_b) + 99 + percent) // (100 + percent)


def set_of(text: bytes, k: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return np.unique(shingles(words(data, np.array([0, len(data)])), k)[0])
