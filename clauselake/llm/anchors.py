"""Anchors of byte texts, with numpy: every window of `length` bytes names the least k-gram inside it, so equal windows name equal anchors at equal offsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shingles import BYTE_VALUE, mix

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, BASE)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, INVERSE)))
        return self.up, self.down


@dataclass
class Runs:
    """Runs of windows that name the same anchor, in order: `start` to `end` (inclusive) are window starts."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray  # position of the anchor
    gram: np.ndarray  # hash of the anchor
    block: np.ndarray  # hash of all bytes of the run's windows, with the anchor's place in them


def runs(data: np.ndarray, at: np.ndarray, powers: Powers, length: int, k: int) -> Runs:
    """Of texts side by side in `data`; no window crosses from one text to the next."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    up, down = powers.upto(n + 1)
    prefix = np.append(np.uint64(0), np.cumsum(BYTE_VALUE[data] * up[:n]))
    grams = mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])
    # The upper half of the hash above the position: the least is the leftmost least.
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width, step = length - k + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows inside one text only.
    sizes = np.diff(at)
    fits = np.flatnonzero(sizes >= length)
    if not len(fits):
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    inside = np.zeros(len(place) + 1, np.int64)
    np.add.at(inside, at[fits], 1)
    np.add.at(inside, at[fits] + sizes[fits] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    same = place[1:] == place[:-1]
    new[1:] &= ~(same & inside[:-1])
    new[at[fits]] = True
    start = np.flatnonzero(new)
    last = inside & np.append(new[1:] | ~inside[1:], True)
    end = np.flatnonzero(last)
    anchor = place[start]
    block = mix((prefix[end + length] - prefix[start]) * down[start] + mix((anchor - start).astype(np.uint64) << np.uint64(20) ^ (end - start).astype(np.uint64)))
    return Runs(np.searchsorted(at, start, "right") - 1, start, end, anchor, grams[anchor], block)
