"""MD5 digests of short texts made of numbers, for whole arrays at a time."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TENS = 10 ** np.arange(1, 19, dtype=np.int64)


def _block(words: list, n: int) -> np.ndarray:
    """The first 60 bits of the digests of one block of 16 words; a word that all `n` share is a number, else an array."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f = np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + words[g]) % 2**32)
        turn = _SHIFTS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=a)
        f >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap().astype(np.uint64) >> np.uint64(4))


def _sized(seed: int, numbers: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """As `leading`, where all numbers of an array have as many digits as `sizes` says."""
    words: list = [0] * 16
    at = 0

    def put(value, place: int) -> None:
        w, up = divmod(place, 4)
        words[w] = words[w] + (value << np.uint32(8 * up) if isinstance(value, np.ndarray) else np.uint32(value << 8 * up))

    for byte in str(seed).encode():
        put(byte, at)
        at += 1
    for values, size in zip(numbers, sizes):
        put(ord(":"), at)
        if values[0] == values[-1] and (values == values[0]).all():
            for k, byte in enumerate(str(values[0]).encode()):
                put(byte, at + 1 + k)
        else:
            rest = values.astype(np.uint32 if size <= 9 else np.uint64)
            for k in range(size, 0, -1):
                tens = rest // 10
                put((rest - tens * 10).astype(np.uint32) + np.uint32(ord("0")), at + k)
                rest = tens
        at += 1 + size
    put(0x80, at)
    if at > 55:
        raise ValueError("the text of a digest has 55 characters at most")
    words[14] = 8 * at
    return _block([w if isinstance(w, np.ndarray) else int(w) for w in words], len(numbers[0]))


def leading(seed: int, *numbers: np.ndarray) -> np.ndarray:
    """The first 60 bits of md5("seed:a:b...") for each a, b of the arrays `numbers` (equally long, none negative)."""
    sizes = [np.searchsorted(_TENS, x, side="right") + 1 for x in numbers]
    code = sum(s * 32**i for i, s in enumerate(sizes))
    out = np.empty(len(code), np.uint64)
    for one in np.unique(code).tolist():
        some = code == one
        out[some] = _sized(seed, [x[some] for x in numbers], [one // 32**i % 32 for i in range(len(numbers))])
    return out
