"""Arrays of class scores: softmax, decisions, prompts; perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..labels import CATEGORIES, OTHER
from .text import let


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Shifted by the largest score; null for null or empty arrays."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(logits, lambda x: x.cast("double") / t)
    powers = lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    share = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda s: F.transform(e, lambda x: x / s))
    return let(let(scaled, powers), lambda e: F.when(F.size(e) > 0, share(e)))


def argmax(values: Column) -> Column:
    """Position from 0 of the first largest."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def decide(probs: Column, threshold: float | Column | None = None) -> Column:
    """The class index: the likeliest; with a threshold `other` from there on, else the likeliest of the others."""
    if threshold is None:
        return argmax(probs)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rest = lambda ps: F.transform(ps, lambda p, i: F.when(i == OTHER, F.lit(float("-inf"))).otherwise(p))
    return let(probs, lambda ps: F.when(F.element_at(ps, OTHER + 1) >= t, OTHER).otherwise(argmax(rest(ps))))


def category(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CATEGORIES]), index)


def with_bias(logits: Column, bias: float | Column) -> Column:
    """The score of `other` shifted."""
    return F.transform(logits, lambda z, i: F.when(i == OTHER, z.cast("double") + bias).otherwise(z.cast("double")))


def normalised(probs: Column) -> Column:
    return let(probs, lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y)))


def imputed(scores: Column) -> Column:
    """Missing scores as one below the least seen; -21 where none was."""
    floor = F.coalesce(F.array_min(scores) - 1, F.lit(-21.0))
    return let(floor, lambda f: F.transform(scores, lambda x: F.coalesce(x, f)))


def letter_prompt(passage: Column) -> Column:
    options = "\n".join(f"{'ABCDEFGHI'[i]}) {name.replace('_', ' ')}" for i, name in enumerate(CATEGORIES))
    return F.concat(F.lit(f"Classify this terms-of-service passage.\n{options}\n\nPassage: "), F.regexp_replace(passage, r"(?U)^\s+|\s+$", ""), F.lit("\nAnswer:"))


def hash_bits(hex16: Column) -> Column:
    """64 bits of 16 hex digits; null for anything else."""
    return F.when(hex16.rlike("^[0-9a-fA-F]{16}$"), F.conv(hex16, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes; null where either is none."""
    return F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))


def difference_hash(gray: Column) -> Column:
    """16 hex digits of 9 x 8 brightnesses by rows: a bit is set where a pixel is darker than the one to its right."""
    at = lambda r, c: F.get(gray, r * 9 + c)
    nibble = lambda i: sum((F.when(at(F.floor(i / 2).cast("int"), i % 2 * 4 + j) < at(F.floor(i / 2).cast("int"), i % 2 * 4 + j + 1), 8 >> j).otherwise(0) for j in range(4)), F.lit(0))
    return F.when(F.size(gray) == 72, F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.hex(nibble(i).cast("bigint"))), "")))


def low_contrast(gray: Column, least: int = 32) -> Column:
    return F.array_max(gray) - F.array_min(gray) < least
