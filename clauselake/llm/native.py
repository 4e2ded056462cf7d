"""Array idioms for operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: the optimizer would copy a column's expression into each lambda call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def total(values: Column, zero: Column | None = None) -> Column:
    return F.aggregate(values, F.lit(0).cast("long") if zero is None else zero, lambda a, x: a + x)


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array<int>, by blocks of about sqrt(n): no step copies the whole array."""

    def by_block(v: Column, step: Column) -> Column:
        starts = F.transform(indices(F.ceil(F.size(v) / step)), lambda b: total(F.slice(v, b * step + 1, step).cast("array<long>")))
        firsts = let(starts, lambda s: F.transform(indices(F.size(s)), lambda b: total(F.slice(s, F.lit(1), b))))
        return let(firsts, lambda f: F.transform(indices(F.size(v)), lambda i: F.get(f, F.floor(i / step).cast("int")) + total(F.slice(v, F.floor(i / step).cast("int") * step + 1, i % step + 1).cast("array<long>"))))

    return let(values, lambda v: let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int"), lambda step: by_block(v, step)))
