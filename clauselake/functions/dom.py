"""Elements of a page as columns over what `html.walk` gives.

Elements come in document order and know the last element inside them, so whatever lies in an element is a range of
numbers, and what it says is the texts under that range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of a page's scripts and texts.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def attr(element: Column, name: str) -> Column:
    """Empty where it is missing."""
    return F.coalesce(F.try_element_at(element["attrs"], F.lit(name)), F.lit(""))


def has(element: Column, name: str) -> Column:
    return F.map_contains_key(element["attrs"], name)


def lies_in(element: Column, other: Column) -> Column:
    return (element["id"] > other["id"]) & (element["id"] <= other["last"])


def elements(page: Column, keep: Callable[[Column], Column]) -> Column:
    return F.filter(page["elements"], keep)


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def raw_text(page: Column, element: Column) -> Column:
    """All text inside an element."""
    own = F.filter(page["texts"], lambda t: (t["under"] >= element["id"]) & (t["under"] <= element["last"]))
    return F.array_join(F.transform(own, lambda t: t["text"]), "")


def text(page: Column, element: Column) -> Column:
    """The same with its white space as single blanks; empty for a null element."""
    return F.coalesce(trimmed(F.regexp_replace(raw_text(page, element), SPACE, " ")), F.lit(""))


def title(page: Column) -> Column:
    return text(page, first(elements(page, lambda e: e["tag"] == "title")))
