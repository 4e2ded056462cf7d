"""Host names as people read them: Punycode, look-alike letters, tokens, edit distance within a budget."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, digits that stand for letters, pairs that read as one letter.
CONFUSABLES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l",
    "ԛ": "q", "ԝ": "w", "ғ": "f", "ь": "b", "ч": "y",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "ι": "i",
    "κ": "k", "μ": "m", "β": "b", "γ": "y", "η": "n",
    "ı": "i", "ł": "l", "đ": "d", "ø": "o", "ɡ": "g", "ɑ": "a", "ѐ": "e", "օ": "o", "ա": "w",
}
DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
LIGATURES = (("rn", "m"), ("vv", "w"), ("cl", "d"))
#: Brand labels that are ordinary words, too.
GENERIC = ("max", "box", "line", "meta", "target", "three", "trip", "wise", "mox", "viu")


def _decomposed(text: Column) -> Column:
    """NFKD without combining marks, which no built-in function gives."""

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn"))

    return F.pandas_udf(of, "string")(text)


def decoded(host: Column) -> Column:
    """A host name with its Punycode labels as Unicode; a malformed label stays as it is."""

    def label(x: str) -> str:
        if not x.lower().startswith("xn--"):
            return x
        try:
            return x[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError):
            return x

    def of(hosts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in hosts:
            yield s.map(lambda h: None if h is None else ".".join(map(label, h.split("."))))

    return F.when(host.rlike(r"(?i)(^|\.)xn--"), F.pandas_udf(of, "string")(host)).otherwise(host)


def _mapped(text: Column, values: dict[str, str]) -> Column:
    return F.translate(text, "".join(values), "".join(values.values()))


def folded(label: Column) -> Column:
    """A form in which labels that look alike are equal; ASCII labels stay with the built-in functions."""
    plain = F.when(label.rlike(r"^[\x00-\x7F]*$"), label).otherwise(_decomposed(label))
    out = _mapped(F.lower(plain), CONFUSABLES)
    for pair, one in LIGATURES:
        out = F.replace(out, F.lit(pair), F.lit(one))
    return _mapped(out, DIGITS)


def tokens(host: Column) -> Column:
    return F.filter(F.split(host, r"[.\-_]"), lambda x: x != "")


def edit_budget(length: Column) -> Column:
    return F.when(length <= 5, 0).when(length <= 8, 1).otherwise(2)


def distance_within(a: Column, b: Column, most: int) -> Column:
    """The edit distance, or most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)
