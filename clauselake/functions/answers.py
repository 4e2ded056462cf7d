"""Answers of a chat model: the JSON object in them, checked against what was asked for, and quotes against their source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import labels as L
from . import text as T
from .display import without_reasoning
from .text import let

POINT = ("category", "severity", "title", "detail", "quote")
#: How many points, and how long a title, a detail and a quote may be; parts of an answer about a form.
MOST_POINTS, TITLE, DETAIL, QUOTE = 6, 120, 400, 2000
VERDICTS = ("safe", "caution", "danger")
FORM = ("verdict", "confidence", "reasons", "advice", "checklist")
MOST_REASONS, REASON, ADVICE, MOST_CHECKS, CHECK = 5, 300, 400, 5, 200


def is_one_value(json: Column) -> Column:
    """Whether brackets close in order, and the last closes the first: no second value follows, and nothing is cut off.

    Strings are taken out first, so brackets inside them don't count.
    """
    bare = F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.filter(F.split(F.regexp_replace(bare, r"[^{}\[\]\"]", ""), ""), lambda c: c != "")

    def closed(all_: Column) -> Column:
        begun = F.struct(F.lit("").alias("open"), F.lit(True).alias("fine"), F.lit(0).alias("at"))

        def step(a: Column, c: Column) -> Column:
            opens = c.isin("{", "[")
            fits = F.right(a["open"], F.lit(1)) == F.translate(c, "}]", "{[")
            rest = F.substring(a["open"], F.lit(1), F.length(a["open"]) - 1)
            early = (F.length(a["open"]) == 1) & (a["at"] < F.size(all_) - 1)
            return F.struct(F.when(opens, F.concat(a["open"], c)).otherwise(rest).alias("open"), (a["fine"] & (opens | F.coalesce(fits & ~early, F.lit(False)))).alias("fine"), (a["at"] + 1).alias("at"))

        return F.aggregate(all_, begun, step, lambda a: a["fine"] & (a["open"] == "") & (a["at"] > 0))

    return let(brackets, closed)


def object_text(content: Column) -> Column:
    """The JSON object of an answer: what a fence holds, or from the first brace to the last; null where that is no single object."""
    bare = F.btrim(F.regexp_replace(F.regexp_replace(content, r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    cut = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    # A list of objects is a value of its own, but no object.
    listed = bare.startswith("[") & bare.endswith("]") & is_one_value(bare)
    return F.when(~listed, let(cut, lambda c: F.when((c != "") & is_one_value(c), c)))


def _sized(text: Column, most: int) -> Column:
    return F.length(text).between(1, most)


def _keys_are(keys: Column, wanted: tuple[str, ...]) -> Column:
    return (F.size(keys) == len(wanted)) & (F.size(F.array_except(keys, F.array(*[F.lit(w) for w in wanted]))) == 0)


def summary_points(content: Column) -> Column:
    """array<struct<category, severity, title, detail, quote>> of an answer about a document; null where it is not in the form that was asked for.

    One to six points, each with the five keys and no others, a known unfair category and severity, and texts of their
    lengths.  What a model says of its reasoning does not count.
    """

    def checked(json: Column) -> Column:
        def of(points: Column) -> Column:
            def fine(p: Column) -> Column:
                value = lambda k: F.try_element_at(p, F.lit(k))
                texts = _sized(value("title"), TITLE) & _sized(value("detail"), DETAIL) & _sized(value("quote"), QUOTE)
                return F.coalesce(_keys_are(F.map_keys(p), POINT) & value("category").isin(*L.UNFAIR) & value("severity").isin(*L.SEVERITY_POINTS) & texts, F.lit(False))

            shown = F.transform(points, lambda p: F.struct(*[F.try_element_at(p, F.lit(k)).alias(k) for k in POINT]))
            return F.when(F.size(points).between(1, MOST_POINTS) & F.forall(points, fine), shown)

        only = _keys_are(F.json_object_keys(json), ("points",))
        return F.when(F.coalesce(only, F.lit(False)), let(F.from_json(json, "points array<map<string, string>>")["points"], of))

    return let(object_text(without_reasoning(content)), checked)


def finalised(points: Column, passages: Column) -> Column:
    """struct risk_score, points, dropped: the points whose quote stands in one of the passages word for word; null points give null."""
    source = F.array_join(passages, "\n")

    def of(all_: Column, canon: Column) -> Column:
        quoted = lambda p: let(T.canonical(p["quote"]), lambda q: (F.length(q) >= 8) & F.contains(canon, q))

        def scored(kept: Column) -> Column:
            risk = F.least(F.lit(100), F.aggregate(kept, F.lit(0), lambda a, p: a + L.severity_points(p["severity"])))
            return F.struct(risk.alias("risk_score"), kept.alias("points"), (F.size(all_) - F.size(kept)).alias("dropped"))

        return let(F.filter(all_, quoted), scored)

    return F.when(points.isNotNull(), let(T.canonical(source), lambda c: of(points, c)))


def form_assessment(content: Column) -> Column:
    """struct verdict, confidence, reasons, advice, checklist of an answer about a form; null where it is not in the form that was asked for."""
    kind = "verdict string, confidence double, reasons array<string>, advice string, checklist array<string>"

    def checked(json: Column) -> Column:
        def of(x: Column) -> Column:
            each = lambda texts, most, length, least: F.size(texts).between(least, most) & F.forall(texts, lambda t: _sized(t, length))
            fine = x["verdict"].isin(*VERDICTS) & x["confidence"].between(0, 1) & each(x["reasons"], MOST_REASONS, REASON, 1) & _sized(x["advice"], ADVICE) & each(x["checklist"], MOST_CHECKS, CHECK, 0)
            return F.when(F.coalesce(fine, F.lit(False)), x)

        return F.when(F.coalesce(_keys_are(F.json_object_keys(json), FORM), F.lit(False)), let(F.from_json(json, kind), of))

    return let(object_text(without_reasoning(content)), checked)
