"""Text columns: keys, words, shingles, likeness, quotes, money and legal cues.

All are built-in expressions.  Lengths count code points.  A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for likeness.
STOP = tuple(
    "the and for you your are not may any all can will with that this from our its has have been was were shall such than then them they their these those which who whom whose into upon under over about out but nor yet per via use used using".split()
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_key(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of `n` words of the normal key; all words as one where there are fewer; none without words."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return let(split_words(normal_key(text)), of)


def significant_words(text: Column) -> Column:
    """Distinct lower-case words of three letters or more that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP)))


def longest_words(words: Column, most: int = 12) -> Column:
    """The longest words, those of equal length in their order."""
    keyed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["w"])


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 where either side is empty or null."""
    ratio = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), ratio), F.lit(0.0))


def tidy(text: Column) -> Column:
    """One blank for runs of blanks, two line ends at most."""
    out = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), "[ \\t\\r\\f\\x0B]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def canonical(text: Column) -> Column:
    """For quotes: zero-width characters gone, straight quotes, single blanks, lower case."""
    out = F.regexp_replace(text, "[​-‏⁠﻿]", "")
    out = F.translate(out, "‘’“”", "''\"\"")
    return F.lower(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))


def is_verbatim(quote: Column, source: Column) -> Column:
    """Whether a quote of eight characters or more is in the source, both canonical."""
    q = canonical(quote)
    return F.coalesce((F.length(q) >= 8) & F.contains(canonical(source), q), F.lit(False))


def wrap_untrusted(text: Column, tag: str = "untrusted_document") -> Column:
    """The text between tags; tags of that name inside lose their force."""
    inner = F.replace(text, F.lit(f"</{tag}>"), F.lit(f"<\\/{tag}>"))
    inner = F.replace(inner, F.lit(f"<{tag}>"), F.lit(f"<\\{tag}>"))
    return F.concat(F.lit(f"<{tag}>\n"), inner, F.lit(f"\n</{tag}>"))


def cut(text: Column, most: int = 120_000) -> Column:
    """text and truncated: what fits, and whether anything was left out."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))


def excerpt(text: Column, most: int) -> Column:
    """At most `most` characters, cut at a blank in the last two fifths where there is one, and marked."""
    head = F.substring(text, 1, most)
    blank = F.length(head) - F.instr(F.reverse(head), " ")
    at = F.when((F.instr(head, " ") > 0) & (blank >= most * 0.6), blank).otherwise(F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), at.cast("int"))), F.lit("…")))


def windows(text: Column, most: int = 600) -> Column:
    """Pieces of at most `most` characters that end at white space or the end."""
    return F.regexp_extract_all(text, F.lit(rf".{{1,{most}}}(\s|$)"), F.lit(0))


def head_and_middle(text: Column, most: int = 1200) -> Column:
    """The first `most` characters, and those from the middle on."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.array(F.substring(text, 1, most), F.substring(text, half + 1, F.lit(most)))


#: Fee clauses, in the order they are tried.
MONEY = (
    (
        "cancellation_fee",
        (
            r"\b(?:early\s+)?(?:termination|cancell?ation)\s+(?:fee|charge|penalt(?:y|ies))",
            r"\b(?:fee|charge|penalt(?:y|ies))\s+(?:for|on|upon|if you)\s+(?:early\s+)?(?:cancell?(?:ing|ation)?|terminat(?:ing|ion)|ending)",
            r"\b(?:pay|owe)\b[^.]{0,80}\b(?:remaining|rest of|balance of)\b[^.]{0,60}\b(?:contract|commitment|term|subscription|plan)\b",
            r"\bliquidated\s+damages\b",
            r"\brestocking\s+fee",
        ),
    ),
    (
        "auto_renewal",
        (
            r"\bauto-?\s?renew\w*",
            r"\brenew(?:s|ed)?\s+automatically",
            r"\bautomatic(?:ally)?\s+renew\w*",
            r"\bautomatic\s+renewal",
            r"\b(?:recurring|ongoing)\s+(?:billing|charges?|payments?|fees?)",
            r"\bcontinue\s+(?:until|unless)\s+you\s+cancel",
            r"\buntil\s+you\s+cancel",
        ),
    ),
    (
        "no_refund",
        (
            r"\bnon[-\s]?refundable",
            r"\bno\s+refunds?\b",
            r"\b(?:will|shall|do|does)\s+not\s+(?:provide|issue|give|offer|grant)\s+(?:any\s+)?(?:refunds?|credits?)",
            r"\bnot\s+(?:be\s+)?refund(?:able|ed)",
            r"\b(?:all\s+)?(?:sales|fees|payments|purchases|charges)\s+are\s+final",
            r"\bno\s+(?:partial\s+)?(?:refund|credit)\s+(?:will|shall)\s+be",
            r"\bnot\s+(?:required|obliged|obligated)\s+to\s+(?:give\s+|issue\s+)?refund",
            r"\bnot\s+entitle\s+you\s+to\s+(?:a\s+)?refund",
        ),
    ),
    (
        "price_change",
        (
            r"\b(?:change|increase|raise|modify|adjust|revise|update)\s+(?:our\s+|the\s+|its\s+|your\s+)?(?:prices?|pricing|fees?|rates?|charges?|subscription\s+(?:price|fee)s?)",
            r"\b(?:prices?|pricing|fees?|rates?|charges?)\s+(?:may|can|are\s+subject\s+to|will)\s+(?:change|increase|vary|be\s+(?:changed|increased|adjusted))",
            r"\b(?:price|fee|rate)\s+(?:increases?|changes?|adjustments?)",
        ),
    ),
)

#: What legal documents say; each counts once.
LEGAL_CUES = (
    r"\bagree(?:s|d|ment)?\b",
    r"\bliab(?:le|ility)\b",
    r"\bwarrant(?:y|ies)\b",
    r"\bdisclaim(?:s|er|ed)?\b",
    r"\bgoverned\s+by\b|\bgoverning\s+law\b|\blaws?\s+of\b",
    r"\bjurisdiction\b|\bcourts?\b",
    r"\barbitration\b",
    r"\bterminate\b|\bsuspend\b",
    r"\bintellectual\s+property\b|\bcopyright\b",
    r"\bindemnif(?:y|ication)\b",
    r"\bat\s+(?:our|its|their)\s+(?:sole\s+)?discretion\b",
    r"\bwithout\s+(?:prior\s+)?notice\b",
    r"\bterms\b",
    r"\bprivacy\b|\bpersonal\s+(?:data|information)\b",
    r"\bshall\s+not\b|\bmust\s+not\b|\bmay\s+not\b",
)
LEAST_CUES = 4


def money_kind(sentence: Column) -> Column:
    """The first kind of fee clause that the sentence reads like; null where none."""
    out = F.lit(None).cast("string")
    for kind, patterns in reversed(MONEY):
        out = F.when(sentence.rlike("(?i)" + "|".join(patterns)), kind).otherwise(out)
    return out


def legal_cues(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return sum((text.rlike(f"(?i){c}").cast("int") for c in LEGAL_CUES), F.lit(0))


def looks_legal(text: Column) -> Column:
    return legal_cues(text) >= LEAST_CUES
