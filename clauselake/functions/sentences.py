"""Documents to sentences, and sentences to the tokenised form of the training corpus, as chains of column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, money_kind

# White space, tokens that end in a full stop without ending a sentence, closers, and what begins a sentence.
SPACE = r"[\s   -     　﻿]"
ABBREVIATIONS = (
    "inc", "ltd", "llc", "llp", "co", "corp", "plc", "gmbh", "e.g", "i.e", "etc", "vs", "v", "no", "nos", "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr",
    "u.s", "u.k", "u.s.a", "a.m", "p.m", "sec", "secs", "art", "para", "approx", "cf", "ca", "fig", "al", "ed", "eds", "ph.d", "b.v", "s.a", "n.v", "l.l.c", "est",
)
CLOSERS = r"""["')\]”’]"""
OPENS = r"""(?=["'(“‘\[]?[A-Z0-9•\-–—])"""

#: Stands between sentences while they are told apart.
MARK = "\u0001"
_WORD = "(?<![A-Za-z.])(?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + "|[a-z])"
#: Punctuation with closers always ends a sentence; without them, a full stop after an abbreviation or initial does not.
_ENDS = rf"([.!?]+{CLOSERS}+|(?<![.!?])(?:[!?]|(?<!{_WORD})\.)[.!?]*) +{OPENS}"


def split_sentences(block: Column) -> Column:
    """Sentences of a text whose white space is single spaces.  The number of a heading stays with what it heads."""
    marked = F.regexp_replace(block, _ENDS, f"$1{MARK}")
    marked = F.regexp_replace(marked, rf"(^|{MARK})(\d+(?:\.\d+)*\.){MARK}", "$1$2 ")
    return F.filter(F.transform(F.split(marked, MARK), lambda s: F.btrim(s)), lambda s: s != "")


def cap_length(sentence: Column, most: int = 1200) -> Column:
    """Parts of at most `most` characters, cut after the last space in the second half where there is one."""
    half = most // 2 + 1
    parts = F.regexp_extract_all(sentence, F.lit(rf"(?s) *(.{{1,{most}}}$|.{{{half},{most - 1}}} |.{{{most}}})"), F.lit(1))
    return F.when(F.length(sentence) <= most, F.array(sentence)).otherwise(F.transform(parts, lambda s: F.btrim(s)))


def sentences(text: Column, min_chars: int = 25, min_words: int = 5, most: int = 1200) -> Column:
    """Sentences of a whole document in reading order; fragments below either least size are left out.  Null: none."""
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), lambda b: F.btrim(F.regexp_replace(b, SPACE + "+", " ")))
    found = F.flatten(F.transform(F.flatten(F.transform(blocks, lambda b: split_sentences(b))), lambda s: cap_length(s, most)))
    return F.filter(found, lambda s: (F.length(s) >= min_chars) & (F.size(F.split(s, " ")) >= min_words))


def with_previous(sentences_: Column) -> Column:
    """array<struct<index, sentence, prev>>: each sentence with the one before it, empty for the first."""
    return let(sentences_, lambda a: F.transform(a, lambda s, i: F.struct(i.alias("index"), s.alias("sentence"), F.coalesce(F.get(a, i - 1), F.lit("")).alias("prev"))))


#: Sizes of the sentences among which fee clauses are looked for, and how many and how long they may be.
FEE_CHARS, FEE_WORDS, FEE_CLAUSES, FEE_LENGTH = 10, 2, 200, 2000


def fee_clauses(text: Column, min_chars: int = 25, min_words: int = 5) -> Column:
    """array<struct<index, text, kind>>: sentences of a document that speak of fees, the first FEE_CLAUSES.

    They are looked for among shorter sentences, too, but are numbered as the longer ones (min_chars, min_words) are: a
    short one takes the number of the next longer one, or of the last.
    """
    reads = lambda s: (F.length(s) >= min_chars) & (F.size(F.split(s, " ")) >= min_words)

    def of(every: Column) -> Column:
        def clause(s: Column, i: Column, last: Column) -> Column:
            number = F.size(F.filter(F.slice(every, F.lit(1), i), reads))
            found = lambda kind: F.when(kind.isNotNull(), F.struct(F.least(number, last).alias("index"), F.substring(s, 1, FEE_LENGTH).alias("text"), kind.alias("kind")))
            return let(money_kind(s), found)

        last = F.greatest(F.size(F.filter(every, reads)) - 1, F.lit(0))
        return let(last, lambda n: F.slice(F.array_compact(F.transform(every, lambda s, i: clause(s, i, n))), 1, FEE_CLAUSES))

    return let(sentences(text, FEE_CHARS, FEE_WORDS), of)


# Addresses, and the tokeniser's rules in order.
ADDRESS = r"""(?:https?://|www\.)[^\s<>"']+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+"""
RULES = (
    (r'^"', "``"),
    (r"(``)", " $1 "),
    (r"""([ (\[{<])("|'{2})""", "$1 `` "),
    (r"([:,])([^\d])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", " $1 "),
    (r"""([^.])(\.)([\])}>"']*)\s*$""", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"--", " -- "),
    (r"^(.*)$", " $1 "),
    (r"''", " '' "),
    (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(d)('ye)\b", "$1 $2"),
    (r"(?i)\b(gim)(me)\b", "$1 $2"),
    (r"(?i)\b(gon)(na)\b", "$1 $2"),
    (r"(?i)\b(got)(ta)\b", "$1 $2"),
    (r"(?i)\b(lem)(me)\b", "$1 $2"),
    (r"(?i)\b(more)('n)\b", "$1 $2"),
    (r"(?i)\b(wan)(na)(?=\s)", "$1 $2"),
    (r"(?i) ('t)(is)\b", "$1 $2"),
    (r"(?i) ('t)(was)\b", "$1 $2"),
)


def tokenised(text: Column) -> Column:
    for pattern, to in RULES:
        text = F.regexp_replace(text, pattern, to)
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def normalised(sentence: Column) -> Column:
    """A sentence in lower case with its tokens apart; web and mail addresses stay whole, without punctuation at their end."""
    text = F.lower(sentence)
    found = F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), F.lit(1))
    kept = F.transform(found, lambda a: F.regexp_replace(a, r"""[.,;:!?)\]}'"]+$""", ""))
    held = F.zip_with(F.sequence(F.lit(0), F.size(found)), F.split(text, ADDRESS), lambda i, piece: F.concat(
        F.when(i > 0, F.concat(F.lit("zzurl"), (i - 1).cast("string"), F.lit("zz"), F.substr(F.get(found, i - 1), F.length(F.get(kept, i - 1)) + 1))).otherwise(""), F.coalesce(piece, F.lit(""))))
    tokens = tokenised(F.array_join(held, ""))
    back = F.aggregate(F.sequence(F.lit(0), F.size(found)), tokens, lambda t, i: F.when(i < F.size(found), F.replace(t, F.concat(F.lit("zzurl"), i.cast("string"), F.lit("zz")), F.coalesce(F.get(kept, i), F.lit("")))).otherwise(t))
    return back
