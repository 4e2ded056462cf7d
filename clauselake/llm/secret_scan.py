"""Secret scans: patterns, and a battery of randomness tests.

Pattern spans come from regular expressions.  Other long tokens are cut at an inner '=' and, for each of three alphabets
(base64, base64url, letters and digits), at the separators foreign to it.  Each piece gets an inferred encoding (the
smallest alphabet that covers it) and, against uniform random symbols of that alphabet, three tests: chi-squared
uniformity, runs above and below the middle, and serial correlation at lag one; the battery's p-value is three times the
least of the three.  Pieces of letters of one case can be plain words, so these have a fourth test, of the share of
letters that are common in words, and four times the least.
Random tokens have p spread evenly over 0 to 1, structured ones have p near 0.  So for each encoding and class of
lengths the counts of p above one half tell how many random tokens there are: an upper bound of that number, DEVIATIONS
standard deviations of a count above it.  The least threshold, P_LEAST or more, is taken whose share of structured
tokens among those that pass may then be below `fdr`.  The bound is wide where a class holds few random tokens, in a
small corpus as in a large one, and close to the estimate where it holds many.  Of nested pieces that pass, the longest counts.  Only DataFrame functions are used, and
no row is shuffled: the counts (a few hundred) are the only thing gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import indices, let, running_sums, total

#: The kinds in their order, their patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: Tokens that are tested: at least TOKEN characters.  P_BINS cells of the p-value; lengths fall in classes by octaves.
TOKEN = 20
TOKENS = "[A-Za-z0-9+/_=-]{%d,}" % TOKEN
P_BINS, FDR = 40, 0.05
#: How far the bound of a count lies above it, in its standard deviations; the least threshold.
DEVIATIONS, P_LEAST = 3.0, 0.05
SPAN = "array<struct<start:int,kind:int,end:int>>"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: About three quarters of the letters of words in the languages at hand.
COMMON = "enirtsaohlc"
#: Name, pattern, alphabet; the first that fits is inferred.
ENCODINGS = (
    ("decimal", "[0-9]+", DIGITS),
    ("hex", "[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdef"),
    ("lower", "[a-z]+", LOWER),
    ("upper", "[A-Z]+", UPPER),
    ("base32", "[A-Z2-7]+=*", UPPER + "234567"),
    ("base36", "[a-z0-9]+|[A-Z0-9]+", DIGITS + LOWER),
    ("base62", "[A-Za-z0-9]+", DIGITS + UPPER + LOWER),
    ("base64", "[A-Za-z0-9+/]+=*", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+=*", UPPER + LOWER + DIGITS + "-_"),
)
CODES = {name: i for i, (name, _, _) in enumerate(ENCODINGS)}
#: Pieces of a token, by alphabet: a run of its symbols, and padding where nothing of the token follows.
PIECES = tuple(f"(?=[{symbols}=]{{{TOKEN}}})[{symbols}]+(?:=+(?![A-Za-z0-9+/_=-]))?" for symbols in ("A-Za-z0-9+/", "A-Za-z0-9_\\-", "A-Za-z0-9"))


def _found(text: Column, pattern: str, kind: int, groups: int, value: int | None, least: int) -> Column:
    """Spans of all leftmost non-overlapping matches whose match (or group `value` of the pattern) has `least` code points."""
    step = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps = F.transform(F.regexp_extract_all(text, step, F.lit(1)), F.length)
    hits = F.transform(F.regexp_extract_all(text, step, F.lit(2)), F.length)
    sized = F.transform(F.regexp_extract_all(text, step, F.lit(2 + value)), F.length) if value else hits

    def spans(gap: Column, hit: Column, size: Column) -> Column:
        ends = running_sums(F.zip_with(gap, hit, lambda a, b: a + b))
        all_ = let(ends, lambda e: F.transform(hit, lambda h, i: F.struct((F.get(e, i) - h).cast("int").alias("start"), F.lit(kind).alias("kind"), F.get(e, i).cast("int").alias("end"), F.get(size, i).alias("size"))))
        return F.transform(F.filter(all_, lambda s: s["size"] >= least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return let(gaps, lambda g: let(hits, lambda h: let(sized, lambda z: spans(g, h, z))))


def _none() -> Column:
    return F.array().cast(SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the patterns by start, then kind.  Each costly extraction runs only where a cheap test of the whole text passes."""
    assign = F.when(text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), _found(text, ASSIGN, 0, 2, 2, LEAST_ASSIGN)).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 1, 0, None, LEAST_ACCESS)).otherwise(_none())
    hexes = F.when(text.rlike("[0-9a-f]{%d}" % LEAST_HEX), _found(text, HEX, 2, 0, None, LEAST_HEX)).otherwise(_none())
    return F.array_sort(F.concat(assign, access, hexes))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))


def encoding(token: Column) -> Column:
    out = F.lit(-1)
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(token.rlike(f"^(?:{pattern})$"), i).otherwise(out)
    return out


def p_value(token: Column, code: Column) -> Column:
    """The battery's p-value under uniform random symbols; 0 where the symbols don't vary."""
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    letters = code.isin(CODES["lower"], CODES["upper"])

    def battery(v: Column, k: Column) -> Column:
        n = F.size(v).cast("double")
        cells = total(F.transform(F.array_distinct(v), lambda x: F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0))), F.lit(0.0))
        df = k - 1
        chi = (F.pow(F.greatest(cells * k / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = total(F.transform(v, lambda x: F.when(x * 2 >= k, 1.0).otherwise(0.0)), F.lit(0.0))
        steps = F.slice(v, F.lit(2), F.size(v) - 1)
        turns = total(F.transform(steps, lambda x, i: F.when((x * 2 >= k) != (F.get(v, i) * 2 >= k), 1.0).otherwise(0.0)), F.lit(0.0))
        both = 2 * high * (n - high)
        runs = F.abs(turns - both / n) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        mean = total(v.cast("array<double>"), F.lit(0.0)) / n
        spread = lambda m: total(F.transform(v, lambda x: (x - m) * (x - m)), F.lit(0.0))
        along = lambda m: total(F.transform(steps, lambda x, i: (x - m) * (F.get(v, i) - m)), F.lit(0.0))
        serial = let(mean, lambda m: F.abs(along(m) / F.greatest(spread(m), F.lit(1e-9)) * F.sqrt(n)))
        common = total(F.transform(v, lambda x: F.when(x.isin(*[LOWER.index(c) for c in COMMON]), 1.0).otherwise(0.0)), F.lit(0.0))
        q = len(COMMON) / 26
        wordy = (common - n * q) / F.sqrt(n * (q * (1 - q)))
        least = F.least(_tail(chi), 2 * _tail(runs), 2 * _tail(serial))
        p = F.when(letters, 4 * F.least(least, _tail(wordy))).otherwise(3 * least)
        return F.when(F.size(F.array_distinct(v)) < 3, 0.0).otherwise(F.least(F.lit(1.0), p))

    def on(alphabet: Column) -> Column:
        plain = F.regexp_replace(token, "=+$", "")
        cased = F.when(code.isin(CODES["hex"], CODES["base36"]), F.lower(plain)).otherwise(plain)
        symbols = F.transform(F.filter(F.split(cased, ""), lambda c: c != ""), lambda c: F.position(c, alphabet) - 1)
        return let(symbols, lambda v: battery(v, F.length(alphabet).cast("double")))

    return F.when(code < 0, 0.0).otherwise(let(F.get(alphabets, code), on))


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n / TOKEN) * 2), F.lit(12)).cast("int")


def _candidates(text: Column) -> Column:
    """Long pieces of long tokens, each once: start, end, code, class, p."""
    spans = F.when(text.rlike(TOKENS), F.array_distinct(F.concat(*[_found(text, p, 3, 0, None, TOKEN) for p in PIECES]))).otherwise(_none())
    tokens = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token")))
    coded = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), encoding(t["token"]).alias("code")))
    return F.transform(
        coded,
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["code"].alias("code"), length_class(t["end"] - t["start"]).alias("len"), p_value(t["token"], t["code"]).alias("p")),
    )


def above(x: float, tests: int = 3) -> float:
    """Share of random tokens whose p is above x: of three even p-values, three times the least is (of four, four times)."""
    return (1 - x / tests) ** tests


def at_most(count: int) -> float:
    """Upper bound of the mean of a Poisson count."""
    return count + DEVIATIONS**2 / 2 + DEVIATIONS * (count + DEVIATIONS**2 / 4) ** 0.5


def thresholds(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[tuple[int, int], float]:
    """Least p that passes, for each encoding and length class; counts over all documents, at most 9 x 13 x P_BINS rows."""
    text = F.coalesce(docs[text_col], F.lit(""))
    tokens = docs.select(text.alias("_text")).where(F.col("_text").rlike(TOKENS)).select(F.explode(_candidates(F.col("_text"))).alias("t")).where("t.code >= 0")
    cell = F.least(F.floor(F.col("t.p") * P_BINS), F.lit(P_BINS - 1)).cast("int")
    counts: dict[tuple[int, int], list[int]] = {}
    for r in tokens.groupBy("t.code", "t.len", cell.alias("cell")).count().collect():
        counts.setdefault((r["code"], r["len"]), [0] * P_BINS)[r["cell"]] = r["count"]
    out = {}
    for key, cells in counts.items():
        tests = 4 if key[0] in (CODES["lower"], CODES["upper"]) else 3
        random = at_most(sum(cells[P_BINS // 2 :])) / above(0.5, tests)
        for i in range(round(P_LEAST * P_BINS), P_BINS // 2 + 1):
            passing = sum(cells[i:])
            expected = random * above(i / P_BINS, tests)
            if passing and 1 - expected / passing <= fdr:
                out[key] = i / P_BINS
                break
    return out


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """The `keep` columns with `spans`: array of (start, kind, end) by start, then kind; code points, end exclusive; kind indexes KINDS.

    Pattern spans always stay; a random token is added where it overlaps none of them and lies in no longer one.  A null text is empty and has
    no spans; an empty table gives an empty one; repeated rows each get theirs.
    """
    passing = thresholds(docs, text_col, fdr)
    least = F.create_map(*[x for (code, n), p in sorted(passing.items()) for x in (F.lit(100 * code + n), F.lit(p))]) if passing else None
    text = F.coalesce(docs[text_col], F.lit(""))

    def added(base: Column, t: Column) -> Column:
        passes = lambda c: F.coalesce(c["p"] >= F.try_element_at(least, 100 * c["code"] + c["len"]), F.lit(False))
        clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        inside = lambda c, d: (d["start"] <= c["start"]) & (c["end"] <= d["end"]) & (d["end"] - d["start"] > c["end"] - c["start"])
        found = let(F.filter(_candidates(t), lambda c: passes(c) & clear(c)), lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda d: inside(c, d))))
        return F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))

    spans = let(base_spans(text), lambda b: F.array_sort(F.concat(b, added(b, text)))) if least is not None else base_spans(text)
    return docs.select(*[docs[c] for c in keep], spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by one mask."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))


def redacted_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` with its secrets masked: no document goes, and texts without secrets stay as they are."""
    rows = scan(docs.select(F.struct(*docs.columns).alias("_doc"), docs["text"]), keep=("_doc",), **options)
    text = redact(F.col("_doc.text"), F.col("spans"))
    new = {"text": text, "n_chars": F.when(F.size("spans") == 0, F.col("_doc.n_chars")).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
