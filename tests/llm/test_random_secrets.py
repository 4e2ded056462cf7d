"""Random spans of the secret scan: env-style, URL, digit and lone random secrets, and plain words beside them."""

import random
import string

from clauselake.llm import secret_scan

HEX, LOWER, UPPER, DIGITS = "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.digits
B62 = LOWER + UPPER + DIGITS
PLAIN = (
    "Donaudampfschifffahrtsgesellschaft", "rechtsschutzversicherungsgesellschaften", "-" * 40, "=" * 40, "a" * 30, "0" * 30, "enkeitlichenzuversch", "erbeeinscherungtzung", "12345678901234567890",
    "internationalization_and_localization_settings", "https://www.example.com/category/subcategory/product-overview", "getElementsByTagNameNS", "MAXIMUM_NUMBER_OF_CONNECTIONS=unlimited",
)


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    return [[(t[s.start : s.end], secret_scan.KINDS[s.kind]) for s in rows[i]] for i, t in enumerate(texts)]


def draw(rng, symbols, n):
    return "".join(rng.choice(symbols) for _ in range(n))


def test_shapes(spark):
    """In each shape the random value, and nothing else, is found: in nearly all draws, as the threshold lets 95% pass."""
    shapes = {
        "env": ("export AWS_ACCESS={} # note", B62 + "+/", 40),
        "long name": ("PRODUCTIONDATABASEPRIMARYVALUE={}\n", B62, 32),
        "padded": ("PRIVATE_KEY={}==\n", B62, 42),
        "query": ("see https://h.example.com/blob/read?sig={}&se=2", B62, 43),
        "path": ("https://h.example.com/files/{}/a_b", B62, 30),
        "foreign": ("id-{}-end+x", B62, 30),
        "digits": ("no. {} of it", DIGITS, 25),
        "base32": ("otp {}.", UPPER + "234567", 32),
        "upper": ("otp {}.", UPPER, 32),
        "lower": ("key {}.", LOWER, 32),
        "base64url": ("/reset/{}", B62 + "-_", 43),
    }
    rng = random.Random(3)
    planted = [(name, shape, draw(rng, symbols, n)) for name, (shape, symbols, n) in shapes.items() for _ in range(30)]
    hits = dict.fromkeys(shapes, 0)
    for (name, _, value), found in zip(planted, spans(spark, [shape.format(v) for _, shape, v in planted])):
        hits[name] += any(kind == "random" and value.strip("+/-_") in text for text, kind in found)
    assert min(hits.values()) >= 24, hits


def test_lone(spark):
    """A class with one token has a threshold, whatever the p-value of its token: most lone secrets are found."""
    rng = random.Random(5)
    values = [draw(rng, B62, n) for n in (21, 30, 43, 60, 85, 120)]
    found = spans(spark, [f"it is {v} here" for v in values])
    assert sum(f == [(v, "random")] for f, v in zip(found, values)) >= 5


def test_plain(spark):
    assert [x for x in spans(spark, PLAIN) if x] == []


def test_nested(spark):
    """A base64 secret is one span, though its parts between the slashes are long enough to be tested as well."""
    rng = random.Random(8)
    value = "/".join(draw(rng, B62, 24) for _ in range(3))
    (found,) = spans(spark, [f"X={value}"])
    assert found == [(value, "random")]


def test_harmless_names_hide_no_secret(spark):
    """Five random tokens among structured names of their class: as many are found beside 420 names as beside 350 or 60."""
    rng = random.Random(11)
    parts = ("account", "Balance", "History", "View", "Controller", "Factory", "request", "Handler", "Default", "Service", "Manager", "Config", "Abstract", "Session", "Token9", "Index2")
    names = []
    while len(names) < 420:
        name = "".join(rng.choices(parts, k=6))[:32]
        if len(name) == 32:
            names.append(name)
    secrets = [draw(rng, B62, 32) for _ in range(5)]
    counts = []
    for many in (60, 350, 420):
        found = spans(spark, [f"call {n} now" for n in names[:many]] + [f"it is {v} here" for v in secrets])
        counts.append((sum(bool(f) for f in found[many:]), sum(bool(f) for f in found[:many])))
    print(counts)
    assert all(hits >= 4 for hits, _ in counts) and len({hits for hits, _ in counts}) == 1, counts
    assert all(false <= 8 for _, false in counts), counts
