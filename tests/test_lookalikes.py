"""Look-alike hosts and icons by known cases and against a plain search."""

import random

from pyspark.sql import functions as F

from clauselake.functions import hosts, urls
from clauselake.operators import lookalikes

BRANDS = [(0, "Payme", "payme.hsbc.com.hk"), (1, "HSBC", "hsbc.com.hk"), (2, "PayPal", "paypal.com"), (3, "Amazon", "amazon.com"), (4, "Microsoft", "microsoft.com"), (5, "Line", "line.me"), (6, "DHL", "dhl.com"), (7, "Netflix", "netflix.com")]


def index(spark):
    return lookalikes.brand_index(spark.createDataFrame(BRANDS, "ord int, name string, domain string"))


def test_known_hosts(spark):
    cases = {
        "paypa1.com": ("PayPal", "homoglyph", 0), "pаypal.com": ("PayPal", "homoglyph", 0), "xn--pypal-4ve.com": ("PayPal", "homoglyph", 0),
        "payppal.com": ("PayPal", "typo", 1), "rnicrosoft.net": ("Microsoft", "homoglyph", 0), "micorsoft.com": ("Microsoft", "typo", 2),
        "paypal.secure-login.xyz": ("PayPal", "impersonation", 0), "hsbc-verify.top": ("HSBC", "impersonation", 0), "dhl-tracking.xyz": ("DHL", "impersonation", 0),
        "mail.paypal.com": None, "amazonaws.com": None, "line.example.com": None, "hsbd.com": None, "example.org": None,
    }
    rows = spark.createDataFrame([(h,) for h in [*cases, None]], "host string")
    got = {r.host: (r.name, r.kind, r.distance) for r in lookalikes.lookalikes(rows, index(spark)).collect()}
    assert got == {h: x for h, x in cases.items() if x}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_typos_are_all_found(spark):
    rng, names = random.Random(1), ("paypal", "amazon", "microsoft", "netflix")
    made = set()
    for _ in range(300):
        x = list(rng.choice(names))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(x))
            kind = rng.randrange(3)
            x[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abmyz")]
        made.add("".join(x) + ".com")
    rows = spark.createDataFrame([(h,) for h in made], "host string").withColumn("label", hosts.folded(F.substring_index("host", ".", 1)))
    folded = {r.host: r.label for r in rows.collect()}
    got = {r.host for r in lookalikes.lookalikes(rows.select("host"), index(spark)).where("kind = 'typo'").collect()}
    budget = lambda n: 0 if n <= 5 else 1 if n <= 8 else 2
    want = {h for h, x in folded.items() if x not in names and any(edits(x, b) <= budget(len(b)) for b in names)}
    assert got == want and len(want) > 50


def test_icons(spark):
    rng = random.Random(4)
    known = [(f"b{i}", f"{rng.getrandbits(64):016x}") for i in range(40)] + [("twin", None)]
    known[-1] = ("twin", f"{int(known[0][1], 16) ^ 0b101:016x}")
    flip = lambda h, n: f"{int(h, 16) ^ sum(1 << b for b in rng.sample(range(64), n)):016x}"
    icons = [(f"i{i}", flip(h, i % 9)) for i, (_, h) in enumerate(known)]
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {}
    for name, h in icons:
        near = {b: far(h, k) for b, k in known if far(h, k) <= 6}
        if len(near) == 1:
            want[name] = next(iter(near.items()))
    table = spark.createDataFrame(known, "brand string, hash string")
    got = {r.icon: (r.brand, r.distance) for r in lookalikes.icon_matches(spark.createDataFrame(icons, "icon string, hash string"), table).collect()}
    assert got == want and len(want) > 10
    assert [(r.brand_a, r.brand_b, r.distance) for r in lookalikes.icon_collisions(table).collect()] == [("b0", "twin", 2)]


def test_typed_hosts(spark):
    one = lambda t: spark.range(1).select(urls.domain_candidates(F.lit(t)).alias("x")).first()["x"]
    assert one("https://www.Docs.Example.co.uk/terms?x=1") == ["docs.example.co.uk", "example.co.uk"]
    assert one("shop.com.mx:8080") == ["shop.com.mx"] and one("x.io") == ["x.io"] and one("a.b c") == [] and one("word") == [] and one(None) == []
