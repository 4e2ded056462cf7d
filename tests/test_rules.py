"""Field kinds, form and page rules by cases whose points add up by hand."""

import pytest
from pyspark.sql import functions as F

from clauselake.functions import fields as K
from clauselake.operators import lookalikes, rules

KINDS = {
    "password": {"type": "password", "name": "cvv"}, "card_cvv": {"label": "Card security code"}, "card_expiry": {"autocomplete": "cc-exp"}, "credit_card": {"name": "card_number"},
    "national_id": {"label": "HKID 身份證"}, "bank_account": {"placeholder": "IBAN"}, "dob": {"name": "dob"}, "address": {"label": "Postal code"}, "full_name": {"id": "surname"},
    "phone": {"type": "tel"}, "email": {"type": "email"}, "other": {"name": "coupon"},
}
FIELDS = "page int, form int, type string, name string, id string, autocomplete string, placeholder string, label string"


def field(page, form, kind):
    return (page, form, *[KINDS[kind].get(a) for a in K.ATTRIBUTES])


@pytest.mark.parametrize("kind", KINDS)
def test_field_kinds(spark, kind):
    rows = spark.createDataFrame([field(0, 0, kind)], FIELDS)
    assert rows.select(K.kind({a: F.col(a) for a in K.ATTRIBUTES})).first()[0] == kind


PAGES = [  # page, hostname, https, form kinds, origin of its action
    (1, "news.example.org", True, ["email"], None),
    (2, "paypa1.com", True, ["credit_card", "card_cvv"], "https://evil.test"),
    (3, "shop.example.org", False, ["password"], None),
    (4, "forms.example.org", True, ["full_name", "dob", "address"], None),
    (5, "paypal.com", True, ["credit_card", "national_id", "bank_account"], None),
    (6, "mine.org", False, ["password", "credit_card", "bank_account"], None),
    (7, "all.top", False, [k for k in KINDS if k != "other"], "https://evil.test"),
    (8, "login.xyz", True, ["password"], None),
]
WANT = {1: (0, "safe"), 2: (80, "danger"), 3: (30, "caution"), 4: (15, "safe"), 5: (75, "caution"), 6: (0, "safe"), 7: (100, "danger"), 8: (10, "safe")}


def scored(spark, hits=()):
    forms = spark.createDataFrame([(p, 0, origin) for p, _, _, _, origin in PAGES], "page int, form int, action_origin string")
    fields = spark.createDataFrame([field(p, 0, k) for p, _, _, kinds, _ in PAGES for k in kinds], FIELDS)
    pages = spark.createDataFrame([(p, h, s) for p, h, s, _, _ in PAGES], "page int, hostname string, is_https boolean")
    brands = spark.createDataFrame([(0, "PayPal", "paypal.com")], "ord int, name string, domain string")
    like = lookalikes.lookalikes(pages.select(F.col("hostname").alias("host")), lookalikes.brand_index(brands))
    return rules.forms_scored(forms, fields, pages, brands, like, spark.createDataFrame(list(hits), f"page int, hits {rules.HITS}"), allowed=["mine.org"])


def test_forms(spark):
    rows = {r.page: r for r in scored(spark).collect()}
    assert {p: (r.score, r.verdict) for p, r in rows.items()} == WANT
    assert [h.id for h in rows[2].hits] == ["lookalike_domain", "credit_card_fields", "cross_origin_action"]
    assert rows[5].hits[-1].id == "known_brand_domain" and "many_personal_fields" in [h.id for h in rows[7].hits]
    more = {r.page: r for r in scored(spark, [(3, [("exfil_sink_endpoint", 35)])]).collect()}
    assert (more[3].score, more[3].verdict, more[3].hits[0].id) == (65, "danger", "exfil_sink_endpoint")


SIGNALS = "page int, hostname string, icon_urls array<string>, referenced_hosts array<string>, sending_hosts array<string>, exfil_sinks array<string>, devtools_blocks array<string>, icon_brand string, sensitive boolean"


def test_pages(spark):
    rows = [
        (1, "a.com", [], [], [], ["telegram_bot_token", "telegram_bot_api"], [], None, False),
        (2, "a.com", ["https://b.com/i.png"], ["cdn.x.com"], ["c.com", "www.a.com"], [], ["contextmenu_block"], None, True),
        (3, "a.com", ["https://img.a.com/i.png"], ["cdn.x.com"], [], ["telegram_bot_api", "discord_webhook"], ["debugger_loop", "contextmenu_block"], "brand.com", True),
        (4, "mine.org", None, None, None, ["paste_sink"], None, None, None),
        (5, "a.com", None, None, None, None, None, "a.com", None),
    ]
    hits = rules.page_hits(spark.createDataFrame(rows, SIGNALS), ["mine.org"], ["x.com"])
    got = {r.page: {h.id: h.points for h in r.hits} for r in hits.collect()}
    assert got == {
        1: {"telegram_bot_token": 40}, 2: {"sensitive_post_third_party": 20, "favicon_hotlinked": 15, "right_click_blocked": 5},
        3: {"exfil_sink_endpoint": 35, "favicon_brand_mismatch": 35, "devtools_blocked": 25}, 4: {}, 5: {},
    }
    assert {r.page: (r.score, r.verdict) for r in rules.standalone(hits).collect()} == {1: (40, "danger"), 2: (0, "safe"), 3: (95, "danger"), 4: (0, "safe"), 5: (0, "safe")}
    forms = spark.createDataFrame([(2, 0, 30, [], "caution"), (2, 1, 30, [], "caution"), (2, 2, 10, [], "safe")], f"page int, form int, score int, hits {rules.HITS}, verdict string")
    assert {r.page: (r.form, r.score) for r in rules.pages_assessed(forms, hits).collect()} == {1: (None, 40), 2: (0, 30), 3: (None, 95), 4: (None, 0), 5: (None, 0)}


def test_icons_are_looked_up_once_something_was_said(spark):
    mark, near, other = "0123456789abcdef", "0123456789abcde0", "f" * 16
    ask = lambda page, host, urls, sinks=(), sensitive=False: (page, host, urls, [], [], list(sinks or ()), [], None, sensitive)
    signals = spark.createDataFrame(
        [
            ask(1, "a.com", ["https://a.com/broken", None, "https://a.com/i"]),  # its second form is the worst, the first icon that reads counts
            ask(2, "b.com", ["https://b.com/i"]),  # says nothing: never asked
            ask(3, "c.com", None, ["paste_sink"]),
            ask(4, "d.com", ["https://d.com/i", "https://a.com/i"], ["paste_sink"]),  # another's icon comes first
            ask(5, "brand.com", ["https://a.com/i"], ["telegram_bot_token"]),
            ask(6, "mine.org", ["https://a.com/i"], ["telegram_bot_token"]),
            ask(7, None, [], None),
            ask(8, "e.com", ["https://a.com/i"]),  # two forms alike
        ],
        SIGNALS,
    )
    hit = lambda *points: [(f"r{p}", p) for p in points]
    found = [(1, 0, hit(10), False, False), (1, 1, hit(25, 20), False, False), (2, 0, hit(25), False, False), (6, 0, hit(60), False, True), (8, 1, hit(30), True, False), (8, 0, hit(30), True, False)]
    found = spark.createDataFrame(found, f"page int, form int, own {rules.HITS}, known boolean, free boolean")
    icons = spark.createDataFrame([("https://a.com/broken", None), ("https://a.com/i", near), ("https://b.com/i", near), ("https://d.com/i", other), (None, mark)], "url string, hash string")
    known = spark.createDataFrame([("brand.com", mark)], "brand string, hash string")
    of = lambda icons_, known_: {r.page: (r.form, r.score, r.verdict, r.asked) for r in rules.assessed(signals.drop("icon_brand"), found, icons_, known_, ["mine.org"]).collect()}
    plain = {2: (None, 0, "safe", False), 3: (None, 35, "caution", True), 4: (None, 35 + 15, "caution", True), 6: (None, 0, "safe", False), 7: (None, 0, "safe", False)}
    assert of(icons, known) == plain | {1: (1, 80, "danger", True), 5: (None, 55, "danger", True), 8: (0, 80, "caution", True)}
    assert of(icons, known.limit(0)) == of(icons.limit(0), known) == plain | {1: (1, 45, "caution", True), 5: (None, 55, "danger", True), 8: (0, 45, "caution", True)}
    assert rules.assessed(signals.drop("icon_brand").limit(0), found, icons, known).count() == 0
