"""Registered queries against their SQL, and functions against known values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from clauselake import queries
from clauselake.functions import pii, probability, text, urls
from clauselake.operators import metrics, similar, store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(str, frame[columns].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, tiny, name):
    got = queries.QUERIES[name](spark, tiny).toPandas()
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "check, value, valid",
    [
        (pii.luhn_valid, "4539578763621486", True),
        (pii.luhn_valid, "4539578763621487", False),
        (pii.luhn_valid, "0", False),
        (pii.hkid_valid, "A123456(3)", True),
        (pii.hkid_valid, "AB987654(3)", True),
        (pii.hkid_valid, "A123456(4)", False),
        (pii.cn_id_valid, "11010519491231002X", True),
        (pii.cn_id_valid, "110105194912310021", False),
        (pii.iban_valid, "GB82 WEST 1234 5698 7654 32", True),
        (pii.iban_valid, "GB82 WEST 1234 5698 7654 33", False),
    ],
)
def test_checksums(spark, check, value, valid):
    assert one(spark, check(F.col("v")), v=value) is valid


@pytest.mark.parametrize(
    "value, kinds",
    [
        ("write to jane.doe@gmail.com", {"email"}),
        ("privacy@acme.com", {"contact_email"}),
        ("you@example.com", set()),
        ("123-45-6789", {"national_id", "phone"}),  # nine grouped digits read like a phone number too
        ("000-12-3456", {"phone"}),
        ("call +852 2345 6789", {"phone"}),
        ("on 2024-05-17", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_personal_data(spark, value, kinds):
    df = spark.createDataFrame([(value,)], "v string")
    assert {x["kind"] for x in df.select(pii.findings(pii.counts(F.col("v"))).alias("f")).first()["f"]} == kinds


@pytest.mark.parametrize(
    "sentence, kind",
    [
        ("An early termination fee applies.", "cancellation_fee"),
        ("Your plan renews automatically unless you cancel, and a cancellation fee is due.", "cancellation_fee"),
        ("Your subscription will auto-renew.", "auto_renewal"),
        ("All sales are final.", "no_refund"),
        ("We may change our prices.", "price_change"),
        ("You may cancel at any time.", None),
    ],
)
def test_money(spark, sentence, kind):
    assert one(spark, text.money_kind(F.col("v")), v=sentence) == kind


def test_scores(spark):
    assert one(spark, probability.softmax(F.array(F.lit(1000.0), F.lit(999.0))))[0] == pytest.approx(0.731, abs=1e-3)
    p = [0.05, 0, 0, 0.3, 0, 0, 0.6, 0.05, 0]
    column = F.array(*[F.lit(float(x)) for x in p])
    assert one(spark, probability.category(probability.decide(column))) == "other"
    assert one(spark, probability.category(probability.decide(column, 0.7))) == "arbitration"
    assert one(spark, probability.category(probability.decide(column, 0.6))) == "other"
    assert one(spark, probability.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000001"))) == 63
    rising = F.array(*[F.lit(i % 9) for i in range(72)])
    assert one(spark, probability.difference_hash(rising)) == "f" * 16


def test_addresses(spark):
    v = F.col("v")
    assert one(spark, urls.registrable(v), v="a.b.example.co.uk") == "example.co.uk"
    assert one(spark, urls.policy_key(v), v="HTTPS://u:p@Example.com:443/a?b#c") == "https://example.com/a"
    assert one(spark, urls.policy_key(v), v="http://127.0.0.1/a") is None
    assert one(spark, urls.address_key(v), v="https://www.example.com/a//") == "example.com/a"
    assert one(spark, urls.strip_query(v), v="not a url?x") == "not a url"


def test_expiry_is_strict(spark):
    made = [(1, "u", "d", "2026-01-01 00:00:00", "2026-01-31 00:00:00", 4, 2), (2, "u", "d", "2026-01-02 00:00:00", "2026-02-01 00:00:00", 4, 1), (3, None, "d", None, None, 0, 0)]
    r = spark.createDataFrame(made, "id long, url string, domain string, created_at string, expires_at string, passage_count int, unfair_count int")
    r = r.withColumn("created_at", F.to_timestamp("created_at")).withColumn("expires_at", F.to_timestamp("expires_at"))
    assert [x["id"] for x in store.current(r, "2026-01-30 23:59:59.999").collect()] == [2]
    assert sorted(x["id"] for x in store.live(r, "2026-01-31 00:00:00").collect()) == [2]
    assert store.current(r, "2026-02-01 00:00:00").count() == 0
    assert store.rankings(r.limit(0), "2026-01-01").count() == 0


def test_similar_clauses(spark):
    stored = spark.createDataFrame(
        [("two.com", "u2", "arbitration", "all disputes resolved through binding arbitration rather than court"), ("three.com", "u3", "jurisdiction", "disputes resolved through binding arbitration"), ("four.com", "u4", "arbitration", "cookies improve browsing")],
        "domain string, url string, category string, text string",
    )
    asked = spark.createDataFrame([(1, "one.com", "arbitration", "disputes are resolved through binding arbitration"), (2, "one.com", "arbitration", "no")], "ask_id long, domain string, category string, text string")
    got = similar.similar_clauses(asked, stored).collect()
    assert [(r["ask_id"], r["sites"], r["examples"][0]["domain"]) for r in got] == [(1, 1, "two.com")]


def test_empty_evaluations(spark):
    none = spark.createDataFrame([], "id long, gold int, pred int, probs array<double>, logits array<double>")
    assert metrics.confusion(none).count() == 0
    assert metrics.fit_temperature(none) == 1.0
    assert metrics.bootstrap(none, 10).count() == 0


def test_saved_sites(spark):
    saves = [("a", "2020-01-10"), ("a", "2020-01-20"), ("b", "2019-12-01"), (None, "2020-01-20"), ("c", None), ("d", "2020-01-20")]
    saved = spark.createDataFrame(saves, "domain string, saved_at string").withColumn("saved_at", F.col("saved_at").cast("timestamp"))
    assert {(r.domain, r.saved_at.day) for r in store.saved_sites(saved, "2020-01-25").collect()} == {("a", 20), ("d", 20)}
    assert [r.domain for r in store.saved_sites(saved, "2020-01-25", most=1).collect()] == ["a"]
    assert store.saved_sites(saved.where("false"), "2020-01-25").count() == 0


def test_flagged_shares(spark):
    judged = spark.createDataFrame([("x", "p", True), ("x", "p", False), ("x", "q", None), ("y", "p", True)], "kind string, run string, flagged boolean")
    assert {tuple(r) for r in metrics.flagged_shares(judged, "kind", "run", "flagged", ["p", "q"]).collect()} == {("x", 0.5, None), ("y", 1.0, None)}
