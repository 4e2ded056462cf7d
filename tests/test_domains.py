"""Sites by suffix rules, reports' addresses, and positions among marked rows."""

from clauselake.operators import domains, reading, similar

LIST = """// a comment
com
uk
co.uk
*.kobe.jp
!city.kobe.jp
jp
*.ck
!www.ck

// ===BEGIN PRIVATE DOMAINS===
github.io // of users
"""


def test_sites(spark, tmp_path):
    (tmp_path / "list.dat").write_text(LIST)
    rules = domains.listed(spark, str(tmp_path / "list.dat"))
    assert {(r.suffix, r.kind) for r in rules.where("not icann").collect()} == {("github.io", "plain")} and rules.count() == 9
    want = {
        "a.b.c.kobe.jp": ("c.kobe.jp", "b.c.kobe.jp", "b", True), "x.city.kobe.jp": ("kobe.jp", "city.kobe.jp", "city", True), "kobe.jp": ("jp", "kobe.jp", "kobe", True), "c.kobe.jp": ("c.kobe.jp", None, None, False),
        "www.ck": ("ck", "www.ck", "www", True), "a.www.ck": ("ck", "www.ck", "www", True), "a.b.ck": ("b.ck", "a.b.ck", "a", True), "x.github.io": ("github.io", "x.github.io", "x", False), "github.io": ("github.io", None, None, False),
        "www.shop.co.uk": ("co.uk", "shop.co.uk", "shop", True), "co.uk": ("co.uk", None, None, False), "localhost": ("localhost", None, None, False), "a.unlisted": ("unlisted", "a.unlisted", "a", False),
        "10.0.0.1": (None, None, None, False), "[::1]": (None, None, None, False), "a.example.com": ("com", "example.com", "example", True),
    }
    hosts = spark.createDataFrame([(h.upper(),) for h in want] + [("a.example.com",), (None,)], "host string")
    assert {r.host: (r.suffix, r.site, r.label, r.public) for r in domains.sites(hosts, rules).collect()} == want
    assert domains.sites(hosts, rules.limit(0)).where("site = 'co.uk'").count() == 2
    assert domains.sites(hosts.limit(0), rules).count() == 0


def test_reported_addresses(spark, tmp_path):
    (tmp_path / "list.dat").write_text(LIST)
    rules = domains.listed(spark, str(tmp_path / "list.dat"))
    tried = spark.createDataFrame([(1, "Lend.com", 0, "https://lend.com/terms"), (1, "Lend.com", 1, "https://other.com/terms"), (1, "Lend.com", 2, "https://www.lend.com/tos"), (1, "Lend.com", 3, "nothing"), (2, "x.github.io", 0, "https://y.github.io/")], "report int, domain string, place int, url string")
    assert sorted((r.report, r.place) for r in domains.same_site_only(tried, rules).collect()) == [(1, 0), (1, 2)]
    assert [r.place for r in domains.same_site_only(tried, rules, most=1).collect()] == [0]
    checked = domains.checked(tried, rules).orderBy("report", "place").collect()
    assert [(r.consistent, r.public) for r in checked] == [(True, True), (False, True), (True, True), (False, False), (False, False)]


def test_positions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 0, "w"), (None, 1, "n"), ("a", 9, "v")], "doc string, at int, what string")
    marks = spark.createDataFrame([("a", 0), ("a", 2), ("a", 4), ("c", 1), (None, 1)], "doc string, at int")
    got = {r.what: r.position for r in reading.positioned(rows, marks, "doc", "at").collect()}
    assert got == {"x": 1, "y": 1, "z": 2, "v": 2, "w": 0, "n": None}
    assert reading.positioned(rows.limit(0), marks, "doc", "at").count() == 0


def test_ranking_of_clauses(spark):
    stored = spark.createDataFrame(
        [(1, "two.com", "arbitration", True, "Disputes are resolved by binding arbitration."), (2, "three.com", "arbitration", False, "binding arbitration disputes"), (3, "ONE.com", "arbitration", True, "binding arbitration disputes"), (4, "four.com", "jurisdiction", True, "binding arbitration disputes"),
         (5, "five.com", "arbitration", True, "cookies improve browsing"), (6, "six.com", "arbitration", True, "binding " * 30), (7, "five.com", "arbitration", True, None), (8, "five.com", "arbitration", True, "")],
        "clause long, domain string, category string, current boolean, text string",
    )
    asked = spark.createDataFrame([(1, "one.com", "arbitration", "Binding arbitration of all disputes"), (2, "one.com", "arbitration", "binding"), (3, "one.com", None, "binding arbitration disputes")], "ask_id long, domain string, category string, text string")
    assert [(r.ask_id, r.clause, r["rank"]) for r in similar.bm25_candidates(asked, stored).orderBy("rank").collect()] == [(1, 1, 1), (1, 6, 2)]
    assert similar.bm25_candidates(asked, stored, most=1).count() == 1
    assert similar.bm25_candidates(asked, stored.limit(0)).count() == 0


def test_near_duplicates_of_one_table(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g"), (4, "x y"), (5, "x  Y"), (6, ""), (7, None), (8, "q r s t")], "id long, text string")
    got = sorted((r.left_id, r.right_id, r.shared, round(r.similarity, 3)) for r in similar.near_duplicates(rows, rows, 0.5).where("left_id <= right_id").collect())
    assert got == [(1, 1, 4, 1.0), (1, 2, 4, 1.0), (1, 3, 3, 0.6), (2, 2, 4, 1.0), (2, 3, 3, 0.6), (3, 3, 4, 1.0), (4, 4, 1, 1.0), (4, 5, 1, 1.0), (5, 5, 1, 1.0), (8, 8, 2, 1.0)]
    other = spark.createDataFrame([(1, "a b c d e f"), (9, "m n o p")], "id long, text string")
    assert sorted((r.left_id, r.right_id) for r in similar.near_duplicates(rows, other, 0.5).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_quotes_of_any_length(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "He said: “Arbitration binds” and went."), (2, "internationalisation"), (3, "all of these words stand in a row here"), (4, ""), (5, None), (6, "übergrößenträger 🙂🙂🙂🙂🙂🙂🙂🙂")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "arbitration BINDS"), (2, "nationalis"), (3, "words stand in a row"), (4, "short"), (5, "ords stand in a ro"), (6, "größenträ"), (7, "🙂🙂🙂🙂🙂🙂🙂🙂"), (8, None), (9, "not anywhere at all")], "item_id long, text string")
    want = [(1, 1), (2, 2), (3, 3), (3, 5), (6, 6), (6, 7)]
    for bytes_ in (8_000_000, 0):
        monkeypatch.setattr(similar, "BROADCAST_BYTES", bytes_)
        assert sorted((r.doc_id, r.item_id) for r in similar.quoting(docs, items).collect()) == want
    assert similar.quoting(docs, items.where("item_id = 4")).count() == 0
