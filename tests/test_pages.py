"""Forms, fields, labels, signals and links of hand-made pages."""

from pyspark.sql import functions as F

from clauselake.functions import urls as U
from clauselake.operators import pages as P

URL = "https://shop.example.com/checkout/pay?x=1#top"


def walk(spark, *sources, url=URL):
    return P.walked(spark.createDataFrame([(i, url, s) for i, s in enumerate(sources)], "page_id int, url string, html string"))


def of_each(pages, column):
    """Each page's value, in order: all pages of a test in one job."""
    return [r.x for r in pages.select("page", column.alias("x")).orderBy("page").collect()]


def forms(spark, *sources):
    return of_each(walk(spark, *sources), P.page_forms(F.col("p"), F.col("url")))


def signals(spark, *sources):
    return of_each(walk(spark, *sources), P.page_signals(F.col("p"), F.col("url")))


def each(*cases):
    """Cases of one test, by column."""
    return list(zip(*cases))


def test_resolve(spark):
    references, want = each(
        ("/a/b", "https://shop.example.com/a/b"), ("c", "https://shop.example.com/checkout/c"), ("../c?q=1#f", "https://shop.example.com/c?q=1"), ("./", "https://shop.example.com/checkout/"), ("..", "https://shop.example.com/"),
        ("//Other.org:443/x", "https://other.org/x"), ("HTTP://o.org:80/./a/../b", "http://o.org/b"), ("?y=2", "https://shop.example.com/checkout/pay?y=2"), ("#z", "https://shop.example.com/checkout/pay?x=1"), ("", "https://shop.example.com/checkout/pay?x=1"),
        ("mailto:a@b.c", "mailto:a@b.c"), ("\\\\o.org\\p", "https://o.org/p"), ("  /t\n", "https://shop.example.com/t"), ("../../../../up", "https://shop.example.com/up"), (None, None),
    )
    df = spark.createDataFrame([(i, r, URL) for i, r in enumerate(references)], "page int, r string, u string")
    assert of_each(df, U.resolve(F.col("r"), F.col("u"))) == list(want)


def test_resolve_without_base(spark):
    df = spark.createDataFrame([("/a", None), ("/a", "not an address"), ("https://a.net/b", "not an address")], "r string, u string")
    assert [r[0] for r in df.select(U.resolve(F.col("r"), F.col("u"))).collect()] == [None, None, "https://a.net/b"]


def test_labels(spark):
    sources, labels = each(
        ("<input aria-label='  Card  no ' id=a><label for=a>x</label>", "Card  no"),
        ("<span id=s1>Date of</span><b id=s2> birth </b><input aria-labelledby='s1 gone s2'>", "Date of birth"),
        ("<label for=a></label><label for=a> Full\n name</label><input id=a>", "Full name"),
        ("<label>Out <label-x></label-x><span>E-mail <input></span></label>", "Out E-mail"),
        ("<p>Your PIN</p><input>", "Your PIN"),
        ("<p>" + "x" * 81 + "</p><input>", ""),
        ("<input name=first><input name=second>", ""),
        ("<div><p>far</p></div>text<input>", "far"),
        ("<label for=''>no</label><input id=''>", "no"),
        ("<input>", ""),
    )
    assert [f[0].fields[-1].label for f in forms(spark, *(f"<form>{s}</form>" for s in sources))] == list(labels)


def test_fields_and_forms(spark):
    (got,) = forms(
        spark,
        """<title>T</title><form action='//pay.example.org/x' method=POST><input type=HIDDEN name=h><select name=s required><option>1</select>
        <textarea id=t placeholder='Say'></textarea><input type=submit value=' Pay  now '><input type=image><input autocomplete='CC-Number' aria-required=true></form>
        <form><button>only a button</button></form><form action='/own'><input></form><form action='mailto:a@b.c'><input></form>""",
    )
    assert [(f.form, f.action_origin, f.method, f.submit_text, len(f.fields)) for f in got] == [(0, "https://pay.example.org", "post", "Pay  now", 4), (1, None, "get", "", 1), (2, None, "get", "", 1)]
    assert [(x.type, x.name, x.id, x.autocomplete, x.placeholder, x.required) for x in got[0].fields] == [("hidden", "h", "", "", "", False), ("select", "s", "", "", "", True), ("textarea", "", "t", "", "Say", False), ("text", "", "", "cc-number", "", True)]


def test_loose_fields(spark):
    sources, many = each(
        ("<input><input>", 0), ("<input><input><select></select>", 3), ("<input><input type=Password>", 2), ("<input type=password>", 0), ("<form><input></form><input><input>", 0),
        ("<input type=submit><input type=button><input><input>", 0), ("", 0), (None, 0), ("<form><input type=password></form><input><input><textarea></textarea>", 3),
    )
    loose = [[f for f in found if f.method == ""] for found in forms(spark, *sources)]
    assert [len(x[0].fields) if x else 0 for x in loose] == list(many)


def test_loose_submit_text_is_of_the_body(spark):
    ((f,),) = forms(spark, "<body><a role=button> </a><a role=button> Log\n in </a><input><input type=password></body>")
    assert f.submit_text == "Log in" and [x.label for x in f.fields] == ["Log in", ""]


def test_deep_pages(spark):
    assert forms(spark, "<div>" * 5000 + "<form><input></form>" + "text" * 1000)[0][0].fields[0].type == "text"


def test_hosts_and_icons(spark):
    (s,) = signals(
        spark,
        """<link rel='shortcut icon' href='//cdn.net/i.png'><link rel=stylesheet href='https://css.net/'><link rel=ICON href='i.ico#x'><link rel=icon href='data:x'><script src='/app.js'></script><script src='https://A.net/x.js'></script>
        <script>var a='https://B.org/x', b="http://b.org:8080/y"</script><script type='application/ld+json'>https://no.org</script><script type=' Module '>`https://c.org`</script><form action='https://f.org/'></form>""",
    )
    assert s.referenced_hosts == ["shop.example.com", "a.net", "b.org", "c.org"] and s.sending_hosts == []
    assert s.icon_urls == ["https://cdn.net/i.png", "https://shop.example.com/checkout/i.ico", "https://shop.example.com/favicon.ico"]


def test_fifty_hosts(spark):
    assert len(signals(spark, "<script>" + " ".join(f"https://h{i}.net/" for i in range(80)) + "</script>")[0].referenced_hosts) == 50


TOKEN = "123456789:" + "A" * 35


def test_sinks(spark):
    sources, sinks = each(
        (f"<script>fetch('https://api.telegram.org/bot{TOKEN}/send')</script>", ["telegram_bot_api", "telegram_bot_token"]),
        (f"<script>x='1{TOKEN}2'</script>", []),
        ("<script src='https://discordapp.com/api/webhooks/1'></script>", ["discord_webhook"]),
        ("<form action='https://formspree.io/f/x'></form>", ["form_relay"]),
        ("<script>'https://hooks.slack.com/services/T' + 'https://abc.ngrok-free.app'</script>", ["slack_webhook", "request_bin"]),
        ("<script type='text/plain' data-saved-defused>https://sink.invalid/pastebin.com/api</script>", ["paste_sink"]),
        ("<script type='text/plain'>https://webhook.site/x</script><p>https://webhook.site/x</p>", []),
        ("<script>'https://notwebhook.sites/'</script>", []),
    )
    assert [s.exfil_sinks for s in signals(spark, *sources)] == list(sinks)


def test_blocks(spark):
    sources, blocks = each(
        ("<script>setInterval(function(){ debugger }, 50)</script>", ["debugger_loop"]),
        ("<script>debugger;" + " " * 130 + "setTimeout(f)</script>", []),
        ("<script>document.onkeydown = e => { if (e.keyCode === 123) return false }</script>", ["devtools_key_block"]),
        ("<script src='/disable-devtool.min.js'></script>", ["devtools_detect_lib"]),
        ("<script>if (window.outerWidth - window.innerWidth > 160) x()</script>", ["devtools_size_probe"]),
        ("<script>setInterval(() => console.clear(), 9)</script>", ["console_suppression"]),
        ("<script>document.addEventListener('contextmenu', f)</script><body oncontextmenu='x'>", ["contextmenu_block"]),
        ("<body onselectstart='return false'>", ["contextmenu_block"]),
        ("<p>debugger setInterval( debugger</p>", []),
    )
    assert [s.devtools_blocks for s in signals(spark, *sources)] == list(blocks)


def test_budget_of_scripts(spark):
    scripts = "<script></script><script>" + "a" * 6 + "</script><script>" + "b" * 6 + "</script><script>c</script>"
    p = walk(spark, scripts)
    assert p.select(P.script_texts(F.col("p"), 10)).first()[0] == ["aaaaaa", "bbbb"]
    assert p.select(P.script_texts(F.col("p"), 6)).first()[0] == ["aaaaaa"]
    assert p.select(P.script_texts(F.col("p"))).first()[0] == ["aaaaaa", "bbbbbb", "c"]


def addresses(spark, source, url="https://www.shop.com/a/b"):
    p = walk(spark, source, url=url)
    return [(x.address, -x.minus) for x in p.select(P.scored_links(P.links(F.col("p"), F.col("url")), F.col("url"))).first()[0]]


def test_scored_links(spark):
    got = addresses(
        spark,
        """<a href='/help'>Terms explained</a><a href='/privacy'>Privacy</a><a href='#terms'>Terms</a><a href='javascript:terms()'>Terms</a><a href='https://other.org/terms'>Terms</a><a href='/disclaimer'>Disclaimer</a>
        <div class='big footer'><a href='/legal-center'>Terms of use</a><a href='https://help.shop.com/tos?x=1'>Rules</a><a href='/imprint' aria-label='Important notice'>i</a></div>
        <p><a href='terms/'>here</a><a href='/terms/../a/terms/'>again</a><a href='/%E6%A2%9D%E6%AC%BE'>zh</a><a title='User agreement' href='/ua'></a></p>""",
    )
    root = "https://www.shop.com"
    assert got == [("https://help.shop.com/tos", 3), (root + "/legal-center", 2), (root + "/a/terms/", 1), (root + "/%E6%A2%9D%E6%AC%BE", 1), (root + "/help", 0), (root + "/ua", 0), (root + "/imprint", -3), (root + "/disclaimer", -5)]


def test_links_a_policy(spark):
    sources, any_ = each(("<a href='/x'>x</a>", False), ("<a href='/x'>Cookie policy</a>", True), ("<a href='https://o.org/privacy'></a>", True), ("<a>Terms</a>", False), ("<a href='/x'>" + "y" * 120 + "terms</a>", False), ("", False))
    assert of_each(walk(spark, *sources), P.links_a_policy(P.links(F.col("p"), F.col("url")))) == list(any_)


def test_publishes_no_terms(spark):
    urls, sources, none = each(
        ("https://lend.com/apply", "<form><input type=password></form>", True), ("https://lend.com/apply", "<form><input name=iban></form>", True), ("https://lend.com/apply", "<form><input name=q></form>", False),
        ("https://lend.com/apply", "<form><input type=password></form><a href='/tos'>x</a>", False), ("https://lend.com/privacy", "<form><input type=password></form>", False), ("https://lend.com/a", "<title>Terms</title><form><input type=password></form>", False),
        ("http://localhost/a", "<form><input type=password></form>", False), ("http://10.0.0.1/a", "<form><input type=password></form>", False), ("ftp://lend.com/a", "<form><input type=password></form>", False), (None, "<form><input type=password></form>", False),
    )
    p = P.walked(spark.createDataFrame(list(zip(range(99), urls, sources)), "page_id int, url string, html string"))
    forms_, links_ = P.page_forms(F.col("p"), F.col("url")), P.links(F.col("p"), F.col("url"))
    assert of_each(p, P.publishes_no_terms(F.col("p"), F.col("url"), forms_, links_)) == list(none)


def test_terms_found(spark):
    pages = walk(spark, "<footer><a href='/tos'>t</a><a href='/legal/terms'>t</a></footer>", "", url="https://a.com/x")
    answers = [("https://a.com/tos", 200, "text/html", 100, 1, 9), ("https://a.com/legal/terms", 404, "text/html", 900, 0, 9), ("https://a.com/terms", 200, "application/pdf", 900, 0, 9), ("https://a.com/terms-of-service", 200, "text/html", 399, 0, 9), ("https://a.com/terms-of-use", 200, "text/html", 400, 0, 3), ("https://a.com/terms-and-conditions", 200, "text/html; x", 400, 0, 4)]
    fetched = spark.createDataFrame(answers, "address string, status int, kind string, chars int, scripts int, cues int")
    rows = {r.page: r for r in P.terms_found(pages, fetched).collect()}
    assert [(f.address.removeprefix("https://a.com"), f.reason) for f in rows[0].failures] == [("/tos", "needs-javascript"), ("/legal/terms", "http-error"), ("/terms", "not-html"), ("/terms-of-service", "too-short"), ("/terms-of-use", "not-terms"), ("/policies/terms", "fetch-failed")]
    assert rows[0].address == "https://a.com/terms-and-conditions" and rows[0].place == 6 and rows[0].tried == 8
    assert P.terms_found(pages, fetched.limit(0)).where("address is null and size(failures) = 8").count() == 2


def test_picked_documents(spark):
    docs = spark.createDataFrame([("a.com", "https://a.com/x", 1), ("a.com", "https://a.com/terms", 2), ("a.com", "https://a.com/privacy", 9), ("b.com", "https://b.com/p", 3), ("b.com", "https://b.com/q", 4), ("c.com", "https://c.com/x", 1), ("c.com", "https://c.com/tos", 0)], "domain string, url string, created_at int")
    hints = spark.createDataFrame([("c.com", 0, "https://c.com/none"), ("c.com", 1, "http://www.c.com/x/?y"), ("a.com", 0, None)], "domain string, place int, url string")
    assert sorted((r.domain, r.url) for r in P.picked_documents(docs, hints).collect()) == [("a.com", "https://a.com/terms"), ("b.com", "https://b.com/q"), ("c.com", "https://c.com/x")]
