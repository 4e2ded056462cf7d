"""What a page asks for, ships data to and links to: forms with their fields and labels, signals, links to terms.

Pages are walked once (`walked`); all the rest are column expressions over that page's own elements, so nothing is
shuffled until results of several pages meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import fields as K
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..functions.text import let

FORM = "array<struct<form: int, action_origin: string, method: string, submit_text: string, fields: array<struct<type: string, name: string, id: string, autocomplete: string, placeholder: string, label: string, required: boolean>>>>"

# Controls that hold data, inputs that hold none, and the lengths of labels, buttons and titles.
CONTROLS = ("input", "select", "textarea")
NO_DATA = ("submit", "button", "reset", "image")
LABEL_CHARS, SUBMIT_CHARS, TITLE_CHARS = 80, 80, 200
#: Loose controls from which on they count as a form; with a password among them, fewer.
LOOSE, LOOSE_WITH_PASSWORD = 3, 2


def walked(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page, url and p (see `html.walk`).  A null page has no elements."""
    return pages.select(F.col(page_col).alias("page"), F.col(url_col).alias("url"), H.walk(F.col(html_col)).alias("p"))


def context(url: Column, title: Column) -> Column:
    """struct url (without query), hostname, is_https, title."""
    return F.struct(
        U.strip_query(url).alias("url"),
        F.coalesce(U.host(url), F.lit("")).alias("hostname"),
        F.coalesce(U.scheme(url) == "https", F.lit(False)).alias("is_https"),
        F.substring(D.trimmed(title), 1, TITLE_CHARS).alias("title"),
    )


# -- forms


def _holds_data(e: Column) -> Column:
    return (e["tag"] == "input") & ~F.lower(D.attr(e, "type")).isin(*NO_DATA) | e["tag"].isin("select", "textarea")


def label(p: Column, e: Column) -> Column:
    """What a reader takes for the label of a control.

    In turn: aria-label, the elements that aria-labelledby names, a label for its id, the innermost label around it, and the text of the
    element before it, if that is no control and has 80 characters at most.
    """
    filled = lambda texts: F.filter(texts, lambda t: t != "")
    some = lambda t: let(t, lambda x: F.when(x != "", x))
    ids = filled(F.split(D.attr(e, "aria-labelledby"), D.SPACE))
    by_ids = F.array_join(filled(F.transform(ids, lambda i: D.text(p, D.first(D.elements(p, lambda x: D.attr(x, "id") == i))))), " ")
    for_id = F.transform(D.elements(p, lambda x: (x["tag"] == "label") & D.has(x, "for") & (D.attr(x, "for") == D.attr(e, "id"))), lambda x: D.text(p, x))
    around = F.try_element_at(D.elements(p, lambda x: (x["tag"] == "label") & D.lies_in(e, x)), F.lit(-1))
    # Nothing where the number is -1.
    before = let(F.get(p["elements"], e["prev"]), lambda x: F.when(~x["tag"].isin(*CONTROLS), D.text(p, x)))
    return F.coalesce(
        some(D.trimmed(D.attr(e, "aria-label"))),
        some(by_ids),
        F.when(D.attr(e, "id") != "", D.first(filled(for_id))),
        some(D.text(p, around)),
        let(before, lambda said: F.when(F.length(said) <= LABEL_CHARS, said)),
        F.lit(""),
    )


def _field(p: Column, e: Column) -> Column:
    kind = F.when(e["tag"] != "input", e["tag"]).when(D.has(e, "type"), F.lower(D.attr(e, "type"))).otherwise("text")
    own = lambda name: D.attr(e, name).alias(name)
    required = D.has(e, "required") | (D.attr(e, "aria-required") == "true")
    return F.struct(kind.alias("type"), own("name"), own("id"), F.lower(D.attr(e, "autocomplete")).alias("autocomplete"), own("placeholder"), label(p, e).alias("label"), required.alias("required"))


def _submit_text(p: Column, inside) -> Column:
    """The first text or value of a button in an element."""
    button = lambda e: (e["tag"] == "button") | (e["tag"] == "input") & F.lower(D.attr(e, "type")).isin("submit", "button") | (D.attr(e, "role") == "button")
    said = lambda e: let(D.text(p, e), lambda t: F.when(t != "", t).otherwise(D.trimmed(D.attr(e, "value"))))
    texts = F.transform(D.elements(p, lambda e: inside(e) & button(e)), said)
    return F.substring(F.coalesce(D.first(F.filter(texts, lambda t: t != "")), F.lit("")), 1, SUBMIT_CHARS)


def action_origin(action: Column, url: Column) -> Column:
    """Where a form posts to, if that is another http(s) origin than the page's own; else null."""
    return let(U.resolve(action, url), lambda to: let(U.origin(to), lambda origin: F.when((action != "") & (origin != U.origin(url)), origin)))


def page_forms(p: Column, url: Column) -> Column:
    """array<struct<form, action_origin, method, submit_text, fields>>: forms with fields, in order, then loose controls as one more.

    Loose controls (in no form) count from three on, or two with a password among them; their form has no method.
    """

    def form(f: Column) -> Column:
        controls = D.elements(p, lambda e: D.lies_in(e, f) & _holds_data(e))
        method = F.when(D.has(f, "method"), F.lower(D.attr(f, "method"))).otherwise("get")
        return F.struct(
            F.when(D.has(f, "action"), action_origin(D.attr(f, "action"), url)).alias("action_origin"),
            method.alias("method"),
            _submit_text(p, lambda e: D.lies_in(e, f)).alias("submit_text"),
            F.transform(controls, lambda e: _field(p, e)).alias("fields"),
        )

    def loose(forms: Column) -> Column:
        controls = D.elements(p, lambda e: _holds_data(e) & ~F.exists(forms, lambda f: D.lies_in(e, f)))

        def of(free: Column) -> Column:
            password = F.exists(free, lambda e: F.lower(D.attr(e, "type")) == "password")
            body = D.first(D.elements(p, lambda e: e["tag"] == "body"))
            one = F.struct(
                F.lit(None).cast("string").alias("action_origin"),
                F.lit("").alias("method"),
                _submit_text(p, lambda e: body.isNull() | F.coalesce(D.lies_in(e, body), F.lit(False))).alias("submit_text"),
                F.transform(free, lambda e: _field(p, e)).alias("fields"),
            )
            return F.when((F.size(free) >= LOOSE) | password & (F.size(free) >= LOOSE_WITH_PASSWORD), F.array(one)).otherwise(F.array())

        return let(controls, of)

    def both(forms: Column) -> Column:
        kept = F.filter(F.transform(forms, form), lambda f: F.size(f["fields"]) > 0)
        every = F.concat(kept, loose(forms))
        return F.transform(every, lambda f, i: F.struct(i.alias("form"), *[f[c].alias(c) for c in ("action_origin", "method", "submit_text", "fields")]))

    # Most pages have no control at all.
    none = F.array().cast(FORM)
    return F.when(F.exists(p["elements"], _holds_data), let(D.elements(p, lambda e: e["tag"] == "form"), both).cast(FORM)).otherwise(none)


def form_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pages (page, hostname, is_https, title), forms (page, form, action_origin, method, submit_text) and fields (page, form, place and the seven attributes).

    `pages` is what `walked` gives.  These are the tables that `rules` judges.
    """
    found = pages.select("page", F.explode(page_forms(F.col("p"), F.col("url"))).alias("f")).select("page", "f.*")
    fields = found.select("page", "form", F.posexplode("fields").alias("place", "field")).select("page", "form", "place", "field.*")
    return pages.select("page", context(F.col("url"), D.title(F.col("p"))).alias("c")).select("page", "c.*"), found.drop("fields"), fields


# Fields that make a page without terms worth a warning.
DETAILS = r"(?i)cc-|card.?num|cvv|cvc|iban|ssn|passport|national.?id|身份證|信用卡|銀行"


def asks_for_details(forms: Column) -> Column:
    said = lambda f: F.concat_ws(" ", f["name"], f["id"], f["autocomplete"], f["placeholder"], f["label"])
    return F.exists(forms, lambda x: F.exists(x["fields"], lambda f: (f["type"] == "password") | said(f).rlike(DETAILS)))


# -- signals

# Addresses that exist to receive data, and ways of keeping readers out of the developer tools; types of scripts that run.
SINKS = (
    ("telegram_bot_api", r"(?i)api\.telegram\.org/bot"),
    ("telegram_bot_token", r"(?<!\d)\d{8,10}:[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    ("discord_webhook", r"(?i)discord(?:app)?\.com/api/webhooks/"),
    ("slack_webhook", r"(?i)hooks\.slack\.com/services/"),
    ("form_relay", r"(?i)\b(?:formspree\.io|formsubmit\.co|getform\.io|web3forms\.com|herotofu\.com|formcarry\.com|usebasin\.com|staticforms\.xyz)\b"),
    ("request_bin", r"(?i)\b(?:webhook\.site|requestbin\.[a-z]{2,}|pipedream\.net|beeceptor\.com|ngrok(?:-free)?\.(?:io|app|dev))\b"),
    ("paste_sink", r"(?i)\b(?:pastebin\.com/api|hastebin\.com/documents|termbin\.com|0x0\.st)\b"),
)
BLOCKS = (
    ("debugger_loop", r"\bdebugger\b[\s\S]{0,120}?(?:setInterval|setTimeout|requestAnimationFrame)|(?:setInterval|setTimeout|requestAnimationFrame)\s*\([\s\S]{0,120}?\bdebugger\b"),
    (
        "devtools_key_block",
        r"""(?i)(?:keydown|keyup|onkeydown)[\s\S]{0,200}?(?:(?:keyCode|which)\s*[=!]==?\s*123|['"]F12['"])|shiftKey[\s\S]{0,80}?(?:keyCode|which)\s*[=!]==?\s*(?:73|74|67)|ctrlKey[\s\S]{0,80}?(?:keyCode|which)\s*[=!]==?\s*85""",
    ),
    ("devtools_detect_lib", r"(?i)\b(?:disable-?devtool|devtools?-?detector|console-ban|DisableDevtool)\b"),
    ("devtools_size_probe", r"(?i)(?:outerWidth|outerHeight)\s*-\s*(?:[A-Za-z_$][\w$]*\.)?(?:innerWidth|innerHeight)\s*[<>]"),
    ("console_suppression", r"(?i)console\.clear\s*\(\s*\)[\s\S]{0,80}?(?:setInterval|setTimeout)|(?:setInterval|setTimeout)\s*\([\s\S]{0,80}?console\.clear"),
    ("contextmenu_block", r"""(?i)addEventListener\s*\(\s*['"](?:contextmenu|selectstart|dragstart)['"]|oncontextmenu\s*="""),
)
RUNNING = ("", "text/javascript", "application/javascript", "module", "text/babel", "application/ecmascript")
LITERAL = r"""(?i)https?://[^\s'"`<>\\)]+"""
ICON = r"\b(?:icon|shortcut|apple-touch-icon|mask-icon)\b"
SCRIPT_CHARS, HOSTS = 300_000, 50


def script_texts(p: Column, budget: int = SCRIPT_CHARS) -> Column:
    """The texts of scripts that run, in order, `budget` characters in all: the script that reaches it is cut, later ones are left out."""
    # A saved page keeps its scripts as text, each with an attribute data-...-defused.
    kept = lambda e: F.exists(F.map_keys(e["attrs"]), lambda k: k.startswith("data-") & k.endswith("-defused"))
    runs = lambda e: kept(e) | D.trimmed(F.lower(D.attr(e, "type"))).isin(*RUNNING)
    texts = F.filter(F.transform(D.elements(p, lambda e: (e["tag"] == "script") & runs(e)), lambda e: D.raw_text(p, e)), lambda t: t != "")
    begun = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("texts"))

    def step(a: Column, t: Column) -> Column:
        more = F.concat(a["texts"], F.array(F.substring(t, F.lit(1), a["left"])))
        return F.struct((a["left"] - F.length(t)).alias("left"), F.when(a["left"] > 0, more).otherwise(a["texts"]).alias("texts"))

    return F.aggregate(texts, begun, step, lambda a: a["texts"])


def icon_urls(p: Column, url: Column) -> Column:
    """The icons that a page declares, and the usual one, each once."""
    declared = D.elements(p, lambda e: (e["tag"] == "link") & D.has(e, "rel") & F.lower(D.attr(e, "rel")).rlike(ICON) & (D.attr(e, "href") != ""))
    found = F.filter(F.transform(declared, lambda e: U.resolve(D.attr(e, "href"), url)), lambda u: U.scheme(u).isin("http", "https"))
    usual = U.resolve(F.lit("/favicon.ico"), url)
    return F.array_distinct(F.array_compact(F.concat(found, F.array(usual))))


def page_signals(p: Column, url: Column) -> Column:
    """struct icon_urls, referenced_hosts (50 at most), sending_hosts (empty: known at run time alone), exfil_sinks, devtools_blocks."""
    sources = F.filter(F.transform(D.elements(p, lambda e: e["tag"] == "script"), lambda e: D.attr(e, "src")), lambda s: s != "")
    actions = F.filter(F.transform(D.elements(p, lambda e: e["tag"] == "form"), lambda e: D.attr(e, "action")), lambda s: s != "")

    def of(texts: Column) -> Column:
        literals = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(LITERAL), F.lit(0))))
        named = F.concat(F.transform(F.transform(sources, lambda s: U.resolve(s, url)), U.host), F.transform(literals, lambda s: U.host(s)))
        hosts = F.slice(F.array_distinct(F.array_compact(named)), 1, HOSTS)
        tells = F.array_join(F.concat(sources, actions, texts), "\n")
        matched = lambda patterns: let(tells, lambda h: F.array_compact(F.array(*[F.when(h.rlike(x), id_) for id_, x in patterns])))
        attribute = F.exists(p["elements"], lambda e: D.has(e, "oncontextmenu") | D.has(e, "onselectstart") | D.has(e, "ondragstart"))
        blocks = let(matched(BLOCKS), lambda b: F.when(attribute & ~F.array_contains(b, "contextmenu_block"), F.array_append(b, F.lit("contextmenu_block"))).otherwise(b))
        return F.struct(icon_urls(p, url).alias("icon_urls"), hosts.alias("referenced_hosts"), F.array().cast("array<string>").alias("sending_hosts"), matched(SINKS).alias("exfil_sinks"), blocks.alias("devtools_blocks"))

    return let(script_texts(p), of)


def signal_table(pages: DataFrame, icons: DataFrame | None = None) -> DataFrame:
    """page, hostname, the five arrays, icon_brand and sensitive: what `rules.page_hits` reads.

    `icons` (page, icon_brand) says whose icon a page shows, where that is known.
    """
    kinds = lambda f: K.kind({a: f[a] for a in K.ATTRIBUTES})
    sensitive = F.exists(page_forms(F.col("p"), F.col("url")), lambda x: F.exists(x["fields"], lambda f: kinds(f).isin(*K.SENSITIVE)))
    rows = pages.select("page", U.host(F.col("url")).alias("hostname"), sensitive.alias("sensitive"), page_signals(F.col("p"), F.col("url")).alias("s"))
    rows = rows.select("page", "hostname", "sensitive", "s.*")
    return rows.join(icons.select("page", "icon_brand"), "page", "left") if icons is not None else rows.withColumn("icon_brand", F.lit(None).cast("string"))


# -- links

# Addresses and words of terms, of legal notices, and of privacy policies.
TERMS = r"(?i)terms|tos\b|(?:general|standard|website|site|use|service|sale|legal)\s*(?:&|and)?\s*conditions|conditions\s+(?:of|for)\s+(?:use|service|sale|access)|user.?agreement|end.?user|eula|service.?agreement|條款|使用者條款|服務條款|使用條款"
NOTICE = r"(?i)disclaimer|legal.?notices?|important.?notices?|notice.?of.?use|免責|法律聲明|重要告示|重要事項"
PRIVACY = r"(?i)privacy|data.?protection|cookie.?(?:policy|notice|statement)|personal.?data|私隱|隱私|個人資料|私穩"
LINK_CHARS = 120
LEAST_CHARS = 400


def links(p: Column, url: Column) -> Column:
    """array<struct<href, target, label, said, footer>> of a page's links in order.

    target is the address without query, null for others than http(s); label the link's own words with those for screen
    readers; said its text alone; footer whether it lies in the page's foot.
    """
    foot = lambda e: (e["tag"] == "footer") | (D.attr(e, "role") == "contentinfo") | (D.attr(e, "id") == "footer") | F.array_contains(F.split(D.attr(e, "class"), D.SPACE), "footer")

    def of(feet: Column) -> Column:
        def link(e: Column) -> Column:
            target = let(U.resolve(D.attr(e, "href"), url), lambda to: F.when(U.host(to).isNotNull(), U.strip_query(to)))
            label_ = lambda said: F.concat_ws(" ", D.trimmed(said), D.attr(e, "title"), D.attr(e, "aria-label"))
            within = F.exists(feet, lambda f: D.lies_in(e, f) | (e["id"] == f["id"]))
            return let(D.raw_text(p, e), lambda said: F.struct(D.attr(e, "href").alias("href"), target.alias("target"), label_(said).alias("label"), said.alias("said"), within.alias("footer")))

        return F.transform(D.elements(p, lambda e: (e["tag"] == "a") & D.has(e, "href")), link)

    return let(D.elements(p, foot), of)


def scored_links(links_: Column, url: Column) -> Column:
    """array<struct<minus, place, address>>: links of the same site that read like terms, the best first, each address once.

    A link in the foot has 2, one whose address says terms 1 more, a mere legal notice 5 less; equals keep their order.
    """
    usable = lambda x: (x["href"] != "") & ~x["href"].startswith("#") & ~x["href"].startswith("javascript:") & x["target"].isNotNull() & U.looks_same_site(U.host(x["target"]), U.host(url))

    def score(x: Column, place: Column) -> Column:
        # The place among all that are usable keeps the order.
        def of(path: Column) -> Column:
            terms = path.rlike(TERMS) | x["label"].rlike(TERMS)
            notice = path.rlike(NOTICE) | x["label"].rlike(NOTICE)
            points = F.when(x["footer"], 2).otherwise(0) + path.rlike(TERMS).cast("int") - F.when(terms, 0).otherwise(5)
            return F.when(terms | notice, F.struct((-points).alias("minus"), place.alias("place"), x["target"].alias("address")))

        return let(U.readable_path(x["target"]), of)

    ranked = F.array_sort(F.array_compact(F.transform(F.filter(links_, usable), score)))
    return let(ranked, lambda r: F.filter(r, lambda x, i: ~F.exists(F.slice(r, F.lit(1), i), lambda y: y["address"] == x["address"])))


def _policy(text: Column) -> Column:
    return text.rlike(TERMS) | text.rlike(NOTICE)


def links_a_policy(links_: Column) -> Column:
    """Whether any link reads like terms, a legal notice or a privacy policy."""
    tells = lambda text: let(text, lambda t: F.coalesce(_policy(t) | t.rlike(PRIVACY), F.lit(False)))
    return F.exists(links_, lambda x: tells(U.readable_path(x["target"])) | tells(F.substring(x["said"], 1, LINK_CHARS)))


def is_policy_page(url: Column, title: Column) -> Column:
    return _policy(F.coalesce(U.readable_path(url), url)) | _policy(title)


def publishes_no_terms(p: Column, url: Column, forms: Column, links_: Column) -> Column:
    """Whether a page on a public host asks for details, is no policy itself and links none."""
    host, title = U.host(url), D.title(p)
    public = host.contains(".") & ~host.rlike(r"^[\d.]+$") & ~host.contains(":")
    own = is_policy_page(url, title) | U.path(url).rlike(PRIVACY) | title.rlike(PRIVACY)
    return F.coalesce(asks_for_details(forms) & public & ~own & ~links_a_policy(links_), F.lit(False))


def terms_candidates(pages: DataFrame) -> DataFrame:
    """page, place, address, linked: where a page's terms may lie, best first: its scored links, then the usual addresses; each address once."""
    scored = scored_links(links(F.col("p"), F.col("url")), F.col("url"))
    guesses = F.coalesce(U.guessed_terms(F.col("url")), F.array().cast("array<string>"))
    linked = F.transform(scored, lambda x: x["address"])
    rows = pages.select("page", linked.alias("linked"), F.array_distinct(F.concat(linked, guesses)).alias("every"))
    rows = rows.select("page", F.size("linked").alias("n"), F.posexplode("every").alias("place", "address"))
    return rows.select("page", "place", "address", (F.col("place") < F.col("n")).alias("linked"))


def read_reason(status: Column, kind: Column, chars: Column, scripts: Column, cues: Column) -> Column:
    """Why an answer is no terms document; null for one that is.  A null status: nothing was reached."""
    return (
        F.when(status.isNull(), "fetch-failed")
        .when(~status.between(200, 299), "http-error")
        .when(~F.coalesce(kind.contains("html"), F.lit(False)), "not-html")
        .when((chars < LEAST_CHARS) & (scripts >= 1), "needs-javascript")
        .when(chars < LEAST_CHARS, "too-short")
        .when(cues < T.LEAST_CUES, "not-terms")
    )


def terms_found(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """page, address, place, tried, failures (array of struct place, address, reason; those before the address).

    `fetched` has one row for each address that was asked: address, status, kind (content type), chars, scripts, cues of
    its text.  The first candidate that reads like terms is taken; without one, address is null and all failures are there.
    """
    rows = terms_candidates(pages).join(fetched.dropDuplicates(["address"]), "address", "left")
    rows = rows.withColumn("reason", read_reason(*[F.col(c) for c in ("status", "kind", "chars", "scripts", "cues")]))
    # At most the links of a page and a few guesses.
    one = F.struct("place", "address", "reason")
    every = rows.groupBy("page").agg(F.array_sort(F.collect_list(one)).alias("every"))
    found = D.first(F.filter("every", lambda x: x["reason"].isNull()))
    every = every.withColumn("found", found)
    failures = F.filter("every", lambda x: F.col("found").isNull() | (x["place"] < F.col("found.place")))
    return every.select("page", F.col("found.address").alias("address"), F.col("found.place").alias("place"), F.size("every").alias("tried"), failures.alias("failures"))


#: Addresses that read like terms, when one of a site's documents is picked.
TERMS_LIKE = r"(?i)terms|tos|conditions|eula|legal|agreement|user-agreement"


def picked_documents(documents: DataFrame, hints: DataFrame) -> DataFrame:
    """Of each domain of `documents` (domain, url, created_at, others): the one that the first fitting hint (domain, place, url) names; else the newest that reads like terms; else the newest.

    Addresses fit by their key.  Of equals the least url.
    """
    keyed = hints.groupBy("domain", U.address_key(F.col("url")).alias("_key")).agg(F.min("place").alias("_place")).where("_key is not null")
    rows = documents.withColumn("_key", U.address_key(F.col("url"))).join(keyed, ["domain", "_key"], "left")
    like = F.coalesce(U.path(F.col("url")).rlike(TERMS_LIKE), F.lit(False))
    rank = Window.partitionBy("domain").orderBy(F.asc_nulls_last("_place"), F.when(F.col("_place").isNull() & ~like, 1).otherwise(0), F.desc("created_at"), "url")
    return rows.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n", "_key", "_place")
