"""Rules on forms and pages: hits with their points, scores and verdicts.  Tables in, one row a form or page out; a hit is its id and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as K
from ..functions import urls as U
from .lookalikes import icon_matches

# Endings that are cheap to register, blocks of the developer tools that tell, and hits that a page without a form may be judged by.
CHEAP = ("top", "xyz", "tk", "cf", "gq", "ml", "ga", "buzz", "click", "link", "work", "rest", "cyou", "icu", "sbs", "lol", "quest", "monster", "shop", "live")
TELLING_BLOCKS = ("debugger_loop", "devtools_key_block", "devtools_detect_lib", "devtools_size_probe", "console_suppression")
STANDALONE = ("telegram_bot_token", "favicon_brand_mismatch", "exfil_sink_endpoint")
DANGER, CAUTION, MANY, ICON_GATE = 60, 30, 8, 15
HITS = "array<struct<id: string, points: int>>"


def _hits(*rules: tuple[str, int, Column]) -> Column:
    """The hits of rules (id, points, whether it holds) in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(id_).alias("id"), F.lit(points).alias("points"))) for id_, points, holds in rules])).cast(HITS)


def total(hits: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(hits, F.lit(0), lambda a, h: a + h["points"]))


def sinks_left(sinks: Column) -> Column:
    """Sinks besides a bot's token, which stands for its own address, too."""
    token = F.array_contains(sinks, "telegram_bot_token")
    return F.when(token, F.array_except(sinks, F.array(F.lit("telegram_bot_token"), F.lit("telegram_bot_api")))).otherwise(sinks)


def is_sensitive(kinds: Column) -> Column:
    return F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in K.SENSITIVE]))


def personal_count(kinds: Column) -> Column:
    return F.size(F.filter(kinds, lambda k: k.isin(*K.PERSONAL)))


def escalates(score: Column, threshold: float) -> Column:
    return score >= threshold


def reportable(exfil_sinks: Column, devtools_blocks: Column) -> Column:
    """Whether a page's signals hold anything to tell."""
    return (F.size(exfil_sinks) > 0) | (F.size(devtools_blocks) > 0)


def _page_hits(allowed: Sequence[str], third_parties: Sequence[str]) -> Column:
    """The hits of a row of `page_hits` whose registrable domain is in _site."""
    site = F.col("_site")
    empty = F.array().cast("array<string>")
    of = {c: F.coalesce(c, empty) for c in ("icon_urls", "referenced_hosts", "sending_hosts", "exfil_sinks", "devtools_blocks")}
    foreign = F.filter(F.array_distinct(F.concat(of["sending_hosts"], of["referenced_hosts"])), lambda h: (U.registrable(h) != site) & ~U.registrable(h).isin(*third_parties))
    telling = F.arrays_overlap(of["devtools_blocks"], F.array(*[F.lit(b) for b in TELLING_BLOCKS]))
    hits = _hits(
        ("telegram_bot_token", 40, F.array_contains(of["exfil_sinks"], "telegram_bot_token")),
        ("exfil_sink_endpoint", 35, F.size(sinks_left(of["exfil_sinks"])) > 0),
        ("sensitive_post_third_party", 20, F.col("sensitive") & (F.size(foreign) > 0)),
        ("favicon_brand_mismatch", 35, F.col("icon_brand") != site),
        ("favicon_hotlinked", 15, F.exists(of["icon_urls"], lambda u: F.coalesce(U.registrable(U.host(u)) != site, F.lit(False)))),
        ("devtools_blocked", 25, telling),
        ("right_click_blocked", 5, ~telling & F.array_contains(of["devtools_blocks"], "contextmenu_block")),
    )
    return F.when(site.isin(*allowed), F.array().cast(HITS)).otherwise(hits)


def page_hits(pages: DataFrame, allowed: Sequence[str] = (), third_parties: Sequence[str] = ()) -> DataFrame:
    """page, hits of `pages`: page, hostname, icon_urls, referenced_hosts, sending_hosts, exfil_sinks, devtools_blocks (arrays),
    icon_brand (the domain whose icon it shows; null: none) and sensitive (whether a form asks for such data).

    Allowed sites (registrable domains) have none; `third_parties` are domains that any site may talk to.
    """
    return pages.withColumn("_site", U.registrable(F.col("hostname"))).select("page", _page_hits(allowed, third_parties).alias("hits"))


def form_hits(forms: DataFrame, fields: DataFrame, pages: DataFrame, brands: DataFrame, lookalikes: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """page, form, own (its own hits), known (the site of a brand), free (an allowed site) of each of `forms`; see `forms_scored`."""
    asked = fields.groupBy("page", "form").agg(F.collect_list(K.kind({a: F.col(a) for a in K.ATTRIBUTES})).alias("kinds"))
    like = lookalikes.select(F.col("host").alias("hostname"), F.lit(True).alias("_like")).distinct()
    known = brands.select(F.col("domain").alias("_site"), F.lit(True).alias("_known")).distinct()
    rows = forms.join(pages.select("page", "hostname", "is_https").withColumn("_site", U.registrable(F.col("hostname"))), "page").join(asked, ["page", "form"], "left")
    rows = rows.join(known, "_site", "left").join(like, "hostname", "left")
    rows = rows.withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    has = lambda k: F.array_contains("kinds", k)
    own = _hits(
        ("lookalike_domain", 35, F.col("_like")),
        ("password_over_http", 30, has("password") & ~F.col("is_https")),
        ("credit_card_fields", 25, has("credit_card") | has("card_cvv")),
        ("national_id_field", 25, has("national_id")),
        ("bank_account_field", 25, has("bank_account")),
        ("cross_origin_action", 20, F.col("action_origin").isNotNull()),
        ("identity_triplet", 15, has("full_name") & has("dob") & has("address")),
        ("many_personal_fields", 10, personal_count(F.col("kinds")) > MANY),
        ("suspicious_tld_login", 10, U.public_suffix(F.col("hostname")).isin(*CHEAP) & has("password")),
    )
    return rows.select("page", "form", own.alias("own"), F.coalesce("_known", F.lit(False)).alias("known"), F.coalesce(F.col("_site").isin(*allowed), F.lit(False)).alias("free"))


def _judged(before: Column, own: Column, known: Column, free: Column) -> tuple[Column, Column, Column]:
    """Score, hits and verdict of a form, the page's hits first."""
    none = F.array().cast(HITS)
    hits = F.concat(F.coalesce(before, none), own)
    score = total(hits)
    note = F.when(known & (score >= DANGER), F.array(F.struct(F.lit("known_brand_domain").alias("id"), F.lit(0).alias("points")))).otherwise(none)
    verdict = F.when((score >= DANGER) & ~known, "danger").when(score >= CAUTION, "caution").otherwise("safe")
    return F.when(free, 0).otherwise(score).alias("score"), F.when(free, none).otherwise(F.concat(hits, note)).alias("hits"), F.when(free, "safe").otherwise(verdict).alias("verdict")


def forms_scored(forms: DataFrame, fields: DataFrame, pages: DataFrame, brands: DataFrame, lookalikes: DataFrame, hits: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """page, form, score, hits, verdict of each of `forms` (page, form, action_origin: null for the page's own).

    `fields` has page, form and the six attributes; `pages` page, hostname, is_https; `brands` domain; `lookalikes`
    host (see `lookalikes`); `hits` page, hits, which come before the form's.  The site of a brand itself is never
    judged worse than caution.
    """
    rows = form_hits(forms, fields, pages, brands, lookalikes, allowed).join(hits.select("page", F.col("hits").alias("_before")), "page", "left")
    return rows.select("page", "form", *_judged(F.col("_before"), F.col("own"), F.col("known"), F.col("free")))


def _alone(hits: Column) -> tuple[Column, Column, Column]:
    """Score, hits and verdict of a page by its own hits."""
    telling = F.filter(hits, lambda h: h["id"].isin(*STANDALONE))
    certain = F.exists(telling, lambda h: h["id"] == "telegram_bot_token") | (F.size(telling) >= 2)
    none = F.size(telling) == 0
    return (
        F.when(none, 0).otherwise(total(hits)).alias("score"), F.when(none, F.array().cast(HITS)).otherwise(hits).alias("hits"),
        F.when(none, "safe").when(certain, "danger").otherwise("caution").alias("verdict"),
    )


def standalone(hits: DataFrame) -> DataFrame:
    """page, score, hits, verdict of pages judged by their own `hits`: only with one of STANDALONE, danger with a bot's token or two of them."""
    return hits.select("page", *_alone(F.col("hits")))


def pages_assessed(scored_forms: DataFrame, hits: DataFrame) -> DataFrame:
    """page, form, score, hits, verdict: the worst form of each page (largest score, the first of equals); without forms, the page by itself (form null)."""
    worst = scored_forms.groupBy("page").agg(F.min(F.struct((-F.col("score")).alias("minus"), "form")).alias("w")).select("page", "w.form")
    best = scored_forms.join(worst, ["page", "form"])
    alone = standalone(hits).join(worst, "page", "left_anti").withColumn("form", F.lit(None).cast(scored_forms.schema["form"].dataType))
    return best.unionByName(alone.select(*best.columns))


def _worst(forms: Column, before: Column) -> Column:
    """The form, score, hits and verdict of the worst of a page's `forms` (see `form_hits`) that are not safe, the first of equals; null without any."""
    def judged(f: Column) -> Column:
        score, hits, verdict = _judged(before, f["own"], f["known"], f["free"])
        return F.struct(score, (-f["form"]).alias("minus"), f["form"].alias("form"), hits, verdict)

    return F.array_max(F.filter(F.transform(forms, judged), lambda f: f["verdict"] != "safe"))


def assessed(signals: DataFrame, found: DataFrame, icons: DataFrame, known: DataFrame, allowed: Sequence[str] = (), third_parties: Sequence[str] = ()) -> DataFrame:
    """page, form, score, hits, verdict, asked of every page: what a reader is told once its icon is known.

    `signals` is as in `page_hits`, one row a page, without icon_brand; `found` are the forms (see `form_hits`).  Only a page
    that has said something already, by a form that is not safe or a hit of its own, has its icon looked up (asked): the
    first of its icon_urls that `icons` (url, hash; null where it could not be read; one row a url) knows.  A brand of `known`
    (brand: a domain, hash) whose icon that is alone counts as a hit, and forms and page are scored again.  The worst form
    that is not safe is told, else the page by itself (form null), which may be safe.  An address or icon that is null or
    unknown matches nothing; a page without a number is left out.
    """
    forms = found.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("form", "own", "known", "free"))).alias("_forms"))
    kept = ["page", "hostname", "icon_urls", "referenced_hosts", "sending_hosts", "exfil_sinks", "devtools_blocks", "sensitive"]
    rows = signals.where("page is not null").select(*kept).withColumn("_site", U.registrable(F.col("hostname"))).join(forms, "page", "left")
    rows = rows.withColumn("icon_brand", F.lit(None).cast("string")).withColumn("_hits", _page_hits(allowed, third_parties))
    said = F.coalesce(_worst(F.col("_forms"), F.col("_hits"))["score"] >= ICON_GATE, F.lit(False)) | (F.size("_hits") > 0)
    rows = rows.withColumn("asked", said).drop("_hits", "icon_brand")
    # Rows without an address or a hash get a key of their own, which meets nothing and spreads.
    lone = lambda c: F.coalesce(c, F.concat(F.lit("page "), F.col("page").cast("string")))
    wanted = rows.select("*", F.posexplode_outer(F.when(F.col("asked"), F.col("icon_urls"))).alias("_place", "_url")).withColumn("_url", lone(F.col("_url")))
    hashes = icons.where("url is not null and hash is not null").select(F.col("url").alias("_url"), F.lower("hash").alias("_hash"))
    read = wanted.join(hashes, "_url", "left")
    first = F.min(F.when(F.col("_hash").isNotNull(), F.struct("_place", "_hash")))["_hash"]
    rest = [c for c in rows.columns if c != "page"]
    rows = read.groupBy("page").agg(first.alias("_hash"), F.any_value(F.struct(*rest)).alias("_row")).select("page", lone(F.col("_hash")).alias("_hash"), "_row.*")
    distinct = hashes.select(F.col("_hash").alias("icon"), F.col("_hash").alias("hash")).distinct()
    brands = icon_matches(distinct, known.select("brand", F.lower("hash").alias("hash"))).select(F.col("icon").alias("_hash"), F.col("brand").alias("icon_brand"))
    rows = rows.join(brands, "_hash", "left").withColumn("_hits", _page_hits(allowed, third_parties)).withColumn("_form", _worst(F.col("_forms"), F.col("_hits")))
    score, hits, verdict = _alone(F.col("_hits"))
    form = found.schema["form"].dataType
    alone = F.struct(score, F.lit(None).cast(form).alias("form"), hits, verdict)
    told = F.struct(*[F.col(f"_form.{c}").alias(c) for c in ("score", "form", "hits", "verdict")])
    return rows.withColumn("_told", F.when(F.col("_form").isNotNull(), told).otherwise(alone)).select("page", "_told.form", "_told.score", "_told.hits", "_told.verdict", "asked")
