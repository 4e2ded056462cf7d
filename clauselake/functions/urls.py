"""Addresses and domains as columns.  Malformed addresses give null parts, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Public suffixes of two labels that are told apart; every other suffix is the last label.
SECOND_LEVEL = tuple(f"{a}.{b}" for b, firsts in {"uk": "co org gov ac net", "hk": "com org gov edu net idv", "au": "com org gov edu net", "jp": "co or ne ac go", "cn": "com org gov edu net", "tw": "com org gov edu net", "br": "com org gov net", "nz": "co org govt ac net", "in": "co org gov ac net", "za": "co org gov ac", "kr": "co or go ac", "sg": "com org gov edu net"}.items() for a in firsts.split())
TERMS_PATHS = ("/terms", "/terms-of-service", "/terms-of-use", "/tos", "/legal/terms", "/policies/terms", "/terms-and-conditions", "/legal")
WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?"


def _part(url: Column, i: int) -> Column:
    return F.when(url.rlike(WHOLE), F.regexp_extract(url, WHOLE, i))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower case; null without one, or for other schemes than http and https."""
    return F.when(scheme(url).isin("http", "https") & (_part(url, 2) != ""), F.lower(_part(url, 2)))


def path(url: Column) -> Column:
    return F.when(host(url).isNotNull(), F.when(_part(url, 4) == "", "/").otherwise(_part(url, 4)))


def port(url: Column) -> Column:
    """`:port` unless it is the scheme's own."""
    p = _part(url, 3)
    return F.when((p == "") | ((scheme(url) == "http") & (p == "80")) | ((scheme(url) == "https") & (p == "443")), "").otherwise(F.concat(F.lit(":"), p))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), port(url))


def _without_dots(path_: Column) -> Column:
    """A path from the root without its `.` and `..` parts."""
    dot, up = F.lit("."), F.lit("..")

    def of(parts: Column) -> Column:
        none = F.array().cast("array<string>")
        kept = F.aggregate(parts, none, lambda a, x: F.when(x == dot, a).when(x == up, F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))

    return let(path_, lambda p: F.when(p.contains("/."), let(F.split(F.substring(p, F.lit(2), F.length(p)), "/"), of)).otherwise(p))


def resolve(reference: Column, base: Column) -> Column:
    """The address that a reference on the page `base` leads to, with its query, without its fragment.

    Null where the base is no http(s) address and the reference needs one.  Addresses of other schemes are left as they are.
    """
    bare = F.regexp_replace(F.regexp_replace(reference, r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    hashless = F.regexp_replace(bare, "(?s)#.*$", "")

    # Each part is used many times: `let` keeps the expression small.
    def of(r: Column, front: Column, query: Column) -> Column:
        here = lambda p: F.concat(origin(base), _without_dots(p), query)
        whole = lambda u: let(u, lambda v: F.concat(origin(v), _without_dots(path(v)), query))
        folder = F.regexp_replace(path(base), "[^/]*$", "")
        return (
            F.when(front.rlike("^[Hh][Tt][Tt][Pp][Ss]?://"), whole(front))
            .when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), r)
            .when(front.startswith("//"), whole(F.concat(scheme(base), F.lit(":"), front)))
            .when((front == "") & (query == ""), F.concat(strip_query(base), F.regexp_extract(base, r"\?[^#]*", 0)))
            .when(front == "", F.concat(origin(base), path(base), query))
            .otherwise(here(F.when(front.startswith("/"), front).otherwise(F.concat(folder, front))))
        )

    def parted(r: Column) -> Column:
        front = F.translate(F.regexp_extract(r, r"^[^?]*", 0), "\\", "/")
        return let(front, lambda f: let(F.regexp_extract(r, r"(?s)\?.*$", 0), lambda q: of(r, f, q)))

    return F.when(reference.isNotNull() & base.isNotNull(), let(hashless, parted))


def strip_query(url: Column) -> Column:
    """Origin and path; a malformed address up to its query."""
    return F.coalesce(F.concat(origin(url), path(url)), F.regexp_replace(url, r"(?s)[?#].*$", ""))


def readable_path(url: Column) -> Column:
    """The path with its escapes decoded; left alone where they are malformed."""
    p = path(url)
    return F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)


def public_suffix(host_: Column) -> Column:
    """By the table above."""
    tail = F.substring_index(host_, ".", -2)
    return F.when(tail.isin(*SECOND_LEVEL), tail).otherwise(F.substring_index(host_, ".", -1))


def is_address(host_: Column) -> Column:
    """Numbers instead of a name."""
    return host_.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\[")


def registrable(host_: Column) -> Column:
    """The public suffix and one label more; the host itself where it has none."""
    def of(h: Column) -> Column:
        two = F.substring_index(h, ".", -2).isin(*SECOND_LEVEL)
        return F.when(is_address(h), h).when(two, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))

    return let(F.lower(host_), of)


def registrable_label(host_: Column) -> Column:
    """The label before the public suffix; null where there is none."""
    def of(h: Column) -> Column:
        r, s = registrable(h), public_suffix(h)
        return F.when(~is_address(h) & (r != s), F.substring_index(r, ".", 1))

    return let(F.lower(host_), of)


def is_public_host(host_: Column) -> Column:
    return F.coalesce(~is_address(host_) & host_.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$") & registrable_label(host_).isNotNull() & ~public_suffix(host_).isin("localhost", "invalid", "test", "local"), F.lit(False))


def policy_key(url: Column) -> Column:
    """The address that results are kept under: http(s), public host, no credentials, query or fragment; else null."""
    return F.when(is_public_host(host(url)), F.concat(origin(url), path(url)))


def address_key(url: Column) -> Column:
    """For matching: host without www., path without closing slashes."""
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""))


def policy_label(url: Column) -> Column:
    return F.coalesce(F.when(path(url) == "/", "/").otherwise(F.regexp_replace(path(url), "/$", "")), url)


def looks_same_site(a: Column, b: Column) -> Column:
    return (a == b) | (F.substring_index(a, ".", -2) == F.substring_index(b, ".", -2))


def same_site(a: Column, b: Column) -> Column:
    return registrable(a) == registrable(b)


def domain_candidates(typed: Column) -> Column:
    """What a search box's text may mean: its host and the parents of it, most specific first.

    Text that is no host name gives none.  Two labels of three and two letters at most, below others, look like a public suffix and are left out.
    """
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(typed, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    host_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[/?#].*$", ""), r":\d+$", ""), r"^www\.", "")

    def of(ls: Column) -> Column:
        tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ls) - 1, F.lit(1))), lambda i: F.slice(ls, i, F.size(ls)))
        suffix = lambda t: (F.size(ls) > 2) & (F.size(t) == 2) & (F.length(t[0]) <= 3) & (F.length(t[1]) == 2)
        return F.transform(F.filter(tails, lambda t: (F.size(t) > 1) & ~suffix(t)), lambda t: F.array_join(t, "."))

    valid = host_.rlike(r"^[a-z0-9.-]{1,253}$") & host_.contains(".")
    return F.when(valid, let(F.filter(F.split(host_, r"\."), lambda x: x != ""), of)).otherwise(F.array().cast("array<string>"))


def guessed_terms(url: Column) -> Column:
    return F.when(origin(url).isNotNull(), F.transform(F.array(*[F.lit(p) for p in TERMS_PATHS]), lambda p: F.concat(origin(url), p)))


def clean_upload_url(url: Column) -> Column:
    """Whether an address may be shared: http(s), no credentials, query or fragment."""
    return F.coalesce(host(url).isNotNull() & ~url.rlike(r"[?#]|^[a-z]+://[^/]*@"), F.lit(False))
