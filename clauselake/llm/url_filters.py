"""URL filters over redirect equivalence.

Pages that redirect or name a canonical address are aliases of it.  Connected components over these edges carry block
decisions from any alias to all others; an explicit allow in the component, or the url's own rule, takes precedence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER
from .components import connected_components

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
REFRESH_URL = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule whose host is `host` or a parent of it and whose path begins `path`; null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.named_struct(F.lit("rule"), F.lit(rule_host + rule_path), F.lit("verdict"), F.lit(verdict))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What names a url among its aliases: host, path (at least /) and query; neither scheme nor fragment.  Null without a host."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def resolved(target: Column, url: Column) -> Column:
    """An address as the page at `url` means it."""
    scheme, root = F.regexp_extract(url, "(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(root, F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), "[^/]*$", ""))
    target = F.regexp_replace(F.trim(target), "&amp;", "&")
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(root, target)).when(target != "", F.concat(folder, target))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v) of canonical links and refreshes; a page whose text names neither is not parsed."""
    html = pages[html_col]
    tags = F.regexp_extract_all(html, F.lit(TAGS), F.lit(0))
    href = lambda t: F.concat(*[F.regexp_extract(t, HREF, i) for i in (1, 2, 3)])
    targets = F.concat(
        F.transform(F.filter(tags, lambda t: t.rlike(CANONICAL) & t.rlike("(?i)^<link")), href),
        F.transform(F.filter(tags, lambda t: t.rlike(REFRESH) & t.rlike("(?i)^<meta")), lambda t: F.regexp_extract(t, REFRESH_URL, 1)),
    )
    named = pages.where(html.rlike("(?i)canonical|http-equiv")).select(pages[url_col].alias("url"), F.explode(targets).alias("target")).where("target <> ''")
    return named.select(node_of(F.col("url")).alias("u"), node_of(resolved(F.col("target"), F.col("url"))).alias("v")).where("u is not null and v is not null and u <> v")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, keep: Sequence[str] = ("page_id",), default: str = "allow", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The `keep` columns with host, path, rule and verdict.

    The url's own rule decides; else its component: allow if any alias has an allow rule, block if any has a block
    rule; else `default`.  Aliases that were never fetched count too.  `redirects` (source, target) adds edges.  A null
    url, or one without ://, has empty host and path, no rule and the default; null html names no alias; repeated
    pages are each judged; an empty table gives an empty one.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")))
    parts = connected_components(edges)
    url = F.concat(F.lit("x://"), F.col("node"))
    ruled = parts.withColumn("own", matching_rule(host_of(url), path_of(url), rules)["verdict"])
    decided = ruled.groupBy("component").agg(F.max(F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1)).alias("top"))
    aliases = parts.join(decided.where("top is not null"), "component").select(F.col("node").alias("_node"), F.when(F.col("top") == 2, "allow").otherwise("block").alias("_alias"))
    rows = pages.select(*[pages[c] for c in keep], host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"), node_of(pages[url_col]).alias("_at"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules)).join(aliases, F.col("_at") == F.col("_node"), "left")
    return rows.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_alias", F.lit(default)).alias("verdict"))
