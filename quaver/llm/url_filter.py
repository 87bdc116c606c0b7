"""URL rules with redirect equivalence.

1. A rule names a host, a path prefix and a verdict. It fits its host and all
   subdomains where the path starts with its own; the longest that fits decides.
2. Redirects (refreshes in the page, or a table of them) and canonical links, all that
   a page has, say that two URLs are the same page. The aliases of a page are its connected component.
3. A URL that no rule decides takes its component's decision: an explicit allow among
   the aliases comes first, then a block; without either it is allowed. A rule that
   fits the URL itself always stands, so an allowed URL is never blocked through an alias.

Everything is DataFrame operations. Only URLs are shuffled, never pages; the rules are a
constant map inside the projection.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
and has no aliases. A page without HTML has no links. Links that name no URL, or
are not to a web page, are left out. Very long URLs and pages are read whole. Repeated
rows are judged alike. Of rules of one length that fit, the last by name decides. An
empty table gives an empty one. Extra columns are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import materialize

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_GOES_TO = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The URL as an alias: host in lower case, no fragment; null for what is no URL."""
    before = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(before.rlike("(?s)://.+"), F.concat(F.translate(before, _UPPER, _LOWER), F.when(tail == "", "/").otherwise(tail)))


def decide(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for h, p, v in rules:
        by_host.setdefault(h.translate(str.maketrans(_UPPER, _LOWER)), []).append((h, p, v))
    one = lambda h, p, v: F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
    table = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*(one(*r) for r in own)))))
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(above, lambda h: F.try_element_at(table, h)), lambda x: x.isNotNull())), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(F.size(fits) > 0, F.struct(best["size"].alias("size"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _absolute(link: Column, page: Column) -> Column:
    link = F.regexp_replace(link, "&amp;", "&")
    base = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(page, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.substring_index(page, "://", 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, F.when(path == "", "/").otherwise(path), link))
        .when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^[?#]"), F.concat(base, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): redirects and canonical links of the pages, as aliases."""
    each = lambda tags, link: F.transform(F.regexp_extract_all(F.col(html), F.lit(tags), F.lit(0)), lambda t: F.regexp_extract(t, link, 1))
    targets = F.filter(F.concat(each(_CANONICAL, _HREF), each(_REFRESH, _GOES_TO)), lambda x: x != "")
    linked = materialize(pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).alias("u"), F.explode(targets).alias("l")), "links")
    known = materialize(linked.select(node_of(F.col("u")).alias("src"), _absolute(F.col("l"), F.col("u")).alias("l")).select("src", node_of(F.col("l")).alias("dst")), "aliases")
    return known.where("src is not null and dst is not null and src <> dst")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) for every row. redirects: further (src, dst) URLs.

    alias_of: the smallest URL of the page's component, null where it has no alias.
    """
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    comps = materialize(connected_components(edges), "components")
    ruled = comps.withColumn("v", decide(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    verdicts = ruled.groupBy("component").agg(F.bool_or(F.col("v") == "allow").alias("a"), F.bool_or(F.col("v") == "block").alias("b"))
    passed = F.when(F.coalesce("a", F.lit(False)), "allow").when(F.coalesce("b", F.lit(False)), "block").otherwise("allow")
    aliases = comps.join(verdicts, "component").select("node", F.col("component").alias("alias_of"), passed.alias("passed"))
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.coalesce(url, F.lit(""))).alias("host"), path_of(F.coalesce(url, F.lit(""))).alias("path"), node_of(F.col(url)).alias("__node"))
    rows = rows.withColumn("__r", decide(F.col("host"), F.col("path"), rules))
    out = rows.join(aliases, F.col("__node") == F.col("node"), "left")
    return out.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), F.coalesce(F.col("__r.verdict"), F.col("passed"), F.lit("allow")).alias("verdict"), "alias_of")
