"""URL rules, spread over redirect and canonical-link aliases.  DataFrame functions only.

A rule is ``allow|block`` and a prefix ``host/path``; it fits its host and all subdomains where the URL's
path starts with its path, and the longest fitting rule decides (of equally long ones an allow).  URLs joined
by a redirect or canonical link are aliases: connected components over those edges carry decisions to members
without a rule of their own.  One explicit allow in a component outweighs its blocks; a component or URL
without any decision is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtrail.functions.text import let

from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column, host: Column, path: Column) -> Column:
    """What two spellings of one address share: scheme and host in lower case, path, query; no fragment.
    Null without a host."""
    query = F.regexp_extract(url, "^[^?#]*([?][^#]*)", 1)
    return F.when(host != "", F.concat(lower_ascii(F.substring_index(url, "://", 1)), F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def spelled(url: Column) -> Column:
    return let(F.struct(url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path")), lambda u: alias_key(u["url"], u["host"], u["path"]))


def deciding_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<n, allow, rule> of the longest rule that fits, null if none does; of equally long ones an allow, then
    the last in order.  The rules are one literal array, so the expression does not grow with them."""
    parts = [(kind, *rule.partition("/")) for kind, rule in rules]
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(slash + rest).alias("prefix"), F.lit(len(name + slash + rest)).alias("n"), F.lit(kind == "allow").alias("allow")) for kind, name, slash, rest in parts] or [F.lit(None).cast("struct<name:string,prefix:string,n:int,allow:boolean>")])
    fits = F.filter(known, lambda r: ((host == r["name"]) | F.endswith(host, F.concat(F.lit("."), r["name"]))) & F.startswith(path, r["prefix"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"), F.concat(r["name"], r["prefix"]).alias("rule"))))


def verdict_of(rule: Column) -> Column:
    return F.when(rule["allow"], "allow").when(~rule["allow"], "block")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, quoted or not; empty if absent."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def resolve(link: Column, page: Column) -> Column:
    """The absolute URL of a link on a page with the given scheme, host and folder."""
    root = F.concat(page["scheme"], F.lit("://"), page["host"])
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(page["scheme"], F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(root, F.when(page["folder"] == "", "/").otherwise(page["folder"]), link))
    )


def tag_link(tag: Column) -> Column:
    """Where a canonical link or refresh redirect points; null for other tags."""
    value = lambda name: attribute(tag, name)
    canonical = F.when(F.lower(tag).startswith("<link") & F.concat(F.lit(" "), F.lower(value("rel")), F.lit(" ")).contains(" canonical "), value("href"))
    refresh = F.when(F.lower(tag).startswith("<meta") & (F.lower(value("http-equiv")) == "refresh"), F.regexp_extract(value("content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1))
    return F.replace(F.trim(F.coalesce(canonical, refresh)), F.lit("&amp;"), F.lit("&"))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) alias keys joined by canonical links and refresh redirects, outside comments and scripts.  All is
    worked out within arrays before they are unnested: filters on the result cannot multiply the expressions."""
    has = F.col(html_col).rlike(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)")
    markup = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    links = F.filter(F.transform(F.regexp_extract_all(markup, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1), tag_link), lambda x: x != "")
    url = F.col(url_col)
    page = let(F.struct(url.alias("url"), F.substring_index(url, "://", 1).alias("scheme"), url_host(url).alias("host"), url_path(url).alias("path")), lambda u: F.struct(u["scheme"].alias("scheme"), u["host"].alias("host"), F.regexp_replace(u["path"], "[^/]*$", "").alias("folder"), alias_key(u["url"], u["host"], u["path"]).alias("key")))
    edges = let(page, lambda p: F.transform(links, lambda x: F.struct(p["key"].alias("a"), spelled(resolve(x, p)).alias("b"))))
    return pages.where(has & url.isNotNull()).select(F.explode(edges).alias("edge")).select("edge.*")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Per row: id, host, path, rule (the deciding rule, else null) and verdict.

    ``redirects``: further (source, target) URLs.  A null URL, or one without ``://``, has an empty host and
    path, no aliases and the default verdict.  Null html has no links.  Repeated rows stay repeated; other
    columns are ignored.  Empty input: no rows.
    """
    # Host and path are columns of their own before anything refers to them: written into each expression that
    # needs them the plan would outgrow what the JVM compiles.
    split = pages.select(F.col(id_col), F.col(url_col).alias("_url"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = split.select(id_col, "host", "path", deciding_rule(F.col("host"), F.col("path"), rules).alias("_rule"), alias_key(F.col("_url"), F.col("host"), F.col("path")).alias("_key"))
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        more = F.array(F.struct(spelled(F.col("source")).alias("a"), spelled(F.col("target")).alias("b")))
        edges = edges.unionByName(redirects.select(F.explode(more).alias("edge")).select("edge.*"))
    nodes = components(edges).withColumns({"host": url_host(F.col("node")), "path": url_path(F.col("node"))})
    decided = nodes.select("node", "component", verdict_of(deciding_rule(F.col("host"), F.col("path"), rules)).alias("own"))
    of_group = decided.groupBy("component").agg(F.min("own").alias("spread"))  # 'allow' sorts before 'block'
    aliases = decided.join(of_group, "component").where(F.col("spread").isNotNull()).select(F.col("node").alias("_key"), "spread")
    return judged.join(aliases, "_key", "left").select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(verdict_of(F.col("_rule")), "spread", F.lit("allow")).alias("verdict"))
