"""URL rules with redirect equivalence.

An explicit rule decides the pages that it fits. The rest follow their
aliases: canonical-link and refresh-redirect edges join urls into components,
found by distributed connected components, and a block on one member reaches
all, unless a member is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize, read
from .graph import connected_components

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Up to so many rules are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 50_000

# Quantifiers of groups are possessive: the regex engine then loops, where it would else recurse and retry.
_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
#: What isn't markup: comments, and the text of elements that hold no tags.
_HIDDEN = rf"""(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b(?:[^"'>]++|{_QUOTED})*+>.*?(?:</\1\b|\z)"""
_TAG = rf"""(?i)<(?:link|meta)\b(?:[^"'>]++|{_QUOTED})*+"""
#: A name, and the value that it may have, quoted or not.
_ATTRIBUTE = rf"""[^\s"'<>/=]++(?:\s*+=\s*+(?:{_QUOTED}|[^\s"'>]++)?+)?+"""
_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
#: Basic entities; that of ``&`` comes last, so that no text is decoded twice.
ENTITIES = (("lt|#0*60|#x0*3c", "<"), ("gt|#0*62|#x0*3e", ">"), ("quot|#0*34|#x0*22", '"'), ("apos|#0*39|#x0*27", "'"), ("amp|#0*38|#x0*26", "&"))


def _value(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name, without its quotes and the blanks around it; null where there is none."""
    own = F.get(F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    return F.trim(F.regexp_replace(F.regexp_replace(own, r"(?s)^[^=]*+=\s*+", ""), r"""^["']|["']$""", ""))


def links_of(html: Column) -> Column:
    """Every canonical link and refresh target of a page, in an array, entities decoded.

    ``rel`` is a list of words; of a repeated attribute the first counts; what comments, scripts, styles, titles and text areas hold is no tag.
    """
    tags = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, ""), F.lit(_TAG), F.lit(0))

    def decoded(link: Column) -> Column:
        for names, char in ENTITIES:
            link = F.regexp_replace(link, f"(?i)&(?:{names});", char)
        return link

    canonical = F.filter(tags, lambda t: t.rlike("(?i)^<link") & F.coalesce(_value(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"), F.lit(False)))
    refresh = F.filter(tags, lambda t: t.rlike("(?i)^<meta") & F.coalesce(F.lower(_value(t, "http-equiv")) == "refresh", F.lit(False)))
    links = F.concat(F.transform(canonical, lambda t: F.regexp_extract(_value(t, "href"), r"^\S+", 0)), F.transform(refresh, lambda t: F.regexp_extract(_value(t, "content"), _URL, 1)))
    return F.transform(F.filter(links, lambda link: link != ""), decoded)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    step = lambda seen, part: F.when(part == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(1)))).when(part == ".", seen).otherwise(F.concat(seen, F.array(part)))
    # A last dot segment leaves the folder's slash.
    parts = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")).otherwise(path)


def node_of(url: Column) -> Column:
    """What tells urls apart: host, path without dot segments and a last slash, and query; null where there is no ``://``."""
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.regexp_replace(without_dots(path_of(url)), "/$", ""), query))


def resolve(base: Column, link: Column) -> Column:
    """A link's absolute url: absolute, //host, /path, ?query, or relative to the base's folder; null for a mere fragment and for other schemes."""
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    here = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(link.startswith("#"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(here, link))
        .when(link.startswith("?"), F.concat(here, path_of(base), link))
        .otherwise(F.concat(here, F.when(folder == "", "/").otherwise(folder), link))
    )


def match_rules(urls: DataFrame, key: str, host: str, path: str, rules: DataFrame, n_rules: int, depth: int) -> DataFrame:
    """(key, rule, rule_verdict) of each key that a rule fits: the longest, and of equals ``allow``. No rule's host has more than ``depth`` labels."""
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - depth + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.where(F.col(host) != "").select(key, path, F.explode(suffixes).alias("rule_host"))
    fit = parts.join(F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules, "rule_host").where(
        F.col(path).startswith(F.col("rule_path"))
    )
    best = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), (F.col("rule_verdict") == "allow").alias("a"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"))
    return fit.groupBy(key).agg(best.alias("b")).select(key, "b.rule", "b.rule_verdict")


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row (id, url, host, path, rule, verdict, node, component) per row of ``pages``.

    A null url, or one without ``://``, has empty host and path, fits no rule
    and has no aliases: it is allowed. Null or empty html gives no edges. Rows
    that repeat are judged alike and all returned.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")
    depth = max((h.count(".") + 1 for h, *_ in rules), default=1)
    url = F.col("url")
    html = F.coalesce(F.col(html_col), F.lit("")) if html_col else F.lit("")
    base = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        links_of(html).alias("links"),
    )
    base = base.select("id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), "links")
    links = base.where("node is not null").select("node", "url", F.explode("links").alias("link")).select("node", resolve(url, F.col("link")).alias("target"))
    edges = materialize(links.where("target is not null").select(F.col("node").alias("a"), node_of(F.col("target")).alias("b"), "target").distinct(), "aliases")
    members = connected_components(edges)
    # Verdicts of whole components come from every url in them, crawled or not.
    ends = edges.select(F.col("b").alias("node"), host_of(F.col("target")).alias("host"), without_dots(path_of(F.col("target"))).alias("path")).unionByName(
        base.where("node is not null").join(members.select("node"), "node", "left_semi").select("node", "host", "path")
    ).distinct().withColumn("key", F.struct("node", "host", "path"))
    ruled = match_rules(ends, "key", "host", "path", table, len(rules), depth).select(F.col("key.node").alias("node"), "rule_verdict")
    groups = members.join(ruled, "node").groupBy("component").agg(
        F.when(F.max((F.col("rule_verdict") == "allow").cast("int")) == 1, "allow").otherwise("block").alias("group_verdict")
    )
    aliases = materialize(members.join(groups, "component", "left"), "alias-verdicts")
    for used in (edges, members):
        discard(used)
    own = match_rules(base.select(F.struct("host", "path").alias("key"), "host", "path").distinct(), "key", "host", "path", table, len(rules), depth).select(
        F.col("key.host").alias("host"), F.col("key.path").alias("path"), "rule", "rule_verdict"
    )
    return (
        base.join(own, ["host", "path"], "left")
        .join(aliases, "node", "left")
        .select("id", "url", "host", "path", "rule", F.coalesce("rule_verdict", "group_verdict", F.lit("allow")).alias("verdict"), "node", F.coalesce("component", "node").alias("component"))
    )


def op10_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return filter_urls(read(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "component"
    )
