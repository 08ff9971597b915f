"""URL filters with redirect equivalence.

Host and path rules judge a url directly. Urls that redirect to each other or name each other as
canonical are one class, found as connected components; a url without a rule of its own takes the
decision of its class. An explicit allow anywhere in the class outweighs the blocks in it; it never
lifts a block that a url's own rule states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components

#: Fixed values: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
# Patterns that both Spark and DuckDB read.
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
URL_QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
CANONICAL_TAG = r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"
CANONICAL_URL = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, URL_PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What identifies a page: host, path and query; null if the url has no ``://``."""
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_extract(url, URL_QUERY, 1)))


def resolve(link: Column, url: Column) -> Column:
    """A link against the url of its page."""
    root = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link)).when(link.startswith("/"), F.concat(root, link))
        .when(link != "", F.concat(root, F.regexp_replace(path_of(url), "[^/]*$", ""), link))
    )


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits; of equally long ones allow comes first.
    The rules are literals in the plan, so they are for lists of a bounded size."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def links_of(html: Column) -> Column:
    return F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL_TAG, 1), CANONICAL_URL, 1), F.regexp_extract(F.regexp_extract(html, REFRESH_TAG, 1), REFRESH_URL, 1))


def judge_pages(spark: SparkSession, pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``page_id, url, html``.

    ``redirects``: further edges ``(source_url, target_url)``, of a crawl's log. Null urls and urls
    without ``://`` have an empty host and path and are allowed; null html has no links; repeated rows
    are judged each. Html is read once: what follows reads a narrow table in the shared folder. Edges,
    classes and decisions stay distributed."""
    scratch = Scratch(spark, "urls")
    url = F.col("url")
    m = match_rules(F.col("host"), F.col("path"), rules)
    page = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), F.filter(links_of(F.col("html")), lambda x: x != "").alias("links"))
    page = scratch.write(page.withColumn("m", m).select("page_id", "url", "host", "path", "node", "links", "m.rule", "m.verdict"), "pages")
    edges = page.select("url", F.explode("links").alias("link")).select(url.alias("s"), resolve(F.col("link"), url).alias("t"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("source_url").alias("s"), F.col("target_url").alias("t")))
    edges = edges.select(node_of(F.col("s")).alias("a"), node_of(F.col("t")).alias("b")).where("a is not null and b is not null")
    found = components(spark, edges, scratch)
    # rules fit every member of a class, pages of the table or not
    as_url = F.concat(F.lit("http://"), F.col("node"))
    ruled = found.select("node", "component", match_rules(host_of(as_url), path_of(as_url), rules)["verdict"].alias("v"))
    decided = ruled.groupBy("component").agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"))
    of_node = found.join(decided, "component").select("node", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("of_class"))
    out = page.drop("links", "url").join(of_node, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "of_class", F.lit("allow")).alias("verdict"))
