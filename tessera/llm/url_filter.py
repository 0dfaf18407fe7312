"""URL filters: rules by host and path, carried to aliases over redirect and canonical-link edges; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, by_hot_key, cut
from .components import components

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule (host and path prefix joined) and the verdict of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def address(url: Column) -> Column:
    """What names a document: host and path and query, without scheme and fragment; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def resolved(url: Column, to: Column) -> Column:
    """A link's target as an absolute url, as seen from the page at url; empty for one with another scheme than http and https, or to a place on the page."""
    scheme, authority = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    to_path, tail = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path_of(url), r"(?s)[^/]*$", ""), "^/", ""))
    full = F.when(to_path == "", path_of(url)).when(to_path.startswith("/"), to_path).otherwise(F.concat(folder, to_path))
    # dots go step by step; one at the end leaves a folder
    steps = F.split(F.regexp_replace(F.regexp_replace(full, r"(/\.\.?)$", "$1/"), "^/", ""), "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    path = F.when(full == "", "").otherwise(F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")))
    away = F.when(authority == "", "").otherwise(F.concat(scheme, F.lit("://"), authority, path, tail))
    return (
        F.when(to.rlike("(?i)^https?://"), to).when(to.rlike("^#|^$") | to.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "")
        .when(to.startswith("//"), F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"), to))).otherwise(away)
    )


def alias_urls(url: Column, html: Column) -> Column:
    """Urls a page says are its own: rel=canonical links and meta refresh targets, resolved against its url, and the target in a redirecting url's query."""
    tags = F.coalesce(F.regexp_extract_all(html, F.lit(r"(?i)(<link\s[^>]*rel=[\"']?canonical[\"']?[^>]*>|<meta\s[^>]*http-equiv=[\"']?refresh[\"']?[^>]*>)"), 1), F.array().cast("array<string>"))
    said = F.transform(tags, lambda t: resolved(url, F.regexp_extract(t, r"(?i)(?:href=[\"']?|url=[\"']?)([^\"'\s>]+)", 1)))
    query = F.regexp_extract(url, r"(?i)[?&](?:url|redirect|redirect_to|redirect_uri|target|dest)=(https?(?:://|%3A%2F%2F)[^&#]+)", 1)
    query = F.regexp_replace(F.regexp_replace(F.coalesce(query, F.lit("")), "(?i)%3A", ":"), "(?i)%2F", "/")
    return F.filter(F.concat(said, F.array(query)), lambda x: x != "")


def url_filter(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """For every row of pages (page_id, url, html): page_id, host, path, rule, verdict, alias_verdict.

    A page's own rule decides first. Without one its class of aliases decides: urls connected by redirect and canonical-link edges, in
    either direction, pages or not. An explicit allow anywhere in the class wins over a block; with neither the default holds.
    A null url, or one without ://, has an empty host and path, no rule and no aliases; null html has no links; repeated rows are each judged; an
    empty table gives an empty one; other columns of pages are not looked at. Rules are a stated list, tried from the longest.
    """
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    edges = pages.select(address(url).alias("own"), F.explode(alias_urls(url, F.col("html"))).alias("to")).select("own", address(F.col("to")).alias("to"), F.col("to").alias("to_url")).where("own is not null and to is not null and own != to")
    edges = cut(edges.select("own", "to").distinct())
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), address(url).alias("own")).withColumns({"rule": rule, "ruled": verdict})
    if not edges.limit(1).count():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("alias_verdict"))
    # classes are of the addresses themselves: two strangers never share one, as hashes of them might
    classes = components(edges, "own", "to").select(F.col("node").alias("name"), "component")
    member = classes.withColumns({"host": F.regexp_extract("name", r"(?s)^([^/?#]*)", 1), "path": F.regexp_extract("name", r"(?s)^[^/?#]*([^?]*)", 1)})
    member = member.withColumn("ruled", verdict)
    decided = member.groupBy("component").agg(F.max(F.col("ruled") == "allow").alias("a"), F.max(F.col("ruled") == "block").alias("b"))
    decided = decided.select("component", F.when(F.col("a"), "allow").when(F.col("b"), "block").alias("alias_verdict")).where("alias_verdict is not null")
    by_name = cut(member.select("name", "component").join(decided, "component").select(F.col("name").alias("own"), "alias_verdict"))
    return by_hot_key(judged, by_name, "own").select("page_id", "host", "path", "rule", F.coalesce("ruled", "alias_verdict", F.lit(default)).alias("verdict"), "alias_verdict")
