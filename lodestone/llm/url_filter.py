"""URL filters by redirect equivalence, DataFrame operations only.

Rules fit a host with its subdomains and a prefix of the path; the longest decides. Pages also state aliases: a canonical
link or a refresh redirect (outside comments, its address with character references read and dots resolved) names another
address, and addresses that differ only in scheme, fragment, a trailing slash
or tracking parameters are one. Connected components over these edges carry a block from any address that a rule
blocks to every address of its component that no rule decides; an explicit allow, like any rule of one's own, takes
precedence over what aliases would bring. Addresses without a rule and without a blocked alias are allowed.

Defined results: a url that is null or has no :// has empty host and path, no aliases and the verdict allow; null html has
no links, and neither have tags without an address; tags may have any length; repeated rows get the same verdict each; of
rules of the same length, block comes before allow; an empty table gives no rows; columns other than page_id, url and
html, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: Query parameters that only track where a visitor came from.
TRACKING = r"(?:utm_\w+|gclid|fbclid|mc_cid|mc_eid)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address without what makes no difference; null where there is no host."""
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1), rf"(?<=[?&]){TRACKING}=[^&]*&?", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+\z", ""), r"/+(?=\?|\z)", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def _unescaped(t: Column) -> Column:
    """Character references that addresses in html are written with."""
    for form, char in (("&(?:quot|#34|#x22);", '"'), ("&(?:apos|#39|#x27);", "'"), ("&(?:lt|#60|#x3c);", "<"), ("&(?:gt|#62|#x3e);", ">"), ("&(?:#47|#x2f);", "/"), ("&(?:amp|#38|#x26);", "&")):
        t = F.regexp_replace(t, "(?i)" + form, char)
    return t


def _undotted(url: Column) -> Column:
    """An address without . and .. in its path."""
    top, path = F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.array_append(done, part))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*[^?#]*(.*)", 1)
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), F.concat(top, F.lit("/"), F.array_join(kept, "/"), rest)).otherwise(url)


def _links(url: Column, html: Column) -> Column:
    """Addresses that a page names as its own: canonical links and refresh redirects outside comments, made absolute."""
    shown = F.when(html.contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(html)
    whole = F.regexp_extract_all(shown, F.lit(r"(?is)(<(?:link|meta)\b[^>]*+>)"), F.lit(1))
    canonical = r"""(?is)\A<link\b.*?[\s"'/]rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
    refresh = r"""(?is)\A<meta\b.*?[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b"""
    tags = F.filter(whole, lambda t: t.rlike(canonical) | t.rlike(refresh))
    href, to = r"""(?is)[\s"'/]href\s*=\s*["']?\s*([^"'\s>]+)""", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""
    named = F.transform(tags, lambda t: _unescaped(F.when(t.rlike(r"(?i)\A<link\b"), F.regexp_extract(t, href, 1)).otherwise(F.regexp_extract(t, to, 1))))
    scheme, top = F.regexp_extract(url, r"\A([^:/?#]*)://", 1), F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1)
    whole_path, folder = F.regexp_extract(url, r"(?s)\A(.*?://[^?#]*)", 1), F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*(?:[^?#]*/)?)", 1)

    def absolute(t: Column) -> Column:
        return _undotted(
            F.when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .when(t.startswith("/"), F.concat(top, t))
            .when(t.startswith("?"), F.concat(whole_path, t))
            .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), t))
        )

    return F.when(top != "", F.transform(F.filter(named, lambda t: (t != "") & ~t.startswith("#")), absolute))


def matched(places: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(host, path, rule, own) of distinct places that a rule fits. rules: (allow or block, host/path)."""
    spark = places.sparkSession
    split = [(verdict, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in rules]
    known = spark.createDataFrame(split or [("", "", "", "")], "own string, rule string, rule_host string, prefix string").where("own <> ''")
    distinct = places.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    probes = distinct.where("host <> ''").select("host", "path", F.explode(tails).alias("rule_host"))
    hits = probes.join(known, "rule_host").where(F.col("path").startswith(F.col("prefix")))
    best = F.max(F.struct(F.length("rule").alias("n"), F.when(F.col("own") == "block", 1).otherwise(0).alias("b"), "rule", "own")).alias("m")
    return hits.groupBy("host", "path").agg(best).select("host", "path", "m.rule", "m.own")


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, component (its least address, null without host) of each row of pages (page_id, url, html)."""
    url = F.col("url")
    read = materialize(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), _links(url, F.col("html")).alias("links")))
    link = F.col("link")
    targets = read.select("node", F.explode("links").alias("link")).select("node", node_of(link).alias("to"), host_of(link).alias("host"), path_of(link).alias("path")).where("to IS NOT NULL")
    named = targets.select(F.col("to").alias("node"), "host", "path")
    places = read.select("node", "host", "path").union(named).distinct()
    ruled = materialize(matched(places, rules))
    component = connected_components(targets.where("node <> to").select(F.col("node").alias("u"), F.col("to").alias("v")).distinct())
    # a component is blocked if a rule blocks one of its addresses; other addresses are components of their own
    blocked = places.join(ruled.where("own = 'block'").select("host", "path").hint("merge"), ["host", "path"], "left_semi").where("node IS NOT NULL").select("node").distinct()
    # every join below that grows with the pages is by sorted partitions: none of its sides is sent whole to all tasks
    component = materialize(component)
    of = blocked.join(component.hint("merge"), "node", "left").select(F.coalesce("component", "node").alias("component")).distinct().withColumn("bad", F.lit(True))
    nodes = read.select("node").where("node IS NOT NULL").distinct().join(component.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")).join(of.hint("merge"), "component", "left")
    out = read.select("page_id", "host", "path", "node").join(ruled.hint("merge"), ["host", "path"], "left").join(nodes.hint("merge"), "node", "left")
    verdict = F.coalesce("own", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
