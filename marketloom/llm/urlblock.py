"""URL filters: host and path rules, and block decisions that reach aliases over redirect and canonical-link edges.

DataFrame functions only. Aliases are the connected components of the graph whose edges are a page's canonical link
and its refresh redirect. A url with a rule of its own has that rule's verdict (so an explicit allow stands within a
blocked component); a url without one is blocked if any url of its component has a block rule, else allowed.

Defined results: a null url or one without `://` has an empty host and path, no rule, and is allowed unless its page
declares a blocked alias; repeated rows and urls get equal rows; an empty table gives none; a very long page is one row
throughout; other columns, whatever their names, are ignored. Of rules of equal length the one with the longer host
wins, of equal rules block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_hot, materialize


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules that the query states.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path, and key: the url without scheme and fragment, host lower-cased (null without a host)."""
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    key = F.when(host != "", F.concat(ascii_lower(host), F.regexp_extract(tail, r"^[^#]*", 0)))
    return df.withColumns({"host": ascii_lower(host), "path": path, "key": key})


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, own) for the urls(host, path, key) that a rule of rules(verdict, host, path) fits; own: struct(text, verdict).

    A rule is found by equality: each suffix of a host meets the path lengths that the rules of that suffix have, and
    so many characters of the path, behind the suffix, are the key of the rules. A url has a row for each of those lengths,
    not for each rule, and lists of any length take the same way. A suffix such as a country's, or a common path, has a
    large part of all urls: both are joined as hot keys."""
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    one = urls.where("key is not null").groupBy("key").agg(F.min("host").alias("host"), F.min("path").alias("path"))
    one = materialize(one.select("key", "path", F.explode(suffixes).alias("at")), "url-suffixes")
    hosts = rules.groupBy(F.col("host").alias("at")).agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
    hosts = materialize(hosts.join(one.groupBy("at").agg(F.count("*").alias("urls")), "at"), "url-rule-hosts")
    asked = join_hot(one, hosts, "at", "urls", one.count()).select("key", "at", "path", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    asked = materialize(asked.select("key", F.concat("at", F.substring("path", F.lit(1), F.col("n"))).alias("text")), "url-prefixes")
    known = rules.groupBy(F.concat("host", "path").alias("text")).agg(F.max("verdict").alias("verdict"), F.max(F.length("host")).alias("size"))
    known = materialize(known.join(asked.groupBy("text").agg(F.count("*").alias("urls")), "text"), "url-rules")
    hit = join_hot(asked, known, "text", "urls", asked.count())
    return hit.groupBy("key").agg(F.max_by(F.struct("text", "verdict"), F.struct(F.length("text"), "size", "verdict")).alias("own"))


def with_rule(urls: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """urls(host, path, key, ...), a written table, with own: struct(text, verdict) of the longest rule that fits, or null."""
    table = urls.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    sizes = urls.where("key is not null").groupBy("key").agg(F.count("*").alias("_loom_n"))
    found = materialize(match_rules(urls, table).join(sizes, "key"), "url-found")
    known = join_hot(urls.where("key is not null"), found, "key", "_loom_n", urls.count(), how="left").drop("_loom_n")
    return known.unionByName(urls.where("key is null").withColumn("own", F.lit(None).cast("struct<text:string,verdict:string>")))


def _absolute(link: Column, url: Column, host: Column) -> Column:
    """A link as an absolute url; relative links are resolved against the page."""
    scheme = F.regexp_extract(url, r"^(?s)(.*?)://", 1)
    base = F.regexp_extract(url, r"^[^?#]*?://[^?#]*/", 0)
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(F.contains(link, F.lit("://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(F.when(F.regexp_extract(base, r"://.", 0) != "", base).otherwise(F.concat(root, F.lit("/"))), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): url keys that a page's canonical link or refresh redirect declares to be one resource."""
    html = F.coalesce("html", F.lit(""))
    tags = F.when(html.rlike("(?i)canonical|http-equiv"), F.regexp_extract_all(html, F.lit("(?is)<(?:link|meta)\\b[^>]*>"), F.lit(0)))
    tag = with_parts(pages.select("url", tags.alias("tags")).where(F.size("tags") > 0)).where("key is not null")
    tag = tag.select("url", "host", F.col("key").alias("a"), F.explode("tags").alias("tag"))
    canonical = F.col("tag").rlike("(?i)^<link\\b") & F.col("tag").rlike("(?i)\\brel\\s*=\\s*[\"']?[^\"'>]*\\bcanonical\\b")
    href = F.regexp_extract("tag", "(?i)\\bhref\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)", 1)
    refresh = F.col("tag").rlike("(?i)^<meta\\b") & F.col("tag").rlike("(?i)\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b")
    target = F.regexp_extract("tag", "(?i)\\burl\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)", 1)
    link = F.replace(F.when(canonical, href).when(refresh, target), F.lit("&amp;"), F.lit("&"))
    out = tag.select("a", _absolute(link, F.col("url"), F.col("host")).alias("to")).where(link.isNotNull() & (link != ""))
    return with_parts(out, "to").select("a", F.col("key").alias("b")).where("b is not null and a <> b").distinct()


def blocked_aliases(pages: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame | None:
    """(key, pages): urls with pages in the table whose component holds a blocked url; None without links."""
    edges = materialize(alias_edges(pages), "alias-edges")
    if edges.isEmpty():
        return None
    comps = connected_components(edges, "alias")
    nodes = materialize(with_parts(comps.select(F.concat(F.lit("x://"), "node").alias("u"), "node", "component"), "u"), "alias-nodes")
    blocked = with_rule(nodes, rules).where(F.col("own.verdict") == "block").select("component").distinct()
    hit = comps.join(blocked, "component", "left_semi").select(F.col("node").alias("key"))
    here = with_parts(pages.select("url")).where("key is not null").groupBy("key").agg(F.count("*").alias("pages"))
    return materialize(here.join(hit, "key"), "alias-blocked")


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_blocked."""
    judged = with_rule(materialize(with_parts(pages.select("page_id", "url")).drop("url"), "url-parts"), rules)
    hit = blocked_aliases(pages, rules)
    if hit is None:
        marked = judged.withColumn("alias_blocked", F.lit(False))
    else:
        hit = hit.withColumn("hit", F.lit(True))
        marked = join_hot(judged.where("key is not null"), hit, "key", "pages", judged.count(), how="left").drop("pages")
        marked = marked.unionByName(judged.where("key is null").withColumn("hit", F.lit(False)))
        marked = marked.withColumn("alias_blocked", F.coalesce("hit", F.lit(False)))
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("alias_blocked"), "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", F.col("own.text").alias("rule"), verdict.alias("verdict"), "alias_blocked")
