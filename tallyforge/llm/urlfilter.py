"""URL filters: rules by host and path, and redirect equivalence.

Pages that redirects or canonical links join are aliases: connected components
carry a block from one alias to the others, unless one is explicitly allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import free_name, settle, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only tell where a visitor came from.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid)(=|$)"
#: A URL with a host, any scheme, a path with dot segments, and a comment.
ABSOLUTE, SCHEME, DOTS, COMMENT = "^[A-Za-z][A-Za-z0-9+.-]*://", "^[A-Za-z][A-Za-z0-9+.-]*:", r"/\.\.?(/|$)", r"(?s)<!--.*?(?:-->|\z)"
#: Rules up to which they are tried as one array; more are joined.
FEW = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def spelling(url: Column) -> Column:
    """One spelling for URLs that differ in scheme, fragment, tracking parameters or a last slash; null without a host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    plain = F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(host_of(url) == "", None).otherwise(F.when(kept == "", plain).otherwise(F.concat_ws("?", plain, kept)))


def with_rules(urls: DataFrame, rules: list[Rule], *, url: str = "url", into: str = "ruled", few: int = FEW) -> DataFrame:
    """``urls`` with a struct ``into`` of host, path, rule and verdict; the last two are null where no rule fits.

    A rule fits its host and all subdomains where the URL's path starts with
    the rule's. The longest rule (host and path) wins, allow before block.
    Many rules are joined on host suffixes and path prefixes of distinct URLs.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict, r.host, r.path))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    if len(ordered) <= few:
        picked = F.lit(None).cast("struct<rule:string,verdict:string>")
        if ordered:
            every = F.array(*(F.struct(F.lit(r.host).alias("h"), F.lit(r.path).alias("p"), F.lit(r.verdict).alias("v")) for r in ordered))
            at = F.struct(host.alias("host"), path.alias("path"))
            fits = F.transform(F.array(at), lambda u: F.filter(every, lambda r: ((u.host == r.h) | F.endswith(u.host, F.concat(F.lit("."), r.h))) & F.startswith(u.path, r.p)))
            first = F.try_element_at(F.element_at(fits, 1), F.lit(1))
            picked = F.when(first.isNotNull(), F.struct(F.concat(first.h, first.p).alias("rule"), first.v.alias("verdict")))
        return urls.withColumn(into, F.struct(host.alias("host"), path.alias("path"), picked.rule.alias("rule"), picked.verdict.alias("verdict")))
    spark = urls.sparkSession
    known = spark.createDataFrame([(r.host, r.path, r.verdict, i) for i, r in enumerate(ordered)], "rh string, rp string, verdict string, place int")
    lengths = sorted({len(r.path) for r in ordered})
    distinct = urls.select(F.col(url).alias("u")).where("u is not null").distinct().select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = distinct.withColumn("rh", F.explode(suffixes)).withColumn("n", F.explode(F.array(*map(F.lit, lengths))))
    keys = keys.where(F.char_length("path") >= F.col("n")).withColumn("rp", F.substr("path", F.lit(1), F.col("n")))
    best = keys.join(known, ["rh", "rp"]).groupBy("u").agg(F.min(F.struct("place", F.concat("rh", "rp").alias("rule"), "verdict")).alias("best"))
    key, found = free_name(urls, "u"), free_name(urls, "best")
    joined = urls.join(settle(best.select(F.col("u").alias(key), F.col("best").alias(found)), "rules"), urls[url] == F.col(key), "left")
    return joined.select(*(F.col(f"`{c}`") for c in urls.columns), F.struct(host.alias("host"), path.alias("path"), F.col(f"{found}.rule").alias("rule"), F.col(f"{found}.verdict").alias("verdict")).alias(into))


def _without_dots(path: Column) -> Column:
    """The path with its segments ``.`` and ``..`` carried out."""
    up = lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x))
    folded = F.aggregate(F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/"))), F.lit(""), up)
    return F.when(path.rlike(DOTS), F.concat(folded, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def resolved(to: Column, src: Column) -> Column:
    """The URL that ``to`` is on a page at ``src``; null where it leads to no other page (mailto:, #part)."""
    own = F.regexp_extract(to, "^[^?#]*", 0)
    scheme = F.regexp_extract(src, r"^([^:/?#]+):", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(src), r"^.*/", 0), F.lit("")), F.lit("/"))
    path = F.when(own == "", path_of(src)).when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(to.rlike(ABSOLUTE), to).when(to.rlike(SCHEME) | to.startswith("#"), None).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(src), _without_dots(path), F.substr(to, F.char_length(own) + 1)))
    )


def page_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): each page's canonical links and meta refreshes, made absolute by its first base, or its own URL.

    Comments hold no links. Pages without a URL, or without ``://`` in it, have none.
    """
    c = F.col
    shown = pages.select(c(url).alias("src"), c(html).alias("html")).where(F.contains("src", F.lit("://")) & c("html").rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    shown = shown.select("src", F.regexp_replace("html", COMMENT, "").alias("html"))
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    base = F.replace(F.regexp_extract("html", r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("&amp;"), F.lit("&"))
    found = shown.select("src", F.when(base != "", resolved(base, c("src"))).alias("base"), F.explode(tags).alias("tag"))
    canonical = F.when(c("tag").rlike(r"(?is)^<link.*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(c("tag").rlike(r"(?is)^<meta.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = found.select("src", "base", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> ''")
    return found.select("src", resolved(c("to"), F.coalesce("base", "src")).alias("dst")).where("dst is not null")


def judge_urls(pages: DataFrame, rules: list[Rule], *, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html", into: str = "judged", default: str = "allow") -> DataFrame:
    """``pages`` with a struct ``into`` of host, path, rule and verdict; a column that is called so is replaced.

    A page's own rule decides. Without one, its aliases do: allow if a rule
    allows any of them, else block if one blocks any, else ``default``. Aliases
    are URLs of one spelling (see ``spelling``), and URLs that redirects (src,
    dst) or the pages' canonical and refresh links join, through any number of
    steps; their targets count even where they aren't pages themselves. All of
    it is edges of one graph, from a URL to its spelling and from spelling to
    spelling, and the connected components carry the verdicts.

    A null URL or one without ``://`` has an empty host and path and no
    aliases. Repeated pages are judged each; other columns are kept.
    """
    c = F.col
    links = page_links(pages, url=url, html=html) if html else None
    if redirects is not None:
        links = redirects.select("src", "dst") if links is None else links.unionByName(redirects.select("src", "dst"))
    urls = pages.select(c(url).alias("url"))
    spelled = lambda x: F.concat(F.lit("="), spelling(c(x)))
    edges = None
    if links is not None:
        links = settle(links, "links")
        urls = urls.union(links.select("src")).union(links.select("dst"))
        edges = links.select(spelled("src").alias("src"), spelled("dst").alias("dst"))
    nodes = with_rules(urls.where(F.contains("url", F.lit("://"))).distinct(), rules)
    nodes = settle(nodes.select(F.concat(F.lit("u"), "url").alias("node"), spelled("url").alias("spelled"), "ruled.verdict").where("spelled is not null"), "nodes")
    own = nodes.select(c("node").alias("src"), c("spelled").alias("dst"))
    joined = settle(connected_components(own if edges is None else own.unionByName(edges)), "components")
    of = nodes.join(joined, c("node") == c("id"))
    classes = of.where("verdict is not null").groupBy("component").agg(F.bool_or(c("verdict") == "allow").alias("allow"))
    by_alias = of.where("verdict is null").join(settle(classes, "classes"), "component")
    node, ruled, alias = free_name(pages, "node"), free_name(pages, "ruled"), free_name(pages, "by_alias")
    verdicts = settle(by_alias.select(F.substr("node", F.lit(2)).alias(node), F.when(c("allow"), "allow").otherwise("block").alias(alias)), "verdicts")
    out = with_rules(pages, rules, url=url, into=ruled)
    out = out.join(verdicts, out[url] == c(node), "left")
    struct = F.struct(c(f"{ruled}.host").alias("host"), c(f"{ruled}.path").alias("path"), c(f"{ruled}.rule").alias("rule"), F.coalesce(c(f"{ruled}.verdict"), c(alias), F.lit(default)).alias("verdict"))
    return out.select(*(c(f"`{x}`") for x in pages.columns if x.lower() != into.lower()), struct.alias(into))


OP5_RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page with its rule and verdict."""
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), OP5_RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def _resolved_sql(to: str, src: str) -> str:
    rest = f"substr({src}, instr({src}, '://') + 3)"
    own, path, scheme = f"regexp_extract({to}, '^[^?#]*')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)", f"regexp_extract({src}, '^([^:/?#]+):', 1)"
    whole = f"CASE WHEN {own} = '' THEN {path} WHEN starts_with({own}, '/') THEN {own} ELSE coalesce(nullif(regexp_extract({path}, '^.*/'), ''), '/') || {own} END"
    folded = "list_reduce(list_concat([''], string_split(w, '/')[2:]), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END)"
    plain = f"(SELECT CASE WHEN regexp_matches(w, '{DOTS}') THEN {folded} || CASE WHEN regexp_matches(w, '/\\.\\.?$') THEN '/' ELSE '' END ELSE w END FROM (SELECT {whole} AS w))"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    return f"""CASE WHEN regexp_matches({to}, '{ABSOLUTE}') THEN {to} WHEN regexp_matches({to}, '{SCHEME}') OR starts_with({to}, '#') THEN NULL WHEN starts_with({to}, '//') THEN {scheme} || ':' || {to}
  ELSE {scheme} || '://' || {host} || {plain} || substr({to}, length({own}) + 1) END"""


OP5_SQL = rf"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
shown AS (SELECT url AS src, regexp_replace(html, '{COMMENT}', '', 'g') AS html FROM pages WHERE contains(url, '://')),
based AS (SELECT src, html, replace(regexp_extract(html, '(?is)<base\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') AS b FROM shown),
tags AS (SELECT src, coalesce(CASE WHEN b <> '' THEN {_resolved_sql("b", "src")} END, src) AS base, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM based),
raw AS (SELECT src, base, replace(CASE WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END, '&amp;', '&') AS too FROM tags),
links AS (SELECT src, dst FROM (SELECT src, {_resolved_sql("too", "base")} AS dst FROM raw WHERE too <> '') WHERE dst IS NOT NULL),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT dst FROM links),
parts AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls),
split AS (SELECT url, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid)(=|$)')), '&') AS q FROM parts),
ruled AS (SELECT url, host, path, CASE WHEN host = '' THEN NULL ELSE host || regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS node,
  (SELECT min_by(rh || rp, -1000 * length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  (SELECT min_by(verdict, -1000 * length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS own FROM split),
e AS (SELECT a.node AS i, b.node AS j FROM links JOIN ruled a ON a.url = src JOIN ruled b ON b.url = dst WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ways AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
reach AS (SELECT node AS i, node AS j FROM ruled WHERE node IS NOT NULL UNION SELECT reach.i, b.j FROM reach JOIN both_ways b ON b.i = reach.j),
alias AS (SELECT reach.i AS node, bool_or(own = 'allow') AS allow, bool_or(own = 'block') AS block FROM reach JOIN ruled ON ruled.node = reach.j GROUP BY 1)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule, coalesce(r.own, CASE WHEN alias.allow THEN 'allow' WHEN alias.block THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN ruled r USING (url) LEFT JOIN alias USING (node)
"""
