"""Pages that lead to pages: candidates, frontiers, streaks, detail pages.

Fetching is a source's work. Here a captured page table stands for it, and
every round is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, url

def links(pages: DataFrame) -> DataFrame:
    """(src, dst, seq): absolute links of each page to its own host, in order; fragments go."""
    hrefs = F.regexp_extract_all("text", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'#]+)"), 1)
    found = pages.select(F.col("url").alias("src"), F.posexplode(hrefs).alias("seq", "href"))
    h, s = F.replace(F.trim("href"), F.lit("&amp;"), F.lit("&")), F.col("src")
    folder = F.concat(url.root(s), F.coalesce(F.nullif(F.regexp_extract(url.path(s), r"^.*/", 0), F.lit("")), F.lit("/")))
    to = F.when(h.rlike("^[a-z]+://"), h).when(h.startswith("//"), F.concat(url.scheme(s), F.lit(":"), h)).when(h.startswith("/"), F.concat(url.root(s), h)).when(h.startswith("?"), F.concat(url.root(s), url.path(s), h)).when(h.rlike("^[a-z]+:"), None).otherwise(F.concat(folder, h))
    return found.select("src", to.alias("dst"), "seq").where(url.domain(F.col("dst")) == url.domain(F.col("src")))


def candidate_score(link: Column, php_domains: list[str] | None = None) -> Column:
    """How promising a page is as a listing; ``php_domains`` list their products on pages that end in .php."""
    low = F.lower(F.coalesce(link, F.lit("")))
    worth = lambda test, n: F.when(test, n).otherwise(0)
    parts = [worth(text.has_any(low, words), n) for words, n in fixed.CANDIDATE_PARTS]
    # A page that is a price list both by a part and by its end counts once.
    prices = text.has_any(low, ["/pages/pricing"])
    ends = [worth(low.endswith(end) & ~(prices if end == "/pricing" else F.lit(False)), n) for end, n in fixed.CANDIDATE_ENDS]
    php = worth(url.domain(link).isin(php_domains or []) & low.endswith(".php"), 1)
    return sum((*parts, *ends, php), F.lit(0))


def top_candidates(candidates: DataFrame, n: int, php_domains: list[str] | None = None) -> DataFrame:
    """The ``n`` most promising pages of each domain; of equals the first."""
    scored = candidates.withColumn("score", candidate_score(F.col("url"), php_domains)).withColumn("domain", url.domain(F.col("url")))
    w = Window.partitionBy("domain").orderBy(F.desc("score"), "seq")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def next_frontier(found: DataFrame, visited: DataFrame) -> DataFrame:
    """Targets that weren't visited, once each."""
    return found.select(F.col("dst").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")


def reachable(pages: DataFrame, start: DataFrame, rounds: int, settle=None) -> DataFrame:
    """(url, depth): pages within ``rounds`` links of the start, by breadth-first rounds of joins.

    ``settle`` writes a round's table and reads it back, so that the plan
    doesn't grow with the rounds; by default it is a reliable checkpoint.
    """
    settle = settle or (lambda df: df.checkpoint())
    edges = settle(links(pages).select("src", "dst").distinct())
    seen = settle(start.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, rounds + 1):
        step = edges.join(frontier.select(F.col("url").alias("src")), "src")
        frontier = settle(next_frontier(step, seen).withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = settle(seen.unionByName(frontier))
    return seen


def streak_cut(probes: DataFrame, stop: int, key: list[str], order: list[str], miss: str = "miss") -> DataFrame:
    """Each key's probes up to the first run of ``stop`` misses in a row, that run included."""
    w = Window.partitionBy(*key).orderBy(*order)
    island = probes.withColumn("_i", F.sum(F.when(F.col(miss), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = island.withColumn("_n", F.sum(F.when(F.col(miss), 1).otherwise(0)).over(Window.partitionBy(*key, "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.max(F.when(F.col("_n") >= stop, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return run.withColumn("_over", before).where("_over = 0").withColumn("streak", F.col("_n").cast("bigint")).drop("_i", "_n", "_over")


def detail_pages(products: DataFrame, n: int, *, recheck_out: bool = False, recheck_in: bool = False, cycles: bool = False) -> DataFrame:
    """(url, priority, first, ids): the pages worth fetching for what rows lack, the ``n`` first by priority and place.

    0: availability is unknown or to be checked again; 1: cycles or their
    prices are missing (if asked for); 2: the location is.
    """
    c = F.col
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    stock = c("available").isNull() | (F.lit(recheck_out) & F.coalesce(~c("available"), F.lit(False))) | (F.lit(recheck_in) & F.coalesce("available", F.lit(False)))
    lacks = F.lit(cycles) & (empty(c("billing_cycles")) | empty(F.map_keys("cycle_prices")))
    nowhere = F.coalesce("location", F.lit("")) == ""
    wanted = products.where(c("url").rlike("^https?://")).withColumn("priority", F.when(stock, 0).when(lacks, 1).when(nowhere, 2)).where("priority is not null")
    per = wanted.groupBy("url").agg(F.min("priority").alias("priority"), F.min("seq").alias("first"), F.count("*").alias("rows"))
    return per.orderBy("priority", "first").limit(n)


def enrich(products: DataFrame, details: DataFrame) -> DataFrame:
    """Products with what their detail pages say: details has url, available, billing_cycles, cycle_prices and locations (name, available).

    Pages that sell nothing only tell availability. The first of several
    locations stays with the row; each other one becomes a row of its own, its
    id ending in ``::loc-<slug>``.
    """
    c = F.col
    d = details.select("url", F.struct(*(x for x in details.columns if x != "url")).alias("d"))
    j = products.join(d, "url", "left")
    sells = c("d").isNotNull() & ~url.non_product_page(c("url"))
    spots = F.when(sells, c("d.locations")).otherwise(F.array().cast("array<struct<name:string,available:boolean>>"))
    j = j.withColumn("spot", F.explode_outer(F.when(F.coalesce(F.size(spots), F.lit(0)) > 0, F.transform(spots, lambda x, i: F.struct(i.alias("i"), x["name"].alias("name"), x["available"].alias("available"))))))
    j = j.where("spot is null or spot.i = 0 or spot.name <> ''")
    other = F.coalesce(c("spot.i") > 0, F.lit(False))
    fresh = {
        "id": F.when(other, F.concat("id", F.lit("::loc-"), text.slugify(c("spot.name")))).otherwise(c("id")),
        "available": F.coalesce("spot.available", "d.available", "available"),
        "billing_cycles": F.when(sells, F.coalesce("billing_cycles", "d.billing_cycles")).otherwise(c("billing_cycles")),
        "cycle_prices": F.when(sells, F.coalesce("cycle_prices", "d.cycle_prices")).otherwise(c("cycle_prices")),
        "location": F.coalesce("spot.name", "location"),
    }
    return j.select(*(fresh.get(x, c(x)).alias(x) for x in products.columns))
