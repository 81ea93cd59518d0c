"""Pages found by links: candidates of a page, and crawls with a budget for each target.

A crawl goes breadth-first over all targets at once: a round asks for what
every target has queued, in the order of its queue, and decides by running
counts where each target stops. A queue is first in, first out, so rounds give
what one page after another would. A target's round holds no more pages than
its budget, which bounds what one task orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, url
from ..functions.availability import any_out
from ..functions.text import either, has_any
from ..sources import html
from . import crawl, filters

#: Candidates that a page may have.
MOST_LINKS = 40
#: The place of a page's usual entries: behind all links.
LATE = 1 << 30


def hrefs(els: Column) -> Column:
    """The addresses in a page's elements (see ``html.linked``): of anchors in order, then quoted ones of click handlers that look like pages of a shop."""
    anchors = F.transform(F.filter(els, lambda e: (e["tag"] == "a") & (F.coalesce(html.attr(e, "href"), F.lit("")) != "")), lambda e: html.attr(e, "href"))
    handlers = F.transform(F.filter(els, lambda e: html.attr(e, "onclick").isNotNull()), lambda e: F.regexp_extract_all(html.attr(e, "onclick"), F.lit("['\"]([^'\"]+)['\"]"), 1))
    tokens = F.transform(F.flatten(handlers), F.trim)
    return F.concat(anchors, F.filter(tokens, lambda t: t.rlike("^(https?://|/)") | has_any(F.lower(t), fixed.CLICK_HINTS)))


def listing_link(link: Column, depth: Column, php: Column) -> Column:
    """Whether an address is that of a listing: a category of a store, cart or product tree no deeper than it may be, a group, or a price list.

    Rules are tried in order, the first that applies decides. ``depth``: levels
    below a cart; ``php``: whether the site lists products on pages that end in
    .php.
    """
    low, p, q = F.lower(link), F.lower(url.path(link)), F.lower(url.query(link))
    has = lambda c, w: F.contains(c, F.lit(w))
    levels = lambda c: F.size(F.filter(F.split(c, "/"), lambda x: x != ""))
    below = lambda marker: levels(F.substr(p, F.instr(p, F.lit(marker)) + len(marker)))
    rp = url.param(link, "rp")
    route = F.btrim(F.substring_index(F.regexp_extract(low, r"(?s)\?/cart/(.*)$", 1), "&", 1), F.lit("/"))
    slashes = F.char_length(route) - F.char_length(F.replace(route, F.lit("/"), F.lit("")))
    return (
        F.when(has_any(low, fixed.NO_LISTING_PARTS), False)
        .when(has(low, "rp=/store"), ~F.coalesce(rp.startswith("/store/"), F.lit(False)) | (levels(rp) <= 2))
        .when(has(p, "/store/"), below("/store/") <= 1)
        .when(has(low, "?/cart/"), slashes <= depth)
        .when(has(p, "/cart/"), below("/cart/") <= depth)
        .when((F.regexp_replace(p, "/+$", "") == "/cart") & has_any(q, ["cat_id=", "fid=", "gid="]), True)
        .when(has(p, "/products/"), below("/products/") <= 1)
        .when(has(low, "cart.php") & (has(low, "gid=") | low.endswith("/cart.php")), True)
        .when(has(p, "/pages/pricing") | p.endswith("/pricing"), True)
        .otherwise(php & p.endswith(".php") & ~has(p, "/billing/") & p.rlike(either(fixed.PHP_LISTING_PARTS)))
    )


def candidate_pages(pages: DataFrame, *, most: int = MOST_LINKS, most_of: dict[str, int] | None = None, php_domains: list[str] | None = None, hostbill_domains: list[str] | None = None) -> DataFrame:
    """(url, place, link, score): the listings that each page of ``pages`` (url, text) links to, the best and then the first ones first.

    Only links to the page's own host count, and not the page itself. A page
    without any that looks like one of a WHMCS shop has that platform's usual
    entries. ``most_of`` has other bounds than ``most`` by domain. Pages that
    are there repeatedly unite; a null address or text has no links. Markup
    stays where it is: only addresses are exploded and grouped.
    """
    c = F.col
    given = pages.where(c("url").isNotNull() & c("text").isNotNull()).select("url", "text", url.domain(c("url")).alias("domain"))
    low = F.lower("text")
    shop = F.contains(low, F.lit("whmcs")) | has_any(F.lower("url"), ["rp=/login", "/login"])
    depth = F.when(filters.hostbill_shop(c("domain"), c("text"), hostbill_domains), 2).otherwise(1)
    seen = given.withColumns({"els": html.linked(c("text")), "depth": depth, "shop": shop}).select("url", "domain", "depth", "shop", hrefs(c("els")).alias("hrefs"))
    usual = F.array(*(F.struct(F.lit(i + LATE).alias("seq"), F.lit(p).alias("href")) for i, p in enumerate(fixed.WHMCS_ENTRIES)))
    told = F.concat(F.transform("hrefs", lambda h, i: F.struct(i.alias("seq"), F.trim(h).alias("href"))), F.when(c("shop"), usual).otherwise(F.array().cast("array<struct<seq:int,href:string>>")))
    rows = seen.select("url", "domain", "depth", F.explode(told).alias("h")).select("url", "domain", "depth", "h.*")
    rows = rows.where(~c("href").rlike("^(#|javascript:|$)")).withColumn("link", url.resolve(c("url"), c("href")))
    rows = rows.where((url.domain(c("link")) == c("domain")) & (c("link") != c("url")))
    late = c("seq") >= LATE
    rows = rows.where(late | listing_link(c("link"), c("depth"), c("domain").isin(php_domains or [])))
    found = rows.groupBy("url", "domain", "link").agg(F.min("seq").alias("seq"))
    of = Window.partitionBy("url")
    found = found.withColumn("first", F.min("seq").over(of)).where((c("first") >= LATE) | ~late).withColumn("score", crawl.candidate_score(c("link"), php_domains))
    bound = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in (most_of or {}).items() for x in kv)), c("domain")), F.lit(most)) if most_of else F.lit(most)
    return found.withColumn("place", F.row_number().over(of.orderBy(F.desc("score"), "seq"))).where(c("place") <= bound).select("url", "place", "link", "score")


#: What a target may spend (0: no bound, but for max_pages): columns of its row.
BUDGETS = ("max_pages", "max_products", "stop_no_new", "stop_errors")


def platform_budgets(platform: Column) -> dict[str, Column]:
    """The usual budgets: shops of a known platform get more pages, and no streak stops them."""
    known = platform.isin("whmcs", "hostbill")
    return {
        "max_pages": F.when(platform == "whmcs", 128).when(platform == "hostbill", 96).otherwise(40), "max_products": F.lit(2000),
        "stop_no_new": F.when(known, 0).otherwise(12), "stop_errors": F.when(known, 0).otherwise(12), "strict": ~known,
    }


def crawl_targets(targets: DataFrame, extra: DataFrame, candidates: DataFrame) -> DataFrame:
    """Targets (domain, base_url, platform) with their queue and the usual budgets of their platform.

    A queue holds a domain's given pages (``extra``: domain, url, seq), then the
    listings that its first page links to (``candidates``: url, link, place),
    then the usual entry points; each address once, at its first place, and not
    the first page itself.
    """
    c = F.col
    base = targets.select("domain", "base_url", "platform")
    given = extra.select("domain", F.lit(0).alias("kind"), c("seq").cast("bigint").alias("nr"), "url")
    led = candidates.join(base.select("domain", c("base_url").alias("url")), "url").select("domain", F.lit(1).alias("kind"), c("place").cast("bigint").alias("nr"), c("link").alias("url"))
    usual = base.select("domain", F.posexplode(url.entry_points(c("base_url"))).alias("nr", "url")).select("domain", F.lit(2).alias("kind"), c("nr").cast("bigint").alias("nr"), "url")
    every = given.unionByName(led).unionByName(usual).where(F.coalesce("url", F.lit("")) != "")
    first = every.groupBy("domain", "url").agg(F.min(F.struct("kind", "nr")).alias("at"))
    queues = first.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x.url).alias("queue"))
    out = base.join(queues, "domain", "left").withColumn("queue", F.filter(F.coalesce("queue", F.array().cast("array<string>")), lambda u: u != c("base_url")))
    return out.select("domain", "base_url", "queue", *(v.alias(k) for k, v in platform_budgets(F.coalesce("platform", F.lit(""))).items()))


@dataclass
class Crawl:
    """targets: (domain, pages, errors, found, new_pages, reason); visits: (domain, place, url, ok, new); products: (domain, id, available, name)."""

    targets: DataFrame
    visits: DataFrame
    products: DataFrame


def budgeted_crawl(targets: DataFrame, source: Callable[[DataFrame], DataFrame], known: DataFrame, *, settle: Callable[[DataFrame], DataFrame] | None = None) -> Crawl:
    """Visit what is queued and what it links to, until a budget of the target is spent.

    ``targets``: domain (one row each), base_url, queue (addresses in order),
    max_pages, max_products, stop_no_new, stop_errors, strict. ``source`` gives
    (domain, url, ok, final_url, products array of (id, available, name), links
    in order) for (domain, url); an address without an answer has failed.
    ``known``: (domain, id, available, name) found before.

    reason: max_products once so many products are known; no_new_pages_streak
    and fetch_error_streak after so many pages in a row without a new product,
    or failed ones, if the last is a main listing (a target that isn't strict
    goes on after failures while its queue holds more); max_pages if pages are
    left; else queue_exhausted. A product seen more than once is out of stock
    if any sight says so, else in stock if any does; its name is the last one
    that isn't empty. ``settle`` as in ``hidden.scan_hidden_ids``.
    """
    settle = settle or (lambda df: df.checkpoint())
    c = F.col
    targets = settle(targets.select("domain", "base_url", "queue", *(F.coalesce(b, F.lit(0)).cast("bigint").alias(b) for b in BUDGETS), F.coalesce("strict", F.lit(True)).alias("strict")))
    queue = targets.select("domain", "base_url", F.posexplode("queue").alias("place", "url")).where((c("url") != "") & (c("url") != c("base_url")))
    frontier = settle(queue.groupBy("domain", "url").agg(F.min("place").alias("place")))
    seen = frontier.select("domain", "url").unionByName(targets.select("domain", c("base_url").alias("url")))
    sights = [settle(known.select("domain", "id", "available", "name", F.lit(0).cast("bigint").alias("at"), F.lit(-1).alias("i")))]
    had = settle(sights[0].select("domain", "id").distinct())
    zero = F.lit(0).cast("bigint")
    state = settle(
        targets.join(had.groupBy("domain").agg(F.count("*").alias("found")), "domain", "left")
        .select("domain", *BUDGETS, "strict", zero.alias("pages"), zero.alias("errors"), F.coalesce("found", zero).alias("found"), zero.alias("new_pages"), zero.alias("error_streak"), zero.alias("no_new_streak"), F.lit(None).cast("string").alias("reason"))
    )
    visits: list[DataFrame] = []
    order = Window.partitionBy("domain").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    while True:
        level = frontier.join(state.where("reason is null"), "domain")
        if level.isEmpty():
            break
        level = level.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("place")).cast("bigint")).withColumn("size", F.count("*").over(Window.partitionBy("domain")))
        level = level.where(c("pages") + c("n") <= c("max_pages"))
        rows = settle(level.join(source(level.select("domain", "url")), ["domain", "url"], "left").withColumn("ok", F.coalesce("ok", F.lit(False))))
        shown = rows.where("ok").select("domain", "n", F.posexplode("products").alias("i", "p")).select("domain", "n", "i", "p.*")
        fresh = shown.groupBy("domain", "id").agg(F.min("n").alias("n")).join(had, ["domain", "id"], "left_anti")
        new = fresh.groupBy("domain", "n").agg(F.count("*").alias("new"))
        leads = rows.where("ok").select("domain", "n", F.posexplode("links").alias("i", "url")).where("url <> ''")
        leads = settle(leads.groupBy("domain", "url").agg(F.min(F.struct("n", "i")).alias("at")).join(seen, ["domain", "url"], "left_anti"))
        led = leads.groupBy("domain", c("at.n").alias("n")).agg(F.count("*").alias("led"))
        r = rows.join(new, ["domain", "n"], "left").join(led, ["domain", "n"], "left").fillna(0, ["new", "led"])
        place = F.max(F.when(c("ok"), c("n"))).over(upto)
        r = r.withColumn("error_run", F.when(c("ok"), 0).otherwise(F.coalesce(c("n") - place, c("error_streak") + c("n"))))
        # Failed pages are neither new nor old: only the others count for this streak.
        r = r.withColumn("fine", F.count_if("ok").over(upto))
        reset = F.max(F.when(c("ok") & (c("new") > 0), c("fine"))).over(upto)
        r = r.withColumns({"old_run": F.coalesce(c("fine") - reset, c("fine") + c("no_new_streak")), "total": c("found") + F.sum("new").over(upto), "more": (c("n") < c("size")) | (F.coalesce(F.sum("led").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)})
        full = lambda run, stop: (c(stop) > 0) & (c(run) >= c(stop))
        failed = ~c("ok") & full("error_run", "stop_errors") & url.primary_listing(c("url")) & (c("strict") | ~c("more"))
        stop = F.when(failed, "fetch_error_streak").when(c("ok") & full("total", "max_products"), "max_products").when(c("ok") & full("old_run", "stop_no_new") & url.primary_listing(F.coalesce("final_url", "url")), "no_new_pages_streak")
        r = r.withColumn("stop", stop)
        r = settle(r.withColumn("over", F.first("stop", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("over is null").select("domain", "n", "url", "ok", "new", "led", "error_run", "old_run", "total", "stop"))
        counted = r.select("domain", "n")
        visits.append(r.join(state.select("domain", "pages"), "domain").select("domain", (c("pages") + c("n")).alias("place"), "url", "ok", F.when(c("ok"), c("new")).otherwise(0).alias("new")))
        sights.append(settle(shown.join(counted, ["domain", "n"], "left_semi").join(state.select("domain", "pages"), "domain").select("domain", "id", "available", "name", (c("pages") + c("n")).alias("at"), "i")))
        had = settle(had.unionByName(sights[-1].select("domain", "id")).distinct())
        ahead = settle(leads.join(counted, [leads["domain"] == counted["domain"], leads["at.n"] == counted["n"]], "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("at"))).select("domain", "url", "place"))
        seen = settle(seen.unionByName(ahead.select("domain", "url")))
        last = F.struct("error_run", "old_run", "total", "stop")
        done = r.groupBy("domain").agg(F.count("*").alias("visited"), F.count_if(~c("ok")).alias("failed"), F.sum("led").alias("more"), F.max_by(last, "n").alias("last"))
        left = level.groupBy("domain").agg(F.max("size").alias("size"))
        queued = ahead.groupBy("domain").agg(F.count("*").alias("ahead"))
        s = state.join(frontier.groupBy("domain").agg(F.count("*").alias("waiting")), "domain", "left").join(done, "domain", "left").join(queued, "domain", "left")
        running = c("reason").isNull()
        pages = c("pages") + F.coalesce("visited", F.lit(0))
        waits = (F.coalesce("waiting", F.lit(0)) > F.coalesce("visited", F.lit(0))) | (F.coalesce("ahead", F.lit(0)) > 0)
        reason = F.coalesce("last.stop", F.when(waits & (pages >= c("max_pages")), "max_pages").when(~waits, "queue_exhausted"))
        state = settle(
            s.select(
                "domain", *BUDGETS, "strict", F.when(running, pages).otherwise(c("pages")).alias("pages"), (c("errors") + F.coalesce("failed", F.lit(0))).alias("errors"), F.coalesce("last.total", "found").alias("found"),
                (c("new_pages") + F.coalesce("ahead", F.lit(0))).alias("new_pages"), F.coalesce("last.error_run", "error_streak").cast("bigint").alias("error_streak"), F.coalesce("last.old_run", "no_new_streak").alias("no_new_streak"), F.when(running, reason).otherwise(c("reason")).alias("reason"),
            )
        )
        frontier = ahead
    every = reduce(DataFrame.unionByName, sights)
    named = F.when(F.coalesce("name", F.lit("")) != "", F.struct("at", "i"))
    merged = every.groupBy("domain", "id").agg(any_out(c("available")).alias("available"), F.max_by("name", named).alias("name"))
    empty = targets.limit(0).select("domain", zero.alias("place"), c("base_url").alias("url"), F.lit(True).alias("ok"), zero.alias("new"))
    return Crawl(state.select("domain", "pages", "errors", "found", "new_pages", F.coalesce("reason", F.lit("queue_exhausted")).alias("reason")), reduce(DataFrame.unionByName, visits, empty), merged)
