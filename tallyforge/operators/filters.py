"""Predicates over product rows and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, url
from ..functions.availability import extract_availability
from ..functions.text import compact_ws, either, has_any


def noise(products: DataFrame | None = None) -> Column:
    """Rows that are no product: no name, pages that sell nothing, names of site furniture, nothing known."""
    name, link = F.lower(compact_ws(F.col("name"))), F.lower(F.coalesce("url", F.lit("")))
    unknown = (F.coalesce("price", F.lit("")) == "") & (F.coalesce(F.size(F.coalesce("specs", F.create_map().cast("map<string,string>"))), F.lit(0)) == 0) & F.col("available").isNull()
    return (
        (name == "") | url.non_product_page(F.col("url")) | has_any(link, fixed.SUPPORT_URLS)
        | (name.isin(fixed.NOISE_SHORT_NAMES) & F.contains(link, F.lit("cart")) & F.col("available").isNull())
        | has_any(name, fixed.NOISE_NAMES) | unknown
    )


def without_noise(products: DataFrame) -> DataFrame:
    return products.where(~noise())


def needs_discovery(products: DataFrame, bases: DataFrame) -> DataFrame:
    """(domain, needs_discovery) per row of ``bases`` (domain, base_url): nothing found, nothing useful, or mostly no products."""
    c = F.col
    useful = (F.coalesce("price", F.lit("")) != "") | (F.coalesce(F.size(F.coalesce("specs", F.create_map().cast("map<string,string>"))), F.lit(0)) > 0)
    per = products.groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if(useful).alias("useful"), F.count_if(url.non_product_page(c("url"))).alias("odd"), F.min("url").alias("one"),
    )
    n = F.coalesce("n", F.lit(0))
    landing = (n == 1) & F.regexp_replace(url.path(c("one")), "/+$", "").isin("") & (url.authority(c("one")) == url.authority(c("base_url")))
    return bases.join(per, "domain", "left").select("domain", ((n == 0) | (c("useful") == 0) | ((n <= 5) & (c("odd") >= F.greatest(F.lit(1), n - 1))) | landing).alias("needs_discovery"))


def force_discovery(candidates: Column, products: Column, base_url: Column, small: int = 6, listing: int = 40) -> Column:
    """Whether many candidate pages but few products call for a wider search."""
    return (candidates >= 2) & ((products <= small) | (url.primary_listing(base_url) & (products <= listing)))


def may_be_incomplete(meta: str = "meta") -> Column:
    """Runs that may have missed products."""
    reason = F.lower(F.trim(F.coalesce(f"{meta}.discovery_stop_reason", F.lit(""))))
    flag = lambda x: F.coalesce(f"{meta}.{x}", F.lit(False))
    return flag("may_be_incomplete") | flag("deadline_exceeded") | reason.isin(fixed.INCOMPLETE_REASONS) | ((reason == "queue_exhausted") & (F.coalesce(f"{meta}.discovery_fetch_errors", F.lit(0)) > 0))


def challenge_page(status: Column, body: Column, headers: Column) -> Column:
    """Pages of an edge server instead of a site's: by status, by marks in the body, or by refusal with its headers."""
    low = F.lower(F.coalesce(body, F.lit("")))
    every = lambda words: reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in words))
    marks = F.contains(low, F.lit(fixed.CHALLENGE_PATH)) & has_any(low, fixed.CHALLENGE_PATH_MARKS)
    phrases = reduce(lambda a, b: a | b, map(every, fixed.CHALLENGE_PHRASES))
    told = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.lower(F.coalesce(e["value"], F.lit(""))).alias("v")))
    edge = F.exists(told, lambda e: (e.k.isin(fixed.CHALLENGE_HEADERS) & (e.v != "")) | ((e.k == "server") & F.contains(e.v, F.lit("cloudflare"))))
    is_in = lambda codes: F.coalesce(status.isin(codes), F.lit(False))
    return is_in(fixed.CHALLENGE_STATUS) | marks | phrases | (is_in(fixed.CHALLENGE_REFUSALS) & F.coalesce(edge, F.lit(False)))


def whmcs_shop(domain: Column, html: Column, domains: list[str] | None = None) -> Column:
    return has_any(F.lower(F.coalesce(html, F.lit(""))), fixed.WHMCS_PAGE_MARKERS) | F.lower(domain).isin(domains or [])


def hostbill_shop(domain: Column, html: Column, domains: list[str] | None = None) -> Column:
    return F.lower(domain).isin(domains or []) | has_any(F.lower(F.coalesce(html, F.lit(""))), fixed.HOSTBILL_PAGE_MARKERS)


def _page(html: Column, misses: list[str]) -> tuple[Column, Column]:
    t = compact_ws(html)
    low = F.lower(t)
    return low, (t != "") & ~low.rlike(either(misses))


def whmcs_product_page(html: Column) -> Column:
    low, usable = _page(html, fixed.MISS_PID)
    return usable & (has_any(low, ["billingcycle", "configoption[", "custom["]) | extract_availability(html).isNotNull())


def whmcs_group_page(html: Column) -> Column:
    low, usable = _page(html, fixed.MISS_GID)
    has = lambda w: F.contains(low, F.lit(w))
    return usable & ((has("cart.php") & has("pid=")) | (has("rp=/store") & has_any(low, ["add to cart", "configure", "order"])))


def hostbill_product_page(html: Column) -> Column:
    low, usable = _page(html, fixed.MISS_HOSTBILL_ID)
    return usable & (extract_availability(html).isNotNull() | has_any(low, ["billing cycle", "configoption", "configure", "action=add&id=", "step=3"]))


def hostbill_group_page(html: Column) -> Column:
    low, usable = _page(html, fixed.MISS_HOSTBILL_GROUP)
    return usable & (low.rlike(r"action=add(?:&amp;|&)id=\d+") | low.rlike(r"name=['\"]id['\"][^>]*value=['\"]\d+['\"]") | (F.contains(low, F.lit("/cart/")) & has_any(low, ["add to cart", "configure", "order"])))


def probe_matches(link: Column, probe: Column, keys: list[str]) -> Column:
    """Whether a product's URL has the probed id under one of the keys."""
    return F.coalesce(F.array_contains(F.array_compact(F.array(*(url.param_int(link, k) for k in keys))), probe), F.lit(False))
