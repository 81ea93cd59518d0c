"""Products completed from their detail pages: the pages most worth a fetch, what they tell, and rows that follow from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, specs, text, url
from ..sources import html

#: What a detail page tells.
DETAILS = "url string, available boolean, billing_cycles array<string>, cycle_prices map<string,string>, locations array<struct<name:string,available:boolean>>"


def priority(*, recheck_out: bool = False, recheck_in: bool = False, cycles: bool = False) -> Column:
    """What a row lacks: 0, stock, which is unknown or to be checked again; 1, cycles or their prices (if asked for); 2, its location; null if nothing, or without a page."""
    c = F.col
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    stock = c("available").isNull() | (F.lit(recheck_out) & F.coalesce(~c("available"), F.lit(False))) | (F.lit(recheck_in) & F.coalesce("available", F.lit(False)))
    lacks = F.lit(cycles) & (empty("billing_cycles") | empty(F.map_keys("cycle_prices")))
    return F.when(c("url").rlike("^https?://"), F.when(stock, 0).when(lacks, 1).when(F.coalesce("location", F.lit("")) == "", 2))


def wanted_pages(products: DataFrame, most: int, **options: bool) -> DataFrame:
    """(domain, url, rows, place): of each domain the ``most`` pages that are worth most, by ``priority`` and then by their first row.

    Pages are combined per address before they are ordered, and Spark limits
    each task's pages before they meet.
    """
    c = F.col
    rows = products.select("domain", "url", "seq", priority(**options).alias("priority")).where("priority is not null")
    per = rows.groupBy("domain", "url").agg(F.min("priority").alias("priority"), F.min("seq").alias("first"), F.count("*").alias("rows"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("priority", "first", "url"))).where(c("place") <= most).select("domain", "url", "rows", "place")


def read_details(pages: DataFrame, *, text_: str = "text") -> DataFrame:
    """DETAILS of captured detail pages (url, text), one row each; pages without text are left out."""
    c = F.col
    p = pages.where(F.coalesce(c(text_), F.lit("")) != "").select("url", c(text_).alias("text"), html.elements(c(text_)).alias("els"))
    return p.select("url", html.availability_in_page(c("els"), c("text")).alias("available"), html.cycles_in_page(c("els"), c("text")).alias("billing_cycles"), html.cycle_prices_in_page(c("els")).alias("cycle_prices"), html.location_variants(c("els")).alias("locations"))


def _united(own: Column, more: Column) -> Column:
    """Both maps, the second's values where both have a key; null if both are empty."""
    none = F.create_map().cast("map<string,string>")
    own, more = F.coalesce(own, none), F.coalesce(more, none)
    both = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k)), more)
    return F.when(F.size(both) > 0, both)


def enriched(products: DataFrame, wanted: DataFrame, details: DataFrame, **options: bool) -> DataFrame:
    """``products`` with what the detail pages of ``wanted`` addresses tell, and a row more for each further location.

    Rows that lack nothing (see ``priority``) stay as they are.

    What a page tells of stock and cycles replaces what the row has, prices of
    cycles join its own. A page that sells nothing and belongs to several rows
    tells only of stock. Of the page's locations, that of the row's own name
    counts, or the first for a row without any; then each other one becomes a
    row of its own, with an id that ends in ``::loc-<slug>``, unless that id is
    there already. A row without a price gets that of its best cycle.
    ``details``: DETAILS, one row an address.
    """
    c = F.col
    told = details.join(wanted.select("domain", "url", "rows"), "url").select("domain", "url", F.struct("rows", "available", "billing_cycles", "cycle_prices", "locations").alias("d"))
    j = products.withColumn("lacks", priority(**options).isNotNull()).join(told, ["domain", "url"], "left")
    shared = (c("d.rows") > 1) & url.non_product_page(c("url"))
    none = F.array().cast("array<struct<name:string,available:boolean>>")
    spots = F.when(shared, none).otherwise(F.coalesce(c("d.locations"), none))
    has = F.coalesce("location", F.lit("")) != ""
    cycles = F.when(~shared & (F.size("d.billing_cycles") > 0), c("d.billing_cycles")).otherwise(c("billing_cycles"))
    prices = _united(c("cycle_prices"), F.when(~shared, c("d.cycle_prices")))
    j = j.withColumns({"spots": spots, "cycles_": cycles, "prices_": prices, "stock_": F.coalesce("d.available", "available")})
    same = F.get(F.filter("spots", lambda s: F.lower(s["name"]) == F.lower("location")), F.lit(0))
    j = j.withColumn("spot", F.when(has, same).otherwise(F.get("spots", F.lit(0))))
    j = j.withColumns({"stock_": F.coalesce("spot.available", "stock_"), "where_": F.coalesce("spot.name", "location")})
    seen = c("d").isNotNull() & c("lacks")
    price = F.when(F.coalesce("price", F.lit("")) != "", c("price")).otherwise(F.coalesce(money.preferred_price(c("prices_")), c("price")))
    one = F.coalesce("where_", F.lit("")) != ""
    base = {
        "price": price, "available": c("stock_"), "location": c("where_"), "locations": F.when(one, F.array("where_")).otherwise(c("locations")), "location_links": F.when(one, F.create_map("where_", "url")).otherwise(c("location_links")),
        "billing_cycles": c("cycles_"), "cycle_prices": c("prices_"), "specs": specs.clean_specs(c("specs")), "is_special": F.coalesce("is_special", F.lit(False)) | text.special_offer(c("name"), c("url"), c("description")),
    }
    kept = j.select(*(F.when(seen, base[x]).otherwise(c(x)).alias(x) if x in base else c(x) for x in products.columns))
    more = j.where(seen & ~has & (F.size("spots") > 1)).withColumn("s", F.explode(F.slice("spots", 2, F.size("spots"))))
    extra = base | {
        "id": F.concat("id", F.lit("::loc-"), text.slugify(c("s.name"))), "available": F.coalesce("s.available", "stock_"), "variant_of": F.coalesce(F.nullif("variant_of", F.lit("")), c("name")), "location": c("s.name"), "price": c("price"), "is_special": c("is_special"),
        "locations": F.array("s.name"), "location_links": F.create_map("s.name", "url"),
    }
    more = more.select(*(extra.get(x, c(x)).alias(x) for x in products.columns)).join(products.select("id"), "id", "left_anti").select(*products.columns)
    more = more.groupBy("id").agg(F.min_by(F.struct(*products.columns), F.struct("seq", "location")).alias("r")).select("r.*")
    return kept.unionByName(more)


def enrich_products(products: DataFrame, source: Callable[[DataFrame], DataFrame], most: int, *, settle: Callable[[DataFrame], DataFrame] = lambda df: df, **options: bool) -> DataFrame:
    """``products`` enriched from the pages most worth a fetch; ``source`` gives captured pages (url, text) of (domain, url, rows, place)."""
    wanted = settle(wanted_pages(products, most, **options))
    return enriched(products, wanted, settle(read_details(source(wanted))), **options)
