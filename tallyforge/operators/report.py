"""What people look at: the dashboard's rows, filters, order and pages, counters, and differences of two catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text
from ..functions.availability import availability_rank

STRINGS, STRING_MAP = "array<string>", "map<string,string>"
PAGE_SIZE = 100


def dashboard_rows(state: DataFrame) -> DataFrame:
    """State rows with no nulls but in available and price_value, and without the specification ``cycles``."""
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")).alias(x)
    locations = F.coalesce(F.filter("locations", lambda x: x.isNotNull() & (x != "")), F.when(F.coalesce("location", F.lit("")) != "", F.array("location")), F.array().cast(STRINGS))
    none = F.create_map().cast(STRING_MAP)
    rows = state.withColumn("_p", money.dashboard_price(c("price"), c("cycle_prices"))).withColumn("_l", locations)
    return rows.select(
        blank("domain"), blank("name"), F.coalesce("name", F.lit("")).alias("original_name"), c("_p.price").alias("price"), c("_p.price_value").alias("price_value"), "available",
        F.map_filter(F.coalesce("specs", none), lambda k, v: F.lower(F.trim(k)) != "cycles").alias("specs"), blank("description"), F.coalesce("description", F.lit("")).alias("original_description"),
        blank("url"), blank("first_seen"), blank("last_seen"), F.coalesce("billing_cycles", F.array().cast(STRINGS)).alias("billing_cycles"), F.coalesce("cycle_prices", none).alias("cycle_prices"),
        F.coalesce(F.nullif("location", F.lit("")), F.get("_l", F.lit(0)), F.lit("")).alias("location"), c("_l").alias("locations"), F.coalesce("location_links", none).alias("location_links"),
        blank("variant_of"), F.coalesce("is_special", F.lit(False)).alias("is_special"),
    )


def default_order() -> list[Column]:
    return [availability_rank(F.col("available")).asc(), F.col("domain").asc(), F.col("name").asc()]


def filtered(rows: DataFrame, *, site: str = "", stock: str = "", special: str = "all", needle: str = "", least: float | None = None, most: float | None = None) -> DataFrame:
    """All conditions together; a price bound leaves out rows without a price."""
    c = F.col
    if site:
        rows = rows.where(c("domain") == site)
    if stock:
        rows = rows.where({"in": c("available") == F.lit(True), "out": c("available") == F.lit(False), "unknown": c("available").isNull()}[stock])
    if special != "all":
        rows = rows.where(c("is_special") if special == "only" else ~c("is_special"))
    if needle.strip():
        blob = text.search_blob(*(c(x) for x in ("domain", "name", "original_name", "price", "description", "original_description", "specs", "cycle_prices", "locations", "url")))
        rows = rows.where(F.contains(blob, F.lit(needle.strip().lower())))
    if least is not None:
        rows = rows.where(c("price_value") >= least)
    if most is not None:
        rows = rows.where(c("price_value") <= most)
    return rows


def column_order(column: str, ascending: bool = True) -> Column:
    """Stock by rank; rows without a price as if it were infinite; other columns with numbers in their order, without case."""
    key = availability_rank(F.col("available")) if column == "available" else F.coalesce("price_value", F.lit(float("inf"))) if column == "price_value" else text.natural_key(F.col(column))
    return key.asc() if ascending else key.desc()


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the ordered rows; numbers outside are moved to the nearest page. The order must be total."""
    total = max(1, -(-rows.count() // size))
    number = min(max(number, 1), total)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def stock_counters() -> list[Column]:
    a = F.col("available")
    return [F.count("*").alias("total"), F.count_if(a).alias("in_stock"), F.count_if(~a).alias("out_of_stock"), F.count_if(a.isNull()).alias("unknown"), F.count_if("is_special").alias("special")]


def domain_counters(domains: DataFrame) -> DataFrame:
    return domains.agg(F.count_if(F.col("last_status") == "ok").alias("domains_ok"), F.count_if(F.col("last_status") == "error").alias("domains_error"))


def run_log(products: DataFrame) -> DataFrame:
    """One progress line per domain."""
    return products.groupBy("domain").agg(*stock_counters()).select("domain", F.format_string("[scrape:%s] products=%d in=%d out=%d unknown=%d special=%d", "domain", "total", "in_stock", "out_of_stock", "unknown", "special").alias("line"))


def report_key(name: Column, link: Column) -> Column:
    return F.lower(F.concat(F.trim(F.coalesce(name, F.lit(""))), F.lit("::"), F.trim(F.coalesce(link, F.lit("")))))


def diff_report(baseline: DataFrame, simple: DataFrame, monitor: DataFrame) -> DataFrame:
    """(side, item): keys that one catalogue has and another lacks, both ways."""
    b, s, m = (x.select(report_key(F.col("name"), F.col("url")).alias("item")) for x in (baseline, simple, monitor))
    sides = {"baseline_minus_simple": (b, s), "baseline_minus_monitor": (b, m), "simple_minus_baseline": (s, b), "monitor_minus_baseline": (m, b)}
    out = None
    for side, (x, y) in sides.items():
        rows = x.subtract(y).select(F.lit(side).alias("side"), "item")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("side", "item")


def short_time(c: Column) -> Column:
    """An ISO time to the minute; empty if it is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm"), F.lit(""))
