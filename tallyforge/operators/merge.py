"""Products: first and last of a key, and rows of one plan merged into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import availability, cycles, fixed, money, text, url
from ..functions.locations import location_links, product_locations


def first_per_key(df: DataFrame, key: list[Column | str], seq: str = "seq") -> DataFrame:
    """The row of the smallest ``seq`` of each key. One aggregate: a hot key is one row per task before the shuffle."""
    return _picked(df, key, F.min_by, seq)


def last_per_key(df: DataFrame, key: list[Column | str], seq: str = "seq") -> DataFrame:
    """The row of the largest ``seq`` of each key, at the place of the first: its ``seq`` is the smallest."""
    row = F.struct(*(F.col(c) for c in df.columns if c != seq))
    picked = df.groupBy(*key).agg(F.max_by(row, seq).alias("row"), F.min(seq).alias(seq))
    return picked.select("row.*", seq).select(*df.columns)


def _picked(df: DataFrame, key: list[Column | str], pick, seq: str) -> DataFrame:
    return df.groupBy(*key).agg(pick(F.struct(*df.columns), F.col(seq)).alias("row")).select("row.*")


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def unite(products: DataFrame, *others: DataFrame) -> DataFrame:
    """One row per id of several lists, later ones counting more: the last row's fields, out of stock if any list says so, and a name if any has one.

    Lists are told apart by their place here, rows of a list by ``seq``. Rows of
    one id combine before they are shuffled.
    """
    c = F.col
    every = products.withColumn("_at", F.lit(0))
    for i, other in enumerate(others, 1):
        every = every.unionByName(other.withColumn("_at", F.lit(i)))
    at = F.struct("_at", "seq")
    named = F.when(F.coalesce("name", F.lit("")) != "", at)
    per = every.groupBy("id").agg(F.max_by(F.struct(*products.columns), at).alias("r"), availability.any_out(c("available")).alias("stock"), F.max_by("name", named).alias("known"), F.min(at).alias("first"))
    fresh = {"available": c("stock"), "name": F.coalesce(F.nullif("r.name", F.lit("")), c("known"), c("r.name")), "seq": F.when(c("first._at") == 0, c("first.seq")).otherwise(c("r.seq"))}
    return per.select(*(fresh.get(x, c(f"r.{x}")).alias(x) for x in products.columns))


def mode_per_key(df: DataFrame, key: list[str], value: str, seq: str = "seq") -> DataFrame:
    """The commonest value of each key; of equals the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"), F.min(seq).alias("_first"))
    return counts.groupBy(*key).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value))


def dedupe_urls(df: DataFrame, url_col: str = "url", seq: str = "seq") -> DataFrame:
    """First of each normalised URL; text that is no http URL stands for itself, and empty rows go."""
    u = F.col(url_col)
    key = F.when(url.is_http(u), url.normalize_for_id(u)).otherwise(u)
    return first_per_key(df.where(F.coalesce(u, F.lit("")) != ""), [key.alias("_key")], seq)


def with_special_flag(products: DataFrame) -> DataFrame:
    c = F.col
    return products.withColumn("is_special", F.coalesce(c("is_special"), F.lit(False)) | text.special_offer(c("name"), c("url"), c("description")))


def override(products: DataFrame, **values: Column) -> DataFrame:
    """New values where they aren't null; ``available`` alone can be set to null."""
    return products.withColumns({k: v if k == "available" else F.coalesce(v, F.col(k)) for k, v in values.items()})


def merge_plans(products: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row per plan (see ``url.canonical_key``), sorted by domain, stock, name and id.

    The best row gives id, URL, name, price and specifications: in stock
    first, then by name quality, number of specifications and of cycle prices,
    and id. Stock is true if any row's is and false if all are. Lists and maps
    unite in input order, the first of a key winning; the commonest variant
    wins, the one seen first among equals. A row alone only has its locations
    normalised. Of a plan's listings only its distinct entries are gathered,
    after they were combined per entry: no more than the merged row holds.
    """
    c = F.col
    p = products.withColumn("key", url.canonical_key(c("domain"), c("url"), c("name"), c("variant_of")))
    p = p.withColumn("locs", product_locations(c("locations"), c("location"))).withColumn("links", location_links(c("location_links"), c("locations"), c("location"), c("url")))
    p = settle(p)
    size = lambda x: F.coalesce(F.size(F.coalesce(c(x), F.create_map().cast("map<string,string>"))), F.lit(0))
    order = F.struct(availability.availability_rank(c("available")).alias("a"), (-text.name_quality(c("name"))).alias("b"), (-size("specs")).alias("c"), (-size("cycle_prices")).alias("d"), c("id").alias("e"), c("seq").alias("f"))
    base = p.groupBy("key").agg(
        F.min_by(F.struct(*products.columns), order).alias("base"),
        availability.any_in(c("available")).alias("available"),
        F.bool_or("is_special").alias("special"),
        F.count("*").alias("n"),
    )
    g = base.join(_united(p), base["key"].eqNullSafe(c("of")), "left")
    single = c("n") == 1
    some = lambda x: F.when(F.size(x) > 0, x)
    specs = F.coalesce(c("base.specs"), F.create_map().cast("map<string,string>"))
    located = F.when((F.size("locs") > 0) & ~F.map_contains_key(specs, "Location"), F.map_concat(specs, F.create_map(F.lit("Location"), F.array_join(F.slice("locs", 1, 4), ", ")))).otherwise(specs)
    fresh = {
        "available": F.when(single, c("base.available")).otherwise(c("available")),
        "price": F.when(single | (F.coalesce(c("base.price"), F.lit("")) != ""), c("base.price")).otherwise(F.coalesce(money.preferred_price(c("prices")), c("base.price"))),
        "variant_of": F.when(single, c("base.variant_of")).otherwise(F.coalesce("variant", c("base.variant_of"))),
        "location": F.coalesce(F.get("locs", F.lit(0)), c("base.location")),
        "locations": F.coalesce(some(c("locs")), c("base.locations")),
        "location_links": F.coalesce(some(c("links")), c("base.location_links")),
        "billing_cycles": F.when(single, c("base.billing_cycles")).otherwise(F.coalesce(some(c("cycles")), c("base.billing_cycles"))),
        "cycle_prices": F.when(single, c("base.cycle_prices")).otherwise(F.coalesce(some(c("prices")), c("base.cycle_prices"))),
        "specs": F.when(single, c("base.specs")).otherwise(F.coalesce(some(located), c("base.specs"))),
        "is_special": F.when(single, c("base.is_special")).otherwise(c("special")),
    }
    merged = g.select(*(fresh.get(x, c(f"base.{x}")).alias(x) for x in products.columns))
    return merged.orderBy("domain", availability.availability_rank(c("available")), F.lower(text.compact_ws(c("name"))), "id")


def _united(p: DataFrame) -> DataFrame:
    """Per plan ``of``: cycles, prices, locs and links in input order, the first of an entry winning, and the commonest variant.

    Entries are combined per plan and entry first, so that a plan of any number of listings is one row per task and entry.
    """
    c = F.col

    def entries(kind: str, values: Column, entry: Column, value: Column) -> Column:
        found = F.transform(values, lambda x, i: F.struct(F.lit(kind).alias("kind"), entry(x).cast("string").alias("entry"), value(x).cast("string").alias("value"), i.alias("place")))
        return F.coalesce(found, F.array().cast("array<struct<kind:string,entry:string,value:string,place:int>>"))

    pair = (lambda x: x["key"], lambda x: x["value"])
    variant = text.compact_ws(c("variant_of"))
    every = F.concat(
        entries("cycle", c("billing_cycles"), lambda x: x, lambda x: x),
        entries("price", F.map_entries("cycle_prices"), *pair),
        entries("loc", c("locs"), F.lower, lambda x: x),
        entries("link", F.map_entries("links"), *pair),
        entries("variant", F.when(variant != "", F.array(variant)), lambda x: x, lambda x: x),
    )
    e = p.select(c("key").alias("of"), "seq", F.explode(every).alias("e")).select("of", "e.*", F.struct("seq", "e.place", "e.value").alias("at"))
    e = e.groupBy("of", "kind", "entry").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    is_a = lambda kind, x: F.when(c("kind") == kind, x)
    listed = lambda kind: F.array_sort(F.collect_list(is_a(kind, F.struct("at", "entry"))))
    values = lambda x: F.transform(x, lambda r: r["at"]["value"])
    pairs = lambda x: F.map_from_entries(F.transform(x, lambda r: F.struct(r["entry"].alias("key"), r["at"]["value"].alias("value"))))
    first = F.min_by("entry", is_a("variant", F.struct((-c("n")).alias("n"), c("at.seq").alias("seq"), c("entry").alias("v"))))
    g = e.groupBy("of").agg(listed("cycle").alias("cycles"), listed("price").alias("prices"), listed("loc").alias("locs"), listed("link").alias("links"), first.alias("variant"))
    return g.withColumns({"cycles": values("cycles"), "prices": pairs("prices"), "locs": values("locs"), "links": pairs("links")})


def fill_cycle_defaults(products: DataFrame) -> DataFrame:
    filled = cycles.fill_defaults(F.col("price"), F.col("billing_cycles"), F.col("cycle_prices"))
    return products.withColumn("_f", filled).withColumns({x: F.coalesce(F.col(f"_f.{x}"), F.col(x)) for x in ("billing_cycles", "cycle_prices")}).drop("_f")


def merge_runs(runs: DataFrame) -> DataFrame:
    """One run per domain: durations add up, one success is success, and the first three errors of a failure are told."""
    failed = runs.where(~F.col("ok") & (F.coalesce("error", F.lit("")) != "")).select(F.col("domain").alias("of"), "seq", "error")
    failed = top_per_key(failed, ["of"], [F.col("seq"), F.col("error")], 3).groupBy("of").agg(F.array_sort(F.collect_list(F.struct("seq", "error"))).alias("first"))
    failed = failed.select("of", F.transform("first", lambda e: e["error"]).alias("errors"))
    g = runs.groupBy("domain").agg(F.bool_or("ok").alias("ok"), F.sum(F.coalesce("duration_ms", F.lit(0))).cast("bigint").alias("duration_ms"), *merged_meta())
    g = g.join(failed, F.col("domain").eqNullSafe(F.col("of")), "left")
    told = F.when(F.size("errors") > 0, F.array_join("errors", "; ")).otherwise("fetch failed")
    return g.select("domain", "ok", F.when(~F.col("ok"), told).alias("error"), "duration_ms", "may_be_incomplete", "deadline_exceeded", "discovery_stop_reason", "discovery_fetch_errors").orderBy("domain")


def merged_meta() -> list[Column]:
    """Aggregates of runs' meta: any, any, the gravest stop reason (else the first), the sum of errors."""
    reason = F.trim("meta.discovery_stop_reason")
    known = F.array(*map(F.lit, fixed.STOP_REASONS))
    place = F.coalesce(F.nullif(F.array_position(known, reason), F.lit(0)), F.lit(len(fixed.STOP_REASONS) + 1).cast("long"))
    told = reason.isNotNull() & (reason != "")
    return [
        F.bool_or(F.coalesce("meta.may_be_incomplete", F.lit(False))).alias("may_be_incomplete"),
        F.bool_or(F.coalesce("meta.deadline_exceeded", F.lit(False))).alias("deadline_exceeded"),
        F.min_by(F.when(told, reason), F.when(told, F.struct(place.alias("p"), F.col("seq").alias("s")))).alias("discovery_stop_reason"),
        F.sum(F.coalesce("meta.discovery_fetch_errors", F.lit(0))).cast("bigint").alias("discovery_fetch_errors"),
    ]
