"""State across runs: a snapshot of products and domains, and what a new run changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.locations import location_links, product_locations
from .filters import may_be_incomplete
from .merge import with_special_flag

#: Fields whose change is a change of the product; currency and description aren't among them.
COMPARED = ("name", "price", "available", "url", "specs", "variant_of", "location", "locations", "location_links", "billing_cycles", "cycle_prices", "is_special")
KEPT = ("domain", "url", "name", "price", "currency", "description", "specs", "variant_of", "location", "locations", "location_links", "billing_cycles", "cycle_prices", "is_special", "available")
SLOTS = ("last_notified_new", "last_notified_restock", "last_notified_new_location")


def active_domains(state: DataFrame, active: DataFrame) -> DataFrame:
    """State rows whose domain is active; rows without a domain stay."""
    names = active.select(F.lower("domain").alias("_d")).where("_d <> ''").distinct()
    blank = F.coalesce("domain", F.lit("")) == ""
    return state.where(~blank).join(names, F.lower("domain") == F.col("_d"), "left_semi").unionByName(state.where(blank))


def pruned(state: DataFrame, products: DataFrame, runs: DataFrame) -> DataFrame:
    """State rows without those that a domain's successful run no longer shows.

    A run that may be incomplete and shows fewer products than the state has
    prunes nothing; one that shows as many or more does.
    """
    ok = runs.where("ok").select("domain", may_be_incomplete().alias("partial"))
    before = state.groupBy("domain").agg(F.count_distinct("id").alias("before"))
    seen = products.groupBy("domain").agg(F.count_distinct("id").alias("seen"))
    prunes = ok.join(before, "domain").join(seen, "domain", "left").where(~(F.col("partial") & (F.coalesce("seen", F.lit(0)) < F.col("before")))).select("domain", F.lit(True).alias("_prunes"))
    ids = products.select("domain", "id").distinct().withColumn("_seen", F.lit(True))
    return state.join(prunes, "domain", "left").join(ids, ["domain", "id"], "left").where("_prunes is null or _seen is not null").select(*state.columns)


def _canonical(c: Column, kind: str) -> Column:
    """Maps as sorted entries, so that they can be compared."""
    return F.array_sort(F.map_entries(c)) if kind.startswith("map") else c


def changed(df: DataFrame, old: str, new: str, fields: tuple[str, ...] = COMPARED) -> Column:
    """Whether any field differs; for locations and their links null and none are the same."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema[old].dataType.fields}
    out = F.lit(False)
    for f in fields:
        a, b = F.col(f"{old}.{f}"), F.col(f"{new}.{f}")
        if f == "locations":
            a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
        elif f == "location_links":
            a, b = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (a, b))
        elif f == "is_special":
            a, b = (F.coalesce(x, F.lit(False)) for x in (a, b))
        out = out | ~_canonical(a, kinds[f]).eqNullSafe(_canonical(b, kinds[f]))
    return out


def restock(old: Column, new: Column) -> Column:
    """From out of stock to in stock; from unknown it is none."""
    return F.coalesce(~old & new, F.lit(False))


def new_locations(products: DataFrame, state: DataFrame) -> DataFrame:
    """``products`` that aren't in the state, with is_new_location.

    It is one where it has a location and its variant was in the state (before
    pruning) or came earlier in this run, by ``seq``.
    """
    fresh = products.join(state.select("id").distinct(), "id", "left_anti")
    known = state.where("coalesce(domain, '') <> '' and coalesce(variant_of, '') <> ''").select("domain", "variant_of").distinct().withColumn("_known", F.lit(True))
    first = fresh.where("coalesce(variant_of, '') <> ''").groupBy("domain", "variant_of").agg(F.min("seq").alias("_first"))
    both = fresh.join(known, ["domain", "variant_of"], "left").join(first, ["domain", "variant_of"], "left")
    had = F.col("_known").isNotNull() | F.coalesce(F.col("_first") < F.col("seq"), F.lit(False))
    return both.withColumn("is_new_location", (F.coalesce("location", F.lit("")) != "") & had).select(*products.columns, "is_new_location")


@dataclass
class Updated:
    """products and domains are the new state; alerts are (kind, id ...) rows; summary is one row."""

    products: DataFrame
    domains: DataFrame
    alerts: DataFrame
    summary: DataFrame


def update_state(state: DataFrame, domains: DataFrame, products: DataFrame, runs: DataFrame, now: str, *, started_at: str | None = None, prune: bool = True, active: DataFrame | None = None, notify: bool = True, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> Updated:
    """One run folded into the state.

    In order: domains no longer active go; domains of this run are recorded (a
    failed one keeps its last success, and its products stay untouched);
    products that a successful run no longer shows are pruned; products of
    successful runs are inserted or updated. One full outer join by id does
    both, and no key is hot. ``settle`` keeps what several results need (the
    shown products, the joined rows): it persists, checkpoints or writes a
    table; by default Spark computes them for each result.
    """
    before = state
    if active is not None:
        state, domains = active_domains(state, active), active_domains(domains, active)
    status = runs.select("domain", F.when(F.col("ok"), "ok").otherwise("error").alias("_status"), "error", "duration_ms", "ok")
    d = domains.join(status, "domain", "full_outer")
    ran = F.col("_status").isNotNull()
    new_domains = d.select(
        "domain",
        F.when(ran, F.col("_status")).otherwise(F.col("last_status")).alias("last_status"),
        F.when(F.col("ok"), F.lit(now)).otherwise(F.col("last_ok")).alias("last_ok"),
        F.when(F.col("ok"), F.lit(None).cast("string")).when(ran, F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(ran, F.col("duration_ms")).otherwise(F.col("last_duration_ms")).alias("last_duration_ms"),
    )
    shown = with_special_flag(products.join(runs.where("ok").select("domain").distinct(), "domain", "left_semi"))
    c = F.col
    some = lambda x: F.when(F.size(x) > 0, x)
    shown = shown.withColumns({"locations": F.coalesce(some(c("locations")), some(product_locations(c("locations"), c("location")))), "location_links": F.coalesce(some(c("location_links")), some(location_links(c("location_links"), c("locations"), c("location"), c("url"))))})
    shown = settle(shown)
    kept = pruned(state, shown, runs) if prune else state
    placed = new_locations(shown, before).select("id", "is_new_location") if notify else None
    old = kept.select("id", F.struct(*(x for x in kept.columns if x != "id")).alias("old"))
    new = shown.select("id", F.struct(*KEPT, "seq").alias("new"))
    j = old.join(new, "id", "full_outer")
    both = c("old").isNotNull() & c("new").isNotNull()
    j = j.withColumns({"is_new": c("old").isNull(), "is_restock": both & restock(c("old.available"), c("new.available")), "is_changed": both & changed(j, "old", "new")})
    if placed is not None:
        j = j.join(placed, "id", "left")
    else:
        j = j.withColumn("is_new_location", F.lit(False))
    at = F.lit(now)
    j = j.withColumn(
        "alert",
        F.when(~F.lit(notify), F.lit(None).cast("string"))
        .when(c("is_new") & F.coalesce("is_new_location", F.lit(False)) & ~F.coalesce(c("new.available") == F.lit(False), F.lit(False)), "new_location")
        .when(c("is_new") & F.coalesce(c("new.available"), F.lit(False)), "new")
        .when(c("is_restock") & ~c("old.last_notified_restock").eqNullSafe(at), "restock"),
    )
    j = settle(j)
    field = lambda x: F.when(c("new").isNotNull(), c(f"new.{x}")).otherwise(c(f"old.{x}")).alias(x)
    slot = {"last_notified_new": "new", "last_notified_restock": "restock", "last_notified_new_location": "new_location"}
    new_products = j.select(
        "id",
        *map(field, KEPT),
        F.coalesce("old.first_seen", at).alias("first_seen"),
        F.when(c("new").isNotNull(), at).otherwise(c("old.last_seen")).alias("last_seen"),
        F.when(c("is_new") | c("is_changed"), at).otherwise(c("old.last_change")).alias("last_change"),
        *(F.when(c("alert") == kind, at).otherwise(c(f"old.{s}")).alias(s) for s, kind in slot.items()),
    )
    alerts = j.where("alert is not null").select(c("alert").alias("kind"), "id", "new.*")
    counts = j.agg(F.count_if("is_restock").alias("restocks"), F.count_if("is_new").alias("new_products"))
    of_domains = runs.agg(F.count_if("ok").alias("domains_ok"), F.count_if(~c("ok")).alias("domains_error"))
    summary = counts.join(of_domains).select(F.lit(started_at or now).alias("started_at"), at.alias("finished_at"), "restocks", "new_products", "domains_ok", "domains_error")
    return Updated(new_products, new_domains, alerts, summary)


def transitions(observations: DataFrame, key: list[str], order: list[str], available: str = "available") -> DataFrame:
    """Observations with the key's previous availability and is_restock; the state of a key is what it was last seen as."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(*order)
    return observations.withColumn("previous", F.lag(available).over(w)).withColumn("is_restock", restock(F.col("previous"), F.col(available)))
