"""One run from captured pages to a new state: chained transforms, one lazy plan up to the sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import specs, text
from ..operators import alerts, enrich, filters, merge, report, state
from ..sources import listing as listing_source
from ..sources import state_json, targets
from ..sources.registry import Binding, Registry
from ..tables import settled


@dataclass
class Rules:
    """What a site needs beyond the general way; data, not code."""

    #: (domain, pattern on the URL): rows to drop.
    drop: list[tuple[str, str]] = field(default_factory=list)
    #: (domain, word): locations with the word go.
    no_location: list[tuple[str, str]] = field(default_factory=list)
    #: Domains where a bare tier name is told with its variant.
    tiers: list[str] = field(default_factory=list)
    #: Domains where a price and an add link mean stock if nothing else tells.
    assume_in: list[str] = field(default_factory=list)
    #: Domains whose names are codes like A.B.C, found in URL or description.
    codes: list[str] = field(default_factory=list)
    #: Domains whose pages are markup with product cards; the others answer with JSON.
    card_domains: list[str] = field(default_factory=list)


def diagnosed(products: DataFrame, dropped: Column, renamed: Column, into: Observation) -> DataFrame:
    """``products`` as they are; the job that runs over them tells ``into`` how many are dropped, renamed and special, without a pass of its own."""
    stays = ~F.coalesce(dropped, F.lit(False))
    return products.observe(into, F.count_if(~stays).alias("dropped_noise"), F.count_if(stays & renamed).alias("renamed"), F.count_if(stays & F.coalesce("is_special", F.lit(False))).alias("special"))


def cleaned(products: DataFrame, rules: Rules, listing: DataFrame | None = None, diagnostics: Observation | None = None) -> DataFrame:
    """Site rules and clean specifications; ``listing`` (domain, pid, name, available) overrides names and stock of its products.

    ``diagnostics`` is told by the job that uses the result: rows dropped,
    names changed and special offers kept.
    """
    from ..functions import url

    c = F.col
    drop = reduce(lambda a, b: a | b, ((F.lower("domain") == domain) & F.coalesce(F.lower("url").rlike(pattern), F.lit(False)) for domain, pattern in rules.drop), F.lit(False))
    p = products.withColumns({"_drop": F.coalesce(drop, F.lit(False)), "_old": c("name"), "specs": specs.clean_specs(c("specs"))})
    for domain, word in rules.no_location:
        here = F.lower("domain") == domain
        has = lambda x, w=word: F.contains(F.lower(x), F.lit(w))
        p = p.withColumns(
            {
                "location": F.when(here & has(c("location")), None).otherwise(c("location")),
                "locations": F.when(here, F.filter("locations", lambda x: ~has(x))).otherwise(c("locations")),
                "location_links": F.when(here, F.map_filter("location_links", lambda k, v: ~has(k))).otherwise(c("location_links")),
            }
        )
    tiered = F.lower("domain").isin(rules.tiers) & text.generic_tier(c("name")) & (F.coalesce("variant_of", F.lit("")) != "")
    p = p.withColumn("name", F.when(tiered, F.concat("variant_of", F.lit(" - "), "name")).otherwise(c("name")))
    code = text.dotted_code(c("name"), c("url"), c("description"))
    short = (F.lower(text.compact_ws(c("name"))) == F.lower(F.element_at(F.split(code, r"\."), -1))) | (F.char_length(text.compact_ws(c("name"))) <= 10)
    if listing is not None:
        known = listing.select(F.lower("domain").alias("_d"), F.col("pid").alias("_pid"), F.col("name").alias("_name"), F.col("available").alias("_available"))
        p = p.withColumn("_key", url.param_int(c("url"), "pid")).join(known, (F.lower("domain") == c("_d")) & (c("_key") == c("_pid")), "left")
        coded = F.lower("domain").isin(rules.codes) & c("_pid").isNull() & code.isNotNull() & short
        p = p.withColumn("name", F.coalesce(F.nullif("_name", F.lit("")), F.when(coded, code), "name")).withColumn("available", F.coalesce("_available", "available"))
    else:
        p = p.withColumn("name", F.when(F.lower("domain").isin(rules.codes) & code.isNotNull() & short, code).otherwise(c("name")))
    if diagnostics is not None:
        p = diagnosed(p, c("_drop"), F.lower(text.compact_ws(c("_old"))) != F.lower(text.compact_ws(c("name"))), diagnostics)
    return p.where(~c("_drop")).select(*products.columns)


def assumed_stock(products: DataFrame, rules: Rules) -> DataFrame:
    """In stock where nothing tells, a price is there and the link adds an id to a cart."""
    low = F.lower("url")
    adds = F.contains(low, F.lit("action=add")) & low.rlike("id=|pid=|product_id=")
    known = F.lower("domain").isin(rules.assume_in) & F.col("available").isNull() & (F.coalesce("price", F.lit("")) != "") & adds
    return products.withColumn("available", F.when(known, True).otherwise(F.col("available")))


def post_process(products: DataFrame, rules: Rules | None = None, listing: DataFrame | None = None, settle: Callable[[DataFrame], DataFrame] = lambda df: df, diagnostics: Observation | None = None) -> DataFrame:
    """In this order, which matters: last row per id, noise, site rules, plans merged, cycles filled, stock assumed, noise, site rules again.

    ``settle`` keeps the cleaned and the merged rows, so that later filters
    aren't pushed through all their expressions.
    """
    rules = rules or Rules()
    p = filters.without_noise(merge.last_per_key(products, ["id"]))
    p = settle(merge.merge_plans(cleaned(p, rules, listing, diagnostics), settle))
    p = assumed_stock(merge.fill_cycle_defaults(p), rules)
    return cleaned(filters.without_noise(p), rules, listing)


def parsers(rules: Rules) -> Registry:
    """The registry that rules ask for: pages of card domains hold cards, all others answer with JSON, if any domain is named."""
    own = Registry(general=Binding("json"))
    return own.bind("cards", *rules.card_domains) if rules.card_domains else own


def listed(pages: DataFrame, rules: Rules) -> DataFrame:
    """The product rows of pages, by the parser of their domain."""
    return parsers(rules).products(pages)


@dataclass
class Sources:
    """What a run asks beyond its pages; each is optional.

    registry: the parsers; listings: domains whose pages list products by id,
    which names and stock are then taken from; hidden: products found by probes
    (see ``operators.hidden``); details: captured detail pages (url, text) of
    (domain, url, rows, place), and how many a domain may ask for.
    """

    registry: Registry | None = None
    listings: list[str] = field(default_factory=list)
    hidden: DataFrame | None = None
    details: Callable[[DataFrame], DataFrame] | None = None
    most_details: int = 60
    recheck_out: bool = True


@dataclass
class Outcome:
    products: DataFrame
    domains: DataFrame
    messages: DataFrame
    summary: DataFrame
    dashboard: DataFrame
    diagnostics: Observation


def gathered(pages: DataFrame, rules: Rules, sources: Sources) -> tuple[DataFrame, DataFrame | None]:
    """(products, listing map): what pages show, with the products of listings, of probes and of detail pages."""
    registry = sources.registry or parsers(rules)
    found, known = settled(registry.products(pages)), None
    if sources.listings:
        own = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).isin([d.lower() for d in sources.listings])
        known = settled(listing_source.listing_map(pages.where(own)))
        found = listing_source.with_listing(found, listing_source.listing_products(known))
    if sources.hidden is not None:
        late = F.lit(1 << 62) + F.pmod(F.xxhash64("id"), F.lit(1 << 31))  # behind all pages
        found = merge.unite(found, listing_source.typed(sources.hidden.withColumns({"is_special": text.special_offer(F.col("name"), F.col("url")), "seq": late})))
    if sources.details is not None:
        found = settled(found)
        found = enrich.enrich_products(found, sources.details, sources.most_details, settle=settled, recheck_out=sources.recheck_out)
    return settled(found), known


def run(spark: SparkSession, pages: DataFrame, state_path: str, now: str, *, mode: str = "full", all_targets: DataFrame | None = None, rules: Rules | None = None, sources: Sources | None = None, prune: bool = True) -> Outcome:
    """Captured storefront answers (see ``schemas.PAGE``) folded into the state.

    full: all targets. lite: only targets of known domains. In both, domains
    that are no target any more leave the state, and products that a successful
    run no longer shows are pruned, unless ``prune`` is off (for runs over
    hand-picked pages). Pages without a ``seq`` are in the order of their URLs'
    hashes. ``sources`` has the run's parsers and what it asks beyond its pages.
    """
    if mode not in ("full", "lite"):
        raise ValueError(f"mode: {mode}")
    if "seq" not in pages.columns:
        pages = pages.withColumn("seq", F.pmod(F.xxhash64("url"), F.lit(1 << 36)))
    old_products, old_domains = state_json.load_state(spark, state_path)
    if all_targets is not None:
        chosen = targets.lite_targets(all_targets, old_domains, old_products) if mode == "lite" else targets.with_domain(all_targets)
        pages = pages.withColumn("_d", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))).join(chosen.select(F.col("domain").alias("_d")).distinct(), "_d", "left_semi").drop("_d")
    meta = F.struct(F.lit(False).alias("may_be_incomplete"), F.lit(False).alias("deadline_exceeded"), F.lit(None).cast("string").alias("discovery_stop_reason"), F.when(F.col("ok"), 0).otherwise(1).alias("discovery_fetch_errors"))
    fetched = pages.select(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("domain"), "ok", "error", F.col("elapsed_ms").cast("bigint").alias("duration_ms"), meta.alias("meta"), "seq")
    merged = merge.merge_runs(fetched)
    runs = merged.select("domain", "ok", "error", "duration_ms", F.struct("may_be_incomplete", "deadline_exceeded", "discovery_stop_reason", F.col("discovery_fetch_errors").cast("int").alias("discovery_fetch_errors")).alias("meta"), F.lit(0).cast("bigint").alias("seq"))
    found, known = gathered(pages.where("ok"), rules or Rules(), sources or Sources())
    diagnostics = Observation()
    found = post_process(found, rules, known, settle=settled, diagnostics=diagnostics)
    active = targets.with_domain(all_targets).select("domain") if prune and all_targets is not None else None
    done = state.update_state(old_products, old_domains, found, runs, now, prune=prune, active=active, settle=settled)
    return Outcome(done.products, done.domains, alerts.messages(done.alerts, now), done.summary, report.dashboard_rows(done.products), diagnostics)
