"""The library's operators as queries over the tables, each with the SQL that checks it.

``QUERIES`` maps a name to (query, SQL); the SQL is None where SQL has no such
operator, and a test holds the query against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import availability, cycles, money, specs, text, url
from ..operators import alerts, crawl, filters, merge, report, state
from ..sources import html, store_json, targets
from ..tables import settled
from . import discovery, storefront, upkeep
from .catalogue import flag_available, listings, observations, runs, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {**storefront.QUERIES, **discovery.QUERIES, **upkeep.QUERIES}

#: The listings of ``catalogue.listings`` in SQL.
LISTINGS = """
listings AS (
  SELECT concat_ws('::', lower(replace(p_brand, '#', '-')), l_partkey, l_suppkey) AS id, lower(replace(p_brand, '#', '-')) AS domain,
    'https://' || lower(replace(p_brand, '#', '-')) || '/cart.php?a=add&pid=' || l_partkey || '&utm_source=feed' AS url, p_name AS name, printf('%.2f USD', l_extendedprice) AS price,
    replace(regexp_extract(printf('%.2f USD', l_extendedprice), '(\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)', 1), ',', '')::DOUBLE AS price_value,
    CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS available, p_type AS variant_of, n_name AS location, l_orderkey * 10 + l_linenumber AS seq, l_partkey, l_suppkey, p_size,
    CASE WHEN l_linenumber % 2 = 0 THEN 'Monthly' ELSE 'Yearly' END AS cycle
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""
OBSERVATIONS = "obs AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS available FROM events)"
RUNS = """
runs AS (
  SELECT o_custkey::VARCHAR AS domain, o_orderstatus <> 'F' AS ok, CASE WHEN o_orderstatus = 'F' THEN 'timeout ' || o_orderpriority END AS error, floor(o_totalprice)::BIGINT AS duration_ms,
    o_orderstatus = 'P' AS incomplete, o_orderkey % 7 = 0 AS late, (['deadline', 'max_pages', 'no_new_pages_streak', 'queue_exhausted', 'other'])[(o_orderkey % 6 + 1)::INT] AS reason, o_orderkey % 3 AS errors, o_orderkey AS seq
  FROM orders
)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


# --- transitions and state ---------------------------------------------------


@query(f"""WITH {OBSERVATIONS}, w AS (SELECT *, lag(available) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM obs)
SELECT user_id, event_id, ts FROM w WHERE previous = false AND available = true""")
def restock_transitions(spark, sf):
    """The flagship: products seen out of stock and next in stock."""
    t = state.transitions(observations(spark, sf), ["user_id"], ["ts", "event_id"])
    return t.where("is_restock").select("user_id", "event_id", "ts")


@query(f"""WITH {OBSERVATIONS}, w AS (SELECT *, lag(available) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM obs)
SELECT user_id, count(*) AS seen, count(*) FILTER (n > 1 AND previous IS DISTINCT FROM available) AS changes, count(*) FILTER (previous = false AND available = true) AS restocks, max(ts) FILTER (n = 1 OR previous IS DISTINCT FROM available) AS last_change,
  min(ts) AS first_seen, max(ts) AS last_seen FROM w GROUP BY user_id""")
def change_history(spark, sf):
    """Per product: first and last seen, changes, restocks, and the last change."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = state.transitions(observations(spark, sf), ["user_id"], ["ts", "event_id"]).withColumn("n", F.row_number().over(w))
    moved = ~F.col("previous").eqNullSafe(F.col("available"))
    return t.groupBy("user_id").agg(
        F.count("*").alias("seen"), F.count_if((F.col("n") > 1) & moved).alias("changes"), F.count_if("is_restock").alias("restocks"), F.max(F.when((F.col("n") == 1) | moved, F.col("ts"))).alias("last_change"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


CUT = "1998-01-01"


def _snapshots(spark, sf):
    """Line items before and from a date on, as previous state and current products, one row per plan and supplier."""
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"), (F.col("l_partkey") % 25).cast("string").alias("domain"), F.col("l_partkey").cast("string").alias("name"), (F.col("l_partkey") % 100).cast("string").alias("variant_of"),
        F.col("l_suppkey").cast("string").alias("location"), F.format_string("%.2f USD", "l_extendedprice").alias("price"), flag_available(F.col("l_returnflag")).alias("available"),
        (F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")).alias("old"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("at"),
    )
    last = rows.groupBy("id", "old").agg(F.max_by(F.struct("domain", "name", "variant_of", "location", "price", "available"), "at").alias("r"), F.min(F.col("at.l_orderkey") * 10 + F.col("at.l_linenumber")).alias("seq")).select("id", "old", "r.*", "seq")
    last = settled(last)  # every user needs both parts, some of them several times
    typed = lambda df: df.selectExpr(
        "id", "domain", "concat('https://', domain, '.test/', id) AS url", "name", "price", "'USD' AS currency", "CAST(NULL AS STRING) AS description", "CAST(NULL AS MAP<STRING,STRING>) AS specs", "available", "variant_of", "location",
        "CAST(NULL AS ARRAY<STRING>) AS locations", "CAST(NULL AS MAP<STRING,STRING>) AS location_links", "CAST(NULL AS ARRAY<STRING>) AS billing_cycles", "CAST(NULL AS MAP<STRING,STRING>) AS cycle_prices", "false AS is_special", "seq",
    )
    old, new = typed(last.where("old")), typed(last.where("not old"))
    before = old.drop("seq").withColumn("locations", F.array("location")).withColumn("location_links", F.create_map("location", "url"))
    before = before.withColumns({"first_seen": F.lit("t0"), "last_seen": F.lit("t0"), "last_change": F.lit("t0"), **{s: F.lit(None).cast("string") for s in state.SLOTS}})
    return before, new


SNAPSHOTS = f"""
rows AS (SELECT l_partkey || '-' || l_suppkey AS id, (l_partkey % 25)::VARCHAR AS domain, l_partkey::VARCHAR AS name, (l_partkey % 100)::VARCHAR AS variant_of, l_suppkey::VARCHAR AS location, printf('%.2f USD', l_extendedprice) AS price,
  CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS available, l_shipdate < TIMESTAMP '{CUT}' AS old,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_shipdate < TIMESTAMP '{CUT}' ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS n,
  min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey, l_shipdate < TIMESTAMP '{CUT}') AS seq FROM lineitem),
old AS (SELECT * FROM rows WHERE old AND n = 1), cur AS (SELECT * FROM rows WHERE NOT old AND n = 1)"""


def _runs_of(spark, new: DataFrame, partial: bool = False) -> DataFrame:
    """A run per domain: every fifth failed, and every third may be incomplete."""
    d = F.col("domain").cast("int")
    meta = F.struct((d % 3 == 0).alias("may_be_incomplete"), F.lit(False).alias("deadline_exceeded"), F.lit(None).cast("string").alias("discovery_stop_reason"), F.lit(0).alias("discovery_fetch_errors"))
    return new.select("domain").distinct().select("domain", (d % 5 != 4).alias("ok"), F.when(d % 5 == 4, "fetch failed").alias("error"), F.lit(100).cast("bigint").alias("duration_ms"), meta.alias("meta"), d.cast("bigint").alias("seq"))


KEPT = """
kept AS (SELECT old.* FROM old LEFT JOIN (SELECT domain, count(*) AS n FROM old GROUP BY 1) b USING (domain) LEFT JOIN (SELECT domain, count(*) AS n FROM cur GROUP BY 1) s USING (domain)
  WHERE domain::INT % 5 = 4 OR s.n IS NULL OR (domain::INT % 3 = 0 AND s.n < b.n) OR id IN (SELECT id FROM cur WHERE cur.domain = old.domain))"""


@query(f"""WITH {SNAPSHOTS}, {KEPT}, shown AS (SELECT * FROM cur WHERE domain::INT % 5 <> 4)
SELECT coalesce(s.id, k.id) AS id, coalesce(s.domain, k.domain) AS domain, CASE WHEN s.id IS NOT NULL THEN s.price ELSE k.price END AS price, CASE WHEN s.id IS NOT NULL THEN s.available ELSE k.available END AS available,
  CASE WHEN k.id IS NULL THEN 't1' ELSE 't0' END AS first_seen, CASE WHEN s.id IS NULL THEN 't0' ELSE 't1' END AS last_seen, CASE WHEN k.id IS NULL OR (s.id IS NOT NULL AND (s.price <> k.price OR s.available IS DISTINCT FROM k.available)) THEN 't1' ELSE 't0' END AS last_change
FROM shown s FULL JOIN kept k ON s.id = k.id""")
def state_upsert(spark, sf):
    """The state after a run: pruned, inserted, updated."""
    before, new = _snapshots(spark, sf)
    domains = spark.createDataFrame([], "domain string, last_status string, last_ok string, last_error string, last_duration_ms bigint")
    done = state.update_state(before, domains, new, _runs_of(spark, new), "t1", notify=False)
    return done.products.select("id", "domain", "price", "available", "first_seen", "last_seen", "last_change")


@query(f"WITH {SNAPSHOTS}, {KEPT} SELECT domain, count(*) AS kept, (SELECT count(*) FROM old o WHERE o.domain = kept.domain) AS before FROM kept GROUP BY domain")
def state_prune_guarded(spark, sf):
    """How many products of each domain the pruning leaves."""
    before, new = _snapshots(spark, sf)
    kept = state.pruned(before, new, _runs_of(spark, new)).groupBy("domain").agg(F.count("*").alias("kept"))
    return kept.join(before.groupBy("domain").agg(F.count("*").alias("before")), "domain")


@query(f"""WITH {SNAPSHOTS}, {KEPT}, shown AS (SELECT * FROM cur WHERE domain::INT % 5 <> 4), j AS (SELECT s.available AS now, k.available AS was, k.id AS known FROM shown s LEFT JOIN kept k ON s.id = k.id)
SELECT count(*) FILTER (was = false AND now = true) AS restocks, count(*) FILTER (known IS NULL) AS new_products, (SELECT count(DISTINCT domain) FROM cur WHERE domain::INT % 5 <> 4) AS domains_ok, (SELECT count(DISTINCT domain) FROM cur WHERE domain::INT % 5 = 4) AS domains_error FROM j""")
def run_summary(spark, sf):
    """Restocks, new products, and domains by outcome."""
    before, new = _snapshots(spark, sf)
    domains = spark.createDataFrame([], "domain string, last_status string, last_ok string, last_error string, last_duration_ms bigint")
    return state.update_state(before, domains, new, _runs_of(spark, new), "t1", notify=False).summary.select("restocks", "new_products", "domains_ok", "domains_error")


@query(f"""WITH {SNAPSHOTS}, fresh AS (SELECT * FROM cur WHERE id NOT IN (SELECT id FROM old))
SELECT id, (EXISTS (SELECT 1 FROM old WHERE old.domain = fresh.domain AND old.variant_of = fresh.variant_of)) OR seq > min(seq) OVER (PARTITION BY domain, variant_of) AS is_new_location FROM fresh""")
def new_location_flags(spark, sf):
    """New rows whose plan was known at another location before."""
    before, new = _snapshots(spark, sf)
    return state.new_locations(new, before).select("id", "is_new_location")


@query(f"WITH {SNAPSHOTS} SELECT domain, count(*) AS products FROM old WHERE domain IN (SELECT domain FROM cur WHERE domain::INT % 5 <> 4) GROUP BY domain")
def state_active_domains(spark, sf):
    before, new = _snapshots(spark, sf)
    return state.active_domains(before, new.where(F.col("domain").cast("int") % 5 != 4).select("domain")).groupBy("domain").agg(F.count("*").alias("products"))


# --- merging -----------------------------------------------------------------


@query("""SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'R') THEN true WHEN bool_and(l_returnflag = 'A') THEN false END AS available, count(*) AS rows FROM lineitem GROUP BY 1""")
def merge_availability_true_dominant(spark, sf):
    a = flag_available(F.col("l_returnflag"))
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(availability.any_in(a).alias("available"), F.count("*").alias("rows"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN false WHEN bool_or(l_returnflag = 'R') THEN true END AS available, count(*) AS rows FROM lineitem GROUP BY 1""")
def merge_availability_false_dominant(spark, sf):
    a = flag_available(F.col("l_returnflag"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(availability.any_out(a).alias("available"), F.count("*").alias("rows"))


MERGED = f"""WITH {LISTINGS}, firsts AS (SELECT *, 'pid' AS k FROM listings),
b AS (SELECT *, row_number() OVER (PARTITION BY domain, l_partkey ORDER BY CASE WHEN available THEN 0 WHEN NOT available THEN 1 ELSE 2 END, id, seq, price_value) AS place FROM listings)"""


@query(f"""{MERGED}, e AS (SELECT domain, l_partkey, 'loc' AS kind, lower(location) AS entry, location AS value, seq FROM listings UNION ALL SELECT domain, l_partkey, 'cycle', cycle, price, seq FROM listings),
f AS (SELECT domain, l_partkey, kind, entry, arg_min(value, (seq, value)) AS value, min((seq, value)) AS first FROM e GROUP BY ALL),
l AS (SELECT domain, l_partkey, list(value ORDER BY first, entry) FILTER (kind = 'loc') AS locations, list(entry ORDER BY first, entry) FILTER (kind = 'cycle') AS cycles, list(entry || '=' || value ORDER BY entry) FILTER (kind = 'cycle') AS prices FROM f GROUP BY ALL),
g AS (SELECT domain, l_partkey, count(*) AS n, CASE WHEN bool_or(available) THEN true WHEN count(*) FILTER (NOT available) = count(*) THEN false END AS available, min(variant_of) AS variant_of FROM listings GROUP BY ALL),
u AS (SELECT domain, l_partkey, location, arg_min(url, (seq, url)) AS url FROM listings GROUP BY ALL),
k AS (SELECT domain, l_partkey, list(location || '=' || url ORDER BY location || '=' || url) AS links FROM u GROUP BY ALL)
SELECT b.id, b.domain, b.name, b.price, g.available, g.variant_of, locations[1] AS location, array_to_string(locations, '|') AS locations, array_to_string(links, '|') AS links, array_to_string(cycles, '|') AS cycles, array_to_string(prices, '|') AS prices,
  'RAM=' || b.p_size || 'GB' || CASE WHEN n > 1 THEN '|Location=' || array_to_string(locations[1:4], ', ') ELSE '' END AS specs
FROM b JOIN g USING (domain, l_partkey) JOIN l USING (domain, l_partkey) JOIN k USING (domain, l_partkey) WHERE place = 1""")
def merge_plans(spark, sf):
    """All listings of a plan as one product, with all that is merged."""
    # The given tables are one row group each: dealt out first, so that not one task computes all keys.
    merged = merge.merge_plans(listings(spark, sf, by_plan=True), settled)
    told = lambda m: F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), e.value))
    joined = lambda x: F.array_join(x, "|")
    return merged.select(
        "id", "domain", "name", "price", "available", "variant_of", "location", joined("locations").alias("locations"), joined(F.array_sort(told("location_links"))).alias("links"), joined("billing_cycles").alias("cycles"),
        joined(F.array_sort(told("cycle_prices"))).alias("prices"), joined(told("specs")).alias("specs"),
    )


@query(f"""WITH {LISTINGS}, c AS (SELECT domain, location, count(*) AS n, min(seq) AS first FROM listings GROUP BY ALL)
SELECT domain, location FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, first, location) AS p FROM c) WHERE p = 1""")
def merge_mode_variant(spark, sf):
    return merge.mode_per_key(listings(spark, sf), ["domain"], "location")


@query(f"""WITH {LISTINGS} SELECT domain, id, name, price_value FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN available THEN 0 WHEN NOT available THEN 1 ELSE 2 END, price_value, id, seq) AS p FROM listings) WHERE p <= 3""")
def merge_best_rows(spark, sf):
    """The three best rows of each domain: in stock and cheapest."""
    rows = listings(spark, sf).withColumn("price_value", money.price_value(F.col("price")))
    top = merge.top_per_key(rows, ["domain"], [availability.availability_rank(F.col("available")), F.col("price_value"), F.col("id"), F.col("seq")], 3)
    return top.select("domain", "id", "name", "price_value")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, min(event_id) AS first_event FROM events GROUP BY 1""")
def dedupe_last_wins(spark, sf):
    events = table(spark, sf, "events").withColumn("seq", F.struct("ts", "event_id")).select("user_id", "event_id", "seq")
    return merge.last_per_key(events, ["user_id"]).select("user_id", "event_id", F.col("seq.event_id").alias("first_event"))


@query(r"""SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_source=feed$', ''), '/+(\?|$)', '\1') ORDER BY page_id) AS n FROM pages) WHERE n = 1""")
def dedupe_first_wins(spark, sf):
    pages = table(spark, sf, "pages").select("url", F.col("page_id").alias("seq"))
    return merge.dedupe_urls(pages).select(F.col("seq").alias("page_id"), "url")


@query(f"""WITH {RUNS}, e AS (SELECT domain, string_agg(error, '; ' ORDER BY seq) AS told FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS p FROM runs WHERE NOT ok) WHERE p <= 3 GROUP BY 1),
r AS (SELECT domain, arg_min(reason, (list_position(['deadline', 'max_pages', 'fetch_error_streak', 'no_new_pages_streak', 'max_products', 'queue_exhausted', reason], reason), seq)) AS reason FROM runs WHERE reason IS NOT NULL GROUP BY 1)
SELECT domain, bool_or(ok) AS ok, CASE WHEN NOT bool_or(ok) THEN any_value(told) END AS error, sum(duration_ms)::BIGINT AS duration_ms, bool_or(incomplete) AS may_be_incomplete, bool_or(late) AS deadline_exceeded, any_value(r.reason) AS discovery_stop_reason, sum(errors)::BIGINT AS discovery_fetch_errors
FROM runs LEFT JOIN e USING (domain) LEFT JOIN r USING (domain) GROUP BY domain""")
def run_merge(spark, sf):
    """All runs of a domain as one, with the gravest stop reason."""
    return merge.merge_runs(runs(spark, sf))


@query(f"""WITH {RUNS} SELECT seq AS run, incomplete OR late OR coalesce(reason IN ('deadline', 'max_pages', 'no_new_pages_streak'), false) OR coalesce(reason = 'queue_exhausted' AND errors > 0, false) AS partial FROM runs""")
def incomplete_runs(spark, sf):
    return runs(spark, sf).select(F.col("seq").alias("run"), filters.may_be_incomplete().alias("partial"))


# --- text, money, URLs -------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, replace(regexp_extract(printf('%.2f', l_extendedprice), '(\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)', 1), ',', '')::DOUBLE AS amount, printf('%.2f', l_extendedprice) || CASE l_linenumber % 4 WHEN 0 THEN ' USD' WHEN 1 THEN ' EUR' WHEN 2 THEN ' GBP' ELSE ' HKD' END AS price,
 CASE l_linenumber % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'HKD' END AS currency FROM lineitem""")
def price_parse(spark, sf):
    """Prices written with symbols before or behind, read back."""
    line = table(spark, sf, "lineitem")
    amount, kind = F.format_string("%.2f", "l_extendedprice"), F.col("l_linenumber") % 4
    told = F.when(kind == 0, F.concat(F.lit("Only $"), amount, F.lit(" / mo"))).when(kind == 1, F.concat(F.lit("from € "), amount)).when(kind == 2, F.concat(F.lit("pay "), amount, F.lit(" gbp today"))).otherwise(F.concat(F.lit("HK$"), amount))
    p = line.select("l_orderkey", "l_linenumber", money.extract_price(told).alias("p"))
    return p.select("l_orderkey", "l_linenumber", money.price_value(F.col("p.price")).alias("amount"), "p.price", "p.currency")


@query("SELECT c_custkey, round(c_acctbal, 2) AS value FROM customer WHERE c_acctbal >= 0")
def price_to_float(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal >= 0")
    return c.select("c_custkey", money.price_value(F.concat(F.lit("USD "), F.format_number("c_acctbal", 2), F.lit(" monthly"))).alias("value"))


@query("SELECT c_custkey, abs(round(c_acctbal, 2)) AS value FROM customer")
def price_to_float_signed(spark, sf):
    """The same of all customers: the sign of an amount is no part of its first number."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", money.price_value(F.concat(F.lit("USD "), F.format_number("c_acctbal", 2), F.lit(" monthly"))).alias("value"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS domain, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def url_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", url.domain(F.col("url")).alias("domain"), url.path(F.col("url")).alias("path"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_source=feed$', ''), '/+(\?|$)', '\1') AS id FROM pages""")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", url.normalize_for_id(F.col("url")).alias("id"))


@query(f"WITH {LISTINGS} SELECT domain || '::cart.php::pid:' || l_partkey AS key, count(*) AS rows FROM listings GROUP BY 1")
def url_canonical_key(spark, sf):
    key = url.canonical_key(F.col("domain"), F.col("url"), F.col("name"), F.col("variant_of"))
    return listings(spark, sf).groupBy(key.alias("key")).agg(F.count("*").alias("rows"))


@query(r"""SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS redirect FROM pages""")
def redirect_signatures(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.redirect_signature(F.col("url")).alias("redirect"))


@query(r"""SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) || '::' || substr(sha1(regexp_replace(regexp_replace(lower(trim(regexp_replace(html, '[ \t\n\r\x0b\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), '[a-f0-9]{24,}', 'x', 'g'), '\b\d{4,}\b', 'n', 'g')), 1, 20) AS signature FROM pages""")
def page_signature(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.page_signature(F.col("url"), F.col("html")).alias("signature"))


@query(r"""SELECT doc_id, sha1(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0b\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS digest FROM documents""")
def compact_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(text.compact_ws(F.col("text"))).alias("digest"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g') AS slug, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part""")
def slugify(spark, sf):
    c = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, sf, "part").select("p_partkey", text.slugify(c).alias("slug"), text.name_key(c).alias("key"))


@query("""SELECT p_partkey, (length(p_name || ' ' || p_size) >= 6)::INT + regexp_matches(p_name || ' ' || p_size, '[a-zA-Z].*[0-9]|[0-9].*[a-zA-Z]')::INT + (contains(p_name, '-') OR contains(p_name, '|'))::INT + contains(p_name || ' ' || p_size, ' ')::INT AS quality FROM part""")
def name_quality(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.name_quality(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("quality"))


@query(r"""SELECT page_id, regexp_replace(string_split(h, '.')[len(string_split(h, '.')) - 1], '[^a-z0-9]', '', 'g') AS tag FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)""")
def domain_tag(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.domain_tag(url.domain(F.col("url"))).alias("tag"))


@query("""SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'special|promo|deal|flash sale|black friday|cyber monday|limited offer|特供|專供|专供|限时|限時') AS special,
 regexp_matches(lower(coalesce(text, '')), 'add to cart|order now|buy now|加入购物车|加入購物車|立即购买|立即購買|立即订购|立即訂購|可购买|可購買') AS purchase FROM documents""")
def offer_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.special_offer(t, F.lit("")).alias("special"), availability.purchase_action(t).alias("purchase"))


STOCK_TEXT = "CASE event_type WHEN 'purchase' THEN 'In  Stock now' WHEN 'error' THEN 'SOLD OUT' WHEN 'click' THEN floor(value)::INT || ' left' WHEN 'view' THEN 'Stock: ' || (event_id % 2) ELSE 'Add to cart' END"


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false WHEN 'click' THEN floor(value) > 0 WHEN 'view' THEN event_id % 2 > 0 END AS available FROM events""")
def availability_text(spark, sf):
    """Stock notices of five kinds, read as three values."""
    kind = F.col("event_type")
    t = F.when(kind == "purchase", "In  Stock now").when(kind == "error", "SOLD OUT").when(kind == "click", F.concat(F.floor("value").cast("string"), F.lit(" left"))).when(kind == "view", F.concat(F.lit("Stock: "), (F.col("event_id") % 2).cast("string"))).otherwise("Add to cart")
    return table(spark, sf, "events").select("event_id", availability.extract_availability(t).alias("available"))


@query("""SELECT l_orderkey, l_linenumber, (['Monthly', 'Quarterly', 'Semiannual', 'Yearly', 'Biennial', 'Triennial', 'One-Time'])[l_linenumber] AS label FROM lineitem""")
def cycle_label(spark, sf):
    written = F.array(*map(F.lit, ("MONTHLY", " quarterly", "Semi-Annually", "annually", "Biennially ", "triennially", "One  Time")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cycles.normalize_cycle(F.get(written, F.col("l_linenumber") - 1)).alias("label"))


@query("""SELECT p_partkey, CASE p_size WHEN 1 THEN 'Monthly' WHEN 3 THEN 'Quarterly' WHEN 6 THEN 'Semiannual' WHEN 12 THEN 'Yearly' WHEN 24 THEN 'Biennial' WHEN 36 THEN 'Triennial' ELSE p_size || ' Months' END AS label,
 CASE WHEN p_size * 512 % 1024 = 0 THEN (p_size // 2) || 'GB' WHEN p_size * 512 > 1024 THEN printf('%.1fGB', p_size / 2.0) ELSE (p_size * 512) || 'MB' END AS memory, printf('%.2f CNY', p_size * 100 / 100.0) AS price FROM part""")
def store_units(spark, sf):
    """Months, megabytes and cents as a storefront shows them."""
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", money.months_label(s).alias("label"), money.megabytes_text(s * 512).alias("memory"), money.cents_text(s * 100, "CNY").alias("price"))


@query("""SELECT p_partkey, p_size || 'GB RAM' AS ram, (p_size % 8 + 1) || ' vCPU' AS cpu, (p_size * 10) || ' GB SSD' AS disk, 'Bandwidth: ' || p_size || 'TB' AS bandwidth, NULL::VARCHAR AS traffic, '1000 Mbps' AS port FROM part""")
def spec_extract(spark, sf):
    """Specifications found in a line of text; traffic that repeats the bandwidth goes."""
    s = F.col("p_size").cast("string")
    line = F.concat(s, F.lit("GB RAM, "), (F.col("p_size") % 8 + 1).cast("string"), F.lit(" vCPU, "), (F.col("p_size") * 10).cast("string"), F.lit(" GB  SSD; Bandwidth: "), s, F.lit("TB Traffic: "), s, F.lit("TB; port 1000 Mbps"))
    m = table(spark, sf, "part").select("p_partkey", specs.extract_specs(line).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k)).alias(k.lower())
    return m.select("p_partkey", *map(get, ("RAM", "CPU", "Disk", "Bandwidth", "Traffic", "Port")))


@query("""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, (props::JSON ->> 'k')::BIGINT % 10 AS bucket FROM events""")
def json_unnest(spark, sf):
    """JSON payloads parsed leniently."""
    v = store_json.lenient_json(F.concat(F.lit("<html><pre>"), F.col("props"), F.lit("</pre>")))
    k = F.try_variant_get(v, "$.k", "bigint")
    return table(spark, sf, "events").select("event_id", k.alias("k"), (k % 10).alias("bucket"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey FROM orders) SELECT (o_custkey % 20)::VARCHAR || '.shop.test' AS domain, 'plan ' || l_linenumber AS name, printf('%.2f CNY', l_quantity / 1) AS price, l_returnflag = 'R' AS available, 'Area ' || (o_custkey % 20) AS location, 'node ' || o_orderkey AS variant_of
FROM n JOIN lineitem ON l_orderkey = o_orderkey""")
def json_store(spark, sf):
    """Orders as storefront answers (areas, nodes, plans), written as JSON and unnested again."""
    orders, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    plan = F.struct(F.col("l_linenumber").cast("bigint").alias("id"), F.format_string("plan %d", "l_linenumber").alias("plan_name"), F.when(F.col("l_returnflag") == "R", 5).otherwise(0).alias("stock"), F.array(F.struct((F.col("l_quantity") * 100).alias("price"), F.lit(1).alias("cycle"))).alias("price_datas"))
    nodes = line.groupBy("l_orderkey").agg(F.collect_list(plan).alias("plans"))
    area = F.struct(F.concat(F.lit("Area "), (F.col("o_custkey") % 20).cast("string")).alias("area_name"), F.array(F.struct(F.col("o_orderkey").alias("id"), F.format_string("node %d", "o_orderkey").alias("node_name"), "plans")).alias("nodes"))
    answers = orders.join(nodes, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("https://"), (F.col("o_custkey") % 20).cast("string"), F.lit(".shop.test/api")).alias("url"), F.to_json(F.struct(F.lit(0).alias("status_code"), F.array(area).alias("data"))).alias("text"))
    return store_json.store_products(answers).select("domain", "name", "price", "available", "location", "variant_of")


# --- filters, crawl ----------------------------------------------------------


@query(r"""SELECT page_id, regexp_matches(lower(regexp_extract(url, '://[^/?#]*([^?#;]*)', 1)), 'clientarea.php|register|login|ticket|announcements|knowledgebase|downloads|serverstatus|contact|about|privacy|terms|tos|protocol|refund|changelog|status|faq|blog|vps-hosting.php') AS no_product,
 false AS listing FROM pages""")
def page_kinds(spark, sf):
    return table(spark, sf, "pages").select("page_id", url.non_product_page(F.col("url")).alias("no_product"), url.primary_listing(F.col("url")).alias("listing"))


@query(f"WITH {LISTINGS} SELECT domain, count(*) AS kept FROM listings WHERE NOT (name LIKE '%introduction%') GROUP BY 1")
def noise_filter(spark, sf):
    return filters.without_noise(listings(spark, sf)).groupBy("domain").agg(F.count("*").alias("kept"))


@query(f"""WITH {OBSERVATIONS}, m AS (SELECT *, coalesce(NOT available, true) AS miss FROM obs), i AS (SELECT *, sum(CASE WHEN miss THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m),
n AS (SELECT *, sum(CASE WHEN miss THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i),
c AS (SELECT *, coalesce(max(CASE WHEN streak >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM n)
SELECT user_id, event_id, streak::BIGINT AS streak FROM c WHERE done = 0""")
def streak_cut(spark, sf):
    """Probes of each target until eight misses in a row."""
    o = observations(spark, sf).withColumn("miss", F.coalesce(~F.col("available"), F.lit(True)))
    return crawl.streak_cut(o, 8, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "streak")


@query(f"""WITH {LISTINGS}, w AS (SELECT url, CASE WHEN available IS NULL THEN 0 WHEN location = '' THEN 2 END AS priority, seq FROM listings)
SELECT url, min(priority) AS priority, min(seq) AS first, count(*) AS rows FROM w WHERE priority IS NOT NULL GROUP BY url ORDER BY priority, first, url LIMIT 100""")
def enrich_topk(spark, sf):
    """The hundred detail pages worth fetching first."""
    return crawl.detail_pages(listings(spark, sf), 100)


@query("""WITH f AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R') SELECT p FROM f WHERE p NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A')""")
def frontier_anti(spark, sf):
    """Found addresses that weren't visited yet."""
    line = table(spark, sf, "lineitem")
    found = line.where("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("dst"))
    seen = line.where("l_linestatus = 'F' and l_returnflag = 'A'").select(F.col("l_partkey").cast("string").alias("url"))
    return crawl.next_frontier(found, seen).select(F.col("url").cast("bigint").alias("p"))


@query("""SELECT o_custkey AS target, arg_min(o_orderkey, o_orderkey) AS attempt, arg_min(o_orderpriority, o_orderkey) AS answer FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def first_success(spark, sf):
    """Of several fetches of a target the first that worked."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("attempt"), (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_orderpriority").alias("answer"))
    return targets.first_success(o).select("target", "attempt", "answer")


@query(r"""SELECT url, unnest(['/cart.php', '/index.php?rp=/store', '/store', '/cart', '/index.php?/cart/', '/products', '/billing/cart.php', '/billing/index.php?rp=/store', '/billing/store']) AS entry FROM pages""")
def entry_points(spark, sf):
    """The usual listing addresses of each page's site."""
    p = table(spark, sf, "pages").select("url", F.explode(url.entry_points(F.col("url"))).alias("entry"))
    return p.select("url", F.concat(url.path(F.col("entry")), F.when(url.query(F.col("entry")) != "", F.concat(F.lit("?"), url.query(F.col("entry")))).otherwise("")).alias("entry"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS links, len(regexp_extract_all(html, '(?i)<li[\s>]')) AS items, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS titled FROM pages""")
def html_elements(spark, sf):
    """Links and list items of each page's element table."""
    p = table(spark, sf, "pages").select("page_id", html.elements(F.col("html")).alias("els"))
    of = lambda tag: F.size(F.filter("els", lambda e: e["tag"] == tag)).cast("bigint")
    return p.select("page_id", F.size(F.filter("els", lambda e: (e["tag"] == "a") & html.attr(e, "href").isNotNull())).cast("bigint").alias("links"), of("li").alias("items"), (F.size(F.filter("els", lambda e: (e["tag"] == "title") & (e["text"] != ""))) > 0).alias("titled"))


# --- reports -----------------------------------------------------------------


def _rows(spark, sf):
    c = F.col
    return listings(spark, sf).withColumns({"first_seen": F.lit(""), "last_seen": F.lit(""), "price_value": money.price_value(c("price")), "original_name": c("name"), "original_description": F.lit("")})


@query(f"""WITH {LISTINGS} SELECT id, seq, domain, name, price_value, available FROM listings WHERE domain = 'brand-7' AND available AND price_value BETWEEN 150 AND 700 AND contains(lower(domain || ' ' || name || ' ' || url), 'widget')""")
def dashboard_filter(spark, sf):
    rows = report.filtered(_rows(spark, sf), site="brand-7", stock="in", needle=" Widget ", least=150, most=700)
    return rows.select("id", "seq", "domain", "name", "price_value", "available")


@query(f"""WITH {LISTINGS} SELECT id, seq, price_value FROM listings ORDER BY price_value DESC, seq, id LIMIT 100 OFFSET 200""")
def dashboard_page(spark, sf):
    """The third page by falling price."""
    rows = _rows(spark, sf)
    return report.page(rows, [report.column_order("price_value", False), F.col("seq").asc(), F.col("id").asc()], 3).select("id", "seq", "price_value")


@query(f"""WITH {LISTINGS} SELECT domain, count(*) AS total, count(*) FILTER (available) AS in_stock, count(*) FILTER (NOT available) AS out_of_stock, count(*) FILTER (available IS NULL) AS unknown, count(*) FILTER (l_partkey % 7 = 0) AS special FROM listings GROUP BY 1""")
def stock_counters(spark, sf):
    rows = listings(spark, sf).withColumn("is_special", url.param_int(F.col("url"), "pid") % 7 == 0)
    return rows.groupBy("domain").agg(*report.stock_counters())


@query("""WITH b AS (SELECT DISTINCT lower(p_name || '::' || p_brand) AS item FROM part WHERE p_size < 30), s AS (SELECT DISTINCT lower(p_name || '::' || p_brand) AS item FROM part WHERE p_size > 20), m AS (SELECT DISTINCT lower(p_name || '::' || p_brand) AS item FROM part WHERE p_size > 10)
SELECT 'baseline_minus_simple' AS side, item FROM (SELECT * FROM b EXCEPT SELECT * FROM s) UNION ALL SELECT 'baseline_minus_monitor', item FROM (SELECT * FROM b EXCEPT SELECT * FROM m)
UNION ALL SELECT 'simple_minus_baseline', item FROM (SELECT * FROM s EXCEPT SELECT * FROM b) UNION ALL SELECT 'monitor_minus_baseline', item FROM (SELECT * FROM m EXCEPT SELECT * FROM b)""")
def diff_report(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("url"), "p_size")
    return report.diff_report(p.where("p_size < 30"), p.where("p_size > 20"), p.where("p_size > 10"))


@query(f"""WITH {LISTINGS}, m AS (
  SELECT *, (['restock', 'new', 'new_location'])[seq % 3 + 1] AS kind, CASE WHEN l_suppkey % 5 = 0 THEN repeat('a&b ', 1200) WHEN l_suppkey % 5 = 1 THEN 'Fast & small' END AS description FROM listings
), t AS (
  SELECT *, (['🔄', '🆕', '📍'])[seq % 3 + 1] || ' <b>' || (['RESTOCK ALERT', 'NEW PRODUCT', 'NEW LOCATION'])[seq % 3 + 1] || '</b>  ·  <b>#' || replace(domain, '-', '') || '</b>' || chr(10)
    || '<b>' || CASE WHEN l_partkey % 7 = 0 THEN '⭐ ' ELSE '' END || CASE WHEN contains(lower(name), lower(variant_of)) THEN name ELSE variant_of || ' - ' || name END || '</b>' || chr(10)
    || CASE WHEN available THEN '🟢 In Stock' WHEN NOT available THEN '🔴 Out of Stock' ELSE '🟡 Unknown' END || '  ·  💵 ' || price || '  ·  📍 ' || location || chr(10) || '<pre>' || cycle || ': ' || price || '</pre>' || chr(10) || '<b>Specs:</b>' || chr(10) || '<pre>RAM: ' || p_size || 'GB</pre>' || chr(10) AS head,
    '🔗 <a href="' || replace(url, '&', '&amp;') || '">Open Product Page</a>' || chr(10) || '<code>2024-01-01</code>' AS tail FROM m
), s AS (
  SELECT *, trim(description) AS d, 4096 - length(head) - length(tail) - 25 - 1 AS room FROM t
), q AS (
  SELECT *, CASE WHEN d IS NULL THEN '' WHEN length(replace(d, '&', '&amp;')) <= room THEN replace(d, '&', '&amp;') ELSE replace(rtrim(d[:(SELECT max(n) FROM range(0, 4096) r(n) WHERE n <= length(d) AND n + 4 * ((n + 2) // 4) + 3 <= room)]), '&', '&amp;') || '...' END AS quote FROM s
)
SELECT id, seq, length(message) AS size, md5(message) AS digest FROM (SELECT id, seq, head || CASE WHEN quote <> '' THEN '<blockquote>' || quote || '</blockquote>' || chr(10) ELSE '' END || tail AS message FROM q)""")
def alert_messages(spark, sf):
    """Every listing as a message of one of the kinds, whole; the descriptions of some are too long and are cut."""
    c = F.col
    key, supplier = url.param_int(c("url"), "pid"), F.split_part("id", F.lit("::"), F.lit(3)).cast("int")
    rows = listings(spark, sf).withColumns(
        {"kind": F.get(F.array(*map(F.lit, ("restock", "new", "new_location"))), (c("seq") % 3).cast("int")), "is_special": key % 7 == 0, "description": F.when(supplier % 5 == 0, F.repeat(F.lit("a&b "), F.lit(1200))).when(supplier % 5 == 1, "Fast & small")}
    )
    m = alerts.messages(rows, "2024-01-01")
    return m.select("id", "seq", F.char_length("message").cast("bigint").alias("size"), F.md5("message").alias("digest"))


@query("""WITH p AS (SELECT p_partkey // 5 AS d, p_partkey % 5 AS n, p_partkey // 5 % 7 AS kind FROM part), r AS (SELECT d, kind, n FROM p WHERE CASE kind WHEN 0 THEN false WHEN 5 THEN n = 0 WHEN 6 THEN n = 0 ELSE true END)
SELECT 'd' || s.d || '.test' AS domain, count(r.n) = 0 OR s.kind IN (1, 2, 5) AS needs_discovery FROM (SELECT DISTINCT d, kind FROM p) s LEFT JOIN r ON r.d = s.d GROUP BY s.d, s.kind""")
def needs_discovery(spark, sf):
    """Sites of seven kinds: nothing found, nothing useful, mostly pages that sell nothing, two fine ones, a landing page only, one product."""
    c = F.col
    k = c("p_partkey")
    p = table(spark, sf, "part").select(F.floor(k / 5).alias("d"), (k % 5).alias("n")).withColumn("kind", c("d") % 7)
    domain = F.concat(F.lit("d"), c("d").cast("string"), F.lit(".test"))
    link = F.concat(F.lit("https://"), domain, F.when(c("kind") == 5, "/").when((c("kind") == 2) & (c("n") < 4), F.concat(F.lit("/knowledgebase/"), c("n").cast("string"))).otherwise(F.concat(F.lit("/store/a/p"), c("n").cast("string"))))
    found = (c("kind") != 0) & (~c("kind").isin(5, 6) | (c("n") == 0))
    rows = p.where(found).select(domain.alias("domain"), link.alias("url"), F.when(c("kind") != 1, "5.00 USD").alias("price"), F.lit(None).cast("map<string,string>").alias("specs"))
    bases = p.select(domain.alias("domain"), F.concat(F.lit("https://"), domain, F.lit("/")).alias("base_url")).distinct()
    return filters.needs_discovery(rows, bases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
