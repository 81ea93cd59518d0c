"""Queries over what surrounds a run: diagnostics, united lists, messages and their receipts, debug artifacts; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cycles, locations, money, text, url
from ..operators import alerts, merge, report
from ..sources import debug_json, delivery, listing
from ..tables import settled, shared_folder
from . import engine
from .catalogue import table

QUERIES: dict[str, tuple] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _parts(spark, sf) -> DataFrame:
    """Parts as product rows of four sites, with names and addresses of several kinds."""
    c = F.col
    k = c("p_partkey")
    domain = F.concat(F.lit("site"), (k % 4).cast("string"), F.lit(".test"))
    link = F.concat(F.lit("https://"), domain, F.when(k % 7 == 0, F.lit("/store/diy-")).otherwise("/store/vps-"), k.cast("string"))
    code = F.concat(F.lit("LAX.AS3."), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return listing.typed(
        table(spark, sf, "part").select(
            F.concat(domain, F.lit("::"), k.cast("string")).alias("id"), domain.alias("domain"), link.alias("url"), F.when(k % 4 == 1, F.when(k % 3 == 0, "Pro").otherwise(c("p_name"))).when(k % 4 == 2, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(c("p_name")).alias("name"),
            F.when(k % 5 > 0, F.format_string("%.2f USD", "p_retailprice")).alias("price"), F.when(k % 4 == 2, F.concat(F.lit("See "), code)).alias("description"), F.when(k % 6 < 3, k % 6 == 0).alias("available"), F.when(k % 4 == 1, F.lit("Tokyo VPS")).alias("variant_of"), (k % 9 == 0).alias("is_special"), k.alias("seq"),
        )
    )


@query("""SELECT count(*) FILTER (p_partkey % 4 = 0 AND p_partkey % 7 = 0) AS dropped_noise, count(*) FILTER (p_partkey % 4 = 1 AND p_partkey % 3 = 0 OR p_partkey % 4 = 2) AS renamed,
  count(*) FILTER (p_partkey % 9 = 0 AND NOT (p_partkey % 4 = 0 AND p_partkey % 7 = 0)) AS special, count(*) FILTER (NOT (p_partkey % 4 = 0 AND p_partkey % 7 = 0)) AS kept FROM part""")
def cleanup_diagnostics(spark, sf):
    """What site rules drop and rename, told by the job that cleans: the rows are read once."""
    told = Observation()
    rules = engine.Rules(drop=[("site0.test", "/store/.*diy-")], tiers=["site1.test"], codes=["site2.test"])
    kept = settled(engine.cleaned(_parts(spark, sf), rules, diagnostics=told))
    return kept.groupBy().agg(*(F.lit(told.get[x]).cast("bigint").alias(x) for x in ("dropped_noise", "renamed", "special")), F.count("*").alias("kept"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN k % 6 < 3 THEN k % 6 = 0 END AS a FROM part),
u AS (
  SELECT k, 0 AS nr, CASE k % 4 WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'Pro' ELSE name END WHEN 2 THEN split_part(name, ' ', 1) ELSE name END AS name, a, 'first' AS price FROM p
  UNION ALL SELECT k, 1, '', CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false END, 'second' FROM p WHERE k % 2 = 0
  UNION ALL SELECT CASE WHEN k % 9 = 0 THEN k + 1000000 ELSE k END, 2, CASE WHEN k % 4 = 0 THEN '' ELSE 'Late ' || name END, CASE WHEN k % 7 < 3 THEN true END, 'third' FROM p WHERE k % 3 = 0
)
SELECT 'site' || (k % 4) || '.test::' || k AS id, CASE WHEN bool_or(NOT a) THEN false WHEN bool_or(a) THEN true END AS available, coalesce(arg_max(name, nr) FILTER (name <> ''), '') AS name, arg_max(price, nr) AS price FROM u GROUP BY k""")
def united_products(spark, sf):
    """Three lists of products in one: parsed, discovered and hidden ones."""
    c = F.col
    p = _parts(spark, sf).withColumn("price", F.lit("first"))
    k = c("seq")
    second = p.where(k % 2 == 0).withColumns({"name": F.lit(""), "available": F.when(k % 5 == 0, True).when(k % 5 == 1, False), "price": F.lit("second")})
    name = table(spark, sf, "part").select(c("p_partkey").alias("seq"), c("p_name").alias("whole"))
    moved = F.when(k % 9 == 0, k + 1000000).otherwise(k)
    third = p.where(k % 3 == 0).join(name, "seq").withColumns(
        {"id": F.concat(F.lit("site"), (moved % 4).cast("string"), F.lit(".test::"), moved.cast("string")), "name": F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Late "), "whole")), "available": F.when(k % 7 < 3, True), "price": F.lit("third")}
    )
    return merge.unite(p, second, third.select(*p.columns)).select("id", "available", "name", "price")


def _send(key: str, message: str) -> bool:
    """A receiver that refuses some messages and breaks at others."""
    if message.endswith("breaks"):
        raise ConnectionError("no answer")
    return not message.endswith("refused")


@query("""WITH p AS (SELECT p_partkey AS k, (['ok', 'ok', 'refused', 'ok', 'breaks'])[p_partkey % 5 + 1] AS how, (['new', 'restock', 'new_location'])[p_partkey % 3 + 1] AS kind FROM part)
SELECT r.run, k AS id, kind, how = 'ok' AS delivered, CASE WHEN how = 'breaks' THEN 'ConnectionError: no answer' END AS error, CASE how WHEN 'ok' THEN 1 ELSE 3 END::BIGINT AS attempts FROM p, (VALUES ('r1'), ('r2')) r(run) WHERE r.run = 'r1' OR k % 2 = 0""")
def delivered_messages(spark, sf):
    """Two runs' messages, each batch queued twice and sent three times: what was delivered, and how often each was tried."""
    c = F.col
    k = c("p_partkey")
    how = F.get(F.array(*map(F.lit, ("ok", "ok", "refused", "ok", "breaks"))), (k % 5).cast("int"))
    kind = F.get(F.array(*map(F.lit, ("new", "restock", "new_location"))), (k % 3).cast("int"))
    m = table(spark, sf, "part").select(k.cast("string").alias("id"), kind.alias("kind"), F.lit("site").alias("domain"), F.concat(k.cast("string"), F.lit(" "), how).alias("message"))
    path = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    for run, rows in (("r1", m), ("r1", m), ("r2", m.where(c("id").cast("bigint") % 2 == 0)), ("r1", m)):
        delivery.queue_messages(rows, path, run)
    for _ in range(3):
        delivery.deliver(spark, path, _send)
    tries = spark.read.parquet(f"{path}/receipts").groupBy("key").agg(F.count("*").alias("attempts"))
    return delivery.receipts_of(spark, path).join(tries, "key").select("run", c("id").cast("bigint").alias("id"), "kind", c("ok").alias("delivered"), "error", "attempts")


def _artifacts(spark, sf) -> DataFrame:
    """A debug document per part: a list, an object with one, broken text, odd entries, odd types."""
    c = F.col
    k = c("p_partkey")
    one = F.concat(F.lit('{"id":"'), k.cast("string"), F.lit('","name":"'), c("p_name"), F.lit('","url":"https://x.test/'), k.cast("string"), F.lit('","available":'), F.when(k % 2 == 0, "true").otherwise("null"), F.lit(',"locations":["A","B"],"specs":{"RAM":"'), c("p_size").cast("string"), F.lit('GB"}}'))
    shapes = [F.concat(F.lit("["), one, F.lit("]")), F.concat(F.lit('{"note":"x","products":['), one, F.lit(","), F.replace(one, F.lit('"id":"'), F.lit('"id":"b')), F.lit("]}")), F.concat(F.lit("{broken "), k.cast("string")), F.concat(F.lit("[7,"), one, F.lit(',null,"x"]')), F.lit("[]"), F.lit('[{"id":5,"available":"maybe","locations":"none"}]'), F.lit('{"other":1}'), F.lit(None)]
    return table(spark, sf, "part").select("p_partkey", F.get(F.array(*shapes), (k % 8).cast("int")).alias("text"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, p_size AS s, p_partkey % 8 AS shape FROM part), whole AS (
  SELECT k, k::VARCHAR AS id FROM p WHERE shape IN (0, 1, 3) UNION ALL SELECT k, 'b' || k FROM p WHERE shape = 1
)
SELECT k AS p_partkey, w.id, name, 'https://x.test/' || k AS url, CASE WHEN k % 2 = 0 THEN true END AS available, 'A,B' AS locations, s || 'GB' AS ram, NULL AS broken FROM whole w JOIN p USING (k)
UNION ALL SELECT k, '5', NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE shape = 5
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, CASE shape WHEN 2 THEN '{broken ' || k ELSE '{"other":1}' END FROM p WHERE shape IN (2, 6)
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, unnest(['7', 'null', '"x"']) FROM p WHERE shape = 3""")
def debug_products(spark, sf):
    """Debug artifacts of eight shapes, read leniently."""
    rows = debug_json.parse_products(_artifacts(spark, sf))
    return rows.select("p_partkey", "id", "name", "url", "available", F.array_join("locations", ",").alias("locations"), F.try_element_at("specs", F.lit("RAM")).alias("ram"), F.col(debug_json.BROKEN).alias("broken"))


@query("""WITH p AS (SELECT DISTINCT lower(trim(p_name)) || '::https://x.test/' || p_partkey AS key, p_partkey AS k FROM part), s AS (SELECT * FROM p WHERE k % 8 IN (0, 1, 3)), m AS (SELECT * FROM p WHERE k % 3 = 0), b AS (SELECT * FROM p WHERE k % 2 = 0)
SELECT 'simple' AS stage, 'missing' AS side, key FROM b WHERE key NOT IN (SELECT key FROM s) UNION ALL SELECT 'simple', 'new', key FROM s WHERE key NOT IN (SELECT key FROM b)
UNION ALL SELECT 'monitor', 'missing', key FROM b WHERE key NOT IN (SELECT key FROM m) UNION ALL SELECT 'monitor', 'new', key FROM m WHERE key NOT IN (SELECT key FROM b)""")
def debug_differences(spark, sf):
    """What two parsed lists lack against a baseline, and have beyond it."""
    c = F.col
    part = table(spark, sf, "part").select(c("p_name").alias("name"), F.concat(F.lit(" HTTPS://x.test/"), c("p_partkey").cast("string")).alias("url"), c("p_partkey").alias("k"))
    rows = settled(debug_json.parse_products(_artifacts(spark, sf)))
    return debug_json.differences(part.where(c("k") % 2 == 0), simple=rows.where(c("url").isNotNull()), monitor=part.where(c("k") % 3 == 0))


# --- small expressions -------------------------------------------------------


def _turn(key: F.Column, values: list) -> F.Column:
    """One of the values, by the key."""
    return F.get(F.array(*(v if isinstance(v, F.Column) else F.lit(v) for v in values)), F.pmod(key, F.lit(len(values))).cast("int"))


@query("""WITH e AS (SELECT event_id AS k, ([200, 403, 429, 503, 521, 404, 408, 425, NULL, 599, 600])[event_id % 11 + 1] AS s, (['', 'Blocked by us', 'timed out', NULL, 'CLOUDFLARE 1020', 'a challenge', 'x'])[event_id % 7 + 1] AS m FROM events)
SELECT k AS event_id, coalesce(regexp_matches(lower(m), 'blocked|cloudflare|challenge'), false) OR coalesce(s IN (429, 521), false) AS blocked, coalesce(s IN (408, 425, 429) OR s BETWEEN 500 AND 599, false) AS again FROM e""")
def fetch_verdicts(spark, sf):
    """Which answers were blocked, and which are worth another try."""
    c = F.col
    k = c("event_id")
    e = table(spark, sf, "events").select("event_id", _turn(k, [F.lit(x).cast("int") for x in (200, 403, 429, 503, 521, 404, 408, 425, None, 599, 600)]).alias("s"), _turn(k, [F.lit(x).cast("string") for x in ("", "Blocked by us", "timed out", None, "CLOUDFLARE 1020", "a challenge", "x")]).alias("m"))
    return e.select("event_id", url.blocked_fetch(c("m"), c("s")).alias("blocked"), url.should_retry(c("s")).alias("again"))


@query("""WITH s AS (SELECT s_suppkey AS k, 'https://s' || s_suppkey || '.test' AS r, (['', '/billing', '/clients'])[s_suppkey % 3 + 1] AS p, '/x' AS tail FROM supplier), f AS (SELECT *, unnest(CASE WHEN p = '' THEN [''] ELSE ['', p] END) AS pre, generate_subscripts(CASE WHEN p = '' THEN [''] ELSE ['', p] END, 1) AS n FROM s)
SELECT k AS s_suppkey, string_agg(r || pre || '/cart.php?a=add&pid={pid}', ' ' ORDER BY n) AS pids, string_agg(r || pre || '/cart.php?gid={gid}', ' ' ORDER BY n) AS gids,
  string_agg(r || pre || '/cart.php?action=add&id={id} ' || r || pre || '/cart?action=add&id={id} ' || r || pre || '/index.php?/cart/&action=add&id={id}', ' ' ORDER BY n) || ' ' || string_agg(r || pre || '/cart/?action=add&id={id}', ' ' ORDER BY n)
    || ' ' || r || '/index.php?/cart/vps&action=add&id={id} ' || r || '/index.php?/cart/vps&cat_id=3&action=add&id={id} ' || r || '/cart?action=add&id={id}&cycle=m' AS ids FROM f GROUP BY k, r""")
def probe_templates(spark, sf):
    """The addresses by which products and groups of shops are probed: under each prefix, and as seeds show them."""
    c = F.col
    k = c("s_suppkey").cast("string")
    root = F.concat(F.lit("https://s"), k, F.lit(".test"))
    base = F.concat(root, _turn(c("s_suppkey"), ["", "/billing", "/clients"]), F.lit("/x"))
    seeds = F.array(F.concat(root, F.lit("/index.php?/cart/vps&cat_id=3")), F.concat(root, F.lit("/cart?action=add&id=77&cycle=m")), F.lit("https://other.test/index.php?/cart/no"))
    s = table(spark, sf, "supplier").select("s_suppkey", base.alias("base"), seeds.alias("seeds"))
    return s.select("s_suppkey", F.array_join(url.pid_templates(c("base")), " ").alias("pids"), F.array_join(url.gid_templates(c("base")), " ").alias("gids"), F.array_join(url.hostbill_product_templates(c("base"), c("seeds")), " ").alias("ids"))


@query("""WITH p AS (SELECT p_partkey AS k, (['Lyon', ' Graz ', '', NULL])[p_partkey % 4 + 1] AS one, p_partkey % 3 AS m, 'https://x.test/' || p_partkey AS url FROM part)
SELECT k AS p_partkey, CASE WHEN m = 0 THEN 'Lyon,Graz' WHEN m = 1 THEN 'Oslo' || CASE WHEN coalesce(trim(one), '') <> '' THEN ',' || trim(one) ELSE '' END ELSE coalesce(trim(one), '') END AS places,
  CASE WHEN m = 0 THEN 'Graz=own,Lyon=' || url WHEN m = 1 THEN CASE k % 4 WHEN 0 THEN 'Graz=own,Lyon=' || url || ',Oslo=' || url ELSE 'Graz=own,Oslo=' || url END ELSE 'Graz=own' || CASE WHEN k % 4 = 0 THEN ',Lyon=' || url ELSE '' END END AS links FROM p""")
def product_places(spark, sf):
    """The locations of products, from a list and a single one, and a link for each."""
    c = F.col
    k = c("p_partkey")
    none = F.lit(None).cast("array<string>")
    p = table(spark, sf, "part").select("p_partkey", _turn(k, [F.lit(x).cast("string") for x in ("Lyon", " Graz ", "", None)]).alias("one"), _turn(k, [F.array(F.lit("Lyon"), F.lit(" graz"), F.lit("LYON"), F.lit("")), F.array(F.lit("Oslo")), none]).alias("many"), F.concat(F.lit("https://x.test/"), k.cast("string")).alias("url"))
    p = p.withColumn("many", F.when(k % 3 == 0, F.array(F.lit("Lyon"), F.lit(" Graz"), F.lit("LYON"), F.lit(""))).otherwise(c("many")))
    links = locations.location_links(F.create_map(F.lit(" Graz "), F.lit("own")), c("many"), c("one"), c("url"))
    return p.select("p_partkey", F.array_join(locations.product_locations(c("many"), c("one")), ",").alias("places"), F.array_join(F.array_sort(F.transform(F.map_entries(links), lambda e: F.concat(e.key, F.lit("="), e.value))), ",").alias("links"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_partkey % 4 AS a, p_partkey % 3 AS b, printf('%.2f USD', p_retailprice) AS price FROM part)
SELECT k AS p_partkey, CASE a WHEN 0 THEN CASE b WHEN 1 THEN 'Yearly' WHEN 2 THEN NULL ELSE 'Monthly' END WHEN 1 THEN CASE b WHEN 2 THEN NULL ELSE 'Monthly' END WHEN 2 THEN 'Quarterly' ELSE 'Yearly,Monthly' END AS cycles,
  CASE a WHEN 0 THEN CASE b WHEN 1 THEN 'Yearly=80 USD' WHEN 2 THEN NULL ELSE 'Monthly=' || price END WHEN 1 THEN CASE b WHEN 0 THEN 'Monthly=' || price WHEN 1 THEN 'Monthly=' || price END WHEN 2 THEN CASE b WHEN 0 THEN 'Quarterly=' || price WHEN 1 THEN 'Yearly=80 USD' END
    ELSE CASE b WHEN 0 THEN 'Monthly=' || price WHEN 1 THEN CASE WHEN a = 3 THEN 'Yearly=80 USD' END END END AS prices, CASE b WHEN 1 THEN CASE a WHEN 1 THEN NULL ELSE '80 USD' END END AS preferred FROM p""")
def cycle_defaults(spark, sf):
    """What prices, cycles and their prices say about each other."""
    c = F.col
    k = c("p_partkey")
    a, b = k % 4, k % 3
    none, nothing = F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")
    listed = F.when(a == 2, F.array(F.lit("Quarterly"))).when(a == 3, F.array(F.lit("Yearly"), F.lit("Monthly"))).otherwise(none)
    prices = F.when((b == 1) & (a != 1), F.create_map(F.lit("Yearly"), F.lit("80 USD"))).otherwise(nothing)
    price = F.when((b == 0) | ((b == 1) & (a == 1)), F.format_string("%.2f USD", "p_retailprice")).otherwise("")
    p = table(spark, sf, "part").select("p_partkey", cycles.fill_defaults(price, listed, prices).alias("f"), money.preferred_price(prices).alias("preferred"))
    return p.select("p_partkey", F.array_join("f.billing_cycles", ",").alias("cycles"), F.array_join(F.transform(F.map_entries("f.cycle_prices"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("prices"), "preferred")


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_size AS s FROM part)
SELECT k AS p_partkey, '&lt;b&gt;' || n || '&lt;/b&gt; &amp; &quot;x&quot; &#x27;' || k AS escaped, '{"a":"\\u003c' || n || '\\u003e \\u0026"}' AS script, CASE k % 4 WHEN 0 THEN 'Lyon' WHEN 1 THEN 'New York' WHEN 2 THEN 'Area ' || s ELSE '' END AS place, k % 5 IN (0, 2) AS label,
  CASE k % 4 WHEN 0 THEN '/cart.php?a=add&pid=' || k WHEN 1 THEN 'https://x.test/p/' || k WHEN 2 THEN NULL ELSE 'index.php?rp=' || k END AS clicked, CASE k % 3 WHEN 0 THEN 'https://x.test/a?x=1&id=' || k WHEN 1 THEN 'https://x.test/a?id=' || k ELSE 'https://x.test/?/cart/&id=' || k END AS longer,
  k % 3 < 2 AS http, k % 4 = 0 AS tier FROM p""")
def small_texts(spark, sf):
    """Escapes, cleaned locations and their labels, addresses from handlers, longer queries, and kinds of texts."""
    c = F.col
    k, n = c("p_partkey"), c("p_name")
    key, size = k.cast("string"), c("p_size").cast("string")
    place = _turn(k, ["Lyon (Test IP: 1.2.3.4)", " New  York - In Stock ", F.concat(F.lit("Area "), size, F.lit("- sold out")), "-"])
    label = _turn(k, ["Location", "Operating OS location", "Pick a 机房", "Plan", "Node password"])
    click = _turn(k, [F.concat(F.lit("go('/cart.php?a=add&pid="), key, F.lit("')")), F.concat(F.lit("open('x', \"https://x.test/p/"), key, F.lit('")')), "hide('menu')", F.concat(F.lit("to('index.php?rp="), key, F.lit("')"))])
    longer = url.append_query(_turn(k, ["https://x.test/a?x=1#top", "https://x.test/a", "https://x.test/?/cart/&"]), F.concat(F.lit("id="), key))
    link = _turn(k, [" HTTPS://x.test", "http://x", "ftp://x.test"])
    return table(spark, sf, "part").select(
        "p_partkey", text.html_escape(F.concat(F.lit("<b>"), n, F.lit("</b> & \"x\" '"), key)).alias("escaped"), text.script_safe_json(F.to_json(F.struct(F.concat(F.lit("<"), n, F.lit("> &")).alias("a")))).alias("script"), text.clean_location(place).alias("place"),
        text.location_label(label).alias("label"), url.onclick_url(click).alias("clicked"), longer.alias("longer"), url.is_http(link).alias("http"), text.generic_tier(_turn(k, [" Pro", "Pro 2", n, "basic"])).alias("tier"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, 'site' || (p_partkey % 4) || '.test' AS domain, CASE WHEN p_partkey % 6 < 3 THEN p_partkey % 6 = 0 END AS available, p_partkey % 5 > 0 AS priced, p_partkey % 3 AS places, p_retailprice AS own FROM part)
SELECT domain, name, 'https://x.test/' || k AS url, available, CASE WHEN priced THEN printf('%.2f USD', own) WHEN k % 2 = 0 THEN '9.50 USD' ELSE '' END AS price, CASE WHEN priced THEN CASE WHEN own < 1000 THEN round(own, 2) ELSE floor(own / 10) END WHEN k % 2 = 0 THEN 9.5 END::DOUBLE AS price_value,
  CASE places WHEN 0 THEN 'Graz' WHEN 1 THEN 'Lyon' ELSE '' END AS location, CASE places WHEN 0 THEN 'Graz,Oslo' WHEN 1 THEN 'Lyon' ELSE '' END AS locations, 'RAM' AS specs, CASE WHEN k % 2 = 0 THEN 'Monthly,Yearly' ELSE '' END AS cycles, '' AS first_seen, k % 9 = 0 AS is_special
FROM p ORDER BY CASE WHEN available THEN 0 WHEN NOT available THEN 1 ELSE 2 END, domain, name, url LIMIT 100""")
def dashboard_view(spark, sf):
    """The first page of the dashboard in its default order: state rows without nulls, with prices of cycles where there is no own."""
    c = F.col
    k = c("p_partkey")
    none, nothing = F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("site"), (k % 4).cast("string"), F.lit(".test")).alias("domain"), c("p_name").alias("name"), F.concat(F.lit("https://x.test/"), k.cast("string")).alias("url"), F.when(k % 5 > 0, F.format_string("%.2f USD", "p_retailprice")).alias("price"),
        F.when(k % 6 < 3, k % 6 == 0).alias("available"), F.create_map(F.lit("RAM"), F.lit("1GB"), F.lit(" Cycles"), F.lit("x")).alias("specs"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("first_seen"), F.lit("t").alias("last_seen"),
        F.when(k % 2 == 0, F.array(F.lit("Monthly"), F.lit("Yearly"))).otherwise(none).alias("billing_cycles"), F.when(k % 2 == 0, F.create_map(F.lit("Yearly"), F.lit("80 USD"), F.lit("Monthly"), F.lit("9.50 USD"))).otherwise(nothing).alias("cycle_prices"),
        F.when(k % 3 == 1, "Lyon").alias("location"), F.when(k % 3 == 0, F.array(F.lit("Graz"), F.lit(""), F.lit("Oslo"))).otherwise(none).alias("locations"), nothing.alias("location_links"), F.lit(None).cast("string").alias("variant_of"), F.when(k % 9 == 0, True).alias("is_special"),
    )
    shown = report.page(report.dashboard_rows(rows), [*report.default_order(), c("url").asc()], 1)
    return shown.select("domain", "name", "url", "available", "price", "price_value", "location", F.array_join("locations", ",").alias("locations"), F.array_join(F.map_keys("specs"), ",").alias("specs"), F.array_join("billing_cycles", ",").alias("cycles"), "first_seen", "is_special")


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n, upper(split_part(p_name, ' ', 1)) AS w FROM part), s AS (
  SELECT *, CASE k % 4 WHEN 0 THEN 'Tokyo VPS - ' || n WHEN 1 THEN 'Tokyo Pro - Pro' WHEN 2 THEN 'Solo' ELSE 'd.test' END AS shown, CASE k % 3 WHEN 0 THEN 'Lyon' WHEN 1 THEN '' ELSE w END AS loc FROM p
)
SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN '⭐ ' ELSE '' END || shown || CASE WHEN loc <> '' AND NOT contains(lower(shown), lower(loc)) THEN ' (' || loc || ')' ELSE '' END AS shown,
  CASE k % 4 WHEN 0 THEN 'LAX.AS3.' || w WHEN 1 THEN 'TYO.X.' || w WHEN 3 THEN 'a.b.c' END AS code FROM s""")
def product_names(spark, sf):
    """Names as messages show them, and the dotted codes that stand for short ones."""
    c = F.col
    k = c("p_partkey")
    word = F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))
    name, variant = _turn(k, [c("p_name"), "Pro", "", " "]), _turn(k, ["Tokyo VPS", "Tokyo  Pro", "Solo", ""])
    link = _turn(k, [F.concat(F.lit("https://xtest/LAX.AS3."), word), "https://xtest/a.b.c", "https://xtest/a.b", "https://xtest/?q=a.b.c"])
    told = _turn(k, ["see Q.R.S", F.concat(F.lit("code TYO.X."), word), F.lit(None).cast("string"), ""])
    return table(spark, sf, "part").select(
        "p_partkey", alerts.display_name(name, variant, _turn(k, ["Lyon", "", word]), F.lit("d.test"), k % 5 == 0).alias("shown"), text.dotted_code(word, link, told).alias("code"),
    )
