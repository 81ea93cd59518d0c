"""Queries over captured storefronts: cards, links, names, specification lines, challenges, stock; each with its SQL.

Their markup and addresses are made from the tables, a few shapes in turn, so
that SQL knows what each shape must give.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cycles, money, names, specs, url
from ..operators import crawl, filters
from ..sources import cards, html
from .catalogue import table

QUERIES: dict[str, tuple] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _turn(key: Column, shapes: list[Column]) -> Column:
    """One of the shapes, by the key."""
    return F.get(F.array(*shapes), F.pmod(key, F.lit(len(shapes))).cast("int"))


def _fill(pattern: str, **values: Column) -> Column:
    out = F.lit(pattern)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


CARD_SHAPES = [
    '<div class="package"><h3>{name}</h3><p>${price} USD Monthly</p><ul><li>RAM: {size}GB</li><li>Disk Space: {size}0 GB SSD</li></ul><div class="package-footer"><a class="btn" href="/cart.php?a=add&amp;pid={key}">Order Now</a></div></div>',
    '<li class="product-row"><strong>{name}</strong> <span>€ {price}</span> <span class="qty soldout">none</span> <dl><dt>Memory</dt><dd>{size} GB</dd><dt>Zone</dt><dd>Area {size}</dd></dl> <a href="/store/vps-{size}/plan-{key}?utm_source=x">Details</a></li>',
    '<form action="/index.php?/cart/vps/" method="post" class="x"><b>{name}</b> starts at HK${price} a month <input name="action" value="add"><input name="id" value="{key}"><select name="cycle"><option value="q">HK${price} Quarterly</option></select><button>Buy now</button></form>',
    '<div class="plan"><h2>Get started</h2><span>£{price}</span><table><tr><th>CPU</th><td>{size} cores</td></tr></table><div><a data-href="/index.php?/cart/hk--nodes/kvm-{key}">Order</a> <button disabled>Out of stock</button></div></div>',
    '<div class="card"><p class="description">About us, a story with many words</p><a href="/about">{name} costs $ {price}</a></div>',
]


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, p_size AS size, printf('%.2f', p_retailprice) AS price, p_partkey % 5 AS shape, 'https://' || lower(replace(p_brand, '#', '-')) || '.test' AS site FROM part)
SELECT CASE shape WHEN 0 THEN site || '/cart.php?a=add&pid=' || k WHEN 1 THEN site || '/store/vps-' || size || '/plan-' || k || '?utm_source=x' WHEN 2 THEN site || '/index.php?/cart/vps/&action=add&id=' || k || '&cycle=q' ELSE site || '/index.php?/cart/hk--nodes/kvm-' || k END AS url,
  CASE shape WHEN 3 THEN 'kvm-' || k ELSE name END AS name, price || ' ' || (['USD', 'EUR', 'HKD', 'GBP'])[shape + 1] AS price, CASE shape WHEN 0 THEN true WHEN 2 THEN true ELSE false END AS available,
  CASE shape WHEN 0 THEN 'RAM=' || size || 'GB' WHEN 1 THEN 'RAM=' || size || ' GB' WHEN 3 THEN 'CPU=' || size || ' cores' END AS spec, CASE shape WHEN 1 THEN 'Area ' || size END AS location,
  CASE shape WHEN 1 THEN 'Vps ' || size WHEN 2 THEN 'Vps' WHEN 3 THEN 'Hk Nodes' END AS variant_of, CASE shape WHEN 0 THEN 'Monthly' WHEN 2 THEN 'Quarterly' END AS cycle,
  CASE shape WHEN 0 THEN '$' || price || ' USD Monthly' WHEN 1 THEN name || ' € ' || price || ' none Memory ' || size || ' GB Zone Area ' || size || ' Details' WHEN 2 THEN name || ' starts at HK$' || price || ' a month HK$' || price || ' Quarterly Buy now' ELSE 'Get started £' || price || ' CPU ' || size || ' cores Order Out of stock' END AS description,
  CASE shape WHEN 2 THEN 'Quarterly=' || price || ' HKD' END AS cycle_prices
FROM p WHERE shape < 4""")
def card_products(spark, sf):
    """Parts as cards of five templates on the pages of their brand, parsed back; the last shape sells nothing."""
    c = F.col
    p = table(spark, sf, "part").select("p_brand", (c("p_partkey") / 40).cast("bigint").alias("nr"), "p_partkey", _fill_card().alias("card"))
    # So many tasks as a shuffle has: pages are small, and what parsing and judging them takes isn't told by their size.
    page = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_brand", "nr").groupBy("p_brand", "nr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), "\n").alias("body"))
    pages = page.select(F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".test/deals?page="), c("nr").cast("string")).alias("url"), F.concat(F.lit('<html><body><h1>All plans</h1><a href="/store/vps/small">Small</a> <a href="/store/vps/large">Large</a>'), "body", F.lit("</body></html>")).alias("text"), c("nr").alias("seq"))
    found = cards.card_products(pages)
    spec = lambda k: F.concat(F.lit(f"{k}="), F.try_element_at("specs", F.lit(k)))
    return found.select("url", "name", "price", "available", F.coalesce(spec("RAM"), spec("CPU")).alias("spec"), "location", "variant_of", F.get("billing_cycles", F.lit(0)).alias("cycle"), "description", F.array_join(F.transform(F.map_entries("cycle_prices"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("cycle_prices"))


def _fill_card() -> Column:
    return _turn(F.col("p_partkey"), [_fill(s, name=F.col("p_name"), price=F.format_string("%.2f", "p_retailprice"), size=F.col("p_size"), key=F.col("p_partkey")) for s in CARD_SHAPES])


LINK_SHAPES = [
    "https://e.test/index.php?rp=/store/vps-{s}/plan-{k}", "https://e.test/cart.php?a=add&pid={k}", "https://e.test/products/cloud-vps/lax.an5/TINY", "https://e.test/index.php?/cart/hk--nodes/kvm-{k}",
    "https://e.test/store/special", "https://e.test/plans/basic/{s}g", "https://e.test/clientarea.php?product=x{k}", "https://e.test/cart/shared?id={k}", "https://e.test/", "https://e.test/customer/plans?page={k}",
]


def _links() -> Column:
    return _turn(F.col("p_partkey"), [_fill(s, k=F.col("p_partkey"), s=F.col("p_size")) for s in LINK_SHAPES])


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'plan-' || p_partkey WHEN 1 THEN 'pid-' || p_partkey WHEN 2 THEN 'lax.an5.TINY' WHEN 3 THEN 'kvm-' || p_partkey WHEN 4 THEN 'special' WHEN 5 THEN 'basic-' || p_size || 'g' WHEN 6 THEN 'x' || p_partkey WHEN 7 THEN 'shared' WHEN 9 THEN 'plans' END AS name,
  CASE p_partkey % 10 WHEN 0 THEN 'Vps ' || p_size WHEN 2 THEN 'Cloud Vps' WHEN 3 THEN 'Hk Nodes' WHEN 4 THEN 'Special' WHEN 7 THEN 'Shared' END AS category, p_partkey % 10 IN (4, 6, 9) AS no_product FROM part""")
def link_names(spark, sf):
    """What addresses tell of a product: its name, its category, and whether they lead to one."""
    link = table(spark, sf, "part").select("p_partkey", _links().alias("link"))
    return link.select("p_partkey", names.name_from_url(F.col("link")).alias("name"), names.category_label(F.col("link")).alias("category"), url.non_product_link(F.col("link")).alias("no_product"))


@query("""SELECT p_partkey, ([7, 10, 6, 3, 2, 3, 3, 3, 2, 3])[p_partkey % 10 + 1]::INT AS score, CASE p_partkey % 10 WHEN 1 THEN 'https://e.test/cart.php?a=add&pid=' || p_partkey WHEN 0 THEN 'https://e.test/index.php?rp=%2Fstore%2Fvps-' || p_size || '%2Fplan-' || p_partkey WHEN 2 THEN 'https://e.test/products/cloud-vps/lax.an5/TINY' END AS same FROM part""")
def link_scores(spark, sf):
    """How likely links buy, and which are one product's."""
    c = F.col
    link = table(spark, sf, "part").select("p_partkey", _links().alias("link"))
    label = F.when(c("p_partkey") % 10 == 0, "Order").otherwise(F.when(c("p_partkey") % 10 == 1, "立即购买").otherwise("Buy it"))
    return link.select("p_partkey", url.buy_score(c("link"), label, ~url.non_product_link(c("link"))).alias("score"), url.product_link_key(c("link"), ~url.non_product_link(c("link"))).alias("same"))


TEXT_SHAPES = ["Sold out  {n} 3 available $5.00", "{n}", "Save 10% now", "In stock {n} Per Month HK$ 7", "CPU node{k}.pro.tiny has it all", "your cart is empty", "2 Cores", "a | b | c | d", "Order {n} now", "one two three four five six seven eight nine ten eleven"]


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 3 THEN p_name WHEN 4 THEN 'CPU node' || p_partkey || '.pro.tiny has it all' WHEN 5 THEN 'your cart is empty' WHEN 6 THEN '2 Cores' WHEN 7 THEN 'a | b | c | d' WHEN 8 THEN 'Order ' || p_name || ' now' WHEN 9 THEN 'one two three four five six seven eight nine ten eleven' END AS of_text,
  CASE p_partkey % 10 WHEN 0 THEN 'Sold' WHEN 1 THEN nullif(regexp_extract(regexp_extract(p_name, '[A-Za-z][A-Za-z0-9._-]{2,63}'), '^.{4,}$'), '') WHEN 2 THEN 'Save' WHEN 3 THEN 'stock' WHEN 5 THEN 'your' WHEN 6 THEN 'Cores' WHEN 8 THEN 'Order' END AS of_lead,
  p_partkey % 10 IN (5, 7, 9) AS no_name, p_partkey % 10 IN (5, 8) AS action, p_partkey % 10 = 6 AS generic FROM part""")
def text_names(spark, sf):
    """Names read from the texts of cards, and what is none."""
    c = F.col
    t = table(spark, sf, "part").select("p_partkey", _turn(c("p_partkey"), [_fill(s, n=c("p_name"), k=c("p_partkey")) for s in TEXT_SHAPES]).alias("t"))
    return t.select("p_partkey", names.name_from_text(c("t")).alias("of_text"), names.name_from_lead(c("t")).alias("of_lead"), names.non_name(c("t")).alias("no_name"), names.action_label(c("t")).alias("action"), names.generic_name(c("t")).alias("generic"))


LINE_SHAPES = ["Memory : {s} GB", "vCPU cores： {s}", "Price: ${s}.00", "Setup | {s} TB traffic", "Add to cart", "Uplink {s} Mbps", "Data Center: Area {s}", "$ {s}.00 only"]


@query("""SELECT p_partkey, (['RAM', 'CPU', NULL, 'Setup', NULL, NULL, 'Datacenter', NULL])[p_partkey % 8 + 1] AS key, CASE p_partkey % 8 WHEN 0 THEN p_size || ' GB' WHEN 1 THEN p_size::VARCHAR WHEN 3 THEN p_size || ' TB traffic' WHEN 6 THEN 'Area ' || p_size END AS value, p_partkey % 8 IN (2, 4, 7) AS noise FROM part""")
def spec_pairs(spark, sf):
    """Lines as pairs with the usual keys, and lines that specify nothing."""
    c = F.col
    line = table(spark, sf, "part").select("p_partkey", _turn(c("p_partkey"), [_fill(s, s=c("p_size")) for s in LINE_SHAPES]).alias("line"))
    line = line.withColumn("pair", specs.split_line(c("line")))
    return line.select("p_partkey", "pair.key", "pair.value", specs.noise_line(c("line")).alias("noise"))


@query(r"""WITH p AS (SELECT page_id, lower(coalesce(html, '')) || CASE page_id % 6 WHEN 1 THEN ' just a moment' WHEN 2 THEN ' just a moment... cloudflare' WHEN 3 THEN ' /cdn-cgi/challenge-platform/x' WHEN 4 THEN ' attention required! | cloudflare' ELSE '' END AS body, ([200, 403, 429, 503, 521, 404, 200])[page_id % 7 + 1] AS status, page_id % 5 AS edge FROM pages)
SELECT page_id, status = 521 OR (contains(body, '/cdn-cgi/') AND regexp_matches(body, 'challenge-platform|cf-chl|__cf_chl|jschl|turnstile')) OR (contains(body, 'just a moment') AND (contains(body, 'cloudflare') OR contains(body, 'checking your browser'))) OR (contains(body, 'attention required') AND contains(body, 'cloudflare')) OR (status IN (403, 429, 503) AND edge IN (1, 2)) AS challenge FROM p""")
def challenge_pages(spark, sf):
    """Pages with the marks of a challenge put in, some answered by an edge server."""
    c = F.col
    n = c("page_id")
    body = F.concat(F.coalesce("html", F.lit("")), _turn(n, [F.lit(""), F.lit(" Just a moment"), F.lit(" Just a Moment... Cloudflare"), F.lit(" /cdn-cgi/challenge-platform/x"), F.lit(" Attention Required! | Cloudflare"), F.lit("")]))
    status = _turn(n, [F.lit(x) for x in (200, 403, 429, 503, 521, 404, 200)])
    headers = _turn(n, [F.create_map(F.lit(k), F.lit(v)) for k, v in (("x", "cloudflare"), ("CF-Ray", "8a"), ("Server", "CloudFlare"), ("cf-cache-status", ""), ("cf-mitigated", "challenge"))])
    return table(spark, sf, "pages").select("page_id", filters.challenge_page(status, body, headers).alias("challenge"))


@query(r"""WITH p AS (SELECT page_id, lower(url || (['', '/cart.php', '/store/vps', '/index.php?/cart/a', '/products/cart/x', '/cart.php?gid=3', '/pages/pricing'])[page_id % 7 + 1]) AS u FROM pages)
SELECT page_id, (2 * regexp_matches(u, 'rp=/store|/store/')::INT + 2 * regexp_matches(u, '/cart/')::INT + 2 * contains(u, '/products/')::INT - contains(u, '/products/cart/')::INT + 2 * contains(u, 'cart.php?gid=')::INT + ends_with(u, '/cart.php')::INT + (contains(u, '/pages/pricing') OR ends_with(u, '/pricing'))::INT)::INT AS score FROM p""")
def candidate_scores(spark, sf):
    """How promising pages are as listings."""
    tails = [F.lit(x) for x in ("", "/cart.php", "/store/vps", "/index.php?/cart/a", "/products/cart/x", "/cart.php?gid=3", "/pages/pricing")]
    return table(spark, sf, "pages").select("page_id", crawl.candidate_score(F.concat("url", _turn(F.col("page_id"), tails))).alias("score"))


STOCK_SHAPES = [
    "<p class='out-of-stock'></p><button>Add to cart</button>", "<p class='xsoldout'>last ones</p><a>Order now</a>", "<button>Sold out</button><p>in stock</p>", "<button>In stock</button><p>sold out</p>", "<button disabled>Buy now</button><p>x</p>",
    "<select name='billingcycle'></select><a>Buy now</a><a>Sold out</a>", "<a>Buy now</a><a>Sold out</a>", "<p>5 available</p>", "<p>nothing told</p>", "<input type='submit' value='加入购物车'>",
]


@query("SELECT page_id, ([false, true, false, true, NULL, true, false, true, NULL, true])[page_id % 10 + 1] AS available FROM pages")
def detail_availability(spark, sf):
    """Stock as detail pages of ten shapes tell it, behind the pages' own markup."""
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), _turn(F.col("page_id"), [F.lit(s) for s in STOCK_SHAPES])).alias("h"))
    return pages.withColumn("els", html.elements(F.col("h"))).select("page_id", html.availability_in_page(F.col("els"), F.col("h")).alias("available"))


PAGE_SHAPES = [
    "<p>Product does not exist</p> billingcycle", "<select name='billingcycle'></select>", "<p>12 left</p>", "<a href='/cart.php?a=add&pid=3'>x</a>", "<a href='/index.php?rp=/store/x'>Configure</a>", "<p>No products found</p> cart.php pid=3",
    "<form action='?/cart/'><input name='id' value='44'>Order</form>", "<a href='/cart/a'>order</a>", "<a href='?action=add&amp;id=9'>x</a>", "   ", "<h2>Billing Cycle</h2> step=3", "<p>Invalid product</p>",
]


@query("""SELECT page_id, page_id % 12 IN (1, 2) AS whmcs_product, page_id % 12 IN (3, 4) AS whmcs_group, page_id % 12 IN (2, 4, 10) AS hostbill_product, page_id % 12 IN (6, 7, 8) AS hostbill_group FROM pages""")
def probe_pages(spark, sf):
    """Which answers to a probe show a product or a group, by platform: the pages' own markup before twelve shapes, alone where it must be empty."""
    c = F.col
    n = c("page_id")
    h = F.concat(F.when(n % 12 == 9, "").otherwise(F.coalesce("html", F.lit(""))), _turn(n, [F.lit(s) for s in PAGE_SHAPES]))
    tests = {"whmcs_product": filters.whmcs_product_page, "whmcs_group": filters.whmcs_group_page, "hostbill_product": filters.hostbill_product_page, "hostbill_group": filters.hostbill_group_page}
    pages = table(spark, sf, "pages").select("page_id", h.alias("h"))
    return pages.select("page_id", *(f(c("h")).alias(k) for k, f in tests.items()))


KIND_SHAPES = [
    "https://e.test/cart.php", "https://e.test/cart.php?a=add&pid={k}", "https://e.test/billing/store", "https://e.test/index.php?rp=/store", "https://e.test/index.php?rp=/store/vps/p{k}", "https://e.test/index.php?/cart/vps/p{k}/x",
    "https://e.test/api/plans?page={k}", "https://e.test/pricing", "https://e.test/products", "https://e.test/index.php?/cart/vps&action=add&id={k}",
]


@query("""SELECT p_partkey, p_partkey % 10 IN (0, 2, 3) AS listing, p_partkey % 10 IN (0, 2, 3, 6, 7, 8, 9) AS solvable, p_partkey % 10 IN (8) AS no_product,
  CASE WHEN p_partkey % 10 = 1 THEN p_partkey END AS pid, CASE p_partkey % 10 WHEN 9 THEN p_partkey END AS id FROM part""")
def url_kinds(spark, sf):
    """Listings, pages worth a costly fetch, pages that sell nothing, and the ids in addresses."""
    c = F.col("u")
    u = table(spark, sf, "part").select("p_partkey", _turn(F.col("p_partkey"), [_fill(s, k=F.col("p_partkey")) for s in KIND_SHAPES]).alias("u"))
    return u.select("p_partkey", url.primary_listing(c).alias("listing"), url.solver_allowed(c).alias("solvable"), url.non_product_page(c).alias("no_product"), url.param_int(c, "pid").alias("pid"), url.param_int(c, "id").alias("id"))


PRICE_SHAPES = ["from $1,{n}.50 / mo", "{n}.25 EUR yearly", "NT$ {n}", "¥{n}元", "HK${n}.5", "free of charge", "{n} CPU cores", "£ {n},75 now"]


@query("""WITH p AS (SELECT p_partkey, p_size + 100 AS n FROM part) SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '1' || n || '.50 USD' WHEN 1 THEN n || '.25 EUR' WHEN 2 THEN n || ' TWD' WHEN 3 THEN n || ' CNY' WHEN 4 THEN n || '.5 HKD' WHEN 7 THEN n || '.75 GBP' END AS price,
  CASE p_partkey % 8 WHEN 0 THEN (1000 + n) // 10 WHEN 1 THEN n + 0.25 WHEN 2 THEN n WHEN 3 THEN n WHEN 4 THEN n + 0.5 WHEN 7 THEN n + 0.75 END::DOUBLE AS value FROM p""")
def price_shapes(spark, sf):
    """Prices with thousands, symbols of two letters, decimal commas, and texts without any.

    As a number, a price is its first one to three digits and whole groups of
    thousands behind commas: without commas, longer ones are cut there.
    """
    p = table(spark, sf, "part").select("p_partkey", money.extract_price(_turn(F.col("p_partkey"), [_fill(s, n=F.col("p_size") + 100) for s in PRICE_SHAPES])).alias("p"))
    return p.select("p_partkey", "p.price", money.price_value(F.col("p.price")).alias("value"))


CYCLE_SHAPES = ["月付 or 年付", "billed semi-annually", "每三年", "One Time fee", "monthly, quarterly and annually", "nothing", "半年", "Biennially / triennially"]


@query("""SELECT p_partkey, (['Monthly', 'Monthly', 'Triennial', 'Monthly', 'Monthly', 'Triennial', 'Semiannual', 'Yearly'])[p_partkey % 8 + 1] AS label, ([ 'Monthly,Yearly', 'Semiannual', '', '', 'Monthly,Quarterly,Yearly', '', 'Semiannual', 'Biennial,Triennial'])[p_partkey % 8 + 1] AS cycles FROM part""")
def cycle_texts(spark, sf):
    """Cycle labels and all cycles of texts in two languages. A label is by the first known key that the text holds, also within a word."""
    t = table(spark, sf, "part").select("p_partkey", _turn(F.col("p_partkey"), [F.lit(s) for s in CYCLE_SHAPES]).alias("t"))
    return t.select("p_partkey", cycles.normalize_cycle(F.col("t")).alias("label"), F.coalesce(F.array_join(cycles.cycles_in_text(F.col("t")), ","), F.lit("")).alias("cycles"))
