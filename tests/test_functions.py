"""Tables of cases for the scalar expressions."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import availability, cycles, locations, money, specs, text, url
from tallyforge.operators import filters


@pytest.fixture
def run(spark):
    def run(cases, make, kind="string"):
        rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, c {kind}")
        got = {r.i: r.r for r in rows.select("i", make(F.col("c")).alias("r")).collect()}
        for i, (c, want) in enumerate(cases):
            value = got[i].asDict(recursive=True) if hasattr(got[i], "asDict") else got[i]
            assert value == want, (c, value, want)

    return run


def test_price(run):
    none = {"price": None, "currency": None}
    p = lambda t: {"price": t, "currency": t.split()[1]}
    run(
        [
            ("Only $9.99 / mo", p("9.99 USD")), ("pay 12 GBP today", p("12 GBP")), ("从开始 ¥1,999.00 CNY 月缴", p("1999.00 CNY")), ("HK$ 5", p("5 HKD")), ("NT$1,234,567", p("1234567 TWD")), ("€3,50", p("3.50 EUR")),
            ("12 rmb", p("12 CNY")), ("usd 7", p("7 USD")), ("$1,234", p("1234 USD")), ("no price", none), (None, none), ("", none), ("5 US$", p("5 USD")), ("$\u00a07", p("7 USD")),
        ],
        money.extract_price,
    )
    run([("9.99 USD", 9.99), ("1,234.50 USD", 1234.5), ("", None), (None, None), ("free", None), ("12345.6", 123.0)], money.price_value)


def test_units(run):
    run([(1, "Monthly"), (36, "Triennial"), (5, "5 Months"), (0, None), (None, None)], money.months_label, "int")
    run([(2048.0, "2GB"), (1536.0, "1.5GB"), (512.0, "512MB"), (None, None)], money.megabytes_text, "double")
    run([(1999.0, "19.99 CNY"), (None, None)], lambda c: money.cents_text(c, "CNY"), "double")
    best = "array<struct<price:double,cycle:bigint>>"
    run([([(300.0, 3), (120.0, 1)], 120.0), ([(300.0, 3), (1000.0, 12)], 1000 / 12), ([], None), (None, None)], money.best_monthly, best)


def test_availability(run):
    run(
        [
            ("Add to cart", None), ("Out of stock - Add to cart", False), ("In Stock", True), ("3 available", True), ("Stock: 0", False), ("Stock: 0, 5 left", None), ("sold out, in stock", None), ("unavailable 5", True), ("库存：3", True),
            ("缺货", False), ("有库存", True), (None, None), ("", None), ("inventory -2", False),
        ],
        availability.extract_availability,
    )


def test_cycles(run):
    run([("monthly", "Monthly"), ("m", "Monthly"), ("3 Years", "Semiannual"), ("$50 USD Annually", "Semiannual"), ("月付", "Monthly"), ("半年", "Semiannual"), ("两年", "Biennial"), ("年", "Yearly"), ("1", None), ("", None), (None, None)], cycles.normalize_cycle)
    run([("Monthly, quarterly and MONTHLY", ["Monthly", "Quarterly"]), ("class cycle-q x", ["Quarterly"]), ("?billingcycle=annually", ["Yearly"]), ("", None), ("none", None)], cycles.cycles_in_text)


def test_specs(run):
    run(
        [
            ("Bandwidth: 1200GB Traffic: 1200GB BandwidthTraffic: 1200GB", {"Bandwidth": "Bandwidth: 1200GB"}), ("2 vCPU 4GB RAM 50 GB NVMe 1 Gbps", {"RAM": "4GB RAM", "CPU": "2 vCPU", "Disk": "50 GB NVMe", "Port": "1 Gbps"}), ("nothing", None), (None, None),
        ],
        specs.extract_specs,
    )
    m = "map<string,string>"
    run([({" CPU ": " 2  v ", "cycles": "x", "": "y"}, {"CPU": "2 v"}), ({"Bandwidth": "1TB", "Traffic": "1 TB/mo"}, {"Bandwidth": "1TB"}), ({}, None), (None, None)], specs.clean_specs, m)
    run([("CPU | 2 | RAM | 4 | x", {"CPU": "2", "RAM": "4"}), ("only", None), (None, None), ("a|1|a|2", {"a": "1"})], specs.bar_pairs)
    run([("CPU：2", {"key": "CPU", "value": "2"}), ("a: b: c", {"key": "a", "value": "b: c"}), ("none", None), (None, None)], specs.split_line)
    run([("CPU: 2 cores RAM: 4 GB", [{"key": "CPU", "value": "2 cores"}, {"key": "RAM", "value": "4 GB"}])], lambda c: F.from_json(F.to_json(specs.key_value_pairs(c)), "array<map<string,string>>"))


def test_url_identity(run):
    run(
        [
            ("https://example.test/p?a=1&utm_source=x&b=2&fbclid=y", "https://example.test/p?a=1&b=2"), ("https://example.test/index.php?/cart/&cat_id=7&action=add&id=94&cycle=a", "https://example.test/index.php?action=add&id=94"),
            ("https://example.test/x/?b=2&a=1#f", "https://example.test/x?a=1&b=2"), ("https://e.test/index.php?/cart/vps/&step=1", "https://e.test/index.php?/cart/vps/&step=1"), ("https://e.test/?q=a%20b~*", "https://e.test?q=a+b~%2A"), ("/rel/", "/rel"), ("https://e.test/a;p", "https://e.test/a"),
            ("https://e.test/?x=%zz", "https://e.test?x=%25zz"), (None, ""),
        ],
        url.normalize_for_id,
    )
    run([("https://A.test:8080/x", "a.test:8080"), ("nope", ""), (None, "")], url.domain)
    run([("http://x/?pid=7&pid=8", 7), ("http://x/?PID=7", None), ("http://x/?pid=a", None), ("http://x/", None)], lambda c: url.param_int(c, "pid"))
    run([("http://x/cart.php?a=add", True), ("http://x/cart.php?a=add&pid=1", False), ("http://x/store", True), ("http://x/blog/1", True), ("http://x/vps/1", False), ("http://x/index.php?/cart/vps/", True), ("http://x/?domain=register", True), ("http://x/index.php?rp=/knowledgebase", True)], url.non_product_page)
    run([("http://x/cart.php", True), ("http://x/cart.php?pid=1", False), ("http://x/index.php?rp=/store", True), ("http://x/index.php?rp=/store/a", False), ("http://x/a/store", False)], url.primary_listing)
    run([("http://x/cart.php?gid=1", True), ("http://x/cart.php?a=add&pid=1", False), ("http://x/api/p", True), ("http://x/index.php?/cart/a/b/c", False), ("http://x/cart", True)], url.solver_allowed)


def test_canonical_key(spark):
    cases = [
        ("https://e.test/cart.php?a=add&pid=10", "Plan A", None, "e.test::cart.php::pid:10"), ("https://e.test/?PlanId=3", "x", None, "e.test::planid:3"), ("https://e.test/index.php?rp=/store/a/b", "x", None, "e.test::url:https://e.test/index.php?rp=%2Fstore%2Fa%2Fb"),
        ("https://e.test/vps/one", "x", None, "e.test::url:https://e.test/vps/one"), ("https://e.test/", "Plan A", "Los Angeles", "e.test::name:losangeles:plana"), ("https://e.test/cart.php", "Plan A", None, "e.test::name:plana"), ("https://e.test/cart.php", "", None, "e.test::url:https://e.test/cart.php"),
    ]
    rows = spark.createDataFrame([(u, n, v) for u, n, v, _ in cases], "u string, n string, v string")
    assert [r[0] for r in rows.select(url.canonical_key(F.lit("e.test"), F.col("u"), F.col("n"), F.col("v"))).collect()] == [c[-1] for c in cases]


def test_text(run):
    run([(" a \u00a0\n b ", "a b"), (None, ""), ("\u2003", "")], text.compact_ws)
    run([("Los  Angeles!", "los-angeles"), ("日本", "x"), (None, "x")], text.slugify)
    run([("香港特供套餐", True), ("plain", False), (None, False)], lambda c: text.special_offer(c, F.lit("http://x")))
    run([("New York (Test IP: 1.2.3.4) - In Stock", "New York"), (" - a - ", "a"), (None, "")], text.clean_location)
    run([("Data Center Location", True), ("Operating System", False), ("", False), ("Node", True)], text.location_label)
    run([("shop.example.co.uk", "example"), ("www.a-b.com", "ab"), ("localhost", "localhost"), ("", "site"), (None, "site")], text.domain_tag)
    run([("<a href=\"x\">'&", "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"), (None, "")], text.html_escape)
    run([("</script>&\u2028", "\\u003c/script\\u003e\\u0026\\u2028")], text.script_safe_json)
    run([("abc", "abc"), ("a" * 50, "aaaaaaa..."), ("&&&&", "&..."), (None, "")], lambda c: text.trim_to_escaped(c, 10))
    run([("Plan A2", 3), ("x", 0), ("abc-1 x", 4), (None, 0)], text.name_quality)
    names = ["a10", "A9", "b1", "a9b"]
    run([(n, sorted(names, key=lambda x: (x.lower() != "a9", x.lower() != "a9b", x.lower() != "a10")).index(n)) for n in names], lambda c: F.array_position(F.array_sort(F.array(*(text.natural_key(F.lit(n)) for n in names))), text.natural_key(c)).cast("int") - 1)


def test_white_space_of_any_kind(run):
    old = re.compile(r"[\s\x1c-\x1f]+")
    ends = [chr(i) for i in (*range(1, 0x300), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    texts = [f"a{x}{y}{z}b {x}" for x in ends for y in ("", " ", "x", "\t", "\xa0") for z in ("", " ", "\u3000")] + ["", " ", "  a  b ", "\u3000 a"]
    run([(t, old.sub(" ", t).strip(" ")) for t in texts], text.compact_ws)


def test_trimming_takes_no_character_by_itself(run, spark):
    from tallyforge.operators import alerts

    raws = ["", "abc", "&", "a&b " * 9, "&amp;" * 4, "<'\">&" * 3, "ab &quot; ", "𝄞&" * 8, "x" * 30, "a    &    b     ", "&\n&\n&"]
    for most in (-1, 0, 1, 2, 3, 4, 5, 8, 9, 13, 14, 15, 16, 17, 30):

        def told(t, most=most):
            if len(html.escape(t)) <= max(most, 0):
                return t
            fits = [n for n in range(len(t) + 1) if len(html.escape(t[:n])) + 3 <= most]
            return t[: fits[-1]].rstrip(" ") + "..." if fits else ""

        run([(t, told(t)) for t in raws], lambda c: text.trim_to_escaped(c, F.lit(most)))  # noqa: B023
        run([(t, html.escape(told(t))) for t in raws], lambda c: text.escaped_start(c, F.lit(most)))  # noqa: B023
    rows = spark.createDataFrame([], f"{schemas.PRODUCT}, kind string")
    assert "regexp_extract_all" not in alerts.messages(rows, "now")._jdf.queryExecution().optimizedPlan().toString()


def test_values_of_many_elements_are_computed_once(spark):
    from tallyforge.sources import cards

    rows = spark.createDataFrame([("RAM: 2GB CPU: 3 | x", {"1": "y"})], "s string, m map<string,string>")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    entry = F.struct(F.reverse("s").alias("key"), F.col("s").alias("value"))
    assert plan(specs.first_entries(F.array(entry))).count("reverse(") == 1
    for f in (specs.extract_specs, specs.multi_pairs, specs.named_bar_pairs, cycles.normalize_cycle, cycles.cycles_in_text, availability.extract_availability, lambda c: cards.all_specs(F.col("m"), c)):
        assert plan(f(F.reverse("s"))).count("reverse(") <= 3, f
    kinds = [r"(?=[a\.])(?:a\.b|\.c)", r"(?=[\-\[])(?:\[x|\-)"]
    assert [text.begins(w) + f"(?:{text.either(w)})" for w in (["a.b", ".c"], ["[x", "-"])] == [k.replace("[a\\.]", "[\\.a]") for k in kinds]


def test_generated_addresses(run):
    run([("https://e.test/billing/clients/x", ["", "/billing", "/clients"]), ("https://e.test/", [""])], url.scan_prefixes)
    run([("https://e.test/a", ["https://e.test/cart.php?a=add&pid={pid}"])], url.pid_templates)
    run([("https://e.test/clients/", 12), ("https://e.test/", 9)], lambda c: F.size(url.entry_points(c)))
    seeds = F.array(F.lit("https://e.test/index.php?/cart/vps/&action=add&id=12"), F.lit("https://other.test/index.php?/cart/x/"))
    run([("https://e.test/", ["https://e.test/index.php?/cart/", "https://e.test/cart/", "https://e.test/index.php?/cart/vps/"])], lambda c: url.hostbill_routes(c, seeds))
    run([("https://e.test/", True)], lambda c: F.array_contains(url.hostbill_product_templates(c, seeds), "https://e.test/index.php?/cart/vps/&action=add&id={id}"))
    run([("<a href='?a=add&amp;pid=7'><a href='x?PID=8&gid=9'>", [7, 8])], lambda c: url.id_candidates(c, ["pid"]))
    run([("<input name='pid' value='7'>", True), ("?pid=77", False), ("&pid=7&", True)], lambda c: url.mentions_id(c, F.lit(7), ["pid"]))
    run([("location.href='/cart.php?a=add&pid=1'", "/cart.php?a=add&pid=1"), ("go()", None), (None, None)], url.onclick_url)


def test_fetch_predicates(spark):
    rows = spark.createDataFrame([(200, None), (403, None), (429, None), (521, None), (503, "Cloudflare challenge"), (500, None), (None, "timeout")], "s int, e string")
    got = rows.select(url.blocked_fetch(F.col("e"), F.col("s")), url.should_retry(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(False, False), (False, False), (True, True), (True, True), (True, True), (False, True), (False, False)]
    pages = [("Product does not exist", False), ("choose a billingcycle", True), ("Out of stock", True), ("", False)]
    html = spark.createDataFrame([(p,) for p, _ in pages], "h string")
    assert [r[0] for r in html.select(filters.whmcs_product_page(F.col("h"))).collect()] == [x for _, x in pages]


def test_locations(spark):
    row = spark.createDataFrame([(["LA", "la ", " "], "New York", {" LA ": "u1"}, "u0")], "l array<string>, o string, k map<string,string>, u string")
    got = row.select(locations.product_locations(F.col("l"), F.col("o")).alias("a"), locations.location_links(F.col("k"), F.col("l"), F.col("o"), F.col("u")).alias("b")).first()
    assert got.a == ["LA", "New York"] and got.b == {"LA": "u1", "New York": "u0"}
