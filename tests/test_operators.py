"""Operators on small products, runs, states and pages."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import alerts, crawl, filters, merge, report, state
from tallyforge.sources import cards, html, state_json, store_json, targets

DEFAULT = {"currency": None, "description": None, "specs": None, "available": None, "variant_of": None, "location": None, "locations": None, "location_links": None, "billing_cycles": None, "cycle_prices": None, "is_special": False, "price": "10.00 USD"}


def products(spark, *rows):
    names = [f.split(" ", 1)[0] for f in schemas.PRODUCT.split(", ")]
    full = []
    for i, r in enumerate(rows):
        p = {**DEFAULT, "domain": "e.test", "url": "https://e.test/cart.php?a=add&pid=1", "name": f"Plan {i}", "id": f"p{i}", "seq": i, **r}
        full.append(tuple(p[n] for n in names))
    return spark.createDataFrame(full, schemas.PRODUCT)


def test_merge_unites_locations_and_stock(spark):
    p = products(
        spark,
        {"name": "Plan A", "available": False, "location": "Los Angeles", "variant_of": "AMD", "billing_cycles": ["Monthly"], "cycle_prices": {"Monthly": "$3.00"}, "url": "https://e.test/cart.php?a=add&pid=1&x=1"},
        {"name": "Plan A 2", "available": True, "location": "New York", "variant_of": "VDS", "billing_cycles": ["Quarterly", "Monthly"], "cycle_prices": {"Monthly": "$4.00", "Quarterly": "$9"}},
        {"name": "Plan A", "available": None, "location": "los angeles", "variant_of": "VDS", "is_special": True},
        {"name": "Other", "available": None, "url": "https://e.test/cart.php?a=add&pid=2", "locations": ["X", "x "], "location": "Y"},
    )
    merged = {r.name: r for r in merge.merge_plans(p).collect()}
    a = merged["Plan A 2"]
    assert (a.id, a.available, a.variant_of, a.location, a.locations) == ("p1", True, "VDS", "Los Angeles", ["Los Angeles", "New York"])
    assert a.billing_cycles == ["Monthly", "Quarterly"] and a.cycle_prices == {"Monthly": "$3.00", "Quarterly": "$9"} and a.is_special and a.specs == {"Location": "Los Angeles, New York"}
    assert a.location_links["Los Angeles"].endswith("x=1") and len(merged) == 2
    assert merged["Other"].locations == ["X", "Y"] and merged["Other"].specs is None


@pytest.mark.parametrize("values, expected", [([True, False], True), ([False, False], False), ([False, None], None), ([None], None)])
def test_three_values(spark, values, expected):
    p = products(spark, *({"available": v} for v in values))
    assert merge.merge_plans(p).first().available is expected


def test_merge_does_not_depend_on_partitions(spark):
    p = products(spark, *({"id": f"p{i}", "available": [True, False, None][i % 3], "location": f"L{i % 4}", "variant_of": f"v{i % 2}", "cycle_prices": {"Monthly": f"${i}"}} for i in range(20)))
    assert merge.merge_plans(p.repartition(7, "id")).collect() == merge.merge_plans(p.coalesce(1)).collect()


def test_merge_gathers_combined_entries(spark):
    """Rows that repeat an entry, or tell a fourth error, are gone before any row is gathered."""
    many = [{"id": f"p{i:03}", "location": f"L{i % 3}", "variant_of": f"v{i % 2}", "billing_cycles": [["Monthly"], ["Yearly", "Monthly"], None][i % 3], "cycle_prices": {"Monthly": f"${i}"}} for i in range(101)]
    p = products(spark, *many)
    got = merge.merge_plans(p).first()
    assert (got.locations, got.variant_of, got.billing_cycles, got.cycle_prices) == (["L0", "L1", "L2"], "v0", ["Monthly", "Yearly"], {"Monthly": "$0"})
    r = runs(spark, *(("a", False, f"e{i}", {}) for i in range(50)))
    assert merge.merge_runs(r).first().error == "e0; e1; e2"
    for df, most in ((merge.merge_plans(p), 3 + 3 + 1 + 2 + 2), (merge.merge_runs(r), 3)):
        assert 0 < gathered(df) <= most


def test_listings_of_a_plan_are_settled_together(spark, monkeypatch):
    """So they combine before they are shuffled: else each is shuffled whole, and its entries again."""
    from tallyforge.plans import queries

    seen = []

    def watched(df):
        if "key" in df.columns:
            seen.append(df.select("key", F.spark_partition_id().alias("at")).distinct().groupBy("key").count().agg(F.max("count"), F.count("*")).first())
        return df

    monkeypatch.setattr(queries, "settled", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries.merge_plans(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(x) for x in seen] == [(1, 200)]


def gathered(df):
    """The rows that come to the first aggregate that collects a list."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "partial_collect_list" in node.verboseStringWithSuffix(1000):
            found.append(rows_of(node.children().apply(0)))
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage")):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def rows_of(node):
    """The rows that a node gives, as its nearest counting node tells."""
    while not node.metrics().contains("numOutputRows"):
        node = node.plan() if "QueryStage" in node.nodeName() else node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


def test_first_last_mode(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("a", 4, "y")], "k string, seq long, v string")
    assert {tuple(r) for r in merge.first_per_key(df, ["k"]).collect()} == {("a", 1, "x"), ("b", 3, "z")}
    assert {tuple(r) for r in merge.last_per_key(df, ["k"]).collect()} == {("a", 1, "y"), ("b", 3, "z")}
    assert {tuple(r) for r in merge.mode_per_key(df, ["k"], "v").collect()} == {("a", "y"), ("b", "z")}


def test_cycle_defaults_and_overrides(spark):
    p = products(spark, {}, {"price": None, "cycle_prices": {"Yearly": "$1"}}, {"price": None}, {"billing_cycles": ["Quarterly"]})
    got = [(r.billing_cycles, r.cycle_prices) for r in merge.fill_cycle_defaults(p).orderBy("seq").collect()]
    assert got == [(["Monthly"], {"Monthly": "10.00 USD"}), (["Yearly"], {"Yearly": "$1"}), (None, None), (["Quarterly"], {"Quarterly": "10.00 USD"})]
    o = merge.override(p, name=F.lit(None).cast("string"), available=F.lit(None).cast("boolean"), price=F.lit("1")).first()
    assert (o.name, o.available, o.price) == ("Plan 0", None, "1")


def test_noise_and_discovery(spark):
    p = products(spark, {"name": " "}, {"name": "Ok"}, {"name": "Browse All Products"}, {"name": "Ok", "url": "https://e.test/submitticket.php"}, {"name": "Item"}, {"name": "x", "price": None})
    assert [r.seq for r in filters.without_noise(p).orderBy("seq").collect()] == [1]
    bases = spark.createDataFrame([("e.test", "https://e.test/"), ("none.test", "https://none.test/")], "domain string, base_url string")
    assert {tuple(r) for r in filters.needs_discovery(p, bases).collect()} == {("e.test", False), ("none.test", True)}


def runs(spark, *rows):
    meta = {"may_be_incomplete": False, "deadline_exceeded": False, "discovery_stop_reason": None, "discovery_fetch_errors": 0}
    return spark.createDataFrame([(d, ok, err, 5, Row(**{**meta, **m}), i) for i, (d, ok, err, m) in enumerate(rows)], schemas.RUN)


def test_run_merge(spark):
    r = runs(spark, ("a", False, "e1", {}), ("a", False, "e2", {"discovery_stop_reason": "queue_exhausted"}), ("a", False, "e3", {"discovery_stop_reason": "max_pages"}), ("a", False, "e4", {}), ("b", True, None, {"discovery_stop_reason": "odd"}), ("b", False, "x", {}), ("c", False, None, {}))
    got = {x.domain: x for x in merge.merge_runs(r).collect()}
    assert (got["a"].ok, got["a"].error, got["a"].duration_ms, got["a"].discovery_stop_reason) == (False, "e1; e2; e3", 20, "max_pages")
    assert (got["b"].ok, got["b"].error, got["b"].discovery_stop_reason) == (True, None, "odd") and got["c"].error == "fetch failed"


EMPTY = {"last_notified_new": None, "last_notified_restock": None, "last_notified_new_location": None}


def snapshot(spark, *rows):
    names = [f.split(" ", 1)[0] for f in schemas.STATE_PRODUCT.split(", ")]
    full = [{**DEFAULT, **EMPTY, "domain": "e.test", "url": "https://e.test/cart.php?a=add&pid=1", "first_seen": "t0", "last_seen": "t0", "last_change": "t0", "name": f"Plan {i}", "id": f"p{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schemas.STATE_PRODUCT)


def domains(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.STATE_DOMAIN)


def test_state_update(spark):
    before = snapshot(spark, {"available": False}, {"available": None}, {"available": True}, {"id": "gone"}, {"id": "other", "domain": "failed.test"}, {"id": "v", "variant_of": "V", "location": "A"})
    new = products(spark, {"available": True}, {"available": True}, {"available": True, "currency": "EUR", "description": "d"}, {"id": "new", "available": None, "variant_of": "V", "location": "B"}, {"id": "new2", "available": True}, {"id": "new3", "available": False, "variant_of": "W", "location": "C"}, {"id": "new4", "available": True, "variant_of": "W", "location": "D"})
    r = runs(spark, ("e.test", True, None, {}), ("failed.test", False, "boom", {}))
    done = state.update_state(before, domains(spark, ("failed.test", "ok", "t0", None, 1), ("e.test", "error", None, "x", 1)), new, r, "t1")
    got = {x.id: x for x in done.products.collect()}
    assert set(got) == {"p0", "p1", "p2", "other", "new", "new2", "new3", "new4"}
    # links are filled in on both sides only where the state has them: here they are new, which is a change
    assert {k: (x.first_seen, x.last_seen) for k, x in got.items()}["p0"] == ("t0", "t1") and got["other"].last_seen == "t0"
    assert {(a.kind, a.id) for a in done.alerts.collect()} == {("restock", "p0"), ("new_location", "new"), ("new", "new2"), ("new_location", "new4")}
    assert got["p0"].last_notified_restock == "t1" and got["p1"].last_change == "t1" and got["p2"].last_change == "t0"
    assert done.summary.first().asDict() == {"started_at": "t1", "finished_at": "t1", "restocks": 1, "new_products": 4, "domains_ok": 1, "domains_error": 1}
    d = {x.domain: x for x in done.domains.collect()}
    assert (d["failed.test"].last_status, d["failed.test"].last_ok, d["failed.test"].last_error) == ("error", "t0", "boom") and d["e.test"].last_ok == "t1"


def test_unchanged_run_only_moves_last_seen(spark):
    new = products(spark, {"available": True, "location": "A", "specs": {"a": "1", "b": "2"}}, {"available": None})
    r = runs(spark, ("e.test", True, None, {}))
    first = state.update_state(spark.createDataFrame([], schemas.STATE_PRODUCT), spark.createDataFrame([], schemas.STATE_DOMAIN), new, r, "t1").products
    again = state.update_state(first, spark.createDataFrame([], schemas.STATE_DOMAIN), new, r, "t2")
    a, b = ({x.id: x.asDict() for x in df.collect()} for df in (first, again.products))
    assert all({**a[k], "last_seen": "t2"} == b[k] for k in a) and again.alerts.count() == 0


@pytest.mark.parametrize("meta, seen, kept", [({}, 1, 1), ({"may_be_incomplete": True}, 1, 3), ({"discovery_stop_reason": "max_pages"}, 3, 3), ({"may_be_incomplete": True, "x": 0}, 3, 3), ({"discovery_stop_reason": "queue_exhausted", "discovery_fetch_errors": 1}, 2, 3), ({"discovery_stop_reason": "queue_exhausted"}, 2, 2)])
def test_guarded_pruning(spark, meta, seen, kept):
    meta = {k: v for k, v in meta.items() if k != "x"}
    before = snapshot(spark, {}, {}, {})
    new = products(spark, *({"id": f"p{i}"} for i in range(seen)))
    assert state.pruned(before, new, runs(spark, ("e.test", True, None, meta))).count() == kept


def test_equal_sized_incomplete_run_prunes(spark):
    before = snapshot(spark, {}, {})
    new = products(spark, {"id": "p0"}, {"id": "p9"})
    assert [r.id for r in state.pruned(before, new, runs(spark, ("e.test", True, None, {"may_be_incomplete": True}))).collect()] == ["p0"]


def test_active_domains(spark):
    before = snapshot(spark, {"domain": "E.test"}, {"domain": "old.test"}, {"domain": None}, {"domain": ""})
    assert state.active_domains(before, spark.createDataFrame([("e.TEST",)], "domain string")).count() == 3


def test_dashboard(spark):
    s = snapshot(spark, {"price": None, "cycle_prices": {"Yearly": "$1,200", "Monthly": "free"}, "specs": {"cycles": "x", "CPU": "2"}, "location": "A"}, {"available": True, "name": "b", "price": "20"}, {"available": True, "name": "a", "is_special": True, "price": "5"}, {"available": False})
    rows = report.dashboard_rows(s)
    assert rows.where("price_value = 1200").first().asDict()["specs"] == {"CPU": "2"} and rows.where("price_value = 1200").first().price == "$1,200" and rows.where("location = 'A'").first().locations == ["A"]
    assert [r.name for r in rows.orderBy(*report.default_order()).collect()] == ["a", "b", "Plan 3", "Plan 0"]
    assert report.filtered(rows, stock="in", special="exclude").count() == 1 and report.filtered(rows, least=6, most=30).count() == 2 and report.filtered(rows, needle="CPU:2").count() == 1 and report.filtered(rows, stock="unknown", site="e.test").count() == 1
    assert [r.price_value for r in rows.orderBy(report.column_order("price_value", False)).collect()][0] == 1200
    ordered = rows.orderBy(*report.default_order()).collect()
    assert report.page(rows, report.default_order(), 99, 3).collect() == ordered[3:] and report.page(rows, report.default_order(), 0, 3).collect() == ordered[:3]
    assert rows.agg(*report.stock_counters()).first().asDict() == {"total": 4, "in_stock": 2, "out_of_stock": 1, "unknown": 1, "special": 1}
    assert report.run_log(rows).first().line == "[scrape:e.test] products=4 in=2 out=1 unknown=1 special=1"


def test_diff_report(spark):
    make = lambda *names: spark.createDataFrame([(n, "u") for n in names], "name string, url string")
    got = {(r.side, r["item"]) for r in report.diff_report(make("A", "b"), make("a"), make("B", "c")).collect()}
    assert got == {("baseline_minus_simple", "b::u"), ("baseline_minus_monitor", "a::u"), ("monitor_minus_baseline", "c::u")}


def test_messages(spark):
    p = products(spark, {"name": "Pro", "variant_of": "LA <VDS>", "available": True, "is_special": True, "locations": ["A", "B"], "cycle_prices": {"Yearly": "2", "Monthly": "1"}, "specs": {"z": "9", "CPU": "2", "cycles": "x"}, "description": "d"}, {"description": "&" * 5000}, {"description": "x", "specs": {f"k{i}": "v" * 400 for i in range(15)}}, {"name": "n" * 9000})
    m = [r.message for r in alerts.messages(p.withColumn("kind", F.lit("restock")), "now").orderBy("seq").collect()]
    assert all(len(x) <= 4096 for x in m)
    assert m[0].split("\n")[:2] == ["🔄 <b>RESTOCK ALERT</b>  ·  <b>#e</b>", "<b>⭐ LA &lt;VDS&gt; - Pro</b>"] and "📍 A +1 more" in m[0] and "<pre>Monthly: 1\nYearly: 2</pre>" in m[0] and "<pre>CPU: 2\nz: 9</pre>" in m[0]
    assert "&amp;...</blockquote>" in m[1] and len(m[1]) > 4000 and "<b>Specs" not in m[2] and "..." in m[3]


def test_streaks(spark):
    probes = spark.createDataFrame([("a", i, miss) for i, miss in enumerate([True, False, True, True, True, False])] + [("b", 0, True)], "k string, i int, miss boolean")
    got = crawl.streak_cut(probes, 2, ["k"], ["i"]).collect()
    assert sorted((r.k, r.i, r.streak) for r in got) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 0, 1)]


def test_crawl(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    page = lambda u, *to: (u, 200, True, "".join(f'<a href="{t}">x</a>' for t in to), None, 1, 0)
    pages = spark.createDataFrame([page("http://e/1", "/2", "http://other/9", "#x", "3?a=1&amp;b=2"), page("http://e/2", "/4", "/1"), page("http://e/4", "/5")], schemas.PAGE)
    start = spark.createDataFrame([("http://e/1",)], "url string")
    got = {r.url: r.depth for r in crawl.reachable(pages, start, 2).collect()}
    assert got == {"http://e/1": 0, "http://e/2": 1, "http://e/3?a=1&b=2": 1, "http://e/4": 2}
    top = crawl.top_candidates(spark.createDataFrame([("http://e/blog", 0), ("http://e/index.php?rp=/store/vps", 1), ("http://e/x", 2)], "url string, seq long"), 1).collect()
    assert [r.url for r in top] == ["http://e/index.php?rp=/store/vps"]
    scores = {"http://e/products/cart/x": 3, "http://e/cart.php?gid=1": 2, "http://e/x/cart.php": 1, "http://e/pages/pricing": 1, "http://e/index.php?/cart/a": 2, "http://e/store/a": 2, "http://e/blog": 0, "http://php.e/a.php": 1}
    rows = spark.createDataFrame([(u,) for u in scores], "url string").select("url", crawl.candidate_score(F.col("url"), ["php.e"]).alias("score")).collect()
    assert {r.url: r.score for r in rows} == scores


def test_challenge_pages(spark):
    cases = [
        (200, "Just a moment...", {}, False), (200, "JUST A MOMENT... Cloudflare", {}, True), (200, "just a moment, checking your browser", {}, True), (200, "Attention Required! | Cloudflare", {}, True), (521, None, None, True), (429, "", None, False),
        (200, '<script src="/cdn-cgi/beacon.js">', {}, False), (200, '<script src="/cdn-cgi/x?__cf_chl_tk=1">', {}, True), (403, "no", {"CF-Cache-Status": "DYNAMIC"}, True), (403, "no", {"cf-ray": ""}, False), (503, "no", {"Server": "CloudFlare"}, True), (200, "no", {"cf-ray": "1"}, False), (403, "no", {"x": "cloudflare", "cf-mitigated": "challenge"}, False), (None, None, None, False),
    ]
    rows = spark.createDataFrame(cases, "s int, b string, h map<string,string>, want boolean")
    assert all(r.want is r.got for r in rows.withColumn("got", filters.challenge_page(F.col("s"), F.col("b"), F.col("h"))).collect())


def test_detail_pages_and_enrichment(spark):
    p = products(spark, {"url": "https://e.test/a", "available": True, "location": "x"}, {"url": "https://e.test/b", "available": True}, {"url": "https://e.test/c"}, {"url": "https://e.test/b", "available": None}, {"url": "/rel"})
    assert [(r.url, r.priority) for r in crawl.detail_pages(p, 10).collect()] == [("https://e.test/b", 0), ("https://e.test/c", 0)]
    assert [r.url for r in crawl.detail_pages(p, 1, cycles=True).collect()] == ["https://e.test/b"]
    details = spark.createDataFrame([("https://e.test/b", False, ["Monthly"], {"Monthly": "$1"}, [("LA", True), ("New York", None)])], "url string, available boolean, billing_cycles array<string>, cycle_prices map<string,string>, locations array<struct<name:string,available:boolean>>")
    got = {r.id: (r.available, r.location) for r in crawl.enrich(p, details).collect()}
    assert got["p1"] == (True, "LA") and got["p1::loc-new-york"] == (False, "New York") and got["p0"] == (True, "x") and len(got) == 7


def test_json_store(spark):
    plan = '{"id":5,"plan_name":"P 1","tag":"Traffic","cpu":2,"memory":2048,"disk":20,"stock":0,"price_datas":[{"price":999,"cycle":1},{"price":2700,"cycle":3}]}'
    a = f'{{"status_code":0,"data":[{{"id":1,"area_name":"HK","nodes":[{{"id":2,"node_name":"N","plans":[{plan}, {{"id":6}}]}}]}}]}}'
    b = f'<html><pre>{{"data":{{"areas":[{{"area_name":"HK","nodes":[{{"group_name":"G","plans":[{plan}]}}]}}]}}}}</pre></html>'
    pages = spark.createDataFrame([("https://s.test/api", a), ("https://t.test/api", b), ("https://u.test/api", "<html>no</html>"), ("https://v.test/", None)], "url string, text string")
    got = {r.domain: r for r in store_json.store_products(pages).collect()}
    two = spark.createDataFrame([("https://s.test/api", a, 1), ("https://s.test/api2", a, 0)], "url string, text string, seq bigint")
    places = sorted(r.seq for r in store_json.store_products(two).collect())
    assert len(set(places)) == 2 and places[0] < store_json.PLANS <= places[1]
    s = got["s.test"]
    assert set(got) == {"s.test", "t.test"} and (s.price, s.available, s.location, s.variant_of, s.billing_cycles) == ("9.99 CNY", False, "HK", "N", ["Monthly", "Quarterly"])
    assert s.url == "https://s.test/shop/server?type=traffic&areaId=1&nodeId=2&planId=5" and s.id == "s.test::https://s.test/shop/server?areaId=1&nodeId=2&planId=5&type=traffic" and s.specs["RAM"] == "2GB" and s.cycle_prices["Quarterly"] == "27.00 CNY"


def test_state_documents(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text('{"schema_version": 1, "products": {"a": {"domain": "e.test", "url": "u", "location": "LA "}, "b": {"domain": "example.com"}, "c": {"domain": "e.test", "locations": [" X ", ""]}}, "domains": {"example.com": {}, "e.test": {"last_status": "ok"}}}')
    p, d = state_json.load_state(spark, str(path))
    got = {r.id: r for r in p.collect()}
    assert set(got) == {"a", "c"} and got["a"].locations == ["LA"] and got["a"].location_links == {"LA": "u"} and got["c"].location == "X" and [r.domain for r in d.collect()] == ["e.test"]
    assert state_json.load_state(spark, str(tmp_path / "none.json"))[0].count() == 0
    (tmp_path / "broken.json").write_text("{")
    assert state_json.load_state(spark, str(tmp_path / "broken.json"))[0].count() == 0
    state_json.save_state(p, d, str(tmp_path / "out"), "2024-01-01T00:00:00+00:00")
    assert spark.read.parquet(str(tmp_path / "out" / "2024-01-01T000000+0000" / "products")).count() == 2
    assert state_json.export_json(p, d, "t1", "t0").count() == 4


def test_targets(spark):
    t = spark.createDataFrame([("https://A.test/1", 0), ("https://b.test/", 1), ("https://a.test/2", 2), ("ftp://c.test", 3)], "url string, seq long")
    empty = spark.createDataFrame([], schemas.STATE_DOMAIN)
    known = spark.createDataFrame([("a.test", "ok", None, None, 1)], schemas.STATE_DOMAIN)
    assert [r.url for r in targets.lite_targets(t, known, snapshot(spark, {"domain": "zzz"})).collect()] == ["https://a.test/2"]
    assert targets.lite_targets(t, empty, spark.createDataFrame([], schemas.STATE_PRODUCT)).count() == 3


def page(spark, source):
    return spark.createDataFrame([(source,)], "h string").select("h", html.elements(F.col("h")).alias("e"))


def test_elements(spark):
    e = page(spark, "<div class='a b'><p>x <b>y</b></p><br><ul><li>1<li>2</ul><script>no</script></div>").first()["e"]
    assert [(x.pos, x.parent, x.last, x.tag, x.text) for x in e] == [(0, -1, 7, "div", "x y 1 2"), (1, 0, 2, "p", "x y"), (2, 1, 2, "b", "y"), (3, 0, 3, "br", ""), (4, 0, 6, "ul", "1 2"), (5, 4, 5, "li", "1"), (6, 4, 6, "li", "2"), (7, 0, 7, "script", "")]
    assert spark.createDataFrame([(None,)], "h string").select(html.elements(F.col("h"))).first()[0] == []


def test_markup_extractors(spark):
    form = """<div class="form-group"><label>Data Center</label><select name="configoption[1]"><option>Los Angeles - Out of Stock</option><option>New York</option><option>none</option></select></div>
    <select name="billingcycle"><option value="monthly">$3.00 USD Monthly</option><option value="annually">$30.00 USD Annually</option></select><button class="btn">Add to Cart</button>"""
    r = page(spark, form).select(html.location_variants(F.col("e")).alias("l"), html.cycles_in_page(F.col("e"), F.col("h")).alias("c"), html.cycle_prices_in_page(F.col("e")).alias("p")).first()
    assert [(x.name, x.available) for x in r.l] == [("Los Angeles", False), ("New York", None)]
    assert r.c == ["Monthly", "Yearly", "Semiannual"] or r.c[:2] == ["Monthly", "Yearly"]
    assert r.p == {"Monthly": "3.00 USD", "Yearly": "30.00 USD"}


@pytest.mark.parametrize("source, expected", [("<p class='out-of-stock'>x</p><button>Add to cart</button>", False), ("<form><select name='billingcycle'></select><button>Continue</button></form>", None), ("<form><select name='billingcycle'></select><button>Order now</button></form>", True), ("<i class='xsoldout'>last item</i><a>Order now</a>", True), ("<i class='xsoldout'> </i><a>Order now</a>", False), ("<button>In stock</button><p>sold out</p>", True), ("<button disabled>In stock</button><p>x</p>", True), ("<a>Buy now</a><a>Sold out</a><input name='configoption[1]'>", True), ("<a class='x disabled'>Buy now</a>", None), ("<button disabled>Order now</button>", None), ("<p>In stock</p>", True), ("<button>Sold out</button>", False)])
def test_detail_availability(spark, source, expected):
    assert page(spark, source).select(html.availability_in_page(F.col("e"), F.col("h"))).first()[0] is expected


def test_modals_and_forms(spark):
    source = "<table><tr><td>A</td><td><button data-bs-target='#m1'>o</button></td></tr></table><div id='m1'><a href='/buy?pid=1'>LA</a><a href='/buy?pid=2'>NY</a></div><form><input name='pid' value='7'><input name='action' value='add'></form><dl><dt>k</dt><dd>v</dd><dt>x</dt></dl>"
    p = page(spark, source)
    links = html.modal_links(p.select(F.lit("u").alias("url"), F.col("e").alias("els"))).collect()
    assert {(r.href, r.text) for r in links} == {("/buy?pid=1", "LA"), ("/buy?pid=2", "NY")}
    r = p.select(html.form_ids(F.col("e"), ["pid"]).alias("ids"), F.exists("e", lambda x: cards.add_form(cards.inner(F.col("e"), x), x)).alias("add"), html.definition_pairs(F.col("e")).alias("d"), html.page_links(F.col("e")).alias("links")).first()
    assert r.ids == [7] and r.add and [(x.key, x.value) for x in r.d] == [("k", "v")] and [x.href for x in r.links] == ["/buy?pid=1", "/buy?pid=2"]


def test_transitions(spark):
    o = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, i), i, a) for i, a in enumerate([False, True, None, True, False, None, True])], "key long, ts timestamp, seq long, available boolean")
    assert [r.is_restock for r in state.transitions(o, ["key"], ["ts", "seq"]).orderBy("seq").collect()] == [False, True, False, False, False, False, False]
