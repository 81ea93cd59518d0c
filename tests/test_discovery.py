"""Hidden ids, link discovery, crawls, parsers, enrichment and delivery against brute force and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import discover, enrich, hidden, merge
from tallyforge.plans import discovery, engine
from tallyforge.sources import cards, delivery, listing
from tallyforge.sources.registry import Binding, Registry
from tallyforge.tables import settled

JUDGED = f"domain string, kind string, id bigint, evidence boolean, products array<{hidden.FOUND}>, extra array<bigint>, signature string, redirect string"
LIMITS = hidden.Limits(no_info=4, no_info_seeded=6, same_page=3, product_no_progress=8, group_no_progress=6, product_duplicates=3, group_duplicates=3, redirects=3, least=1, most_product=30, most_group=20, most_candidates=4, backtrack=2)


def brute_scan(answers, seeds, groups, existing, limits):
    """One id after another."""
    known, linked, log, ends = set(existing), set(), [], {}
    key = lambda k: f"p{k}"
    none = (False, [], [], None, None)

    def probe(kind, i, phase):
        evidence, products, extra, signature, redirect = answers.get((kind, i), none)
        duplicate = evidence and (all(p in known for p in products) if products else bool(extra) and all(key(x) in known for x in extra))
        fresh = len(set(products) - known) if evidence and not duplicate else 0
        new = len(set(extra) - linked)
        if evidence and not duplicate:
            known.update(products)
        linked.update(extra)
        log.append((phase, kind, i, evidence, duplicate, fresh, new))
        return evidence, duplicate, fresh, new, signature, redirect

    def every(kind, start, without, phase):
        product = kind == "product"
        info = page = progress = dup = away = 0
        last = moved = None
        i, most = start, limits.most_product if product else limits.most_group
        least_info = 0 if not product else limits.no_info if not seeds else max(limits.no_info, limits.no_info_seeded)
        while i <= most:
            if i in without:
                i += 1
                continue
            if i > limits.least:
                rules = [("no_info", info, least_info), ("same_page", page, 0 if product else limits.same_page), ("no_progress", progress, limits.product_no_progress if product else limits.group_no_progress)]
                rules += [("duplicates", dup, limits.product_duplicates if product else limits.group_duplicates), ("redirects", away, limits.redirects)]
                why = next((name for name, n, stop in rules if stop and n >= stop), None)
                if why:
                    ends[kind] = why
                    return
            evidence, duplicate, fresh, new, signature, redirect = probe(kind, i, phase)
            info = 0 if evidence else info + 1
            if signature is not None:
                page = page + 1 if signature == last else 1
                last = signature
            progress = 0 if fresh or (new and not product) else progress + 1
            dup = dup + 1 if evidence and duplicate else 0
            away = 0 if redirect is None else away + 1 if redirect == moved and away else 1
            moved = redirect
            i += 1
        ends[kind] = "exhausted"

    for g in sorted(set(groups)):
        probe("group", g, 1)
    every("group", 0, set(), 2)
    first = sorted(linked)[: limits.most_candidates]
    for i in first:
        probe("product", i, 3)
    for i in sorted(set(seeds) - set(first)):
        probe("product", i, 4)
    every("product", max(0, min(seeds) - limits.backtrack) if seeds else 0, set(first) | set(seeds), 5)
    return log, ends


@pytest.mark.parametrize("batch", [7, 100])
def test_hidden_scan_is_that_of_one_id_after_another(spark, batch):
    r = random.Random(5)
    rows, scans, existing, want = [], [], [], {}
    for d in range(12):
        name, answers = f"d{d}.test", {}
        lively = r.choice([0.2, 0.6, 0.95])
        for kind, most in (("group", 20), ("product", 30)):
            for i in range(most + 3):
                if r.random() < 0.1:
                    continue
                evidence = r.random() < lively
                products = [f"p{r.choice([i, i, r.randint(0, 30)])}" for _ in range(r.choice([0, 1, 1, 2]))] if evidence else []
                extra = [r.randint(0, 25) for _ in range(r.choice([0, 0, 2]))] if kind == "group" and evidence else []
                signature = r.choice(["a", "b", f"s{i}", None]) if kind == "group" else None
                redirect = None if evidence else r.choice(["x", "x", "y", None])
                answers[kind, i] = (evidence, products, extra, signature, redirect)
                rows.append((name, kind, i, evidence, [(p, p, p, None, None) for p in products], extra, signature, redirect))
        seeds, groups = r.choice([[], [12, 3], [25]]), r.choice([[], [4, 2, 4]])
        known = [f"p{k}" for k in range(r.choice([0, 6]))]
        scans.append((name, "whmcs", ["p{id}"], seeds or None, groups))
        existing += [(name, k) for k in known]
        want[name] = brute_scan(answers, seeds, groups, known, LIMITS)
    judged = settled(spark.createDataFrame(rows, JUDGED))
    table = spark.createDataFrame(scans, "domain string, platform string, templates array<string>, seed_products array<bigint>, seed_groups array<bigint>")
    # The addresses of linked ids are their keys here: templates hold no host.
    same = judged.withColumn("products", F.transform("products", lambda p: p.withField("id", F.concat("domain", F.lit("::"), p["id"]))))
    known = spark.createDataFrame(existing, "domain string, k string").select("domain", F.concat("domain", F.lit("::"), "k").alias("id"))
    asked = []

    def source(wanted):
        asked.append(wanted.count())
        return same.join(wanted.select("domain", "kind", "id"), ["domain", "kind", "id"], "left_semi")

    got = hidden.scan_hidden_ids(table, source, known, limits=LIMITS, batch=batch, settle=settled)
    log = {}
    for x in got.probes.collect():
        log.setdefault(x.domain, []).append((x.phase, x.kind, x.id, x.evidence, x.duplicate, x.added, x.candidates))
    ends = {(x.domain, x.kind): x.reason for x in got.stops.collect()}
    for name, (probes, reasons) in want.items():
        assert sorted(log[name]) == sorted(probes), name
        assert {k: ends[name, k] for k in ("group", "product")} == reasons
    assert len({v for v in ends.values()}) >= 4
    if batch == 7:
        assert sum(asked) < 0.8 * 12 * 50, "ids behind a stop aren't asked for"


def answer(url, text, *, kind="product", id_=11, platform="whmcs", nr=0, products=(), available=None, name=None, asked=None, ok=True):
    asked = asked or f"https://e.test/cart.php?a=add&pid={id_}"
    return ("e.test", platform, kind, id_, nr, asked, url, ok, text, [(f"e.test::{p}", p, "Plan", "1.00 USD", None) for p in products], available, name)


ORDER = "<select name='billingcycle'></select>"


@pytest.mark.parametrize(
    ("answers", "want"),
    [
        # An order page that keeps its id.
        ([answer("https://e.test/cart.php?a=add&pid=11", f"{ORDER}<a href='?pid=11'>x</a>", name="Plan")], (True, ["e.test::https://e.test/cart.php?a=add&pid=11"], None)),
        # A redirect without the id, to a page that still is an order page but doesn't mention it: one product is taken for the probed one.
        ([answer("https://e.test/cart.php?a=confproduct&i=0", ORDER, products=["https://e.test/x"])], (True, ["e.test::https://e.test/cart.php?a=add&pid=11"], None)),
        # A redirect to a page without anything.
        ([answer("https://e.test/cart.php?a=view", "<p>Your cart</p>")], (False, [], "https://e.test/cart.php")),
        # One that ended at another id.
        ([answer("https://e.test/cart.php?a=add&pid=12", ORDER, products=["https://e.test/cart.php?a=add&pid=12"])], (False, [], "https://e.test/cart.php")),
        # The second address answers.
        ([answer("u", None, ok=False), answer("https://e.test/billing/cart.php?a=add&pid=11", f"{ORDER} pid <input name='pid' value='11'>", nr=1)], (True, [], None)),
        # Only the matching ones of several products.
        ([answer("https://e.test/cart.php?pid=11", ORDER, products=["https://e.test/cart.php?a=add&pid=11", "https://e.test/cart.php?a=add&pid=9"])], (True, ["e.test::https://e.test/cart.php?a=add&pid=11"], None)),
        # A group whose page links to products, though the id is lost.
        ([answer("https://e.test/store", "<a href='/cart.php?a=add&amp;pid=7'>x</a>", kind="group", id_=3, asked="https://e.test/cart.php?gid=3")], (True, [], None)),
        # An id of any length isn't the probed one.
        ([answer("https://e.test/cart.php?a=add&pid=99999999999999999999999", ORDER)], (False, [], "https://e.test/cart.php")),
        ([answer("https://e.test/cart.php?a=add&pid=11", "")], None),
    ],
)
def test_judged_answers(spark, answers, want):
    got = hidden.judge(spark.createDataFrame(answers, hidden.ANSWER)).collect()
    assert [(r.evidence, [p.id for p in r.products], r.redirect) for r in got] == ([] if want is None else [want])


def test_links_of_odd_pages(spark):
    pages = [
        ("https://e.test/a", None), (None, "<a href='/store/x'>"), ("https://e.test/b", ""), ("https://e.test/store/x", "<a href='/store/x'>self</a><a href='/store/y#z'>y</a>"), ("https://e.test/login", "<p>hi</p>"),
        ("https://e.test/c", "<a href='/store/x'>1</a>"), ("https://e.test/c", "<a href='/store/y'>2</a><a href='/store/x'>again</a>"), ("https://p.test/", "<a href='vps-plans.php'>x</a><a href='/billing/vps.php'>y</a>"),
        ("https://h.test/", "<a href='/index.php?/cart/a/b/'>two levels</a><a href='/cart/a/b/c'>three</a> action=add&id=3"),
    ]
    got = discover.candidate_pages(spark.createDataFrame(pages, "url string, text string"), php_domains=["p.test"], most_of={"e.test": 2})
    found = {}
    for r in got.orderBy("url", "place").collect():
        found.setdefault(r.url, []).append(r.link)
    assert found == {
        "https://e.test/store/x": ["https://e.test/store/y#z"], "https://e.test/login": ["https://e.test/cart.php", "https://e.test/index.php?rp=/store"][::-1], "https://e.test/c": ["https://e.test/store/x", "https://e.test/store/y"],
        "https://p.test/": ["https://p.test/vps-plans.php"], "https://h.test/": ["https://h.test/index.php?/cart/a/b/"],
    }


def test_parsers_by_domain(spark):
    card = "<div class='package'><h3>VPS One</h3><p>$5.00 USD Monthly</p><a href='/cart.php?a=add&amp;pid=3'>Order Now</a></div>"
    store = '{"data":[{"id":1,"area_name":"A","nodes":[{"id":2,"node_name":"N","plans":[{"id":3,"plan_name":"P","stock":1,"price_datas":[{"price":100,"cycle":1}]}]}]}]}'
    table = "<table><tr class='table-row'><td>Box</td><td>1</td><td>2</td><td>$3.00</td><td><a href='/billing/store/x/box'>Order</a></td></tr></table>"
    pages = spark.createDataFrame([("https://c.test/", card, 0), ("https://c.test/", card, 0), ("https://unknown.test/", card, 1), ("https://J.test/", store, 2), ("https://t.test/vps.php", table, 3), ("https://t.test/about.php", card, 4), ("https://own.test/", "any", 5), (None, card, 6)], "url string, text string, seq bigint")

    def mine(pages, tag="x"):
        return listing.typed(pages.select(F.concat(F.lit(f"{tag}::"), "url").alias("id"), F.lit("own.test").alias("domain"), "url", F.lit(tag).alias("name"), "seq"))

    reg = Registry().register("mine", mine).bind("json", "j.test").bind("plans", "T.test").bind("mine", "own.test", tag="y")
    got = {r.id: r.name for r in reg.products(pages).collect()}
    assert got == {
        "c.test::https://c.test/cart.php?a=add&pid=3": "VPS One", "unknown.test::https://unknown.test/cart.php?a=add&pid=3": "VPS One", "y::https://own.test/": "y",
        "t.test::https://t.test/billing/store/x/box": "Box", **{k: v for k, v in got.items() if k.startswith("j.test")},
    }
    assert sum(k.startswith("j.test") for k in got) == 1
    assert reg.of("nobody.test") == Binding("cards") and reg.of("OWN.test") == Binding("mine", (("tag", "y"),))
    with pytest.raises(ValueError):
        reg.register("mine", mine)
    with pytest.raises(ValueError):
        reg.bind("nothing", "x.test")
    pages.where("seq = 5").createOrReplaceTempView("own_pages")
    reg.view(spark, "own_pages", "own_products")
    assert [r.name for r in spark.sql("SELECT name FROM own_products WHERE domain = 'own.test'").collect()] == ["y"]


def test_repeated_pages_give_their_cards_once(spark):
    card = "<div class='package'><h3>VPS One</h3><p>$5.00 USD Monthly</p><a href='/cart.php?a=add&amp;pid=3'>Order Now</a></div>"
    pages = spark.createDataFrame([("https://c.test/", card, 1)] * 3 + [("https://c.test/", card, 2), ("https://d.test/", card, 1), ("https://c.test/x", None, 3), ("https://c.test/y", "", 4)], "url string, text string, seq bigint")
    assert sorted((r.domain, r.seq >> 27) for r in cards.card_products(pages).collect()) == [("c.test", 1), ("c.test", 2), ("d.test", 1)]
    assert cards.card_products(pages.limit(0)).count() == 0
    # No markup is joined or grouped: what is shuffled holds no elements.
    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    cards.card_products(pages, settle=watched)
    for p in plans:
        assert all("els#" not in line and "inside#" not in line for line in p.splitlines() if "Exchange" in line and "hashpartitioning" in line)


def test_messages_are_sent_once(spark, tmp_path):
    m = spark.createDataFrame([(f"p{i}", "new", "d", f"text {i}") for i in range(20)] + [("p1", "restock", "d", "back"), ("p1", "restock", "d", "back")], "id string, kind string, domain string, message string")
    path, log = f"file://{tmp_path}/box", f"{tmp_path}/sent"

    def send(key, message, broken=("text 3", "text 7")):
        if message in broken:
            raise OSError("down")
        with open(log, "a") as f:
            f.write(f"{key} {message}\n")
        return True

    assert delivery.deliver(spark, path, send).count() == 0
    delivery.queue_messages(m, path, "r1")
    delivery.queue_messages(m, path, "r1")
    first = delivery.deliver(spark, path, send).collect()
    assert len(first) == 21 and sum(r.ok for r in first) == 19 and {r.error for r in first if not r.ok} == {"OSError: down"}
    again = delivery.deliver(spark, path, lambda k, t: send(k, t, ())).collect()
    assert sorted(r.id for r in again) == ["p3", "p7"]
    delivery.queue_messages(m, path, "r2")
    assert delivery.deliver(spark, path, lambda k, t: False).count() == 21
    assert len(open(log).read().split("\n")) == 22, "each once, none of the second run"
    state = spark.createDataFrame([("p1", None, "r9", None), ("p3", "r0", None, None), ("x", "r5", None, None)], "id string, last_notified_new string, last_notified_restock string, last_notified_new_location string")
    told = {r.id: tuple(r)[1:] for r in delivery.with_receipts(state, delivery.receipts_of(spark, path)).collect()}
    assert told == {"p1": ("r1", "r9", None), "p3": ("r1", None, None), "x": ("r5", None, None)}


def rows_of(spark, *rows):
    base = {"domain": "e.test", "name": "Plan", "is_special": False}
    table = spark.createDataFrame([(r["id"], r.get("url", "https://e.test/store/a/" + r["id"]), r.get("name", "Plan"), r.get("price"), r.get("available"), r.get("location"), i) for i, r in enumerate(rows)], "id string, url string, name string, price string, available boolean, location string, seq bigint")
    return listing.typed(table.withColumn("domain", F.lit(base["domain"])).withColumn("is_special", F.lit(False)))


def test_enrichment_of_shared_and_known_rows(spark):
    p = rows_of(spark, {"id": "a"}, {"id": "b", "url": "https://e.test/cart"}, {"id": "c", "url": "https://e.test/cart"}, {"id": "d", "available": True, "location": "x"}, {"id": "a::loc-graz", "available": True, "location": "Graz"}, {"id": "e", "location": "GRAZ"}, {"id": "f", "url": "rel"})
    details = spark.createDataFrame([(u, False, ["Monthly"], {"Monthly": "9.00 USD"}, [("Lyon", None), ("Graz", True), ("Bern", None)]) for u in ("https://e.test/store/a/a", "https://e.test/cart", "https://e.test/store/a/d", "https://e.test/store/a/e")], enrich.DETAILS)
    wanted = enrich.wanted_pages(p, 10)
    assert [(r.url, r.rows) for r in wanted.orderBy("place").collect()] == [("https://e.test/store/a/a", 1), ("https://e.test/cart", 2), ("https://e.test/store/a/e", 1)]
    assert [r.url for r in enrich.wanted_pages(p, 1).collect()] == ["https://e.test/store/a/a"]
    got = {r.id: r for r in enrich.enriched(p, wanted, details).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "f", "a::loc-graz", "a::loc-bern"}
    assert (got["a"].location, got["a"].available, got["a"].price, got["a"].locations) == ("Lyon", False, "9.00 USD", ["Lyon"])
    assert (got["a::loc-bern"].location, got["a::loc-bern"].available, got["a::loc-bern"].variant_of, got["a::loc-bern"].price) == ("Bern", False, "Plan", None)
    assert got["a::loc-graz"].available is True and got["b"].available is False and got["b"].billing_cycles is None and got["b"].location is None
    assert got["d"].billing_cycles is None and (got["e"].location, got["e"].available) == ("Graz", True) and got["f"].available is None


def test_united_lists(spark):
    a, b = rows_of(spark, {"id": "x", "name": "N", "available": True}, {"id": "y", "available": False}), rows_of(spark, {"id": "x", "name": "", "price": "1 USD"}, {"id": "y", "available": True}, {"id": "z"})
    got = {r.id: (r.name, r.price, r.available) for r in merge.unite(a, b).collect()}
    assert got == {"x": ("N", "1 USD", True), "y": ("Plan", None, False), "z": ("Plan", None, None)}
    assert merge.unite(a).count() == 2 and merge.unite(a.limit(0), b.limit(0)).count() == 0


def test_a_run_with_all_sources(spark, tmp_path):
    card = "<div class='package'><h3>VPS One</h3><p>$5.00 USD Monthly</p><a href='/cart.php?a=add&amp;pid=3'>Order Now</a></div>"
    items = "".join(f"<div class='cart-products-item'><div class='cart-products-box{s}' pid='{k}'><b class='cart-products-title'>LAX.{k}.BIG</b><i class='cart-products-price'>$7.00</i></div></div>" for k, s in ((3, " none-stock"), (8, "")))
    pages = spark.createDataFrame([("https://c.test/", 200, True, card + items, None, 1, 0), ("https://k.test/", 200, True, card, None, 1, 1)], "url string, status_code int, ok boolean, text string, error string, elapsed_ms bigint, seq bigint")
    hidden_rows = spark.createDataFrame([("k.test", "k.test::https://k.test/cart.php?a=add&pid=44", "https://k.test/cart.php?a=add&pid=44", "Hidden One", "4.00 USD", None)], "domain string, id string, url string, name string, price string, available boolean")
    detail = lambda wanted: wanted.select("url", F.when(F.contains("url", F.lit("pid=44")), "<p>Sold out</p>").alias("text"))
    out = engine.run(spark, pages, f"{tmp_path}/state.json", "t1", sources=engine.Sources(Registry(), ["C.test"], hidden_rows, detail))
    got = {r.url.split("://")[1]: (r.name, r.available, r.price) for r in out.products.collect()}
    assert got == {"c.test/cart.php?a=add&pid=3": ("LAX.3.BIG", False, "5.00 USD"), "c.test/cart.php?a=add&pid=8": ("LAX.8.BIG", True, "7.00 USD"), "k.test/cart.php?a=add&pid=3": ("VPS One", True, "5.00 USD"), "k.test/cart.php?a=add&pid=44": ("Hidden One", False, "4.00 USD")}
    assert out.diagnostics.get["renamed"] == 1 and out.diagnostics.get["dropped_noise"] == 0


def test_crawl_of_targets_without_queue(spark):
    targets = spark.createDataFrame([("a.test", "https://a.test/", [], 5, 10, 0, 0, True), ("b.test", "https://b.test/", ["https://b.test/x", ""], 0, 10, 0, 0, True), ("c.test", "https://c.test/", ["https://c.test/x"], 5, 10, 0, 1, True)], "domain string, base_url string, queue array<string>, max_pages int, max_products int, stop_no_new int, stop_errors int, strict boolean")
    source = lambda wanted: wanted.where("false").select("domain", "url", F.lit(True).alias("ok"), F.col("url").alias("final_url"), F.array().cast("array<struct<id:string,available:boolean,name:string>>").alias("products"), F.array().cast("array<string>").alias("links"))
    known = spark.createDataFrame([], "domain string, id string, available boolean, name string")
    got = discover.budgeted_crawl(targets, source, known, settle=settled)
    assert {r.domain: (r.pages, r.errors, r.reason) for r in got.targets.collect()} == {"a.test": (0, 0, "queue_exhausted"), "b.test": (0, 0, "max_pages"), "c.test": (1, 1, "queue_exhausted")}
    assert got.products.count() == 0 and [r.url for r in got.visits.collect()] == ["https://c.test/x"]


def test_hidden_query_for_any_batch(spark):
    want = sorted(map(tuple, discovery.hidden_ids(spark, "/root/testdata/sf0.001", 5).collect()))
    assert want == sorted(map(tuple, discovery.hidden_ids(spark, "/root/testdata/sf0.001", 40).collect()))


def test_targets_of_crawls_and_scans(spark):
    targets = spark.createDataFrame([("w.test", "https://w.test/billing/", "whmcs", ["/cart.php?gid=4", "https://w.test/cart.php?a=add&pid=9", "/x"]), ("h.test", "https://h.test/", "hostbill", None), ("o.test", "https://o.test/store", None, ["/cart.php?pid=3"])], "domain string, base_url string, platform string, seeds array<string>")
    extra = spark.createDataFrame([("o.test", "https://o.test/cart", 0), ("o.test", "https://o.test/api", 1), ("o.test", "", 2)], "domain string, url string, seq int")
    led = spark.createDataFrame([("https://o.test/store", "https://o.test/store/a", 1), ("https://o.test/store", "https://o.test/api", 2), ("https://other.test/", "https://x.test", 1)], "url string, link string, place int")
    got = {r.domain: r for r in discover.crawl_targets(targets, extra, led).collect()}
    assert got["o.test"].queue[:4] == ["https://o.test/cart", "https://o.test/api", "https://o.test/store/a", "https://o.test/cart.php"] and "https://o.test/store" not in got["o.test"].queue and len(set(got["o.test"].queue)) == len(got["o.test"].queue)
    assert [(got[d].max_pages, got[d].stop_errors, got[d].strict) for d in ("w.test", "h.test", "o.test")] == [(128, 0, False), (96, 0, False), (40, 12, True)]
    rows = rows_of(spark, {"id": "a", "url": "https://w.test/cart.php?a=add&pid=30"}, {"id": "b", "url": "https://w.test/store/x"}).withColumn("domain", F.lit("w.test"))
    scans = {r.domain: r for r in hidden.scan_targets(targets, rows).collect()}
    assert set(scans) == {"w.test", "h.test"} and scans["w.test"].seed_products == [9, 30] and scans["w.test"].seed_groups == [4] and scans["h.test"].seed_products == []
    assert scans["w.test"].templates == ["https://w.test/cart.php?a=add&pid={id}", "https://w.test/billing/cart.php?a=add&pid={id}"] and all("{id}" in x for x in scans["h.test"].templates)
