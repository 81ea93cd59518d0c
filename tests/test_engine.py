"""A run end to end: captured answers, state, alerts, page, command line."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge import __main__ as cli
from tallyforge import schemas
from tallyforge.plans import engine
from tallyforge.sources import sinks

from .test_operators import products


def answer(domain, *stocks):
    plans = [{"id": i, "plan_name": f"Plan {i}", "stock": s, "price_datas": [{"price": 100, "cycle": 1}]} for i, s in enumerate(stocks)]
    return (f"https://{domain}/api", 200, True, json.dumps({"data": [{"area_name": "HK </script>", "nodes": [{"node_name": "N", "plans": plans}]}]}), None, 5, 0)


def test_runs_in_a_row(spark, tmp_path):
    targets = spark.createDataFrame([("https://a.test/", 0), ("https://b.test/", 1)], "url string, seq bigint")
    pages = spark.createDataFrame([answer("a.test", 0, 5), ("https://b.test/api", 500, False, None, "boom", 9, 1)], schemas.PAGE)
    first = engine.run(spark, pages, str(tmp_path / "none.json"), "t1", all_targets=targets)
    assert first.summary.first().asDict() == {"started_at": "t1", "finished_at": "t1", "restocks": 0, "new_products": 2, "domains_ok": 1, "domains_error": 1}
    assert first.messages.count() == 1
    state = {"schema_version": 1, "products": {r.id: {k: v for k, v in r.asDict(recursive=True).items() if k != "id"} for r in first.products.collect()}, "domains": {r.domain: {"last_status": r.last_status, "last_ok": r.last_ok} for r in first.domains.collect()}}
    path = tmp_path / "state.json"
    path.write_text(json.dumps(state))
    second = engine.run(spark, spark.createDataFrame([answer("a.test", 3)], schemas.PAGE), str(path), "t2", mode="full", all_targets=targets)
    assert [(r.available, r.last_change, r.last_notified_restock) for r in second.products.collect()] == [(True, "t2", "t2")]
    assert "RESTOCK" in second.messages.first().message
    lite = engine.run(spark, spark.createDataFrame([answer("a.test", 3)], schemas.PAGE), str(path), "t2", mode="lite", all_targets=targets)
    assert lite.products.count() == 1
    hand_picked = engine.run(spark, spark.createDataFrame([answer("a.test", 3)], schemas.PAGE).drop("seq"), str(path), "t2", mode="lite", all_targets=targets, prune=False)
    assert hand_picked.products.count() == 2
    page = sinks.dashboard_page(second.dashboard)
    assert "\\u003c/script\\u003e" in page and page.count("</script>") == 2
    with pytest.raises(ValueError):
        engine.run(spark, pages, str(path), "t", mode="odd")


def test_parsers_by_domain(spark):
    card = '<div><a href="/store/a/b">x</a><a href="/store/a/c">y</a></div><div class="package"><h3>Plan &amp; A</h3><p>$5.00 USD Monthly</p><a href="/cart.php?a=add&amp;pid=7">Order Now</a></div><div class="package"><h3>No link</h3><p>$9.00 USD</p></div>'
    pages = spark.createDataFrame([answer("a.test", 3), ("https://c.test/", 200, True, card, None, 5, 1), ("https://c.test/none", 200, True, None, None, 5, 2), ("https://c.test/empty", 200, True, "", None, 5, 3)], schemas.PAGE)
    got = engine.listed(pages, engine.Rules(card_domains=["c.test"]))
    assert got.columns == [f.split(" ", 1)[0] for f in schemas.PRODUCT.split(", ")]
    rows = {r.domain: r for r in got.collect()}
    assert set(rows) == {"a.test", "c.test"} and got.count() == 2
    c = rows["c.test"]
    assert (c.name, c.price, c.available, c.url, c.billing_cycles) == ("Plan & A", "5.00 USD", True, "https://c.test/cart.php?a=add&pid=7", ["Monthly"])


def test_site_rules(spark):
    p = products(
        spark, {"name": "Pro", "variant_of": "LA", "domain": "Tier.test"}, {"name": "x", "url": "https://drop.test/store/diy-1", "domain": "drop.test"}, {"location": "Special LA", "locations": ["Special LA", "NY"], "domain": "loc.test"},
        {"name": "tiny", "url": "https://c.test/LAX.AN5.Pro.TINY?pid=9", "domain": "c.test"}, {"name": "y", "available": None, "domain": "in.test", "url": "https://in.test/?action=add&id=3"}, {"name": "z", "domain": "c.test", "url": "https://c.test/?pid=7"},
    )
    rules = engine.Rules(drop=[("drop.test", "/store/.*diy-")], no_location=[("loc.test", "special")], tiers=["tier.test"], assume_in=["in.test"], codes=["c.test"])
    listing = spark.createDataFrame([("c.test", 7, "Listed", False)], "domain string, pid bigint, name string, available boolean")
    got = {r.id: r for r in engine.assumed_stock(engine.cleaned(p, rules, listing), rules).collect()}
    assert "p1" not in got and got["p0"].name == "LA - Pro" and (got["p2"].location, got["p2"].locations) == (None, ["NY"]) and got["p3"].name == "LAX.AN5.Pro.TINY" and got["p4"].available is True and (got["p5"].name, got["p5"].available) == ("Listed", False)
    assert engine.post_process(p, rules).where(F.col("id") == "p0").first().billing_cycles == ["Monthly"]


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([answer("a.test", 1)], schemas.PAGE).write.parquet(f"{tmp_path}/pages")
    assert cli.main(["--pages", f"{tmp_path}/pages", "--state", f"{tmp_path}/none.json", "--output", f"{tmp_path}/out"]) == 0
    assert "'new_products': 1" in capsys.readouterr().out and (tmp_path / "out" / "index.html").exists()
