"""Products of storefronts that answer with JSON: areas, nodes and plans, unnested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import money, url
from ..functions.text import compact_ws

SHAPES = f"struct<data:array<{schemas.STORE_JSON}>>", f"struct<data:struct<areas:array<{schemas.STORE_JSON}>>>"

#: More than the plans that a text of 2 GB can hold, at 17 bytes or more each.
PLANS = 1 << 27


def json_text(c: Column) -> Column:
    """The JSON of an answer: inside a ``pre`` element if there is one, from the first brace or bracket on."""
    inner = F.regexp_extract(c, r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    raw = F.when(F.lower(c).contains("<pre"), F.coalesce(F.nullif(inner, F.lit("")), c)).otherwise(c)
    for entity, char in (("&quot;", '"'), ("&#34;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.when(F.lower(c).contains("<pre"), F.replace(raw, F.lit(entity), F.lit(char))).otherwise(raw)
    return F.trim(F.regexp_extract(raw, r"(?s)[{\[].*$", 0))


def lenient_json(c: Column) -> Column:
    """The answer as VARIANT, null where it is no JSON."""
    return F.try_parse_json(F.nullif(json_text(c), F.lit("")))


def store_products(pages: DataFrame, *, currency: str = "CNY", shop_path: str = "/shop/server", text: str = "text") -> DataFrame:
    """A product row per plan of each page (url, text) of either shape; plans without a name are left out.

    The domain is that of the page's URL. ``seq`` follows page (its own ``seq``,
    null or missing is 0), area, node, plan: a page's text holds fewer than
    PLANS plans, so no two places are the same.
    """
    c = F.col
    body = json_text(c(text))
    options = {"mode": "PERMISSIVE"}
    areas = F.coalesce(F.from_json(body, SHAPES[0], options)["data"], F.from_json(body, SHAPES[1], options)["data"]["areas"])
    plans = lambda a, n: F.transform(n["plans"], lambda p: F.struct(F.struct(a["id"].alias("id"), a["area_name"].alias("area_name")).alias("area"), F.struct(n["id"].alias("id"), n["node_name"].alias("node_name"), n["group_name"].alias("group_name")).alias("node"), p.alias("plan")))
    every = F.flatten(F.array_compact(F.transform(areas, lambda a: F.flatten(F.array_compact(F.transform(a["nodes"], lambda n: plans(a, n)))))))
    place = F.coalesce(c("seq"), F.lit(0)) if "seq" in pages.columns else F.lit(0)
    rows = pages.select(url.domain(c("url")).alias("domain"), place.cast("bigint").alias("page"), F.posexplode(every).alias("n", "of")).select("domain", "page", "n", "of.*")
    some = lambda x: F.nullif(compact_ws(x), F.lit(""))
    rows = rows.select("*", some(c("plan.plan_name")).alias("name"), some(c("area.area_name")).alias("area_name"), some(F.coalesce(F.nullif("node.node_name", F.lit("")), c("node.group_name"))).alias("node_name")).where("name is not null")
    tag = F.lower(compact_ws(c("plan.tag")))
    query = F.concat_ws(
        "&", F.when(tag.isin("traffic", "bandwidth"), F.concat(F.lit("type="), tag)),
        F.concat(F.lit("areaId="), c("area.id").cast("string")), F.concat(F.lit("nodeId="), c("node.id").cast("string")), F.concat(F.lit("planId="), c("plan.id").cast("string")),
    )
    link = F.concat(F.lit("https://"), c("domain"), F.lit(shop_path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    number = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    plan = lambda x: c(f"plan.{x}")
    specs = {
        "Location": c("area_name"), "Node": c("node_name"), "CPU": number(plan("cpu"), " vCPU"), "RAM": money.megabytes_text(plan("memory")), "Disk": number(plan("disk"), "GB"),
        "Transfer": number(plan("flow"), "GB"), "Port": number(plan("bandwidth"), "Mbps"), "IPv4": number(plan("ipv4_num"), ""), "IPv6": number(plan("ipv6_num"), ""),
    }
    table = F.map_filter(F.create_map(*(x for k, v in specs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    prices = F.coalesce(plan("price_datas"), F.array().cast("array<struct<price:double,cycle:bigint>>"))
    labels = F.array_distinct(F.array_compact(F.transform(prices, lambda p: money.months_label(p["cycle"]))))
    priced = F.filter(F.transform(prices, lambda p: F.struct(money.months_label(p["cycle"]).alias("key"), money.cents_text(p["price"], currency).alias("value"))), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    last = F.filter(priced, lambda e, i: ~F.exists(F.slice(priced, i + 2, F.size(priced)), lambda x: x["key"] == e["key"]))
    price = money.cents_text(money.best_monthly(prices), currency)
    told = lambda x: F.when(x.isNotNull() & ~F.contains(F.lower("name"), F.lower(x)), x)
    place = F.coalesce("area_name", "node_name")
    return rows.withColumn("url", link).select(
        F.concat("domain", F.lit("::"), url.normalize_for_id(c("url"))).alias("id"), "domain", "url", "name", price.alias("price"), F.when(price.isNotNull(), currency).alias("currency"),
        F.nullif(F.concat_ws(" / ", "area_name", "node_name"), F.lit("")).alias("description"), F.when(F.size(table) > 0, table).alias("specs"), (plan("stock") > 0).alias("available"),
        F.coalesce(told(c("node_name")), told(c("area_name"))).alias("variant_of"), place.alias("location"), F.lit(None).cast("array<string>").alias("locations"), F.lit(None).cast("map<string,string>").alias("location_links"),
        F.when(F.size(labels) > 0, labels).alias("billing_cycles"), F.when(F.size(last) > 0, F.map_from_entries(last)).alias("cycle_prices"), F.lit(False).alias("is_special"),
        (c("page") * PLANS + c("n")).alias("seq"),
    )
