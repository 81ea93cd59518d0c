"""Product rows, observations and runs derived from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flag_available(flag: Column) -> Column:
    """Return flags as availability: R in stock, A out of stock, N unknown."""
    return F.when(flag == "R", True).when(flag == "A", False)


def listings(spark: SparkSession, sf_dir: str, by_plan: bool = False) -> DataFrame:
    """A product row per line item: the part is the plan, its brand the domain, the supplier's nation the location.

    ``by_plan`` deals the line items out by their part before they get its
    columns, so that a plan's listings are in one task and combine there.
    """
    line = table(spark, sf_dir, "lineitem")
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    placed = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", "n_name")
    sold = line.join(placed, line.l_suppkey == placed.s_suppkey)
    sold = sold.repartition("l_partkey") if by_plan else sold
    rows = sold.join(part, sold.l_partkey == part.p_partkey)
    domain = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    price = F.concat(F.format_string("%.2f", "l_extendedprice"), F.lit(" USD"))
    columns = {
        "id": F.concat_ws("::", domain, F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")),
        "domain": domain,
        "url": F.concat(F.lit("https://"), domain, F.lit("/cart.php?a=add&pid="), F.col("l_partkey").cast("string"), F.lit("&utm_source=feed")),
        "name": F.col("p_name"),
        "price": price,
        "currency": F.lit("USD"),
        "description": F.lit(None),
        "specs": F.create_map(F.lit("RAM"), F.concat(F.col("p_size").cast("string"), F.lit("GB"))),
        "available": flag_available(F.col("l_returnflag")),
        "variant_of": F.col("p_type"),
        "location": F.col("n_name"),
        "locations": F.lit(None),
        "location_links": F.lit(None),
        "billing_cycles": F.array(F.when(F.col("l_linenumber") % 2 == 0, "Monthly").otherwise("Yearly")),
        "cycle_prices": F.create_map(F.when(F.col("l_linenumber") % 2 == 0, "Monthly").otherwise("Yearly"), price),
        "is_special": F.lit(False),
        "seq": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
    }
    return _typed(rows.select(*(v.alias(k) for k, v in columns.items())))


def _typed(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.split(" ", 1)[0]).cast(f.split(" ", 1)[1]) for f in schemas.PRODUCT.split(", ")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of a product: a purchase shows stock, an error none, others leave it open."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("available"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: the customer is the domain, status F is a failure."""
    o = table(spark, sf_dir, "orders")
    reasons = F.array(*map(F.lit, ("deadline", "max_pages", "no_new_pages_streak", "queue_exhausted", "other")))
    meta = F.struct(
        (F.col("o_orderstatus") == "P").alias("may_be_incomplete"),
        (F.col("o_orderkey") % 7 == 0).alias("deadline_exceeded"),
        F.get(reasons, (F.col("o_orderkey") % 6).cast("int")).alias("discovery_stop_reason"),
        (F.col("o_orderkey") % 3).cast("int").alias("discovery_fetch_errors"),
    )
    return o.select(F.col("o_custkey").cast("string").alias("domain"), (F.col("o_orderstatus") != "F").alias("ok"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("timeout "), F.col("o_orderpriority"))).alias("error"), F.floor("o_totalprice").cast("bigint").alias("duration_ms"), meta.alias("meta"), F.col("o_orderkey").alias("seq"))
