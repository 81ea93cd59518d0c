"""The state as one JSON document, for exchange; between runs it is Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

VERSION = 1
#: The domain that is dropped whenever a state is loaded (a fixed value).
DROPPED = "example.com"


def _document() -> str:
    record = ", ".join(f.replace(" ", ": ", 1) for f in schemas.STATE_PRODUCT.split(", ") if not f.startswith("id "))
    record = record.replace("map<string: string>", "map<string,string>")
    domain = ", ".join(f.replace(" ", ": ", 1) for f in schemas.STATE_DOMAIN.split(", ") if not f.startswith("domain "))
    return f"schema_version int, updated_at string, products map<string, struct<{record}, option: string>>, domains map<string, struct<{domain}>>"


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(products, domains); empty for a missing or broken file.

    Locations of older documents become lists with links: a single location or
    option is a list of one, linked to the product's page. Documents of another
    version keep products and domains as they are.
    """
    try:
        doc = spark.read.schema(_document()).json(path, multiLine=True, mode="PERMISSIVE")
        doc.take(1)
    except Exception as e:  # a missing file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        doc = spark.createDataFrame([], _document())
    c = F.col
    now = c("schema_version") == VERSION
    p = doc.select(now.alias("now"), F.explode("products").alias("id", "r")).select("now", "id", "r.*")
    loc = F.coalesce(F.nullif("location", F.lit("")), "option")
    listed = F.filter(F.transform("locations", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    fixed = F.when(c("locations").isNull(), F.when(F.coalesce(F.trim(loc), F.lit("")) != "", F.array(F.trim(loc)))).otherwise(F.when(F.size(listed) > 0, listed))
    p = p.withColumn("_l", F.when(c("now"), fixed).otherwise(c("locations")))
    p = p.withColumns(
        {
            "location": F.when(c("now") & (F.coalesce("location", F.lit("")) == "") & c("locations").isNotNull(), F.get("_l", F.lit(0))).otherwise(c("location")),
            "location_links": F.when(c("now") & c("location_links").isNull() & c("_l").isNotNull() & c("url").isNotNull(), F.create_map(F.get("_l", F.lit(0)), c("url"))).otherwise(c("location_links")),
            "locations": c("_l"),
        }
    )
    p = p.where(~(c("now") & c("domain").eqNullSafe(F.lit(DROPPED)))).select(*(f.name for f in T._parse_datatype_string(schemas.STATE_PRODUCT).fields))
    d = doc.select(now.alias("now"), F.explode("domains").alias("domain", "r")).where(~(c("now") & (c("domain") == DROPPED))).select("domain", "r.*")
    return p, d


def save_state(products: DataFrame, domains: DataFrame, path: str, now: str) -> None:
    """Tables ``products`` (by domain) and ``domains`` under ``path/<now>``; ``path/<now>`` appears whole, and no path that is being read is overwritten."""
    at = f"{path.rstrip('/')}/{now.replace(':', '')}"
    products.repartition("domain").write.partitionBy("domain").parquet(f"{at}/products")
    domains.write.parquet(f"{at}/domains")


def export_json(products: DataFrame, domains: DataFrame, now: str, started_at: str) -> DataFrame:
    """Lines of an exchange format: one header, then a line per domain and per product, keys sorted within each."""
    head = products.sparkSession.range(1).select(F.to_json(F.struct(F.struct(F.lit(now).alias("finished_at"), F.lit(started_at).alias("started_at")).alias("last_run"), F.lit(VERSION).alias("schema_version"), F.lit(now).alias("updated_at"))).alias("value"))
    line = lambda df, key: df.select(F.to_json(F.struct(F.col(key), F.struct(*sorted(x for x in df.columns if x != key)).alias("record"))).alias("value"))
    return head.unionByName(line(domains, "domain")).unionByName(line(products, "id"))
