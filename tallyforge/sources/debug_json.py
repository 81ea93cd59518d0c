"""Debug artifacts: product lists as JSON that may be missing, broken or odd, and what is written beside a run to compare them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a debug product (in the order they are told).
DEBUG = (
    "id string, domain string, url string, name string, price string, currency string, available boolean, variant_of string, location string, locations array<string>, location_links map<string,string>, "
    "billing_cycles array<string>, cycle_prices map<string,string>, specs map<string,string>, description string, is_special boolean"
)
BROKEN = "_broken"


def debug_rows(products: DataFrame) -> DataFrame:
    """Product rows as debug artifacts hold them."""
    return products.select(*(f.split(" ", 1)[0] for f in DEBUG.split(", ")))


def parse_products(texts: DataFrame, *, text: str = "text") -> DataFrame:
    """DEBUG rows of each document of ``texts``, with its other columns, and the text of what isn't one as ``_broken``.

    A document is a list of products, or an object with a list called
    products. What isn't JSON, or is neither, gives one row with only
    ``_broken``; so does an entry of the list that isn't an object. A value of
    another type than its column's is null. A null document has no rows.
    """
    c = F.col
    others = [x for x in texts.columns if x != text]
    value = F.try_parse_json(c(text))
    listed = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$.products", "array<variant>"))
    rows = texts.where(c(text).isNotNull()).select(*others, c(text).alias("_all"), F.explode_outer(F.transform(F.coalesce(listed, F.array(F.lit(None).cast("variant"))), lambda v: F.struct(v.alias("v")))).alias("e"), listed.isNotNull().alias("_list"))
    rows = rows.where(c("e").isNotNull() | ~c("_list")).withColumn("one", c("e.v"))
    whole = c("_list") & F.coalesce(F.schema_of_variant(c("one")).startswith("OBJECT"), F.lit(False))
    fields = [f.split(" ", 1) for f in DEBUG.split(", ")]
    told = [F.when(whole, F.try_variant_get("one", f"$.{n}", t)).alias(n) for n, t in fields]
    broken = F.when(~whole, F.when(c("_list"), F.coalesce(F.to_json("one"), F.lit("null"))).otherwise(c("_all"))).alias(BROKEN)
    return rows.select(*others, *told, broken)


def read_products(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(products, broken) of the JSON files at ``path``; both are empty where nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    texts = spark.read.text(path, wholetext=True).select(F.col("value").alias("text")) if found else spark.createDataFrame([], "text string")
    rows = parse_products(texts)
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN), rows.where(F.col(BROKEN).isNotNull()).select(BROKEN)


def product_keys(products: DataFrame) -> DataFrame:
    """(key): name and address in lower case, trimmed, by which artifacts are compared."""
    low = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return products.select(F.concat(low("name"), F.lit("::"), low("url")).alias("key")).distinct()


def differences(baseline: DataFrame, **parsed: DataFrame) -> DataFrame:
    """(stage, side, key): what each parsed list lacks against the baseline (missing) and has beyond it (new)."""
    base = product_keys(baseline)
    out = None
    for stage, rows in parsed.items():
        own = product_keys(rows)
        for side, a, b in (("missing", base, own), ("new", own, base)):
            part = a.join(b, "key", "left_anti").select(F.lit(stage).alias("stage"), F.lit(side).alias("side"), "key")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to compare")
    return out


def write_lines(rows: DataFrame, path: str, order: list[Column | str]) -> None:
    """``rows`` as JSON lines in an order; null fields are told."""
    rows.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
