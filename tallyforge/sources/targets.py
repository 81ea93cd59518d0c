"""Targets of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url


def with_domain(targets: DataFrame) -> DataFrame:
    """Targets (url, seq) that are http URLs, with their domain."""
    return targets.where(url.is_http(F.col("url"))).withColumn("domain", url.domain(F.col("url")))


def lite_targets(targets: DataFrame, domains: DataFrame, products: DataFrame) -> DataFrame:
    """The last target of each domain that the state knows, in the order of their first appearance; all if it knows none."""
    known = domains.select(F.lower("domain").alias("domain")).union(products.select(F.lower("domain"))).where("domain <> ''").distinct()
    per = with_domain(targets).groupBy("domain").agg(F.max_by("url", "seq").alias("url"), F.min("seq").alias("seq"))
    chosen = per.join(known, "domain", "left_semi").select("url", "seq", "domain")
    return with_domain(targets).select("url", "seq", "domain") if chosen.isEmpty() else chosen.orderBy("seq")


def first_success(fetches: DataFrame, key: str = "target", attempt: str = "attempt") -> DataFrame:
    """The first attempt of each target that succeeded."""
    return fetches.where("ok").groupBy(key).agg(F.min_by(F.struct(*(x for x in fetches.columns if x != key)), attempt).alias("r")).select(key, "r.*")
