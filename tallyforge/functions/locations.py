"""Locations of a plan and the links to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_ws

NONE = "array<string>"


def distinct_locations(values: Column) -> Column:
    """Compact, not empty, the first of each spelling without case; in order."""
    v = F.filter(F.transform(F.coalesce(values, F.array().cast(NONE)), compact_ws), lambda x: x != "")
    low = F.transform(v, F.lower)
    return F.filter(v, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def product_locations(locations: Column, location: Column) -> Column:
    """The list, then the single location if it is another one."""
    return distinct_locations(F.concat(F.coalesce(locations, F.array().cast(NONE)), F.when(F.coalesce(location, F.lit("")) != "", F.array(location)).otherwise(F.array().cast(NONE))))


def location_links(links: Column, locations: Column, location: Column, url: Column) -> Column:
    """A link per location: its own, else the product's page."""
    own = F.filter(F.transform(F.map_entries(F.coalesce(links, F.create_map().cast("map<string,string>"))), lambda e: F.struct(compact_ws(e.key).alias("key"), e.value.alias("value"))), lambda e: (e.key != "") & e.value.isNotNull())
    keys = F.transform(own, lambda e: e.key)
    last = F.filter(own, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e.key))
    rest = F.filter(product_locations(locations, location), lambda x: ~F.array_contains(keys, x))
    return F.map_from_entries(F.concat(last, F.transform(rest, lambda x: F.struct(x.alias("key"), url.alias("value")))))
