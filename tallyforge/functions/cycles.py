"""Billing cycles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import begins, compact_ws, let

_FLAGS, _WORDS = fixed.CYCLE_TOKENS.split("(", 2)[1:]
TOKENS = f"({_FLAGS}{begins(_WORDS[:-1].split('|'))}({_WORDS}"


def normalize_cycle(c: Column) -> Column:
    """The cycle's label: by the whole text, else by the first known key in it, else by its characters; or null."""
    exact = F.create_map(*(F.lit(x) for kv in fixed.CYCLE_LABELS.items() for x in kv))

    def labelled(v: Column) -> Column:
        out = F.when(v == "", F.lit(None).cast("string")).when(F.map_contains_key(exact, v), F.try_element_at(exact, v))
        for key, label in [*fixed.CYCLE_LABELS.items(), *fixed.CYCLE_CHARACTERS]:
            out = out.when(F.contains(v, F.lit(key)), label)
        return out

    return let(F.lower(compact_ws(c)), labelled)


def cycles_in_text(c: Column) -> Column:
    """Distinct labels of the cycle words in a text, then of ``cycle-x`` classes and ``billingcycle=x`` links; null if none."""
    tokens = lambda t: F.concat(F.regexp_extract_all(t, F.lit(TOKENS), 0), F.regexp_extract_all(t, F.lit(r"(?i)\bcycle-([a-z]+)\b"), 1), F.regexp_extract_all(t, F.lit(r"(?i)billingcycle=([a-z]+)"), 1))
    labels = F.array_distinct(F.array_compact(F.transform(let(compact_ws(c), tokens), normalize_cycle)))
    return let(labels, lambda found: F.when(F.size(found) > 0, found))


def fill_defaults(price: Column, cycles: Column, cycle_prices: Column) -> Column:
    """struct(billing_cycles, cycle_prices): what a price and either of both say about the other."""
    none, empty = F.size(F.coalesce(cycles, F.array().cast("array<string>"))) == 0, F.size(F.coalesce(cycle_prices, F.create_map().cast("map<string,string>"))) == 0
    priced = F.coalesce(price, F.lit("")) != ""
    filled = F.when(none & ~empty, F.map_keys(cycle_prices)).when(none & priced, F.array(F.lit("Monthly"))).when(~none, cycles)
    first = F.when(F.array_contains(filled, "Monthly"), "Monthly").otherwise(F.get(filled, F.lit(0)))
    prices = F.when(~empty, cycle_prices).when(priced & filled.isNotNull(), F.create_map(first, price))
    return F.struct(filled.alias("billing_cycles"), prices.alias("cycle_prices"))


def ordered_cycles(cycle_prices: Column) -> Column:
    """``cycle: price`` lines in the order of messages; unknown cycles last, by name."""
    place = lambda e: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, fixed.MESSAGE_CYCLES)), e.key), F.lit(0)), F.lit(999).cast("long"))
    items = F.array_sort(F.transform(F.map_entries(cycle_prices), lambda e: F.struct(place(e).alias("p"), e.key.alias("k"), e.value.alias("v"))))
    return F.transform(items, lambda i: F.concat(i.k, F.lit(": "), i.v))
