"""Availability is a three-valued boolean: in stock, out of stock, unknown (null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import compact_ws, has_any, let


def extract_availability(c: Column) -> Column:
    """From text: counts first, if they agree; then words.

    Words of both kinds, or only purchase labels, leave it unknown.
    """
    some = lambda n: n.rlike("^0*[1-9]")
    unknown = F.lit(None).cast("boolean")

    def judged(t: Column) -> Column:
        counts = F.concat(*(F.regexp_extract_all(t, F.lit(p), 1) for p in (fixed.WORD_THEN_COUNT, fixed.COUNT_THEN_WORD)))
        agreed = let(F.array_distinct(F.transform(counts, some)), lambda said: F.when(F.size(said) == 1, F.get(said, F.lit(0))))
        strong = has_any(t, fixed.IN_WORDS_STRONG)
        words = F.when(has_any(t, fixed.OUT_WORDS), F.when(strong, unknown).otherwise(False)).when(strong, True).otherwise(unknown)
        return F.coalesce(agreed, words)

    return let(F.lower(compact_ws(c)), judged)


def purchase_action(c: Column) -> Column:
    return has_any(F.lower(compact_ws(c)), fixed.IN_WORDS_WEAK)


def availability_rank(available: Column) -> Column:
    """0 in stock, 1 out of stock, 2 unknown."""
    return F.when(available, 0).when(~available, 1).otherwise(2)


def any_in(available: Column) -> Column:
    """Aggregate of a plan's rows: true if any is, false if all are, else unknown."""
    return F.when(F.bool_or(available), True).when(F.count_if(~available) == F.count("*"), False)


def any_out(available: Column) -> Column:
    """Aggregate of one product's sightings: false if any is, else true if any is, else unknown."""
    return F.when(F.bool_or(~available), False).when(F.bool_or(available), True)


def status_label(available: Column) -> Column:
    return F.when(available, "In Stock").when(~available, "Out of Stock").otherwise("Unknown")
