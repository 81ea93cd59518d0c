"""Specifications: found in text, cleaned, ordered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .money import extract_price
from .text import SPACE, compact_ws, first_match, has_any, let

EMPTY = "map<string,string>"
PAIRS = "array<struct<key:string,value:string>>"


def value_key(c: Column) -> Column:
    """What two spellings of one amount have in common."""
    t = F.replace(F.lower(compact_ws(c)), F.lit(" "), F.lit(""))
    for word in fixed.SPEC_NOISE:
        t = F.replace(t, F.lit(word), F.lit(""))
    return F.btrim(t, F.lit(":：-"))


def _same(m: Column, a: str, b: str) -> Column:
    x, y = F.try_element_at(m, F.lit(a)), F.try_element_at(m, F.lit(b))
    return F.coalesce((x != "") & (y != "") & (value_key(x) == value_key(y)), F.lit(False))


def extract_specs(c: Column) -> Column:
    """The first match per specification; traffic that repeats the bandwidth goes; null if none."""

    def found(t: Column) -> Column:
        told = {k: F.coalesce(*(first_match(t, f"(?iuU){p}") for p in patterns)) for k, patterns in fixed.SPEC_PATTERNS.items()}
        return F.map_filter(F.create_map(*(x for k, v in told.items() for x in (F.lit(k), F.trim(F.regexp_replace(v, SPACE, " "))))), lambda k, v: v.isNotNull())

    once = lambda m: F.map_filter(m, lambda k, v: ~((k == "Traffic") & _same(m, "Bandwidth", "Traffic")))
    return let(let(let(compact_ws(c), found), once), lambda m: F.when(F.size(m) > 0, m))


def clean_specs(m: Column) -> Column:
    """Compact keys and values, no empty key and no ``cycles``; amounts said twice go; null if nothing is left."""
    entries = F.transform(F.map_entries(F.coalesce(m, F.create_map().cast(EMPTY))), lambda e: F.struct(compact_ws(e.key).alias("key"), compact_ws(e.value).alias("value")))
    entries = F.filter(entries, lambda e: (e.key != "") & (F.lower(e.key) != "cycles"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later.key == e.key))
    out = F.map_from_entries(last)
    double = _same(out, "Bandwidth", "BandwidthTraffic") | _same(out, "Traffic", "BandwidthTraffic")
    out = F.map_filter(out, lambda k, v: ~((k == "Traffic") & _same(out, "Bandwidth", "Traffic")) & ~((k == "BandwidthTraffic") & double))
    return F.when(F.size(out) > 0, out)


def bar_pairs(c: Column) -> Column:
    """``key | value | key | value`` as a map; the first of a key wins; null if there is no pair."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: compact_ws(p)), lambda p: p != "")
    n = F.floor(F.size(parts) / 2).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    pairs = F.transform(at, lambda i: F.struct(F.get(parts, 2 * i).alias("key"), F.get(parts, 2 * i + 1).alias("value")))
    keys = F.transform(pairs, lambda p: p.key)
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p.key) == i + 1)
    return F.when(n > 0, F.map_from_entries(first))


def normalize_key(c: Column) -> Column:
    """The usual name of a key: by the whole key, else by the first known word that it holds; else the key, 80 characters at most."""

    def named(k: Column) -> Column:
        low = F.lower(k)
        known, usual = (F.split(F.lit("|".join(x)), r"\|") for x in (fixed.SPEC_KEYS, fixed.SPEC_KEYS.values()))
        place = F.coalesce(F.nullif(F.array_position(known, low), F.lit(0)), F.array_position(F.transform(known, lambda w: F.contains(low, w)), True))
        return F.when(k == "", "").otherwise(F.coalesce(F.get(usual, place.cast("int") - 1), F.substr(k, F.lit(1), F.lit(80))))

    return let(F.btrim(compact_ws(c), F.lit(" -|:：")), named)


def noise_line(c: Column) -> Column:
    """Lines that specify nothing: empty, buttons, short prices, long text."""
    return let(compact_ws(c), lambda t: (t == "") | has_any(F.lower(t), fixed.SPEC_LINE_STOPS) | ((F.char_length(t) <= 40) & extract_price(t)["price"].isNotNull()) | (F.char_length(t) > 220))


def split_line(c: Column) -> Column:
    """struct(key, value) of a line at a bar, else at a full-width colon, else at a colon; null if none cuts a pair.

    Both sides must tell something and the key have at most 40 characters; a
    price alone is no value.
    """

    def cut(t: Column, mark: str) -> Column:
        key, value = F.trim(F.substring_index(t, mark, 1)), F.trim(F.substr(t, F.instr(t, F.lit(mark)) + 1))
        name = normalize_key(key)
        plain = extract_price(value)["price"].isNull() | has_any(F.lower(value), fixed.SPEC_VALUE_WORDS)
        fits = F.contains(t, F.lit(mark)) & (key != "") & (value != "") & (F.char_length(key) <= 40) & (name != "") & plain
        return F.when(fits, F.struct(name.alias("key"), F.substr(value, F.lit(1), F.lit(220)).alias("value")))

    return let(compact_ws(c), lambda t: F.coalesce(*(cut(t, m) for m in ("|", "：", ":"))))


def multi_pairs(c: Column) -> Column:
    """Several ``key: value`` pairs of one line, keys by their usual names; none of a line that specifies nothing."""

    def read(t: Column) -> Column:
        keys, values = (F.regexp_extract_all(t, F.lit(fixed.SPEC_PAIRS), i) for i in (1, 2))
        pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(normalize_key(p["k"]).alias("key"), F.substr(compact_ws(p["v"]), F.lit(1), F.lit(220)).alias("value")))
        kept = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "") & ~noise_line(F.concat(p["key"], F.lit(":"), p["value"])))
        # No pair is without a colon.
        none = ~F.contains(F.translate(t, "：", ":"), F.lit(":")) | (noise_line(t) & (F.regexp_count(t, F.lit("[:：]")) < 3))
        return F.when(none, F.array().cast(PAIRS)).otherwise(kept)

    return let(compact_ws(c), read)


def named_bar_pairs(c: Column) -> Column:
    """``bar_pairs`` with usual keys and without noise, as entries; parts of more than 140 characters are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: compact_ws(p)), lambda p: F.char_length(p).between(1, 140))

    def paired(parts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: (i % 2 == 0) & (i + 1 < F.size(parts)))
        return F.transform(at, lambda i: F.struct(normalize_key(F.get(parts, i)).alias("key"), F.get(parts, i + 1).alias("value")))

    return F.filter(let(parts, paired), lambda p: (p["key"] != "") & ~noise_line(F.concat(p["key"], F.lit(":"), p["value"])))


def first_entries(entries: Column) -> Column:
    """A map of entries (key, value), the first of each key; null if there are none."""
    # A lambda's body computes anew what isn't its variable, for each element: so both are variables.
    keys = lambda e: F.transform(e, lambda p: p["key"])
    first = lambda e: let(keys(e), lambda k: F.filter(e, lambda p, i: F.array_position(k, p["key"]) == i + 1))
    return let(let(entries, first), lambda f: F.when(F.size(f) > 0, F.map_from_entries(f)))


def key_value_pairs(c: Column) -> Column:
    """Several ``key: value`` of one line: a value ends where the next key begins."""
    t = compact_ws(c)
    pattern = F.lit(r"(?U)([A-Za-z][A-Za-z0-9 /_-]{0,30}?)\s*[:：]\s*(.+?)(?=\s+[A-Za-z][A-Za-z0-9/_-]{0,30}\s*[:：]|$)")
    keys, values = F.regexp_extract_all(t, pattern, 1), F.regexp_extract_all(t, pattern, 2)
    return F.transform(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p: F.struct(F.trim(p["key"]).alias("key"), F.trim(p["value"]).alias("value")))


def ordered_specs(m: Column, most: int = 15) -> Column:
    """``key: value`` lines in the order of messages; unknown keys last, by name."""
    place = lambda e: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, fixed.MESSAGE_SPECS)), e.key), F.lit(0)), F.lit(999).cast("long"))
    kept = F.filter(F.map_entries(m), lambda e: F.lower(compact_ws(e.key)) != "cycles")
    items = F.slice(F.array_sort(F.transform(kept, lambda e: F.struct(place(e).alias("p"), e.key.alias("k"), e.value.alias("v")))), 1, most)
    return F.transform(F.filter(items, lambda i: (i.k != "") & (F.coalesce(i.v, F.lit("")) != "")), lambda i: F.concat(i.k, F.lit(": "), i.v))


LOCATION_KEYS = ["Location", "location", "Data Center", "Datacenter", "Region", "Zone"]


def explicit_location(m: Column) -> Column:
    """The location that the specifications name, if any."""
    return F.coalesce(*(F.nullif(compact_ws(F.try_element_at(m, F.lit(k))), F.lit("")) for k in LOCATION_KEYS))
