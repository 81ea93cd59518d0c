"""Names of products: what is none, and where one can be read from if a card doesn't tell it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, url
from .text import compact_ws, has_any, let


def _count(c: Column, mark: str) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(mark), F.lit("")))


def non_name(c: Column) -> Column:
    """Headings that name no product: totals, sentences, rows of many bars."""

    def judged(n: Column) -> Column:
        low, size = F.lower(n), F.char_length(n)
        bars = F.contains(n, F.lit("|")) & ((size > 70) | (_count(n, "|") >= 3))
        sentence = (F.regexp_count(n, F.lit("[,，。:：]")) >= 2) & (size > 45)
        return (n == "") | has_any(low, fixed.NON_NAME_PHRASES) | low.isin(fixed.NON_NAMES) | bars | (size > 90) | sentence | (_count(n, " ") >= 9) | has_any(n, fixed.NON_NAME_MARKS)

    return let(compact_ws(c), judged)


def action_label(c: Column) -> Column:
    """Labels of buttons, and what is too short for a name."""
    return let(F.lower(compact_ws(c)), lambda low: has_any(low, [*fixed.ACTION_LABELS, fixed.ACTION_NAME]) | (F.char_length(low) <= 2))


def generic_name(c: Column) -> Column:
    """Names that only tell an amount, or head a price table."""
    return let(F.lower(compact_ws(c)), lambda low: (low == "") | low.rlike(r"(?U)^\d+\s*(?:core|cores?|vcpu|vcore|cpu|gb|tb|mbps|g|m|核心|核)$") | has_any(low, fixed.GENERIC_NAME_MARKS))


def suffix_token(c: Column) -> Column:
    """Short ends of an address that need the part before them: up to three characters, or a number with a letter or two."""
    return let(F.btrim(F.lower(compact_ws(c)), F.lit("-_")), lambda t: (t != "") & ((F.char_length(t) <= 3) | t.rlike(r"(?U)^\d+[a-z]{1,2}$")))


def confident_url_name(url_name: Column, instead_of: Column) -> Column:
    """Whether a name from the address may stand for another: not if that is much longer and no mere suffix."""
    u, old = compact_ws(url_name), compact_ws(instead_of)
    longer = (old != "") & (F.char_length(old) > F.char_length(u) + 10) & ~suffix_token(old)
    return url_name.isNotNull() & (F.char_length(u) >= 3) & ~longer


def name_from_text(c: Column) -> Column:
    """What stands before the first price, without stock notices, offers and cycles; null if that is no name."""
    lead = F.trim(F.regexp_replace(compact_ws(c), f"(?s){fixed.NAME_PRICE}.*$", ""))
    lead = F.regexp_replace(lead, fixed.NAME_STOCK_LEAD, "")
    lead = F.trim(F.regexp_replace(lead, r"(?isU)\bsave\b.*$", ""))
    for word in fixed.NAME_CYCLES:
        lead = F.replace(lead, F.lit(word), F.lit(" "))
    lead = compact_ws(F.regexp_replace(lead, fixed.NAME_TAIL, ""))
    return let(lead, lambda n: F.when(F.char_length(n).between(2, 140) & (_count(n, " ") < 14), n))


def name_from_lead(c: Column) -> Column:
    """The first token of a description that looks like a plan's code; null if it is a unit or has fewer than four characters."""
    found = F.regexp_extract(F.substr(compact_ws(c), F.lit(1), F.lit(220)), r"(?U)\b([A-Za-z][A-Za-z0-9._-]{2,63})\b", 1)
    return let(found, lambda n: F.when((F.char_length(n) >= 4) & ~F.upper(n).isin(fixed.LEAD_NO_NAMES), n))


def _segments(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda x: x != "")


def _route(link: Column) -> Column:
    """The segments of a route that stands in the query (``?/cart/...``), without those that assign a value."""
    return F.filter(_segments(F.regexp_extract(F.lower(link), r"(?s)\?/cart/(.*)$", 1)), lambda x: ~F.contains(x, F.lit("=")))


def _query_route(link: Column) -> Column:
    return _segments(F.substring_index(F.regexp_extract(url.query(link), r"(?s)^/cart/(.*)$", 1), "&", 1))


def _coded(parts: Column) -> Column:
    """The last part, behind the one before it where that is a dotted code and the last one a short tier."""
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    return F.when(F.contains(before, F.lit(".")) & ~F.contains(last, F.lit(".")) & (F.char_length(last) <= 12), F.concat(before, F.lit("."), last))


def name_from_url(link: Column) -> Column:
    """What an address calls its product: a store route, a product parameter, a cart route, or the path's end."""
    last = lambda p: F.element_at(p, -1)
    suffixed = lambda p: F.when((F.size(p) >= 2) & suffix_token(last(p)), F.concat(F.try_element_at(p, F.lit(-2)), F.lit("-"), last(p)))
    rp, low = url.param(link, "rp"), F.lower(url.path(link))
    store = let(_segments(rp), lambda p: F.when(rp.startswith("/store/") & (F.size(p) >= 3), F.coalesce(_coded(p), last(p))))
    product = F.nullif(F.trim(url.param(link, "product")), F.lit(""))
    pid = F.when(low.endswith("/cart.php"), F.concat(F.lit("pid-"), F.nullif(F.trim(url.param(link, "pid")), F.lit(""))))
    route = let(_route(link), lambda p: F.when(F.size(p) > 0, last(p)))
    other = let(F.filter(_query_route(link), lambda x: ~F.contains(x, F.lit("="))), lambda p: F.when(F.size(p) > 0, last(p)))
    goods = let(_segments(url.path(link)), lambda p: F.when(F.contains(low, F.lit("/products/")) & (F.size(p) >= 3), F.coalesce(_coded(p), suffixed(p), last(p))))
    end = let(_segments(url.path(link)), lambda p: F.when(F.size(p) > 0, F.coalesce(suffixed(p), last(p))))
    return F.coalesce(store, product, pid, route, other, goods, end)


def title_case(c: Column) -> Column:
    """Each run of letters with one capital in front."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), 0), F.initcap), "")


def category_label(link: Column) -> Column:
    """The category that an address stands in, as a title; null if it tells none."""
    first = lambda p: F.get(p, F.lit(0))
    low = F.lower(link)
    path = F.lower(url.path(link))
    rp = url.param(link, "rp")
    of_path = F.coalesce(*(first(_segments(F.when(F.contains(path, F.lit(m)), F.substr(path, F.instr(path, F.lit(m)) + len(m))))) for m in ("/cart/", "/store/", "/products/")))
    slug = F.when(F.contains(low, F.lit("?/cart/")), first(_route(link))).otherwise(F.coalesce(of_path, first(_query_route(link)), F.when(rp.startswith("/store/"), F.get(_segments(rp), F.lit(1)))))
    pretty = slug
    for mark in ("--", "-", "_"):
        pretty = F.replace(pretty, F.lit(mark), F.lit(" "))
    return F.nullif(title_case(compact_ws(pretty)), F.lit(""))


def variant_from_url(link: Column, name: Column) -> Column:
    """The category, unless the name tells it already."""
    return let(category_label(link), lambda c: F.when((F.coalesce(name, F.lit("")) != "") & ~F.contains(F.lower(name), F.lower(c)), c))
