"""Prices as text and as numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import begins, compact_ws, let

_TOKENS = "|".join(re.escape(t) for t in sorted(fixed.CURRENCY_TOKENS, key=len, reverse=True))
SYMBOL_FIRST = rf"(?iuU){begins(fixed.CURRENCY_TOKENS)}({_TOKENS})\s*({fixed.AMOUNT})"
AMOUNT_FIRST = rf"(?iuU)({fixed.AMOUNT})\s*({_TOKENS})"


def normalize_amount(c: Column) -> Column:
    """Thousands' commas go; a single comma before at most two digits is a decimal point."""
    s = F.regexp_replace(compact_ws(c), "[ \u00a0]", "")
    commas = F.char_length(s) - F.char_length(F.replace(s, F.lit(","), F.lit("")))
    plain = F.replace(s, F.lit(","), F.lit(""))
    return F.when(F.contains(s, F.lit(".")) | (commas != 1), plain).when(s.rlike(r",.{0,2}$"), F.replace(s, F.lit(","), F.lit("."))).otherwise(plain)


def currency_code(token: Column) -> Column:
    up = F.upper(token)
    codes = F.create_map(*(F.lit(x) for kv in fixed.CURRENCY_CODES.items() for x in kv))
    return F.coalesce(F.try_element_at(codes, up), up)


def extract_price(c: Column) -> Column:
    """struct(price, currency): the first symbol with an amount, else the first amount with a symbol; null fields without either."""
    # The first match is found once; its parts are then read from the match alone.
    none = F.lit(None).cast("struct<token:string,amount:string>")

    def read(pattern: str, token: int, amount: int):
        return lambda m: F.when(m != "", F.struct(F.regexp_extract(m, pattern, token).alias("token"), F.regexp_extract(m, pattern, amount).alias("amount"))).otherwise(none)

    def found(t: Column) -> Column:
        first = let(F.regexp_extract(t, SYMBOL_FIRST, 0), read(SYMBOL_FIRST, 1, 2))
        return F.coalesce(first, let(F.regexp_extract(t, AMOUNT_FIRST, 0), read(AMOUNT_FIRST, 2, 1)))

    def told(m: Column) -> Column:
        code = currency_code(m.token)
        return F.struct(F.when(m.isNotNull(), F.concat(normalize_amount(m.amount), F.lit(" "), code)).alias("price"), code.alias("currency"))

    return let(let(compact_ws(c), found), told)


def price_value(c: Column) -> Column:
    """The first number of a text as a double, whatever its currency."""
    number = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), fixed.PRICE_NUMBER, 1)
    return F.nullif(F.replace(number, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def cents_text(cents: Column, currency: Column | str) -> Column:
    """Cents as ``12.34 CUR``."""
    code = currency if isinstance(currency, Column) else F.lit(currency)
    return F.when(cents.isNotNull(), F.format_string("%.2f %s", cents.cast("double") / 100, code))


def months_label(months: Column) -> Column:
    """1, 3, 6, 12, 24 and 36 months have names; others are ``N Months``; null from 0 down."""
    out = F.when(months.isNull() | (months <= 0), F.lit(None).cast("string"))
    for n, label in fixed.MONTHS.items():
        out = out.when(months == n, label)
    return out.otherwise(F.format_string("%d Months", months.cast("long")))


def megabytes_text(mb: Column) -> Column:
    """GB where a whole number (within a hundredth), else one decimal; below one GB in MB."""
    gb = mb.cast("double") / 1024
    near = F.abs(gb - F.round(gb)) < 0.01
    return F.when(mb.isNull(), None).when((gb >= 1) & near, F.format_string("%dGB", F.round(gb).cast("long"))).when(gb >= 1, F.format_string("%.1fGB", gb)).otherwise(F.format_string("%dMB", mb.cast("long")))


def preferred_price(cycle_prices: Column, order: list[str] | None = None) -> Column:
    """The price of the first preferred cycle that is there, else of the map's first."""
    named = (F.try_element_at(cycle_prices, F.lit(c)) for c in order or fixed.PREFERRED_CYCLES)
    return F.coalesce(*named, F.get(F.map_values(cycle_prices), F.lit(0)))


def dashboard_price(price: Column, cycle_prices: Column) -> Column:
    """struct(price, price_value): the price's number, else that of the first cycle price that has one."""
    own = price_value(price)
    named = F.transform(F.array(*map(F.lit, fixed.DASHBOARD_CYCLES)), lambda c: F.try_element_at(cycle_prices, c))
    texts = F.filter(F.concat(named, F.coalesce(F.map_values(cycle_prices), F.array().cast("array<string>"))), lambda t: price_value(t).isNotNull())
    text = F.coalesce(price, F.lit(""))
    other = F.get(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0))
    return F.struct(F.when((text == "") & own.isNull() & other.isNotNull(), other).otherwise(text).alias("price"), F.coalesce(own, price_value(other)).alias("price_value"))


def best_monthly(price_datas: Column) -> Column:
    """The least price of one month, else the least price per month, of an array of (price, cycle)."""
    usable = F.filter(price_datas, lambda p: p.price.isNotNull() & (F.coalesce(F.nullif(p.cycle, F.lit(0)), F.lit(1)) > 0))
    cycle = lambda p: F.coalesce(F.nullif(p.cycle, F.lit(0)), F.lit(1))
    monthly = F.array_min(F.transform(F.filter(usable, lambda p: cycle(p) == 1), lambda p: p.price.cast("double")))
    return F.coalesce(monthly, F.array_min(F.transform(usable, lambda p: p.price.cast("double") / cycle(p))))
