"""Alert messages, at most 4096 characters of HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cycles, specs, text
from ..functions.availability import status_label
from ..functions.text import compact_ws, html_escape

#: The messages' limit, signs and titles.
LIMIT = 4096
ICONS = {"restock": "🔄", "new": "🆕", "new_location": "📍"}
TITLES = {"restock": "RESTOCK ALERT", "new": "NEW PRODUCT", "new_location": "NEW LOCATION"}
STAR = "⭐ "


def _lookup(table: dict[str, str], c: Column, default: str) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(table.items())[1:], F.when(c == next(iter(table)), next(iter(table.values())))).otherwise(default)


def display_name(name: Column, variant: Column, location: Column, domain: Column, special: Column) -> Column:
    """Variant and name, each once, with the location where it isn't told, and a star for special offers."""
    v, n, loc = compact_ws(variant), compact_ws(name), compact_ws(location)
    both = (text.generic_tier(n) & (v != "")) | ((v != "") & (n != "") & ~F.contains(F.lower(n), F.lower(v)))
    pieces = F.when(both, F.array(v, n)).when(n != "", F.array(n)).when(v != "", F.array(v)).otherwise(F.array(domain))
    keys = F.transform(pieces, text.name_key)
    kept = F.filter(pieces, lambda p, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))
    shown = F.when(F.size(kept) > 0, F.array_join(kept, " - ")).otherwise(domain)
    shown = F.when((loc != "") & ~F.contains(F.lower(shown), F.lower(loc)), F.concat(shown, F.lit(" ("), loc, F.lit(")"))).otherwise(shown)
    return F.when(special & ~shown.startswith(STAR), F.concat(F.lit(STAR), shown)).otherwise(shown)


def messages(alerts: DataFrame, now: str) -> DataFrame:
    """``alerts`` with their message.

    What is too long loses, in this order: the end of the description, the
    specifications, the cycles; at last only head, name, price and link stay.
    """
    # Each stage is a projection of its own: Spark keeps what a later one uses several times.
    c = F.col
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    count = lambda x: F.coalesce(F.size(x), F.lit(0))
    pre = lambda lines: F.concat(F.lit("<pre>"), html_escape(F.array_join(lines, "\n")), F.lit("</pre>"))
    bold = lambda x: F.concat(F.lit("<b>"), html_escape(x), F.lit("</b>"))
    d = alerts.withColumns({"_full": F.trim(F.coalesce("name", F.lit(""))), "_variant": compact_ws(c("variant_of")), "_desc": F.trim(F.coalesce("description", F.lit(""))), "_lines": specs.ordered_specs(c("specs"))})
    d = d.withColumn("_named", F.when(c("_full") == "", display_name(c("name"), c("variant_of"), c("location"), c("domain"), F.lit(False))).when((c("_variant") != "") & ~F.contains(F.lower("_full"), F.lower("_variant")), F.concat("variant_of", F.lit(" - "), "_full")).otherwise(c("_full")))
    d = d.withColumn("_plain", F.when(c("is_special") & ~c("_named").startswith(STAR), F.concat(F.lit(STAR), "_named")).otherwise(c("_named")))
    place = F.when(count(c("locations")) > 1, F.concat(F.get("locations", F.lit(0)), F.lit(" +"), (F.size("locations") - 1).cast("string"), F.lit(" more"))).otherwise(c("location"))
    icon = F.when(c("available"), "🟢").when(~c("available"), "🔴").otherwise("🟡")
    d = d.withColumn("_place", place).withColumns(
        {
            "_head": F.concat(_lookup(ICONS, c("kind"), "📢"), F.lit(" "), bold(_lookup(TITLES, c("kind"), "ALERT")), F.lit("  ·  <b>#"), text.domain_tag(c("domain")), F.lit("</b>")),
            "_name": bold(c("_plain")),
            "_info": F.concat_ws("  ·  ", F.concat(icon, F.lit(" "), status_label(c("available"))), F.when(filled(c("price")), F.concat(F.lit("💵 "), html_escape(c("price")))), F.when(filled(c("_place")), F.concat(F.lit("📍 "), html_escape(c("_place"))))),
            "_cycle": F.when(count(c("cycle_prices")) > 0, pre(cycles.ordered_cycles(c("cycle_prices")))).when(count(c("billing_cycles")) > 0, F.concat(F.lit("🔁 "), html_escape(F.array_join("billing_cycles", ", ")))),
            "_spec": F.when(count(c("_lines")) > 0, F.concat(F.lit("<b>Specs:</b>\n"), pre(c("_lines")))),
            "_link": F.concat(F.lit('🔗 <a href="'), html_escape(c("url")), F.lit('">Open Product Page</a>')),
            "_now": F.lit(f"<code>{now}</code>"),
        }
    )
    join = lambda *names: F.concat_ws("\n", *names)
    d = d.withColumn("_rest", F.lit(LIMIT) - F.char_length(join("_head", "_name", "_info", "_cycle", "_spec", "_link", "_now")) - len("<blockquote></blockquote>") - 1)
    d = d.withColumn("_told", F.when(c("_desc") != "", text.escaped_start(c("_desc"), c("_rest"))))
    d = d.withColumn("_quote", F.when(c("_told") != "", F.concat(F.lit("<blockquote>"), "_told", F.lit("</blockquote>"))))
    d = d.withColumns({"_1": join("_head", "_name", "_info", "_cycle", "_spec", "_quote", "_link", "_now"), "_2": join("_head", "_name", "_info", "_cycle", "_quote", "_link", "_now"), "_3": join("_head", "_name", "_info", "_quote", "_link", "_now")})
    fits = F.coalesce(*(F.when(F.char_length(x) <= LIMIT, c(x)) for x in ("_1", "_2", "_3")))
    least = join(c("_head"), bold(text.trim_to_escaped(c("_plain"), 320)), F.when(filled(c("price")), F.concat(F.lit("💵 "), html_escape(text.trim_to_escaped(c("price"), 120)))))
    d = d.withColumn("_fits", fits).withColumn("_least", F.when(c("_fits").isNull(), least)).withColumn("_linked", join("_least", "_link", "_now"))
    message = F.coalesce("_fits", F.when(F.char_length("_linked") <= LIMIT, c("_linked")), join("_least", "_now"))
    # A generator: filters on the message stop here instead of taking all its expressions along.
    return d.select(*alerts.columns, F.explode_outer(F.array(message)).alias("message"))
