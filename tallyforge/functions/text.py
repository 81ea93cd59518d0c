"""String expressions: white space, keys, escapes, names. All are ``Column -> Column`` and run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of Unicode white space that aren't a single blank. Printable ASCII, most of any text, is told by one comparison.
SPACE = rf"(?: (?=[{_BLANKS}])|[[^ -~]&&[{_BLANKS}]])[{_BLANKS}]*"


def either(words: list[str]) -> str:
    """A pattern that matches any of the words literally."""
    return "|".join(re.escape(w) for w in words)


def begins(words: list[str]) -> str:
    """A look at one character that rules most places out before the words are tried there one after another."""
    return f"(?=[{''.join(sorted({re.escape(w[0]) for w in words}))}])"


def has_any(c: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words."""
    return c.rlike(f"{begins(words)}(?:{either(words)})")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null where none is."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compact_ws(c: Column) -> Column:
    """Unicode white space collapsed to single blanks and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def slugify(c: Column, default: str = "x") -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, none at the ends."""
    dashed = F.regexp_replace(F.lower(compact_ws(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit(default))


def name_key(c: Column) -> Column:
    """Only a-z and 0-9 of the lower-cased text."""
    return F.regexp_replace(F.lower(compact_ws(c)), "[^a-z0-9]+", "")


def html_escape(c: Column, apostrophe: bool = True) -> Column:
    """Text for HTML; the browser's variant leaves the apostrophe."""
    rarer = [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")] + [("'", "&#x27;")] * apostrophe

    def escaped(raw: Column) -> Column:
        e = F.replace(raw, F.lit("&"), F.lit("&amp;"))
        # Looking for a character costs far less than a replacement's pass.
        there = reduce(lambda a, b: a | b, (F.contains(raw, F.lit(p[0])) for p in rarer))
        return F.when(there, reduce(lambda e, p: F.replace(e, F.lit(p[0]), F.lit(p[1])), rarer, e)).otherwise(e)

    return let(F.coalesce(c.cast("string"), F.lit("")), escaped)


def script_safe_json(c: Column) -> Column:
    """JSON that can stand in a script element."""
    for ch in "&<>\u2028\u2029":
        c = F.replace(c, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    return c


def special_offer(name: Column, url: Column, description: Column | None = None) -> Column:
    """Whether name, URL or description holds a word of special offers."""
    parts = [F.coalesce(x, F.lit("")) for x in (name, url, F.lit(None) if description is None else description)]
    return F.lower(F.concat_ws(" ", *parts)).rlike(either(fixed.SPECIAL_WORDS))


def generic_tier(name: Column) -> Column:
    return F.lower(compact_ws(name)).isin(fixed.TIER_NAMES)


def name_quality(name: Column) -> Column:
    """0 to 4: six characters, letters with digits, a bar or dash, two words."""
    n = compact_ws(name)
    signals = [F.char_length(n) >= 6, n.rlike(r"[a-zA-Z].*\p{Nd}|\p{Nd}.*[a-zA-Z]"), n.rlike(r"[|\-]"), F.contains(n, F.lit(" "))]
    return F.when(n == "", 0).otherwise(sum((s.cast("int") for s in signals), F.lit(0)))


def domain_tag(domain: Column) -> Column:
    """The registrable label of a domain; second-level suffixes of country codes count as suffixes."""
    labels = F.filter(F.split(F.lower(F.coalesce(domain, F.lit(""))), r"\."), lambda x: x != "")
    n = F.size(labels)
    country = (n >= 3) & F.get(labels, n - 2).isin(fixed.SECOND_LEVEL) & (F.char_length(F.get(labels, n - 1)) == 2)
    label = F.when(country, F.get(labels, n - 3)).when(n >= 2, F.get(labels, n - 2)).otherwise(F.get(labels, F.lit(0)))
    return F.coalesce(F.nullif(F.regexp_replace(label, "[^a-z0-9]", ""), F.lit("")), F.lit("site"))


def clean_location(c: Column) -> Column:
    """A location without test addresses, stock remarks at its end, and outer dashes."""
    v = F.regexp_replace(compact_ws(c), r"(?i)\(\s*test\s*ip[^)]*\)", "")
    v = F.regexp_replace(v, r"(?i)\s*-\s*(?:in\s*stock|out\s*of\s*stock|sold\s*out)\s*$", "")
    return F.btrim(F.regexp_replace(v, SPACE, " "), F.lit(" -"))


def location_label(c: Column) -> Column:
    """Whether a label names a location: a hint and none of the blocked words."""
    t = F.lower(compact_ws(c))
    return t.rlike(either(fixed.LOCATION_HINTS)) & ~t.rlike(either(fixed.LOCATION_BLOCKS))


def page_signature(url: Column, html: Column) -> Column:
    """Host and path, and a digest of the text with long hex and digit runs masked."""
    from . import url as u

    path = F.regexp_replace(F.coalesce(F.nullif(u.path(url), F.lit("")), F.lit("/")), "/+$", "")
    key = F.lower(F.concat(u.scheme(url), F.lit("://"), u.authority(url), F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))))
    body = F.regexp_replace(F.regexp_replace(F.lower(compact_ws(html)), "[a-f0-9]{24,}", "x"), r"(?U)\b\d{4,}\b", "n")
    return F.when(body == "", key).otherwise(F.concat(key, F.lit("::"), F.substr(F.sha1(body), F.lit(1), F.lit(20))))


def redirect_signature(url: Column) -> Column:
    """Scheme, host and path in lower case."""
    from . import url as u

    return F.lower(F.concat(u.scheme(url), F.lit("://"), u.authority(url), u.path(url)))


def map_text(m: Column) -> Column:
    """``key:value`` pairs of a map, by blanks."""
    return F.array_join(F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.concat(e.key, F.lit(":"), e.value)), " ")


def search_blob(domain: Column, name: Column, original_name: Column, price: Column, description: Column, original_description: Column, specs: Column, cycle_prices: Column, locations: Column, url: Column) -> Column:
    """All that a text search looks at, in lower case."""
    blank = F.lit("")
    parts = [domain, name, original_name, price, description, original_description, map_text(specs), map_text(cycle_prices), F.array_join(F.coalesce(locations, F.array().cast("array<string>")), " "), url]
    return F.lower(F.concat_ws(" ", *(F.coalesce(p, blank) for p in parts)))


def dotted_code(name: Column, url: Column, description: Column) -> Column:
    """The first code like ``A.B.C`` of URL or description whose last part is the name, else the first; null without any."""
    pattern = F.lit(r"\b([A-Za-z0-9]+(?:\.[A-Za-z0-9]+){2,})\b")
    found = F.concat(*(F.regexp_extract_all(F.coalesce(c, F.lit("")), pattern, 1) for c in (url, description)))
    same = F.filter(found, lambda c: F.lower(F.element_at(F.split(c, r"\."), -1)) == F.lower(compact_ws(name)))
    return F.coalesce(F.get(same, F.lit(0)), F.get(found, F.lit(0)))


def natural_key(c: Column) -> Column:
    """A sort key by which digit runs of any length order as numbers, and letters without case: a run's length stands before it."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(r"\d+|\D+"), 0)
    number = lambda d: F.coalesce(F.nullif(F.regexp_replace(d, "^0+", ""), F.lit("")), F.lit("0"))
    told = lambda d: F.concat(F.lpad(F.char_length(d).cast("string"), 10, "0"), d)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), told(number(p))).otherwise(p)), "")


def html_unescape(c: Column) -> Column:
    """The text that ``html_escape`` was given."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&#x27;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")], c)


def escaped_start(c: Column, most: Column | int) -> Column:
    """``trim_to_escaped``, escaped.

    No character is longer unescaped, so only the first ``most`` ones are looked
    at. Every ``&`` of escaped text begins an entity of at most six characters,
    so the only one that a cut can break is at the end.
    """
    most = most if isinstance(most, Column) else F.lit(most)
    room = F.greatest(most, F.lit(0))

    def cut(e: Column) -> Column:
        start = F.substr(e, F.lit(1), most - 3)
        broken = F.char_length(F.regexp_extract(F.right(start, F.lit(5)), "&[^;]*$", 0))
        return F.when(F.char_length(e) <= room, F.when(most > 0, e).otherwise("")).when(most < 3, "").otherwise(F.concat(F.rtrim(F.substr(e, F.lit(1), most - 3 - broken)), F.lit("...")))

    return let(html_escape(F.substr(F.coalesce(c, F.lit("")), F.lit(1), room + 1)), cut)


def trim_to_escaped(c: Column, most: Column | int) -> Column:
    """The longest start of the text that, escaped and with an ellipsis if cut, has at most ``most`` characters."""
    return html_unescape(escaped_start(c, most))
