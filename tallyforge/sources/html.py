"""HTML as rows: one element each, so that selecting is filtering and nesting is a range join.

Elements are numbered in document order; the descendants of one are those
whose number lies between its own and its ``last``. ``text`` is all that an
element shows, ``own`` what stands in it beside its children.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cycles, fixed, money, text, url
from ..functions.availability import extract_availability, purchase_action

ELEMENT = T.StructType(
    [
        *(T.StructField(c, T.IntegerType()) for c in ("pos", "parent", "last")),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("own", T.StringType()),
    ]
)
#: Elements without content, and elements whose text isn't shown (fixed by the format).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style"}
#: Elements that close an open one of the same kind.
CLOSED_BY = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and self.rows[self.open[-1]][3] in CLOSED_BY.get(tag, ()):
            self._close()
        self.rows.append([len(self.rows), self.open[-1] if self.open else -1, len(self.rows), tag, {k: v or "" for k, v in attrs}, [], []])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag: str) -> None:
        if any(self.rows[i][3] == tag for i in self.open):
            while self.rows[self.open[-1]][3] != tag:
                self._close()
            self._close()

    def _close(self) -> None:
        self.rows[self.open.pop()][2] = len(self.rows) - 1

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(self.rows[i][3] in HIDDEN for i in self.open):
            for i in self.open:
                self.rows[i][5].append(data)
            if self.open:
                self.rows[self.open[-1]][6].append(data)

    def result(self) -> list[dict]:
        while self.open:
            self._close()
        plain = lambda parts: " ".join(" ".join(parts).split())
        return [dict(zip(("pos", "parent", "last", "tag", "attrs", "text", "own"), (*r[:5], plain(r[5]), plain(r[6])), strict=True)) for r in self.rows]


@F.arrow_udf(T.ArrayType(ELEMENT))
def _elements(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("own", pa.string())]))
    for pages in batches:
        out = []
        for page in pages:
            parser = _Elements()
            parser.feed(page.as_py() or "")
            parser.close()
            out.append([{**r, "attrs": list(r["attrs"].items())} for r in parser.result()])
        yield pa.array(out, kind)


def elements(html: Column) -> Column:
    """The elements of a page as an array of structs; null has none."""
    return _elements(html)


class _Links(HTMLParser):
    """Only elements that lead somewhere: anchors with an address, and handlers of clicks; no text is kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if attrs:
            kept = {k: v or "" for k, v in attrs if k == "onclick" or (k == "href" and tag == "a")}
            if kept:
                self.found.append((tag, list(kept.items())))


@F.arrow_udf(T.ArrayType(T.StructType([f for f in ELEMENT if f.name in ("tag", "attrs")])))
def _linked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))
    for pages in batches:
        out = []
        for page in pages:
            parser = _Links()
            parser.feed(page.as_py() or "")
            parser.close()
            out.append([{"tag": t, "attrs": a} for t, a in parser.found])
        yield pa.array(out, kind)


def linked(html: Column) -> Column:
    """The elements of a page that have an address or a click handler, with these only, in order; null has none."""
    return _linked(html)


def has_class(e: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.try_element_at(e["attrs"], F.lit("class")), F.lit("")), r"\s+"), name)


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def inside(els: Column, e: Column) -> Column:
    """The elements within one."""
    return F.filter(els, lambda x: (x["pos"] > e["pos"]) & (x["pos"] <= e["last"]))


def _cycle_control(e: Column, tag: str) -> Column:
    return (e["tag"] == tag) & F.coalesce(attr(e, "name"), F.lit("")).contains("cycle")


def cycles_in_page(els: Column, html: Column) -> Column:
    """Distinct cycle labels of cycle selects and inputs, then of links and text; null if none."""
    options = F.flatten(F.transform(F.filter(els, lambda e: _cycle_control(e, "select")), lambda s: F.flatten(F.transform(F.filter(inside(els, s), lambda o: o["tag"] == "option"), lambda o: F.array(attr(o, "value"), o["text"])))))
    inputs = F.transform(F.filter(els, lambda e: _cycle_control(e, "input")), lambda i: attr(i, "value"))
    marked = F.array_compact(F.transform(F.concat(options, inputs, F.regexp_extract_all(html, F.lit("(?i)billingcycle=([a-z]+)"), 1)), cycles.normalize_cycle))
    every = F.array_distinct(F.concat(marked, F.coalesce(cycles.cycles_in_text(html), F.array().cast("array<string>"))))
    return text.let(every, lambda found: F.when(F.size(found) > 0, found))


def cycle_prices_in_page(els: Column) -> Column:
    """Label to price, from options of cycle selects and price elements of a ``cycle-x`` class; the first of a label wins."""
    options = F.flatten(F.transform(F.filter(els, lambda e: _cycle_control(e, "select")), lambda s: F.transform(F.filter(inside(els, s), lambda o: o["tag"] == "option"), lambda o: F.struct(attr(o, "value").alias("c"), o["text"].alias("t")))))
    spans = F.transform(
        F.filter(els, lambda e: has_class(e, "product-price") & F.coalesce(attr(e, "class"), F.lit("")).contains("cycle-")),
        lambda e: F.struct(F.regexp_extract(attr(e, "class"), r"(?i)\bcycle-([a-z0-9]+)\b", 1).alias("c"), e["text"].alias("t")),
    )
    pairs = F.transform(F.concat(options, spans), lambda p: F.struct(F.coalesce(cycles.normalize_cycle(p["c"]), cycles.normalize_cycle(p["t"])).alias("key"), money.extract_price(p["t"])["price"].alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    first = lambda all_: F.filter(all_, lambda p, i: F.array_position(F.transform(all_, lambda x: x["key"]), p["key"]) == i + 1)
    return text.let(text.let(pairs, first), lambda f: F.when(F.size(f) > 0, F.map_from_entries(f)))


#: Classes and elements that group form controls, and those that label them (fixed values).
GROUPS = {"div": ["form-group", "cart-item", "option-val", "section"], "": ["configoptions", "product-config", "order-config"]}
LABELS = ["control-label", "font-weight-bold", "section-title"]


def location_control(e: Column) -> Column:
    """Form controls by whose name shops ask for a location."""
    n = F.lower(F.trim(F.coalesce(attr(e, "name"), F.lit(""))))
    return n.startswith("configoption") | n.startswith("custom") | n.rlike(r"configoption\[|custom\[|location|datacenter|data_center|data center")


def location_variants(els: Column) -> Column:
    """Distinct (name, available) of the options whose group's label names a location, in order."""
    group = lambda e: (e["tag"] == "fieldset") | F.coalesce(F.exists(F.array(*map(F.lit, GROUPS["div"])), lambda c: (e["tag"] == "div") & F.array_contains(F.split(F.coalesce(attr(e, "class"), F.lit("")), r"\s+"), c)), F.lit(False)) | F.exists(F.array(*map(F.lit, GROUPS[""])), lambda c: F.array_contains(F.split(F.coalesce(attr(e, "class"), F.lit("")), r"\s+"), c))
    label = lambda e: e["tag"].isin("label", "h2", "h3", "h4") | F.exists(F.array(*map(F.lit, LABELS)), lambda c: F.array_contains(F.split(F.coalesce(attr(e, "class"), F.lit("")), r"\s+"), c))

    def of(g: Column) -> Column:
        own = inside(els, g)
        named = F.array_join(F.transform(F.filter(own, label), lambda x: x["text"]), " ")
        selects = F.filter(own, lambda e: (e["tag"] == "select") & location_control(e))
        options = F.flatten(F.transform(selects, lambda s: F.transform(F.filter(inside(els, s), lambda o: o["tag"] == "option"), lambda o: o["text"])))
        radios = F.transform(F.filter(own, lambda e: (e["tag"] == "input") & F.coalesce(attr(e, "type"), F.lit("")).isin("radio", "checkbox") & location_control(e)), lambda i: attr(i, "value"))
        return F.when(text.location_label(named), F.concat(options, radios)).otherwise(F.array().cast("array<string>"))

    raw = F.flatten(F.transform(F.filter(els, group), of))
    found = F.transform(raw, lambda t: F.struct(text.clean_location(t).alias("name"), extract_availability(t).alias("available")))
    found = F.filter(found, lambda v: v["name"].isNotNull() & ~F.lower(v["name"]).isin(fixed.VALUE_BLOCKS))
    keys = F.transform(found, lambda v: F.lower(v["name"]))
    return F.filter(found, lambda v, i: F.array_position(keys, F.lower(v["name"])) == i + 1)


def _classes(e: Column) -> Column:
    return F.coalesce(attr(e, "class"), F.lit(""))


def disabled(e: Column) -> Column:
    return F.map_contains_key(e["attrs"], "disabled") | F.contains(F.lower(_classes(e)), F.lit("disabled"))


def label(e: Column) -> Column:
    """A control's text, or its value."""
    return F.coalesce(F.nullif(e["text"], F.lit("")), text.compact_ws(attr(e, "value")))


def availability_in_page(els: Column, html: Column, trusted: Column | None = None) -> Column:
    """From a detail page; the first of these that tells decides.

    Elements of a sold-out class whose text is empty or says so; controls, in
    order: one that says sold out, one that is enabled and says in stock, or an
    enabled buy button beside an order form; the page's words, if they say sold
    out; an enabled buy button; the page's words. ``trusted`` pages need no form.
    """
    split = lambda e: F.split(_classes(e), r"\s+")
    marked = F.filter(els, lambda e: F.arrays_overlap(split(e), F.array(*map(F.lit, fixed.SOLD_CLASSES))) | text.has_any(_classes(e), fixed.SOLD_CLASS_PARTS))
    sold = F.exists(marked, lambda e: F.coalesce(~extract_availability(e["text"]), e["text"] == ""))
    controls = F.filter(els, lambda e: e["tag"].isin("a", "button") | ((e["tag"] == "input") & F.coalesce(attr(e, "type"), F.lit("")).isin("submit", "button")))
    told = F.transform(controls, lambda e: F.struct(extract_availability(label(e)).alias("says"), purchase_action(label(e)).alias("buys"), (~disabled(e)).alias("on")))
    form = text.has_any(F.lower(text.compact_ws(html)), fixed.ORDER_FORM_MARKS) | (F.lit(False) if trusted is None else trusted)
    buys = lambda t: t.says.isNull() & t.on & t.buys
    verdicts = F.array_compact(F.transform(told, lambda t: F.when(~t.says, False).when(t.says & t.on, True).when(buys(t) & form, True)))
    page = extract_availability(html)
    return F.when(sold, False).when(F.size(verdicts) > 0, F.get(verdicts, F.lit(0))).when(~page, False).when(F.exists(told, buys), True).otherwise(page)


def page_links(els: Column) -> Column:
    """(href, text) of links, and the addresses in click handlers."""
    links = F.transform(F.filter(els, lambda e: (e["tag"] == "a") & (F.coalesce(attr(e, "href"), F.lit("")) != "")), lambda e: F.struct(attr(e, "href").alias("href"), e["text"].alias("text")))
    clicks = F.transform(F.filter(els, lambda e: url.onclick_url(attr(e, "onclick")).isNotNull()), lambda e: F.struct(url.onclick_url(attr(e, "onclick")).alias("href"), e["text"].alias("text")))
    return F.concat(links, clicks)


def form_ids(els: Column, keys: list[str]) -> Column:
    """Distinct ids that form inputs hold, sorted."""
    found = F.filter(els, lambda e: (e["tag"] == "input") & F.lower(F.trim(F.coalesce(attr(e, "name"), F.lit("")))).isin(keys) & F.coalesce(F.trim(attr(e, "value")), F.lit("")).rlike(r"^\d{1,18}$"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda e: F.trim(attr(e, "value")).cast("long"))))


def definition_pairs(els: Column) -> Column:
    """Terms and descriptions of lists, paired by position; a longer side is cut."""
    terms = F.transform(F.filter(els, lambda e: e["tag"] == "dt"), lambda e: e["text"])
    values = F.transform(F.filter(els, lambda e: e["tag"] == "dd"), lambda e: e["text"])
    return F.filter(F.transform(F.arrays_zip(terms.alias("key"), values.alias("value")), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))), lambda p: p["key"].isNotNull() & p["value"].isNotNull())


def modal_links(pages: DataFrame, els: str = "els") -> DataFrame:
    """Rows joined to the dialogs their buttons open: (url, row, href, text), a row per link of the dialog."""
    e = pages.select("url", F.explode(els).alias("e")).select("url", "e.*")
    rows = e.where("tag = 'tr'").select("url", F.col("pos").alias("row"), F.col("last").alias("row_last"))
    buttons = e.select("url", "pos", F.regexp_replace(F.coalesce(F.try_element_at("attrs", F.lit("data-bs-target")), F.try_element_at("attrs", F.lit("data-target"))), "^#", "").alias("target")).where("target is not null")
    owned = buttons.alias("b").join(rows.alias("r"), (F.col("b.url") == F.col("r.url")) & F.col("b.pos").between(F.col("r.row"), F.col("r.row_last"))).select("b.url", "r.row", "b.target")
    dialogs = e.select("url", F.try_element_at("attrs", F.lit("id")).alias("target"), F.col("pos").alias("first"), "last").where("target is not null")
    links = e.where("tag = 'a'").select("url", "pos", F.try_element_at("attrs", F.lit("href")).alias("href"), "text")
    return owned.join(dialogs, ["url", "target"]).alias("d").join(links.alias("l"), (F.col("d.url") == F.col("l.url")) & F.col("l.pos").between(F.col("d.first"), F.col("d.last"))).select("d.url", "d.row", "l.href", "l.text")
