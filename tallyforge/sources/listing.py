"""Listings that need more than cards: a page of all products by id, and tables of plans whose buttons open dialogs of places.

Both look at a page's own element array; only texts and addresses leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed, money, specs, text, url
from ..functions.text import compact_ws, has_any
from . import cards, html


def typed(products: DataFrame) -> DataFrame:
    """The columns of ``schemas.PRODUCT``; those that ``products`` lacks are null."""
    fields = [f.split(" ", 1) for f in schemas.PRODUCT.split(", ")]
    return products.select(*((F.col(n) if n in products.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))


def _paged(pages: DataFrame, text_: str) -> DataFrame:
    """(base, page, els): parsed pages; ``page`` is their seq, or 0. A null or empty page has no elements and is left out."""
    page = F.coalesce(F.col("seq"), F.lit(0)).cast("bigint") if "seq" in pages.columns else F.lit(0).cast("bigint")
    return pages.select(F.col("url").alias("base"), page.alias("page"), html.elements(F.col(text_)).alias("els")).where((F.size("els") > 0) & F.col("base").isNotNull())


def _first(els: Column, test) -> Column:
    return F.get(F.filter(els, test), F.lit(0))


def listing_map(pages: DataFrame, *, text_: str = "text") -> DataFrame:
    """(domain, pid, name, available, price, currency, specs, root, seq): what listing pages tell of the products of their domain.

    An item without an id of digits or a title is none. A box of a sold-out
    class is out of stock, any other in stock. Of several items of one id the
    last on the last page counts (by seq). Kept as a table, it is joined to
    every product of its domain, see ``plans.engine.cleaned``.
    """
    c = F.col
    of = lambda name: lambda e: F.array_contains(F.split(F.coalesce(html.attr(e, "class"), F.lit("")), r"\s+"), name)
    is_box = lambda e: of(fixed.LISTING_BOX)(e) & html.attr(e, "pid").isNotNull()

    def item(els: Column, e: Column) -> Column:
        def told(inside: Column) -> Column:
            box = _first(inside, is_box)
            featured = F.filter(inside, lambda x: of(fixed.LISTING_FEATURES[0])(x) | of(fixed.LISTING_FEATURES[2])(x) | ((x["tag"] == "li") & F.exists(inside, lambda o: of(fixed.LISTING_FEATURES[1])(o) & (x["pos"] > o["pos"]) & (x["pos"] <= o["last"]))))
            return F.struct(
                e["pos"].alias("pos"), F.trim(html.attr(box, "pid")).alias("pid"), F.coalesce(html.attr(box, "class"), F.lit("")).alias("classes"), _first(inside, of(fixed.LISTING_TITLE))["text"].alias("name"),
                _first(inside, of(fixed.LISTING_PRICE))["text"].alias("price"), F.transform(featured, lambda x: x["text"]).alias("features"), e["text"].alias("text"),
            )

        return text.let(cards.inner(els, e), told)

    rows = _paged(pages, text_).select("base", "page", F.explode(F.transform(F.filter("els", of(fixed.LISTING_ITEM)), lambda e: item(c("els"), e))).alias("i")).select("base", "page", "i.*")
    rows = rows.where(c("pid").rlike(r"^\d+$") & (compact_ws(c("name")) != "")).withColumn("price", money.extract_price(c("price")))
    entries = lambda t: F.coalesce(F.map_entries(specs.extract_specs(t)), F.array().cast(cards.PAIR))
    listed = F.flatten(F.transform("features", entries))
    last = specs.first_entries(F.reverse(F.when(F.size(listed) > 0, listed).otherwise(entries(c("text")))))
    rows = rows.select(
        url.domain(c("base")).alias("domain"), c("pid").try_cast("bigint").alias("pid"), compact_ws(c("name")).alias("name"), (~F.contains("classes", F.lit(fixed.LISTING_SOLD))).alias("available"), "price.price", "price.currency", last.alias("specs"),
        url.root(c("base")).alias("root"), (c("page") * (1 << 27) + c("pos")).alias("seq"),
    ).where("pid is not null")
    return rows.groupBy("domain", "pid").agg(F.max_by(F.struct("name", "available", "price", "currency", "specs", "root", "seq"), "seq").alias("r")).select("domain", "pid", "r.*")


def listing_products(listing: DataFrame) -> DataFrame:
    """Product rows of a listing map: each id under its address in the cart."""
    c = F.col
    link = F.concat("root", F.lit("/cart.php?a=add&pid="), c("pid").cast("string"))
    return typed(listing.withColumns({"url": link, "id": F.concat("domain", F.lit("::"), url.normalize_for_id(link)), "is_special": text.special_offer(c("name"), link)}))


def with_listing(products: DataFrame, listed: DataFrame) -> DataFrame:
    """Parsed products and those of listing maps: a parsed row stays, unless only the listing has its price."""
    has = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    both = products.withColumn("_late", F.lit(0)).unionByName(listed.withColumn("_late", F.lit(1)))
    row = F.struct(*products.columns)
    per = both.groupBy("id").agg(
        F.max_by(row, F.when(F.col("_late") == 0, F.col("seq"))).alias("own"), F.max_by(row, F.when(F.col("_late") == 1, F.col("seq"))).alias("map"),
    )
    mapped = F.col("own").isNull() | (~has("own.price") & has("map.price"))
    return per.select(F.when(mapped, F.col("map")).otherwise(F.col("own")).alias("r")).select("r.*")


def plan_rows(pages: DataFrame, *, text_: str = "text") -> DataFrame:
    """A product row per plan and place of the pages' plan tables.

    A row's first cell names the plan, the next ones specify it. Its button
    names a dialog, whose store links are the plan's places; where it has none,
    the row's own store links are. Rows of fewer than four cells are no plans.
    Of links with one identity the first on the page stays.
    """
    c = F.col
    cells = lambda inside: F.transform(F.filter(inside, lambda x: x["tag"].isin("td", "th")), lambda x: compact_ws(x["text"]))
    anchors = lambda inside, kind: F.transform(F.filter(inside, lambda x: (x["tag"] == "a") & (F.coalesce(html.attr(x, "href"), F.lit("")) != "")), lambda x: F.struct(F.lit(kind).alias("kind"), x["pos"].alias("pos"), html.attr(x, "href").alias("href"), compact_ws(x["text"]).alias("label")))

    def plan(els: Column, e: Column) -> Column:
        def told(inside: Column) -> Column:
            target = F.trim(F.regexp_replace(html.attr(_first(inside, lambda x: html.attr(x, "data-bs-target").isNotNull()), "data-bs-target"), "^#+", ""))
            dialog = _first(els, lambda x: (target != "") & (html.attr(x, "id") == target))
            own = anchors(inside, 1)
            return F.struct(e["pos"].alias("row"), cells(inside).alias("cells"), F.when(dialog.isNotNull(), F.concat(anchors(cards.inner(els, dialog), 0), own)).otherwise(own).alias("links"))

        return text.let(cards.inner(els, e), told)

    is_row = lambda e: (e["tag"] == "tr") & F.array_contains(F.split(F.coalesce(html.attr(e, "class"), F.lit("")), r"\s+"), fixed.PLAN_ROW)
    plans = _paged(pages, text_).select("base", "page", F.explode(F.transform(F.filter("els", is_row), lambda e: plan(c("els"), e))).alias("p")).select("base", "page", "p.*").where(F.size("cells") >= 4)
    priced = F.filter("cells", lambda x: has_any(x, fixed.PRICE_MARKS))
    plans = plans.withColumns({"price": money.extract_price(F.coalesce(F.try_element_at(priced, F.lit(-1)), F.array_join("cells", " "))), "domain": url.domain(c("base"))})
    plans = plans.withColumn("plan", F.coalesce(F.nullif(F.get("cells", F.lit(0)), F.lit("")), c("domain")))
    rows = plans.select("base", "page", "domain", "row", "plan", "cells", "price", F.explode("links").alias("l")).select("base", "page", "domain", "row", "plan", "cells", "price", "l.*")
    rows = rows.withColumn("url", url.resolve(c("base"), c("href"))).where(F.contains(F.lower("url"), F.lit(fixed.PLAN_LINK)))
    rows = rows.withColumn("best", F.min("kind").over(Window.partitionBy("base", "page", "row"))).where("kind = best")
    rows = rows.withColumn("place", F.when(~F.lower("label").isin(fixed.PLAN_BUTTONS), F.nullif("label", F.lit(""))))
    named = F.transform(F.sequence(F.lit(0), F.lit(len(fixed.PLAN_CELLS) - 1)), lambda i: F.struct(F.get(F.array(*map(F.lit, fixed.PLAN_CELLS)), i).alias("key"), F.get(c("cells"), i + 1).alias("value")))
    pairs = F.filter(F.concat(named, F.array(F.struct(F.lit("Location").alias("key"), c("place").alias("value")))), lambda p: F.coalesce(p["value"], F.lit("")) != "")
    rows = rows.withColumns({"name": F.concat_ws(" / ", "plan", "place"), "specs": F.map_from_entries(pairs), "id": F.concat("domain", F.lit("::"), url.normalize_for_id(c("url")))})
    first = rows.groupBy("page", "base", "id").agg(F.min_by(F.struct("domain", "url", "name", "price", "specs", "plan", "place", "row", "pos"), F.struct("row", "pos")).alias("r")).select("page", "id", "r.*")
    return typed(
        first.select(
            "id", "domain", "url", "name", "price.price", "price.currency", F.when(F.size("specs") > 0, c("specs")).alias("specs"), c("plan").alias("variant_of"), c("place").alias("location"), text.special_offer(c("name"), c("url")).alias("is_special"),
            (c("page") * (1 << 27) + F.row_number().over(Window.partitionBy("page", "domain").orderBy("row", "pos")) - 1).alias("seq"),
        )
    )


def plan_tables(pages: DataFrame, *, text_: str = "text", settle=lambda df: df) -> DataFrame:
    """The plan rows of pages, and product cards of pages that have none.

    Pages that end in .php outside the billing tree and have no plan table only
    lead on: no cards are read from them. ``settle`` keeps the plan rows, which
    are looked at twice.
    """
    found = settle(plan_rows(pages, text_=text_))
    with_page = pages.withColumn("_page", F.coalesce("seq", F.lit(0)).cast("bigint")) if "seq" in pages.columns else pages.withColumn("_page", F.lit(0).cast("bigint"))
    told = found.select("domain", F.floor(F.col("seq") / (1 << 27)).alias("_page")).distinct()
    rest = with_page.withColumn("domain", url.domain(F.col("url"))).join(told, ["domain", "_page"], "left_anti")
    table = F.lower(F.col(text_)).rlike(rf"<tr\b[^>]*\bclass\s*=[^>]*\b{fixed.PLAN_ROW}\b")
    leads = F.lower(url.path(F.col("url"))).endswith(".php") & ~F.contains(F.lower("url"), F.lit("/billing/"))
    return found.unionByName(typed(cards.card_products(rest.where(F.coalesce(table, F.lit(False)) | ~leads).drop("domain", "_page"), text_=text_)))
