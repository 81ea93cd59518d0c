"""Parsers by domain: each turns captured pages into product rows, and each page goes to the parser of its domain.

A parser is a function (pages, **options) -> rows of ``schemas.PRODUCT``, built
from DataFrame operations like any other table function. A registry holds the
parsers, which of them a domain has and with which options, so that users add
their own; domains that aren't registered have the general one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import url
from . import cards, listing, store_json

Parser = Callable[..., DataFrame]


@dataclass(frozen=True)
class Binding:
    """A parser's name and its options."""

    parser: str
    options: tuple[tuple[str, object], ...] = ()


@dataclass
class Registry:
    """Which parser reads which domain's pages."""

    parsers: dict[str, Parser] = field(default_factory=lambda: {"cards": cards.card_products, "json": _json, "plans": listing.plan_tables})
    domains: dict[str, Binding] = field(default_factory=dict)
    general: Binding = Binding("cards")

    def register(self, name: str, parser: Parser) -> Registry:
        """Add a parser; a name is taken once."""
        if name in self.parsers:
            raise ValueError(f"there is a parser {name}")
        self.parsers[name] = parser
        return self

    def bind(self, parser: str, *domains: str, **options: object) -> Registry:
        """Let ``parser`` read the pages of ``domains``, with its options; a later binding of a domain replaces an earlier one."""
        if parser not in self.parsers:
            raise ValueError(f"no parser {parser}")
        for d in domains:
            self.domains[d.lower()] = Binding(parser, tuple(sorted(options.items())))
        return self

    def of(self, domain: str) -> Binding:
        return self.domains.get(domain.lower(), self.general)

    def products(self, pages: DataFrame) -> DataFrame:
        """The product rows of ``pages`` (url, text, ok, seq).

        Pages are split by binding, each part parsed once, and the parts
        united: there is one branch per parser and options, however many
        domains there are. A page without an address goes to the general parser.
        """
        groups: dict[Binding, list[str]] = {}
        for d, b in self.domains.items():
            groups.setdefault(b, []).append(d)
        own = F.coalesce(url.domain(F.col("url")), F.lit(""))
        parts = [(b, own.isin(ds)) for b, ds in groups.items() if b != self.general]
        taken = [d for b, ds in groups.items() if b != self.general for d in ds]
        parts.append((self.general, ~own.isin(taken) if taken else F.lit(True)))
        return reduce(DataFrame.unionByName, (self._parsed(b, pages.where(test)) for b, test in parts))

    def _parsed(self, binding: Binding, pages: DataFrame) -> DataFrame:
        rows = self.parsers[binding.parser](pages, **dict(binding.options))
        return rows.select(*(F.col(n).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in schemas.PRODUCT.split(", "))))

    def view(self, spark: SparkSession, pages: str, name: str) -> None:
        """A temporary view ``name`` for SQL: the product rows of the table or view ``pages``, parsed when it is asked."""
        self.products(spark.table(pages)).createOrReplaceTempView(name)


def _json(pages: DataFrame, **options: object) -> DataFrame:
    return store_json.store_products(pages, **options)


def product_of(column: str) -> Column:
    """A product column for parsers of users: null in the column's type."""
    kind = dict(f.split(" ", 1) for f in schemas.PRODUCT.split(", "))[column]
    return F.lit(None).cast(kind).alias(column)
