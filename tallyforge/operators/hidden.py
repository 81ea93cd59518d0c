"""Hidden ids: products and groups that no page links to, found by probing one id after another.

A probe's answers come from a source, one table per round: ids that a scan no
longer reaches are never asked for. Each scan stops for itself, by streaks that
its state carries from round to round, so rounds can have any size without
changing a result: what lies behind the id that stops a scan never counts.

A scan's history is at most as long as the largest id that may be probed, which
bounds what one task orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url
from ..functions.text import page_signature
from . import filters

#: A product that an answer shows.
FOUND = "struct<id:string,url:string,name:string,price:string,available:boolean>"
#: An answer to a probe. kind: product or group; nr: the place of its address among those of the id; url: where it ended;
#: products: what the domain's parser found; page_available, page_name: what the page as a whole tells.
ANSWER = f"domain string, platform string, kind string, id bigint, nr int, asked string, url string, ok boolean, text string, products array<{FOUND}>, page_available boolean, page_name string"
#: Query keys of ids (fixed values): of a product's link, and by platform those of products in markup, of links to products, and of groups.
PRODUCT_KEYS = ["id", "pid", "product_id", "planid"]
MARKUP_KEYS = {"whmcs": ["pid", "id", "product_id"], "hostbill": ["id", "pid", "product_id"]}
GROUP_KEYS = {"whmcs": ["gid"], "hostbill": ["fid", "cat_id"]}


@dataclass(frozen=True)
class Limits:
    """After how many probes in a row a scan stops (0: never); the largest ids; and what is known ids' worth."""

    no_info: int = 150
    no_info_seeded: int = 200
    same_page: int = 100
    product_no_progress: int = 300
    group_no_progress: int = 300
    product_duplicates: int = 150
    group_duplicates: int = 150
    redirects: int = 120
    least: int = 0
    most_product: int = 5000
    most_group: int = 5000
    most_candidates: int = 1000
    backtrack: int = 120


def _by_platform(of: Callable[[str], Column]) -> Column:
    return F.when(F.col("platform") == "hostbill", of("hostbill")).otherwise(of("whmcs"))


def judge(answers: DataFrame) -> DataFrame:
    """One row per (domain, kind, id) of ANSWER rows: evidence, products, extra (ids that its page links to), signature, redirect.

    The first answer that shows products or looks like a page of its kind
    decides. An answer that ended at another id says nothing, neither does a
    product's that dropped the id and doesn't mention it, unless it looks like
    an order page. Without a deciding answer there is no evidence, and the
    first page's signature and the first address that lost the id are told.
    """
    c = F.col
    product, probe = c("kind") == "product", c("id")
    usable = F.coalesce("ok", F.lit(False)) & (F.coalesce("text", F.lit("")) != "")
    got = F.when(product, _by_platform(lambda p: url.param_digits(c("url"), MARKUP_KEYS[p][0]))).otherwise(_by_platform(lambda p: F.coalesce(*(url.param_digits(c("url"), k) for k in GROUP_KEYS[p]))))
    a = answers.where(usable).withColumns({"got": got, "own": F.concat("domain", F.lit("::"), url.normalize_for_id(c("asked")))})
    other = F.coalesce(c("got") != probe.cast("string"), F.lit(False))
    at = F.regexp_replace(url.path(c("url")), "/+$", "")
    away = F.lower(F.concat(url.root(c("url")), F.when(at == "", "/").otherwise(at)))
    page = F.when(product, _by_platform(lambda p: filters.whmcs_product_page(c("text")) if p == "whmcs" else filters.hostbill_product_page(c("text")))).otherwise(
        _by_platform(lambda p: filters.whmcs_group_page(c("text")) if p == "whmcs" else filters.hostbill_group_page(c("text")))
    )
    a = a.withColumns(
        {
            "other": other,
            "redirect": F.when(c("got").isNull() | other, away),
            "signature": F.when(~product, page_signature(c("url"), c("text"))),
            "mentioned": ~product | _by_platform(lambda p: url.mentions_id(c("text"), probe, MARKUP_KEYS[p])),
            "page": page,
            "extra": F.when(~product, _by_platform(lambda p: url.id_candidates(c("text"), MARKUP_KEYS[p]))),
        }
    )
    shop = c("platform") != "hostbill"
    lost = product & shop & c("got").isNull() & ~c("mentioned") & ~c("page")
    evidence = F.when(product & shop & ~c("mentioned"), False).otherwise(c("page")) | F.coalesce(F.size("extra") > 0, F.lit(False))
    same = F.filter("products", lambda x: filters.probe_matches(x.url, probe, PRODUCT_KEYS))
    one = F.transform("products", lambda x: x.withField("url", c("asked")).withField("id", c("own")))
    matched = F.when(~product, c("products")).when(F.size(same) > 0, same).when(F.size("products") == 1, one)
    matched = F.transform(F.coalesce(matched, F.array().cast(f"array<{FOUND}>")), lambda x: x.withField("available", F.coalesce("page_available", x.available)))
    a = a.withColumns({"matched": matched, "evidence": evidence})
    named = F.struct(c("own").alias("id"), c("asked").alias("url"), c("page_name").alias("name"), F.lit(None).cast("string").alias("price"), F.coalesce("page_available", F.lit(False)).alias("available"))
    shown = F.when(F.size("matched") > 0, c("matched")).when(product & c("evidence") & (F.coalesce("page_name", F.lit("")) != ""), F.array(named.cast(FOUND))).otherwise(c("matched"))
    decides = ~c("other") & ~lost & ((F.size("matched") > 0) | c("evidence"))
    a = a.withColumns({"shown": shown, "place": F.when(decides, c("nr"))})
    per = a.groupBy("domain", "kind", "id").agg(
        F.min_by(F.struct("shown", "extra", "signature"), "place").alias("won"),
        F.min_by("signature", "nr").alias("page"),
        F.min_by("redirect", F.when(c("redirect").isNotNull(), c("nr"))).alias("away"),
    )
    has = c("won").isNotNull()
    return per.select(
        "domain", "kind", "id", has.alias("evidence"), F.coalesce("won.shown", F.array().cast(f"array<{FOUND}>")).alias("products"), F.coalesce("won.extra", F.array().cast("array<bigint>")).alias("extra"),
        F.when(has, c("won.signature")).otherwise(c("page")).alias("signature"), F.when(~has, c("away")).alias("redirect"),
    )


def captured(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Answers of a table as a source: ``judge`` of those that a round asks for."""
    return lambda wanted: judge(answers.join(wanted.select("domain", "kind", "id"), ["domain", "kind", "id"], "left_semi"))


def scan_targets(targets: DataFrame, products: DataFrame) -> DataFrame:
    """Scans of targets (domain, base_url, platform, seeds: addresses known of them): the addresses that a product may have, and ids known beforehand.

    Known are the ids in the addresses of the domain's ``products`` and of its
    seeds, of each address the first key that has one. Targets of no platform
    have no scan.
    """
    c = F.col
    t = targets.where(c("platform").isin("whmcs", "hostbill")).select("domain", "base_url", "platform", F.coalesce("seeds", F.array().cast("array<string>")).alias("seeds"))
    seeds = F.transform("seeds", lambda u: url.resolve(c("base_url"), u))
    ids = lambda keys: lambda p: F.array_compact(F.transform("seeds", lambda u: url.first_param_int(u, keys[p])))
    whmcs = F.transform(url.pid_templates(c("base_url")), lambda x: F.replace(x, F.lit("{pid}"), F.lit("{id}")))
    t = t.withColumn("seeds", seeds).withColumns({"templates": F.when(c("platform") == "hostbill", url.hostbill_product_templates(c("base_url"), c("seeds"))).otherwise(whmcs), "of_seeds": _by_platform(ids(MARKUP_KEYS)), "seed_groups": F.array_distinct(_by_platform(ids(GROUP_KEYS)))})
    own = products.join(t.select("domain", "platform"), "domain").select("domain", _by_platform(lambda p: url.first_param_int(c("url"), MARKUP_KEYS[p])).alias("k")).where("k is not null")
    own = own.groupBy("domain").agg(F.collect_set("k").alias("of_products"))
    none = F.array().cast("array<bigint>")
    return t.join(own, "domain", "left").select("domain", "platform", "templates", F.array_sort(F.array_distinct(F.concat("of_seeds", F.coalesce("of_products", none)))).alias("seed_products"), "seed_groups")


@dataclass
class Scan:
    """probes: one row per probe (domain, phase, kind, id, evidence, duplicate, added, candidates, products); stops: (domain, kind, reason) of the two long scans."""

    probes: DataFrame
    stops: DataFrame

    def products(self) -> DataFrame:
        """(domain, id, url, name, price, available): the last sight of each product that a probe has added or seen again with news."""
        seen = self.probes.where("evidence and not duplicate").select("domain", F.struct("phase", F.col("id").alias("nr")).alias("at"), F.posexplode("products").alias("i", "p"))
        return seen.groupBy("domain", F.col("p.id").alias("product")).agg(F.max_by("p", F.struct("at", "i")).alias("p")).select("domain", "p.*")


def scan_hidden_ids(
    scans: DataFrame, source: Callable[[DataFrame], DataFrame], existing: DataFrame, *, limits: Limits = Limits(), batch: int = 1024, groups: bool = True, settle: Callable[[DataFrame], DataFrame] | None = None
) -> Scan:
    """Probe the ids of each domain.

    ``scans``: domain (one row each), platform, templates (addresses with
    ``{id}`` that a product may have), seed_products, seed_groups (ids known
    beforehand). ``existing``: (domain, id) of known products. ``source`` gives
    the judged answers to (domain, platform, kind, id).

    Known groups come first, then all groups from 0; the products that their
    pages link to, in order and up to a limit; the known product ids; and then
    all products, from a little below the smallest known one, without those
    already probed. A probe is a duplicate if all it shows was known before it;
    one that shows no product but other ids, if their addresses all were.

    The long scans stop after so many probes in a row without evidence
    (no_info), with one and the same page (same_page), without new ids
    (no_progress), with duplicates (duplicates) or with one redirect
    (redirects), else at their largest id (exhausted).

    Per round there are a few joins by domain and id or key. ``settle`` writes
    a round's table and reads it back; by default it is a reliable checkpoint.
    """
    settle = settle or (lambda df: df.checkpoint())
    c, spark = F.col, scans.sparkSession
    scans = settle(scans.select("domain", "platform", *(F.coalesce(x, F.array().cast(f"array<{t}>")).alias(x) for x, t in (("templates", "string"), ("seed_products", "bigint"), ("seed_groups", "bigint")))))
    known = settle(existing.select("domain", F.lit("id").alias("space"), c("id").alias("key")).distinct())
    probes: list[DataFrame] = []
    stops: list[DataFrame] = []

    def probed(wanted: DataFrame) -> DataFrame:
        """The probes of ``wanted`` (domain, platform, kind, id, templates, ...) with what they show that is new, in the order of their ids."""
        rows = wanted.join(source(wanted), ["domain", "kind", "id"], "left")
        rows = rows.withColumns({"evidence": F.coalesce("evidence", F.lit(False)), "products": F.coalesce("products", F.array().cast(f"array<{FOUND}>")), "extra": F.coalesce("extra", F.array().cast("array<bigint>"))})
        rows = settle(rows)
        address = lambda t, x: F.concat("domain", F.lit("::"), url.normalize_for_id(F.replace(t, F.lit("{id}"), x.cast("string"))))
        linked = F.when(F.size("products") == 0, F.flatten(F.transform("extra", lambda x: F.transform("templates", lambda t: address(t, x)))))
        item = lambda what, space: lambda x: F.struct(F.lit(what).alias("what"), F.lit(space).alias("space"), x.cast("string").alias("key"))
        items = F.concat(F.transform("products", lambda x: item("shown", "id")(x.id)), F.transform(F.coalesce(linked, F.array().cast("array<string>")), item("linked", "id")), F.transform("extra", item("candidate", "extra")))
        items = rows.select("domain", "id", F.explode(F.array_distinct(items)).alias("i")).select("domain", "id", "i.*")
        first = F.min(F.when(c("what") != "linked", c("id"))).over(Window.partitionBy("domain", "space", "key"))
        before = items.withColumn("first", first).join(known.withColumn("had", F.lit(True)), ["domain", "space", "key"], "left")
        old = c("had").isNotNull() | F.coalesce(c("first") < c("id"), F.lit(False))
        count = lambda what, which: F.count_if((c("what") == what) & which)
        told = before.groupBy("domain", "id").agg(count("shown", old).alias("shown_old"), count("shown", ~old).alias("shown_new"), count("linked", ~old).alias("linked_new"), count("linked", old).alias("linked_old"), count("candidate", ~old).alias("candidates"))
        rows = rows.join(told, ["domain", "id"], "left").fillna(0, ["shown_old", "shown_new", "linked_new", "linked_old", "candidates"])
        bare = (c("shown_old") + c("shown_new")) == 0
        duplicate = c("evidence") & F.when(bare, (c("linked_old") > 0) & (c("linked_new") == 0)).otherwise(c("shown_new") == 0)
        return rows.withColumn("duplicate", duplicate).withColumn("added", F.when(c("evidence") & ~duplicate, c("shown_new")).otherwise(0))

    def learnt(rows: DataFrame, phase: int) -> None:
        nonlocal known
        probes.append(rows.select("domain", F.lit(phase).alias("phase"), "kind", "id", "evidence", "duplicate", "added", "candidates", "products"))
        shown = rows.where("evidence and not duplicate").select("domain", F.lit("id").alias("space"), F.explode(F.transform("products", lambda x: x.id)).alias("key"))
        linked = rows.select("domain", F.lit("extra").alias("space"), F.explode(F.transform("extra", lambda x: x.cast("string"))).alias("key"))
        known = settle(known.unionByName(shown).unionByName(linked).distinct())

    def listed(kind: str, ids: DataFrame, phase: int) -> None:
        """Probe given ids (domain, id): all of them."""
        if not ids.isEmpty():
            learnt(settle(probed(ids.join(scans, "domain").select("domain", "platform", "templates", F.lit(kind).alias("kind"), "id"))), phase)

    def every(kind: str, start: DataFrame, without: DataFrame | None, phase: int) -> None:
        """Probe all ids from a start on (domain, next, no_info) until a streak is too long."""
        product = kind == "product"
        most = limits.most_product if product else limits.most_group
        rules = {
            "no_info": c("no_info") if product else F.lit(0), "same_page": F.lit(0 if product else limits.same_page), "no_progress": F.lit(limits.product_no_progress if product else limits.group_no_progress),
            "duplicates": F.lit(limits.product_duplicates if product else limits.group_duplicates), "redirects": F.lit(limits.redirects),
        }
        zero = F.struct(*(F.lit(0).cast("bigint").alias(r) for r in rules), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("redirect"))
        state = settle(start.select("domain", "next", "no_info", zero.alias("s"), F.lit(None).cast("string").alias("reason")))
        while not (running := state.where(c("reason").isNull() & (c("next") <= most))).isEmpty():
            ids = running.withColumn("id", F.explode(F.sequence(c("next"), F.least(c("next") + batch - 1, F.lit(most)))))
            ids = ids.join(scans, "domain").select("domain", "platform", "templates", F.lit(kind).alias("kind"), "id", "s", "no_info")
            if without is not None:
                ids = ids.join(without, ["domain", "id"], "left_anti")
            rows = settle(_streaks(probed(ids), rules, product, limits.least))
            learnt(rows.where("stop is null"), phase)
            ends = rows.groupBy("domain").agg(F.max_by("after", F.when(c("stop").isNull(), c("id"))).alias("after"), F.min_by("stop", F.when(c("stop").isNotNull(), c("id"))).alias("stop"))
            state = settle(state.join(ends, "domain", "left").select("domain", F.when(c("reason").isNull(), c("next") + batch).otherwise(c("next")).alias("next"), "no_info", F.coalesce("after", "s").alias("s"), F.coalesce("reason", "stop").alias("reason")))
        stops.append(state.select("domain", F.lit(kind).alias("kind"), F.coalesce("reason", F.lit("exhausted")).alias("reason")))

    seeds = settle(scans.select("domain", F.explode(F.array_distinct("seed_products")).alias("id")).where("id >= 0"))
    if groups:
        listed("group", scans.select("domain", F.explode(F.array_distinct("seed_groups")).alias("id")).where("id >= 0"), 1)
        every("group", scans.select("domain", F.lit(0).cast("bigint").alias("next"), F.lit(0).alias("no_info")), None, 2)
        linked = known.where("space = 'extra'").select("domain", c("key").cast("bigint").alias("id"))
        if limits.most_candidates > 0:
            linked = linked.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("id"))).where(c("n") <= limits.most_candidates).drop("n")
        linked = settle(linked)
        listed("product", linked, 3)
        rest = seeds.join(linked, ["domain", "id"], "left_anti")
        listed("product", rest, 4)
        without = settle(linked.unionByName(seeds).distinct())
    else:
        listed("product", seeds, 4)
        without = seeds
    least = seeds.groupBy("domain").agg(F.min("id").alias("least"))
    seeded = limits.no_info if limits.no_info >= limits.no_info_seeded else limits.no_info_seeded
    start = scans.join(least, "domain", "left").select("domain", F.greatest(F.coalesce(c("least") - limits.backtrack, F.lit(0)), F.lit(0)).cast("bigint").alias("next"), F.when(c("least").isNotNull(), seeded).otherwise(limits.no_info).alias("no_info"))
    every("product", start, without, 5)
    return Scan(reduce(DataFrame.unionByName, probes), reduce(DataFrame.unionByName, stops))


def _streaks(rows: DataFrame, rules: dict[str, Column], product: bool, least: int) -> DataFrame:
    """``rows`` with their scan's state ``after`` each probe, and ``stop``: why the scan ends before it, null for probes that count.

    ``s`` is the state that the scan came with.
    """
    c = F.col
    order = Window.partitionBy("domain").orderBy("id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(order))

    def since(reset: Column, carried: str) -> Column:
        """Rows since the last one that resets, or since before."""
        return F.coalesce(c("n") - F.max(F.when(reset, c("n"))).over(upto), c("n") + c(f"s.{carried}"))

    last = F.coalesce(F.last("signature", ignorenulls=True).over(before), c("s.signature"))
    rows = rows.withColumns(
        {
            "turned": c("signature").isNotNull() & ~last.eqNullSafe(c("signature")),
            "pages": F.count("signature").over(upto),
            "moved": c("redirect").isNotNull() & ~F.when(c("n") == 1, c("s.redirect")).otherwise(F.lag("redirect").over(order)).eqNullSafe(c("redirect")),
            "progress": (c("added") > 0) | (F.lit(not product) & (c("candidates") > 0)),
        }
    )
    turn, move = F.max(F.when(c("turned"), c("pages"))).over(upto), F.max(F.when(c("moved"), c("n"))).over(upto)
    streaks = {
        "no_info": since(c("evidence"), "no_info"),
        "same_page": F.coalesce(c("pages") - turn + 1, c("pages") + c("s.same_page")),
        "no_progress": since(c("progress"), "no_progress"),
        "duplicates": since(~(c("evidence") & c("duplicate")), "duplicates"),
        "redirects": F.when(c("redirect").isNull(), 0).otherwise(F.coalesce(c("n") - move + 1, c("n") + c("s.redirects"))),
    }
    after = F.struct(*(v.cast("bigint").alias(k) for k, v in streaks.items()), F.coalesce(F.last("signature", ignorenulls=True).over(upto), c("s.signature")).alias("signature"), c("redirect"))
    rows = rows.withColumn("after", after)
    came = F.coalesce(F.lag("after").over(order), c("s"))
    rows = rows.withColumn("came", came)
    full = [F.when((limit > 0) & (c(f"came.{k}") >= limit), F.lit(k)) for k, limit in rules.items()]
    rows = rows.withColumn("full", F.when(c("id") > least, F.coalesce(*full)))
    return rows.withColumn("stop", F.first("full", ignorenulls=True).over(upto)).drop("turned", "pages", "moved", "progress", "came", "full", "n")
