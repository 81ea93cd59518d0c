"""URL expressions: parts, identity, query parameters, page kinds, generated addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import compact_ws, either, has_any, let, name_key

#: Scheme, authority, path, query, fragment: the generic pattern of RFC 3986.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host with its port."""
    return _part(url, 2)


def path(url: Column) -> Column:
    """Without the parameters of the last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return _part(url, 4)


def domain(url: Column) -> Column:
    """The authority in lower case; it keeps the port."""
    return F.lower(authority(url))


def is_http(url: Column) -> Column:
    return F.lower(F.trim(F.coalesce(url, F.lit("")))).rlike("^https?://")


def decoded(c: Column) -> Column:
    """Percent-decoding that leaves malformed text as it is."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def encoded(c: Column) -> Column:
    """Form encoding: letters, digits and ``_.-~`` stay."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(q: Column) -> Column:
    """The decoded (k, v) pairs of a query, in order; blank values stay."""
    parts = F.filter(F.split(q, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))


def normalize_for_id(url: Column) -> Column:
    """The spelling that identifies a page.

    Tracking keys go; where a product id is, keys of groups and cycles go too;
    pairs are sorted. Fragment, path parameters and last slashes go. A route
    at the query's start (``?/cart/...``) stays first, unless a product id is there.
    """
    raw = query(url)
    routed = raw.startswith("/")
    route = F.when(routed, F.substring_index(raw, "&", 1)).otherwise("")
    tail = F.when(routed, F.when(F.contains(raw, F.lit("&")), F.regexp_replace(raw, "^[^&]*&", "")).otherwise("")).otherwise(raw)
    every = pairs(tail)
    product = F.exists(every, lambda p: F.lower(p.k).isin(fixed.PRODUCT_ID_KEYS))
    kept = F.filter(
        every,
        lambda p: ~F.lower(p.k).isin(fixed.TRACKING_KEYS) & ~(p.k.startswith("/") & (p.v == "")) & ~(product & F.lower(p.k).isin(fixed.DROP_IF_PRODUCT_KEYS)),
    )
    text = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encoded(p.k), F.lit("="), encoded(p.v))), "&")
    text = F.when((route != "") & ~product, F.concat_ws("&", route, F.nullif(text, F.lit("")))).otherwise(text)
    base = F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(authority(url) != "", F.concat(F.lit("//"), authority(url))).otherwise(""))
    return F.concat(base, F.regexp_replace(path(url), "/+$", ""), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def param(url: Column, key: str, any_case: bool = False) -> Column:
    """The first non-blank value of a query key, or null."""
    found = F.filter(pairs(query(url)), lambda p: ((F.lower(p.k) if any_case else p.k) == key) & (p.v != ""))
    return F.get(found, F.lit(0)).v


def param_digits(url: Column, key: str) -> Column:
    """The first value of a query key where it has only digits, of any length, without leading zeros."""
    v = F.trim(param(url, key))
    return F.when(v.rlike(r"^\d+$"), F.regexp_replace(v, r"^0+(?=\d)", ""))


def param_int(url: Column, key: str) -> Column:
    """The first value of a query key as a number, where it has only digits; null beyond a long (see ``param_digits``)."""
    return param_digits(url, key).try_cast("long")


def first_param_int(url: Column, keys: list[str]) -> Column:
    return F.coalesce(*(param_int(url, k) for k in keys))


def canonical_key(domain_: Column, url: Column, name: Column, variant: Column) -> Column:
    """The plan that a product row belongs to: by product id, else by page, else by name."""
    parts = F.struct(F.transform(pairs(query(url)), lambda p: F.struct(F.lower(p.k).alias("k"), p.v.alias("v"))).alias("q"), F.lower(path(url)).alias("path"), F.concat(domain_, F.lit("::")).alias("at"))

    def of(u: Column) -> Column:
        first = lambda key: F.get(F.filter(u.q, lambda p: (p.k == key) & (p.v != "")), F.lit(0)).v
        scope = F.array_join(F.slice(F.filter(F.split(u.path, "/"), lambda x: x != ""), 1, 3), "/")
        scoped = F.when(scope != "", F.concat(scope, F.lit("::"))).otherwise("")
        ids = F.array(*(F.struct(F.lit(k).alias("k"), compact_ws(first(k)).alias("v")) for k in ("planid", "product_id", "pid", "id")))
        by_id = let(F.get(F.filter(ids, lambda x: x.v != ""), F.lit(0)), lambda x: F.concat(u.at, scoped, x.k, F.lit(":"), x.v))
        rp = F.lower(compact_ws(first("rp")))
        store = rp.startswith("/store/") & (F.size(F.filter(F.split(rp, "/"), lambda x: x != "")) >= 3)
        bare = F.btrim(u.path, F.lit("/"))
        n, v = name_key(name), name_key(variant)
        by_url = F.concat(u.at, F.lit("url:"), normalize_for_id(url))
        by_name = F.when((v != "") & (n != ""), F.concat(u.at, F.lit("name:"), v, F.lit(":"), n)).when(n != "", F.concat(u.at, F.lit("name:"), n))
        return F.coalesce(by_id, F.when(~store & bare.isin("", "cart.php", "index.php"), by_name), by_url)

    return let(parts, of)


def _any_in(c: Column, *words: str) -> Column:
    return has_any(c, list(words))


def non_product_page(url: Column) -> Column:
    """Pages that sell nothing. Rules are tried in order; links that add or configure an id are products."""
    low = F.lower(F.coalesce(url, F.lit("")))
    p, q = F.lower(path(url)), F.lower(query(url))
    bare = F.regexp_replace(p, "/+$", "")
    ids = ("pid=", "id=", "product=", "product_id=")
    adds = _any_in(q, "action=add", "a=add")
    tail = F.btrim(F.substring_index(F.regexp_extract(low, r"(?s)\?/cart/(.*)$", 1), "&", 1), F.lit("/"))
    return (
        F.when((adds | F.contains(q, F.lit("a=configure"))) & _any_in(q, *ids), False)
        .when(F.contains(p, F.lit("cart.php")) & _any_in(q, "pid=", "product_id="), False)
        .when(bare.isin("/cart", "/products", "/store") & ~_any_in(q, "a=add", "pid=", "id=", "product=", "gid=", "fid="), True)
        .when(F.contains(p, F.lit("/products/cart/")) & ~_any_in(q, "a=add", "action=add", "pid=", "id=", "product="), True)
        .when(F.contains(low, F.lit("?/cart/")) & ~F.contains(tail, F.lit("/")) & ~_any_in(q, "a=add", "pid=", "id=", "product="), True)
        .when(F.contains(low, F.lit("index.php?/products/")) & ~_any_in(q, "a=add", "action=add", "pid=", "id=", "product="), True)
        .when(F.contains(q, F.lit("a=view")) & F.contains(p, F.lit("cart.php")), True)
        .when(F.contains(p, F.lit("cart.php")) & F.contains(q, F.lit("a=add")) & ~_any_in(q, *ids), True)
        .when(_any_in(q, "domain=register", "domain=transfer"), True)
        .when(has_any(p, fixed.NON_PRODUCT_FRAGMENTS), True)
        .otherwise(_any_in(q, "rp=/announcements", "rp=/knowledgebase"))
    )


def _has_key(url: Column, keys: list[str], value: str | None = None) -> Column:
    """Whether the query gives one of the keys a value, or this one (in lower case, the first of its key)."""
    if value is None:
        return F.exists(pairs(query(url)), lambda p: p.k.isin(keys) & (p.v != ""))
    return F.coalesce(F.lower(param(url, keys[0])) == value, F.lit(False))


def non_product_link(url: Column) -> Column:
    """Links of cards that lead to no single product: listings by route, path or cart, and pages that sell nothing. Rules are tried in order."""
    low, p = F.lower(F.coalesce(url, F.lit(""))), F.lower(path(url))
    marks = _any_in(low, "action=add", "pid=", "id=", "product=")
    adds = _has_key(url, ["pid", "id", "product", "fid", "gid"]) | _has_key(url, ["a"], "add") | _has_key(url, ["a"], "configure") | _has_key(url, ["action"], "add")
    routed = F.contains(low, F.lit("?/cart/"))
    tail = F.btrim(F.substring_index(F.regexp_extract(low, r"(?s)\?/cart/(.*)$", 1), "&", 1), F.lit("/"))
    rp = param(url, "rp")
    parts = lambda marker: F.filter(F.split(F.substr(p, F.instr(p, F.lit(marker)) + len(marker)), "/"), lambda x: x != "")
    sized = lambda c: F.size(F.filter(F.split(c, "/"), lambda x: x != ""))
    return (
        F.when(routed & marks, False)
        .when(routed & ~F.contains(tail, F.lit("/")), True)
        .when(F.lower(rp).startswith("/knowledgebase") | F.lower(rp).startswith("/announcements"), True)
        .when(rp.startswith("/store/"), sized(rp) <= 2)
        .when(has_any(p, fixed.CARD_NO_PRODUCT_PATHS), True)
        .when(F.contains(p, F.lit("/customer/plans")) & ~_has_key(url, ["pid", "id", "product", "product_id", "plan_id", "planid"]), True)
        .when(F.contains(p, F.lit("/products/cart/")) | F.regexp_replace(p, "/+$", "").isin("/cart", "/products", "/store"), ~adds)
        .when(F.contains(low, F.lit("index.php?/products/")), ~marks)
        .when(F.contains(p, F.lit("/products/")), let(parts("/products/"), lambda x: ~F.coalesce(F.try_element_at(x, F.lit(-1)).isin("checkout", "configure"), F.lit(False)) & (F.size(x) <= 1)))
        .when(F.contains(p, F.lit("/store/")), F.size(parts("/store/")) <= 1)
        .when(p.endswith("/cart.php"), ~(_has_key(url, ["pid"]) | _has_key(url, ["a"], "add")))
        .when(F.contains(p, F.lit("/cart/")), (F.size(parts("/cart/")) <= 1) & ~marks)
        .otherwise(False)
    )


def resolve(base: Column, href: Column) -> Column:
    """The address that a link leads to; the usual cart and store addresses start at the site's root. Dot segments are carried out."""
    h, low = F.trim(href), F.lower(F.trim(href))
    own = F.regexp_extract(h, "^[^?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(base), "^.*/", 0), F.lit("")), F.lit("/"))
    rooted = reduce(lambda a, b: a | b, (low.startswith(x) for x in fixed.ROOTED))
    at = F.when(own == "", path(base)).when(own.startswith("/"), own).when(rooted, F.concat(F.lit("/"), own)).otherwise(F.concat(folder, own))
    step = lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x))
    plain = F.when(at.rlike(r"/\.\.?(/|$)"), F.concat(F.aggregate(F.slice(F.split(at, "/"), 2, F.size(F.split(at, "/"))), F.lit(""), step), F.when(at.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(at)
    rest = F.substr(h, F.char_length(own) + 1)
    kept = F.when((own == "") & h.startswith("#") & (query(base) != ""), F.concat(F.lit("?"), query(base))).otherwise("")
    return F.when(h == "", base).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h)).otherwise(F.concat(root(base), plain, kept, rest))


def buy_score(url: Column, label: Column, product: Column) -> Column:
    """How likely a link of a card buys its product; ``product``: whether it leads to one (see ``non_product_link``)."""
    u, lab = F.lower(url), F.lower(compact_ws(label))
    worth = lambda test, n: F.when(test, n).otherwise(0)
    has = lambda w: F.contains(u, F.lit(w))
    cart = F.when(~has("cart.php"), 0).when(has("a=add") | (has("pid=") & ~has("a=view")), 7).when(has("a=view") & has("pid="), 3).otherwise(0)
    return (
        cart + worth(has("/checkout"), 7) + worth(has("action=add") & (has("id=") | has("pid=")), 7) + worth(has("action=add") & has("id="), 2) + worth(has("/store/") & product, 4)
        + worth(has("/products/") & product, 3) + worth(has_any(u, fixed.LINK_HINTS), 1) + worth(has_any(lab, fixed.BUY_LABELS), 2)
    )


def product_link_key(url: Column, product: Column) -> Column:
    """The identity of a link that can buy or show one product; null for other links."""
    u = F.lower(url)
    has = lambda w: F.contains(u, F.lit(w))
    buys = (has("cart.php") & (has("pid=") | has("a=add"))) | (has("action=add") & (has("id=") | has("pid="))) | has("/checkout") | has("/store/") | has("/products/")
    return F.when(buys & product, normalize_for_id(url))


def with_params(url: Column, params: Column) -> Column:
    """The URL with more pairs (an array of k and v) at its query's end, form-encoded anew; a route at its start stays."""
    q = query(url)
    routed = q.startswith("/")
    tail = F.when(routed, F.when(F.contains(q, F.lit("&")), F.regexp_replace(q, "^[^&]*&", "")).otherwise("")).otherwise(q)
    text = F.array_join(F.transform(F.concat(pairs(tail), params), lambda p: F.concat(encoded(p.k), F.lit("="), encoded(p.v))), "&")
    text = F.when(routed, F.concat_ws("&", F.substring_index(q, "&", 1), F.nullif(text, F.lit("")))).otherwise(text)
    return F.concat(root(url), path(url), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def primary_listing(url: Column) -> Column:
    """Pages that list a shop's products."""
    p, q = F.lower(path(url)), F.lower(query(url))
    cart, store = F.endswith(p, F.lit("/cart.php")), F.endswith(p, F.lit("/store"))
    slashes = F.char_length(p) - F.char_length(F.replace(p, F.lit("/"), F.lit("")))
    rp = F.contains(q, F.lit("rp=/store"))
    return (rp & ~F.contains(q, F.lit("rp=/store/"))) | (cart & ~_any_in(q, "pid=", "a=add")) | (store & (slashes <= 1)) | (F.contains(p, F.lit("/billing/")) & (rp | cart | store))


def solver_allowed(url: Column) -> Column:
    """Pages worth a costly fetch: listings, interfaces and price lists, not single products or groups."""
    low, p, q = F.lower(F.coalesce(url, F.lit(""))), F.lower(path(url)), F.lower(query(url))
    tail = F.btrim(F.substring_index(F.regexp_extract(low, r"(?s)\?/cart/(.*)$", 1), "&", 1), F.lit("/"))
    slashes = F.char_length(tail) - F.char_length(F.replace(tail, F.lit("/"), F.lit("")))
    return (
        F.when(primary_listing(url), True)
        .when(F.contains(low, F.lit("/api/")) | low.startswith("https://api.") | F.contains(low, F.lit("getvpsstore")), True)
        .when(F.contains(low, F.lit("/pages/pricing")) | F.endswith(low, F.lit("/pricing")), True)
        .when(F.contains(low, F.lit("?/cart/")), slashes <= 1)
        .when(F.regexp_replace(p, "/+$", "").isin("/cart", "/products", "/store"), True)
        .when(F.endswith(p, F.lit("/cart.php")), ~_any_in(q, "a=add", "pid=", "gid=", "fid=", "cat_id="))
        .otherwise(False)
    )


def platform_of(urls: Column) -> Column:
    """hostbill if any URL of the array has one of its marks, else whmcs likewise, else empty."""
    low = F.transform(urls, lambda u: F.lower(compact_ws(u)))
    return F.when(F.exists(low, lambda u: has_any(u, fixed.HOSTBILL_URL_MARKERS)), "hostbill").when(F.exists(low, lambda u: has_any(u, fixed.WHMCS_URL_MARKERS)), "whmcs").otherwise("")


def root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def entry_points(url: Column) -> Column:
    """The usual listing addresses of a shop, in order."""
    clients = F.when(F.contains(F.lower(path(url)), F.lit("/clients")), F.array(*map(F.lit, fixed.CLIENT_ENTRY_PATHS))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(F.array(*map(F.lit, fixed.ENTRY_PATHS)), clients), lambda p: F.concat(root(url), p))


def scan_prefixes(url: Column) -> Column:
    p = F.lower(path(url))
    return F.array_compact(F.array(F.lit(""), F.when(F.contains(p, F.lit("/billing")), "/billing"), F.when(F.contains(p, F.lit("/clients")), "/clients")))


def pid_templates(url: Column) -> Column:
    return F.transform(scan_prefixes(url), lambda p: F.concat(root(url), p, F.lit("/cart.php?a=add&pid={pid}")))


def gid_templates(url: Column) -> Column:
    return F.transform(scan_prefixes(url), lambda p: F.concat(root(url), p, F.lit("/cart.php?gid={gid}")))


def _distinct_by(urls: Column) -> Column:
    """First of each spelling, white space and case aside."""
    key = lambda u: F.lower(compact_ws(u))
    keys = F.transform(urls, key)
    return F.filter(urls, lambda u, i: (key(u) != "") & (F.array_position(keys, key(u)) == i + 1))


def hostbill_routes(url: Column, seeds: Column) -> Column:
    """Cart routes of a shop: the usual ones under each prefix, and those that seed URLs of the same host show."""
    usual = F.flatten(F.transform(scan_prefixes(url), lambda p: F.array(F.concat(root(url), p, F.lit("/index.php?/cart/")), F.concat(root(url), p, F.lit("/cart/")))))
    same = F.filter(F.concat(F.array(url), F.coalesce(seeds, F.array().cast("array<string>"))), lambda u: domain(u) == domain(url))

    def of(u: Column) -> Column:
        base = F.concat(root(u), path(u))
        return F.array_compact(F.array(F.when(query(u).startswith("/cart/"), F.concat(base, F.lit("?"), F.substring_index(query(u), "&", 1))), F.when(F.contains(F.lower(path(u)), F.lit("/cart/")), base)))

    return _distinct_by(F.concat(usual, F.flatten(F.transform(same, of))))


def _joined(u: Column, tail: str) -> Column:
    return F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit(tail))


def hostbill_product_templates(url: Column, seeds: Column) -> Column:
    """Addresses that add product ``{id}`` to a cart."""
    usual = F.flatten(F.transform(scan_prefixes(url), lambda p: F.array(*(F.concat(root(url), p, F.lit(x)) for x in ("/cart.php?action=add&id={id}", "/cart?action=add&id={id}", "/index.php?/cart/&action=add&id={id}")))))
    routes = F.transform(hostbill_routes(url, seeds), lambda r: _joined(r, "action=add&id={id}"))
    adds = lambda u: F.contains(F.lower(u), F.lit("action=add"))
    seen = F.transform(
        F.coalesce(seeds, F.array().cast("array<string>")),
        lambda u: F.when(~adds(u) & param_int(u, "cat_id").isNotNull(), _joined(u, "action=add&id={id}")).when(adds(u) & param_int(u, "id").isNotNull(), F.regexp_replace(u, r"(?i)([?&]id=)\d+", "$1{id}")),
    )
    return _distinct_by(F.concat(usual, routes, F.array_compact(seen)))


def hostbill_group_templates(url: Column, seeds: Column) -> Column:
    """Addresses that list group ``{fid}``."""
    tails = [f"{at}{key}={{fid}}" for key in ("fid", "cat_id") for at in ("/cart.php?", "/cart?", "/index.php?/cart/&")]
    usual = F.flatten(F.transform(scan_prefixes(url), lambda p: F.array(*(F.concat(root(url), p, F.lit(t)) for t in tails))))
    routes = F.flatten(F.transform(hostbill_routes(url, seeds), lambda r: F.array(_joined(r, "fid={fid}"), _joined(r, "cat_id={fid}"))))
    return _distinct_by(F.concat(usual, routes))


def append_query(url: Column, tail: Column) -> Column:
    """More query at the end, behind a route if there is one; the fragment goes."""
    base = F.substring_index(url, "#", 1)
    return F.concat(base, F.when(F.contains(base, F.lit("?")), F.when(base.rlike("[?&]$"), "").otherwise("&")).otherwise("?"), tail)


def onclick_url(c: Column) -> Column:
    """The first quoted token of a handler that looks like an address."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("['\"]([^'\"]+)['\"]"), 1)
    return F.get(F.filter(tokens, lambda t: t.rlike(r"^(https?://|/)|\.php|\?")), F.lit(0))


def id_candidates(html: Column, keys: list[str]) -> Column:
    """Distinct numbers that stand behind the given keys in links, sorted."""
    found = F.regexp_extract_all(F.replace(F.coalesce(html, F.lit("")), F.lit("&amp;"), F.lit("&")), F.lit(rf"(?i)[?&](?:{either(keys)})=(\d{{1,18}})\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("long"))))


def mentions_id(html: Column, probe: Column, keys: list[str]) -> Column:
    """Whether a page links to an id or holds it as a form value."""
    raw, p = F.coalesce(html, F.lit("")), probe.cast("string")
    tests = [F.rlike(raw, F.concat(F.lit(rf"(?i)(?:[?&]|&amp;){k}="), p, F.lit(r"\b"))) | F.rlike(raw, F.concat(F.lit(rf"(?i)name=['\"]{k}['\"][^>]*value=['\"]"), p, F.lit("['\"]"))) for k in keys]
    return (probe >= 0) & reduce(lambda a, b: a | b, tests)


def blocked_fetch(error: Column, status: Column) -> Column:
    """Fetches that an edge server has blocked."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return has_any(e, ["blocked", "cloudflare", "challenge"]) | F.coalesce(status.isin(fixed.BLOCKED_STATUS), F.lit(False))


def should_retry(status: Column) -> Column:
    return F.coalesce(status.isin(fixed.RETRY_STATUS) | status.between(500, 599), F.lit(False))


