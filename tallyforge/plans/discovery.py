"""Queries over captured pages of shops: hidden ids, links, crawls, listings, enrichment; each with its SQL.

Sites, addresses and answers are made from the page table, so that all of its
pages take part; SQL knows what each shape must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url
from ..operators import discover, enrich, hidden
from ..sources import listing
from ..tables import settled
from .catalogue import table

QUERIES: dict[str, tuple] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


# --- hidden ids --------------------------------------------------------------

#: A site has so many pages in turn: answers to groups, then to products.
SITE, SITE_GROUPS = 60, 20
#: Small limits, so that scans of one site end for each of the reasons.
LIMITS = hidden.Limits(no_info=4, no_info_seeded=5, same_page=3, product_no_progress=9, group_no_progress=5, product_duplicates=3, group_duplicates=3, redirects=3, least=2, most_product=45, most_group=24, most_candidates=6, backtrack=3)


def _shops(spark, sf) -> DataFrame:
    """Pages as answers of shops: site t, place n in it, and the shape of the answer."""
    c = F.col
    p = table(spark, sf, "pages").select("page_id", "html", F.floor(c("page_id") / SITE).alias("t"), (c("page_id") % SITE).alias("n"))
    p = p.withColumns({"domain": F.concat(F.lit("shop"), c("t").cast("string"), F.lit(".test")), "kind": F.when(c("n") < SITE_GROUPS, "group").otherwise("product"), "id": F.when(c("n") < SITE_GROUPS, c("n")).otherwise(c("n") - SITE_GROUPS)})
    p = p.withColumn("platform", F.when(c("t") % 3 == 2, "hostbill").otherwise("whmcs"))
    return p.withColumn("shape", F.when(c("kind") == "group", F.floor((c("id") + c("t")) / (c("t") % 4 + 2)) % 5).otherwise(F.floor((c("id") + 3 * c("t")) / (c("t") % 5 + 1)) % 8))


def shop_answers(spark, sf) -> DataFrame:
    c = F.col
    p = _shops(spark, sf)
    whmcs, n = c("platform") == "whmcs", c("id").cast("string")
    site = F.concat(F.lit("https://"), "domain")
    buy = lambda k: F.concat(site, F.when(whmcs, F.lit("/cart.php?a=add&pid=")).otherwise("/cart.php?action=add&id="), k)
    group = F.concat(site, F.when(whmcs, F.lit("/cart.php?gid=")).otherwise("/cart.php?fid="), n)
    asked = F.when(c("kind") == "group", group).otherwise(buy(n))
    html = F.coalesce("html", F.lit(""))
    link = lambda k: F.concat(F.lit('<a href="'), F.replace(buy(k), F.lit("&"), F.lit("&amp;")), F.lit('">Order</a>'))
    twice = F.concat(link((2 * c("id")).cast("string")), link((2 * c("id") + 1).cast("string")))
    groups = [F.concat(html, twice), F.lit("<p>All groups</p>"), F.concat(html, F.lit("<p>Nothing here</p>")), F.lit(None), F.concat(html, link((c("id") % 3).cast("string")))]
    order = F.lit("<select name='billingcycle'></select><h2>Billing Cycle</h2>")
    mark = F.concat(F.lit("<input name='"), F.when(whmcs, "pid").otherwise("id"), F.lit("' value='"), n, F.lit("'>"))
    products = [F.concat(html, order, link(n)), F.concat(html, order, link(n)), F.lit("<p>Product does not exist</p>"), F.lit("<p>See our offers</p>"), F.concat(html, link(F.lit("7"))), F.concat(html, order, mark), F.lit(None), F.concat(html, order, mark)]
    shape = c("shape").cast("int")
    text = F.when(c("kind") == "group", F.get(F.array(*groups), shape)).otherwise(F.get(F.array(*products), shape))
    away = F.when(c("kind") == "group", F.when(shape == 2, F.concat(site, F.lit("/cart.php?a=view")))).otherwise(F.when(shape == 3, F.concat(site, F.lit("/cart.php?a=view"))).when(shape == 4, buy(F.lit("7"))))
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:a=add&amp;pid|action=add&amp;id)=(\d+)"), F.lit(1)), lambda k: F.struct(F.concat("domain", F.lit("::"), url.normalize_for_id(buy(k))).alias("id"), buy(k).alias("url"), F.concat(F.lit("Plan "), k).alias("name"), F.lit(None).cast("string").alias("price"), F.lit(None).cast("boolean").alias("available")))
    found = F.when((c("kind") == "group") | shape.isin(5, 7), F.array().cast(f"array<{hidden.FOUND}>")).otherwise(found)
    return p.select("domain", "platform", "kind", "id", F.lit(0).alias("nr"), asked.alias("asked"), F.coalesce(away, asked).alias("url"), text.isNotNull().alias("ok"), text.alias("text"), found.alias("products"), F.lit(None).cast("boolean").alias("page_available"), F.when(shape == 7, F.concat(F.lit("Plan "), n)).alias("page_name"))


def shop_scans(spark, sf) -> tuple[DataFrame, DataFrame]:
    """What is known of the shops beforehand: ids of some groups and products, and products of the first ids."""
    c = F.col
    sites = _shops(spark, sf).select("domain", "t", "platform").distinct()
    template = F.concat(F.lit("https://"), "domain", F.when(c("platform") == "whmcs", F.lit("/cart.php?a=add&pid={id}")).otherwise("/cart.php?action=add&id={id}"))
    scans = sites.select("domain", "platform", F.array(template).alias("templates"), F.when(c("t") % 4 == 1, F.array(F.lit(20) + c("t") % 7, F.lit(30))).alias("seed_products"), F.when(c("t") % 2 == 0, F.array(F.lit(5).cast("bigint"), F.lit(3).cast("bigint"))).alias("seed_groups"))
    existing = sites.select("domain", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), template.alias("template")).select("domain", F.concat("domain", F.lit("::"), url.normalize_for_id(F.replace("template", F.lit("{id}"), c("k").cast("string")))).alias("id"))
    return scans, existing


_L = LIMITS
HIDDEN_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(html, '') AS html, page_id // {SITE} AS t, page_id % {SITE} AS n, 'shop' || (page_id // {SITE}) || '.test' AS domain, page_id % {SITE} < {SITE_GROUPS} AS grp FROM pages
), q AS (
  SELECT *, CASE WHEN grp THEN n ELSE n - {SITE_GROUPS} END AS id, CASE WHEN t % 3 = 2 THEN '/cart.php?action=add&id=' ELSE '/cart.php?a=add&pid=' END AS tail FROM p
), s AS (
  SELECT *, CASE WHEN grp THEN ((id + t) // (t % 4 + 2)) % 5 ELSE ((id + 3 * t) // (t % 5 + 1)) % 8 END AS shape, domain || '::https://' || domain || tail AS stem FROM q
), j AS (
  SELECT domain, CASE WHEN grp THEN 'group' ELSE 'product' END AS kind, id,
    CASE WHEN grp THEN shape IN (0, 4) ELSE shape IN (0, 1, 5, 7) OR (shape = 4 AND id = 7) END AS evidence,
    CASE WHEN NOT grp AND (shape IN (0, 1, 7) OR (shape = 4 AND id = 7)) THEN [stem || id] ELSE []::VARCHAR[] END AS products,
    CASE WHEN grp AND shape = 0 THEN [2 * id, 2 * id + 1] WHEN grp AND shape = 4 THEN [id % 3] ELSE []::BIGINT[] END AS extra,
    CASE WHEN NOT grp OR shape = 3 THEN NULL WHEN shape = 1 THEN 'same' ELSE md5(html) || (shape, id)::VARCHAR END AS sig,
    CASE WHEN grp AND shape = 2 THEN 'away' WHEN NOT grp AND (shape = 3 OR (shape = 4 AND id <> 7)) THEN 'away' END AS red, stem
  FROM s
), sites AS (
  SELECT DISTINCT domain, t, stem, CASE WHEN t % 2 = 0 THEN [3, 5] ELSE []::BIGINT[] END AS groups, CASE WHEN t % 4 = 1 THEN list_sort([20 + t % 7, 30]) ELSE []::BIGINT[] END AS seeds FROM s
), st AS (
  SELECT domain, stem, seeds, 1 AS phase, groups AS todo, 0::BIGINT AS cur, list_transform(range(10), lambda k: stem || k) AS known, []::BIGINT[] AS cands, []::BIGINT[] AS done,
    0::BIGINT AS ni, 0::BIGINT AS sp, 0::BIGINT AS np, 0::BIGINT AS du, 0::BIGINT AS rd, NULL::VARCHAR AS lsig, NULL::VARCHAR AS lred, NULL::VARCHAR AS ended, NULL::BIGINT AS id, NULL::BOOLEAN AS ev, NULL::BOOLEAN AS dup, NULL::BIGINT AS added, NULL::BIGINT AS newc
  FROM sites
  UNION ALL
  SELECT domain, stem, seeds, CASE WHEN go THEN phase ELSE phase + 1 END,
    CASE WHEN go THEN todo[2:] WHEN phase = 2 THEN list_sort(cands)[1:{_L.most_candidates}] WHEN phase = 3 THEN list_filter(seeds, lambda x: NOT list_contains(done, x)) ELSE []::BIGINT[] END,
    CASE WHEN NOT go THEN CASE WHEN phase = 4 AND len(seeds) > 0 THEN greatest(0, list_min(seeds) - {_L.backtrack}) ELSE 0 END WHEN phase IN (2, 5) THEN cur + 1 ELSE cur END,
    CASE WHEN act AND j_ev AND NOT j_dup THEN list_distinct(list_concat(known, j_products)) ELSE known END, CASE WHEN act THEN list_distinct(list_concat(cands, j_extra)) ELSE cands END,
    CASE WHEN go THEN done WHEN phase = 2 THEN list_sort(cands)[1:{_L.most_candidates}] WHEN phase = 3 THEN list_distinct(list_concat(done, seeds)) ELSE done END,
    CASE WHEN NOT go THEN 0 WHEN NOT act THEN ni WHEN j_ev THEN 0 ELSE ni + 1 END,
    CASE WHEN NOT go THEN 0 WHEN NOT act OR j_sig IS NULL THEN sp WHEN j_sig = lsig THEN sp + 1 ELSE 1 END,
    CASE WHEN NOT go THEN 0 WHEN NOT act THEN np WHEN j_added > 0 OR (phase < 3 AND j_newc > 0) THEN 0 ELSE np + 1 END,
    CASE WHEN NOT go THEN 0 WHEN NOT act THEN du WHEN j_ev AND j_dup THEN du + 1 ELSE 0 END,
    CASE WHEN NOT go THEN 0 WHEN NOT act THEN rd WHEN j_red IS NULL THEN 0 WHEN j_red = lred THEN rd + 1 ELSE 1 END,
    CASE WHEN NOT go THEN NULL WHEN act THEN coalesce(j_sig, lsig) ELSE lsig END, CASE WHEN NOT go THEN NULL WHEN act THEN coalesce(j_red, lred) ELSE lred END,
    CASE WHEN NOT go AND phase IN (2, 5) THEN coalesce(why, 'exhausted') END, CASE WHEN act THEN probe END, CASE WHEN act THEN j_ev END, CASE WHEN act THEN j_dup END, CASE WHEN act THEN j_added END, CASE WHEN act THEN j_newc END
  FROM (
    SELECT *, go AND NOT skip AS act, coalesce(list_sum(list_transform(j_fresh, lambda x: 1)), 0)::BIGINT * (j_ev AND NOT j_dup)::BIGINT AS j_added FROM (
      SELECT b.*, coalesce(j.evidence, false) AS j_ev, coalesce(j.products, []::VARCHAR[]) AS j_products, coalesce(j.extra, []::BIGINT[]) AS j_extra, j.sig AS j_sig, CASE WHEN coalesce(j.evidence, false) THEN NULL ELSE j.red END AS j_red,
        list_filter(list_distinct(coalesce(j.products, []::VARCHAR[])), lambda x: NOT list_contains(b.known, x)) AS j_fresh, len(list_filter(coalesce(j.extra, []::BIGINT[]), lambda x: NOT list_contains(b.cands, x)))::BIGINT AS j_newc,
        coalesce(CASE WHEN NOT j.evidence THEN false WHEN len(j.products) > 0 THEN len(list_filter(j.products, lambda x: NOT list_contains(b.known, x))) = 0 ELSE len(j.extra) > 0 AND len(list_filter(j.extra, lambda x: NOT list_contains(b.known, b.stem || x))) = 0 END, false) AS j_dup
      FROM (
        SELECT a.*, CASE WHEN phase IN (1, 3, 4) THEN len(todo) > 0 ELSE skip OR (why IS NULL AND cur <= CASE WHEN phase = 2 THEN {_L.most_group} ELSE {_L.most_product} END) END AS go, CASE WHEN phase IN (1, 3, 4) THEN todo[1] ELSE cur END AS probe, CASE WHEN phase < 3 THEN 'group' ELSE 'product' END AS kd
        FROM (
          SELECT st.* EXCLUDE (ended, id, ev, dup, added, newc), phase = 5 AND list_contains(done, cur) AS skip,
            CASE WHEN cur > CASE WHEN phase = 2 THEN {_L.most_group} ELSE {_L.most_product} END OR cur <= {_L.least} THEN NULL WHEN phase = 5 AND ni >= CASE WHEN len(seeds) > 0 THEN {_L.no_info_seeded} ELSE {_L.no_info} END THEN 'no_info' WHEN phase = 2 AND sp >= {_L.same_page} THEN 'same_page'
              WHEN np >= CASE WHEN phase = 2 THEN {_L.group_no_progress} ELSE {_L.product_no_progress} END THEN 'no_progress' WHEN du >= {_L.product_duplicates} THEN 'duplicates' WHEN rd >= {_L.redirects} THEN 'redirects' END AS why
          FROM st WHERE phase < 6
        ) a
      ) b LEFT JOIN j ON j.domain = b.domain AND j.kind = b.kd AND j.id = b.probe
    )
  )
), ends AS (SELECT domain, CASE WHEN phase = 3 THEN 'group' ELSE 'product' END AS kind, ended FROM st WHERE ended IS NOT NULL)
SELECT st.domain, phase, e.kind, id, ev AS evidence, dup AS duplicate, added, newc AS candidates, CASE WHEN phase IN (2, 5) THEN ended END AS reason
FROM (SELECT * EXCLUDE (ended) FROM st WHERE id IS NOT NULL) st JOIN ends e ON e.domain = st.domain AND e.kind = CASE WHEN phase < 3 THEN 'group' ELSE 'product' END"""


@query(HIDDEN_SQL)
def hidden_ids(spark, sf, batch: int = 16):
    """Every probe of the shops' hidden ids, and why their scans stop."""
    scans, existing = shop_scans(spark, sf)
    found = hidden.scan_hidden_ids(scans, hidden.captured(settled(shop_answers(spark, sf))), existing, limits=LIMITS, batch=batch, settle=settled)
    log = found.probes.select("domain", "phase", "kind", "id", "evidence", "duplicate", F.col("added").cast("bigint"), F.col("candidates").cast("bigint"))
    return log.join(found.stops, ["domain", "kind"]).withColumn("reason", F.when(F.col("phase").isin(2, 5), F.col("reason")))


# --- links -------------------------------------------------------------------

#: (href, what it leads to on site {s} or null, score): addresses of all kinds.
LINK_KINDS = [
    ("/store/vps", "https://{s}/store/vps", 2), ("/store/vps/plan-{k}", None, 0), ("cart.php?gid={k}", "https://{s}/cart.php?gid={k}", 2), ("https://{s}/index.php?rp=/store/kvm", "https://{s}/index.php?rp=/store/kvm", 2), ("/index.php?rp=/store/kvm/p{k}", None, 0),
    ("index.php?/cart/nodes/", "https://{s}/index.php?/cart/nodes/", 2), ("/index.php?/cart/nodes/kvm/a{k}/b", None, 0), ("/cart/shared", "https://{s}/cart/shared", 2), ("/cart?fid={k}", "https://{s}/cart?fid={k}", 0), ("/cart", None, 0),
    ("products/cloud", "https://{s}/products/cloud", 2), ("/products/cloud/one", None, 0), ("/cart.php", "https://{s}/cart.php", 1), ("/cart.php?a=view", None, 0), ("/pricing", "https://{s}/pricing", 1), ("/pages/pricing?x={k}", "https://{s}/pages/pricing?x={k}", 1),
    ("//{s}/store/ssd", "https://{s}/store/ssd", 2), ("https://other.test/store/vps", None, 0), ("#top", None, 0), ("javascript:void(0)", None, 0), ("mailto:x@y.test", None, 0), ("/login?to=/store/vps", None, 0), ("/About", None, 0), ("cloud-vps.php", None, 0), ("/store/vps", "https://{s}/store/vps", 2),
]
CLICKS = [("location.href='/products/metal'", "https://{s}/products/metal", 2), ("go('x', \"cart.php?gid=9{k}\")", "https://{s}/cart.php?gid=9{k}", 2), ("go('about us')", None, 0)]


def _kinds_sql() -> str:
    told = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {told(link)}, {score})" for i, (_, link, score) in enumerate([*LINK_KINDS, *CLICKS]))


@query(f"""WITH k(i, link, score) AS (VALUES {_kinds_sql()}), p AS (SELECT page_id, 's' || (page_id % 9) || '.test' AS s FROM pages),
l AS (SELECT page_id, replace(replace(link, '{{s}}', s), '{{k}}', page_id::VARCHAR) AS link, score, i FROM p JOIN k ON (i + page_id) % 4 < 2 WHERE page_id % 11 <> 5 AND link IS NOT NULL
  UNION ALL SELECT page_id, 'https://' || s || x.link, CASE WHEN x.i = 2 THEN 0 WHEN x.i = 1 THEN 2 ELSE 1 END, 1000 + x.i FROM p, (VALUES (0, '/cart.php'), (1, '/index.php?rp=/store'), (2, '/store')) x(i, link) WHERE page_id % 22 = 5),
d AS (SELECT page_id, link, any_value(score) AS score, min(i) AS i FROM l GROUP BY 1, 2)
SELECT page_id, link, score::INTEGER AS score, (row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i))::INTEGER AS place FROM d QUALIFY place <= 8""")
def candidate_links(spark, sf):
    """The eight best listings that each page links to, by anchors and click handlers of 28 kinds; some pages have none but those of their platform."""
    c = F.col
    k, s = c("page_id").cast("string"), F.concat(F.lit("s"), (c("page_id") % 9).cast("string"), F.lit(".test"))
    tag = lambda i, a: F.when(((F.lit(i) + c("page_id")) % 4 < 2) & (c("page_id") % 11 != 5), F.replace(F.replace(F.lit(a), F.lit("{s}"), s), F.lit("{k}"), k)).otherwise("")
    tags = [tag(i, f'<a href="{h}">x</a>') for i, (h, _, _) in enumerate(LINK_KINDS)]
    clicks = [tag(len(LINK_KINDS) + i, f"<button onclick='{h}'>x</button>" if '"' in h and "'" not in h else '<button onclick="' + h.replace('"', "&quot;") + '">x</button>') for i, (h, _, _) in enumerate(CLICKS)]
    pages = table(spark, sf, "pages").withColumn("text", F.concat(F.coalesce("html", F.lit("")), *clicks, *tags, F.when(c("page_id") % 22 == 5, "<p>Powered by WHMCS</p>").otherwise("")))
    pages = pages.select("page_id", F.concat(F.lit("https://"), s, F.lit("/x/"), k, F.lit(".html")).alias("url"), "text")
    found = discover.candidate_pages(pages, most=8)
    return found.select(F.regexp_extract("url", r"/x/(\d+)\.html", 1).cast("bigint").alias("page_id"), "link", "score", "place")


# --- crawls ------------------------------------------------------------------

CRAWL_SITE = 30
_CRAWL_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id // {CRAWL_SITE} AS t, page_id % {CRAWL_SITE} AS n, (page_id % {CRAWL_SITE} * 7 + page_id // {CRAWL_SITE}) % 5 <> 0 AS ok FROM pages
), a AS (
  SELECT *, list_filter(CASE WHEN n % 2 = 1 THEN [2 * n + 2, 2 * n + 1, n // 2] ELSE [2 * n + 1, 2 * n + 2] END, lambda x: x < 34) AS links, [n // 2, n % 3 + 20, n // 2] AS products FROM p
), st AS (
  SELECT DISTINCT t, [2, 1, 3]::BIGINT[] AS queue, 1::BIGINT AS pos, [0, 2, 1, 3]::BIGINT[] AS seen, [0, 7]::BIGINT[] AS known, 0::BIGINT AS es, 0::BIGINT AS ns, 0::BIGINT AS pages, 0::BIGINT AS errors, 0::BIGINT AS new_pages, NULL::VARCHAR AS reason, NULL::BIGINT AS n, NULL::BOOLEAN AS ok, 0::BIGINT AS fresh FROM p
  UNION ALL
  SELECT t, queue || more, pos + 1, seen || more, known || news, e1, s1, pages + go::BIGINT, errors + (go AND NOT good)::BIGINT, new_pages + len(more),
    CASE WHEN NOT go THEN CASE WHEN pos > len(queue) THEN 'queue_exhausted' ELSE 'max_pages' END
      WHEN NOT good THEN CASE WHEN stop_errors > 0 AND e1 >= stop_errors AND here % 4 = 0 AND (strict OR pos >= len(queue)) THEN 'fetch_error_streak' END
      WHEN len(known) + len(news) >= max_products THEN 'max_products' WHEN stop_no_new > 0 AND s1 >= stop_no_new AND here % 4 = 0 THEN 'no_new_pages_streak' END,
    CASE WHEN go THEN here END, CASE WHEN go THEN good END, len(news)
  FROM (
    SELECT *, CASE WHEN NOT go THEN es WHEN good THEN 0 ELSE es + 1 END AS e1, CASE WHEN NOT go OR NOT good THEN ns WHEN len(news) > 0 THEN 0 ELSE ns + 1 END AS s1 FROM (
      SELECT b.*, coalesce(a.ok, false) AS good, CASE WHEN go AND coalesce(a.ok, false) THEN list_filter(a.links, lambda x: NOT list_contains(seen, x)) ELSE []::BIGINT[] END AS more,
        CASE WHEN go AND coalesce(a.ok, false) THEN list_distinct(list_filter(a.products, lambda x: NOT list_contains(known, x))) ELSE []::BIGINT[] END AS news
      FROM (
        SELECT st.* EXCLUDE (reason, n, ok, fresh), queue[pos] AS here, pos <= len(queue) AND pages < max_pages AS go, max_pages, max_products, stop_no_new, stop_errors, strict
        FROM st, LATERAL (SELECT ([12, 40, 6, 40])[t % 4 + 1] AS max_pages, CASE WHEN t % 3 = 0 THEN 9 ELSE 2000 END AS max_products, ([0, 3, 2])[t % 3 + 1] AS stop_no_new, ([2, 0, 2])[t % 3 + 1] AS stop_errors, t % 2 = 0 AS strict) WHERE reason IS NULL
      ) b LEFT JOIN a ON a.t = b.t AND a.n = b.here
    )
  )
), ends AS (SELECT t, pages, errors, len(known)::BIGINT AS found, new_pages, reason FROM st WHERE reason IS NOT NULL)"""


def _crawl(spark, sf) -> discover.Crawl:
    """Thirty pages a site: each links to two further ones and every second one back; some don't answer, and some addresses lead nowhere."""
    c = F.col
    p = table(spark, sf, "pages").select("html", F.floor(c("page_id") / CRAWL_SITE).alias("t"), (c("page_id") % CRAWL_SITE).alias("n"))
    domain = F.concat(F.lit("crawl"), c("t").cast("string"), F.lit(".test"))
    at = lambda n: F.concat(F.lit("https://"), domain, F.when(n % 4 == 0, F.lit("/cart.php?gid=")).otherwise("/store/c"), n.cast("string"))
    n = c("n")
    links = F.filter(F.when(n % 2 == 1, F.array(2 * n + 2, 2 * n + 1, F.floor(n / 2))).otherwise(F.array(2 * n + 1, 2 * n + 2)), lambda x: x < 34)
    text = F.concat(F.coalesce("html", F.lit("")), F.array_join(F.transform(links, lambda x: F.concat(F.lit("<a href='"), at(x), F.lit("'>x</a>"))), ""))
    stock = lambda i: F.when((n + i) % 3 == 0, True).when((n + i) % 3 == 1, False)
    shown = F.array(*(F.struct(k.cast("string").alias("id"), stock(i).alias("available"), F.when((n + i) % 2 == 0, F.concat(F.lit("n"), n.cast("string"))).otherwise("").alias("name")) for i, k in enumerate((F.floor(n / 2), n % 3 + 20, F.floor(n / 2)))))
    answers = settled(p.select(domain.alias("domain"), at(n).alias("url"), ((n * 7 + c("t")) % 5 != 0).alias("ok"), text.alias("text"), shown.alias("products")))

    def source(wanted: DataFrame) -> DataFrame:
        asked = answers.join(wanted, ["domain", "url"], "left_semi")
        led = discover.candidate_pages(asked.where("ok")).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "link"))), lambda x: x.link).alias("links"))
        return asked.select("domain", "url", "ok", F.col("url").alias("final_url"), "products").join(led, "url", "left")

    t = c("t")
    sites = p.select("t").distinct()
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (t % k).cast("int"))
    targets = sites.select(
        domain.alias("domain"), at(F.lit(0)).alias("base_url"), F.array(at(F.lit(2)), at(F.lit(0)), at(F.lit(1)), at(F.lit(2)), at(F.lit(3))).alias("queue"), pick((12, 40, 6, 40), 4).alias("max_pages"), F.when(t % 3 == 0, 9).otherwise(2000).alias("max_products"),
        pick((0, 3, 2), 3).alias("stop_no_new"), pick((2, 0, 2), 3).alias("stop_errors"), (t % 2 == 0).alias("strict"),
    )
    known = sites.select(domain.alias("domain"), F.explode(F.array(F.lit("0"), F.lit("7"))).alias("id"), F.lit(None).cast("boolean").alias("available"), F.lit("old").alias("name"))
    return discover.budgeted_crawl(targets, source, known, settle=settled)


@query(f"""{_CRAWL_SQL}
SELECT 'crawl' || st.t || '.test' AS domain, st.pages AS place, 'https://crawl' || st.t || '.test' || CASE WHEN n % 4 = 0 THEN '/cart.php?gid=' ELSE '/store/c' END || n AS url, ok, fresh AS new, e.pages, e.errors, e.found, e.new_pages, e.reason
FROM st JOIN ends e ON e.t = st.t WHERE n IS NOT NULL""")
def crawl_budgets(spark, sf):
    """Every visit of the sites' crawls, what they found, and why they stop."""
    found = _crawl(spark, sf)
    return found.visits.join(found.targets, "domain")


@query(f"""{_CRAWL_SQL}, s AS (
  SELECT st.t, st.pages AS place, i, ([st.n // 2, st.n % 3 + 20, st.n // 2])[i + 1] AS id, CASE (st.n + i) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS available, CASE WHEN (st.n + i) % 2 = 0 THEN 'n' || st.n ELSE '' END AS name FROM st, range(3) r(i) WHERE ok
  UNION ALL SELECT t, 0, -1, unnest([0, 7]), NULL, 'old' FROM ends
)
SELECT 'crawl' || t || '.test' AS domain, id::VARCHAR AS id, CASE WHEN bool_or(NOT available) THEN false WHEN bool_or(available) THEN true END AS available, arg_max(name, place * 10 + i) FILTER (name <> '') AS name FROM s GROUP BY t, id""")
def crawl_products(spark, sf):
    """The products of the visited pages, all sights of each in one row."""
    return _crawl(spark, sf).products


# --- listings ----------------------------------------------------------------


def _brand_pages(spark, sf, body, page: str = "/cart.php", wrap: str = "{}") -> DataFrame:
    """Forty parts a page on the site of their brand: ``body`` of each, in order."""
    c = F.col
    p = table(spark, sf, "part").select("p_brand", F.floor(c("p_partkey") / 40).alias("nr"), "p_partkey", body.alias("item"))
    p = p.groupBy("p_brand", "nr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]), "\n").alias("body"))
    site = F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".test"))
    head, tail = wrap.split("{}")
    return p.select(F.concat(site, F.lit(page)).alias("url"), c("nr").alias("seq"), F.concat(F.lit(head), c("body"), F.lit(tail)).alias("text"), F.lit(True).alias("ok"))


def _filled(pattern: str, **values) -> F.Column:
    out = F.lit(pattern)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def _item() -> F.Column:
    c = F.col
    sold = F.when(c("p_partkey") % 3 == 0, " none-stock").otherwise("")
    features = F.when(c("p_partkey") % 4 == 0, F.lit("")).otherwise(_filled("<ul class='cart-products-features'><li>RAM: {s}GB</li><li>Port: {s}Mbps</li></ul>", s=c("p_size")))
    item = F.concat(_filled("<div class='cart-products-item'><div class='cart-products-box{sold}' pid='{k}'><h4 class='cart-products-title'> LAX.{s}.{n} </h4><p class='cart-products-price'>$ {p} USD</p>", sold=sold, k=c("p_partkey"), s=c("p_size"), n=c("p_name"), p=F.format_string("%.2f", "p_retailprice")), features, F.lit("</div></div>"))
    return F.when(c("p_partkey") % 7 == 0, F.replace(item, F.lit("pid='"), F.lit("pid='x"))).otherwise(item)


@query("""SELECT 'brand-' || lower(split_part(p_brand, '#', 2)) || '.test' AS domain, p_partkey AS pid, 'brand-' || lower(split_part(p_brand, '#', 2)) || '.test::https://brand-' || lower(split_part(p_brand, '#', 2)) || '.test/cart.php?a=add&pid=' || p_partkey AS id,
  'LAX.' || p_size || '.' || p_name AS name, printf('%.2f USD', p_retailprice) AS price, 'USD' AS currency, p_partkey % 3 <> 0 AS available, CASE WHEN p_partkey % 4 <> 0 THEN p_size || 'GB' END AS ram, CASE WHEN p_partkey % 4 <> 0 THEN p_size || 'Mbps' END AS port FROM part WHERE p_partkey % 7 <> 0""")
def listing_map(spark, sf):
    """Parts listed by id on their brand's page, read as a map and as product rows; every seventh has no id."""
    pages = _brand_pages(spark, sf, _item())
    found = settled(listing.listing_map(pages))
    rows = listing.listing_products(found).select("id", F.col("specs").alias("own"), "domain", url.param_int(F.col("url"), "pid").alias("pid"))
    spec = lambda k: F.try_element_at("specs", F.lit(k))
    return found.join(rows, ["domain", "pid"]).select("domain", "pid", "id", "name", "price", "currency", "available", F.regexp_extract(spec("RAM"), r"\d+\s*GB", 0).alias("ram"), F.regexp_extract(spec("Port"), r"\d+\s*Mbps", 0).alias("port"))


def _plan() -> F.Column:
    """A row of a plan table: a dialog of two places, store links of its own, no store link, or too few cells."""
    c = F.col
    cells = _filled("<td> {n} </td><td>{s}0 GB SSD</td><td>{s} vCPU</td><td>{s} GB</td><td></td><td>{s} Gbps</td><td>$ {p} / mo</td>", n=c("p_name"), s=c("p_size"), p=F.format_string("%.2f", "p_retailprice"))
    link = lambda place: _filled("<a href='/billing/store/x/{w}-{k}?utm_source=a'>{w}</a>", w=F.lit(place), k=c("p_partkey"))
    dialog = F.concat(_filled("</tr></table><div id='m{k}'>", k=c("p_partkey")), link("Lyon"), F.lit("<a href='/help'>Help</a>"), link("Graz"), link("Graz"), F.lit("</div><table>"))
    button = _filled("<td><button data-bs-target='#m{k}'>Order</button><a href='/billing/store/x/own-{k}'>Own</a></td>", k=c("p_partkey"))
    own = _filled("<td><a href='billing/store/x/own-{k}'> Buy  now </a></td>", k=c("p_partkey"))
    row = lambda inside: F.concat(F.lit("<tr class='a table-row'>"), inside)
    shapes = [row(F.concat(cells, button, dialog)), row(F.concat(cells, own, F.lit("</tr>"))), row(F.concat(cells, F.lit("<td><a href='/about'>Order</a></td></tr>"))), row(F.concat(_filled("<td>{n}</td><td>x</td>", n=c("p_name")), own, F.lit("</tr>")))]
    return F.get(F.array(*shapes), (c("p_partkey") % 4).cast("int"))


@query("""WITH p AS (SELECT *, 'brand-' || split_part(p_brand, '#', 2) || '.test' AS domain FROM part WHERE p_partkey % 4 < 2), l AS (SELECT *, unnest(CASE p_partkey % 4 WHEN 0 THEN ['Lyon', 'Graz'] ELSE [NULL] END) AS location FROM p)
SELECT domain || '::https://' || domain || '/billing/store/x/' || coalesce(location, 'own') || '-' || p_partkey AS id, domain, p_name || coalesce(' / ' || location, '') AS name, p_name AS variant_of, location, printf('%.2f USD', p_retailprice) AS price, NULL::BOOLEAN AS available,
  'Disk=' || p_size || '0 GB SSD,CPU=' || p_size || ' vCPU,RAM=' || p_size || ' GB,Port=' || p_size || ' Gbps,OS=$ ' || printf('%.2f', p_retailprice) || ' / mo' || coalesce(',Location=' || location, '') AS specs FROM l""")
def plan_table(spark, sf):
    """Parts as rows of their brand's plan tables: a product per place of a row's dialog, or per store link of its own."""
    pages = _brand_pages(spark, sf, _plan(), "/vps.php", "<html><body><table>{}</table></body></html>")
    c = F.col
    found = listing.plan_tables(pages, settle=settled)
    return found.select("id", "domain", "name", "variant_of", "location", "price", "available", F.array_join(F.transform(F.map_entries("specs"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("specs"))


# --- enrichment --------------------------------------------------------------

_STOCKS = ["<p>5 available</p>", "<p>Sold out</p>", "<p>nothing told</p>"]
_ENRICH_MOST = 60


def _rows_to_enrich(spark, sf) -> DataFrame:
    """Parts as product rows, in pairs of one address: some lack stock, some a location, some a price; the page of every eleventh pair sells nothing."""
    c = F.col
    k = c("p_partkey")
    pair = F.floor(k / 2)
    domain = F.concat(F.lit("brand-"), F.split_part("p_brand", F.lit("#"), F.lit(2)), F.lit(".test"))
    p = table(spark, sf, "part").withColumns({"domain": domain, "pair": pair})
    return listing.typed(
        p.select(
            F.concat("domain", F.lit("::"), k.cast("string")).alias("id"), "domain", F.concat(F.lit("https://"), "domain", F.when(c("pair") % 11 == 0, F.lit("/cart?x=")).otherwise("/store/vps/p"), F.floor(c("pair") / 20).cast("string")).alias("url"), c("p_name").alias("name"),
            F.when(k % 3 > 0, F.concat("p_size", F.lit(".00 USD"))).alias("price"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("available"), F.when(k % 5 == 0, "lyon").when(k % 5 == 1, "Oslo").alias("location"),
            F.when(k % 2 == 0, F.array(F.lit("Yearly"))).alias("billing_cycles"), F.when(k % 2 == 0, F.create_map(F.lit("Yearly"), F.lit("90.00 USD"))).alias("cycle_prices"), k.alias("seq"),
        )
    )


def _detail(wanted: DataFrame) -> DataFrame:
    """A detail page for each wanted address, by its number: stock, cycles, locations; some don't answer."""
    c = F.col
    nr = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")
    cycle = F.when(nr % 2 == 0, "<select name='cycle'><option value='m'>$9.00 Monthly</option></select>").otherwise("")
    place = F.when(nr % 3 == 0, "<div class='form-group'><label>Location</label><select name='configoption[1]'><option>Lyon</option><option>Graz</option><option>Oslo - Out of Stock</option></select></div>").when(nr % 3 == 1, "<div class='form-group'><label>Location</label><select name='configoption[1]'><option>Bern</option></select></div>").otherwise("")
    text = F.when(nr % 7 != 6, F.concat(F.get(F.array(*map(F.lit, _STOCKS)), (nr % 3).cast("int")), cycle, place))
    return wanted.select("url", text.alias("text"))


@query(f"""WITH r AS (
  SELECT p_partkey AS k, 'brand-' || split_part(p_brand, '#', 2) || '.test' AS d, (p_partkey // 2) // 20 AS nr, 'https://' || d || CASE WHEN p_partkey // 2 % 11 = 0 THEN '/cart?x=' ELSE '/store/vps/p' END || nr AS url, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_size || '.00 USD' END AS price,
    CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS av, CASE p_partkey % 5 WHEN 0 THEN 'lyon' WHEN 1 THEN 'Oslo' END AS loc, p_partkey % 2 = 0 AS yearly, CASE WHEN av IS NULL OR NOT av THEN 0 WHEN loc IS NULL THEN 2 END AS pr FROM part
), w AS (
  SELECT d, url, count(*) AS n, min(pr) AS pr, min(k) AS f FROM r WHERE pr IS NOT NULL GROUP BY d, url QUALIFY row_number() OVER (PARTITION BY d ORDER BY min(pr), min(k), url) <= {_ENRICH_MOST}
), j AS (
  SELECT r.*, w.n IS NOT NULL AND r.pr IS NOT NULL AND nr % 7 <> 6 AS seen, coalesce(w.n > 1 AND contains(r.url, '/cart?'), false) AS shared,
    CASE WHEN NOT seen THEN av ELSE coalesce((nr % 3 = 0) OR (CASE WHEN nr % 3 = 1 THEN false END), av) END AS st, seen AND NOT shared AND nr % 2 = 0 AS monthly, CASE WHEN NOT seen OR shared THEN 9 ELSE nr % 3 END AS kind FROM r LEFT JOIN w ON w.d = r.d AND w.url = r.url
), t AS (
  SELECT *, CASE WHEN nr % 3 = 2 OR NOT seen THEN av WHEN nr % 3 = 0 THEN true ELSE false END AS st2,
    CASE WHEN kind = 0 THEN coalesce(CASE loc WHEN 'lyon' THEN 'Lyon' WHEN 'Oslo' THEN 'Oslo' END, 'Lyon') WHEN kind = 1 THEN coalesce(loc, 'Bern') ELSE loc END AS place FROM j
), b AS (
  SELECT d || '::' || k AS id, url, name, CASE WHEN price IS NOT NULL OR NOT seen THEN price WHEN monthly THEN '9.00 USD' WHEN yearly THEN '90.00 USD' END AS price, CASE WHEN kind = 0 AND loc = 'Oslo' THEN false ELSE st2 END AS available, place AS location,
    CASE WHEN seen THEN place END AS locations, CASE WHEN monthly THEN 'Monthly' WHEN yearly THEN 'Yearly' END AS cycles, concat_ws(',', CASE WHEN monthly THEN 'Monthly=9.00 USD' END, CASE WHEN yearly THEN 'Yearly=90.00 USD' END) AS prices, NULL AS variant_of FROM t
  UNION ALL
  SELECT d || '::' || k || '::loc-' || lower(x), url, name, price, CASE WHEN x = 'Oslo' THEN false ELSE st2 END, x, x, CASE WHEN monthly THEN 'Monthly' WHEN yearly THEN 'Yearly' END, concat_ws(',', CASE WHEN monthly THEN 'Monthly=9.00 USD' END, CASE WHEN yearly THEN 'Yearly=90.00 USD' END), name
  FROM t, (SELECT unnest(['Graz', 'Oslo']) AS x) WHERE kind = 0 AND loc IS NULL
)
SELECT id, name, price, available, location, locations, CASE WHEN locations IS NOT NULL THEN locations || '=' || url END AS links, cycles, prices, variant_of FROM b""")
def enriched_products(spark, sf):
    """Product rows completed from the sixty detail pages of each domain that are worth most."""
    c = F.col
    rows = settled(_rows_to_enrich(spark, sf))
    got = enrich.enrich_products(rows, _detail, _ENRICH_MOST, settle=settled, recheck_out=True)
    pairs = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), e.value))), ",")
    return got.select("id", "name", "price", "available", "location", F.array_join("locations", ",").alias("locations"), pairs("location_links").alias("links"), F.array_join("billing_cycles", ",").alias("cycles"), F.coalesce(pairs("cycle_prices"), F.lit("")).alias("prices"), "variant_of")
