"""Quality rules in DataFrame functions only: fixed base rules, and rules whose cutoffs carry a guarantee.

Statistics of whole texts are built-in expressions; no text is shuffled. A
labelled holdout then says, per stratum and rule, which cutoffs surely reject
at most a given share of good documents: each cutoff is a hypothesis with an
exact binomial tail, and all of them are corrected together by Holm's steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_name, settle, table

WHITE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Words of the windows whose repetition counts.
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30


@dataclass(frozen=True)
class Rule:
    """Rejects where part / whole is beyond a cutoff (in thousandths, lenient ones first): above it, or below it if ``low``."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]
    low: bool = False


RULES = (
    Rule("symbols", "n_symbols", "n_words", (1000, 500, 300, 200, 100, 50)),
    Rule("bangs", "n_bangs", "n_words", (1000, 500, 300, 200, 100, 50)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (900, 700, 500, 300, 200, 100)),
    Rule("repeated_words", "n_repeat_words", "n_words", (250, 200, 150, 100, 50, 20)),
    Rule("long_words", "word_chars", "n_words", (20_000, 15_000, 12_000, 10_000, 9_000, 8_000)),
    Rule("short_words", "word_chars", "n_words", (2_000, 2_500, 3_000, 3_500, 4_000, 4_500), low=True),
)
#: Of the good documents of a stratum a rule may reject so many (a share); the chance that any cutoff in use breaks this; bad documents that weigh up one good one.
RISK, ERROR, PRICE = 0.01, 0.05, 10
#: Strata with cutoffs of their own, at most: those with most good labels. All others share one. The bound is what lets cutoffs be broadcast.
MOST_STRATA = 1000

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def covered(hashes: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order."""

    def positions(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i).h == x.h, F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.at))

    steps = lambda at: F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    words = F.aggregate(_let(_let(ordered, positions), steps), F.lit(0), lambda a, n: a + n)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), words).otherwise(0).cast("long")


def text_statistics(docs: DataFrame, *, text: str = "text", into: str = "stats") -> DataFrame:
    """``docs`` with a struct ``into`` of STATISTICS of the whole text; a null text has none of anything.

    Words are runs of anything but ASCII white space, n_lines counts the lines
    that hold one, and n_dup_lines those of them that equal an earlier line.
    Windows of words are compared by 64-bit hashes within their own text. A
    column called like ``into`` is replaced.
    """
    words, hashes, full = (free_name(docs, c) for c in ("words", "hashes", "full"))
    raw = F.coalesce(F.col(full), F.lit(""))
    trimmed = F.btrim(raw, F.lit(WHITE))
    cut = docs.withColumn(full, F.col(text)).withColumn(words, F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>")))
    n = F.size(words)
    # Each step is a projection of its own: what a later one uses twice is computed once.
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(F.col(words), i, WINDOW))))
    cut = cut.withColumn(hashes, F.coalesce(windows, F.array().cast("array<bigint>")))
    squeezed = _without(raw, WHITE)
    lines = F.filter(F.split(raw, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    many = F.contains(raw, F.lit("\n"))
    sizes = F.when(many, _let(lines, lambda held: F.struct(F.size(held).alias("held"), F.size(F.array_distinct(held)).alias("distinct"))))
    told, chars = free_name(docs, "told"), free_name(docs, "chars")
    cut = cut.withColumn(told, sizes).withColumn(chars, squeezed)
    count = lambda what: (F.char_length(chars) - F.char_length(_without(F.col(chars), what))).cast("long")
    lined = F.coalesce(F.col(told).held, (n > 0).cast("int"))
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(chars).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count("!").alias("n_bangs"),
        lined.cast("long").alias("n_lines"),
        F.coalesce(F.col(told).held - F.col(told).distinct, F.lit(0)).cast("long").alias("n_dup_lines"),
        covered(F.col(hashes)).alias("n_repeat_words"),
    )
    return cut.withColumn(into, stats).drop(words, hashes, full, told, chars)


def base_failed(stats: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (stats.n_words < LEAST_WORDS) | (100 * stats.n_repeat_words > MOST_REPEATED * stats.n_words)


def severity(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """For each rule, how many of its cutoffs a document is beyond; without a whole it is beyond none."""

    def beyond(rule: Rule) -> Column:
        part, whole = 1000 * stats.getField(rule.part), stats.getField(rule.whole)
        hits = [((part < c * whole) if rule.low else (part > c * whole)).cast("int") for c in rule.cutoffs]
        return F.when(whole > 0, reduce(lambda a, b: a + b, hits)).otherwise(0)

    return F.array(*map(beyond, rules))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function, for x of 1 or more (Stirling's series from x + 10 on; to some 1e-11)."""
    y = x + 10
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - reduce(lambda a, b: a + b, (F.ln(x + i) for i in range(10)))


def log_tail(k: Column, n: Column, risk: float) -> Column:
    """ln P(X <= k) of a binomial X with n draws of chance ``risk``, for k below its mean; 0 (certain) from there on.

    Terms are summed from the k-th down, which fall faster than geometrically;
    those after the first 40 deviations can't change the sum.
    """
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.ln(F.lit(risk)) + (n - k) * F.ln(F.lit(1 - risk))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * risk)) + 60).cast("int")
    down = F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0)))
    odds = (1 - risk) / risk
    add = lambda a, j: _let(a.term * (k - j) / (n - k + j + 1) * odds, lambda t: F.struct(t.alias("term"), (a.total + t).alias("total")))
    total = F.aggregate(down, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), add, lambda a: a.total)
    return F.when(k < n * risk, first + F.ln(total)).otherwise(0.0)


def certified_cutoffs(labelled: DataFrame, rules: tuple[Rule, ...] = RULES, *, risk: float = RISK, error: float = ERROR, price: float = PRICE) -> DataFrame:
    """(stratum, rule, need): of each stratum and rule, the cutoff in use; documents of that severity or more are rejected.

    ``labelled`` counts ``good`` and ``bad`` documents by ``stratum`` and
    ``severity``. A cutoff's hypothesis is that it rejects more than ``risk`` of the good
    documents of a stratum. It is refuted where the exact binomial chance of so
    few rejections is small enough by Holm's steps over all strata, rules and
    cutoffs, so that with a chance of 1 - ``error`` no cutoff in use rejects
    more. Of the certified ones that counts which rejects most bad documents
    less ``price`` times the good ones, of equal ones the most lenient; none,
    if that isn't above 0. Without enough good labels nothing is certified.
    """
    levels = F.array(*(F.lit(len(r.cutoffs)) for r in rules))
    seen = labelled.select("stratum", "good", "bad", F.posexplode("severity").alias("rule", "s")).groupBy("stratum", "rule", "s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    need = F.explode(F.sequence(F.lit(1), F.get(levels, F.col("rule"))))
    hit = lambda c: F.sum(F.when(F.col("s") >= F.col("need"), F.col(c)).otherwise(0))
    tests = seen.withColumn("need", need).groupBy("stratum", "rule", "need").agg(F.sum("good").alias("n"), hit("good").alias("k"), hit("bad").alias("caught"))
    tests = tests.withColumn("log_p", log_tail(F.col("k"), F.col("n"), risk))
    # One row a cutoff: what one task orders is bounded by the strata.
    steps = tests.withColumn("step", F.row_number().over(Window.orderBy("log_p", F.col("stratum").asc_nulls_first(), "rule", F.col("need").desc())))
    every = Window.partitionBy(F.lit(0))
    steps = steps.withColumn("m", F.count("*").over(every)).withColumn("stop", F.min(F.when(F.col("log_p") > F.ln(error / (F.col("m") - F.col("step") + 1)), F.col("step"))).over(every))
    sure = steps.where(F.col("stop").isNull() | (F.col("step") < F.col("stop"))).withColumn("worth", F.col("caught") - price * F.col("k"))
    best = sure.groupBy("stratum", "rule").agg(F.max(F.struct("worth", "need")).alias("best"))
    return best.where(F.col("best.worth") > 0).select("stratum", "rule", F.col("best.need").alias("need"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR, price: float = PRICE, most_strata: int = MOST_STRATA) -> DataFrame:
    """``docs`` without the text, with STATISTICS, base_failed, rejected_by (names of rules, in order) and kept.

    The holdout is all labelled documents that the base rules keep. Rows with a
    null id or label say nothing; of repeated labels the smallest counts, and a
    repeated document counts as often as it is there. A null stratum, and one
    beyond the ``most_strata`` with most good labels, belongs to one that all
    such share. Null and empty texts have no words, so they fail the base.
    Without labels the base alone decides. Columns called like new ones give
    way.
    """
    new = (*STATISTICS, "base_failed", "rejected_by", "kept")
    into, failed, level, own, key, uses = (free_name(docs, c) for c in ("stats", "failed", "level", "own", "key", "uses"))
    others = [c for c in docs.columns if c.lower() not in new and c.lower() != text.lower()]
    told = text_statistics(docs, text=text, into=into)
    told = settle(told.select(*(F.col(f"`{c}`") for c in others), into, base_failed(F.col(into)).alias(failed), severity(F.col(into), rules).alias(level)), "rules")
    good = labels.where(F.col(id_).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_).alias("label_id")).agg((F.min(label) > 0).cast("int").alias("good"))
    held = told.where(~F.col(failed)).select(F.col(id_).alias("label_id"), F.col(stratum).alias("stratum"), F.col(level).alias("severity")).join(good, "label_id")
    # From here to the cutoffs there is one row a stratum and combination of severities.
    held = settle(held.groupBy("stratum", "severity").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")), "holdout")
    named = held.where(F.col("stratum").isNotNull()).groupBy("stratum").agg(F.sum("good").alias("n")).orderBy(F.col("n").desc(), "stratum").limit(most_strata).select(F.col("stratum").alias(own))
    counts = held.join(F.broadcast(named), F.col("stratum") == F.col(own), "left").select(F.col(own).alias("stratum"), "severity", "good", "bad")
    cutoffs = certified_cutoffs(counts, rules, risk=risk, error=error, price=price)
    cutoffs = cutoffs.groupBy(F.col("stratum").alias(key)).agg(F.sort_array(F.collect_list(F.struct("rule", "need"))).alias(uses))
    # Both tables have one row a stratum at most.
    joined = told.join(F.broadcast(named), F.col(f"`{stratum}`") == F.col(own), "left").join(F.broadcast(cutoffs), F.col(own).eqNullSafe(F.col(key)), "left")
    names = F.array(*(F.lit(r.name) for r in rules))
    hits = F.filter(F.col(uses), lambda u: F.get(F.col(level), u.rule) >= u.need)
    rejected = F.coalesce(F.transform(hits, lambda u: F.get(names, u.rule)), F.array().cast("array<string>"))
    out = joined.select(*(F.col(f"`{c}`") for c in others), *(F.col(into).getField(c).alias(c) for c in STATISTICS), F.col(failed).alias("base_failed"), rejected.alias("rejected_by"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with the base statistics and the verdict."""
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, lang, coalesce(text, '') AS raw, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS held
    FROM documents
),
numbered AS (SELECT row_number() OVER () AS r, * FROM d),
windows AS (SELECT r, unnest(range(1, len(w) - 6)) AS pos, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM numbered WHERE len(w) > 8),
twice AS (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS next FROM (SELECT r, pos FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1)),
repeated AS (SELECT r, sum(least(8, coalesce(next - pos, 8)))::BIGINT AS n FROM twice GROUP BY r),
stats AS (
    SELECT r, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(raw, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(raw, '[^!]', '', 'g'))::BIGINT AS n_bangs,
           len(held)::BIGINT AS n_lines, (len(held) - len(list_distinct(held)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM numbered LEFT JOIN repeated USING (r)
),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats),
rules(rule, cutoffs, low) AS (
    VALUES ('symbols', [1000, 500, 300, 200, 100, 50], 1), ('bangs', [1000, 500, 300, 200, 100, 50], 1), ('duplicate_lines', [900, 700, 500, 300, 200, 100], 1),
           ('repeated_words', [250, 200, 150, 100, 50, 20], 1), ('long_words', [20000, 15000, 12000, 10000, 9000, 8000], 1), ('short_words', [2000, 2500, 3000, 3500, 4000, 4500], -1)
),
shares AS (
    SELECT r, doc_id, lang, base_failed, unnest(['symbols', 'bangs', 'duplicate_lines', 'repeated_words', 'long_words', 'short_words']) AS rule,
           unnest([n_symbols, n_bangs, n_dup_lines, n_repeat_words, word_chars, word_chars]) AS part, unnest([n_words, n_words, n_lines, n_words, n_words, n_words]) AS whole
    FROM based
),
graded AS (SELECT r, doc_id, lang, base_failed, rule, CASE WHEN whole > 0 THEN len(list_filter(cutoffs, lambda c: low * 1000 * part > low * c * whole)) ELSE 0 END AS s FROM shares JOIN rules USING (rule)),
good AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
held AS (SELECT lang, rule, s, good FROM graded JOIN good USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT lang, rule, need, count(*) FILTER (good)::DOUBLE AS n, count(*) FILTER (good AND s >= need)::DOUBLE AS k, count(*) FILTER (NOT good AND s >= need) AS caught FROM held, (SELECT unnest(range(1, 7)) AS need) GROUP BY ALL),
tails AS (
    SELECT *, CASE WHEN k >= n * 0.01::DOUBLE THEN 0 ELSE ln(list_sum(list_transform(range(0, k::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01::DOUBLE) + (n - i) * ln(0.99::DOUBLE))))) END AS log_p
    FROM tests
),
steps AS (SELECT *, row_number() OVER (ORDER BY log_p, lang NULLS FIRST, rule, need DESC) AS step, count(*) OVER () AS m FROM tails),
sure AS (SELECT *, caught - 10 * k AS worth FROM (SELECT *, min(CASE WHEN log_p > ln(0.05::DOUBLE / (m - step + 1)) THEN step END) OVER () AS stop FROM steps) WHERE stop IS NULL OR step < stop),
uses AS (SELECT lang, rule, need FROM sure QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY worth DESC, need DESC) = 1 AND worth > 0),
rejected AS (
    SELECT r, string_agg(rule, ',' ORDER BY list_position(['symbols', 'bangs', 'duplicate_lines', 'repeated_words', 'long_words', 'short_words'], rule)) AS rejected_by
    FROM graded g JOIN uses u USING (rule) WHERE g.lang IS NOT DISTINCT FROM u.lang AND s >= need GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM based LEFT JOIN rejected USING (r)
"""
