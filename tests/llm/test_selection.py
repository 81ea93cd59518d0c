"""Importance resampling, hard negatives and quality rules against brute force: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from tallyforge.llm import hardnegatives, importance, qualityrules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(n))


# Importance resampling


def brute_features(text, ngrams):
    w = [x.encode() for x in words(text)]
    return [crc32(b" ".join(w[i : i + n])) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize(("ngrams", "most"), [(1, 1 << 20), (3, 1 << 20), (3, 7), (2, 1)])
def test_features(monkeypatch, ngrams, most):
    monkeypatch.setattr(importance.pieces, "__defaults__", (most,))
    for text in (prose(1, 60), "", "A-b_c Ééß\x85日本 語 x 12ab\x0b\n z", "x" * 50, " lead", "a b", "a"):
        told = list(importance.features(text.encode(), ngrams))
        assert sum(n for n, _ in told) == len(words(text))
        assert sorted(h for _, hashes in told for h in hashes) == sorted(brute_features(text, ngrams))


def brute_importance(docs, target, ngrams, buckets, least, percent):
    counts = []
    for texts in ([t for _, t in docs], target):
        c = [0] * buckets
        for t in texts:
            for h in brute_features(t, ngrams):
                c[h % buckets] += 1
        counts.append(c)
    size = [sum(c) for c in counts]
    gain = [math.floor(1000 * math.log((t + 1) * (size[0] + buckets) / ((s + 1) * (size[1] + buckets)))) for s, t in zip(*counts, strict=True)]
    out = []
    for d, t in docs:
        f = brute_features(t, ngrams)
        weight = sum(gain[h % buckets] for h in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r, rank.get(id(r))) for r in out]


@pytest.mark.parametrize(("ngrams", "percent"), [(1, 10), (2, 100), (3, 37)])
def test_importance(spark, ngrams, percent):
    texts = [None, "", "  ", "one", prose(2, 19), prose(2, 20), prose(3, 5000), *(prose(k, 25) for k in range(60))]
    docs = [*enumerate(texts), (3, prose(9, 30)), (None, prose(10, 30)), (None, None)]
    target = [prose(5, 40), None, "", prose(6, 10)]
    table = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in docs], "doc_id long, text string, score string, most int, drawn int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "body string")
    got = importance.importance_resample(table, wanted, target_text="body", ngrams=ngrams, buckets=50, percent=percent)
    assert got.columns == ["doc_id", "most", "drawn", "n_words", "n_features", "weight", "score", "rank"]
    rows = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(brute_importance(docs, target, ngrams, 50, 20, percent), key=str)


def test_importance_of_ties_and_empty_tables(spark):
    same = spark.createDataFrame([(7, prose(1, 20))] * 9 + [(8, prose(1, 20))] * 2, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.importance_resample(same, same, percent=100).collect())
    assert ranks == list(range(1, 12))
    assert importance.importance_resample(same.limit(0), same).count() == 0
    assert all(r.weight <= 0 for r in importance.importance_resample(same, same.limit(0)).collect())


# Hard negatives


def brute_negatives(rows, is_anchor, n_pos, n_neg, low, high):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [max(-(1 << 62), min(1 << 62, math.floor(256 * x))) for x in v])
        best[i] = min(best.get(i, row), row)
    most = (1 << 63) - 1
    dot = lambda a, b: max(-most, min(most, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for a, (label, v) in best.items():
        if not is_anchor(a):
            continue
        others = sorted(((-dot(v, w), i, other) for i, (other, w) in best.items() if i != a))
        for s, p, _ in [o for o in others if o[2] == label][:n_pos]:
            fits = [o for o in others if o[2] != label and low * -s <= 100 * -o[0] <= high * -s][:n_neg]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, d, labels, spread=0.3, kinds=3):
    r = np.random.default_rng(seed)
    heads = r.normal(size=(kinds, d))
    x = heads[r.integers(0, kinds, n)] + spread * r.normal(size=(n, d))
    return [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(r.integers(0, labels, n), x, strict=True))]


def mined(spark, rows, every, **kw):
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], "vec_id long, embedding array<double>, label int, v string, a int").repartition(4)
    got = hardnegatives.mine_hard_negatives(table, hardnegatives.F.col("id") % every == 0, **kw)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("seed", "d", "labels", "block"), [(1, 16, 3, 1 << 24), (2, 7, 2, 4096), (3, 1, 2, 2048), (4, 33, 4, 9000), (5, 20, 1, 1 << 24)])
def test_negatives(spark, monkeypatch, seed, d, labels, block):
    monkeypatch.setattr(hardnegatives, "BLOCK_BYTES", block)  # small blocks: many meet many
    monkeypatch.setattr(hardnegatives, "TILE", 300)
    rows = vectors(seed, 160, d, labels)
    rows += [(i, label, v) for i, label, v in rows[:40]]  # repeated rows
    rows += [(200 + i, label, rows[5][2]) for i, label, _ in rows[:30]]  # ties
    assert mined(spark, rows, 10) == brute_negatives(rows, lambda i: i % 10 == 0, 5, 3, 50, 95)


def test_negatives_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BLOCK_BYTES", 4096)
    rows = vectors(6, 300, 16, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as large shuffles: blocks stay in partitions of their own
    try:
        assert mined(spark, rows, 10) == brute_negatives(rows, lambda i: i % 10 == 0, 5, 3, 50, 95)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_negatives_of_odd_rows(spark):
    rows = vectors(9, 60, 8, 2)
    odd = [(None, 1, [1.0]), (100, None, [1.0]), (110, 1, None), (120, 1, [None, 1.0]), (130, 0, [float("nan")]), (140, 0, [float("inf"), 1.0]), (150, 1, []), (160, 1, [2.0]), (170, 0, [1.0] * 11), (10, 0, [0.0]), (-20, 1, [1.0, 2.0])]
    for given, kw in ((rows + odd, {}), (rows + odd, {"n_positives": 2, "n_negatives": 1, "low": 0, "high": 100}), (odd, {}), ([(i, k, [0.0] * 4) for i, k, _ in rows], {})):
        want = brute_negatives(given, lambda i: i % 10 == 0, kw.get("n_positives", 5), kw.get("n_negatives", 3), kw.get("low", 50), kw.get("high", 95))
        assert mined(spark, given, 10, **kw) == want
    assert mined(spark, [], 10) == []
    assert mined(spark, [(i, k, v) for i, k, v in rows if i % 10], 10) == []


def test_negatives_beyond_doubles_and_longs(spark):
    for size in (1e5, 3e9, 1e30):
        rows = [(i, k, [size * x for x in v]) for i, k, v in vectors(11, 40, 6, 2)]
        assert mined(spark, rows, 5) == brute_negatives(rows, lambda i: i % 5 == 0, 5, 3, 50, 95)


def test_bounds_hold_and_prune():
    import pyarrow as pa

    rows = vectors(3, 300, 64, 1, spread=0.05, kinds=12)
    whole = np.floor(256 * np.array([v for *_, v in rows])).astype(np.int64)
    means, deviations = hardnegatives.narrow_segments(whole)
    block = pa.table({"id": np.arange(300), "label": np.zeros(300, np.int64), "v": whole.tolist(), "means": means.tolist(), "deviations": deviations.tolist()})
    q = hardnegatives.Vectors.of(block, 64)
    assert [w for w, *_ in q.levels] == [64, 16, 4]
    scores = whole @ whole.T
    low = np.sort(scores, axis=1)[:, -5].astype(float)
    i, j = hardnegatives.open_pairs(q, q, low, np.full(300, np.inf))
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert found >= set(zip(*map(np.ndarray.tolist, np.nonzero(scores >= low[:, None])), strict=True)) and len(found) < 0.3 * 300 * 300
    for width, m, d in q.levels:
        assert (np.abs(scores - width * (m @ m.T)) <= width * (d @ d.T) + 1e-6 * np.abs(scores) + 1).all()


def test_window():
    for low, high in ((50, 95), (0, 100), (33, 34), (90, 10)):
        s = np.array([-5, -1, 0, 1, 2, 7, 99, 100, 101, 12345, (1 << 63) - 1])
        for value, a, b in zip(s.tolist(), *map(np.ndarray.tolist, hardnegatives.window(s, low, high)), strict=True):
            if value >= 0:
                assert a == -(-low * value // 100) and b == high * value // 100
            else:
                assert a > b


# Quality rules


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    held = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for g in windows:
        seen[g] = seen.get(g, 0) + 1
    inside = {k for i, g in enumerate(windows) if seen[g] > 1 for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), text.count("!"), len(held), len(held) - len(set(held)), len(inside))


@pytest.fixture(scope="module")
def texts():
    p = prose(4, 400)
    eight = "a b c d e f g h"
    return [
        None, "", " \n\t\x0b\f\r\n", "x", "x\n", "\nx\nx\n x\n", eight, f"{eight} {eight}", f"{eight} i {eight[2:]}", f"{eight} a b c", "z " * 300, f"{p} {p}", p, prose(5, 20_000), "w w\x85w é日本 \U0001f600\U0001f600",
        "#*$%&|<> !!!", "a\r\nb\r\na\r\n", "\x00 nul \x1c x", "v" * 100_000, f"{eight} {p} {eight} {prose(6, 50)} {eight}", "A!! B!! " * 30,
    ]


def test_statistics(spark, texts):
    table = spark.createDataFrame([(i, t, "s", "w", "h") for i, t in enumerate(texts)], "doc_id int, text string, stats string, words string, hashes string")
    got = qualityrules.text_statistics(table)
    assert set(got.columns) == set(table.columns)
    rows = {r.doc_id: tuple(r.stats) for r in got.collect()}
    assert rows == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    for risk in (0.01, 0.3):
        pairs = [(k, n) for n in (1, 10, 350, 2000) for k in range(0, math.ceil(n * risk) + 1)]
        table = spark.createDataFrame([(k, n) for k, n in pairs], "k long, n long")
        for k, n, got in table.select("k", "n", qualityrules.log_tail(table.k, table.n, risk)).collect():
            want = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if n < 500 else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk)) for i in range(k + 1))
            assert got == pytest.approx(math.log(want) if k < n * risk else 0.0, abs=1e-7)
    # A tail far longer than what is summed.
    table = spark.createDataFrame([(295_000_000, 30_000_000_000)], "k long, n long")
    assert table.select(qualityrules.log_tail(table.k, table.n, 0.01)).first()[0] == pytest.approx(-42110, rel=0.01)


RULES = (qualityrules.Rule("symbols", "n_symbols", "n_words", (500, 200, 50)), qualityrules.Rule("short_words", "word_chars", "n_words", (1500, 2500), low=True))


def brute_rules(docs, labels, risk, error, price, most):
    stats = [brute_statistics(t) for _, t, _ in docs]
    named = dict(zip(qualityrules.STATISTICS, range(7), strict=True))
    failed = [s[0] < 20 or 100 * s[6] > 30 * s[0] for s in stats]

    def beyond(s, rule):
        part, whole = 1000 * s[named[rule.part]], s[named[rule.whole]]
        return sum((part < c * whole) if rule.low else (part > c * whole) for c in rule.cutoffs) if whole else 0

    grades = [[beyond(s, r) for r in RULES] for s in stats]
    good = {}
    for d, q in labels:
        if d is not None and q is not None:
            good[d] = min(good.get(d, q), q)
    held = [(lang, g, good[d] > 0) for (d, _, lang), g, f in zip(docs, grades, failed, strict=True) if not f and d in good]
    sizes = {}
    for lang, _, y in held:
        if lang is not None:
            sizes[lang] = sizes.get(lang, 0) + y
    own = sorted(sizes, key=lambda s: (-sizes[s], s))[:most]
    of = lambda lang: lang if lang in own else None
    tests = []
    for stratum in {of(lang) for lang, *_ in held}:
        mine = [(g, y) for lang, g, y in held if of(lang) == stratum]
        for r, rule in enumerate(RULES):
            for need in range(1, len(rule.cutoffs) + 1):
                n, k = sum(y for _, y in mine), sum(y and g[r] >= need for g, y in mine)
                p = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if k < n * risk else 1
                tests.append((p, stratum is not None, stratum or "", r, -need, sum(not y and g[r] >= need for g, y in mine) - price * k))
    uses = {}
    for step, (p, has, stratum, r, need, worth) in enumerate(sorted(tests)):
        if p > error / (len(tests) - step):
            break
        key = (stratum if has else None, r)
        if worth > 0 and (worth, -need) > uses.get(key, (0, 0)):
            uses[key] = (worth, -need)
    out = []
    for (d, t, lang), s, f, g in zip(docs, stats, failed, grades, strict=True):
        hit = [rule.name for r, rule in enumerate(RULES) if (of(lang), r) in uses and g[r] >= uses[of(lang), r][1]]
        out.append((d, *s, f, hit, not f and not hit))
    return sorted(out, key=str), uses


@pytest.mark.parametrize(("error", "most", "size"), [(0.05, 1000, 700), (0.5, 1, 400), (0.05, 0, 300), (0.05, 1000, 30)])
def test_rules(spark, texts, error, most, size):
    r = random.Random(size)
    docs = [(i, t, "en") for i, t in enumerate(texts)]
    for i in range(100, 100 + size):
        bad = r.random() < 0.3
        w = prose(i, r.randint(18, 40)).split()
        docs.append((i, " ".join(x + "#" * (r.random() < (0.4 if bad else 0.02)) for x in w), r.choice(["en", "en", "de", None])))
    docs += [docs[-1], (None, prose(1, 30), "en"), (None, None, None)]
    labels = [(i, int(docs[i - 100 + len(texts)][1].count("#") < 5)) for i in range(100, 100 + size) if r.random() < 0.9]
    labels += [(None, 1), (5, None), (100, 1), (100, 0), (10**9, 1), *((i, 1) for i in range(len(texts)))]
    table = spark.createDataFrame([(*d, "k", "l") for d in docs], "doc_id long, text string, lang string, kept string, level string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = qualityrules.quality_rules(table, marks, rules=RULES, risk=0.05, error=error, price=3, most_strata=most)
    assert got.columns == ["doc_id", "lang", "level", *qualityrules.STATISTICS, "base_failed", "rejected_by", "kept"]
    want, uses = brute_rules(docs, labels, 0.05, error, 3, most)
    assert sorted((tuple(x[c] for c in ("doc_id", *qualityrules.STATISTICS, "base_failed", "rejected_by", "kept")) for x in got.collect()), key=str) == want
    assert bool(uses) == (size > 30)


def test_rules_without_labels_or_documents(spark, texts):
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed and not r.rejected_by for r in qualityrules.quality_rules(table, marks).collect())
    assert qualityrules.quality_rules(table.limit(0), marks).count() == 0


def test_false_rejections_stay_below_the_risk(spark):
    """On labels that say nothing, cutoffs in use break the bound more seldom than ``error`` allows."""
    r = random.Random(3)
    broken = 0
    for trial in range(5):
        rows = [("s", [sum(r.random() < 0.02 for _ in range(3)) and 1, 0], 1, 0) for _ in range(400)] + [("s", [1, 1], 0, 1)] * 50
        counts = spark.createDataFrame(rows, "stratum string, severity array<int>, good int, bad int")
        used = qualityrules.certified_cutoffs(counts, (qualityrules.Rule("a", "n", "n", (1,)), qualityrules.Rule("b", "n", "n", (1,))), risk=0.02)
        broken += any(x.rule == 0 for x in used.collect())  # its true rate is 6 %
        assert any(x.rule == 1 for x in used.collect())
    assert broken == 0
