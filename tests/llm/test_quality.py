"""Statistics, fitting and traversal of the quality classifier against plain versions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import quality

CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "symbol": "#$%&*@^~<>{}[]\\/=+_", "bar": "|", "bang": "!?", "stop": ".", "comma": ",;:", "line": "\n"}


def plain_statistics(text):
    text = text or ""
    n = len(text.encode())
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    k, n1, k1 = len(words), max(n, 1), max(len(words), 1)
    size = [len(w.encode()) for w in words]
    of = {c: sum(text.count(x) for x in chars) for c, chars in CLASSES.items()}
    of["high"] = sum(len(c.encode()) for c in text if ord(c) > 127)
    runs, run = [0], 0
    for i, w in enumerate(low):
        run = run + 1 if i and w == low[i - 1] else 1
        runs.append(run)
    capitals = sum(len(w) > 1 and all("A" <= c <= "Z" for c in w) for w in words)
    same = sum(a == b for a, b in zip(low, low[1:], strict=False))
    return [
        math.log1p(n), math.log1p(k), sum(size) / k1, *(of[c] / n1 for c in ("upper", "digit", "symbol", "bar", "bang", "stop", "comma", "line", "high")),
        n / (of["line"] + 1), n / (of["stop"] + 1), capitals / k1, len(set(low)) / k1, same / k1, max(runs) / k1, max(size, default=0), (of["symbol"] + of["bar"] + of["bang"]) / k1,
    ]


def test_statistics():
    r = random.Random(1)
    texts = [None, "", " ", "a", "A AB ABC aB A1", "word word Word\nword. é É ÉÀ 日本語 #$|!?", "x" * 300_000, "..\n\n,;:", "\x00\x7f\x80"]
    texts += ["".join(r.choice("abAB01 .\n|!#é日") for _ in range(r.randint(1, 400))) for _ in range(60)]
    texts.append(" ".join(r.choice(["One", "two", "THREE", "vier."]) for _ in range(80_000)))
    got = quality.document_statistics(pa.array(texts, pa.string()))
    for t, row in zip(texts, got, strict=True):
        np.testing.assert_allclose(row, plain_statistics(t), rtol=1e-12, err_msg=repr((t or "")[:60]))


def plain_fit(x, y, trees, depth, rate, bins, l2, least):
    """Every row at every node, every edge of every feature."""
    n, m = len(x), len(x[0])
    edges = [sorted(set(np.quantile([row[f] for row in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(m)]
    share = (sum(y) + 0.5) / (n + 1)
    base = math.log(share / (1 - share))
    raw, forest = [base] * n, []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in raw]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

        def grow(rows, level):
            sums = lambda some: (math.fsum(g[i] for i in some), math.fsum(h[i] for i in some))
            gt, ht = sums(rows)
            if level == depth:
                return gt / (ht + l2) * rate
            best = (1e-6, None, math.inf)
            for f in range(m):
                for e in edges[f]:
                    gl, hl = sums([i for i in rows if x[i][f] <= e])
                    if hl < least or ht - hl < least:
                        continue
                    won = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    if won > best[0] + 1e-12:
                        best = (won, f, e)
            _, f, e = best
            left = [i for i in rows if f is None or x[i][f] <= e]
            right = [i for i in rows if f is not None and x[i][f] > e]
            return f, e, grow(left, level + 1), grow(right, level + 1)

        tree = grow(list(range(n)), 0)
        forest.append(tree)
        raw = [v + walk(tree, row) for v, row in zip(raw, x, strict=True)]
    return base, forest


def walk(tree, row):
    while isinstance(tree, tuple):
        f, e, left, right = tree
        tree = left if f is None or row[f] <= e else right
    return tree


@pytest.mark.parametrize(("seed", "n", "depth", "bins", "least"), [(1, 80, 3, 8, 1.0), (2, 150, 2, 64, 2.0), (3, 40, 4, 4, 0.5), (4, 60, 3, 8, 1000.0)])
def test_trees(seed, n, depth, bins, least):
    r = random.Random(seed)
    x = [[r.gauss(0, 1), r.choice([0.0, 1.0, 2.0]), 7.0, r.random()] for _ in range(n)]
    y = [int(a[0] + a[1] - 1 + r.gauss(0, 0.7) > 0) for a in x]
    options = {"trees": 6, "depth": depth, "rate": 0.3, "bins": bins, "l2": 1.5, "least": least}
    trees = quality.fit(np.array(x), np.array(y, float), **options)
    base, forest = plain_fit(x, y, **options)
    probe = x + [[r.gauss(0, 2), r.uniform(-1, 3), r.choice([6.0, 8.0]), r.random()] for _ in range(200)]
    want = [1 / (1 + math.exp(-(base + sum(walk(t, row) for t in forest)))) for row in probe]
    np.testing.assert_allclose(trees.score(np.array(probe)), want, rtol=1e-9)
    assert trees.feature.shape == (6, 2**depth - 1) and trees.leaf.shape == (6, 2**depth)


def test_rows_that_teach(spark):
    """Ties, repeats and columns of clashing names: one row an id counts, whatever else the tables hold."""
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'b#d'} " * 20, "x", 1.0, "s") for i in range(60)] * 2 + [(3, "another text", "x", 1.0, "s"), (None, "t", "x", 1.0, "s")], "doc_id long, text string, y string, x double, id string")
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(60)] * 2 + [(3, 0, "t"), (None, 1, "t"), (5, None, "t")], "doc_id long, quality int, text string")
    once = quality.train(docs.dropDuplicates(["doc_id", "text"]), labels.dropDuplicates())
    twice = quality.train(docs, labels)
    x = quality.document_statistics(pa.array(["good " * 20, "b#d " * 20, ""], pa.string()))
    np.testing.assert_allclose(once.score(x), twice.score(x))
    assert twice.score(x)[0] > 0.5 > twice.score(x)[1]
