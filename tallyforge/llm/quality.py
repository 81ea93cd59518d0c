"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole Arrow batches in numpy. The trees are fitted
on a bounded sample of labelled rows and flattened into arrays: all documents
of a batch go down one tree together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, table
from .wordhash import U64, words

#: Labelled rows that the trees are fitted on, at most: those of the smallest hash of their id.
SAMPLE = 20_000
STATISTICS = (
    "bytes_log", "words_log", "word_bytes", "upper", "digit", "symbol", "bar", "bang", "stop", "comma", "line", "high",
    "bytes_a_line", "bytes_a_stop", "words_in_capitals", "words_distinct", "words_repeated", "longest_repeat", "longest_word", "symbols_a_word",
)

#: Classes of bytes.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#$%&*@^~<>{}[]\\/=+_", "bar": b"|", "bang": b"!?", "stop": b".", "comma": b",;:", "line": b"\n"}


def document_statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics (float64) per text; a null or empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    tables = {}
    for name, chars in _CLASSES.items():
        tables[name] = np.zeros(256, bool)
        tables[name][list(chars)] = True
    from .wordhash import string_buffers

    off, data = string_buffers(texts) if len(texts) else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
    for w in words(texts):
        raw = data[off[w.lo] : off[w.hi]]
        total = lambda mask, at=w.offsets: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])
        n, k = np.diff(w.offsets).astype(float), w.counts.astype(float)
        n1, k1 = np.maximum(n, 1), np.maximum(k, 1)
        of = {name: total(t[raw]) for name, t in tables.items()}
        of["high"] = total(raw >= 128)
        rows = w.rows()
        by_row = lambda x, at=w.bounds: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[at])
        size = (w.end - w.start).astype(float)
        same = np.zeros(len(rows), bool)
        if len(rows) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (rows[1:] == rows[:-1])
        marks = np.flatnonzero(~same)
        runs = np.diff(np.append(marks, len(rows)))
        longest_run = np.zeros(len(k))
        longest_word = np.zeros(len(k))
        if len(rows):
            np.maximum.at(longest_run, rows[marks], runs)
            np.maximum.at(longest_word, rows, size)
        key = np.sort((rows.astype(U64) << U64(40)) | (w.hash >> U64(24)))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[fresh] >> U64(40)).astype(np.int64), minlength=len(k)) if len(key) else np.zeros(len(k))
        up = np.concatenate([[0], np.cumsum(tables["upper"][raw], dtype=np.int64)])
        capital = (up[w.end] - up[w.start] == size) & (size > 1)
        columns = {
            "bytes_log": np.log1p(n), "words_log": np.log1p(k), "word_bytes": by_row(size) / k1, **{c: of[c] / n1 for c in (*_CLASSES, "high")},
            "bytes_a_line": n / (of["line"] + 1), "bytes_a_stop": n / (of["stop"] + 1), "words_in_capitals": by_row(capital) / k1, "words_distinct": distinct / k1,
            "words_repeated": by_row(same) / k1, "longest_repeat": longest_run / k1, "longest_word": longest_word, "symbols_a_word": (of["symbol"] + of["bar"] + of["bang"]) / k1,
        }
        out[w.lo : w.hi] = np.stack([columns[c] for c in STATISTICS], axis=1)
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has the children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Boosted trees for the log-odds of y (0 or 1).

    Splits are chosen on histograms of at most ``bins`` quantile bins. Without
    rows the score is 0.5 everywhere, with one class only its share, smoothed.
    """
    inner = 2**depth - 1
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y):
        return none
    share = (y.sum() + 0.5) / (len(y) + 1)
    none.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # x <= e[b] iff bin <= b
    raw = np.full(n, none.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node = at - first
            best, gain = np.full((width, 2), -1), np.full(width, 1e-6)
            for f in range(m):
                if not len(edges[f]):
                    continue
                size = len(edges[f]) + 1
                code = node * size + binned[:, f]
                gs = np.bincount(code, g, width * size).reshape(width, size).cumsum(axis=1)
                hs = np.bincount(code, h, width * size).reshape(width, size).cumsum(axis=1)
                gt, ht, gl, hl = gs[:, -1:], hs[:, -1:], gs[:, :-1], hs[:, :-1]
                won = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                won[(hl < least) | (ht - hl < least)] = 0
                b = won.argmax(axis=1)
                top = won[np.arange(width), b]
                for k in np.flatnonzero(top > gain):
                    gain[k], best[k] = top[k], (f, b[k])
            for k in range(width):
                if best[k, 0] >= 0:
                    feature[first + k], threshold[first + k] = best[k, 0], edges[best[k, 0]][best[k, 1]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + l2) * rate
        raw += leaf[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(none.base, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(id_) -> F.Column:
    """True for the rows whose labels are never learnt from; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees for ``label``, from at most ``sample`` labelled rows that aren't held out.

    The bound is what lets the sampled ids be broadcast and their statistics be
    collected. Rows with a null id or label teach nothing; of repeated labels
    the smallest counts, and of rows that repeat an id the smallest statistics;
    a label without a document is left out.
    """
    usable = labels.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_))).groupBy(F.col(id_).alias("id")).agg(F.min(label).cast("double").alias("y"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(sample)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(list(document_statistics(texts)), pa.list_(pa.float64()))

    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", statistics("text").alias("x"))
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("id")
    return fit(np.array(rows["x"].tolist()).reshape(-1, len(STATISTICS)), rows["y"].to_numpy())


def score_quality(docs: DataFrame, trees: Trees, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 from the text alone; null counts as empty. A column called like ``into`` is replaced."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(trees.score(document_statistics(texts)))

    return docs.withColumn(into, score.asNondeterministic()(F.col(text)))


#: A document is kept from this score on.
KEEP = 0.3


def keep_quality(docs: DataFrame, trees: Trees, *, text: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with their columns."""
    into = free_name(docs, "score")
    return score_quality(docs, trees, text=text, into=into).where(F.col(into) >= least).drop(into)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
