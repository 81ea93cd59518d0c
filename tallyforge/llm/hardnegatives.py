"""Hard-negative mining: negatives whose score lies close below that of an anchor's positives.

Every vector is stored with the mean and the deviation of each of its segments.
The product of two segments' means, plus or minus that of their deviations,
bounds their part of the inner product (Cauchy-Schwarz). Pairs are bounded by
wide segments first and by narrow ones where that leaves them open; only what
is then left is scored on whole vectors, in integers.

The anchors are a set of queries against all rows: both are dealt to blocks of
bounded size, and a block of anchors meets a block of rows in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle, table

#: Components of the narrowest segments; each wider level joins so many of the one below.
WIDTH, FANOUT = 4, 4
#: Bytes of vectors in a block of rows or anchors.
BLOCK_BYTES = 16 << 20
#: Pairs that are bounded at once, and the share of them from which whole matrices are cheaper than single pairs.
TILE, DENSE = 1 << 21, 0.1
#: Production parameters: positives of an anchor, negatives of a positive, and the window of their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Components and scores are held within these bounds.
MOST_COMPONENT, MOST_SCORE = 1 << 62, (1 << 63) - 1

SUMMARY = T.StructType([T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("deviations", T.ArrayType(T.DoubleType()))])
PAIR = "anchor_id long, positive_id long, positive_score long"
FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def matrix(lists: pa.ChunkedArray | pa.Array, kind: type, multiple: int = 1) -> np.ndarray:
    """Lists of numbers as rows of one matrix, filled with zeros to the longest (and a multiple)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    most = -(-max(int(sizes.max(initial=0)), 1) // multiple) * multiple
    if len(flat) == len(sizes) * most:
        return flat.reshape(len(sizes), most)
    out = np.zeros((len(sizes), most), kind)
    out[np.arange(most) < sizes[:, None]] = flat
    return out


def narrow_segments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each WIDTH components of each row."""
    parts = v.astype(np.float64).reshape(len(v), v.shape[1] // WIDTH, WIDTH)
    means = parts.mean(axis=2)
    return means, np.sqrt(((parts - means[:, :, None]) ** 2).mean(axis=2))


@dataclass
class Vectors:
    """A block: ids, labels, whole vectors, and segments' means and deviations from wide to narrow."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    levels: list[tuple[int, np.ndarray, np.ndarray]]  # width, means, deviations

    @classmethod
    def of(cls, block: pa.Table, size: int) -> Vectors:
        """From rows with (id, label, v, means, deviations); vectors are filled with zeros to ``size``, as any block they meet."""
        whole = matrix(block["v"], np.int64)
        whole = np.pad(whole, ((0, 0), (0, size - whole.shape[1])))
        means, deviations = (matrix(block[c], np.float64) for c in ("means", "deviations"))
        n = -(-size // WIDTH)
        means, deviations = (np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (means, deviations))
        levels = [(WIDTH, means, deviations)]
        while levels[0][1].shape[1] > 1:
            width, m, d = levels[0]
            m, d = (np.pad(x, ((0, 0), (0, -x.shape[1] % FANOUT))) for x in (m, d))
            m, d = (x.reshape(len(x), x.shape[1] // FANOUT, FANOUT) for x in (m, d))
            mean = m.mean(axis=2)
            levels.insert(0, (width * FANOUT, mean, np.sqrt(np.maximum((d**2 + (m - mean[:, :, None]) ** 2).mean(axis=2), 0))))
        return cls(block["id"].to_numpy(), block["label"].to_numpy(), whole, levels)

    def take(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.whole[at], [(w, m[at], d[at]) for w, m, d in self.levels])

    def __len__(self) -> int:
        return len(self.ids)


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of rows i of a and j of b, some at a time."""
    some = max(1, (TILE * 2) // a.shape[1])
    parts = [np.einsum("ij,ij->i", a[i[k : k + some]], b[j[k : k + some]]) for k in range(0, len(i), some)]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def open_pairs(q: Vectors, x: Vectors, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of q, rows of x) of the pairs whose bounds allow a score from low to high (by row of q), level by level."""
    norm = lambda v: np.sqrt((v.whole.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    slack = 1 + 1e-9 * norm(q) * norm(x)  # for rounding
    keep = at = None
    for (width, mq, dq), (_, mx, dx) in zip(q.levels, x.levels, strict=True):
        if at is None:
            middle, reach = width * (mq @ mx.T), width * (dq @ dx.T) + slack
            now = (middle + reach >= low[:, None]) & (middle - reach <= high[:, None])
            keep = now if keep is None else keep & now
            if np.count_nonzero(keep) <= DENSE * keep.size:
                at = np.nonzero(keep)
        elif len(at[0]):
            i, j = at
            middle, reach = width * _dots(mq, mx, i, j), width * _dots(dq, dx, i, j) + slack
            now = (middle + reach >= low[i]) & (middle - reach <= high[i])
            at = i[now], j[now]
    return at if at is not None else np.nonzero(keep)


def exact_scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs; one beyond 64 bits is held at the nearest long."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1 << 53:  # doubles hold every sum
        a, b = q.astype(np.float64), x.astype(np.float64)
        return ((a @ b.T)[i, j] if len(i) > DENSE * len(q) * len(x) else _dots(a, b, i, j)).astype(np.int64)
    if most < 1 << 63:
        return _dots(q, x, i, j)
    a, b = q.astype(object), x.astype(object)
    return np.array([max(-MOST_SCORE, min(MOST_SCORE, int(a[m] @ b[n]))) for m, n in zip(i, j, strict=True)], np.int64)


def first_of(groups: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, groups))
    own = groups[order]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[rank < most]


def _tiles(q: Vectors, x: Vectors):
    step = max(1, TILE // max(len(x), 1))
    for at in range(0, len(q), step):
        yield slice(at, at + step)


def positives(q: Vectors, x: Vectors, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of each anchor's best others; all rows have the anchors' label."""
    out = []
    for tile in _tiles(q, x):
        part = q.take(tile)
        low = np.full(len(part), -np.inf)
        if len(x) > 2 * (most + 1):
            # The scores of a few likely rows say how low a score still counts.
            width, mq, _ = part.levels[len(part.levels) // 2]
            likely = np.argpartition(-(mq @ x.levels[len(x.levels) // 2][1].T), most, axis=1)[:, : most + 1]
            i = np.repeat(np.arange(len(part)), most + 1)
            told = exact_scores(part.whole, x.whole, i, likely.ravel()).reshape(likely.shape).astype(np.float64)
            told[x.ids[likely] == part.ids[:, None]] = -np.inf
            low = np.sort(told, axis=1)[:, 1]  # at least ``most`` others reach it
        i, j = open_pairs(part, x, low, np.full(len(part), np.inf))
        other = part.ids[i] != x.ids[j]
        i, j = i[other], j[other]
        score = exact_scores(part.whole, x.whole, i, j)
        top = first_of(i, score, x.ids[j], most)
        out.append((i[top] + tile.start, j[top], score[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer n with low * score <= 100 * n <= high * score; none (least above largest) for a negative score."""
    whole, rest = score // 100, score % 100
    least, most = whole * low + -(-rest * low // 100), whole * high + rest * high // 100
    return np.where(score < 0, 1, least), np.where(score < 0, 0, most)


def negatives(q: Vectors, x: Vectors, scores: np.ndarray, known: np.ndarray, most: int, low: int, high: int):
    """Yield (row of q, column of ``scores``, row of x, score) arrays: per positive the first other-label rows in its window.

    ``scores`` holds the positives' scores by anchor, ``known`` where there is one.
    """
    least, largest = window(scores, low, high)
    known = known & (least <= largest)
    least, largest = np.where(known, least, MOST_SCORE), np.where(known, largest, -MOST_SCORE)
    for label in np.unique(q.labels):
        mine, others = np.flatnonzero((q.labels == label) & known.any(axis=1)), np.flatnonzero(x.labels != label)
        if not len(mine) or not len(others):
            continue
        own, rows = q.take(mine), x.take(others)
        for tile in _tiles(own, rows):
            part, lo, hi = own.take(tile), least[mine[tile]], largest[mine[tile]]
            i, j = open_pairs(part, rows, lo.min(axis=1).astype(np.float64), hi.max(axis=1).astype(np.float64))
            score = exact_scores(part.whole, rows.whole, i, j)
            for column in range(scores.shape[1]):
                fits = np.flatnonzero((score >= lo[i, column]) & (score <= hi[i, column]))
                top = fits[first_of(i[fits], score[fits], rows.ids[j[fits]], most)]
                yield mine[tile][i[top]], np.full(len(top), column), others[j[top]], score[top]


def prepare(vectors: DataFrame, *, id_: str, vector: str, label: str) -> DataFrame:
    """(id, label, v, means, deviations) of the rows that take part, written to the shared folder.

    v is floor(256 * x). Rows with a null id, label or vector, or with a null
    or non-finite component, take no part. Of rows that repeat an id the one
    with the smallest label, then the smallest vector counts; repeats combine
    before they are shuffled.
    """

    @F.arrow_udf(SUMMARY)
    def summary(v: pa.Array) -> pa.Array:
        means, deviations = narrow_segments(matrix(v, np.int64, WIDTH))
        rows = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32)), pa.array(m.ravel()))
        return pa.StructArray.from_arrays([rows(means), rows(deviations)], SUMMARY.names)

    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    usable = vectors.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    held = F.transform(x, lambda c: F.greatest(F.least(F.floor(256 * c.cast("double")), F.lit(MOST_COMPONENT)), F.lit(-MOST_COMPONENT)))
    rows = usable.select(F.col(id_).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), held.alias("v")).alias("row"))
    rows = rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")
    return settle(rows.withColumn("s", summary("v")).select("id", "label", "v", "s.means", "s.deviations"), "vectors")


def _dealt(of: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), of.cast("long"))


def _all(of: Column) -> Column:
    """Each block's number: a long as ``_dealt`` gives, since equal keys of other types hash to other partitions."""
    return F.explode(F.sequence(F.lit(0).cast("long"), of.cast("long") - 1))


def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], func, schema: str) -> DataFrame:
    """Each block of anchors with each block of rows; both have the numbers of blocks, a_n and g_n."""
    left = anchors.withColumn("a", _dealt(F.col("a_n"), 1)).withColumn("g", _all(F.col("g_n"))).drop("a_n", "g_n")
    right = rows.withColumn("g", _dealt(F.col("g_n"), 2)).withColumn("a", _all(F.col("a_n"))).drop("a_n", "g_n")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both sides may come from one table
    keys = [*keys, "a", "g"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(func, schema)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, *, id_: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is an expression over ``id`` (and ``label``). Scores are
    integer inner products of floor(256 * x); a vector that is shorter than
    another has zeros there. An anchor's positives are its ``n_positives`` best
    other rows of its label, a positive's negatives the first ``n_negatives``
    rows of other labels with a score of ``low`` to ``high`` hundredths of the
    positive's. Higher scores come first, ties by smaller ids. A positive with
    a negative score has no negatives. See ``prepare`` for rows that take no
    part. Components beyond 2 ** 62 and scores beyond 64 bits are held at these
    bounds. An empty table gives no rows; other columns play no part.

    Exact for every row. The work is anchors times rows; what is sent is each
    block of rows once per block of anchors (of the same label for positives)
    and at most the asked-for rows per anchor and block.
    """
    ready = prepare(vectors, id_=id_, vector=vector, label=label)
    size = ready.agg(F.max(F.size("v"))).first()[0] or 1
    fill = max(1, BLOCK_BYTES // (8 * max(size, 1)))
    tasks = 2 * ready.sparkSession.sparkContext.defaultParallelism
    marked = ready.withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    # Blocks are of bounded size; a small table still makes work for all cores.
    blocks = lambda n, few: F.greatest(F.lit(1), F.ceil(n / fill), F.least(F.lit(few), F.ceil(n / 1024)))
    sizes = marked.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("q"))

    def best(q: pa.Table, x: pa.Table) -> pa.Table:
        own, rows = Vectors.of(q, size), Vectors.of(x, size)
        i, j, score = positives(own, rows, n_positives)
        return pa.table({"anchor_id": own.ids[i], "positive_id": rows.ids[j], "positive_score": score})

    by_label = settle(sizes.where("q > 0").select("label", blocks(F.col("q"), 1).alias("a_n"), blocks(F.col("n"), tasks // 2).alias("g_n")), "labels")
    near = _met(marked.where("anchor").join(by_label, "label").drop("anchor"), marked.join(by_label, "label").drop("anchor"), ["label"], best, PAIR)
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_positives)
    chosen = top.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p")).select(F.col("anchor_id").alias("id"), F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    asked = settle(marked.where("anchor").drop("anchor").join(chosen, "id"), "anchors")

    def mined(q: pa.Table, x: pa.Table) -> pa.Table:
        own, rows = Vectors.of(q, size), Vectors.of(x, size)
        ids, scores = matrix(q["positive_ids"], np.int64), matrix(q["positive_scores"], np.int64)
        known = np.arange(ids.shape[1]) < q["positive_ids"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)[:, None]
        found = list(negatives(own, rows, scores, known, n_negatives, low, high))
        i, column, j, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        return pa.table({"anchor_id": own.ids[i], "positive_id": ids[i, column], "positive_score": scores[i, column], "negative_id": rows.ids[j], "negative_score": score})

    n, q = (ready.count(), asked.count())
    a_n, g_n = max(1, math.ceil(q / fill)), max(1, math.ceil(n / fill), min(tasks, math.ceil(n / 1024)))
    counts = [F.lit(a_n).alias("a_n"), F.lit(g_n).alias("g_n")]
    far = _met(asked.select("*", *counts), ready.select("*", *counts), [], mined, FOUND)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh vector's label is one further."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine_hard_negatives(vectors, F.col("id") % 50 == 0)


OP12_SQL = r"""
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
e AS (SELECT vec_id, label, v FROM usable QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
    FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
