"""Target-distribution importance resampling over hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks separators in UTF-8, so that
``bytes.split`` yields the words; ``zlib.crc32`` of a word continues from the
hash of the words before it, which extends n-grams without joining strings;
Counters reduce a task's features before anything is shuffled. Only one count a
bucket reaches the driver. Documents are then drawn without replacement by
weight plus Gumbel noise, the noise being a hash of the id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, settle, table

#: Production parameters: words of the longest run, buckets, least words of a document that may be drawn, share that is drawn (in per cent), seed.
NGRAMS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Texts are cut to words in pieces of about so many bytes.
PIECE = 1 << 20
#: Distinct features that a task counts before it folds them into buckets.
MOST_FEATURES = 1 << 19

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WEIGHED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


def pieces(raw: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, piece by piece, so that a very long text isn't held as words."""
    if len(raw) <= most:
        yield raw.translate(_TABLE).split()
        return
    low, at = raw.translate(_TABLE), 0
    while at < len(low):
        end = low.find(b" ", at + most)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def features(raw: bytes, ngrams: int) -> Iterator[tuple[int, list[int]]]:
    """(words, hashes of the runs that end in them) of each piece; a run is hashed as its words joined by one space."""
    before: list[bytes] = []
    for words in pieces(raw):
        fresh, words = len(words), before + words
        old = len(words) - fresh
        hashes = list(map(crc32, words))
        out = hashes[old:]
        spaced = [b" " + w for w in words] if ngrams > 1 else []
        for n in range(2, ngrams + 1):
            hashes = list(map(crc32, spaced[n - 1 :], hashes))
            out += hashes[max(0, old - n + 1) :]
        before = words[max(0, len(words) - ngrams + 1) :] if ngrams > 1 else []
        yield fresh, out


def bucket_counts(docs: DataFrame, *, text: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; a bucket without any has no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Counter()

        def fold() -> None:
            if seen:
                at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
                np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
                seen.clear()

        for batch in batches:
            for t in batch.column(0):
                for _, hashes in features((t.as_py() or "").encode("utf-8", "surrogatepass"), ngrams):
                    seen.update(hashes)
                    if len(seen) > MOST_FEATURES:
                        fold()
        fold()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return docs.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of target to source, smoothed by one a bucket, floored; one row a bucket is collected."""
    both = bucket_counts(docs, text=text, ngrams=ngrams, buckets=buckets).withColumn("kind", F.lit(0)).unionByName(bucket_counts(target, text=target_text, ngrams=ngrams, buckets=buckets).withColumn("kind", F.lit(1)))
    counts = [[0] * buckets, [0] * buckets]
    for bucket, n, kind in both.collect():
        counts[kind][bucket] = n
    source, wanted = map(sum, counts)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(source + buckets) / (float(s + 1) * float(wanted + buckets)))) for s, t in zip(*counts, strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, *, text: str = "text", ngrams: int = NGRAMS, into: str = "weighed") -> DataFrame:
    """``docs`` with a struct ``into`` of n_words, n_features and weight: the floored mean of the gains of a text's features, 0 without any.

    A null text has no words. A column called like ``into`` is replaced.
    """
    buckets = len(gains)

    @F.arrow_udf(WEIGHED)
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.zeros((3, len(texts)), np.int64)
            for i, t in enumerate(texts):
                total = words = n = 0
                for fresh, hashes in features((t.as_py() or "").encode("utf-8", "surrogatepass"), ngrams):
                    words += fresh
                    n += len(hashes)
                    total += int(gains[np.array(hashes, np.int64) % buckets].sum())
                rows[:, i] = words, n, total // n if n else 0
            yield pa.StructArray.from_arrays([pa.array(x) for x in rows], WEIGHED.names)

    return docs.withColumn(into, weighed.asNondeterministic()(F.col(text)))


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the id's hash, floored; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: float, eligible: Column, *, id_: str = "doc_id", score: str = "score", into: str = "rank") -> DataFrame:
    """``scored`` with the rank of each row that is drawn: floor(percent * n / 100) highest scores of the n eligible rows, ties to smaller ids; null for the rest.

    Scores are whole thousandths of logarithms, so there are some 100,000
    different ones at most, whatever the input: how many rows lie above each is
    a small table, and only rows of one score are ordered among themselves.
    Noise spreads even equal texts over scores. Repeated rows rank one after
    another; a null id comes last. ``scored`` is read twice, so it is best a
    settled table. A column called like ``into`` is replaced.
    """
    base, drawn, most = (free_name(scored, c) for c in ("above", "drawn", "most"))
    counted = scored.where(eligible).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    # One row a score: the table that one task orders is bounded by the scores, not by the rows.
    above = F.sum("n").over(Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1))
    levels = counted.select("s", F.coalesce(above, F.lit(0)).alias(base), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("of"))
    levels = levels.withColumn(most, F.floor(F.col("of") * percent / 100)).where(F.col(base) < F.col(most)).select(F.col("s").alias(drawn), base, most)
    joined = scored.join(F.broadcast(levels), eligible & (F.col(score) == F.col(drawn)), "left")
    within = F.row_number().over(Window.partitionBy(drawn).orderBy(F.col(id_).asc_nulls_last()))
    ranked = joined.where(F.col(drawn).isNotNull()).withColumn(into, (F.col(base) + within).cast("long"))
    ranked = ranked.withColumn(into, F.when(F.col(into) <= F.col(most), F.col(into)))
    rest = joined.where(F.col(drawn).isNull()).withColumn(into, F.lit(None).cast("long"))
    columns = [c for c in scored.columns if c.lower() != into.lower()] + [into]
    return ranked.select(*(F.col(f"`{c}`") for c in columns)).unionByName(rest.select(*(F.col(f"`{c}`") for c in columns)))


def importance_resample(docs: DataFrame, target: DataFrame, *, id_: str = "doc_id", text: str = "text", target_text: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: float = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` without their text, with n_words, n_features, weight, score and rank; rank is null for rows that aren't drawn.

    Documents are drawn so that their hashed n-grams follow those of
    ``target``. Features are all runs of 1 to ``ngrams`` words, repeats
    counted. Documents of fewer than ``least_words`` words are never drawn, but
    count in the distribution. Null and empty texts have no words and weight 0;
    an empty target makes every bucket's target share equal. Texts are read
    twice and never shuffled. Columns that are called like new ones give way.
    """
    new = ("n_words", "n_features", "weight", "score", "rank")
    into = free_name(docs, "weighed")
    weighed = weigh(docs, bucket_gains(docs, target, text=text, target_text=target_text, ngrams=ngrams, buckets=buckets), text=text, ngrams=ngrams, into=into)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new and (c.lower() != text.lower())]
    parts = [F.col(into).getField(c).alias(c) for c in new[:3]]
    scored = settle(weighed.select(*kept, *parts, (F.col(into).getField("weight") + gumbel(F.col(id_), seed)).alias("score")), "importance")
    return draw(scored, percent, F.col("n_words") >= least_words, id_=id_)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; rank numbers the tenth that is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 in SQL: the remainder of each byte's table entry, bit by bit, folded over a word's bytes. Only distinct words are hashed.
OP11_SQL = r"""
WITH t8 AS (
    SELECT list(v ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
),
words AS (
    SELECT 0 AS kind, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM documents
    UNION ALL
    SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) FROM benchmark
),
seen AS (SELECT kind, id, w, count(*) AS n FROM words GROUP BY ALL),
hashed AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::BIGINT, 2))::BIGINT)),
                              lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM seen), t8
),
counts AS (
    SELECT b.bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t
    FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN (SELECT kind, bucket, sum(n) AS n FROM seen JOIN hashed USING (w) GROUP BY ALL) USING (bucket) GROUP BY b.bucket
),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM seen JOIN hashed USING (w) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (
    SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents d LEFT JOIN weights USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM ranked) THEN rank END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
