"""Benchmark decontamination: benchmark n-grams are found in document texts.

The n-grams of the benchmark, normalised, go to every executor as a hash set
whose size is checked; each document's token windows are probed against it and
every hit is verified on the words themselves. The windows of a benchmark that
is too large for that are joined instead, in one pass over the documents and
with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, joined_sha256, settle, table
from .wordhash import U64, Words, gram_hashes, words

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hits", T.ArrayType(T.IntegerType())),
        T.StructField("clean", T.StringType()),
    ]
)
MARKED = T.StructType([f for f in FOUND if f.name != "items"])
#: Bytes of a set of windows that may be broadcast; a window takes WINDOW_BYTES of it, an item's name NAME_BYTES beside its letters.
BROADCAST_BYTES, WINDOW_BYTES, NAME_BYTES = 64 << 20, 20, 64
#: Beyond that size, windows of documents are first held against so many bits (16 MB, whatever the benchmark's size).
FILTER_BITS = 27
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _windows(w: Words, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, hashes) of all windows of rows that aren't empty: n words, or all of a row with fewer."""
    row, counts = w.rows(), w.counts
    if len(row) >= n:
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        yield n, at, gram_hashes(w.hash, n)[at]
    for k in range(1, n):
        at = w.bounds[:-1][counts == k]
        if len(at):
            yield k, at, gram_hashes(w.hash, k)[at]


class GramSet:
    """The windows of some benchmark items: their words, and sorted hashes that tell item and place of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.names = sorted({x for x, _ in items if x is not None})
        code = {x: i for i, x in enumerate(self.names)}
        codes = np.array([code.get(x, -1) for x, _ in items], np.int32)
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        joined, base = [], 0
        for w in words(pa.array([t or "" for _, t in items], pa.large_string())):
            size = w.end - w.start
            if not len(size):
                continue
            own = np.full(int(size.sum()) + len(size), 32, np.uint8)
            own[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.low[w.low != 0]
            end = np.cumsum(size + 1) - 1 + base
            start = end - size
            row = w.rows()
            for k, at, hashes in _windows(w, n):
                parts.setdefault(k, []).append((hashes, codes[w.lo + row[at]], start[at].astype(np.uint32), end[at + k - 1].astype(np.uint32)))
            joined.append(own.tobytes())
            base += len(own)
        self.text = b"".join(joined)
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for k, found in parts.items():
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            hashes, item, start, end = (x[order] for x in columns)
            keep = np.ones(len(hashes), bool)
            for i in np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])).tolist():
                keep[i + 1] = self.text[start[i] : end[i]] != self.text[start[i + 1] : end[i + 1]]
            self.windows[k] = tuple(x[keep] for x in (hashes, item, start, end))
        self._filters: dict[int, tuple[U64, np.ndarray]] | None = None
        self._told: dict[tuple[int, bytes], tuple[str, ...] | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_filters": None, "_told": {}}

    def filters(self) -> dict[int, tuple[U64, np.ndarray]]:
        """For each size a table by the first bits of a hash: most windows end there."""
        if self._filters is None:
            self._filters = {}
            for k, (hashes, *_) in self.windows.items():
                bits = min(24, max(16, len(hashes).bit_length() + 4))
                self._filters[k] = U64(64 - bits), np.zeros(1 << bits, bool)
                self._filters[k][1][hashes >> U64(64 - bits)] = True
        return self._filters

    def told(self, k: int, hash_: np.uint64, window: bytes) -> tuple[str, ...] | None:
        """The named items that hold the window, or None if none does; by its words."""
        if (k, window) not in self._told:
            if len(self._told) >= 10_000:
                self._told.clear()
            hashes, item, start, end = self.windows[k]
            lo, hi = np.searchsorted(hashes, hash_, "left"), np.searchsorted(hashes, hash_, "right")
            of = [int(item[i]) for i in range(lo, hi) if self.text[start[i] : end[i]] == window]
            self._told[k, window] = tuple(self.names[i] for i in of if i >= 0) if of else None
        return self._told[k, window]

    def scan(self, texts: pa.Array, clean: bool) -> pa.Array:
        items: dict[int, set[str]] = {}
        marked: dict[int, list[tuple[int, int]]] = {}
        for w in words(texts):
            row = w.rows()
            for k, (shift, table_) in self.filters().items():
                h = gram_hashes(w.hash, k)
                at = np.flatnonzero(table_[h >> shift])
                at = at[row[at] == row[at + k - 1]]
                hashes = self.windows[k][0]
                place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                for p in at[hashes[place] == h[at]].tolist():
                    if (names := self.told(k, h[p], w.text(p, k))) is not None:
                        i = int(row[p])
                        marked.setdefault(w.lo + i, []).append((p - int(w.bounds[i]), k))
                        items.setdefault(w.lo + i, set()).update(names)
        out = _marked(texts, marked, clean)
        listed = pa.array([sorted(items.get(i, ())) for i in range(len(texts))], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([out.field("n_words"), out.field("n_hit"), listed, out.field("hits"), out.field("clean")], names=FOUND.names)


def _marked(texts: pa.Array, windows: dict[int, list[tuple[int, int]]], clean: bool) -> pa.StructArray:
    """What the hit windows (first word, size) of some rows make of all rows: the fields of MARKED."""
    n_words = np.zeros(len(texts), np.int64)
    hits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    cleaned: dict[int, str] = {}
    for w in words(texts):
        n_words[w.lo : w.hi] = w.counts
        for i in range(w.lo, w.hi):
            if i in windows:
                inside = np.zeros(int(n_words[i]) + 1, np.int64)
                for p, k in set(windows[i]):
                    inside[p] += 1
                    inside[p + k] -= 1
                hits[i] = np.flatnonzero(np.cumsum(inside))
                if clean and len(hits[i]):
                    cleaned[i] = _without(texts[i].as_py(), w, i - w.lo, hits[i] + w.bounds[i - w.lo])
    out = pa.array([cleaned[i] if i in cleaned else t for i, t in enumerate(texts.to_pylist())], pa.string()) if clean else pa.nulls(len(texts), pa.string())
    return pa.StructArray.from_arrays([pa.array(n_words), pa.array([len(x) for x in hits], pa.int64()), pa.array(hits, pa.list_(pa.int32())), out], names=MARKED.names)


def _without(text: str, w, row: int, marks: list[int]) -> str:
    """The text without its hit spans: from a run's first word to its last."""
    raw, base, out, at = text.encode(), int(w.offsets[row]), [], 0
    runs = np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1)
    for run in runs:
        out.append(raw[at : int(w.start[run[0]]) - base])
        at = int(w.end[run[-1]]) - base
    return b"".join([*out, raw[at:]]).decode()


def _exploded(texts: DataFrame, n: int, sizes: list[int] | None = None, bits: np.ndarray | None = None) -> DataFrame:
    """(key, k, hash, gram, at) of windows of ``texts`` (key, text).

    Without ``sizes`` those of benchmark items; else all runs of so many words
    whose hash ``bits`` doesn't rule out.
    """
    held = texts.sparkSession.sparkContext.broadcast(bits) if bits is not None else None
    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("gram", T.BinaryType()), T.StructField("at", T.IntegerType())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for w in words(batch.column(1)):
                row = w.rows()
                if sizes is None:
                    found = _windows(w, n)
                else:
                    found = []
                    for k in sizes:
                        h = gram_hashes(w.hash, k)
                        place = (h >> U64(64 - FILTER_BITS)).astype(np.int64)
                        at = np.flatnonzero(held.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                        at = at[row[at] == row[at + k - 1]]
                        found.append((k, at, h[at]))
                for k, at, h in found:
                    for lo in range(0, len(at), 20_000):
                        p = at[lo : lo + 20_000]
                        i = row[p]
                        columns = [keys.take(pa.array(i + w.lo)), pa.array(np.full(len(p), k), pa.int32()), pa.array(h[lo : lo + 20_000].view(np.int64)), pa.array([w.text(x, k) for x in p.tolist()], pa.binary()), pa.array(p - w.bounds[i], pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return texts.mapInArrow(explode, kind)


def _joined(docs: DataFrame, bench: DataFrame, n: int, text: str, into: str, clean: bool) -> DataFrame:
    """What a broadcast set would tell, by joins of windows on hash and words.

    One pass over the documents emits the windows that a bitmap of fixed size
    lets through, and equal ones of equal texts combine before the shuffle. The
    benchmark's side of the join holds each window once, so that Spark can
    split a window which very many documents hold.
    """
    spark = docs.sparkSession
    own = settle(_exploded(bench.select(F.col("id").alias("key"), "text"), n).select(F.col("key").alias("item"), "k", "hash", "gram").distinct(), "windows")
    prefix = F.shiftrightunsigned("hash", 64 - FILTER_BITS) + 1
    held = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for bucket, part in own.select(prefix.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v"))).collect():
        held[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
    sizes = sorted(r.k for r in own.select("k").distinct().collect())  # n of them at most
    whole = F.coalesce(F.col(text), F.lit(""))
    found = _exploded(docs.select(F.sha2(whole, 256), whole), n, sizes, held).distinct()
    hits = settle(found.join(own.select("k", "hash", "gram").distinct(), ["k", "hash", "gram"]), "hits")
    items = hits.select("key", "k", "hash", "gram").distinct().join(own.where("item is not null"), ["k", "hash", "gram"]).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = hits.groupBy("key").agg(F.collect_set(F.struct("at", "k")).alias("marks")).join(items, "key", "left")

    @F.arrow_udf(MARKED)
    def finish(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marked in batches:
            yield _marked(texts, {i: [(x["at"], x["k"]) for x in m] for i, m in enumerate(marked.to_pylist()) if m}, clean)

    key, told, m = free_name(docs, "key"), free_name(docs, "told"), free_name(docs, "marked")
    marks = settle(marks.select(F.col("key").alias(key), F.struct("marks", "items").alias(told)), "marks")
    out = docs.withColumn(key, F.sha2(whole, 256)).join(marks, key, "left").withColumn(m, finish.asNondeterministic()(F.col(text), F.col(f"{told}.marks")))
    fields = {"items": F.coalesce(F.col(f"{told}.items"), F.array().cast("array<string>"))}
    return out.withColumn(into, F.struct(*(fields.get(c, F.col(f"{m}.{c}")).alias(c) for c in FOUND.names))).drop(*(c for c in (key, told, m) if c != into))


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 13, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "found", clean: bool = False, max_broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` with a struct column ``into``; a column that is called so is replaced.

    Its fields: n_words, n_hit (words inside any occurrence of a benchmark
    window), items (ids of items with occurring windows, sorted as strings),
    hits (the hit words' positions) and clean (the text without its hit spans,
    if ``clean``).

    A null or empty text has no words. An item of fewer than n words, but not
    none, is one window; items without words match nothing. The windows of an
    item with a null id count as hits, but it is listed nowhere. Repeated items
    count once; repeated documents are judged each. Other columns are kept.

    The size of the set of windows is computed first: up to
    ``max_broadcast_bytes`` it is broadcast, a larger one is joined. Both give
    the same rows.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    n_words = F.regexp_count("text", F.lit(WORD)).cast("long")
    of_item = F.octet_length("text") + n_words + F.greatest(n_words - n + 1, F.lit(1)) * WINDOW_BYTES + F.coalesce(F.octet_length("id"), F.lit(0)) + NAME_BYTES
    if (bench.agg(F.sum(of_item)).first()[0] or 0) > max_broadcast_bytes:
        return _joined(docs, bench, n, text, into, clean)
    grams = spark.sparkContext.broadcast(GramSet([tuple(r) for r in bench.collect()], n))

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield grams.value.scan(texts, clean)

    return docs.withColumn(into, scan.asNondeterministic()(F.col(text)))  # so that it is never run twice for one row


def contaminated(found: str | Column = "found", share: Fraction = Fraction(1, 20)) -> Column:
    """True where hit words are at least ``share`` of a document's words."""
    hit, n = F.col(f"{found}.n_hit"), F.col(f"{found}.n_words")
    return (hit > 0) & (share.denominator * hit >= share.numerator * n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", share: Fraction = Fraction(1, 20), text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or without the hit spans.

    remove: "documents" drops each document whose hit words reach ``share`` of
    its words; "spans" keeps all documents and cuts the hit spans out of the
    text (a null text stays null). The columns are those of ``docs``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    into = free_name(docs, "found")
    scanned = scan_documents(docs, benchmark, text=text, into=into, clean=remove == "spans", **options)
    if remove == "documents":
        return scanned.where(~contaminated(into, share)).select(*(F.col(f"`{c}`") for c in docs.columns))
    return scanned.select(*(F.col(f"{into}.clean").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its hits against the whole benchmark."""
    scanned = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return scanned.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        joined_sha256(F.col("found.items")).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM b WHERE len(ws) > 0)
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS gram
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)
), hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
