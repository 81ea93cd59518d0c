"""Near duplicates: an n-gram Jaccard join by MinHash banding.

Texts with the same n-gram set are one class, and only classes are compared.
A class's signature is cut into bands; classes that share a band's hash are
candidates. Candidates are verified on their full n-gram sets, block against
block, and what leaves a task is a count of links and one edge per class:
never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import settle, table
from .wordhash import GRAM_BASE, U64, mix, row_grams, words

WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Chance that two texts at the threshold itself share a band.
RECALL = 0.9999
#: Hash functions at most.
HASHES = 128
#: Bits that rows are held against before their texts are shuffled.
FILTER_BITS = 27
#: Classes of a block, and the bytes of its n-gram sets, about.
BLOCK, BLOCK_BYTES = 128, 16 << 20

SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
FOUND = T.StructType([T.StructField("cls", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("linked", T.LongType()), T.StructField("root", T.BinaryType())])
SET = T.StructType([T.StructField("cls", T.BinaryType()), T.StructField("grams", T.BinaryType())])


def choose_bands(threshold: float, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"{most} hashes can't reach a recall of {recall}")
    return best


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per segment: its rows, their distinct n-grams (sorted within a row) and bounds."""
    for w in words(texts):
        grams, bounds = row_grams(w, n)
        own = [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(w.hi - w.lo)]
        yield w.lo, w.hi, np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, n + 1, dtype=U64) * U64(GRAM_BASE)
    return mix(seed) | U64(1), mix(~seed)


def sketch_texts(docs: DataFrame, bands: int, rows: int, *, n: int = WORDS, text: str = "text", into: str = "sketch") -> DataFrame:
    """``docs`` with its number of distinct n-grams, their set's digest, and band hashes (null without words)."""

    @F.arrow_udf(SKETCH)
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, b = _factors(bands * rows)
        for texts in batches:
            sizes = np.zeros(len(texts), np.int64)
            digests: list[bytes | None] = [None] * len(texts)
            hashed: list[np.ndarray | None] = [None] * len(texts)
            for lo, hi, grams, bounds in _sets(texts, n):
                count = np.diff(bounds)
                sizes[lo:hi] = count
                full = np.flatnonzero(count)
                if not len(full):
                    continue
                at = bounds[:-1][full]
                least = np.stack([np.minimum.reduceat(grams * a[k] + b[k], at) for k in range(bands * rows)], axis=1)
                band = np.zeros((len(full), bands), U64)
                for r in range(rows):
                    band = mix(band + least[:, r::rows] + U64(r + 1))
                band = mix(band + np.arange(bands, dtype=U64) * a[0]).view(np.int64)
                for row, of in zip(full.tolist(), band, strict=True):
                    hashed[lo + row] = of
                    digests[lo + row] = _digest(grams[bounds[row] : bounds[row + 1]])
            yield pa.StructArray.from_arrays([pa.array(sizes), pa.array(digests, pa.binary()), pa.array(hashed, pa.list_(pa.int64()))], names=SKETCH.names)

    return docs.withColumn(into, sketch.asNondeterministic()(F.col(text)))


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams, digest_size=16).digest()


def _gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """(cls, grams): the n-gram sets of ``texts`` and their digests."""

    @F.arrow_udf(SET)
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for lo, hi, found, bounds in _sets(texts, n):
                out += [found[bounds[i] : bounds[i + 1]] for i in range(hi - lo)]
            yield pa.StructArray.from_arrays([pa.array(map(_digest, out), pa.binary()), pa.array((x.tobytes() for x in out), pa.binary())], names=SET.names)

    return texts.select(sets.asNondeterministic()(F.col("text")).alias("s")).select("s.*").where(F.octet_length("grams") > 0)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(m), [len(s) for s in sets])[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0])) if len(every) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(every)))
    for f in range(2, 12):  # an element of few sets: its pairs one by one
        at = first[size == f]
        for i in range(f if len(at) else 0):
            for j in range(i + 1, f):
                np.add.at(out, (owner[at + i], owner[at + j]), 1)
    out += out.T
    many = np.flatnonzero(size >= 12)
    for k in range(0, len(many), 2048):  # an element of many: a product of incidence matrices
        some = many[k : k + 2048]
        held = np.zeros((len(some), m), np.float32)
        row = np.repeat(np.arange(len(some)), size[some])
        held[row, owner[np.repeat(first[some], size[some]) + np.arange(len(row)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])]] = 1
        out += (held.T @ held).astype(np.int64)
    return out


def _linked(rows: list[dict], threshold: Fraction) -> list[tuple[bytes, int, int, bytes]]:
    """(class, links, linked documents, smallest class linked to it here) of the members with a link."""
    rows = list({(r["cls"], r["blk"]): r for r in rows}.values())
    keys = sorted({r["cls"] for r in rows})
    code = {k: i for i, k in enumerate(keys)}
    ids = np.array([code[r["cls"]] for r in rows])
    sets = [np.frombuffer(r["grams"], U64) for r in rows]
    if len(rows) < 2:
        return []
    n = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    link = both * threshold.denominator >= (n[:, None] + n[None, :] - both) * threshold.numerator
    link &= ids[:, None] != ids[None, :]
    if rows[0]["lo"] != rows[0]["hi"]:
        blk = np.array([r["blk"] for r in rows])
        link &= blk[:, None] != blk[None, :]
    # A link shares a band, whichever way it is verified; bucket by bucket it counts in the first one.
    bands = np.array([r["bands"] for r in rows])
    i, j = np.nonzero(link)
    same = bands[i] == bands[j]
    link[i, j] = same.any(axis=1) if rows[0]["band"] is None else same.argmax(axis=1) == rows[0]["band"]
    root = ids.copy()
    while True:
        least = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            break
        root = least
    size = np.array([r["size"] for r in rows])
    links = link.sum(axis=1)
    return [(keys[ids[i]], int(links[i]), int(size[link[i]].sum()), keys[root[i]]) for i in np.flatnonzero(links)]


def _verified(members: DataFrame, threshold: Fraction) -> DataFrame:
    """Links within each group (kind, grp, lo, hi) of members."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        found: list[tuple[bytes, int, int, bytes]] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64() if i in (1, 2) else pa.binary()) for i in range(4)], names=FOUND.names)
            found.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["band"], r["grp"], r["lo"], r["hi"])
                if now != key:
                    found.extend(_linked(rows, threshold))
                    key, rows = now, []
                rows.append(r)
            if len(found) >= 10_000:
                yield flush()
        found.extend(_linked(rows, threshold))
        yield flush()

    keys = ["band", "grp", "lo", "hi"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, FOUND)


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose id is one of ``ids``, and some others: those that a bitmap doesn't rule out.

    Before texts are shuffled to be joined, this leaves out most of them. The
    bitmap is broadcast: FILTER_BITS are 16 MB, however many ids there are.
    """
    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - FILTER_BITS) + 1
    held = ids.select(place.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(settle(held, "bitmap")), F.bitmap_bucket_number(place) == F.col("bucket"))
    return found.where(F.getbit(byte, at.bitwiseAND(7)) == 1).select(*rows.columns)


def near_classes(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", n: int = WORDS, threshold: Fraction = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, class_id, copy_of, n_links), one row per row of ``docs``.

    Links join texts whose sets of word n-grams have a Jaccard similarity of at
    least ``threshold``; a text of fewer than n words, but not none, has one
    gram of all of them. class_id is the smallest id that links lead to,
    copy_of the smallest id with the very same set, n_links the number of others
    linked to it. N-grams are compared as 64-bit hashes.

    Null texts and texts without words have no links: their class is their own
    id. Rows with a null id have no links either and a null class. Ids are
    integers. Rows that repeat an id and its n-grams are one; rows of one id with
    other n-grams are in one class, whether they are linked or not, and n_links
    is that of the row's own text: the other pairs (id, set) linked to it.

    A link also shares one of the bands (of pairs at 0.8, all but 7 in 100,000
    by default). Candidate classes are the connected components over shared
    bands. One is verified whole, in blocks of about ``block`` classes, each
    block against each; where its buckets together would send fewer rows than
    that, they are verified bucket by bucket instead. Both ways give the same
    links, so results don't depend on sizes.
    """
    bands, rows = choose_bands(float(threshold), recall)
    sketched = sketch_texts(docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")), bands, rows, n=n)
    sketched = settle(sketched.select("id", "sketch.*"), "sketch")
    usable = sketched.where("id is not null and n > 0").select("id", F.col("digest").alias("cls"), "n", "bands")
    # Ids of several rows, by their sets: few where ids are unique.
    repeated = settle(usable.groupBy("id").count().where("count > 1").select("id"), "repeated")
    again = settle(usable.select("id", "cls").join(repeated, "id").groupBy("id", "cls").agg(F.count("*").alias("rows")), "again")
    classes = usable.groupBy("cls", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    if not again.where("rows > 1").isEmpty():
        classes = classes.join(again.where("rows > 1").groupBy("cls").agg(F.sum(F.col("rows") - 1).alias("extra")), "cls", "left")
        classes = classes.select("cls", "n", "rep", (F.col("size") - F.coalesce("extra", F.lit(0))).alias("size"), "bands")
    classes = settle(classes, "classes")
    # Candidates are told by their smallest ids: classes that share one are candidates too.
    banded = classes.select("rep", F.explode("bands").alias("hash"))
    buckets = settle(banded.groupBy("hash").agg(F.count("*").alias("held"), F.min("rep").alias("head")).where("held > 1"), "buckets")
    edges = banded.join(buckets, "hash").select(F.col("rep").alias("src"), F.col("head").alias("dst"))
    shared_reps = classes.join(repeated.select(F.col("id").alias("rep")), "rep").select("rep").distinct()
    near = connected_components(edges)
    near = near.unionByName(shared_reps.join(near, F.col("rep") == F.col("id"), "left_anti").select(F.col("rep").alias("id"), F.col("rep").alias("component"))).select(F.col("id").alias("rep"), "component")

    of = near.join(classes, "rep")
    of = settle(of, "candidates")
    comps = of.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    comps = comps.withColumn("blocks", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("grams") * 8 / BLOCK_BYTES)).cast("long"))
    large = comps.where("blocks > 1")
    by_bucket = buckets.join(near, F.col("head") == F.col("rep")).groupBy("component").agg(F.sum(F.col("held") * F.ceil(F.col("held") / block)).alias("rows"))
    large = large.join(by_bucket, "component", "left").select("component", "blocks", (F.col("rows") < F.col("m") * F.col("blocks")).alias("bucketwise"))
    plan = settle(large, "large")
    routed = of.join(plan, "component", "left")
    whole = routed.where("not coalesce(bucketwise, false)").select(
        "cls", "size", F.lit(None).cast("int").alias("band"), "bands", F.col("component").alias("grp"), F.coalesce("blocks", F.lit(1)).alias("blocks")
    )
    members = whole
    if not plan.where("bucketwise").isEmpty():
        hot = routed.where("bucketwise").select("cls", "size", "bands", F.posexplode("bands").alias("band", "hash"))
        hot = hot.join(buckets.select("hash", F.ceil(F.col("held") / block).cast("long").alias("blocks")), "hash")
        members = whole.unionByName(hot.select("cls", "size", "band", "bands", F.col("hash").alias("grp"), "blocks"))
    members = members.withColumn("blk", F.pmod(F.xxhash64("cls"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("cls", "size", "band", "bands", "grp", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    reps = of.select(F.col("rep").alias("id")).distinct()
    texts = _likely(docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")), reps).join(reps, "id")
    sets = settle(_gram_sets(texts, n), "sets")
    found = settle(_verified(members.join(sets, "cls"), threshold), "found")

    # An id with several sets joins their classes.
    several = again.groupBy("id").agg(F.min("cls").alias("one"), F.count("*").alias("sets")).where("sets > 1").select("id", "one")
    of_id = again.join(several, "id").select(F.col("cls").alias("src"), F.col("one").alias("dst"))
    joined = settle(connected_components(found.select(F.col("cls").alias("src"), F.col("root").alias("dst")).unionByName(of_id)).select(F.col("id").alias("cls"), "component"), "joined")
    least = joined.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("class_id"))
    joined = joined.join(settle(least, "least"), "component").select("cls", "class_id")
    links = found.groupBy("cls").agg(F.sum("linked").alias("linked"))
    result = classes.join(joined, "cls", "left").join(links, "cls", "left")
    result = settle(result.select(F.col("cls").alias("digest"), "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("linked")), "result")
    out = sketched.select("id", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(result, "digest", "left")
    has = F.col("id").isNotNull()
    return out.select("id", F.when(has, F.coalesce("class_id", "id")).alias("class_id"), F.when(has, F.coalesce("rep", "id")).alias("copy_of"), F.when(has, F.coalesce("linked", F.lit(0))).otherwise(0).alias("n_links"))


def near_dedup(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without all but the document of the smallest id of each class, with all its rows; rows with a null id stay."""
    gone = near_classes(docs, id_=id_, text=text, **options).where("class_id <> id").select(F.col("id").alias(id_)).distinct()
    return docs.join(settle(gone, "gone"), id_, "left_anti")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class and its number of links."""
    return near_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(ws, i, i + 4), ' ')) AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n, bit_xor(gram) AS x, sum(gram::HUGEINT) AS s FROM g GROUP BY 1),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, x, s) AS rep, n FROM n),
r AS (SELECT g.doc_id, gram FROM g JOIN c USING (doc_id) WHERE rep = g.doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 5 * k >= 4 * (a.n + b.n - k)),
reach AS (SELECT rep AS i, rep AS j FROM c UNION SELECT reach.i, l.j FROM reach JOIN l ON l.i = reach.j),
comp AS (SELECT i, min(j) AS class_id FROM reach GROUP BY 1),
size AS (SELECT rep, count(*) AS size FROM c GROUP BY 1),
near AS (SELECT l.i, sum(size) AS linked FROM l JOIN size ON size.rep = l.j GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(c.rep, d.doc_id) AS copy_of, (coalesce(linked, 0) + coalesce(size.size, 1) - 1)::BIGINT AS n_links
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN comp ON comp.i = c.rep LEFT JOIN size ON size.rep = c.rep LEFT JOIN near ON near.i = c.rep
"""
