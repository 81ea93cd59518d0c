"""Byte-level BPE over whole texts, by a hierarchical-bitmap rank queue.

Within a pre-token, adjacent pairs wait in one bucket for each merge rank; a
bucket holds linked-list positions, lowest first. A two-level bitmap tells the
lowest rank that has a bucket by two find-first-set steps; its words are as
wide as the vocabulary needs. Entries that a merge
has made stale are skipped when they come up. A pre-token of n bytes costs
O(n log n), so one very long run without spaces is no hazard.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

#: Log of the fewest bits that a word of the bitmap has: 2 ** (2 * WORD) ranks fit two levels of such words.
WORD = 8
#: Pre-tokens whose ids a worker keeps (some 200 bytes each), and the longest of them.
#: Where nothing else runs beside encoding, three times as many.
CACHE, ALONE, LONGEST = 500_000, 1_500_000, 64
#: Pre-tokens of a text that are encoded at once.
SLICE = 1 << 16


class Known(dict):
    """Packed ids (int32) by pre-token, of at most ``most`` pre-tokens and a slice's: what isn't there is encoded when it is asked for.

    There are two generations. Once the young one holds half of ``most``, it
    becomes the old one, and what the old one held since its last use is forgotten.
    """

    def __init__(self, merge: Callable[[bytes], tuple[int, ...]], most: int, old: Known | None = None):
        self.merge, self.most, self.old, self.long = merge, most, {} if old is None else old, {}
        if old is not None:
            old.old, old.long = {}, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.pop(piece, None) or self.long.get(piece)
        if packed is None:
            packed = array("i", self.merge(piece.encode())).tobytes()
        (self if len(piece) <= LONGEST else self.long)[piece] = packed
        return packed

    def ready(self) -> Known:
        """For the next slice: long pre-tokens are kept within one only."""
        self.long.clear()
        return self if 2 * len(self) <= self.most else Known(self.merge, self.most, self)


class ByteBPE:
    """Encoder and decoder for a table of token bytes to ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.word = max(WORD, -(-max(ranks.values(), default=0).bit_length() // 2))
        self.bit = [1 << i for i in range(1 << self.word)]
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.known = Known(self.merge, cache)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return (whole,)
        n, wide, bit = len(piece), self.word, self.bit
        mask = (1 << wide) - 1
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                rank[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> wide
                    words[w] = words.get(w, 0) | bit[r & mask]
                    top |= bit[w]
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            low = word & -word
            r = (w << wide) + low.bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                words[w] = word = word ^ low
                if not word:
                    top ^= bit[w]
            if rank[i] != r:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            rank[j] = rank[i] = -1
            h = before[i]
            if k < n:
                before[k] = i
                if (r := get(piece[i : after[k]])) is not None:
                    rank[i] = r
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        w = r >> wide
                        words[w] = words.get(w, 0) | bit[r & mask]
                        top |= bit[w]
            if h >= 0:
                r = rank[h] = get(piece[h:k], -1)
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], h)
                    else:
                        buckets[r] = [h]
                        w = r >> wide
                        words[w] = words.get(w, 0) | bit[r & mask]
                        top |= bit[w]
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def slices(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, some thousand pre-tokens at a time."""
        if len(text) <= SLICE:
            parts = iter([self.pattern.findall(text)])
        else:
            found = self.pattern.finditer(text)
            parts = iter(lambda: [m[0] for m in islice(found, SLICE)], [])
        for part in parts:
            self.known = self.known.ready()
            yield np.frombuffer(b"".join(map(self.known.__getitem__, part)), np.int32)

    def encode(self, text: str) -> list[int]:
        return np.concatenate([np.zeros(0, np.int32), *self.slices(text)]).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(4)
def load(path: str, pattern: str, cache: int = CACHE) -> ByteBPE:
    """From a file of lines "base64 rank"; each worker reads it once."""
    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern, cache)


def encode_texts(docs: DataFrame, path: str, pattern: str, *, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with a column ``into`` of token ids (array<int>).

    A null or empty text has no ids. Every row is encoded for itself, so
    repeated rows and other columns stay as they are; one that is called like
    ``into`` is replaced. No special tokens.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, pattern)
        for texts in batches:
            rows = (np.concatenate([np.zeros(0, np.int32), *bpe.slices(t.as_py() or "")]) for t in texts)
            yield pa.array(rows, pa.list_(pa.int32()))

    return docs.withColumn(into, encode.asNondeterministic()(F.col(text)))


def decode_ids(docs: DataFrame, path: str, pattern: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the bytes (binary) of its ids; null ids give null, none give empty bytes. A column called like ``into`` is replaced."""

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, pattern)
        for rows in batches:
            yield pa.array([None if r is None else bpe.decode(r) for r in rows.to_pylist()], pa.binary())

    return docs.withColumn(into, decode(F.col(ids)))


ROUND_TRIP = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", into: str = "trip") -> DataFrame:
    """``docs`` with the number of ids and the digests of the ids and of what they decode to.

    The same encoder and decoder as above; ids and bytes stay in the task, some
    thousand pre-tokens at a time, and only digests leave it. A column called
    like ``into`` is replaced.
    """

    @F.arrow_udf(ROUND_TRIP)
    def trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, pattern, ALONE)
        names = [b"%d" % i for i in range(len(bpe.bytes_of))]
        for texts in batches:
            counts, ids_hex, text_hex = [], [], []
            for t in texts:
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for packed in bpe.slices(t.as_py() or ""):
                    ids = packed.tolist()
                    of_ids.update((b" " if n and ids else b"") + b" ".join(map(names.__getitem__, ids)))
                    of_text.update(bpe.decode(ids))
                    n += len(ids)
                counts.append(n)
                ids_hex.append(of_ids.hexdigest())
                text_hex.append(of_text.hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=ROUND_TRIP.names)

    return docs.withColumn(into, trip.asNondeterministic()(F.col(text)))


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its number of tokens, and the round trip's digests."""
    path, pattern = vocabulary()
    docs = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return docs.select("doc_id", "trip.n_tokens", "trip.ids_sha256", "trip.decoded_sha256")
