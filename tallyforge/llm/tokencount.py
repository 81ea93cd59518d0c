"""Token counts with a digest cache: only texts never counted before are encoded.

The cache is a Parquet table (digest, n_tokens) by version. The digest is the
SHA-256 of the normalised content, the version that of the tokenizer's file.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, new_path, table

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.StringType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])
#: Words whose counts a worker keeps, and the longest such word.
WORDS, LONGEST = 500_000, 64
#: Characters of text that are cut into words at once.
SLICE = 1 << 20


def normalised(text: Column) -> Column:
    """White space of ASCII becomes blanks; blanks at either end go.

    Only for tokenizers that drop white space: their counts don't change.
    """
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.trim(out)


class Counter:
    """Token counts by a tokenizer's file; with ``by_word`` each distinct word is encoded once.

    ``by_word`` is right where no token, special or not, spans a blank and
    blanks make no tokens: then a text's count is the sum of its words' counts.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_word, self.known = by_word, {"": 0}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: map(len, model.encode(texts, num_threads=1))
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: map(len, model.encode_batch_fast(texts, add_special_tokens=False))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return list(self.encode(texts))
        out, at = [0] * len(texts), 0
        while at < len(texts):  # some texts at once, or a slice of a long one
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            if size <= SLICE:
                for k, n in enumerate(self._sums([t.split(" ") for t in texts[at:end]]), at):
                    out[k] = n
            else:
                out[at] = sum(self._sums([x.split(" ")])[0] for x in self._slices(texts[at]))
            at = end
        return out

    def _slices(self, text: str) -> Iterator[str]:
        """Cut at blanks."""
        at = 0
        while at < len(text):
            end = len(text) if at + SLICE >= len(text) else text.find(" ", at + SLICE)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    def _sums(self, split: list[list[str]]) -> list[int]:
        known = self.known
        missing = list(set(chain.from_iterable(split)).difference(known))
        if not missing:
            return [sum(map(known.__getitem__, w)) for w in split]
        found = dict(zip(missing, self.encode(missing), strict=True))
        if len(known) + len(missing) > WORDS:
            self.known = known = {"": 0}
            found |= dict(zip(rest := list(set(chain.from_iterable(split)).difference(found, known)), self.encode(rest), strict=True))
        known.update((w, n) for w, n in found.items() if len(w) <= LONGEST)
        return [sum(known[x] if x in known else found[x] for x in w) for w in split]


@functools.lru_cache(4)
def load(path: str, by_word: bool) -> Counter:
    return Counter(path, by_word)


def encode_counts(df: DataFrame, path: str, by_word: bool, *, text: str, into: str) -> DataFrame:
    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = load(path, by_word)
        for texts in batches:
            yield pa.array(chain.from_iterable(counter.counts([t or "" for t in texts.slice(k, 512).to_pylist()]) for k in range(0, len(texts), 512)), pa.int64())

    return df.withColumn(into, count.asNondeterministic()(F.col(text)))


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """One row per digest, however often it was stored."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, drops_space: bool, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with a column ``into``: its tokens as the library counts them.

    tokenizer: a file of tokenizers (.json) or sentencepiece (.model).
    cache: the folder of the stored counts; it need not exist. A count stored
    twice, by two writers or a job run again, is read once.
    drops_space: the tokenizer drops white space, so texts that differ only in
    its kind or at their ends share a digest, and words are encoded once each.

    A null text counts as empty, with 0 tokens. Repeated texts, however many,
    are encoded once: they combine before the shuffle, so none is a hot key.
    Other columns are kept. Empty tables leave the cache as it is.
    """
    spark = docs.sparkSession
    version = hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()
    content = normalised(F.col(text)) if drops_space else F.coalesce(F.col(text), F.lit(""))
    misses = docs.select(content.alias("content")).withColumn("digest", F.sha2("content", 256)).groupBy("digest").agg(F.first("content").alias("content"))
    if (stored := _stored(spark, cache, version)) is not None:
        misses = misses.join(stored, "digest", "left_anti")
    counted = encode_counts(misses, tokenizer, drops_space, text="content", into="n_tokens")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").partitionBy("version").parquet(cache)
    digest, found = free_name(docs, "digest"), free_name(docs, "n_found")
    stored = _stored(spark, cache, version)
    if stored is None:  # an empty table, and no cache so far
        stored = spark.createDataFrame([], "digest string, n_tokens bigint")
    counts = stored.select(F.col("digest").alias(digest), F.col("n_tokens").alias(found))
    joined = docs.withColumn(digest, F.sha2(content, 256)).join(counts, digest, "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()), F.col(found).alias(into))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; the cache starts empty, so every distinct text is encoded."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-counts"), drops_space=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
