"""Exact dedup that no hot text can overload.

Equal texts combine first within each task, then within salted groups of their
digest, and last the salts' winners combine. Every stage groups by the digest
and the text or its content itself, so a digest alone never decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, table

#: Parts that a hot digest is split into.
SALTS = 32


def squeezed(text: Column) -> Column:
    """The text without the white space of ASCII; a null text is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\f\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _combined(docs: DataFrame, row: Column, id_: str, text: str, salts: int, with_text: bool) -> DataFrame:
    """One row (digest, best, of, text, n) per distinct content; of: the ``row`` of the best, text: its original text.

    The first two stages group by the original text, which then needs no copy
    beside its key; the last one by the content.
    """
    best = F.struct((-F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("less"), F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.xxhash64(F.col(text)).alias("of_text"))
    # Spark combines a task's rows before it shuffles them: the local stage.
    salted = (
        docs.select(F.col(text).alias("text"), best.alias("best"), row.alias("of"), (F.spark_partition_id() % salts).alias("salt"))
        .select(F.sha2(squeezed(F.col("text")), 256).alias("digest"), "text", "best", "of", "salt")
        .groupBy("digest", "text", "salt")
        .agg(F.min_by("of", "best").alias("of"), F.min("best").alias("best"), F.count("*").alias("n"))
    )
    winner = F.struct("of", (F.col("text") if with_text else F.lit(None).cast("string")).alias("text"))
    content = salted.select("digest", squeezed(F.col("text")).alias("content"), "best", winner.alias("of"), "n")
    won = content.groupBy("digest", "content").agg(F.min_by("of", "best").alias("of"), F.min("best").alias("best"), F.sum("n").alias("n"))
    return won.select("digest", "best", "of.of", "of.text", "n")


def exact_dedup(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts are equal when they are identical without white space; null counts as
    empty. Of equal texts the row with the most code points in the original
    text stays, then that with the smallest id (a null id comes last); of rows
    that tie in both, that with the smallest hash of its text, and of repeated
    rows any one. Columns may have any names.
    """
    others = [c for c in docs.columns if c.lower() != text.lower()]
    kept = _combined(docs, F.struct(*(F.col(f"`{c}`") for c in others)), id_, text, salts, True)
    return kept.select(*(F.col("of").getField(c).alias(c) if c in others else F.col("text").alias(c) for c in docs.columns))


def duplicate_report(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.

    The rule is that of ``exact_dedup``. Rows that repeat both id and text of
    the one that stays are that document: all are marked as kept; its other
    texts aren't. Groups find their rows again by the digest; Spark splits a hot
    one while it joins.
    """
    names = ["keep_id", "group_size", "kept", "text_sha256"]
    digest, own = free_name(docs, "digest"), free_name(docs, "own")
    groups = _combined(docs.select(id_, text), F.lit(None).cast("int"), id_, text, salts, False).select(F.col("digest").alias(digest), F.struct(F.col("best.id").alias("keep_id"), "best.of_text", "n").alias("group_"))
    # The text's own hash is taken before the join, so that no text need be shuffled.
    joined = docs.withColumns({digest: F.sha2(squeezed(F.col(text)), 256), own: F.xxhash64(F.col(text))}).join(groups, digest)
    return joined.select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names),
        F.col("group_.keep_id").alias("keep_id"),
        F.col("group_.n").alias("group_size"),
        (F.col(id_).eqNullSafe(F.col("group_.keep_id")) & (F.col(own) == F.col("group_.of_text"))).alias("kept"),
        F.col(digest).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, dropped ones too."""
    report = duplicate_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
w AS (SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256 FROM w
"""
