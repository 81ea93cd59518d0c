"""Messages that are sent once: an outbox keyed by run, product and kind, receipts, and slots that receipts set.

A message's key is a digest of run, id and kind. Writing a batch again adds
nothing, and sending again sends only what has no receipt. A receipt is written
when the task that sent is done: where a task is lost between the two, its
messages are sent again under the same keys, by which receivers tell them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import SLOTS

OUTBOX = "key string, run string, id string, kind string, domain string, message string"
RECEIPT = "key string, run string, id string, kind string, ok boolean, error string"
ATTEMPT = f"{RECEIPT}, attempt string"
#: The slot that a delivered message of a kind sets.
SLOT_OF = {"new": SLOTS[0], "restock": SLOTS[1], "new_location": SLOTS[2]}


def message_key(run: Column, id_: Column, kind: Column) -> Column:
    return F.sha2(F.to_json(F.struct(run.alias("run"), id_.alias("id"), kind.alias("kind"))), 256)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def queue_messages(messages: DataFrame, path: str, run: str) -> None:
    """Add messages (id, kind, domain, message) of a run to the outbox; of those with a key that is there already the old one stays."""
    spark = messages.sparkSession
    rows = messages.select(message_key(F.lit(run), F.col("id"), F.col("kind")).alias("key"), F.lit(run).alias("run"), "id", "kind", "domain", "message")
    rows = rows.groupBy("key").agg(F.min(F.struct("run", "id", "kind", "domain", "message")).alias("m")).select("key", "m.*")
    rows.join(_table(spark, f"{path}/outbox", OUTBOX).select("key"), "key", "left_anti").write.mode("append").parquet(f"{path}/outbox")


def deliver(spark: SparkSession, path: str, send: Callable[[str, str], bool]) -> DataFrame:
    """Send what has no receipt by ``send`` (key, message), in the tasks that hold it; return this call's results (RECEIPT).

    A message is delivered if ``send`` returns true. One that fails or raises
    gets a row that isn't ok and stays to be sent; the others go on.
    """
    pending = _table(spark, f"{path}/outbox", OUTBOX).join(_table(spark, f"{path}/receipts", RECEIPT).where("ok").select("key"), "key", "left_anti")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for r in batch.to_pylist():
                try:
                    ok, error = bool(send(r["key"], r["message"])), None
                except Exception as e:  # one message's failure is its own
                    ok, error = False, f"{type(e).__name__}: {e}"
                results.append((r["key"], r["run"], r["id"], r["kind"], ok, error))
            kinds = [pa.string()] * 4 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in results], k) for i, k in enumerate(kinds)], names=["key", "run", "id", "kind", "ok", "error"])

    attempt = uuid.uuid4().hex
    pending.mapInArrow(sent, RECEIPT).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{path}/receipts")
    return _table(spark, f"{path}/receipts", ATTEMPT).where(F.col("attempt") == attempt).drop("attempt")


def with_receipts(state: DataFrame, receipts: DataFrame) -> DataFrame:
    """State products whose slots hold the last run of which a message of that kind was delivered; others stay."""
    per = receipts.where("ok").groupBy("id").agg(*(F.max(F.when(F.col("kind") == k, F.col("run"))).alias(f"_{s}") for k, s in SLOT_OF.items()))
    out = state.join(per, "id", "left")
    newer = {s: F.greatest(F.col(s), F.col(f"_{s}")) for s in SLOT_OF.values()}
    return out.select(*(newer[x].alias(x) if x in newer else F.col(x) for x in state.columns))


def receipts_of(spark: SparkSession, path: str) -> DataFrame:
    """All receipts, one per key: a later success counts."""
    return _table(spark, f"{path}/receipts", RECEIPT).groupBy("key", "run", "id", "kind").agg(F.bool_or("ok").alias("ok"), F.min("error").alias("error"))
