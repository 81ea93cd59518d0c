"""Availability transitions over a stream: a key's last availability is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import transitions

OUTPUT = "key bigint, ts timestamp, seq bigint, previous boolean, available boolean, is_restock boolean"


class LastAvailability(StatefulProcessor):
    """Within a batch a key's observations are put in order; the last one becomes its state. Nothing expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "available boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        have = self.last.get()[0] if self.last.exists() else None
        available = [None if pd.isna(x) else bool(x) for x in seen["available"]]
        previous = [have, *available[:-1]]
        self.last.update((available[-1],))
        yield pd.DataFrame({"key": key[0], "ts": seen["ts"].to_numpy(), "seq": seen["seq"].to_numpy(), "previous": pd.array(previous, dtype="boolean"), "available": pd.array(available, dtype="boolean"), "is_restock": [p is False and a is True for p, a in zip(previous, available, strict=True)]})

    def close(self) -> None:
        pass


def transitions_stream(observations: DataFrame) -> DataFrame:
    """Observations (key, ts, seq, available) with the previous availability and is_restock; needs the RocksDB state store."""
    return observations.groupBy("key").transformWithStateInPandas(LastAvailability(), OUTPUT, "Append", "None")


def fold_batches(path: str, initial: DataFrame | None = None, keep: int = 2):
    """A sink for ``foreachBatch``: each micro-batch (key, ts, seq, available) is folded into a state table under ``path``.

    A key's earlier availability stands before its rows of the batch. A batch
    writes its own version of the state and its own alerts (the restocks), so
    a repeated batch overwrites itself and nothing else. ``initial`` (key,
    available) is the state before batch 0: where a query starts anew, give it
    another ``path`` and the last state of the old one. The last ``keep``
    versions stay, two at least: a repeated batch needs the one before it.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("key", "ts", "seq", "available")
        old = spark.read.parquet(f"{path}/state/{batch_id - 1}") if batch_id else initial
        if old is not None:
            rows = rows.unionByName(old.select("key", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("seq"), "available"))
        rows.groupBy("key").agg(F.max_by("available", F.struct("ts", "seq")).alias("available")).write.mode("overwrite").parquet(f"{path}/state/{batch_id}")
        transitions(rows, ["key"], ["ts", "seq"]).where("is_restock").select("key", "ts", "seq", F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(f"{path}/alerts/{batch_id}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/{batch_id - max(keep, 2)}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return fold


#: Parts of a state table: a batch rewrites only those that hold one of its keys.
PARTS = 256


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions (batch ids) of each part that is there, in order: at most parts times versions kept."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=*/v=*")
    found: dict[int, list[int]] = {}
    for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
        part, v = (int(x.split("=")[1]) for x in status.getPath().toString().split("/")[-2:])
        found.setdefault(part, []).append(v)
    return {k: sorted(v) for k, v in found.items()}


def _read(spark: SparkSession, path: str, chosen: dict[int, int]) -> DataFrame | None:
    paths = [f"{path}/part={k}/v={v}" for k, v in chosen.items()]
    return spark.read.schema("key bigint, available boolean").parquet(*paths) if paths else None


def parted_state(spark: SparkSession, path: str) -> DataFrame:
    """(key, available): the last version of every part that ``fold_parts`` has written under ``path``."""
    last = {k: v[-1] for k, v in _versions(spark, f"{path}/state").items()}
    return _read(spark, f"{path}/state", last) if last else spark.createDataFrame([], "key bigint, available boolean")


def fold_parts(path: str, parts: int = PARTS, keep: int = 2):
    """As ``fold_batches``, for states much larger than a batch: the state is dealt to parts by key, and a batch reads and writes only those of its keys.

    A part's version is named by the batch that wrote it; a repeated batch
    starts from the versions before it and overwrites its own. The last
    ``keep`` versions of a part stay, two at least. Each part is one of the
    batch's groups, whatever the number of its keys; rows of a key combine
    before they are shuffled.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
        rows = batch.select("key", "ts", "seq", "available")
        touched = sorted(r.part for r in rows.select(part.alias("part")).distinct().collect())  # at most ``parts``
        before = {k: [v for v in vs if v < batch_id] for k, vs in _versions(spark, f"{path}/state").items() if k in set(touched)}
        old = _read(spark, f"{path}/state", {k: vs[-1] for k, vs in before.items() if vs})
        known = rows if old is None else rows.unionByName(old.select("key", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("seq"), "available"))
        last = known.groupBy("key").agg(F.max_by("available", F.struct("ts", "seq")).alias("available"))
        last.withColumns({"part": part, "v": F.lit(batch_id)}).write.partitionBy("part", "v").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/state")
        keys = rows.select("key").distinct()
        seen = rows if old is None else rows.unionByName(known.where("seq is null").join(keys, "key", "left_semi"))
        transitions(seen, ["key"], ["ts", "seq"]).where("is_restock").select("key", "ts", "seq", F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(f"{path}/alerts/{batch_id}")
        for k, vs in before.items():
            for v in vs[: -(max(keep, 2) - 1)]:
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/part={k}/v={v}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return fold


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Observations and restocks by event-time window, late rows dropped behind a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
