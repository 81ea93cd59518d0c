"""The stream's transitions are those of the batch."""

import datetime

from pyspark.sql import functions as F

from tallyforge.operators import state
from tallyforge.plans.catalogue import observations
from tallyforge.streaming import state as streaming

SF = "/root/testdata/sf0.001"


def _source(spark, tmp_path):
    o = observations(spark, SF).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "available")
    for i, part in enumerate(o.orderBy("ts", "seq").toPandas().groupby(lambda x: x * 3 // o.count())):
        spark.createDataFrame(part[1].astype({"available": object}), o.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return o, spark.readStream.schema(o.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)


def test_stream_equals_batch(spark, tmp_path):
    o, reader = _source(spark, tmp_path)
    batch = state.transitions(o, ["key"], ["ts", "seq"]).where("is_restock").select("key", "seq")
    q = streaming.transitions_stream(reader.parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("restocks").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("restocks").where("is_restock").select("key", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert spark.table("restocks").count() == o.count()


def test_folded_batches(spark, tmp_path):
    o, reader = _source(spark, tmp_path)
    fold = streaming.fold_batches(f"{tmp_path}/state")
    q = reader.parquet(f"{tmp_path}/in").writeStream.foreachBatch(fold).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = o.groupBy("key").agg(F.max_by("available", F.struct("ts", "seq")).alias("available"))
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/state/state/2").collect())) == sorted(map(str, last.select("key", "available").collect()))
    assert sorted(p.name for p in (tmp_path / "state" / "state").iterdir()) == ["1", "2"]
    again = streaming.fold_batches(f"{tmp_path}/anew", spark.read.parquet(f"{tmp_path}/state/state/2"))
    again(o.limit(0), 0)
    assert spark.read.parquet(f"{tmp_path}/anew/state/0").count() == last.count()
    alerts = [r.seq for i in range(3) for r in spark.read.parquet(f"{tmp_path}/state/alerts/{i}").collect()]
    assert sorted(alerts) == sorted(r.seq for r in state.transitions(o, ["key"], ["ts", "seq"]).where("is_restock").collect())


def test_folded_parts(spark, tmp_path):
    o, reader = _source(spark, tmp_path)
    path = f"{tmp_path}/parted"
    fold, done = streaming.fold_parts(path, parts=8), []

    def twice(batch, batch_id):
        done.append({r.part for r in batch.select(F.pmod(F.xxhash64("key"), F.lit(8)).cast("int").alias("part")).collect()})
        fold(batch, batch_id)
        fold(batch, batch_id)  # a batch that is given again changes nothing

    q = reader.parquet(f"{tmp_path}/in").writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = o.groupBy("key").agg(F.max_by("available", F.struct("ts", "seq")).alias("available"))
    assert sorted(map(str, streaming.parted_state(spark, path).collect())) == sorted(map(str, last.select("key", "available").collect()))
    alerts = [r.seq for i in range(len(done)) for r in spark.read.parquet(f"{path}/alerts/{i}").collect()]
    assert sorted(alerts) == sorted(r.seq for r in state.transitions(o, ["key"], ["ts", "seq"]).where("is_restock").collect())
    one = o.limit(1)
    before = streaming._versions(spark, f"{path}/state")
    fold(one, len(done))
    after = streaming._versions(spark, f"{path}/state")
    assert sum(after[k] != before.get(k) for k in after) == 1, "other parts aren't written"
    assert all(len(v) <= 2 for v in after.values()) and streaming.parted_state(spark, f"{tmp_path}/none").count() == 0


def test_windows_with_late_rows(spark, tmp_path):
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(t(1), "view", 1.0), (t(1, 30), "view", 2.0), (t(9), "view", 1.0)], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/a/0")
    events = spark.readStream.schema("ts timestamp, event_type string, value double").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/a")
    q = streaming.windowed_counts(events).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("windows").collect()] == [(2, 3.0)]
