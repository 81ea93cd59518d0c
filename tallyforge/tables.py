"""Tables that cut lineage: written to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallyforge.tables.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyforge-tables-")
        spark.conf.set("tallyforge.tables.dir", path)
    return f"{path.rstrip('/')}/tallyforge/{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` from a table of its own: what several results need is computed once, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Delete this application's tables, once its results are written elsewhere."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
