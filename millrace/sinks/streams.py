"""Streams run to the end of what has arrived, and their results as tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The state store that the stateful processors need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temp folder only where that is
    unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"millrace-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def finished(df: DataFrame, name: str = "stream") -> DataFrame:
    """Runs a stream in append mode over all that has arrived and returns what it wrote. Progress and state are kept
    beside it, in the shared folder."""
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(df.schema).parquet(f"{path}/rows")
