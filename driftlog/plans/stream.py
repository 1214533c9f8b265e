"""Continuous ingestion: the same state as a batch, kept by a streaming aggregate."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share, by the session's checkpoint folder; a local one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="driftlog-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def current_state(ops: DataFrame) -> DataFrame:
    """Last write of each key. Works on a stream too (update or complete mode), where windows do not."""
    return ops.where("op <> 'get'").groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w")).select("key", "w.*")


def stream_state(spark: SparkSession, path: str, to_ops: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The visible state after a stream over the Parquet files at ``path`` has read all there is.

    Each batch writes the keys it changed; the state is the last write of each key over all batches. A
    batch that is delivered again overwrites its own files.
    """
    out, checkpoint = scratch(spark, "stream-state"), scratch(spark, "stream-checkpoint")
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    events = source.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")  # a pattern: one file and a folder of files both match

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = current_state(to_ops(events)).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return current_state(spark.read.schema("key string, seq bigint, op string, value string").parquet(f"{out}/epoch=*"))
