"""Structured Streaming into a store: files or topic messages, micro-batch by micro-batch.

Order is arrival order. A batch becomes one segment, its rows ordered by ``seq``; reads in it are answered
by the writes before them, in the batch and in the store. A batch that Spark delivers again after a failure
is recognised by its stream and its number and not appended twice; another stream numbers its own batches.
"""

from __future__ import annotations

import re
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlog.functions import formats
from driftlog.operators import lww
from driftlog.plans.store import Store

MESSAGES = "topic string, payload string, seq bigint"


def messages_to_ops(messages: DataFrame) -> DataFrame:
    """Topic messages as operations: the topic routes, the payload or the topic names the key."""
    topic, payload, seq = F.col("topic"), F.col("payload"), F.col("seq")
    op = formats.route(topic, payload)
    return messages.select("seq", formats.message_key(topic, payload, seq).alias("key"), op.alias("op"), F.when(op.isin("put", "update"), payload).alias("value"))


class Ingest:
    """A running stream into a store; one at a time.

    ``answers``: a folder for what reads find (``seq, key, found, value``), a part for each batch; ``every``:
    progress is noted whenever so many more messages have come.
    """

    def __init__(self, store: Store, answers: str | None = None, every: int = 0) -> None:
        self.store, self.query, self.answers, self.every = store, None, answers, every
        self.counts = {"put": 0, "update": 0, "delete": 0, "get": 0, "hits": 0, "misses": 0, "batches": 0}
        self.marks: list[dict[str, object]] = []
        self._known = threading.Event()
        self._began = time.monotonic()

    def _answer(self, batch: DataFrame, number: int) -> None:
        """Reads see the writes that stand before them, first those of the batch, then the store's."""
        reads = batch.where("op = 'get'").select("seq", "key")
        first = batch.agg(F.min("seq")).first()[0]
        earlier = self.store.multi_get(reads.select("key")).where("found").select(F.lit(first - 1).cast("bigint").alias("seq"), "key", F.lit("put").alias("op"), "value")
        found = lww.as_of(reads, earlier.unionByName(batch.where("op <> 'get'").select("seq", "key", "op", "value")))
        if self.answers:
            found.write.mode("overwrite").parquet(f"{self.answers}/stream={self.query.id}/batch={number}")
            found = self.store.spark.read.parquet(f"{self.answers}/stream={self.query.id}/batch={number}")
        hits, n = found.agg(F.count_if("found"), F.count("*")).first()
        self.counts["hits"] += hits
        self.counts["misses"] += n - hits

    def _batch(self, batch: DataFrame, number: int) -> None:
        self._known.wait()  # until the stream has its name
        stream, streams = str(self.query.id), self.store.catalog.streams
        if streams.get(stream, -1) >= number:
            return  # delivered again
        seen = {r["op"]: r["count"] for r in batch.groupBy("op").count().collect()}
        if seen.get("get"):
            self._answer(batch, number)
        before = self._messages()
        for op, n in seen.items():
            self.counts[op] += n
        self.counts["batches"] += 1
        if self.every and before // self.every < self._messages() // self.every:
            self.marks.append({"messages": self._messages(), "rate": self._messages() / max(1e-3, time.monotonic() - self._began), **self.counts})
        streams[stream] = number
        base = batch.agg(F.min("seq")).first()[0] or 0  # a segment numbers its rows from where the store stands
        if not self.store.append(batch.withColumn("seq", F.col("seq") - base)):
            self.store._commit("stream", f"batch {number} without writes")

    def _messages(self) -> int:
        return sum(self.counts[k] for k in ("put", "update", "delete", "get"))

    def start(self, ops: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """``trigger``: all there is and then an end (the default), or ``live_trigger``."""
        if self.query is not None and self.query.isActive:
            raise RuntimeError("a stream is already running")
        self._known.clear()
        self._began = time.monotonic()
        writer = ops.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint)
        self.query = writer.trigger(**(trigger or {"availableNow": True})).start()
        self._known.set()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def status(self) -> dict[str, object]:
        running = self.query is not None and self.query.isActive
        return {"running": running, **self.counts, "marks": self.marks, "progress": self.query.lastProgress if self.query is not None else None}


def live_trigger(age_ms: int = 250) -> dict[str, str]:
    """A stream that goes on: what has come is taken when it is so old (how much at once, the source's options say)."""
    return {"processingTime": f"{age_ms} milliseconds"}


def matching(messages: DataFrame, pattern: str) -> DataFrame:
    """Messages whose topic a subscription matches: ``+`` stands for one level, ``#`` at the end for all further ones."""
    levels = pattern.split("/")
    parts = ["[^/]*" if x == "+" else re.escape(x) for x in levels if x != "#"]
    whole = "^" + "/".join(parts) + ("(/.*)?$" if parts else ".*$") if levels[-1] == "#" else "^" + "/".join(parts) + "$"
    return messages.where(F.col("topic").rlike(whole))


def message_files(spark: SparkSession, folder: str, files_per_batch: int = 1, bytes_per_batch: str | None = None) -> DataFrame:
    """A stream over JSON-lines files of messages; a batch takes so many files, or so many bytes of them."""
    source = spark.readStream.schema(MESSAGES)
    return (source.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else source.option("maxFilesPerTrigger", files_per_batch)).json(folder)
