"""Sources of the operation log: the driver's event table, JSON lines, bulk bodies, and segments with checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions.binary import record_crc
from driftlog.schemas import MAX_FIELD_BYTES, WRITES


def to_ops(events: DataFrame) -> DataFrame:
    """Rows of the ``events`` table, batch or stream, as operations."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "update").otherwise("put")
    key = F.concat(F.lit("user:"), "user_id", F.lit(":"), F.get_json_object("props", "$.k"))
    return events.select(F.col("event_id").alias("seq"), "ts", key.alias("key"), op.alias("op"), F.col("props").alias("value"))


def events_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as an operation log."""
    return to_ops(spark.read.parquet(f"{sf_dir}/events.parquet"))


def writes(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("op").isin(*WRITES))


def with_runs(frame: DataFrame, total: int, runs: int = 8) -> DataFrame:
    """``frame`` with ``run_seq``: its place among ``runs`` equal stretches of the log of ``total`` operations."""
    return frame.withColumn("run_seq", F.expr(f"(seq * {runs}) div {total}"))


def valid_prefix(log: DataFrame, ok: Column) -> DataFrame:
    """Rows before the first bad one: replay never resumes behind damage.

    The place of the first bad row is one aggregate that every task can use, so the log itself isn't shuffled.
    """
    bad = log.where(~ok).agg(F.min("seq").alias("bad_seq"))
    return log.crossJoin(F.broadcast(bad)).where("bad_seq IS NULL OR seq < bad_seq").drop("bad_seq")


def replay_report(log: DataFrame, ok: Column) -> DataFrame:
    """One row: whether the log is damaged, the first bad place, and the last good one before it."""
    first = log.agg(F.min(F.when(~ok, F.col("seq"))).alias("bad_seq"), F.count("*").alias("rows"))
    kept = valid_prefix(log, ok).agg(F.max("seq").alias("safe_seq"), F.count("*").alias("kept"))
    return first.crossJoin(kept).select(F.col("bad_seq").isNotNull().alias("tainted"), "safe_seq", "bad_seq", "kept")


def checked(log: DataFrame) -> Column:
    """Whether a log row with a stored ``crc`` is intact and within the field limit."""
    value = F.when(F.col("op") == "delete", F.lit(None)).otherwise(F.col("value"))
    sizes = (F.octet_length("key") <= MAX_FIELD_BYTES) & (F.coalesce(F.octet_length("value"), F.lit(0)) <= MAX_FIELD_BYTES)
    return sizes & (F.col("crc") == record_crc(F.col("key"), value))


def bulk_records(bodies: DataFrame, body: str = "body", most: int = 500) -> DataFrame:
    """Records of bulk bodies ``{"records": [{"key", "value"}]}``; bodies with more than ``most`` or no valid record give none.

    A record is valid with a non-empty key and a value (which may be empty).
    """
    parsed = F.from_json(body, "records ARRAY<STRUCT<key: STRING, value: STRING>>").getField("records")
    rows = bodies.select("*", parsed.alias("_records")).where(F.size("_records").between(1, most))
    return rows.select(*bodies.columns, F.posexplode("_records").alias("pos", "_r")).where("_r.key <> '' AND _r.value IS NOT NULL").select(*bodies.columns, "pos", F.col("_r.key").alias("key"), F.col("_r.value").alias("value"))


def accepted(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to ingest, rejected rows with a ``reason``)."""
    reason = (
        F.when(F.coalesce(F.col("key"), F.lit("")) == "", "empty key")
        .when(~F.col("op").isin("put", "update", "delete", "get"), "unknown operation")
        .when(F.col("op").isin("put", "update") & F.col("value").isNull(), "missing value")
        .when((F.octet_length("key") > MAX_FIELD_BYTES) | (F.octet_length("value") > MAX_FIELD_BYTES), "field too large")
    )
    judged = ops.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Workload files, one ``{"op", "key"[, "topic"][, "value"]}`` per line."""
    return spark.read.schema("op STRING, key STRING, topic STRING, value STRING").json(path)
