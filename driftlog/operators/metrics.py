"""Byte accounting, amplification and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.schemas import ENTRY_BYTES, FOOTER_BYTES, RECORD_HEADER, VALUE_HEADER


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def user_bytes() -> Column:
    return F.octet_length("key") + F.when(F.col("op") == "delete", 0).otherwise(F.octet_length("value"))


def storage_bytes() -> Column:
    """What a write puts on disk: the log record, and the value again in the value log."""
    again = F.when(F.col("op") == "delete", 0).otherwise(VALUE_HEADER + 2 * F.octet_length("value"))
    return RECORD_HEADER + F.octet_length("key") + again


def flush_bytes() -> Column:
    return ENTRY_BYTES + F.octet_length("key")


def accounting(writes: DataFrame) -> DataFrame:
    """Bytes asked for and bytes written, by operation."""
    return writes.groupBy("op").agg(F.count("*").alias("n"), F.sum(user_bytes()).alias("user_bytes"), F.sum(storage_bytes()).alias("storage_bytes"))


def write_amplification(writes: DataFrame, runs: DataFrame) -> DataFrame:
    """Bytes written, with the flushed runs, for each byte asked for."""
    w = writes.agg(F.sum(user_bytes()).alias("user"), F.sum(storage_bytes()).alias("stored"))
    r = runs.agg((F.sum(flush_bytes()) + F.count_distinct("run_seq") * FOOTER_BYTES).alias("flushed"))
    return w.crossJoin(r).select(F.col("user").alias("user_bytes"), (F.col("stored") + F.col("flushed")).alias("storage_bytes"), F.round(ratio(F.col("stored") + F.col("flushed"), F.col("user")), 6).alias("write_amp"))


def ranks(frame: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), blocks: int = 256) -> DataFrame:
    """The value at place floor(n * p) (from 0) of the sorted values, for each p. Exact.

    Values are counted first, then cut into blocks by approximate splitters; the counts of the blocks say
    which of them hold the wanted places, and only those are sorted.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    cuts = counts.agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)])).first()[0] or []
    splitters = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    cut = counts.withColumn("b", F.size(F.filter(splitters, lambda x: x < F.col(value))))
    sizes = cut.groupBy("b").agg(F.sum("c").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = sizes.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n"))
    wanted = n.select(F.explode(F.array(*[F.struct(F.lit(f"p{round(100 * p)}").alias("name"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("at")) for p in shares])).alias("w")).select("w.*")
    holding = sizes.join(wanted, (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("s"))).select("b", "before", "name", "at")  # at most a row for each share
    inside = cut.join(F.broadcast(holding.select("b", "before").distinct()), "b")
    upto = inside.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    hit = upto.join(F.broadcast(holding.select("b", "name", "at")), "b").where("upto > at AND upto - c <= at")
    return hit.select(F.col("name").alias("percentile"), F.col(value).alias("latency"))
