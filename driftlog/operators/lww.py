"""Last write wins: the visible state of a key is its write with the largest sequence number.

Every function here keeps the grouping key first, so a filter on the key reaches the scan. Where a
window over a key (or over everything) would put a hot key into one task, ``running_sum`` and ``as_of``
work in blocks of the order: inside a block with a window, between blocks with one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(writes: DataFrame, priority: Column | str = "seq") -> DataFrame:
    """The winning write of each key, all columns kept. Partial maxima are taken before the shuffle."""
    order = F.col(priority) if isinstance(priority, str) else priority
    rest = [c for c in writes.columns if c != "key"]
    return writes.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("w")).select("key", "w.*")


def live(writes: DataFrame) -> DataFrame:
    """Keys whose newest write is not a delete."""
    return resolve(writes).where("op <> 'delete'")


def tombstones(writes: DataFrame) -> DataFrame:
    return resolve(writes).where("op = 'delete'")


def storage_summary(current: DataFrame) -> DataFrame:
    """Live keys, tombstones and live bytes of a resolved log."""
    alive = F.col("op") != "delete"
    return current.agg(
        F.count_if(alive).alias("live_keys"),
        F.count_if(~alive).alias("tombstones"),
        F.coalesce(F.sum(F.when(alive, F.octet_length("key") + F.octet_length("value"))), F.lit(0)).cast("bigint").alias("live_logical_bytes"),
    )


def point_get(writes: DataFrame, key: str) -> DataFrame:
    """``found`` and ``value`` of one key; the key filter is pushed below the resolution."""
    got = live(writes.where(F.col("key") == key)).agg(F.max("value").alias("value"), F.count("*").alias("n"))
    return got.select(F.lit(key).alias("key"), (F.col("n") > 0).alias("found"), "value")


def multi_get(keys: DataFrame, writes: DataFrame) -> DataFrame:
    """``found`` and ``value`` for each of ``keys`` (one column, ``key``)."""
    return keys.join(live(writes).select("key", "value", F.lit(True).alias("hit")), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def block_of(order: str, size: int) -> Column:
    return F.expr(f"{order} div {size}")


def running_sum(frame: DataFrame, value: Column, order: str, block: Column, keys: list[str], name: str, inclusive: bool = True) -> DataFrame:
    """``frame`` with the sum of ``value`` over earlier rows (and this one) of its key.

    ``block`` must not fall along ``order``; a block of a key, not the whole key, goes to one task.
    """
    rows = frame.withColumns({"_v": value, "_b": block})
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    per_block = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    between = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(*keys, "_b", F.coalesce(F.sum("_s").over(between), F.lit(0)).alias("_before"))
    out = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(starts, [*keys, "_b"])
    return out.withColumn(name, F.col("_before") + F.col("_in")).drop("_v", "_b", "_in", "_before")


def version_rank(writes: DataFrame, block: int = 1 << 20) -> DataFrame:
    """``version``: 1 for a key's first write; ``newest_rank``: 1 for its newest, the others are shadowed.

    Totals reach the writes by key and block, so a hot key is as spread as its blocks are.
    """
    rows = writes.withColumn("_b", block_of("seq", block))
    inside = Window.partitionBy("key", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    per_block = rows.groupBy("key", "_b").agg(F.count("*").alias("_s"))
    every = Window.partitionBy("key")
    between = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("key", "_b", F.coalesce(F.sum("_s").over(between), F.lit(0)).alias("_before"), F.sum("_s").over(every).alias("_n"))
    out = rows.withColumn("_in", F.count("*").over(inside)).join(starts, ["key", "_b"]).withColumn("version", F.col("_before") + F.col("_in"))
    return out.withColumn("newest_rank", F.col("_n") - F.col("version") + 1).drop("_b", "_in", "_before", "_n")


def as_of(reads: DataFrame, writes: DataFrame, block: int = 1 << 20) -> DataFrame:
    """For each read, the last write of its key before it: ``found`` (that write is no delete) and ``value``."""
    both = reads.select("seq", "key", F.lit(None).cast("struct<op:string,value:string>").alias("w")).unionAll(writes.select("seq", "key", F.struct("op", "value").alias("w")))
    both = both.withColumn("_b", block_of("seq", block))
    # a read stands before a write with its own number
    earlier = Window.partitionBy("key", "_b").orderBy("seq", F.col("w").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("last", F.last("w", ignorenulls=True).over(earlier)).where("w IS NULL").drop("w")
    per_block = writes.withColumn("_b", block_of("seq", block)).groupBy("key", "_b").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    # the state in which each block of a key begins; blocks without writes take it over
    begin = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.select("key", "_b").distinct().join(per_block, ["key", "_b"], "left").withColumn("before", F.last("w", ignorenulls=True).over(begin)).drop("w")
    seen = inside.join(blocks, ["key", "_b"], "left").withColumn("s", F.coalesce("last", "before"))
    hit = F.coalesce(F.col("s.op") != "delete", F.lit(False))
    return seen.select("seq", "key", hit.alias("found"), F.when(hit, F.col("s.value")).alias("value"))


def delete_effect(writes: DataFrame, block: int = 1 << 20) -> DataFrame:
    """For each delete, whether the key was live before it: an as-of read by the delete itself."""
    slim = writes.select("seq", "key", "op", F.lit(None).cast("string").alias("value"))
    return as_of(slim.where("op = 'delete'").select("seq", "key"), slim, block).select("seq", "key", F.col("found").alias("was_live"))
