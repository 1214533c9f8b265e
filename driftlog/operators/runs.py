"""Immutable sorted runs: what a flush writes, what levels hold, and how compaction and collection use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.operators.lww import resolve, running_sum
from driftlog.schemas import ENTRY_BYTES, VALUE_HEADER


def flush_runs(writes: DataFrame) -> DataFrame:
    """The newest write of each key inside each run (``run_seq``), tombstones included."""
    rest = [c for c in writes.columns if c not in ("key", "run_seq")]
    return writes.groupBy("run_seq", "key").agg(F.max_by(F.struct(*rest), "seq").alias("w")).select("run_seq", "key", "w.*")


def run_metadata(runs: DataFrame) -> DataFrame:
    """First and last key and number of entries of each run."""
    return runs.groupBy("run_seq").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"))


def overlapping(a: DataFrame, b: DataFrame) -> Column:
    return ~((a["max_key"] < b["min_key"]) | (a["min_key"] > b["max_key"]))


def range_overlaps(meta: DataFrame) -> DataFrame:
    """Pairs of runs whose key ranges meet. Metadata has one row for each run, so a theta join is cheap."""
    a, b = meta.alias("a"), meta.alias("b")
    meet = (F.col("a.max_key") >= F.col("b.min_key")) & (F.col("a.min_key") <= F.col("b.max_key"))
    return a.join(b, (F.col("a.run_seq") < F.col("b.run_seq")) & meet).select(F.col("a.run_seq").alias("run_a"), F.col("b.run_seq").alias("run_b"))


def candidate_runs(keys: DataFrame, meta: DataFrame, most: int = 1000) -> DataFrame:
    """For each key, how many runs have it inside their key range.

    Ranges that begin at or before a key, less those that end before it: two as-of counts over the sorted
    bounds. Up to ``most`` runs the bounds are an array in every row; beyond that the bounds cut the keys into
    stretches, in each of which one window runs over the keys and the bounds.
    """
    bounds = meta.agg(F.count("*").alias("n")).first()["n"]
    if bounds <= most:
        ends = meta.agg(F.sort_array(F.collect_list("min_key")).alias("lo"), F.sort_array(F.collect_list("max_key")).alias("hi"))
        at = keys.crossJoin(F.broadcast(ends))  # one row
        begun, over = F.size(F.filter("lo", lambda x: x <= F.col("key"))), F.size(F.filter("hi", lambda x: x < F.col("key")))
        return at.select("key", (begun - over).cast("bigint").alias("candidates"))
    events = keys.select("key", F.lit(1).alias("at"), F.lit(0).alias("v")).unionAll(meta.select("min_key", F.lit(0), F.lit(1))).unionAll(meta.select("max_key", F.lit(2), F.lit(-1)))
    events = events.select("key", "at", "v", F.struct("key", "at").alias("place"))
    cut = blocks_by_range(events, "key")
    # a key counts the ranges that begin up to it; those that end at it end behind it
    counted = running_sum(cut, F.col("v"), "place", F.col("block"), [], "candidates")
    return counted.where("at = 1").select("key", F.col("candidates").cast("bigint").alias("candidates"))


def blocks_by_range(frame: DataFrame, column: str, blocks: int | None = None) -> DataFrame:
    """``frame`` with ``block``: which of about so many stretches of ``column`` a row falls into, by sampled splitters.

    Default: as many as the session has shuffle partitions, 256 to 4096. Splitters are looked up in two steps.
    """
    blocks = blocks or min(4096, max(256, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted({r[column] for r in frame.select(column).where(F.col(column).isNotNull()).sample(min(1.0, 16 * blocks / max(1, frame.count())), seed=1).collect()})
    splitters = cuts[:: max(1, len(cuts) // blocks)]
    if not splitters:
        return frame.withColumn("block", F.lit(0))
    groups = [splitters[i : i + 64] for i in range(0, len(splitters), 64)]
    upto = lambda values: F.size(F.filter(values, lambda x: x <= F.col(column)))
    first = upto(F.array(*[F.lit(g[0]) for g in groups]))
    inside = upto(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), first - 1))
    return frame.withColumn("block", F.when(first > 0, (first - 1) * 64 + inside).otherwise(0))


def retained(meta: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Runs that a compaction of the keys from ``lo`` to ``hi`` leaves as they are."""
    return meta.where(~((F.col("max_key") >= lo) & (F.col("min_key") <= hi)))


def merge_levels(levels: DataFrame) -> DataFrame:
    """One visible row per key out of runs of several levels: the lowest level wins, inside it the newest run."""
    return resolve(levels, F.struct(-F.col("level"), F.col("run_seq")))


def compact(source: DataFrame, target: DataFrame) -> DataFrame:
    """All runs of a level and the runs of the next that they meet, as one; tombstones stay."""
    both = source.withColumn("level", F.lit(0)).unionByName(target.withColumn("level", F.lit(1)))
    return merge_levels(both).drop("level")


def chunks(merged: DataFrame, threshold: int, blocks: int | None = None) -> DataFrame:
    """Which chunk of about ``threshold`` bytes of keys each entry falls into, in key order."""
    size = F.octet_length("key") + ENTRY_BYTES
    cut = running_sum(blocks_by_range(merged.select("key"), "key", blocks), size, "key", F.col("block"), [], "_bytes", inclusive=False)
    return cut.select("key", F.expr(f"_bytes div {threshold}").alias("chunk"))


def value_offsets(writes: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Where each put's value starts in a value log that is written in arrival order."""
    puts = writes.where("op <> 'delete'").select("seq", "key", F.octet_length("value").cast("bigint").alias("length"))
    return running_sum(puts, F.col("length") + VALUE_HEADER, "seq", F.expr(f"seq div {block}"), [], "offset", inclusive=False)


def resolve_pointers(current: DataFrame, log: DataFrame) -> DataFrame:
    """Values behind the pointers (``offset``, ``length``) of live keys; a stored length must agree."""
    at = log.select("offset", F.col("length").alias("stored"), F.col("value").alias("read_value"))
    return current.join(at, "offset").where("stored = length").select("key", "offset", "length", F.col("read_value").alias("value"))


def dead_writes(writes: DataFrame, current: DataFrame) -> DataFrame:
    """Writes that a later write of their key shadows."""
    return writes.join(current.select("seq"), "seq", "left_anti")


def live_pointers(writes: DataFrame, current: DataFrame) -> DataFrame:
    """Writes that are still visible."""
    return writes.where("op <> 'delete'").join(current.where("op <> 'delete'").select("seq"), "seq", "left_semi")


def read_paths(keys: DataFrame, runs: DataFrame, n_runs: int) -> DataFrame:
    """What reading each key newest run first costs with exact filters: runs considered, skipped, searched, values read."""
    newest = runs.groupBy("key").agg(F.max("run_seq").alias("hit"), F.max_by("op", F.struct("run_seq", "seq")).alias("op"))
    probed = keys.join(newest, "key", "left")
    considered = F.when(F.col("hit").isNull(), n_runs).otherwise(n_runs - F.col("hit")).cast("bigint")
    searched = F.col("hit").isNotNull().cast("bigint")
    return probed.select("key", considered.alias("considered"), (considered - searched).alias("skipped"), searched.alias("searched"), F.coalesce(F.col("op") != "delete", F.lit(False)).cast("bigint").alias("value_reads"))
