"""Queries over the driver's tables: the event table as an operation log, and generated sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.functions import binary, formats
from driftlog.operators import lww, metrics, runs
from driftlog.package import ship_package
from driftlog.plans import lab, verify, workloads
from driftlog.plans.store import Store
from driftlog.plans.stream import scratch, stream_state
from driftlog.schemas import Limits
from driftlog.sources import oplog
from driftlog.streaming.ingest import messages_to_ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RUNS = 8


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.events_ops(spark, sf_dir)


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.writes(_ops(spark, sf_dir))


def _total(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()  # from the files' footers


def _in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.with_runs(_writes(spark, sf_dir), _total(spark, sf_dir), RUNS)


def _flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flush_runs(_in_runs(spark, sf_dir).select("run_seq", "key", "seq", "op", "value"))


# ---------------------------------------------------------------- visible state


@query
def lww_current(spark, sf_dir):
    return lww.resolve(_writes(spark, sf_dir).select("key", "seq", "op", "value"))


@query
def live_snapshot(spark, sf_dir):
    return lww.live(_writes(spark, sf_dir).select("key", "seq", "op", "value")).select("key", "value")


@query
def tombstone_keys(spark, sf_dir):
    return lww.tombstones(_writes(spark, sf_dir).select("key", "seq", "op")).select("key", F.col("seq").alias("deleted_at"))


@query
def storage_summary(spark, sf_dir):
    return lww.storage_summary(lww_current(spark, sf_dir))


@query
def point_get(spark, sf_dir):
    return lww.point_get(_writes(spark, sf_dir).select("key", "seq", "op", "value"), "user:7:3")


@query
def multi_get(spark, sf_dir):
    keys = _ops(spark, sf_dir).where("op = 'get'").select("key").distinct()
    return lww.multi_get(keys, _writes(spark, sf_dir).select("key", "seq", "op", "value"))


@query
def get_asof(spark, sf_dir):
    reads = _ops(spark, sf_dir).where("op = 'get'").select("seq", "key")
    return lww.as_of(reads, _writes(spark, sf_dir).select("seq", "key", "op", "value"))


@query
def version_rank(spark, sf_dir):
    return lww.version_rank(_writes(spark, sf_dir).select("seq", "key")).select("seq", "key", "newest_rank")


@query
def key_versions(spark, sf_dir):
    return lww.version_rank(_writes(spark, sf_dir).select("seq", "key")).select("seq", "key", "version")


@query
def delete_effect(spark, sf_dir):
    return lww.delete_effect(_writes(spark, sf_dir).select("seq", "key", "op"))


@query
def conversations_latest_turn(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("key"), "turn", "role", "text")
    return lww.resolve(rows, "turn").withColumnRenamed("key", "conv_id")


@query
def stream_lww_current(spark, sf_dir):
    return stream_state(spark, f"{sf_dir}/events.parquet", oplog.to_ops)


# ---------------------------------------------------------------- counts


@query
def op_mix(spark, sf_dir):
    return _ops(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"))


@query
def unique_state_keys(spark, sf_dir):
    return _ops(spark, sf_dir).groupBy("op").agg(F.count_distinct("key").alias("unique_keys"))


@query
def memtable_stats(spark, sf_dir):
    last = _flushed(spark, sf_dir).where(f"run_seq = {RUNS - 1}")
    return last.agg(F.count("*").alias("entries"), F.sum(F.octet_length("key") + 24).alias("bytes"))


@query
def next_run_seq(spark, sf_dir):
    return _in_runs(spark, sf_dir).agg((F.max("run_seq") + 1).alias("next_run_seq"))


@query
def metrics_delta(spark, sf_dir):
    per_run = _in_runs(spark, sf_dir).groupBy("run_seq").agg(F.count("*").alias("writes"), F.sum(metrics.user_bytes()).alias("user_bytes"))
    before = Window.orderBy("run_seq")  # one row for each run
    return per_run.select("run_seq", "writes", (F.col("writes") - F.lag("writes", 1, 0).over(before)).alias("writes_delta"), (F.col("user_bytes") - F.lag("user_bytes", 1, 0).over(before)).alias("user_bytes_delta"))


@query
def byte_accounting(spark, sf_dir):
    return metrics.accounting(_writes(spark, sf_dir))


@query
def write_amp(spark, sf_dir):
    return metrics.write_amplification(_writes(spark, sf_dir), _flushed(spark, sf_dir))


@query
def space_amp(spark, sf_dir):
    w = _writes(spark, sf_dir)
    disk = w.agg(F.sum(metrics.storage_bytes()).alias("disk_bytes"))
    alive = lww.storage_summary(lww.resolve(w.select("key", "seq", "op", "value"))).select("live_logical_bytes")
    return disk.crossJoin(alive).select("disk_bytes", "live_logical_bytes", F.round(metrics.ratio(F.col("disk_bytes"), F.col("live_logical_bytes")), 6).alias("space_amp"))


@query
def latency_percentiles(spark, sf_dir):
    return metrics.ranks(spark.read.parquet(f"{sf_dir}/events.parquet").select("value"), "value")


# ---------------------------------------------------------------- runs and levels


@query
def flush_runs(spark, sf_dir):
    return _flushed(spark, sf_dir).select("run_seq", "key", "seq", "op")


@query
def run_metadata(spark, sf_dir):
    return runs.run_metadata(_flushed(spark, sf_dir))


def _levels(spark, sf_dir) -> DataFrame:
    """Runs 0 to 3 compacted into level 1, runs 4 to 7 in level 0."""
    f = _flushed(spark, sf_dir)
    old = lww.resolve(f.where("run_seq < 4"), F.struct("run_seq", "seq")).withColumn("run_seq", F.lit(0).cast("bigint"))
    return f.where("run_seq >= 4").withColumn("level", F.lit(0)).unionByName(old.withColumn("level", F.lit(1)))


@query
def merge_levels(spark, sf_dir):
    return runs.merge_levels(_levels(spark, sf_dir)).select("key", "seq", "op", "value")


@query
def level_counts(spark, sf_dir):
    return _levels(spark, sf_dir).groupBy("level").agg(F.count_distinct("run_seq").alias("runs"), F.count("*").alias("entries"))


@query
def level_pressure(spark, sf_dir):
    limits = Limits(l0_runs=2, l1_runs=2)
    n = _levels(spark, sf_dir).groupBy("level").agg(F.count_distinct("run_seq").alias("runs"))
    most = F.when(F.col("level") == 0, limits.of_level(0)).otherwise(limits.of_level(1))
    return n.select("level", "runs", F.round(100 * metrics.ratio(F.col("runs"), most), 6).alias("pressure"), (F.col("runs") > most).alias("compacts"))


@query
def compact_l0_l1(spark, sf_dir):
    f = _flushed(spark, sf_dir)
    return runs.compact(f.where("run_seq >= 4"), f.where("run_seq < 4")).select("key", "seq", "op")


@query
def compact_l1_l2(spark, sf_dir):
    f = _flushed(spark, sf_dir)
    upper = runs.compact(f.where("run_seq >= 6"), f.where("run_seq IN (4, 5)"))
    return runs.compact(upper, f.where("run_seq < 4")).select("key", "seq", "op")


@query
def compaction_chunks(spark, sf_dir):
    return runs.chunks(lww.resolve(_writes(spark, sf_dir).select("key", "seq")), 4096).groupBy("chunk").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"))


@query
def range_overlap_runs(spark, sf_dir):
    return runs.range_overlaps(runs.run_metadata(_flushed(spark, sf_dir)))


@query
def range_overlap_chunks(spark, sf_dir):
    """Key ranges of chunks of the merged state against chunks of the newest run: only some meet."""
    cut = compaction_chunks(spark, sf_dir).select((F.col("chunk") + 1_000_000).alias("run_seq"), "min_key", "max_key")
    newest = runs.chunks(_flushed(spark, sf_dir).where("run_seq = 7").select("key"), 4096)
    newest = newest.groupBy(F.col("chunk").alias("run_seq")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return runs.range_overlaps(cut.unionByName(newest)).where("run_a < 1000000 AND run_b >= 1000000").select("run_a", (F.col("run_b") - 1_000_000).alias("run_b"))


@query
def sst_candidates(spark, sf_dir):
    keys = _ops(spark, sf_dir).where("op = 'get'").select("key").distinct()
    return runs.candidate_runs(keys, runs.run_metadata(_flushed(spark, sf_dir)))


def _paths(spark, sf_dir) -> DataFrame:
    keys = _ops(spark, sf_dir).where("op = 'get'").select("key").distinct()
    return runs.read_paths(keys, _flushed(spark, sf_dir), RUNS)


@query
def read_path_stats(spark, sf_dir):
    return _paths(spark, sf_dir)


@query
def read_amp(spark, sf_dir):
    return _paths(spark, sf_dir).agg(F.round(metrics.ratio(F.sum(F.col("searched") + F.col("value_reads")), F.count("*")), 6).alias("read_amp"))


@query
def bloom_effect(spark, sf_dir):
    return _paths(spark, sf_dir).agg(F.sum("considered").alias("considered"), F.sum("skipped").alias("skipped"), F.round(100 * metrics.ratio(F.sum("skipped"), F.sum("considered")), 6).alias("effect"))


def _manifest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Runs on disk, and the runs with even numbers as those that the catalog names, with one that is gone."""
    on_disk = _in_runs(spark, sf_dir).select("run_seq").distinct()
    return on_disk, on_disk.where("run_seq % 2 = 0").unionAll(spark.createDataFrame([(99,)], "run_seq bigint"))


@query
def retained_runs(spark, sf_dir):
    meta = runs.run_metadata(_flushed(spark, sf_dir))
    return runs.retained(meta, F.lit("user:1"), F.lit("user:2")).select("run_seq")


@query
def retained_chunks(spark, sf_dir):
    """Chunks of the merged state that a compaction of one stretch of keys leaves as they are."""
    cut = compaction_chunks(spark, sf_dir)
    return runs.retained(cut, F.lit("user:3"), F.lit("user:6")).select("chunk", "entries")


@query
def orphan_runs(spark, sf_dir):
    disk, named = _manifest(spark, sf_dir)
    return disk.join(named, "run_seq", "left_anti")


@query
def manifest_files(spark, sf_dir):
    disk, named = _manifest(spark, sf_dir)
    return named.join(disk.withColumn("there", F.lit(True)), "run_seq", "left").select("run_seq", F.coalesce("there", F.lit(False)).alias("exists"))


# ---------------------------------------------------------------- value log and collection


@query
def gc_live_pointers(spark, sf_dir):
    w = _writes(spark, sf_dir).select("seq", "key", "op")
    return runs.live_pointers(w, lww.resolve(w)).select("seq", "key")


@query
def gc_dead_bytes(spark, sf_dir):
    w = _writes(spark, sf_dir).select("seq", "key", "op", "value")
    dead = runs.dead_writes(w, lww.resolve(w.select("seq", "key"))).where("op <> 'delete'")
    return dead.agg(F.count("*").alias("dead_values"), F.sum(F.octet_length("value") + 4).alias("dead_bytes"))


@query
def vlog_offsets(spark, sf_dir):
    return runs.value_offsets(_writes(spark, sf_dir)).select("seq", "offset", "length")


@query
def vlog_pointer_resolve(spark, sf_dir):
    w = _writes(spark, sf_dir)
    at = runs.value_offsets(w)
    current = lww.live(w.select("key", "seq", "op")).join(at.select("seq", "offset", "length"), "seq")
    log = at.select("seq", "offset", "length").join(w.select("seq", "value"), "seq")
    return runs.resolve_pointers(current.select("key", "offset", "length"), log)


@query
def wal_replay_prefix(spark, sf_dir):
    return oplog.valid_prefix(_writes(spark, sf_dir), F.col("seq") % 997 != 996).select("seq", "key", "op")


@query
def wal_replay_report(spark, sf_dir):
    return oplog.replay_report(_writes(spark, sf_dir).select("seq"), F.col("seq") % 997 != 996)


# ---------------------------------------------------------------- verification


def _compared(spark, sf_dir) -> DataFrame:
    """Visible state by levels against visible state by sequence number, key by key."""
    a = merge_levels(spark, sf_dir).select("key", F.col("op").alias("op_a"), F.col("value").alias("value_a"), F.lit(True).alias("in_a"))
    b = lww_current(spark, sf_dir).select("key", F.col("op").alias("op_b"), F.col("value").alias("value_b"), F.lit(True).alias("in_b"))
    return a.join(b, "key", "full_outer")


@query
def verify_full_outer(spark, sf_dir):
    live_a, live_b = F.coalesce(F.col("op_a") != "delete", F.lit(False)), F.coalesce(F.col("op_b") != "delete", F.lit(False))
    kind = F.when(live_a & ~live_b, "unexpected").when(~live_a & live_b, "missing").when(live_a & ~F.col("value_a").eqNullSafe(F.col("value_b")), "different").otherwise("same")
    return _compared(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def verify_differences(spark, sf_dir):
    """The state at three quarters of the log against that at its end: every kind of difference, key by key."""
    n = _total(spark, sf_dir)
    w = _writes(spark, sf_dir).select("key", "seq", "op", "value")
    kind, both = verify.differences(lww.live(w), lww.live(w.where(F.col("seq") < n * 3 // 4)))
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def verify_domain(spark, sf_dir):
    current = lww_current(spark, sf_dir)
    model, deleted = current.where("op <> 'delete'").select("key"), current.where("op = 'delete'").select("key")
    return model.union(deleted).agg(F.count("*").alias("checks"), F.count_distinct("key").alias("keys"))


# ---------------------------------------------------------------- generated sequences and formats


@query
def iot_bulk_keys(spark, sf_dir):
    i = F.col("id")
    return spark.range(10000).select("id", formats.bulk_key(i, 100).alias("key"), F.when(i % 97 == 0, "alert").otherwise("normal").alias("status"))


@query
def iot_bulk_payloads(spark, sf_dir):
    return spark.range(10000).select("id", formats.bulk_payload(F.col("id"), 100).alias("payload"))


def _stream(spark, mode: str) -> DataFrame:
    return workloads.stream_ops(spark, mode, 10_000, 100)


@query
def stream1_ops(spark, sf_dir):
    return _stream(spark, "stream1").select("seq", "op", "key", "value")


@query
def stream2_ops(spark, sf_dir):
    """Without the deletes, whose keys depend on all that came before (``stream2_deletes``)."""
    return _stream(spark, "stream2").where("op <> 'delete'").select("seq", "op", "key", "value")


@query
def stream2_deletes(spark, sf_dir):
    """Each delete takes a telemetry key that is still alive: none twice, none before it was written."""
    ops = _stream(spark, "stream2")
    gone = ops.where("op = 'delete'").select("key", F.col("seq").alias("gone"))
    made = ops.where("op = 'put'").select("key", "seq")
    return gone.join(made, "key").agg(F.count("*").alias("deletes"), F.count_distinct("key").alias("keys"), F.count_if(F.col("gone") > F.col("seq")).alias("later"))


@query
def bulk_bodies(spark, sf_dir):
    """Events in bulk bodies of up to 600 records of one user, of which those with more than 500 are refused."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"))
    record = F.struct(F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("e"), "event_id")).otherwise("").alias("key"), F.when(F.col("event_id") % 5 != 0, F.col("k")).alias("value"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", record.alias("r")))), lambda x: x["r"])
    bodies = events.groupBy((F.col("user_id") % 20).alias("body_id"), F.expr("event_id div 10000").alias("part")).agg(F.to_json(F.struct(rows.alias("records"))).alias("body"))
    return oplog.bulk_records(bodies).select("body_id", "part", F.col("pos").cast("bigint").alias("pos"), "key", "value")


@query
def display_formats(spark, sf_dir):
    n = F.col("seq") * 7919
    return _ops(spark, sf_dir).select("seq", formats.display_bytes(F.when(F.col("seq") % 3 == 0, F.col("seq")).otherwise(n * 4000)).alias("size"), formats.display_number(n).alias("number"), formats.display_factor(F.col("seq") / 64).alias("factor"))


@query
def json_report(spark, sf_dir):
    """Byte accounting by operation as JSON texts."""
    n = metrics.accounting(_writes(spark, sf_dir))
    share = metrics.ratio(F.col("storage_bytes"), F.col("user_bytes"))
    text = formats.json_object(op=formats.json_text(F.concat(F.lit('the "'), "op", F.lit('"'))), n=formats.json_whole(F.col("n")), amplification=formats.json_decimal(F.floor(share * 100) / 100), deletes=formats.json_flag(F.col("op") == "delete"))
    return n.select("op", text.alias("report"))


@query
def run_paths(spark, sf_dir):
    paths = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("wal_"), "id")).otherwise(F.format_string("data/sst_%06d.sst", F.col("id") * 13)).alias("path"))
    return paths.select("id", formats.sequence_of_path(F.col("path")).alias("run_seq"))


@query
def record_round_trip(spark, sf_dir):
    """Writes as bytes of log records, read back; one in a hundred with a byte changed."""
    value = F.when(F.col("op") != "delete", F.col("value"))
    raw = _writes(spark, sf_dir).select("seq", binary.record_bytes(F.col("key"), value).alias("raw"))
    raw = raw.withColumn("raw", F.when(F.col("seq") % 100 == 0, F.concat(F.expr("substring(raw, 1, octet_length(raw) - 1)"), F.unhex(F.lit("FF")))).otherwise(F.col("raw")))
    got = raw.select("seq", binary.parsed_record(F.col("raw")).alias("r"))
    return got.select("seq", *[F.when(F.col("r.intact"), F.col(f"r.{c}")).alias(c) for c in ("key", "value")], F.col("r.intact").alias("intact"))


@query
def sensor_formula(spark, sf_dir):
    i = F.col("id")
    return spark.range(10000).select("id", F.round(formats.sensor(i, 20, 37, 1700, 100), 2).alias("temperature_c"), F.round(formats.sensor(i, 0.15, 17, 900, 1000), 3).alias("vibration_g"), F.round(formats.sensor(i, 218, 29, 900, 100), 2).alias("voltage_v"))


@query
def stream2_math(spark, sf_dir):
    return spark.range(10000).select("id", formats.op_of_bucket(F.col("id") % 100).alias("op"), formats.spread_device("id", 100).alias("device"), formats.family("id").alias("family"))


@query
def hash_order(spark, sf_dir):
    h = formats.order_hash(F.col("id"))
    return spark.range(5000).select("id", h.alias("h"), F.row_number().over(Window.orderBy(h, "id")).cast("bigint").alias("place"))


@query
def bloom_sizing(spark, sf_dir):
    n = F.col("n")
    bits = binary.bloom_bits(n, 0.01)
    return spark.range(1, 101).select((F.col("id") * 100).alias("n")).select("n", bits.alias("bits"), binary.bloom_hashes(n, 0.01).alias("hashes"), F.expr("0").alias("_")).drop("_").withColumn("bytes", F.expr("(bits + 7) div 8"))


@query
def range_expand(spark, sf_dir):
    specs = spark.createDataFrame([("1..5",), ("9..7",), ("a..3",), ("0..30000",), ("4",)], "spec string")
    return specs.select("spec", F.explode(formats.expand_range(F.col("spec"))).alias("id"))


@query
def sample_keys(spark, sf_dir):
    n = _total(spark, sf_dir)
    return _ops(spark, sf_dir).where(F.col("seq").isin(0, n // 2, n - 1)).select("seq", "key", "op")


@query
def trace_tail(spark, sf_dir):
    return _ops(spark, sf_dir).orderBy(F.desc("seq")).limit(200).select("seq", F.concat_ws(" | ", "op", "key").alias("line"))


def _messages(spark, sf_dir) -> DataFrame:
    """The event table as topic messages."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "query").when(F.col("event_type") == "click", "state/status:health").otherwise("telemetry")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.concat(F.lit("factory/site_a/device/"), "user_id", F.lit("/"), kind).alias("topic"), F.col("props").alias("payload"))


@query
def topic_route(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy(formats.route(F.col("topic"), F.col("payload")).alias("op")).agg(F.count("*").alias("n"))


@query
def stable_suffix(spark, sf_dir):
    return _messages(spark, sf_dir).select("seq", formats.stable_suffix(F.col("topic"), F.col("payload"), F.col("seq")).alias("suffix"))


@query
def bridge_key(spark, sf_dir):
    """Keys of messages whose payloads hold, in turn, no field, a name, an empty name with another, a target, or a number."""
    m, k = _messages(spark, sf_dir), F.get_json_object("payload", "$.k")
    fields = lambda *named: F.to_json(F.struct(*[v.alias(n) for n, v in named]))
    payload = (
        F.when(F.col("seq") % 5 == 0, F.col("payload"))
        .when(F.col("seq") % 5 == 1, fields(("storage_key", F.concat(F.lit("s"), k))))
        .when(F.col("seq") % 5 == 2, fields(("storage_key", F.lit("")), ("key", F.concat(F.lit("k"), k))))
        .when(F.col("seq") % 5 == 3, fields(("target_key", F.concat(F.lit("t"), k)), ("event_id", F.concat(F.lit("e"), k))))
        .otherwise(fields(("sequence", F.col("seq"))))
    )
    return m.select("seq", formats.message_key(F.col("topic"), payload, F.col("seq")).alias("key"))


@query
def json_fields(spark, sf_dir):
    props = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    k = F.get_json_object("props", "$.k")
    return props.select("event_id", k.alias("k_text"), k.try_cast("bigint").alias("k_int"), F.array_contains(F.json_object_keys("props"), "k").alias("has_k"), F.coalesce(F.get_json_object("props", "$.missing").try_cast("bigint"), F.lit(-1)).alias("missing_int"))


@query
def record_crc(spark, sf_dir):
    w = _writes(spark, sf_dir)
    value = F.when(F.col("op") != "delete", F.col("value"))
    return w.select("seq", binary.record_crc(F.col("key"), value).alias("crc"))


@query
def key_hashes(spark, sf_dir):
    ship_package(spark)
    return _writes(spark, sf_dir).select("key").distinct().select("key", binary.murmur64a_udf("key").alias("hash"))


@query
def publisher_mix(spark, sf_dir):
    m = workloads.publisher_messages(spark, 10_000, 100)
    ops = messages_to_ops(m)
    return ops.groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("key").alias("unique_keys"))


@query
def stream_state_summary(spark, sf_dir):
    """Visible state after 10,000 generated operations of a topic stream."""
    ops = workloads.stream_ops(spark, "mqtt", 10_000, 100).where("op <> 'get'").select("key", "seq", "op", "value")
    return lww.storage_summary(lww.resolve(ops))


# ---------------------------------------------------------------- the store


@query
def store_lifecycle(spark, sf_dir):
    """What a store shows after segments, flushes, compactions, a collection and a new start."""
    store = Store(spark, scratch(spark, "store"), Limits(l0_runs=1, l1_runs=1))
    log, n = _ops(spark, sf_dir), _total(spark, sf_dir)
    for part in range(4):
        lo, hi = part * n // 4, (part + 1) * n // 4
        store.append(log.where(F.col("seq").between(lo, hi - 1)).withColumn("seq", F.col("seq") - store.catalog.next_seq))
        if part < 3:
            store.flush()
        if part == 1:
            store.compact(0)
    store.collect()
    return store.reopen().live()


@query
def store_counters(spark, sf_dir):
    """Durable counters of a store that took the whole log as one segment and flushed it."""
    store = Store(spark, scratch(spark, "store"))
    store.append(_ops(spark, sf_dir))
    store.flush()
    return spark.createDataFrame([tuple(map(int, store.reopen().catalog.stats.values()))], "user_bytes_written bigint, storage_bytes_written bigint, put_calls bigint, delete_calls bigint")


@query
def store_reads(spark, sf_dir):
    """Point reads of a store with four runs, with filters and without them: what is found, and what was opened."""
    store = Store(spark, scratch(spark, "store"), Limits(l0_runs=9))
    rows = spark.range(400).select("id", F.format_string("key_%04d", "id").alias("key"))
    for part in range(4):
        store.append(rows.where(f"id % 4 = {part}").select((F.col("id") - part).alias("seq"), "key", F.lit("put").alias("op"), F.concat(F.lit("v"), "id").alias("value")))
        store.flush()
    out = []
    for key in ("key_0001", "key_0002", "key_0399", "key_0400", "key_01"):
        for bypass in (False, True):
            before = store.reads["sst_searches"]
            found, value = store.get(key, bypass_filter=bypass)
            out.append((key, bypass, found, value, store.reads["sst_searches"] - before if bypass or found else 0))  # a filter may be wrong about an absent key
    return spark.createDataFrame(out, "key string, bypass boolean, found boolean, value string, searched bigint")


@query
def store_bytes(spark, sf_dir):
    """What a store's files are by kind: runs and segments, their number and whether they hold bytes."""
    store = Store(spark, scratch(spark, "store"))
    store.append(_ops(spark, sf_dir))
    store.flush()
    store.append(_ops(spark, sf_dir).where("seq < 100"))
    return spark.createDataFrame([(k, v["files"], v["bytes"] > 0) for k, v in store.bytes_by_kind().items()], "kind string, files bigint, filled boolean")


@query
def store_damage(spark, sf_dir):
    """A store whose segment is damaged at one record, opened again: what stood before it is there, the rest is cut off."""
    store = Store(spark, scratch(spark, "store"))
    store.append(_ops(spark, sf_dir))
    name, n = store.catalog.segments[0], _total(spark, sf_dir) // 2
    rows = spark.read.parquet(f"{store.root}/{name}")
    at = rows.where(F.col("seq") >= n).agg(F.min("seq")).first()[0]
    store.replace_segment(name, rows.withColumn("crc", F.when(F.col("seq") == at, F.col("crc") + 1).otherwise(F.col("crc"))))
    return store.reopen().current()


@query
def lab_report(spark, sf_dir):
    """An experiment script on a new store, compared with its model."""
    script = "insert 1..3000 random\nupdate 800..1500 random\ndelete 1000..1300 random\nflush\ncompact\nrecover\nverify\nstate"
    r = lab.run_script(spark, scratch(spark, "lab"), script)
    names = ("commands", "generated_ops", "puts", "updates", "deletes", "verify_checks", "mismatches", "live_keys", "tombstones")
    return spark.createDataFrame([(r["status"], *(int(r[k]) for k in names))], "status string, " + ", ".join(f"{k} bigint" for k in names))


@query
def verification_suite(spark, sf_dir):
    """All phases of the full verification with 1,000 events."""
    r = verify.run_suite(spark, scratch(spark, "verify"), "full", 1000)
    return spark.createDataFrame([(p["phase"], int(p["checked"]), int(p["mismatches"]), bool(p["ok"])) for p in r["phases"]], "phase string, checked bigint, mismatches bigint, ok boolean")
