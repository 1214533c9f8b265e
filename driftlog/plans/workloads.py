"""Workload generators: operation logs with fixed contents for given sizes."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions import formats
from driftlog.operators.lww import running_sum

MODES = ("stream1", "stream2", "mqtt")


def clamp(n: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, n))


def bulk_iot(spark: SparkSession, events: int, devices: int) -> DataFrame:
    """Sensor events of ``devices`` machines, as puts."""
    events, devices, i = clamp(events, 1, 100_000), clamp(devices, 1, 1000), F.col("id")
    return spark.range(events).select(i.alias("seq"), formats.bulk_key(i, devices).alias("key"), F.lit("put").alias("op"), formats.bulk_payload(i, devices).alias("value"))


def _device(mode: str, i: str, devices: int) -> Column:
    if mode == "stream2":
        return formats.spread_device(i, devices)
    return formats.spread_device(i, devices, 19, 11, 3, 10) if mode == "mqtt" else F.expr(f"{i} % {devices}")


def _telemetry_key(mode: str, i: str, devices: int) -> Column:
    place = F.concat(F.lit("mqtt:factory/site_a/device/"), _device(mode, i, devices), F.lit("/telemetry:")) if mode == "mqtt" else F.concat(F.lit("iot:device_"), _device(mode, i, devices), F.lit(":telemetry:"))
    return F.concat(place, F.col(i))


def victims(operations: int) -> list[tuple[int, int]]:
    """(delete, telemetry operation it deletes) where deletes pick among what is still alive.

    Each choice depends on all earlier ones (the last key takes the place of the deleted one), so it is a
    plain loop; the number of operations is bounded by ``stream_ops``.
    """
    alive: list[int] = []
    out = []
    for i in range(operations):
        bucket = i % 100
        if bucket < 80:
            alive.append(i)
        elif 90 <= bucket < 95 and alive:
            at = (i * 1103515245 + 12345) % 2**64 % len(alive)
            out.append((i, alive[at]))
            alive[at] = alive[-1]
            alive.pop()
    return out


def stream_ops(spark: SparkSession, mode: str, operations: int, devices: int) -> DataFrame:
    """``seq, key, op, topic, value`` of a stream of telemetry, state updates, deletes and reads."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    operations, devices = clamp(operations, 100, 500_000), clamp(devices, 1, 5000)
    i, bucket = F.col("seq"), F.col("seq") % 100
    ops = spark.range(operations).withColumnRenamed("id", "seq").withColumn("op", formats.op_of_bucket(bucket)).withColumn("device", _device(mode, "seq", devices).cast("string"))
    spread = mode != "stream1"
    if spread:
        pairs = victims(operations)
        ops = ops.join(F.broadcast(spark.createDataFrame(pairs or [(-1, -1)], "seq bigint, victim bigint")), "seq", "left")
        missing = F.concat(F.lit("iot:device_"), "device", F.lit(":telemetry:none"))
    else:
        ops = ops.withColumn("victim", F.when(i > devices, i - devices).otherwise(i))
        missing = F.lit(None)
    root = F.concat(F.lit("factory/site_a/device/"), "device")
    home = F.concat(F.lit("mqtt:"), root, F.lit("/state/")) if mode == "mqtt" else F.concat(F.lit("iot:device_"), "device", F.lit(":"))
    update_key = F.concat(home, formats.family("seq") if spread else F.lit("config"))
    read_key = F.concat(home, F.lit("status:health" if spread else "config"))
    key = F.when(F.col("op") == "put", _telemetry_key(mode, "seq", devices)).when(F.col("op") == "update", update_key).when(F.col("op") == "delete", F.coalesce(_telemetry_key(mode, "victim", devices), missing)).otherwise(read_key)
    topic = F.lit("")
    if mode == "mqtt":
        topic = F.when(F.col("op") == "put", F.concat(root, F.lit("/telemetry"))).when(F.col("op") == "update", F.concat(root, F.lit("/state/"), formats.family("seq"))).otherwise("")
    protocol = "mqtt" if mode == "mqtt" else "http-stream"
    telemetry = F.format_string(
        f'{{"protocol":"{protocol}","topic":"%s","device_id":"device_%s","sequence":%d,"op":"telemetry","temperature_c":%.2f,"vibration_g":%.3f}}',
        topic, F.col("device"), i, formats.sensor(i, 20, 31, 1800, 100), formats.sensor(i, 0.10, 13, 700, 1000),
    )
    state = F.format_string(
        f'{{"protocol":"{protocol}","topic":"%s","device_id":"device_%s","op":"state_update","field":"%s","version":%d,"value":%d}}',
        topic, F.col("device"), formats.family("seq"), F.expr("seq div 100"), 100 + i * 17 % 900,
    )
    config = F.format_string('{"device_id":"device_%s","op":"config_update","sampling_ms":%d}', F.col("device"), 250 + i % 10 * 50)
    value = F.when(F.col("op") == "put", telemetry).when(F.col("op") == "update", state if spread else config)
    return ops.select("seq", key.alias("key"), "op", topic.alias("topic"), value.alias("value"))


def bench_ops(spark: SparkSession, kind: str, operations: int, value_bytes: int = 100, seed: int = 7) -> DataFrame:
    """random_write, sequential_write, random_read and mixed (70 % reads) over keys ``key_<n>`` / ``seq_<n>``."""
    i = F.col("id")
    key = F.format_string("seq_%08d", i) if kind == "sequential_write" else F.concat(F.lit("key_"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(operations)))
    op = {"random_write": F.lit("put"), "sequential_write": F.lit("put"), "random_read": F.lit("get"), "mixed": F.when(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10)) < 7, "get").otherwise("put")}[kind]
    value = F.substring(F.repeat(F.sha2(F.concat(i.cast("string"), F.lit(seed)), 256), value_bytes // 64 + 1), 1, value_bytes)
    return spark.range(operations).select(i.alias("seq"), key.alias("key"), op.alias("op"), F.when(op == "put", value).alias("value"))


def bench_keys(spark: SparkSession, operations: int, value_bytes: int = 100) -> DataFrame:
    """Every key that the reads of a bench may ask for."""
    i = F.col("id")
    value = F.substring(F.repeat(F.sha2(i.cast("string"), 256), value_bytes // 64 + 1), 1, value_bytes)
    return spark.range(operations).select(i.alias("seq"), F.concat(F.lit("key_"), i).alias("key"), F.lit("put").alias("op"), value.alias("value"))


def random_messages(spark: SparkSession, events: int, devices: int, site: str = "site_a", seed: int = 42) -> DataFrame:
    """``topic, payload, seq`` of a publisher that draws devices and operations at random (the same for a seed).

    Deletes and reads draw their target among all telemetry messages before them, or name themselves if none is.
    """
    seq = F.col("seq")
    draw = lambda salt, n: F.pmod(F.xxhash64("seq", F.lit(seed), F.lit(salt)), n if isinstance(n, Column) else F.lit(n))
    m = spark.range(1, events + 1).withColumnRenamed("id", "seq").withColumn("bucket", draw(0, 100)).withColumn("device", F.format_string("dev_%04d", draw(1, devices) + 1))
    m = running_sum(m, F.when(F.col("bucket") < 80, 1).otherwise(0), "seq", F.expr("seq div 65536"), [], "so_far")
    puts = m.where("bucket < 80").select(F.col("so_far").alias("nth"), F.col("seq").alias("target"), F.col("device").alias("target_device"))
    asked = F.when((F.col("bucket") >= 90) & (F.col("so_far") > 0), draw(2, F.greatest(F.col("so_far"), F.lit(1))) + 1)
    m = m.withColumn("nth", asked).join(puts, "nth", "left").withColumn("target", F.coalesce("target", "seq")).withColumn("target_device", F.coalesce("target_device", "device"))
    root = F.concat(F.lit(f"factory/{site}/device/"), F.col("device"))
    kind = F.element_at(F.array(*map(F.lit, ("firmware", "sampling", "threshold", "mode"))), (draw(3, 4) + 1).cast("int"))
    of = F.concat(F.lit(f"mqtt:factory/{site}/device/"), F.col("target_device"), F.lit("/telemetry:"), F.col("target"))
    part = lambda salt, top: F.round(draw(salt, 1000) / 1000.0 * top, 3)
    telemetry = F.to_json(F.struct(
        F.lit("put").alias("op"), F.concat(F.lit("mqtt:"), root, F.lit("/telemetry:"), seq).alias("storage_key"), F.col("device").alias("device_id"), seq.alias("sequence"),
        (F.lit(1_700_000_000_000) + seq * 1000).alias("timestamp_ms"), (24.0 + part(4, 7.0)).alias("temperature_c"), part(5, 4.0).alias("vibration_mm_s"), F.when(part(6, 1.0) > 0.02, "ok").otherwise("warn").alias("status"),
    ))
    state = F.to_json(F.struct(F.lit("update").alias("op"), F.col("device").alias("device_id"), seq.alias("sequence"), kind.alias("state_family"), F.concat(kind, F.lit("-"), draw(7, 100_000) + 1).alias("value")))
    target = F.to_json(F.struct(F.when(F.col("bucket") < 95, "delete").otherwise("get").alias("op"), F.col("device").alias("device_id"), seq.alias("sequence"), of.alias("target_key")))
    end = F.when(F.col("bucket") < 80, "/telemetry").when(F.col("bucket") < 90, F.concat(F.lit("/state/"), kind)).when(F.col("bucket") < 95, "/delete").otherwise("/query")
    return m.select(F.concat(root, end).alias("topic"), F.when(F.col("bucket") < 80, telemetry).when(F.col("bucket") < 90, state).otherwise(target).alias("payload"), "seq")


def publish(messages: DataFrame, folder: str, rate: float = 0.0, batch: int = 1000, events: int | None = None, stop=None) -> int:
    """Write messages as files of JSON lines, ``batch`` at a time in the order of ``seq``, not faster than ``rate`` a second.

    ``events``: how many (None: for ever, the messages again and again with further numbers, until ``stop()`` is true).
    """
    first, last = messages.agg(F.min("seq"), F.max("seq")).first()
    if first is None:
        return 0
    began, done, span = time.monotonic(), 0, last - first + 1
    while (events is None or done < events) and not (stop is not None and stop()):
        lo, turn = done % span, done // span
        n = min(batch, span - lo, events - done if events is not None else batch)
        part = messages.where(F.col("seq").between(first + lo, first + lo + n - 1)).withColumn("seq", F.col("seq") + turn * span)
        part.orderBy("seq").coalesce(1).write.mode("append").json(folder)
        done += n
        if rate > 0 and (wait := began + done / rate - time.monotonic()) > 0:
            time.sleep(wait)
    return done


def publisher_messages(spark: SparkSession, events: int, devices: int, site: str = "site_a") -> DataFrame:
    """``topic, payload, seq`` of a deterministic publisher. Deletes take the oldest live telemetry, so the
    n-th delete takes the n-th telemetry message; reads ask for the newest."""
    seq, bucket, block = F.col("seq"), (F.col("seq") - 1) % 100, F.expr("(seq - 1) div 100")
    m = spark.range(1, events + 1).withColumnRenamed("id", "seq")
    device = F.format_string("dev_%04d", (seq - 1) % devices + 1)
    root = F.concat(F.lit(f"factory/{site}/device/"), device)
    kind = F.element_at(F.array(*map(F.lit, ("firmware", "sampling", "threshold", "mode"))), F.expr("CAST(seq % 4 + 1 AS INT)"))
    nth = block * 5 + bucket - 90
    oldest = F.floor(nth / 80) * 100 + nth % 80 + 1
    target = F.when(bucket < 95, oldest).otherwise(block * 100 + 80)
    of = F.concat(F.lit(f"mqtt:factory/{site}/device/"), F.format_string("dev_%04d", (target - 1) % devices + 1), F.lit("/telemetry:"), target)
    noise = lambda salt, top: F.round(F.pmod(F.xxhash64("seq", F.lit(salt)), F.lit(1000)) / 1000.0 * top, 3)
    telemetry = F.to_json(F.struct(
        F.lit("put").alias("op"), F.concat(F.lit("mqtt:"), root, F.lit("/telemetry:"), seq).alias("storage_key"), device.alias("device_id"), seq.alias("sequence"),
        (F.lit(1_700_000_000_000) + seq * 1000).alias("timestamp_ms"), (24.0 + noise(1, 7.0)).alias("temperature_c"), noise(2, 4.0).alias("vibration_mm_s"),
        F.when(noise(3, 1.0) > 0.02, "ok").otherwise("warn").alias("status"),
    ))
    state = F.to_json(F.struct(F.lit("update").alias("op"), device.alias("device_id"), seq.alias("sequence"), kind.alias("state_family"), F.concat(kind, F.lit("-"), F.expr(f"seq div {max(devices, 1)}")).alias("value")))
    asked = F.to_json(F.struct(F.when(bucket < 95, "delete").otherwise("get").alias("op"), device.alias("device_id"), seq.alias("sequence"), of.alias("target_key")))
    end = F.when(bucket < 80, "/telemetry").when(bucket < 90, F.concat(F.lit("/state/"), kind)).when(bucket < 95, "/delete").otherwise("/query")
    return m.select(F.concat(root, end).alias("topic"), F.when(bucket < 80, telemetry).when(bucket < 90, state).otherwise(asked).alias("payload"), "seq")


def demo_ops(spark: SparkSession, first: int, last: int, kind: str) -> DataFrame:
    """Events of the demonstration with padded payloads, or deletes of them."""
    i = F.col("id")
    value = F.format_string('{"device_id":"demo_device_%d","sequence":%d,"kind":"%s","payload":"%s"}', i % 8, i, F.lit(kind), F.repeat(F.lit("x"), 900))
    gone = kind == "delete"
    return spark.range(first, last).select((i - first).alias("seq"), F.concat(F.lit("demo:event:"), i).alias("key"), F.lit("delete" if gone else "put").alias("op"), (F.lit(None).cast("string") if gone else value).alias("value"))


def sequence_events(spark: SparkSession, first: int, count: int, version: int, seq: int = 0) -> DataFrame:
    """Events of one machine with consecutive numbers, for verification."""
    i = F.col("id")
    value = F.format_string(
        '{"device_id":"machine_07","sensor":"vibration","sequence":%d,"version":%d,"value":%.3f,"unit":"g"}', i, F.lit(version), F.lit(0.5) + (i % 100).cast("double") / 100.0
    )
    return spark.range(first, first + count).select((i - first + seq).alias("seq"), F.format_string("event:machine_07:vibration:%08d", i).alias("key"), F.lit("put").alias("op"), value.alias("value"))


def write_json_lines(ops: DataFrame, path: str) -> None:
    """One ``{"op", "key"[, "topic"][, "value"]}`` per line, empty fields left out."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    ops.orderBy("seq").select("op", "key", *[filled(c) for c in ("topic", "value") if c in ops.columns]).write.json(path)
