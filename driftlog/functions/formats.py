"""Keys, payloads and the arithmetic of the generated workloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: state families in order, the order hash, sensor coefficients
FAMILIES = ("config:sampling", "config:threshold", "status:health", "status:firmware", "calibration:vibration")
ORDER_MULTIPLIER, ORDER_MASK = 2654435761, 0xFFFFFFFF


def sensor(i: Column | str, base: float, times: int, modulo: int, unit: int) -> Column:
    """base + (i * times mod modulo) / unit"""
    i = F.col(i) if isinstance(i, str) else i
    return F.lit(base) + (i * times % modulo).cast("double") / F.lit(float(unit))


def bulk_key(i: Column, devices: int) -> Column:
    return F.format_string("iot:device_%04d:event_%010d", i % devices, i)


def bulk_payload(i: Column, devices: int) -> Column:
    """The JSON text of a bulk event; decimals are printed with two or three digits."""
    return F.format_string(
        '{"device_id":"device_%04d","site":"edge_lab_A","sensor":"machine_health","timestamp_minute":%d,"sequence":%d,"temperature_c":%.2f,"vibration_g":%.3f,"voltage_v":%.2f,"status":"%s"}',
        i % devices, F.expr(f"id div {devices}"), i, sensor(i, 20, 37, 1700, 100), sensor(i, 0.15, 17, 900, 1000), sensor(i, 218, 29, 900, 100), F.when(i % 97 == 0, "alert").otherwise("normal"),
    )


def order_hash(i: Column) -> Column:
    """A pseudo-random but fixed order of small numbers."""
    return (i.cast("bigint") * F.lit(ORDER_MULTIPLIER)).bitwiseAND(F.lit(ORDER_MASK))


def op_of_bucket(b: Column) -> Column:
    """80 puts, 10 updates, 5 deletes, 5 gets in every hundred."""
    return F.when(b < 80, "put").when(b < 90, "update").when(b < 95, "delete").otherwise("get")


def spread_device(i: str, devices: int, times: int = 17, step: int = 13, base: int = 7, per: int = 100) -> Column:
    """Device of operation ``i`` where operations are spread over devices."""
    return F.expr(f"(({i} div {per}) * {times} + ({i} % 100) * {step} + {base}) % {devices}")


def family(i: str) -> Column:
    return F.element_at(F.array(*map(F.lit, FAMILIES)), F.expr(f"CAST(({i} div 100 + {i} % 100) % {len(FAMILIES)} + 1 AS INT)"))


def expand_range(spec: Column, most: int = 20000) -> Column:
    """``a..b`` as an array of numbers, in ascending order whichever way it is written; null if invalid or too long."""
    ends = F.split(F.trim(spec), r"\.\.")
    a, b = ends[0].try_cast("bigint"), F.get(ends, 1).try_cast("bigint")
    lo, hi = F.least(a, b), F.greatest(a, b)
    fine = (F.size(ends) == 2) & a.isNotNull() & b.isNotNull() & (lo >= 0) & (hi - lo < most)
    return F.when(fine, F.sequence(lo, hi))


def route(topic: Column, payload: Column | None = None) -> Column:
    """What a message asks for: the end of its topic decides, then an ``op`` field of its payload."""
    asked = F.lower(F.get_json_object(payload, "$.op")) if payload is not None else F.lit("")
    return F.when(topic.endswith("/delete") | (asked == "delete"), "delete").when(topic.endswith("/query") | (asked == "get"), "get").when(is_state(topic), "update").otherwise("put")


def is_state(topic: Column) -> Column:
    return topic.contains("/state/") | topic.endswith("/state") | topic.contains("/config/") | topic.endswith("/config")


def stable_suffix(topic: Column, payload: Column, seq: Column) -> Column:
    """A short identifier of a message that is the same in every run."""
    return F.substring(F.sha1(F.concat_ws("\x00", topic, payload, seq.cast("string")).cast("binary")), 1, 16)


def filled(c: Column) -> Column:
    """Null where a field is missing, empty or zero."""
    return F.when(~c.isin("", "0", "0.0", "null", "false", "[]", "{}"), c)


def message_key(topic: Column, payload: Column, seq: Column) -> Column:
    """Key of a message: a field that names it (deletes and reads look at ``target_key`` first), else its
    topic, which alone names a state; other topics get a field that tells messages apart, or a checksum.
    A field that is null counts as absent."""
    field = lambda name: F.get_json_object(payload, f"$.{name}")
    named = F.coalesce(filled(field("storage_key")), filled(field("key")))
    target = F.coalesce(filled(field("target_key")), filled(field("key")), filled(field("storage_key")))
    suffix = F.coalesce(*[field(n) for n in ("storage_key", "event_id", "sequence", "seq", "timestamp", "ts", "id")], stable_suffix(topic, payload, seq))
    place = F.concat(F.lit("mqtt:"), topic)
    built = F.when(is_state(topic), place).otherwise(F.concat(place, F.lit(":"), suffix))
    return F.coalesce(F.when(route(topic, payload).isin("delete", "get"), target).otherwise(named), built)


def display_bytes(n: Column) -> Column:
    """Bytes for people: whole bytes, else one decimal of KB, MB or GB."""
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    step = F.when(n < 1024, 0).when(n < 1024.0**2, 1).when(n < 1024.0**3, 2).otherwise(3)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1)
    scaled = n / F.pow(F.lit(1024.0), step)
    return F.concat_ws(" ", F.when(step == 0, F.format_string("%.0f", scaled)).otherwise(F.format_string("%.1f", scaled)), unit)


def display_factor(x: Column) -> Column:
    """An amplification for people."""
    return F.format_string("%.2fx", F.coalesce(x.cast("double"), F.lit(0.0)))


def display_number(n: Column) -> Column:
    """A whole number with commas, after three digits and then after every two."""
    text = F.coalesce(n.cast("bigint"), F.lit(0)).cast("string")
    return F.regexp_replace(text, r"(?<=[0-9])(?=(?:[0-9]{2})*[0-9]{3}$)", ",")


def sequence_of_path(path: Column) -> Column:
    """The number after the last ``sst_`` of a path, 0 without one."""
    return F.coalesce(F.regexp_extract(path, r"^.*sst_([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def json_object(**fields: Column) -> Column:
    """A JSON object with fields in this order: texts escaped, whole numbers as they are, others with four decimals, null as null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in fields.items()]), F.lit("}"))


def json_text(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def json_whole(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def json_decimal(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.4f", c.cast("double")))


def json_flag(c: Column) -> Column:
    return c.cast("boolean").cast("string")
