import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlog.functions import binary, formats


def test_record_checksums_of_known_records(spark):
    df = spark.createDataFrame([("bad", "record"), ("key1", None)], "key string, value string")
    assert [r[0] for r in df.select(binary.record_crc(F.col("key"), F.col("value"))).collect()] == [0x014B2A27, 0xEF1666CA]


def test_record_checksum_matches_its_definition(spark):
    rows = [("k", ""), ("ключ", "значение"), ("a" * 300, "b" * 70000)]
    df = spark.createDataFrame(rows, "key string, value string")
    pack = lambda n: n.to_bytes(4, "little")
    want = [zlib.crc32(pack(len(k.encode())) + pack(len(v.encode())) + k.encode() + v.encode()) for k, v in rows]
    assert [r[0] for r in df.select(binary.record_crc(F.col("key"), F.col("value"))).collect()] == want


def test_murmur_of_known_keys():
    assert binary.murmur64a(b"deterministic_validation_key") == 0x96F803D0E0EB4435
    assert binary.murmur64a(b"key_1") == 0x9E9AF1EA79A98B0F


def test_bloom_sizes(spark):
    df = spark.createDataFrame([(100,), (1000,), (10000,)], "n bigint")
    got = [tuple(r) for r in df.select(binary.bloom_bits(F.col("n"), 0.01), binary.bloom_hashes(F.col("n"), 0.01)).collect()]
    assert got == [(959, 7), (9586, 7), (95851, 7)]
    assert [len(binary.BloomFilter(n).bytes) for n in (100, 1000, 10000)] == [120, 1199, 11982]


@settings(max_examples=20, deadline=None)
@given(st.sets(st.text(min_size=1, max_size=12), min_size=1, max_size=50))
def test_bloom_has_no_false_negatives(keys):
    f = binary.BloomFilter(len(keys))
    for k in keys:
        f.add(k)
    assert all(f.may_contain(k) for k in keys)


def test_bloom_skips_most_missing_keys():
    f = binary.BloomFilter(1000)
    for i in range(1000):
        f.add(f"key_{i}")
    assert sum(f.may_contain(f"other_{i}") for i in range(2000)) < 100


def test_order_hash(spark):
    assert spark.range(5, 6).select(formats.order_hash(F.col("id"))).first()[0] == 387276917


def test_ranges(spark):
    df = spark.createDataFrame([("1..3",), (" 5..4 ",), ("x..2",), ("-1..2",), ("1",), ("0..20000",), ("0..19999",)], "s string")
    got = [r[0] for r in df.select(formats.expand_range(F.col("s"))).collect()]
    assert got[:6] == [[1, 2, 3], [4, 5], None, None, None, None] and len(got[6]) == 20000


def test_message_keys(spark):
    rows = [("f/d/1/telemetry", '{"sequence":5}', 1), ("f/d/1/state/x", "{}", 2), ("t/delete", '{"target_key":"k"}', 3), ("t/query", '{"key":"","storage_key":"s"}', 4)]
    df = spark.createDataFrame(rows, "topic string, payload string, seq bigint")
    got = [tuple(r) for r in df.select(formats.route(F.col("topic")), formats.message_key(F.col("topic"), F.col("payload"), F.col("seq"))).collect()]
    assert got == [("put", "mqtt:f/d/1/telemetry:5"), ("update", "mqtt:f/d/1/state/x"), ("delete", "k"), ("get", "s")]


def test_hashes_of_columns_are_those_of_keys(spark):
    import numpy as np
    import pandas as pd

    from driftlog.functions.binary import BloomFilter, murmur64a, murmur64a_all, murmur64a_udf

    keys = ["", "a", "seven77", "eight888", "nine99999", "é" * 9, "x" * 1000, None] + [f"user:{i}" for i in range(50)]
    got, there = murmur64a_all(pd.Series(keys))
    assert [int(h) for h, ok in zip(got, there, strict=True) if ok] == [murmur64a(k.encode()) for k in keys if k is not None]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    back = {r["key"]: r["h"] for r in frame.select("key", murmur64a_udf("key").alias("h")).collect()}
    assert back[None] is None and all(back[k] == int(np.uint64(murmur64a(k.encode())).astype(np.int64)) for k in keys if k is not None)
    bloom = BloomFilter(50)
    bloom.add_all(pd.Series(keys[8:]))
    again = BloomFilter.load(bloom.k, bloom.bytes.tobytes())
    assert all(again.may_contain(k) for k in keys[8:]) and sum(again.may_contain(f"no:{i}") for i in range(500)) < 30


def test_records_are_read_back(spark):
    from pyspark.sql import functions as F

    from driftlog.functions.binary import from_le, parsed_record, record_bytes

    rows = spark.createDataFrame([("k", "v"), ("é", ""), ("gone", None)], "key string, value string")
    raw = rows.select("key", "value", record_bytes(F.col("key"), F.col("value")).alias("raw"))
    got = raw.select("key", "value", parsed_record(F.col("raw")).alias("r"), parsed_record(F.expr("substring(raw, 1, 11)")).alias("short")).collect()
    assert all((r["r"]["key"], r["r"]["value"], r["r"]["intact"], r["short"]) == (r["key"], r["value"], True, None) for r in got)
    n = spark.range(1).select(from_le(F.unhex(F.lit("FF010000"))).alias("a"), from_le(F.unhex(F.lit(""))).alias("b")).first()
    assert (n["a"], n["b"]) == (511, None)


def test_formats_for_people(spark):
    from pyspark.sql import functions as F

    from driftlog.functions import formats

    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1 << 30,), (None,)], "n bigint")
    assert [r[0] for r in sizes.select(formats.display_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 GB", "0 B"]
    numbers = spark.createDataFrame([(0,), (999,), (1000,), (1234567,), (None,)], "n bigint")
    assert [r[0] for r in numbers.select(formats.display_number(F.col("n"))).collect()] == ["0", "999", "1,000", "12,34,567", "0"]
    paths = spark.createDataFrame([("x/sst_000012.sst",), ("sst_1/sst_7.sst",), ("wal_3",), ("sst_",)], "p string")
    assert [r[0] for r in paths.select(formats.sequence_of_path(F.col("p"))).collect()] == [12, 7, 0, 0]
