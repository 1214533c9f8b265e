import random

import pytest
from pyspark.sql import functions as F

from driftlog.plans.store import Store
from driftlog.schemas import Limits

OPS = "seq bigint, key string, op string, value string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def write(store, *ops):
    store.append(store.spark.createDataFrame([(i, k, "put" if v is not None else "delete", v) for i, (k, v) in enumerate(ops)], OPS))


def state(store):
    return {r["key"]: r["value"] for r in store.live().collect()}


def test_the_newest_write_wins_also_after_reopening(store):
    for v in ("v1", "v2", "v3"):
        store.put("key", v)
    assert store.get("key") == (True, "v3") and store.reopen().get("key") == (True, "v3")
    assert store.get("missing") == (False, None)


def test_an_empty_value_is_a_value_and_an_empty_key_is_refused(store):
    store.put("k", "")
    assert store.get("k") == (True, "")
    with pytest.raises(ValueError, match="empty key"):
        store.put("", "v")
    with pytest.raises(ValueError, match="missing value"):
        store.append(store.spark.createDataFrame([(0, "k", "put", None)], OPS))
    assert store.catalog.stats["put_calls"] == 1


def test_deletes_hide_older_runs_and_stay(store):
    write(store, ("a", "1"), ("b", "2"))
    store.flush()
    store.delete("a")
    store.delete("never")
    store.flush()
    store.compact(0)
    assert state(store) == {"b": "2"} and store.get("a") == (False, None)
    assert store.summary() == {"live_keys": 1, "tombstones": 2, "live_logical_bytes": 2}
    assert store.catalog.stats["delete_calls"] == 2


def test_maintenance_never_changes_what_is_visible(spark, tmp_path):
    rng, model = random.Random(5), {}
    store = Store(spark, f"file://{tmp_path}/s", Limits(flush_bytes=400, l0_runs=1, l1_runs=1, growth=2))
    for _ in range(6):
        ops = []
        for _ in range(30):
            k = f"k{rng.randrange(20):02d}"
            v = None if rng.random() < 0.3 else str(rng.random())
            ops.append((k, v))
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        write(store, *ops)
        step = rng.choice(["flush", "compact", "collect", "reopen", "maintain"])
        if step == "reopen":
            store = store.reopen()
        else:
            getattr(store, step)()
        assert state(store) == model, step
    for k in ("k00", "k07", "k19"):
        assert store.get(k) == (k in model, model.get(k))


def test_levels_deepen_and_reload(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/deep", Limits(flush_bytes=2048, l0_runs=1, l1_runs=1, growth=1))
    for n, c in enumerate("ABCD"):
        write(store, *[(f"key_{120 * n + i:04d}", c * 80) for i in range(120)])
        store.flush()
        store.compact(0)
        if n % 2:
            store.compact(1)
            store.compact(2)
    store = store.reopen()
    assert max(store.catalog.levels()) == 3
    assert store.get("key_0000") == (True, "A" * 80) and store.get("key_0479") == (True, "D" * 80)


def test_collection_keeps_the_newest_values(store):
    write(store, ("k", "old"), ("k", "new"), ("gone", "x"), ("gone", None))
    store.flush()
    before = store.catalog.stats["user_bytes_written"]
    store.collect()
    assert state(store) == {"k": "new"} and store.catalog.stats["user_bytes_written"] == before
    assert store.summary()["tombstones"] == 1 and store.reopen().get("k") == (True, "new")


@pytest.mark.parametrize("phase", ["started", "isolated", "rewrite_complete"])
def test_a_stopped_collection_is_undone_or_finished(store, phase):
    write(store, ("k", "old"), ("k", "new"))
    store.catalog.phase = phase
    if phase == "rewrite_complete":
        store.catalog.pending = store._write_runs(store.current(), 1)
    else:
        store._write_runs(store.current(), 1)  # written, but no catalog names it
    store.catalog.commit(store.files)
    again = store.reopen()
    assert state(again) == {"k": "new"} and again.catalog.phase == "" and again.orphans() == []


def test_a_broken_commit_is_passed_over(store):
    store.put("k", "v")
    store.files.replace("catalog-999999999999.json", "{ not json")
    store.files.replace("run-99999999-dead", "x")
    again = store.reopen()
    assert again.get("k") == (True, "v") and again.orphans() == []


def test_runs_are_pruned_by_key_range(store):
    write(store, ("a", "1"), ("b", "2"))
    store.flush()
    write(store, ("x", "1"), ("y", "2"))
    store.flush()
    assert store.get("b") == (True, "2")
    assert (store.reads["sst_considered"], store.reads["bloom_skips"], store.reads["sst_searches"]) == (2, 1, 1)


def test_accounting_follows_the_formulas(store):
    write(store, ("key", "value"), ("key", None))
    s = store.catalog.stats
    assert s["user_bytes_written"] == 3 + 5 + 3 and s["storage_bytes_written"] == (12 + 3 + 5 + 4 + 5) + (12 + 3)
    store.flush()
    assert s["storage_bytes_written"] == 44 + 20 + 3 + 24
    assert [f["in_catalog"] for f in store.describe_files()] == [True] and store.trace()[-1].startswith("flush | ")


def test_many_keys_at_once(store):
    write(store, ("a", "1"), ("b", None))
    got = {r["key"]: r["found"] for r in store.multi_get(store.spark.createDataFrame([("a",), ("b",), ("c",)], "key string")).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_replay_stops_at_the_first_bad_record(spark):
    from driftlog.functions.binary import record_crc
    from driftlog.sources.oplog import checked, replay_report, valid_prefix

    log = spark.createDataFrame([(i, f"k{i}", "put" if i != 2 else "delete", f"v{i}" if i != 2 else None) for i in range(8)], OPS)
    log = log.withColumn("crc", F.when(F.col("seq") == 5, 0xDEADBEEF).otherwise(record_crc(F.col("key"), F.when(F.col("op") != "delete", F.col("value")))))
    assert sorted(r["seq"] for r in valid_prefix(log, checked(log)).collect()) == [0, 1, 2, 3, 4]
    assert replay_report(log, checked(log)).first().asDict() == {"tainted": True, "safe_seq": 4, "bad_seq": 5, "kept": 5}


def test_bulk_bodies(spark):
    from driftlog.sources.oplog import bulk_records

    many = '{"records":[' + ",".join('{"key":"k","value":"v"}' for _ in range(501)) + "]}"
    bodies = spark.createDataFrame([('{"records":[{"key":"a","value":""},{"key":"","value":"x"},{"value":"y"},{"key":"b"}]}',), (many,), ("nonsense",)], "body string")
    assert [(r["key"], r["value"]) for r in bulk_records(bodies).collect()] == [("a", "")]


def test_filters_spare_searches_and_can_be_bypassed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Limits(l0_runs=9))
    for part in range(2):
        write(store, *[(f"key_{i:04d}", "v") for i in range(part, 200, 2)])
        store.flush()
    keys = [f"key_{i:04d}x" for i in range(0, 150, 10)]  # inside the ranges, in no run
    assert not any(store.get(k)[0] for k in keys)
    assert store.reads["sst_considered"] == 30 and store.reads["sst_searches"] < 4 and store.reads["bloom_skips"] > 26
    searches = store.reads["sst_searches"]
    assert store.get(keys[0], bypass_filter=True) == (False, None) and store.reads["sst_searches"] == searches + 2
    assert store.get("key_0007") == (True, "v") and store.get("key_0007", bypass_filter=True) == (True, "v")
    assert all(store.may_contain(r, k) for r, start in zip(store.catalog.level(0), (1, 0), strict=True) for k in (f"key_{i:04d}" for i in range(start, 200, 40)))


def test_compaction_writes_chunks_and_leaves_other_ranges(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Limits(flush_bytes=1000, l0_runs=9))
    write(store, *[(f"key_{i:04d}", "old") for i in range(200)])
    store.flush()
    store.compact(0)
    first = {r.path: (r.min_key, r.max_key) for r in store.catalog.level(1)}
    assert len(first) == 200 * 28 // 1000 + 1
    ordered = sorted(first.values())
    assert all(a[1] < b[0] for a, b in zip(ordered, ordered[1:], strict=False))
    write(store, ("key_0100", "new"), ("key_0105", None))
    store.flush()
    store.compact(0)
    left = {r.path for r in store.catalog.level(1)} & set(first)
    assert left == {p for p, (a, z) in first.items() if z < "key_0100" or a > "key_0105"} and len(left) >= len(first) - 2
    assert "retained" in store.trace()[-1]
    again = store.reopen()
    assert again.orphans() == [] and again.get("key_0100") == (True, "new") and again.get("key_0105") == (False, None) and again.get("key_0199") == (True, "old")
    assert again.summary()["live_keys"] == 199 and all(f["exists"] and f["in_catalog"] for f in again.describe_files())


def test_a_damaged_segment_is_cut_off(store):
    write(store, ("a", "1"), ("b", "2"))
    write(store, ("c", "3"), ("d", "4"), ("e", "5"))
    write(store, ("f", "6"))
    name = store.catalog.segments[1]
    rows = store.spark.read.parquet(f"{store.root}/{name}")
    store.replace_segment(name, rows.withColumn("value", F.when(F.col("key") == "d", "wrong").otherwise(F.col("value"))))
    again = store.reopen()
    assert state(again) == {"a": "1", "b": "2", "c": "3"} and again.damage == {"bad_seq": 3, "safe_seq": 2, "kept": 3, "lost": 3}
    again.put("g", "7")
    assert state(again.reopen()) == {"a": "1", "b": "2", "c": "3", "g": "7"} and again.reopen().damage == {} and again.orphans() == []


def test_a_store_damaged_at_its_first_record_is_empty(store):
    store.put("a", "1")
    name = store.catalog.segments[0]
    store.replace_segment(name, store.spark.read.parquet(f"{store.root}/{name}").withColumn("crc", F.lit(0).cast("bigint")))
    again = store.reopen()
    assert state(again) == {} and again.catalog.segments == [] and again.damage["kept"] == 0


def test_memory_is_scanned_in_order(store):
    write(store, ("c", "1"), ("a", "2"), ("b", "3"), ("a", "4"), ("d", None))
    assert [(r["key"], r["value"]) for r in store.memory_scan().collect()] == [("a", "4"), ("b", "3"), ("c", "1"), ("d", None)]
    assert [r["key"] for r in store.memory_scan("b", "c").collect()] == ["b", "c"]
    store.flush()
    assert store.memory_scan().count() == 0


def test_the_trace_is_kept_and_stops(store):
    store.put("a", "1")
    n = len(store.trace())
    store.set_tracing(False)
    store.put("b", "1")
    again = store.reopen()
    assert len(again.trace()) == n and not again.catalog.tracing
    again.set_tracing(True)
    assert again.trace()[-1] == "trace | enabled"
