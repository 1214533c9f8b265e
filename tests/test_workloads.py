import pytest
from pyspark.sql import functions as F

from driftlog.operators import lww, metrics
from driftlog.plans import lab, verify, workloads
from driftlog.plans.store import Store


@pytest.mark.parametrize(
    ("mode", "devices", "live", "tombstones", "states", "hits", "user", "live_bytes"),
    [
        ("stream1", 25, 7510, 500, 10, 0, 1400165, 1222160),
        ("stream1", 100, 8010, 495, 10, 0, 1406155, 1309060),
        ("stream2", 25, 7625, 500, 125, 462, 1479542, 1242851),
        ("stream2", 100, 8000, 500, 500, 349, 1485096, 1308468),
        ("mqtt", 25, 7550, 500, 50, 195, 1889948, 1553253),
        ("mqtt", 100, 7600, 500, 100, 96, 1898208, 1571253),
    ],
)
def test_streams_have_their_known_contents(spark, mode, devices, live, tombstones, states, hits, user, live_bytes):
    ops = workloads.stream_ops(spark, mode, 10_000, devices).cache()
    assert {r["op"]: r["count"] for r in ops.groupBy("op").count().collect()} == {"put": 8000, "update": 1000, "delete": 500, "get": 500}
    writes = ops.where("op <> 'get'")
    assert lww.storage_summary(lww.resolve(writes.select("key", "seq", "op", "value"))).first().asDict() == {"live_keys": live, "tombstones": tombstones, "live_logical_bytes": live_bytes}
    assert ops.where("op = 'update'").select("key").distinct().count() == states
    assert writes.agg(F.sum(metrics.user_bytes())).first()[0] == user
    assert lww.as_of(ops.where("op = 'get'"), writes, block=512).where("found").count() == hits
    ops.unpersist()


SCRIPTS = [
    ("insert 1..3000 random\nupdate 800..1500 random\ndelete 1000..1300 random\nflush\ncompact\nrecover\nverify\nstate", 4002, 6000, 2699, 301),
    ("put manual:key hello\nget manual:key\nupdate manual:key hello_v2\ndelete manual:key\nrecover\nverify", 4, None, 0, 1),
]


@pytest.mark.parametrize(("script", "ops", "checks", "live", "deleted"), SCRIPTS)
def test_lab_scripts(spark, tmp_path, script, ops, checks, live, deleted):
    r = lab.run_script(spark, f"file://{tmp_path}/lab", script)
    assert r["status"] == "pass" and r["mismatches"] == 0, r["mismatch_details"]
    assert (r["generated_ops"], r["model_live_keys"], r["model_deleted_keys"], r["live_keys"], r["tombstones"]) == (ops, live, deleted, live, deleted)
    assert checks is None or r["verify_checks"] == checks
    assert r["write_amplification"] > 0


@pytest.mark.parametrize("script", ["", "# only a comment", "insert", "insert 1..x", "insert 0..20000", "fly 1..2", "put k"])
def test_lab_refuses(spark, tmp_path, script):
    assert lab.run_script(spark, f"file://{tmp_path}/lab", script)["status"] == "fail"


def test_lab_finds_a_difference(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/lab")
    run = lab.Lab(spark, store)
    run.run("insert 1..5")
    store.delete("lab:event:00000003")
    run.verify()
    assert run.counts["mismatches"] == 1 and run.details == ["lab:event:00000003: missing"]


@pytest.mark.parametrize(("suite", "live"), [("full", 200 - 10 + 1000), ("gc", 200)])
def test_suites(spark, tmp_path, suite, live):
    r = verify.run_suite(spark, f"file://{tmp_path}/v", suite, 200)
    assert r["status"] == "pass" and r["live_keys"] == live, r["phases"]


def test_a_stream_of_messages_equals_a_batch(spark, tmp_path):
    from driftlog.streaming.ingest import Ingest, message_files, messages_to_ops

    rows = [(f"f/d/{i % 3}/{kind}", f'{{"sequence":{i}}}' if kind == "telemetry" else '{"target_key":"mqtt:f/d/0/state/a"}' if kind == "delete" else "{}", i) for i, kind in enumerate(["telemetry", "state/a", "delete", "query"] * 6)]
    messages = spark.createDataFrame(rows, "topic string, payload string, seq bigint")
    for part in range(3):
        messages.where(F.col("seq").between(part * 8, part * 8 + 7)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        # files are read in the order in which they came
    store = Store(spark, f"file://{tmp_path}/s")
    ingest = Ingest(store)
    ingest.start(messages_to_ops(message_files(spark, f"{tmp_path}/in")), f"{tmp_path}/cp").awaitTermination()
    want = lww.live(messages_to_ops(messages).where("op <> 'get'"))
    assert {(r["key"], r["value"]) for r in store.live().collect()} == {(r["key"], r["value"]) for r in want.select("key", "value").collect()}
    assert ingest.counts["batches"] == 3 and ingest.counts["get"] == 6 and not ingest.status()["running"]
    ingest._batch(messages_to_ops(messages).where("seq < 8"), 0)  # a batch that comes again
    assert ingest.counts["batches"] == 3


def test_command_line(spark, tmp_path):
    from driftlog.cli import execute

    store = Store(spark, f"file://{tmp_path}/c")
    assert [execute(store, x) for x in ("put a 1", "get a", "delete a", "get a", "put a", "fly", "", "load 5")] == ["OK", "1", "OK", "(not found)", "error: cannot understand 'put a'", "error: cannot understand 'fly'", "", "5 written"]
    assert execute(store, "quit") is None


def test_bulk_payloads(spark):
    r = workloads.bulk_iot(spark, 200_000, 7).agg(F.count("*"), F.max("seq")).first()
    assert tuple(r) == (100_000, 99_999)
    v = workloads.bulk_iot(spark, 98, 7).where("seq = 97").first()
    assert v["key"] == "iot:device_0006:event_0000000097" and '"status":"alert"' in v["value"] and '"timestamp_minute":13,' in v["value"] and '"temperature_c":21.89,' in v["value"]


def test_json_lines_round_trip(spark, tmp_path):
    from driftlog.sources.oplog import json_lines

    ops = workloads.stream_ops(spark, "mqtt", 200, 5)
    workloads.write_json_lines(ops, f"{tmp_path}/w")
    assert json_lines(spark, f"{tmp_path}/w").groupBy("op").count().count() == 4


def test_random_messages_draw_what_was_there(spark):
    from driftlog.plans import workloads
    from driftlog.streaming.ingest import messages_to_ops

    m = workloads.random_messages(spark, 3000, 20)
    ops = messages_to_ops(m)
    rows = {r["seq"]: r for r in ops.collect()}
    assert sorted(rows) == list(range(1, 3001)) and {r["op"] for r in rows.values()} == {"put", "update", "delete", "get"}
    written = {r["key"]: s for s, r in rows.items() if r["op"] == "put"}
    asked = [(s, r["key"]) for s, r in rows.items() if r["op"] in ("delete", "get")]
    assert len(asked) > 200 and sum(written.get(k, 10**9) < s for s, k in asked) >= len(asked) - 2
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, workloads.random_messages(spark, 3000, 20).collect()))


def test_publishing_is_paced_and_goes_on(spark, tmp_path):
    import time

    from driftlog.plans import workloads

    m = workloads.publisher_messages(spark, 30, 5)
    began = time.monotonic()
    assert workloads.publish(m, f"file://{tmp_path}/m", rate=40.0, batch=20, events=50) == 50
    assert time.monotonic() - began >= 1.2
    back = spark.read.schema("topic string, payload string, seq bigint").json(f"file://{tmp_path}/m")
    assert sorted(r["seq"] for r in back.collect()) == list(range(1, 51))
    turns = iter([False, False, True])
    assert workloads.publish(m, f"file://{tmp_path}/live", batch=10, stop=lambda: next(turns)) == 20
    assert workloads.publish(m.limit(0), f"file://{tmp_path}/none") == 0


def test_two_streams_and_reads_in_them(spark, tmp_path):
    from driftlog.plans.store import Store
    from driftlog.streaming.ingest import Ingest

    store = Store(spark, f"file://{tmp_path}/store")
    schema, counts = "seq bigint, key string, op string, value string", []
    for name, first in (("one", 0), ("two", 10)):
        rows = [(i, f"k{first + i}", "put", f"v{first + i}") for i in range(10)] + [(10, f"k{first + 3}", "get", None), (11, f"k{first + 3}", "delete", None), (12, f"k{first + 3}", "get", None), (13, "k4", "get", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/{name}")
        stream = Ingest(store, answers=f"file://{tmp_path}/answers-{name}", every=5)
        source = spark.readStream.schema(schema).json(f"file://{tmp_path}/{name}")
        stream.start(source, f"file://{tmp_path}/checkpoint-{name}").awaitTermination()
        found = {r["seq"]: (r["found"], r["value"]) for r in spark.read.parquet(f"file://{tmp_path}/answers-{name}/*/*").collect()}
        assert found == {10: (True, f"v{first + 3}"), 12: (False, None), 13: (True, "v4")}
        assert (stream.counts["hits"], stream.counts["misses"], len(stream.marks)) == (2, 1, 1)
        counts.append(store.summary()["live_keys"])
        stream.start(source, f"file://{tmp_path}/checkpoint-{name}").awaitTermination()  # nothing new
        stream._batch(spark.createDataFrame(rows, schema), 0)  # delivered again
        assert store.summary()["live_keys"] == counts[-1]
    assert counts == [9, 18] and store.reopen().summary() == {"live_keys": 18, "tombstones": 2, "live_logical_bytes": store.summary()["live_logical_bytes"]}


def test_subscriptions_match_topics(spark):
    from driftlog.streaming.ingest import matching

    m = spark.createDataFrame([(t,) for t in ("a/b/c", "a/x/c", "a/b", "a", "a/b/c/d", "ab/b/c")], "topic string")
    got = lambda p: sorted(r["topic"] for r in matching(m, p).collect())
    assert got("a/+/c") == ["a/b/c", "a/x/c"] and got("a/#") == ["a", "a/b", "a/b/c", "a/b/c/d", "a/x/c"] and got("#") == sorted(r["topic"] for r in m.collect()) and got("a/b") == ["a/b"]
