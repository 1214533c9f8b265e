import json
import threading
import urllib.error
import urllib.request

import pytest

from driftlog.console import Console, serve


@pytest.fixture(scope="module")
def console(spark, tmp_path_factory):
    return Console(spark, f"file://{tmp_path_factory.mktemp('console')}")


def test_calls_over_http(console):
    server = serve(console, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(name, method=None, **body):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/{name}", json.dumps(body).encode() if body else None, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read() or "null")
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("put", key="a", value="")[1] == {"ok": True} and call("get", key="a")[1] == {"found": True, "value": ""}
    assert call("bulk/put", records=[{"key": "b", "value": "1"}, {"key": ""}])[1] == {"written": 1}
    assert call("bulk/put", records=[{"key": ""}])[0] == 400 and call("put", key="", value="x")[0] == 400 and call("nothing")[0] == 404
    assert call("delete", key="a")[0] == 200 and call("get", key="a")[1]["found"] is False
    assert call("trace/read")[1] == {"lines": []} and call("trace/toggle", "POST")[1] == {"enabled": True} and call("trace/read")[1]["lines"]
    assert call("lsm-state")[1]["version"] > 0 and call("debug/files")[1]["orphans"] == [] and call("debug/state")[0] == 200
    assert call("iot/bulk", events=50, devices=5)[1]["written"] == 50
    assert call("metrics")[1]["live_keys"] == 51
    assert call("production/reset")[0] == 405 and call("trace/toggle")[0] == 405 and call("put", "OPTIONS")[0] == 204 and call("verify/nothing", "POST")[0] == 404
    for suite in ("basic", "bloom"):
        status, out = call(f"verify/{suite}", "POST", ops=100)
        assert (status, out["suite"], out["status"]) == (200, suite, "pass")
    assert call("trace/toggle", "POST")[1] == {"enabled": False}
    lines = call("trace/read")[1]["lines"]
    assert console.store.put("k", "v") is None and call("trace/read")[1]["lines"] == lines and console.store.reopen().catalog.tracing is False
    server.shutdown()


def test_streams(console):
    console.production_reset()
    assert console.stream_start(mode="stream2", operations=300, devices=5, batch=150)["operations"] == 300
    with pytest.raises(RuntimeError):
        console.stream_start()
    console.worker.join()
    s = console.stream_status()
    assert (s["status"], s["percent"], s["put"], s["get"]) == ("done", 100, 240, 15)


def test_demo(console):
    r = console.demo_run(60)
    assert r["status"] == "pass" and r["timeline"][-1]["levels"] == {2: 1} and len(r["timeline"]) == 7


def test_published_messages_reach_a_store(console):
    from driftlog.plans import workloads
    from driftlog.streaming.ingest import messages_to_ops

    console.production_reset()
    ops = messages_to_ops(workloads.publisher_messages(console.spark, 200, 10))
    assert console.store.append(ops) == 190
    assert console.store.summary()["tombstones"] == 10


def test_a_paced_stream_is_not_faster(console):
    import time

    console.production_reset()
    began = time.monotonic()
    console.stream_start(mode="stream1", operations=100, devices=5, batch=50, rate=25.0)
    console.worker.join()
    assert time.monotonic() - began >= 4 and console.stream_status()["status"] == "done"


def test_the_bench_tells_percentiles(spark, tmp_path):
    from driftlog.cli import _percentiles, bench

    runs = bench(spark, f"file://{tmp_path}/bench", 60, 2)
    assert len(runs) == 8 and all(r["p50_us"] <= r["p95_us"] <= r["p99_us"] for r in runs)
    assert all(20 < r["hits"] <= 60 and not r["writes"] for r in runs if r["kind"] == "random_read")
    assert _percentiles([(50, 5.0), (45, 9.0), (5, 2.0)]) == {"p50_us": 200000.0, "p95_us": 400000.0, "p99_us": 400000.0}
