"""The engine's calls as methods of one object, and as JSON over HTTP.

    python -m driftlog.console ROOT [PORT]

``/api/<name>`` calls the method of that name with the body's JSON fields, ``/api/verify/<suite>`` a suite of
verification. What only reads is asked for with GET (POST works, too), all else with POST.
"""

from __future__ import annotations

import json
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftlog.cli import bench
from driftlog.plans import lab, verify, workloads
from driftlog.plans.store import Store
from driftlog.schemas import SMALL, WEB
from driftlog.sources.oplog import bulk_records


class Console:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, f"{root.rstrip('/')}/store", WEB)
        self.lock, self.stopping, self.worker = threading.Lock(), False, None
        if not self.store.catalog.version:
            self.store.set_tracing(False)
        self.progress: dict[str, object] = {"status": "idle", "done": 0, "operations": 0}

    # reading

    def metrics(self) -> dict:
        return self.store.metrics()

    def lsm_state(self) -> dict:
        return self.store.state()

    def debug_state(self) -> dict:
        return {"state": self.store.state(), "metrics": self.store.metrics(), "files": len(self.store.describe_files())}

    def debug_files(self) -> dict:
        return {"kinds": self.store.bytes_by_kind(), "files": self.store.describe_files(), "orphans": self.store.orphans()}

    def trace_status(self) -> dict:
        return {"enabled": self.store.catalog.tracing}

    def trace_toggle(self) -> dict:
        self.store.set_tracing(not self.store.catalog.tracing)
        return self.trace_status()

    def trace_read(self) -> dict:
        return {"lines": self.store.trace()}

    # writing

    def put(self, key: str, value: str) -> dict:
        self.store.put(key, value)
        return {"ok": True}

    def bulk_put(self, records: list[dict]) -> dict:
        """Up to 500 records; invalid ones are passed over, and a body without a valid one is an error."""
        body = self.spark.createDataFrame([(json.dumps({"records": records}),)], "body string")
        rows = bulk_records(body).select(F.col("pos").cast("bigint").alias("seq"), "key", F.lit("put").alias("op"), "value")
        if rows.isEmpty():
            raise ValueError("no valid record, or more than 500")
        return {"written": self.store.append(rows)}

    def get(self, key: str) -> dict:
        found, value = self.store.get(key)
        return {"found": found, "value": value}

    def delete(self, key: str) -> dict:
        self.store.delete(key)
        return {"ok": True}

    def production_reset(self) -> dict:
        self.stream_stop()
        self.store.reset()
        return {"ok": True}

    def iot_bulk(self, events: int = 1000, devices: int = 25) -> dict:
        """Load sensor events and read the first, the middle and the last one back."""
        ops = workloads.bulk_iot(self.spark, events, devices)
        began, before = time.time(), dict(self.store.catalog.stats)
        with self.lock:
            n = self.store.append(ops)
        took = time.time() - began
        sample = self.store.multi_get(ops.where(F.col("seq").isin(0, n // 2, n - 1)).select("key")).collect()
        return {"written": n, "seconds": took, "per_second": n / took, "sample": [r.asDict() for r in sample], "user_bytes": self.store.catalog.stats["user_bytes_written"] - before["user_bytes_written"]}

    def bench(self, ops: int = 500) -> dict:
        return {"runs": bench(self.spark, f"{self.root}/bench", workloads.clamp(ops, 50, 2000))}

    # streams: one at a time, micro-batch by micro-batch

    def stream_start(self, mode: str = "stream1", operations: int = 10_000, devices: int = 100, batch: int = 5000, rate: float = 0.0) -> dict:
        """``rate``: at most so many operations a second (0: as fast as batches go)."""
        if self.worker is not None and self.worker.is_alive():
            raise RuntimeError("a stream is already running")
        operations = workloads.clamp(operations, 100, 500_000)
        ops = workloads.stream_ops(self.spark, mode, operations, devices)
        self.stopping, self.progress = False, {"status": "running", "mode": mode, "done": 0, "operations": operations, **dict.fromkeys(("put", "update", "delete", "get"), 0)}

        def work() -> None:
            began = time.monotonic()
            for at in range(0, operations, batch):
                if self.stopping:
                    break
                part = ops.where(F.col("seq").between(at, at + batch - 1))
                with self.lock:
                    self.store.append(part.withColumn("seq", F.col("seq") - at))
                for r in part.groupBy("op").count().collect():
                    self.progress[r["op"]] += r["count"]
                self.progress["done"] = min(operations, at + batch)
                while rate > 0 and not self.stopping and (wait := began + self.progress["done"] / rate - time.monotonic()) > 0:
                    time.sleep(min(wait, 0.2))
            self.progress["status"] = "stopped" if self.stopping else "done"

        self.worker = threading.Thread(target=work, daemon=True)
        self.worker.start()
        return self.stream_status()

    def stream2_start(self, **options) -> dict:
        return self.stream_start(**{"mode": "stream2", **options})

    def stream_status(self) -> dict:
        return {**self.progress, "percent": 100 * self.progress["done"] / max(1, self.progress["operations"])}

    def stream_stop(self) -> dict:
        self.stopping = True
        if self.worker is not None:
            self.worker.join()
        return self.stream_status()

    # scripted runs on stores of their own

    def experiment_run(self, script: str) -> dict:
        return lab.run_script(self.spark, f"{self.root}/lab", script)

    def verify(self, suite: str = "full", ops: int = 1000) -> dict:
        return verify.run_suite(self.spark, f"{self.root}/verify", suite, ops)

    def demo_run(self, events: int = 600) -> dict:
        """A walk through inserts, overwrites, deletes and compactions, with the levels after each phase."""
        n, timeline = workloads.clamp(events, 60, 2000), []
        store = Store(self.spark, f"{self.root}/demo", SMALL)
        store.reset()

        def phase(name: str, *steps) -> None:
            for step in steps:
                step()
            timeline.append({"phase": name, "memory": store.memory(), "levels": store.catalog.levels()})

        write = lambda a, z, kind: lambda: store.append(workloads.demo_ops(self.spark, a, z, kind))
        phase("empty")
        phase("inserts", write(0, n, "insert"))
        phase("overwrites", write(0, n // 6, "overwrite"))
        phase("deletes", write(n // 2, n // 2 + n // 10, "delete"), store.flush)
        phase("level 0 compacted", lambda: store.compact(0))
        phase("second wave", write(n, n + n // 3, "second-wave"), store.flush, lambda: store.compact(0))
        phase("level 1 compacted", lambda: store.compact(1))
        gone, kept = store.get(f"demo:event:{n // 2}"), store.get("demo:event:0")
        return {"status": "pass" if not gone[0] and kept[0] else "fail", "events_requested": n, "timeline": timeline, "trace": store.trace(80)}


CALLS = tuple(n for n in vars(Console) if not n.startswith("_"))
READS = ("metrics", "lsm_state", "debug_state", "debug_files", "trace_status", "trace_read", "stream_status")


def handler(console: Console) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            name = self.path.partition("?")[0].removeprefix("/api/").replace("/", "_").replace("-", "_")
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            options = {}
            if name.removeprefix("verify_") in verify.SUITES and name.startswith("verify_"):
                name, options = "verify", {"suite": name.removeprefix("verify_")}
            if not self.path.startswith("/api/") or name not in CALLS:
                status, out = 404, {"error": "not found"}
            elif self.command == "GET" and name not in READS:
                status, out = 405, {"error": "use POST"}
            else:
                try:
                    status, out = 200, getattr(console, name)(**({**json.loads(body), **options} if body else options))
                except (TypeError, ValueError, RuntimeError) as e:
                    status, out = 400, {"error": str(e)}
            self._send(status, json.dumps(out, default=str).encode())

        def _send(self, status: int, text: bytes) -> None:
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def do_OPTIONS(self) -> None:
            self._send(204, b"")

        do_GET = do_POST = _answer

        def log_message(self, *_) -> None:
            pass

    return Handler


def serve(console: Console, port: int = 8080) -> HTTPServer:
    return HTTPServer(("127.0.0.1", port), handler(console))


if __name__ == "__main__":
    session = SparkSession.builder.appName("driftlog-console").getOrCreate()
    serve(Console(session, sys.argv[1]), int(sys.argv[2]) if len(sys.argv) > 2 else 8080).serve_forever()
