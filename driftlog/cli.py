"""Command line: ``python -m driftlog.cli ROOT`` reads verbs from standard input.

    put KEY VALUE | get KEY | delete KEY | load N | bench | state | metrics | exit
    script FILE | verify SUITE [OPS]
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftlog.plans import lab, verify, workloads
from driftlog.plans.store import Store


def bench(spark: SparkSession, root: str, operations: int = 20_000, batches: int = 4) -> list[dict[str, object]]:
    """The four workloads on new stores, cold and then warm.

    Operations come in batches; the latency of an operation is its batch's seconds over the batch's operations,
    and the percentiles are by rank floor(n * p) over all operations.
    """
    out = []
    for kind in ("random_write", "sequential_write", "random_read", "mixed"):
        store = Store(spark, f"{root}/bench-{kind}")
        store.reset()
        if kind in ("random_read", "mixed"):  # something to read
            store.append(workloads.bench_keys(spark, operations))
        for run in ("cold", "warm"):
            ops, before, lots = workloads.bench_ops(spark, kind, operations), dict(store.catalog.stats), []
            written = read = 0
            for b in range(batches):
                lo, hi = b * operations // batches, (b + 1) * operations // batches
                part = ops.where(F.col("seq").between(lo, hi - 1)).withColumn("seq", F.col("seq") - lo)
                began = time.time()
                if kind != "random_read":
                    written += store.append(part)
                if kind in ("random_read", "mixed"):
                    read += store.multi_get(part.where("op = 'get'").select("key")).where("found").count()
                lots.append((hi - lo, time.time() - began))
            took = sum(s for _, s in lots)
            user, stored = (store.catalog.stats[k] - before[k] for k in ("user_bytes_written", "storage_bytes_written"))
            out.append({"kind": kind, "run": run, "writes": written, "hits": read, "seconds": round(took, 3), "ops_per_s": round(operations / took), **_percentiles(lots), "write_amplification": round(stored / user if user else 0.0, 3)})
    return out


def _percentiles(lots: list[tuple[int, float]]) -> dict[str, float]:
    """Microseconds of an operation at the ranks of 50, 95 and 99 in a hundred."""
    n, ordered = sum(k for k, _ in lots), sorted((s / k, k) for k, s in lots if k)
    found = {}
    for p in (0.5, 0.95, 0.99):
        at, passed = int(n * p), 0
        for each, k in ordered:
            passed += k
            if at < passed:
                found[f"p{round(100 * p)}_us"] = round(1e6 * each, 1)
                break
    return found


def execute(store: Store, line: str) -> str | None:
    """Answer to one line; None ends the session."""
    verb, _, rest = line.strip().partition(" ")
    key, _, value = rest.strip().partition(" ")
    match verb.lower():
        case "":
            return ""
        case "exit" | "quit":
            return None
        case "put" if key and value:
            store.put(key, value)
            return "OK"
        case "get" if key:
            found, got = store.get(key)
            return got if found else "(not found)"
        case "delete" if key:
            store.delete(key)
            return "OK"
        case "load" if key.isdigit():
            return f"{store.append(workloads.bench_ops(store.spark, 'sequential_write', int(key)))} written"
        case "bench":
            return "\n".join(json.dumps(r) for r in bench(store.spark, store.root))
        case "state":
            return json.dumps(store.state())
        case "metrics":
            return json.dumps(store.metrics())
        case "script" if key:
            with open(key) as f:
                return json.dumps(lab.run_script(store.spark, f"{store.root}-lab", f.read()))
        case "verify" if key in verify.SUITES:
            return json.dumps(verify.run_suite(store.spark, f"{store.root}-verify", key, int(value) if value.isdigit() else 1000))
    return f"error: cannot understand {line.strip()!r}"


def main(args: list[str]) -> int:
    if len(args) != 1:
        print(__doc__)
        return 2
    store = Store(SparkSession.builder.appName("driftlog").getOrCreate(), args[0])
    for line in sys.stdin:
        if (answer := execute(store, line)) is None:
            break
        print(answer, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
