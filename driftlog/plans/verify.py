"""Verification suites: phases of writes and maintenance, each compared with a model that is computed apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.plans.store import Store
from driftlog.plans.workloads import clamp, sequence_events

SUITES = ("basic", "overwrite", "delete", "flush", "bloom", "compaction", "recovery", "gc", "full")
#: phases in order, each with the suites that it belongs to; a suite includes what it builds on
PHASES = (
    ("overwrite", {"overwrite", "delete", "flush", "compaction", "bloom", "recovery", "full"}),
    ("delete", {"delete", "flush", "compaction", "bloom", "recovery", "full"}),
    ("flush", {"flush", "compaction", "bloom", "recovery", "full"}),
    ("compaction", {"compaction", "bloom", "recovery", "full"}),
    ("bloom", {"bloom", "full"}),
    ("recovery", {"recovery", "full"}),
    ("gc", {"gc"}),
)


#: differences that a phase tells by key
MOST_TOLD = 25


def differences(model: DataFrame, found: DataFrame) -> tuple[Column, DataFrame]:
    """(kind of difference, null-free, to be used on) both states (``key, value``) side by side."""
    want = model.select("key", F.col("value").alias("want"), F.lit(True).alias("wanted"))
    have = found.select("key", F.col("value").alias("have"), F.lit(True).alias("there"))
    kind = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("there").isNull(), "missing").when(~F.col("want").eqNullSafe(F.col("have")), "different").otherwise("same")
    return kind, want.join(have, "key", "full_outer")


class Suite:
    def __init__(self, store: Store, ops: int) -> None:
        self.store, self.n, self.spark = store, clamp(ops, 100, 100_000), store.spark
        self.phases: list[dict[str, object]] = []
        self.written: list[DataFrame] = []

    def write(self, rows: DataFrame) -> None:
        self.store.append(rows)
        self.written.append(rows.select("key", "op", "value", F.lit(len(self.written)).alias("round")))

    def model(self) -> DataFrame:
        """Later rounds win; a round has each key once."""
        rows = self.written[0]
        for r in self.written[1:]:
            rows = rows.unionAll(r)
        return rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "round").alias("w")).select("key", "w.*").where("op <> 'delete'")

    def check(self, phase: str, fine: bool = True, **more) -> None:
        kind, both = differences(self.model(), self.store.live())
        judged = both.select("key", kind.alias("kind"))
        got = judged.agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "same").alias("bad")).first()
        details = [f"{r['key']}: {r['kind']}" for r in judged.where("kind <> 'same'").orderBy("key").limit(MOST_TOLD).collect()] if got["bad"] else []
        self.phases.append({"phase": phase, "checked": got["n"], "mismatches": got["bad"], "ok": fine and not got["bad"], "details": details, **more})

    def basic(self) -> None:
        self.write(sequence_events(self.spark, 0, self.n, 1))
        self.check("basic")

    def overwrite(self) -> None:
        self.write(sequence_events(self.spark, 0, max(1, self.n // 10), 2))
        self.check("overwrite")

    def delete(self) -> None:
        gone = max(1, self.n // 20)
        self.write(sequence_events(self.spark, self.n - gone, gone, 1).withColumn("op", F.lit("delete")).withColumn("value", F.lit(None).cast("string")))
        found = self.store.live().join(self.written[-1].select("key"), "key", "left_semi").count()
        self.check("delete", not found, deleted=gone, found=found)

    def flush(self) -> None:
        before = len(self.store.catalog.level(0))
        self.store.flush()
        after = len(self.store.catalog.level(0))
        self.check("flush", after > before, l0_before=before, l0_after=after)

    def compaction(self) -> None:
        for batch in range(4):
            self.write(sequence_events(self.spark, self.n + 250 * batch, 250, 1))
            self.store.flush()
        before = len(self.store.catalog.level(0))
        self.store.compact(0)
        after = len(self.store.catalog.level(0))
        self.check("compaction", after < before, l0_before=before, l0_after=after)

    def bloom(self) -> None:
        missing = self.model().select(F.concat("key", F.lit(":missing")).alias("key")).limit(500)
        found = self.store.multi_get(missing).where("found").count()
        keys = [r["key"] for r in missing.orderBy("key").limit(3).collect()]
        before = dict(self.store.reads)
        some = sum(self.store.get(k)[0] for k in keys)
        asked = {k: self.store.reads[k] - before[k] for k in ("sst_considered", "bloom_skips", "sst_searches")}
        self.check("bloom", not found and not some, missing=500, found=found, **asked)

    def recovery(self) -> None:
        self.store = self.store.reopen()
        self.check("recovery")

    def gc(self) -> None:
        self.write(sequence_events(self.spark, 0, max(1, self.n // 2), 3))
        sizes = self.store.collect()
        self.check("gc", sizes["bytes_after"] < sizes["bytes_before"], **sizes)


def run_suite(spark: SparkSession, root: str, name: str = "full", ops: int = 1000) -> dict[str, object]:
    if name not in SUITES:
        raise ValueError(f"unknown suite {name}")
    store = Store(spark, root)
    store.reset()
    suite = Suite(store, ops)
    suite.basic()
    for phase, suites in PHASES:
        if name in suites:
            getattr(suite, phase)()
    return {"suite": name, "status": "pass" if all(p["ok"] for p in suite.phases) else "fail", "live_keys": suite.store.summary()["live_keys"], "phases": suite.phases}
