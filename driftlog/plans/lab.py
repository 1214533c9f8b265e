"""Experiment scripts: a line language whose operations run on a store and on a plain model, then compared.

    put <key> <value> | update <key> <value> | get <key> | delete <key>
    insert|update|delete|get <a>..<b> [random|sequential]
    flush | compact | compact_l1 | recover | verify | state        # comment

The script becomes a list of steps on the driver; a range of any length becomes one DataFrame. The store
and the model are two separate evaluations: the store's visible state comes from its files, the model is
last write wins over the script's own operations, and a full outer join of both finds mismatches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.functions import formats
from driftlog.plans.store import Store
from driftlog.schemas import SMALL

LONGEST_RANGE = 20_000
OPS = "seq bigint, key string, op string, value string"


@dataclass
class Step:
    verb: str
    text: str
    ids: tuple[int, int] | None = None
    order: str = "sequential"
    key: str = ""
    value: str = ""
    bad: bool = False


def parse(script: str) -> list[Step]:
    steps = []
    for line in script.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        words = line.split()
        verb, ranged = words[0].lower(), len(words) > 1 and ".." in words[1]
        step = Step({"compact-l1": "compact_l1", "restart": "recover"}.get(verb, verb), line)
        if verb in ("insert", "update", "delete", "get") and ranged:
            step.ids = _range(words[1])
            step.order = "random" if len(words) > 2 and words[2].lower() == "random" else "sequential"
            step.bad = step.ids is None
        elif verb in ("put", "update"):
            parts = line.split(None, 2)
            step.bad = len(parts) < 3
            step.key, step.value = (parts[1], parts[2]) if not step.bad else ("", "")
        elif verb in ("get", "delete"):
            step.bad = len(words) < 2
            step.key = words[1] if not step.bad else ""
        elif step.verb not in ("flush", "compact", "compact_l1", "recover", "verify", "state"):
            step.bad = True
        steps.append(step)
    return steps


def _range(text: str) -> tuple[int, int] | None:
    a, _, b = text.partition("..")
    if not (a.isdigit() and b.isdigit()):
        return None
    lo, hi = sorted((int(a), int(b)))
    return (lo, hi) if hi - lo < LONGEST_RANGE else None


def _payload() -> Column:
    """The JSON text of a lab event, from ``id``, ``version`` and ``op_name``."""
    i, v = F.col("id"), F.col("version")
    return F.format_string(
        '{"device_id":"device_%d","sensor":"edge_lab","sequence":%d,"version":%d,"op":"%s","temperature_c":%.2f,"vibration_g":%.3f}',
        i % 128, i, v, F.col("op_name"), F.lit(20.0) + ((i * 37 + v * 11) % 1800).cast("double") / 100.0, F.lit(0.1) + ((i * 17 + v * 7) % 900).cast("double") / 1000.0,
    )


@dataclass
class Lab:
    spark: SparkSession
    store: Store
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys("commands generated_ops puts updates deletes gets flushes compactions recoveries verify_checks mismatches".split(), 0))
    steps: list[tuple[str, bool, str]] = field(default_factory=list)
    details: list[str] = field(default_factory=list)
    ranges: list[tuple[int, int, int, str]] = field(default_factory=list)  # step, first id, last id, verb: for versions
    model: DataFrame | None = None
    at: int = 0
    before: dict[str, int] = field(default_factory=dict)  # counters when the script began

    def __post_init__(self) -> None:
        self.before = dict(self.store.catalog.stats)

    def _bulk(self, n: int, step: Step) -> DataFrame:
        """Operations of a range step. An event's version is the number of inserts and updates of it so far."""
        lo, hi = step.ids
        ids = self.spark.range(lo, hi + 1)
        order = [formats.order_hash(F.col("id")), F.col("id")] if step.order == "random" else [F.col("id")]
        ids = ids.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)  # a step has at most LONGEST_RANGE rows
        if step.verb in ("insert", "update"):
            self.ranges.append((n, lo, hi, step.verb))
        version = sum((F.col("id").between(a, z).cast("int") for _, a, z, _ in self.ranges), F.lit(0))
        rows = ids.withColumn("version", version).withColumn("op_name", F.lit(step.verb))
        op = {"insert": "put"}.get(step.verb, step.verb)
        value = _payload() if op in ("put", "update") else F.lit(None).cast("string")
        return rows.select("seq", F.format_string("lab:event:%08d", "id").alias("key"), F.lit(op).alias("op"), value.alias("value"))

    def _single(self, step: Step) -> DataFrame:
        return self.spark.createDataFrame([(0, step.key, step.verb, step.value or None)], OPS)

    def _apply(self, ops: DataFrame, verb: str, n: int) -> None:
        name = {"insert": "puts", "put": "puts", "update": "updates", "delete": "deletes", "get": "gets"}[verb]
        self.counts[name] += n
        self.counts["generated_ops"] += n
        if verb == "get":
            self.verify(ops.select("key"))
            return
        self.store.append(ops)
        rows = ops.select("key", (F.col("seq") + self.at).alias("seq"), "op", "value")
        self.model = rows if self.model is None else self.model.unionAll(rows)
        self.at += n

    def _expected(self) -> DataFrame:
        if self.model is None:
            return self.spark.createDataFrame([], "key string, op string, value string")
        return self.model.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w")).select("key", "w.*")

    def verify(self, keys: DataFrame | None = None) -> None:
        """Compare the store with the model, on all keys ever written or on some."""
        want = self._expected()
        have = self.store.live().select("key", F.col("value").alias("found"), F.lit(True).alias("there"))
        if keys is not None:
            want = keys.join(want, "key", "left")
            have = have.join(keys, "key", "left_semi")
        both = want.join(have, "key", "full_outer")
        alive = F.coalesce(F.col("op") != "delete", F.lit(False))
        there = F.coalesce(F.col("there"), F.lit(False))
        wrong = F.when(alive & ~there, "missing").when(~alive & there, "unexpected").when(alive & ~F.col("value").eqNullSafe(F.col("found")), "different")
        judged = both.select("key", wrong.alias("wrong"))
        got = judged.agg(F.count("*").alias("n"), F.count("wrong").alias("bad")).first()
        if keys is None:
            self.counts["verify_checks"] += got["n"]
        self.counts["mismatches"] += got["bad"]
        if got["bad"]:
            self.details += [f"{r['key']}: {r['wrong']}" for r in judged.where("wrong IS NOT NULL").limit(25 - len(self.details)).collect()]
        if keys is None:
            self.steps.append(("verify", got["bad"] == 0, f"{got['n']} keys checked"))

    def run(self, script: str) -> dict[str, object]:
        ok = True
        for n, step in enumerate(parse(script)):
            self.counts["commands"] += 1
            if step.bad:
                ok = False
                self.steps.append(("parse", False, f"cannot understand: {step.text}"))
            elif step.ids is not None:
                self._apply(self._bulk(n, step), step.verb, step.ids[1] - step.ids[0] + 1)
                self.steps.append((step.verb, True, step.text))
            elif step.key:
                self._apply(self._single(step), step.verb, 1)
                self.steps.append((step.verb, True, step.text))
            elif step.verb == "verify":
                self.verify()
            else:
                self._maintain(step.verb)
        if not self.counts["commands"]:
            ok = False
            self.steps.append(("parse", False, "the script has no command"))
        else:
            self.verify()
        return self.report(ok)

    def _maintain(self, verb: str) -> None:
        if verb == "flush":
            self.store.flush()
            self.counts["flushes"] += 1
        elif verb in ("compact", "compact_l1"):
            self.store.compact(0 if verb == "compact" else 1)
            self.counts["compactions"] += 1
        elif verb == "recover":
            reads, self.store = self.store.reads, self.store.reopen()
            for k, n in reads.items():  # a session's counters go on
                self.store.reads[k] += n
            self.counts["recoveries"] += 1
        self.steps.append((verb, True, str(self.store.catalog.levels())))

    def report(self, ok: bool) -> dict[str, object]:
        want = self._expected().agg(F.count_if(F.col("op") != "delete").alias("live"), F.count_if(F.col("op") == "delete").alias("gone")).first()
        passed = ok and not self.counts["mismatches"]
        m, kinds, memory, levels = self.store.metrics(), self.store.bytes_by_kind(), self.store.memory(), self.store.catalog.levels()
        written = {k: m[k] - self.before[k] for k in ("user_bytes_written", "storage_bytes_written")}
        share = lambda a, b: a / b if b else 0.0
        values = self.store.value_bytes()
        disk = kinds["segment"]["bytes"] + kinds["run"]["bytes"]
        return {
            **m, "status": "pass" if passed else "fail", **self.counts,
            "script_user_bytes_written": written["user_bytes_written"], "script_storage_bytes_written": written["storage_bytes_written"],
            "model_live_keys": want["live"], "model_deleted_keys": want["gone"],
            "memtable_entries": memory["entries"], "memtable_bytes": memory["bytes"], "flush_threshold": self.store.limits.flush_bytes,
            **{f"l{n}_count": levels.get(n, 0) for n in (0, 1, 2)},
            "wal_bytes": kinds["segment"]["bytes"], "sst_files": kinds["run"]["files"], "sst_bytes": kinds["run"]["bytes"], "vlog_bytes": values, "total_disk_bytes": disk,
            "live_keys_estimate": m["live_keys"], "tombstones_estimate": m["tombstones"], "live_logical_bytes_estimate": m["live_logical_bytes"],
            "space_amplification_estimate": share(disk, m["live_logical_bytes"]), "write_amplification": share(written["storage_bytes_written"], written["user_bytes_written"]),
            "levels": levels, "memory": memory, "steps": self.steps, "mismatch_details": self.details,
        }


def run_script(spark: SparkSession, root: str, script: str) -> dict[str, object]:
    """Run a script on a new small store at ``root``; the report says ``pass`` if every step ran and nothing differs."""
    store = Store(spark, root, SMALL)
    store.reset()
    return Lab(spark, store).run(script)
