"""A store on shared files: segments of the operation log, sorted runs in levels, and a catalog.

State is last write wins by sequence number, so every maintenance step (flush, compaction, collection,
recovery) is a rewrite that leaves the visible relation as it is. A step writes new folders first, then
commits a catalog that names them, then removes the old ones; whatever a stopped step leaves behind is not
in the catalog and goes when the store is opened again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions.binary import BloomFilter, filter_rows, record_crc
from driftlog.operators import lww, metrics, runs
from driftlog.package import ship_package
from driftlog.plans.catalog import Catalog, Files, Run
from driftlog.schemas import ENTRY_BYTES, FOOTER_BYTES, VALUE_HEADER, Limits
from driftlog.sources.oplog import accepted, checked

ROW = "key string, seq bigint, op string, value string"
#: events that a store remembers, keys that one Bloom filter answers for, and levels that maintenance goes down
MOST_TRACED, FILTER_KEYS, MOST_LEVELS = 200, 1 << 20, 32


class Store:
    """Open (and recover) the store at ``root``."""

    def __init__(self, spark: SparkSession, root: str, limits: Limits = Limits()) -> None:
        self.spark, self.root, self.limits = spark, root.rstrip("/"), limits
        self.files = Files(spark, self.root)
        self.damage: dict[str, object] = {}
        self.reads = {"get_calls": 0, "sst_considered": 0, "bloom_skips": 0, "sst_searches": 0, "vlog_reads": 0}
        self.catalog = Catalog.load(self.files)
        self._recover()

    # ------------------------------------------------------------ writing

    def append(self, ops: DataFrame) -> int:
        """Append writes (``seq`` orders them; also ``key, op, value``) as one segment; returns how many.

        Gets are passed over; rejected rows raise before anything is written.
        """
        good, bad = accepted(ops.select("seq", "key", "op", "value"))
        if reasons := [r["reason"] for r in bad.select("reason").distinct().collect()]:
            raise ValueError(f"rejected operations: {', '.join(sorted(reasons))}")
        self.maintain()
        rows = good.where("op <> 'get'").withColumn("seq", F.col("seq") + self.catalog.next_seq)
        name = self._name("segment")
        rows.select("key", "seq", "op", "value", record_crc(F.col("key"), F.when(F.col("op") != "delete", F.col("value"))).alias("crc")).write.parquet(f"{self.root}/{name}")
        seen = self._segments([name]).agg(
            F.count("*").alias("n"), F.max("seq").alias("last"), F.coalesce(F.sum(metrics.user_bytes()), F.lit(0)).alias("user"),
            F.coalesce(F.sum(metrics.storage_bytes()), F.lit(0)).alias("stored"), F.count_if(F.col("op") == "delete").alias("deletes"),
        ).first()
        if not seen["n"]:
            self.files.remove(name)
            return 0
        self.catalog.segments.append(name)
        self.catalog.next_seq = seen["last"] + 1
        for k, v in (("user_bytes_written", seen["user"]), ("storage_bytes_written", seen["stored"]), ("put_calls", seen["n"] - seen["deletes"]), ("delete_calls", seen["deletes"])):
            self.catalog.stats[k] += v
        self._commit("append", f"{name} with {seen['n']} writes")
        return seen["n"]

    def put(self, key: str, value: str, op: str = "put") -> None:
        self.append(self.spark.createDataFrame([(0, key, op, value)], "seq bigint, key string, op string, value string"))

    def delete(self, key: str) -> None:
        self.append(self.spark.createDataFrame([(0, key, "delete", None)], "seq bigint, key string, op string, value string"))

    # ------------------------------------------------------------ reading

    def _segments(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*[f"{self.root}/{n}" for n in names])

    def _rows(self, found: list[Run]) -> DataFrame:
        return self._segments([r.path for r in found])

    def log(self) -> DataFrame:
        """Every write that is still stored: runs and segments. Readers take the list from the catalog, never from a folder."""
        return self._segments([r.path for r in self.catalog.runs] + self.catalog.segments)

    def current(self) -> DataFrame:
        return lww.resolve(self.log())

    def live(self) -> DataFrame:
        return self.current().where("op <> 'delete'").select("key", "value")

    def get(self, key: str, bypass_filter: bool = False) -> tuple[bool, str | None]:
        """Newest first: segments, then runs. A run is opened if its Bloom filter for the key's range may hold
        the key, or, with ``bypass_filter``, whatever it says. Below level 0, runs of other ranges are not considered."""
        self.reads["get_calls"] += 1
        names = list(self.catalog.segments)
        found = self._newest(self._segments(names), key) if names else None
        for level in sorted({r.level for r in self.catalog.runs}):
            for run in self.catalog.level(level):
                if found is not None:
                    break
                if level and not run.min_key <= key <= run.max_key:
                    continue
                self.reads["sst_considered"] += 1
                if not bypass_filter and not self.may_contain(run, key):
                    self.reads["bloom_skips"] += 1
                    continue
                self.reads["sst_searches"] += 1
                found = self._newest(self._rows([run]), key)
        if found is None or found["op"] == "delete":
            return False, None
        self.reads["vlog_reads"] += 1
        return True, found["value"]

    def may_contain(self, run: Run, key: str) -> bool:
        """What the run's filters say. A key outside all their ranges is certainly not there."""
        if not run.min_key <= key <= run.max_key:
            return False
        filters = self.spark.read.schema("min_key string, max_key string, k int, bits binary").parquet(f"{self.root}/{run.filters}")
        near = filters.where((F.col("min_key") <= key) & (F.col("max_key") >= key)).select("k", "bits")
        return any(BloomFilter.load(r["k"], bytes(r["bits"])).may_contain(key) for r in near.toLocalIterator())

    def memory_scan(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The newest write of each key that is not flushed yet, in the order of keys, between two keys."""
        rows = self._segments(self.catalog.segments)
        if first is not None:
            rows = rows.where(F.col("key") >= first)
        if last is not None:
            rows = rows.where(F.col("key") <= last)
        return lww.resolve(rows).orderBy("key")

    def _newest(self, rows: DataFrame, key: str):
        return rows.where(F.col("key") == key).orderBy(F.desc("seq")).limit(1).first()

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return lww.multi_get(keys.select("key").distinct(), self.log())

    # ------------------------------------------------------------ maintenance

    def _name(self, kind: str) -> str:
        """A folder name that no other attempt uses."""
        n, self.catalog.next_name = self.catalog.next_name, self.catalog.next_name + 1
        return f"{kind}-{n:08d}-{uuid.uuid4().hex[:8]}"

    def _commit(self, event: str, detail: str) -> None:
        if self.catalog.tracing:
            self.catalog.trace = [*self.catalog.trace, f"{event} | {detail}"][-MOST_TRACED:]
        self.catalog.commit(self.files)

    def set_tracing(self, on: bool) -> None:
        """Whether events are kept from now on; the store remembers it."""
        if on != self.catalog.tracing:
            self.catalog.tracing = on
            self._commit("trace", "enabled" if on else "disabled")

    def _write_runs(self, rows: DataFrame, level: int, chunk_bytes: int | None = None) -> list[Run]:
        """Rows as sorted runs, each with Bloom filters over its keys.

        Without ``chunk_bytes`` one run, of ranges of keys in files; else as many runs, by ranges of keys, as
        there are so many bytes of keys.
        """
        name, rows = self._name("run"), rows.select("key", "seq", "op", "value")
        at = f"{self.root}/{name}"
        if chunk_bytes is None:
            rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{at}/chunk=0")
        else:
            size = rows.agg(F.sum(F.octet_length("key") + ENTRY_BYTES)).first()[0] or 0
            chunked = rows.repartitionByRange(size // chunk_bytes + 1, "key").withColumn("chunk", F.spark_partition_id())
            chunked.sortWithinPartitions("chunk", "key").write.partitionBy("chunk").parquet(at)
        written = self.spark.read.schema(f"{ROW}, chunk int").parquet(at)
        made = written.groupBy("chunk").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("b")).orderBy("chunk").collect()  # a row for each run
        if not made:
            self.files.remove(name)
            return []
        out = []
        for i, m in enumerate(made):
            if i:
                self.catalog.next_name += 1
            path = f"{name}/chunk={m['chunk']}"
            out.append(Run(self.catalog.next_name - 1, level, path, m["a"], m["z"], m["n"], m["b"], f"{name}/_filters/chunk={m['chunk']}"))
            self.catalog.stats["storage_bytes_written"] += m["b"] + ENTRY_BYTES * m["n"] + FOOTER_BYTES
        ship_package(self.spark)
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, str(FILTER_KEYS))
        try:  # the folder's name begins with a line, so readers of the run do not see it
            filters = written.select("chunk", "key").mapInPandas(filter_rows, "chunk int, min_key string, max_key string, k int, bits binary")
            filters.write.partitionBy("chunk").parquet(f"{at}/_filters")
        finally:
            self.spark.conf.set(setting, before)
        return out

    def memory(self) -> dict[str, int]:
        """Entries of the not yet flushed state, and the bytes that count towards a flush."""
        m = self._segments(self.catalog.segments).groupBy("key").agg(F.lit(1)).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + 24), F.lit(0)).alias("b")).first()
        return {"entries": m["n"], "bytes": m["b"]}

    def flush(self) -> bool:
        """Not yet flushed writes, newest of each key, as a run of level 0."""
        old = list(self.catalog.segments)
        if not old:
            return False
        self.catalog.runs += self._write_runs(lww.resolve(self._segments(old)), 0)
        self.catalog.segments = []
        self._commit("flush", f"{len(old)} segments")
        for name in old:
            self.files.remove(name)
        return True

    def compact(self, level: int = 0) -> bool:
        """All runs of a level, with the runs of the next that their keys meet, as runs of the next by ranges of keys.

        Runs of the next level that their keys do not meet stay as they are.
        """
        source = self.catalog.level(level)
        if not source:
            return False
        lo, hi = min(r.min_key for r in source), max(r.max_key for r in source)
        target = [r for r in self.catalog.level(level + 1) if r.max_key >= lo and r.min_key <= hi]
        retained = len(self.catalog.level(level + 1)) - len(target)
        merged = self._write_runs(runs.compact(self._ranked(source), self._ranked(target)), level + 1, self.limits.flush_bytes)
        gone = {r.path for r in source + target}
        self.catalog.runs = [r for r in self.catalog.runs if r.path not in gone] + merged
        self._commit("compact", f"level {level}: {len(source)} runs, {len(target)} of the next, {retained} retained, {len(merged)} written")
        for run in source + target:
            self._drop(run)
        return True

    def _drop(self, run: Run) -> None:
        """Remove a run's files, and its folder when no other run of it is left."""
        self.files.remove(run.path)
        self.files.remove(run.filters)
        name = run.path.partition("/")[0]
        if not any(r.path.partition("/")[0] == name for r in self.catalog.runs + self.catalog.pending):
            self.files.remove(name)

    def _ranked(self, found: list[Run]) -> DataFrame:
        """Rows of runs with ``run_seq``."""
        parts = [self._rows([r]).withColumn("run_seq", F.lit(r.run_seq)) for r in found]
        out = parts[0] if parts else self.spark.createDataFrame([], f"{ROW}, run_seq int")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def maintain(self) -> None:
        """Compact every level over its limit, and those that this brings over theirs; then flush if enough is in memory."""
        level = 0
        while level <= max(self.catalog.levels(), default=-1) and level < MOST_LEVELS:
            deepest = level == max(self.catalog.levels())
            if len(self.catalog.level(level)) > self.limits.of_level(level) and not (deepest and level and self.limits.growth < 2):  # a level that holds no more is no help
                self.compact(level)
            level += 1
        if self.catalog.segments and self.memory()["bytes"] >= self.limits.flush_bytes:
            self.flush()

    def collect(self) -> dict[str, int]:
        """Drop shadowed values: rewrite what is visible (tombstones stay) as one run of the deepest level."""
        before = self.value_bytes()
        self.catalog.phase, self.catalog.pending = "started", []
        self._commit("gc", "started")
        level = max([1, *self.catalog.levels()])
        self.catalog.phase = "isolated"
        self._commit("gc", "isolated")
        user = self.catalog.stats["user_bytes_written"]
        self.catalog.pending = self._write_runs(self.current(), level)
        self.catalog.stats["user_bytes_written"] = user  # nobody asked for these writes
        self.catalog.phase = "rewrite_complete"
        self._commit("gc", "rewrite_complete")
        self._finish_collection()
        return {"bytes_before": before, "bytes_after": self.value_bytes()}

    def value_bytes(self) -> int:
        """Bytes of all stored values with their length fields, shadowed ones too."""
        return self.log().where("op <> 'delete'").agg(F.coalesce(F.sum(F.octet_length("value") + VALUE_HEADER), F.lit(0))).first()[0]

    def _finish_collection(self) -> None:
        gone, names = list(self.catalog.runs), list(self.catalog.segments)
        self.catalog.runs, self.catalog.segments, self.catalog.pending, self.catalog.phase = self.catalog.pending, [], [], ""
        self._commit("gc", "done")
        for run in gone:
            self._drop(run)
        for name in names:
            self.files.remove(name)

    def _recover(self) -> None:
        """Finish or undo a collection, cut damaged segments off, then remove folders that no catalog names."""
        if self.catalog.phase == "rewrite_complete":
            self._finish_collection()
        elif self.catalog.phase:
            self.catalog.phase, self.catalog.pending = "", []
            self._commit("gc", "rolled back")
        self._truncate()
        for name in self.orphans():
            self.files.remove(name)

    def _truncate(self) -> None:
        """Replay stops at the first record whose checksum is wrong: it and all that follows are cut off."""
        if not self.catalog.segments:
            return
        stored = self.spark.read.schema(f"{ROW}, crc bigint").parquet(*[f"{self.root}/{n}" for n in self.catalog.segments])
        bad = stored.where(~F.coalesce(checked(stored), F.lit(False))).agg(F.min("seq")).first()[0]
        if bad is None:
            return
        kept, left = stored.where(F.col("seq") < bad), []
        before = stored.agg(F.count("*")).first()[0]
        name = self._name("segment")
        kept.write.parquet(f"{self.root}/{name}")
        seen = self._segments([name]).agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
        if seen["n"]:
            left = [name]
        self.damage = {"bad_seq": bad, "safe_seq": seen["last"], "kept": seen["n"], "lost": before - seen["n"]}
        self.catalog.segments, self.catalog.next_seq = left, bad
        self._commit("recover", f"log damaged at {bad}, {seen['n']} records kept")

    def replace_segment(self, name: str, rows: DataFrame) -> None:
        """Put other rows (with ``crc``) in the place of a segment; what damages and repairs are made with."""
        new = self._name("segment")
        rows.select("key", "seq", "op", "value", "crc").write.parquet(f"{self.root}/{new}")
        self.catalog.segments[self.catalog.segments.index(name)] = new
        self._commit("replace", f"{name} by {new}")
        self.files.remove(name)

    def orphans(self) -> list[str]:
        """Folders of runs and segments, and chunks of runs, that the catalog does not name."""
        held = self.catalog.runs + self.catalog.pending
        named = {r.path.partition("/")[0] for r in held} | set(self.catalog.segments)
        chunks = {p for r in held for p in (r.path, r.filters)}
        out = []
        for n in self.files.names():
            if not n.startswith(("run-", "segment-")):
                continue
            if n not in named:
                out.append(n)
            elif n.startswith("run-"):
                inside = [f"{n}/{x}" for x in self.files.names(n)] + [f"{n}/_filters/{x}" for x in self.files.names(f"{n}/_filters")]
                out += [x for x in inside if x.rpartition("/")[2].startswith("chunk=") and x not in chunks]
        return out

    def reopen(self) -> Store:
        return Store(self.spark, self.root, self.limits)

    def reset(self) -> None:
        self.files.remove("")
        self.catalog = Catalog()
        self._commit("reset", "")

    # ------------------------------------------------------------ reports

    def metrics(self) -> dict[str, float]:
        s, r = self.catalog.stats, self.reads
        share = lambda a, b: a / b if b else 0.0
        summary = self.summary()
        disk = self.files.size("")
        return {
            **s, **r, **summary, "total_disk_bytes": disk, "write_amplification": share(s["storage_bytes_written"], s["user_bytes_written"]),
            "read_amplification": share(r["sst_searches"] + r["vlog_reads"], r["get_calls"]), "filter_effect_percent": 100 * share(r["bloom_skips"], r["sst_considered"]),
            "space_amplification": share(disk, summary["live_logical_bytes"]),
        }

    def summary(self) -> dict[str, int]:
        return lww.storage_summary(self.current()).first().asDict()

    def state(self) -> dict[str, object]:
        levels = self.catalog.levels()
        return {"memory": self.memory(), "levels": levels, "pressure": {n: 100 * c / self.limits.of_level(n) for n, c in levels.items()}, "version": self.catalog.version, "phase": self.catalog.phase}

    def describe_files(self) -> list[dict[str, object]]:
        """Each run and segment, whether the catalog names it, and those of the catalog that are missing."""
        named = {r.path: r.level for r in self.catalog.runs} | {s: -1 for s in self.catalog.segments}
        there = set(self.orphans()) | {n for n in named if self.files.exists(n)}
        return [{"name": n, "kind": n.partition("-")[0], "level": named.get(n), "in_catalog": n in named, "exists": n in there, "bytes": self.files.size(n)} for n in sorted(there | set(named))]

    def bytes_by_kind(self) -> dict[str, dict[str, int]]:
        """Number and bytes of the files of each kind: runs, their filters, segments and the catalog."""
        out = {k: {"files": 0, "bytes": 0} for k in ("run", "filter", "segment", "catalog")}
        places = [("run", r.path) for r in self.catalog.runs] + [("filter", r.filters) for r in self.catalog.runs] + [("segment", n) for n in self.catalog.segments]
        newest = [n for n in self.files.names() if n.startswith("catalog-") and n.endswith(".json")][-1:]
        for kind, name in places + [("catalog", n) for n in newest]:
            out[kind]["files"] += 1
            out[kind]["bytes"] += self.files.size(name)
        return out

    def trace(self, last: int = MOST_TRACED) -> list[str]:
        return self.catalog.trace[-last:]

