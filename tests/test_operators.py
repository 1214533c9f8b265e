import random

import pytest
from pyspark.sql import functions as F

from driftlog.operators import lww, metrics, runs

OPS = "seq bigint, key string, op string, value string"


def log(spark, seed, n=400, keys=9):
    rng = random.Random(seed)
    rows = [(i, f"k{min(rng.randrange(keys), rng.randrange(keys))}", rng.choice(["put", "put", "update", "delete", "get"]), f"v{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, OPS)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_as_of_reads_see_what_stood_before_them(spark, block):
    rows, ops = log(spark, block)
    state, want = {}, {}
    for seq, key, op, value in rows:
        if op == "get":
            want[seq] = (key in state, state.get(key))
        elif op == "delete":
            state.pop(key, None)
        else:
            state[key] = value
    got = lww.as_of(ops.where("op = 'get'"), ops.where("op <> 'get'"), block)
    assert {r["seq"]: (r["found"], r["value"]) for r in got.collect()} == want


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_delete_effects_and_versions(spark, block):
    rows, ops = log(spark, 5)
    live, effect, version, seen = set(), {}, {}, {}
    for seq, key, op, _ in rows:
        if op != "get":
            seen[key] = version[seq] = seen.get(key, 0) + 1
        if op == "delete":
            effect[seq] = key in live
            live.discard(key)
        elif op != "get":
            live.add(key)
    writes = ops.where("op <> 'get'")
    assert {r["seq"]: r["was_live"] for r in lww.delete_effect(writes, block).collect()} == effect
    ranked = lww.version_rank(writes.select("seq", "key"), block).collect()
    assert {r["seq"]: r["version"] for r in ranked} == version
    assert {r["seq"]: r["newest_rank"] for r in ranked} == {r["seq"]: seen[r["key"]] - version[r["seq"]] + 1 for r in ranked}


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_offsets_are_running_sums(spark, block):
    rows, ops = log(spark, 6)
    at, want = 0, {}
    for seq, _, op, value in rows:
        if op in ("put", "update"):
            want[seq], at = at, at + 4 + len(value)
    got = runs.value_offsets(ops.where("op <> 'get'"), block)
    assert {r["seq"]: r["offset"] for r in got.collect()} == want


@pytest.mark.parametrize(("n", "values"), [(1, 5), (10, 3), (1000, 7), (1000, 10**6)])
def test_ranks_are_exact(spark, n, values):
    rng = random.Random(n)
    v = [float(rng.randrange(values)) for _ in range(n)]
    frame = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    got = {r["percentile"]: r["latency"] for r in metrics.ranks(frame, "v", blocks=16).collect()}
    assert got == {f"p{round(100 * p)}": sorted(v)[min(int(n * p), n - 1)] for p in (0.5, 0.95, 0.99)}


def test_ranks_of_nothing(spark):
    assert metrics.ranks(spark.createDataFrame([], "v double"), "v").count() == 0


def test_levels_win_over_older_ones(spark):
    rows = [("a", 0, 1, 0, "put", "old"), ("a", 4, 0, 9, "delete", None), ("b", 5, 0, 3, "put", "1"), ("b", 6, 0, 4, "put", "2"), ("c", 0, 1, 2, "put", "3")]
    got = runs.merge_levels(spark.createDataFrame(rows, "key string, run_seq int, level int, seq bigint, op string, value string"))
    assert {r["key"]: (r["op"], r["value"]) for r in got.collect()} == {"a": ("delete", None), "b": ("put", "2"), "c": ("put", "3")}


def test_overlaps_and_candidates(spark):
    meta = spark.createDataFrame([(1, "a", "f"), (2, "f", "k"), (3, "m", "z")], "run_seq int, min_key string, max_key string")
    assert [tuple(r) for r in runs.range_overlaps(meta).collect()] == [(1, 2)]
    got = runs.candidate_runs(spark.createDataFrame([("f",), ("l",), ("zz",)], "key string"), meta)
    assert {r["key"]: r["candidates"] for r in got.collect()} == {"f": 2, "l": 0, "zz": 0}


def test_ratios_without_a_denominator(spark):
    assert spark.range(1).select(metrics.ratio(F.lit(3), F.lit(0)), metrics.ratio(F.lit(3), F.lit(2))).first() == (0.0, 1.5)


def test_candidates_of_few_and_of_many_runs_agree(spark):
    import random

    from driftlog.operators import runs

    rng = random.Random(3)
    key = lambda: f"k{rng.randrange(500):03d}"
    ranges = [tuple(sorted((key(), key()))) for _ in range(60)]
    keys = sorted({key() for _ in range(300)} | {a for a, _ in ranges} | {z for _, z in ranges})
    meta = spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(ranges)], "run_seq bigint, min_key string, max_key string")
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    want = {k: sum(a <= k <= z for a, z in ranges) for k in keys}
    for most in (1000, 5):
        assert {r["key"]: r["candidates"] for r in runs.candidate_runs(frame, meta, most).collect()} == want


def test_chunks_of_keys_with_one_head_are_cut_into_blocks(spark):
    from pyspark.sql import functions as F

    from driftlog.operators import runs

    keys = spark.range(5000).select(F.format_string("lab:event:%08d", "id").alias("key"))
    assert runs.blocks_by_range(keys, "key", 64).groupBy("block").count().agg(F.max("count")).first()[0] < 1000
    got = {r["key"]: r["chunk"] for r in runs.chunks(keys, 1000).collect()}
    assert got == {f"lab:event:{i:08d}": i * 38 // 1000 for i in range(5000)}
