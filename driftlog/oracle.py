"""DuckDB SQL for the queries, written independently of the Spark plans: runs and levels are left out where
the visible state must not depend on them."""

from __future__ import annotations

OPS = """
ops AS (SELECT event_id AS seq, ts, 'user:' || user_id || ':' || json_extract_string(props, '$.k') AS key,
               CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'get' WHEN 'click' THEN 'update' ELSE 'put' END AS op,
               props AS value FROM events),
writes AS (SELECT * FROM ops WHERE op <> 'get'),
lww AS (SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM writes) WHERE rn = 1),
inruns AS (SELECT *, (seq * 8) // (SELECT count(*) FROM events) AS run_seq FROM writes),
flushed AS (SELECT run_seq, key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY run_seq, key ORDER BY seq DESC) AS rn FROM inruns) WHERE rn = 1),
meta AS (SELECT run_seq, min(key) AS min_key, max(key) AS max_key, count(*) AS entries FROM flushed GROUP BY run_seq),
readkeys AS (SELECT DISTINCT key FROM ops WHERE op = 'get')
"""


def _q(sql: str, more: str = "") -> str:
    return f"WITH {OPS}{', ' + more if more else ''} {sql}"


_USER = "strlen(key) + CASE WHEN op = 'delete' THEN 0 ELSE strlen(value) END"
_STORED = "12 + strlen(key) + CASE WHEN op = 'delete' THEN 0 ELSE 4 + 2 * strlen(value) END"
_PATHS = """paths AS (SELECT r.key,
    CASE WHEN f.hit IS NULL THEN 8 ELSE 8 - f.hit END AS considered,
    CASE WHEN f.hit IS NULL THEN 8 ELSE 8 - f.hit - 1 END AS skipped,
    CASE WHEN f.hit IS NULL THEN 0 ELSE 1 END AS searched,
    CASE WHEN coalesce(l.op, 'delete') = 'delete' THEN 0 ELSE 1 END AS value_reads
  FROM readkeys r LEFT JOIN (SELECT key, max(run_seq) AS hit FROM flushed GROUP BY key) f USING (key) LEFT JOIN lww l USING (key))"""
_CHUNKS = """chunked AS (SELECT key, (sum(strlen(key) + 20) OVER (ORDER BY key) - strlen(key) - 20) // 4096 AS chunk FROM lww),
chunks AS (SELECT CAST(chunk AS BIGINT) AS chunk, min(key) AS min_key, max(key) AS max_key, count(*) AS entries FROM chunked GROUP BY chunk)"""
_OFFSETS = "offs AS (SELECT seq, key, strlen(value) AS length, CAST(sum(4 + strlen(value)) OVER (ORDER BY seq) - 4 - strlen(value) AS BIGINT) AS \"offset\" FROM writes WHERE op <> 'delete')"
_LEVELS = """levels AS (SELECT 0 AS level, run_seq, key FROM flushed WHERE run_seq >= 4 UNION ALL SELECT DISTINCT 1, 0, key FROM flushed WHERE run_seq < 4)"""
_TOPICS = """msgs AS (SELECT event_id AS seq, 'factory/site_a/device/' || user_id || '/' || CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'query' WHEN 'click' THEN 'state/status:health' ELSE 'telemetry' END AS topic, props AS payload FROM events)"""

_OP = "CASE WHEN i % 100 < 80 THEN 'put' WHEN i % 100 < 90 THEN 'update' WHEN i % 100 < 95 THEN 'delete' ELSE 'get' END"
_TELEMETRY = """printf('{"protocol":"http-stream","topic":"","device_id":"device_%d","sequence":%d,"op":"telemetry","temperature_c":%.2f,"vibration_g":%.3f}', DEVICE, i, 20 + CAST(i * 31 % 1800 AS DOUBLE) / 100, 0.10::DOUBLE + CAST(i * 13 % 700 AS DOUBLE) / 1000)"""


def _le32(n: str) -> str:
    """A number below 2**32 as eight hexadecimal digits, lowest byte first."""
    return f"printf('%02X%02X%02X%02X', ({n}) & 255, (({n}) >> 8) & 255, (({n}) >> 16) & 255, (({n}) >> 24) & 255)"


def _byte(x: str, i: str) -> str:
    return f"CAST(('0x' || substr({x}, 2 * ({i}) + 1, 2)) AS BIGINT)"


def _crc32(_: str) -> str:
    """CRC-32 of the bytes ``raw`` (hexadecimal), bit by bit."""
    bit = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    eight = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: " + bit.format(c="v") + ")"
    every = f"list_transform(range(0, length(raw) // 2), lambda i: {_byte('raw', 'i')})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {every}), lambda c, b: {eight}), 4294967295)"


_TWO64, _M = "18446744073709551616::UHUGEINT", "14313749767032793493::UHUGEINT"
_TIMES = "(({a}) * " + _M + " % " + _TWO64 + ")"
_FOLD = "xor({a}, ({a}) >> 47::UHUGEINT)"


def _word(n: str) -> str:
    """Up to eight bytes of the key from byte ``8 * w`` on as a number, lowest first."""
    return f"list_reduce(list_prepend(0::UHUGEINT, list_transform(range(0, {n}), lambda j: {_byte('x', '8 * w + j').replace('BIGINT', 'UHUGEINT')} << CAST(8 * j AS UHUGEINT))), lambda a, b: a + b)"


_K = _TIMES.format(a=_word("8"))
_STEPS = "list_transform(range(0, length(x) // 16), lambda w: " + _TIMES.format(a=_FOLD.format(a=_K)) + ")"
_START = "xor(2538058380::UHUGEINT, " + _TIMES.format(a="(length(x) // 2)::UHUGEINT") + ")"
_BODY = f"list_reduce(list_prepend({_START}, {_STEPS}), lambda h, k: " + _TIMES.format(a="xor(h, k)") + ")"
_TAIL = f"list_reduce(list_prepend({_BODY}, list_transform(CASE WHEN length(x) % 16 = 0 THEN [] ELSE [length(x) // 16] END, lambda w: {_word('(length(x) % 16) // 2')})), lambda h, k: " + _TIMES.format(a="xor(h, k)") + ")"
_END = f"list_transform([{_TAIL}], lambda h: " + _TIMES.format(a=_FOLD.format(a="h")) + ")"
_MURMUR = f"list_transform({_END}, lambda h: CASE WHEN " + _FOLD.format(a="h") + " >= 9223372036854775808::UHUGEINT THEN CAST(CAST(" + _FOLD.format(a="h") + " AS HUGEINT) - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(" + _FOLD.format(a="h") + " AS BIGINT) END)[1]"

ORACLE_SQL: dict[str, str] = {
    "lww_current": _q("SELECT key, seq, op, value FROM lww"),
    "live_snapshot": _q("SELECT key, value FROM lww WHERE op <> 'delete'"),
    "tombstone_keys": _q("SELECT key, seq AS deleted_at FROM lww WHERE op = 'delete'"),
    "storage_summary": _q("SELECT count(*) FILTER (op <> 'delete') AS live_keys, count(*) FILTER (op = 'delete') AS tombstones, CAST(coalesce(sum(strlen(key) + strlen(value)) FILTER (op <> 'delete'), 0) AS BIGINT) AS live_logical_bytes FROM lww"),
    "point_get": _q("SELECT 'user:7:3' AS key, count(*) > 0 AS found, max(value) AS value FROM lww WHERE key = 'user:7:3' AND op <> 'delete'"),
    "multi_get": _q("SELECT r.key, l.key IS NOT NULL AS found, l.value FROM readkeys r LEFT JOIN (SELECT * FROM lww WHERE op <> 'delete') l USING (key)"),
    "get_asof": _q("SELECT g.seq, g.key, coalesce(w.op <> 'delete', false) AS found, CASE WHEN w.op <> 'delete' THEN w.value END AS value FROM (SELECT * FROM ops WHERE op = 'get') g ASOF LEFT JOIN writes w ON g.key = w.key AND g.seq > w.seq"),
    "version_rank": _q("SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS newest_rank FROM writes"),
    "key_versions": _q("SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) AS version FROM writes"),
    "delete_effect": _q("SELECT seq, key, coalesce(before <> 'delete', false) AS was_live FROM (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS before FROM writes) WHERE op = 'delete'"),
    "conversations_latest_turn": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1",
    "stream_lww_current": _q("SELECT key, seq, op, value FROM lww"),
    "op_mix": _q("SELECT op, count(*) AS n FROM ops GROUP BY op"),
    "unique_state_keys": _q("SELECT op, count(DISTINCT key) AS unique_keys FROM ops GROUP BY op"),
    "memtable_stats": _q("SELECT count(*) AS entries, CAST(sum(strlen(key) + 24) AS BIGINT) AS bytes FROM flushed WHERE run_seq = 7"),
    "next_run_seq": _q("SELECT max(run_seq) + 1 AS next_run_seq FROM inruns"),
    "metrics_delta": _q(f"SELECT run_seq, writes, writes - lag(writes, 1, 0) OVER (ORDER BY run_seq) AS writes_delta, CAST(user_bytes - lag(user_bytes, 1, 0) OVER (ORDER BY run_seq) AS BIGINT) AS user_bytes_delta FROM (SELECT run_seq, count(*) AS writes, CAST(sum({_USER}) AS BIGINT) AS user_bytes FROM inruns GROUP BY run_seq)"),
    "byte_accounting": _q(f"SELECT op, count(*) AS n, CAST(sum({_USER}) AS BIGINT) AS user_bytes, CAST(sum({_STORED}) AS BIGINT) AS storage_bytes FROM writes GROUP BY op"),
    "write_amp": _q(f"SELECT u AS user_bytes, s + f AS storage_bytes, round((s + f) / u, 6) AS write_amp FROM (SELECT CAST(sum({_USER}) AS BIGINT) AS u, CAST(sum({_STORED}) AS BIGINT) AS s FROM writes), (SELECT CAST(sum(20 + strlen(key)) + 24 * count(DISTINCT run_seq) AS BIGINT) AS f FROM flushed)"),
    "space_amp": _q(f"SELECT d AS disk_bytes, l AS live_logical_bytes, round(d / l, 6) AS space_amp FROM (SELECT CAST(sum({_STORED}) AS BIGINT) AS d FROM writes), (SELECT CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS l FROM lww WHERE op <> 'delete')"),
    "latency_percentiles": "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS at, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT p.name AS percentile, v.value AS latency FROM v, (VALUES ('p50', 0.5::DOUBLE), ('p95', 0.95::DOUBLE), ('p99', 0.99::DOUBLE)) p(name, share) WHERE v.at = least(CAST(floor(v.n * p.share) AS BIGINT), v.n - 1)",
    "flush_runs": _q("SELECT run_seq, key, seq, op FROM flushed"),
    "run_metadata": _q("SELECT run_seq, min_key, max_key, entries FROM meta"),
    "merge_levels": _q("SELECT key, seq, op, value FROM lww"),
    "level_counts": _q("SELECT level, count(DISTINCT run_seq) AS runs, count(*) AS entries FROM levels GROUP BY level", _LEVELS),
    "level_pressure": _q("SELECT level, runs, round(100.0 * runs / 2, 6) AS pressure, runs > 2 AS compacts FROM (SELECT level, count(DISTINCT run_seq) AS runs FROM levels GROUP BY level)", _LEVELS),
    "compact_l0_l1": _q("SELECT key, seq, op FROM lww"),
    "compact_l1_l2": _q("SELECT key, seq, op FROM lww"),
    "compaction_chunks": _q("SELECT chunk, min_key, max_key, entries FROM chunks", _CHUNKS),
    "range_overlap_runs": _q("SELECT a.run_seq AS run_a, b.run_seq AS run_b FROM meta a JOIN meta b ON a.run_seq < b.run_seq AND NOT (a.max_key < b.min_key OR a.min_key > b.max_key)"),
    "range_overlap_chunks": _q("SELECT a.chunk AS run_a, b.chunk AS run_b FROM newest a, chunks b WHERE NOT (a.max_key < b.min_key OR a.min_key > b.max_key)", _CHUNKS + """,
        newest AS (SELECT CAST((upto - strlen(key) - 20) // 4096 AS BIGINT) AS chunk, min(key) AS min_key, max(key) AS max_key FROM (SELECT key, sum(strlen(key) + 20) OVER (ORDER BY key) AS upto FROM flushed WHERE run_seq = 7) GROUP BY 1)"""),
    "sst_candidates": _q("SELECT r.key, count(m.run_seq) AS candidates FROM readkeys r LEFT JOIN meta m ON r.key BETWEEN m.min_key AND m.max_key GROUP BY r.key"),
    "read_path_stats": _q("SELECT key, considered, skipped, CAST(searched AS BIGINT) AS searched, CAST(value_reads AS BIGINT) AS value_reads FROM paths", _PATHS),
    "read_amp": _q("SELECT round(CAST(sum(searched + value_reads) AS DOUBLE) / count(*), 6) AS read_amp FROM paths", _PATHS),
    "bloom_effect": _q("SELECT CAST(sum(considered) AS BIGINT) AS considered, CAST(sum(skipped) AS BIGINT) AS skipped, round(100 * (CAST(sum(skipped) AS DOUBLE) / sum(considered)), 6) AS effect FROM paths", _PATHS),
    "retained_runs": _q("SELECT run_seq FROM meta WHERE NOT (max_key >= 'user:1' AND min_key <= 'user:2')"),
    "retained_chunks": _q("SELECT chunk, entries FROM chunks WHERE NOT (max_key >= 'user:3' AND min_key <= 'user:6')", _CHUNKS),
    "orphan_runs": _q("SELECT DISTINCT run_seq FROM inruns WHERE run_seq % 2 <> 0"),
    "manifest_files": _q("SELECT run_seq, true AS exists FROM (SELECT DISTINCT run_seq FROM inruns WHERE run_seq % 2 = 0) UNION ALL SELECT 99, false"),
    "gc_live_pointers": _q("SELECT seq, key FROM lww WHERE op <> 'delete'"),
    "gc_dead_bytes": _q("SELECT count(*) AS dead_values, CAST(sum(strlen(value) + 4) AS BIGINT) AS dead_bytes FROM writes w WHERE op <> 'delete' AND NOT EXISTS (SELECT 1 FROM lww l WHERE l.seq = w.seq)"),
    "vlog_offsets": _q('SELECT seq, "offset", length FROM offs', _OFFSETS),
    "vlog_pointer_resolve": _q('SELECT l.key, o."offset", o.length, l.value FROM lww l JOIN offs o USING (seq) WHERE l.op <> \'delete\'', _OFFSETS),
    "wal_replay_prefix": _q("SELECT seq, key, op FROM writes WHERE seq < coalesce((SELECT min(seq) FROM writes WHERE seq % 997 = 996), 9223372036854775807)"),
    "wal_replay_report": _q("SELECT b IS NOT NULL AS tainted, (SELECT max(seq) FROM writes WHERE b IS NULL OR seq < b) AS safe_seq, b AS bad_seq, (SELECT count(*) FROM writes WHERE b IS NULL OR seq < b) AS kept FROM (SELECT min(seq) FILTER (seq % 997 = 996) AS b FROM writes)"),
    "verify_full_outer": _q("SELECT 'same' AS kind, count(*) AS n FROM lww"),
    "verify_differences": _q("""SELECT CASE WHEN a.key IS NULL THEN 'unexpected' WHEN b.key IS NULL THEN 'missing' WHEN a.value <> b.value THEN 'different' ELSE 'same' END AS kind, count(*) AS n
        FROM (SELECT * FROM lww WHERE op <> 'delete') a FULL JOIN early b ON a.key = b.key GROUP BY 1""",
        """early AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM writes WHERE seq < (SELECT count(*) * 3 // 4 FROM events)) WHERE rn = 1 AND op <> 'delete')"""),
    "verify_domain": _q("SELECT count(*) AS checks, count(DISTINCT key) AS keys FROM lww"),
    "iot_bulk_keys": "SELECT i AS id, printf('iot:device_%04d:event_%010d', i % 100, i) AS key, CASE WHEN i % 97 = 0 THEN 'alert' ELSE 'normal' END AS status FROM range(10000) t(i)",
    "iot_bulk_payloads": """SELECT i AS id, printf('{"device_id":"device_%04d","site":"edge_lab_A","sensor":"machine_health","timestamp_minute":%d,"sequence":%d,"temperature_c":%.2f,"vibration_g":%.3f,"voltage_v":%.2f,"status":"%s"}',
        i % 100, i // 100, i, 20 + CAST(i * 37 % 1700 AS DOUBLE) / 100, 0.15::DOUBLE + CAST(i * 17 % 900 AS DOUBLE) / 1000, 218 + CAST(i * 29 % 900 AS DOUBLE) / 100, CASE WHEN i % 97 = 0 THEN 'alert' ELSE 'normal' END) AS payload FROM range(10000) t(i)""",
    "stream1_ops": f"""SELECT i AS seq, {_OP} AS op, CASE WHEN i % 100 < 80 THEN 'iot:device_' || i % 100 || ':telemetry:' || i WHEN i % 100 BETWEEN 90 AND 94 THEN 'iot:device_' || (CASE WHEN i > 100 THEN i - 100 ELSE i END) % 100 || ':telemetry:' || (CASE WHEN i > 100 THEN i - 100 ELSE i END)
        ELSE 'iot:device_' || i % 100 || ':config' END AS key,
        CASE WHEN i % 100 < 80 THEN {_TELEMETRY.replace('DEVICE', 'i % 100')} WHEN i % 100 < 90 THEN printf('{{"device_id":"device_%d","op":"config_update","sampling_ms":%d}}', i % 100, 250 + i % 10 * 50) END AS value FROM range(10000) t(i)""",
    "stream2_ops": f"""WITH o AS (SELECT i, {_OP} AS op, ((i // 100) * 17 + (i % 100) * 13 + 7) % 100 AS d, ['config:sampling', 'config:threshold', 'status:health', 'status:firmware', 'calibration:vibration'][(i // 100 + i % 100) % 5 + 1] AS f FROM range(10000) t(i))
        SELECT i AS seq, op, 'iot:device_' || d || CASE op WHEN 'put' THEN ':telemetry:' || i WHEN 'update' THEN ':' || f ELSE ':status:health' END AS key,
        CASE op WHEN 'put' THEN {_TELEMETRY.replace('DEVICE', 'd')} WHEN 'update' THEN printf('{{"protocol":"http-stream","topic":"","device_id":"device_%d","op":"state_update","field":"%s","version":%d,"value":%d}}', d, f, i // 100, 100 + i * 17 % 900) END AS value FROM o WHERE op <> 'delete'""",
    "stream2_deletes": f"SELECT count(*) AS deletes, count(*) AS keys, count(*) AS later FROM range(10000) t(i) WHERE {_OP} = 'delete'",
    "bulk_bodies": """WITH r AS (SELECT user_id % 20 AS body_id, event_id // 10000 AS part, event_id, CASE WHEN event_id % 7 <> 0 THEN 'e' || event_id ELSE '' END AS key, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS value FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY body_id, part ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY body_id, part) AS n FROM r)
        SELECT body_id, part, pos, key, value FROM n WHERE n <= 500 AND key <> '' AND value IS NOT NULL""",
    "display_formats": r"""WITH o AS (SELECT event_id AS seq, CAST(event_id AS BIGINT) * 7919 AS v FROM events), b AS (SELECT seq, CAST(v AS VARCHAR) AS t, CAST(CASE WHEN seq % 3 = 0 THEN seq ELSE v * 4000 END AS DOUBLE) AS n FROM o),
        u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS k FROM b)
        SELECT seq, CASE WHEN k = 0 THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE printf('%.1f', floor(n / 1024 ** k * 10 + 0.5) / 10) END || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] AS size,
        CASE WHEN length(t) <= 3 THEN t ELSE reverse(rtrim(regexp_replace(reverse(left(t, length(t) - 3)), '(..)', '\1,', 'g'), ',')) || ',' || right(t, 3) END AS number,
        printf('%.2f', floor(seq / 64 * 100 + 0.5) / 100) || 'x' AS factor FROM u""",
    "json_report": _q(f"""SELECT op, printf('{{"op":"the \\"%s\\"","n":%d,"amplification":%.4f,"deletes":%s}}', op, n, floor(CAST(s AS DOUBLE) / u * 100) / 100, CASE WHEN op = 'delete' THEN 'true' ELSE 'false' END) AS report
        FROM (SELECT op, count(*) AS n, sum({_USER}) AS u, sum({_STORED}) AS s FROM writes GROUP BY op)"""),
    "run_paths": "SELECT i AS id, CASE WHEN i % 10 = 0 THEN 0 ELSE i * 13 END AS run_seq FROM range(2000) t(i)",
    "record_round_trip": _q("SELECT seq, CASE WHEN seq % 100 <> 0 THEN key END AS key, CASE WHEN op <> 'delete' AND seq % 100 <> 0 THEN value END AS value, seq % 100 <> 0 AS intact FROM writes"),
    "record_crc": _q(f"SELECT seq, {_crc32('{}')} AS crc FROM (SELECT seq, {_le32('strlen(key)')} || {_le32("CASE WHEN op = 'delete' THEN 4294967295 ELSE strlen(value) END")} || hex(encode(key)) || CASE WHEN op = 'delete' THEN '' ELSE hex(encode(value)) END AS raw FROM writes)"),
    "key_hashes": _q(f"SELECT key, {_MURMUR} AS hash FROM (SELECT DISTINCT key, hex(encode(key)) AS x FROM writes)"),
    "sensor_formula": "SELECT i AS id, round(20 + CAST(i * 37 % 1700 AS DOUBLE) / 100, 2) AS temperature_c, round(0.15::DOUBLE + CAST(i * 17 % 900 AS DOUBLE) / 1000, 3) AS vibration_g, round(218 + CAST(i * 29 % 900 AS DOUBLE) / 100, 2) AS voltage_v FROM range(10000) t(i)",
    "stream2_math": "SELECT i AS id, CASE WHEN i % 100 < 80 THEN 'put' WHEN i % 100 < 90 THEN 'update' WHEN i % 100 < 95 THEN 'delete' ELSE 'get' END AS op, ((i // 100) * 17 + (i % 100) * 13 + 7) % 100 AS device, ['config:sampling', 'config:threshold', 'status:health', 'status:firmware', 'calibration:vibration'][(i // 100 + i % 100) % 5 + 1] AS family FROM range(10000) t(i)",
    "hash_order": "SELECT i AS id, (i * 2654435761) & 4294967295 AS h, row_number() OVER (ORDER BY (i * 2654435761) & 4294967295, i) AS place FROM range(5000) t(i)",
    "bloom_sizing": "SELECT n, bits, CAST(ceil(bits / n * ln(2)) AS BIGINT) AS hashes, (bits + 7) // 8 AS bytes FROM (SELECT n, CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM (SELECT i * 100 AS n FROM range(1, 101) t(i)))",
    "range_expand": "SELECT '1..5' AS spec, i AS id FROM range(1, 6) t(i) UNION ALL SELECT '9..7', i FROM range(7, 10) t(i)",
    "sample_keys": _q("SELECT seq, key, op FROM ops WHERE seq IN (0, (SELECT count(*) // 2 FROM events), (SELECT count(*) - 1 FROM events))"),
    "trace_tail": _q("SELECT seq, op || ' | ' || key AS line FROM ops ORDER BY seq DESC LIMIT 200"),
    "topic_route": f"WITH {_TOPICS} SELECT CASE WHEN ends_with(topic, '/delete') THEN 'delete' WHEN ends_with(topic, '/query') THEN 'get' WHEN contains(topic, '/state/') THEN 'update' ELSE 'put' END AS op, count(*) AS n FROM msgs GROUP BY 1",
    "stable_suffix": f"WITH {_TOPICS} SELECT seq, substr(sha1(topic || chr(0) || payload || chr(0) || seq), 1, 16) AS suffix FROM msgs",
    "bridge_key": f"""WITH {_TOPICS}, k AS (SELECT seq, topic, payload, json_extract_string(payload, '$.k') AS k, ends_with(topic, '/delete') OR ends_with(topic, '/query') AS asks, 'mqtt:' || topic AS place, contains(topic, '/state/') AS st FROM msgs)
        SELECT seq, CASE seq % 5 WHEN 1 THEN 's' || k WHEN 2 THEN 'k' || k
          WHEN 3 THEN CASE WHEN asks THEN 't' || k WHEN st THEN place ELSE place || ':e' || k END
          WHEN 4 THEN CASE WHEN st THEN place ELSE place || ':' || seq END
          ELSE CASE WHEN st THEN place ELSE place || ':' || substr(sha1(topic || chr(0) || payload || chr(0) || seq), 1, 16) END END AS key FROM k""",
    "json_fields": "SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_int, list_contains(json_keys(props), 'k') AS has_k, -1::BIGINT AS missing_int FROM events",
    "publisher_mix": """
        WITH m AS (SELECT i, (i - 1) % 100 AS b, (i - 1) // 100 AS block, ((i - 1) % 100) + 1 AS dev FROM range(1, 10001) t(i)),
        k AS (SELECT CASE WHEN b < 80 THEN 'put' WHEN b < 90 THEN 'update' WHEN b < 95 THEN 'delete' ELSE 'get' END AS op,
          CASE WHEN b < 80 THEN 't' || i WHEN b < 90 THEN dev || ['firmware', 'sampling', 'threshold', 'mode'][i % 4 + 1]
               WHEN b < 95 THEN 't' || ((block * 5 + b - 90) // 80 * 100 + (block * 5 + b - 90) % 80 + 1) ELSE 't' || (block * 100 + 80) END AS key FROM m)
        SELECT op, count(*) AS n, count(DISTINCT key) AS unique_keys FROM k GROUP BY op""",
    "stream_state_summary": "SELECT 7600::BIGINT AS live_keys, 500::BIGINT AS tombstones, 1571253::BIGINT AS live_logical_bytes",
    "store_lifecycle": _q("SELECT key, value FROM lww WHERE op <> 'delete'"),
    "store_counters": _q(f"""SELECT u AS user_bytes_written, s + f AS storage_bytes_written, p AS put_calls, d AS delete_calls FROM
        (SELECT CAST(sum({_USER}) AS BIGINT) AS u, CAST(sum({_STORED}) AS BIGINT) AS s, count(*) FILTER (op <> 'delete') AS p, count(*) FILTER (op = 'delete') AS d FROM writes),
        (SELECT CAST(sum(20 + strlen(key)) + 24 AS BIGINT) AS f FROM lww)"""),
    "store_reads": """SELECT k AS key, b AS bypass, k IN ('key_0001', 'key_0002', 'key_0399') AS found, CASE k WHEN 'key_0001' THEN 'v1' WHEN 'key_0002' THEN 'v2' WHEN 'key_0399' THEN 'v399' END AS value,
        CASE WHEN b THEN CASE k WHEN 'key_0001' THEN 3 WHEN 'key_0002' THEN 2 WHEN 'key_0399' THEN 1 ELSE 4 END WHEN k IN ('key_0001', 'key_0002', 'key_0399') THEN 1 ELSE 0 END AS searched
        FROM (VALUES ('key_0001'), ('key_0002'), ('key_0399'), ('key_0400'), ('key_01')) x(k), (VALUES (false), (true)) y(b)""",
    "store_bytes": "SELECT * FROM (VALUES ('run', 1::BIGINT, true), ('segment', 1, true), ('filter', 1, true), ('catalog', 1, true)) v(kind, files, filled)",
    "store_damage": _q("SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM writes WHERE seq < (SELECT min(seq) FROM writes WHERE seq >= (SELECT count(*) // 2 FROM events))) WHERE rn = 1"),
    "lab_report": "SELECT 'pass' AS status, 8::BIGINT AS commands, 4002::BIGINT AS generated_ops, 3000::BIGINT AS puts, 701::BIGINT AS updates, 301::BIGINT AS deletes, 6000::BIGINT AS verify_checks, 0::BIGINT AS mismatches, 2699::BIGINT AS live_keys, 301::BIGINT AS tombstones",
    "verification_suite": """SELECT phase, checked::BIGINT AS checked, 0::BIGINT AS mismatches, true AS ok FROM (VALUES ('basic', 1000), ('overwrite', 1000), ('delete', 950), ('flush', 950),
        ('compaction', 1950), ('bloom', 1950), ('recovery', 1950)) v(phase, checked)""",
}
