"""DuckDB SQL for those corpus queries that SQL can express.

Spans are found by the plain patterns of the contracts: extracted matches and the texts between them give
places as running lengths. The Jaccard join counts common shingles
of all pairs and follows links by recursion. Token files and classifiers have no SQL; their tests compare
them with brute force.
"""

from __future__ import annotations

# kind, plain pattern (matches are found leftmost and without overlap), check on a match x.m at [x.s, x.e) of the text t
_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j:
  CAST({_DIGITS}[length({_DIGITS}) - j + 1] AS INT) * (2 - j % 2) // 10 + CAST({_DIGITS}[length({_DIGITS}) - j + 1] AS INT) * (2 - j % 2) % 10)) % 10 = 0"""
_IBAN = "replace(x.m, ' ', '')"
# value of the digits that stand for the rearranged characters, modulo 97
_MOD97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_IBAN}[5:] || {_IBAN}[:4], ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))),
  lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""


def _alone(kind: str) -> str:
    return f"(x.s = 0 OR NOT regexp_matches(substr(t, x.s, 1), '{kind}')) AND NOT regexp_matches(substr(t, x.e + 1, 1), '{kind}')"


PII_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
)
PII_MORE = (
    ("iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", f"length({_IBAN}) BETWEEN 15 AND 34 AND {_alone('[A-Za-z0-9]')} AND {_MOD97}"),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", f"left(x.m, 3) NOT IN ('000', '666') AND left(x.m, 1) <> '9' AND substr(x.m, 5, 2) <> '00' AND right(x.m, 4) <> '0000' AND {_alone('[0-9-]')}"),
)
_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRET_BASE = (
    ("assign", _ASSIGN, f"length(regexp_extract(x.m, '{_ASSIGN.replace("'", "''")}', 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(x.m) >= 16"),
    ("hex", "[0-9a-f]+", "length(x.m) >= 32"),
)
SECRET_MORE = (
    ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("gittoken", "gh[pousr]_[A-Za-z0-9]{36,}", _alone("[A-Za-z0-9]")),
)


def _spans(base: tuple, more: tuple) -> str:
    """CTEs down to ``f``: doc_id, t, and for each kind a list of (s, r, e, k, m) that passed its check."""
    parts = [(k, r, p.replace("'", "''"), c) for r, (k, p, c) in enumerate(base + more)]
    cut = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, _, p, _ in parts)
    before = lambda k: f"list_sum(list_transform(g_{k}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m_{k}[1:i-1], lambda g: length(g))), 0)"
    put = ", ".join(f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'s': CAST({before(k)} AS BIGINT), 'r': {r}, 'e': CAST({before(k)} + length(m_{k}[i]) AS BIGINT), 'k': '{k}', 'm': m_{k}[i]}}) AS a_{k}" for k, r, _, _ in parts)
    kept = ", ".join(f"list_filter(a_{k}, lambda x: {c}) AS s_{k}" for k, _, _, c in parts)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        c AS (SELECT doc_id, t, {cut} FROM d), p AS (SELECT doc_id, t, {put} FROM c), f AS (SELECT doc_id, t, {kept} FROM p)"""


def _joined(lists: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort({lists}), lambda x: x.k || ':' || x.s || ':' || x.e), ','), '')"


def _pii() -> str:
    from driftlog.llm.pii import CONTEXT, PRIOR

    words = "CASE x.k " + " ".join(f"WHEN '{k}' THEN regexp_matches(n, '(?i)(^|[^A-Za-z])({w})')" for k, w in CONTEXT.items()) + " END"
    near = "substr(t, greatest(1, x.s + 1 - 40), least(x.s, 40)) || ' ' || substr(t, x.e + 1, 40)"
    prior = "CASE x.k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIOR.items()) + " END"
    score = f"round(least(1.0, CAST({prior} AS DOUBLE) + CASE WHEN {words.replace('n, ', f'{near}, ')} THEN 0.2 ELSE 0 END), 3)"
    kinds = [k for k, *_ in PII_BASE + PII_MORE]
    every = " || ".join(f"s_{k}" for k in kinds)
    counts = ", ".join(f"CAST(len(list_filter(kept, lambda x: x.k = '{k}')) AS BIGINT) AS n_{k}" for k in kinds)
    return f"""{_spans(PII_BASE, PII_MORE)},
        k AS (SELECT doc_id, t, list_filter({every}, lambda x: x.r < {len(PII_BASE)} OR {score} >= 0.6) AS kept FROM f)
        SELECT doc_id, {counts}, sha256({_joined(f"list_filter(kept, lambda x: x.r < {len(PII_BASE)})")}) AS base_sha256, {_joined('kept')} AS spans,
               list_max(list_transform(kept, lambda x: CAST({score} AS DOUBLE))) AS max_score FROM k"""


def _secrets() -> str:
    kinds = [k for k, *_ in SECRET_BASE + SECRET_MORE]
    counts = ", ".join(f"CAST(len(s_{k}) AS BIGINT) AS n_{k}" for k in kinds)
    base, every = " || ".join(f"s_{k}" for k, *_ in SECRET_BASE), " || ".join(f"s_{k}" for k in kinds)
    return f"{_spans(SECRET_BASE, SECRET_MORE)} SELECT doc_id, {counts}, sha256({_joined(base)}) AS base_sha256, {_joined(every)} AS spans FROM f"


ORACLE_SQL: dict[str, str] = {
    "op1_pii": _pii(),
    "op2_secrets": _secrets(),
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
        k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
        e AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
        SELECT r.doc_id, coalesce(any_value(k.n), 0) AS n_shingles, min(r.c) AS component_id, coalesce(any_value(l.links), 0) AS n_links
        FROM r LEFT JOIN k ON k.doc_id = r.doc_id LEFT JOIN (SELECT a, count(*) AS links FROM e GROUP BY a) l ON l.a = r.doc_id GROUP BY r.doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        r AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM r""",
}
