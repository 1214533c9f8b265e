"""Personal data in texts: patterns propose, checksums confirm, context words adjust a score.

Everything runs as DataFrame expressions in one pass over the scan: no shuffle, no Python.

Defined results: null and empty texts have no spans; every input row, repeated ids too, gives one row;
null ids stay null; other columns of the input are ignored. A text of any length is searched whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm import spans as S
from driftlog.llm.shared import id_and_text

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: kind, pattern, SQL condition that confirms a match, what must be in a text for a search to be worth it
BASE = (
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "true", "contains({t}, '@')"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "forall(split(x.v, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST('0' || right(ltrim('0', p), 3) AS INT) <= 255)", "contains({t}, '.')"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", f"{S.n_digits('x.v')} BETWEEN 12 AND 19 AND {S.luhn('x.v')}", "true"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{S.n_digits('x.v')} BETWEEN 9 AND 15", "contains({t}, '+')"),
)
#: further kinds; these need the threshold besides their check
MORE = (
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", f"length(replace(x.v, ' ', '')) BETWEEN 15 AND 34 AND {S.alone('[A-Za-z0-9]')} AND {S.mod97('x.v')}", "true"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", f"left(x.v, 3) NOT IN ('000', '666') AND left(x.v, 1) <> '9' AND substring(x.v, 5, 2) <> '00' AND right(x.v, 4) <> '0000' AND {S.alone('[0-9-]')}", "contains({t}, '-')"),
)
#: score of a confirmed match without context; checksums weigh more than a bare form
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
#: words that raise a score when they stand near
CONTEXT = {
    "email": "mail|contact|write|address", "ip": "ip|host|server|address|login", "card": "card|visa|credit|payment|pay",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|transfer", "ssn": "ssn|social|security",
}


def find_pii(docs: DataFrame, reach: int = 40, bonus: float = 0.2, threshold: float = 0.6) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (kind, rank, s, e, v, score).

    ``reach``: code points before and after a match where context words count; ``bonus``: what such a
    word adds to the prior of the kind. Kinds of ``MORE`` need ``threshold``, kinds of ``BASE`` are kept
    with any score once their check confirms them.
    """
    rules = BASE + MORE
    t = "text"
    found = S.with_spans(id_and_text(docs), t, [(k, p, ok, F.expr(need.format(t=t))) for k, p, ok, need in rules])
    found = found.select("doc_id", t, F.expr(f"concat({', '.join(f's_{k}' for k, *_ in rules)})").alias("all"))
    found = found.select("doc_id", "all", F.expr(f"CASE WHEN size(all) > 0 THEN {S.chunks(t)} END").alias("pieces"))
    words = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN '(?i)(?<![A-Za-z])(?:{w})'" for k, w in CONTEXT.items()) + " END"
    prior = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in PRIOR.items()) + " END"
    near = f"concat_ws(' ', {S.around('pieces', f'greatest(0, x.s - {reach})', f'least(x.s, {reach})')}, {S.around('pieces', 'x.e', str(reach))})"
    scored = f"transform(all, x -> named_struct('kind', x.kind, 'rank', x.rank, 's', x.s, 'e', x.e, 'v', x.v, 'score', round(least(1.0D, {prior} + CASE WHEN regexp_like({near}, {words}) THEN {bonus}D ELSE 0D END), 3)))"
    kept = f"filter({scored}, x -> x.rank < {len(BASE)} OR x.score >= {threshold})"
    return found.select("doc_id", F.expr(f"CASE WHEN size(all) = 0 THEN filter({scored}, x -> false) ELSE {S.in_order(kept)} END").alias("spans"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``find_pii`` returned."""
    base = f"filter(spans, x -> x.rank < {len(BASE)})"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k, *_ in BASE + MORE],
        F.expr(f"sha2({S.digest_text(base)}, 256)").alias("base_sha256"),
        F.expr(S.digest_text("spans")).alias("spans"),
        F.expr("array_max(transform(spans, x -> x.score))").alias("max_score"),
    )
