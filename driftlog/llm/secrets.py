"""Secrets in texts, found through a trigram inverted index.

Every rule's Boolean trigram query is derived from its regex (``trigrams``): alternatives of trigrams in
lower case, one of which any match contains whole. The index is a table of postings: for each trigram that
some rule names, the rows that contain it, by id and hash of the text. A rule's candidates are the rows in
the intersection of the postings of one of its alternatives; only these are verified with the regex. A rule
without a mandatory trigram (a bare class such as hex) scans every text.

Defined results: null and empty texts have no spans; every input row gives one row; rows that share id and
text are candidates together; null ids stay null; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm import spans as S
from driftlog.llm.shared import id_and_text, written
from driftlog.llm.trigrams import trigram_query

_KEY = r"(?i:password|passwd|secret|token|api_?key)"
#: kind, pattern, SQL check on a match
BASE = (
    ("assign", rf"""{_KEY}["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
     rf"""length(regexp_extract(x.v, {S.quoted(rf'''^{_KEY}["']?[\x20]*[:=][\x20]*["']?([A-Za-z0-9+/_.=-]+)$''')}, 1)) >= 8"""),
    ("access", r"AKIA[A-Z0-9]{12,}", "true"),
    ("hex", r"[0-9a-f]{32,}", "true"),
)
#: further kinds
MORE = (
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("gittoken", r"gh[pousr]_[A-Za-z0-9]{36,}", S.alone("[A-Za-z0-9]")),
)


#: candidates (three numbers each) that may be broadcast; more are joined by a shuffle of the texts
MOST_BROADCAST = 1_000_000


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``tri, doc_id, h`` (hash of the text) for every whole text."""
    low = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("h"), F.lower("text").alias("low"))
    tests = ", ".join(f"CASE WHEN contains(low, {S.quoted(t)}) THEN {S.quoted(t)} END" for t in trigrams)
    return low.select(F.expr(f"explode(array_compact(array({tests})))").alias("tri"), "doc_id", "h")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(``doc_id``, ``h``, ``rules``: bits of the rules of which the row is in all postings of an alternative)."""
    terms = [(rule, k, len(ands), t) for rule, ors in queries.items() for k, ands in enumerate(ors) for t in sorted(ands)]
    terms = F.broadcast(index.sparkSession.createDataFrame(terms, "rule int, alternative int, needed int, tri string"))  # as long as the rules are
    both = index.join(terms, "tri").groupBy("rule", "alternative", "needed", "doc_id", "h").agg(F.count_distinct("tri").alias("held")).where("held = needed")
    return both.groupBy("doc_id", "h").agg(F.expr("bit_or(shiftleft(1L, rule))").alias("rules"))


def find_secrets(docs: DataFrame, rules: tuple = BASE + MORE) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (kind, rank, s, e, v, b, a)."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r[1])) is not None}
    named = sorted({t for ors in queries.values() for ands in ors for t in ands})
    hits = written(candidates(build_index(docs, named), queries), "secret-candidates")
    d = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    small = hits.count() <= MOST_BROADCAST
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "rules")
    hits = F.broadcast(hits) if small else hits
    d = d.join(hits, d["doc_id"].eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", F.coalesce("rules", F.lit(0)).alias("rules"))
    found = S.with_spans(d, "text", [(k, p, ok, F.expr(f"rules & {1 << i} <> 0") if i in queries else None) for i, (k, p, ok) in enumerate(rules)])
    return found.select("doc_id", F.expr(S.in_order(f"concat({', '.join(f's_{r[0]}' for r in rules)})")).alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``find_secrets`` returned."""
    base = f"filter(spans, x -> x.rank < {len(BASE)})"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k, *_ in BASE + MORE],
        F.expr(f"sha2({S.digest_text(base)}, 256)").alias("base_sha256"),
        F.expr(S.digest_text("spans")).alias("spans"),
    )
