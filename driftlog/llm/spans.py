"""Code-point spans of regex matches, as plain SQL expressions.

``regexp_extract_all`` returns texts without places, so the places come from a second pass: ``split`` by
the same pattern returns what stands between the matches, and running lengths of both give start and end
in code points. Both walk a text with the same leftmost non-overlapping search. Running lengths are made
block by block, so a text with many matches costs no more than in proportion to them, and nothing looks
into the whole text for a single match: neighbours come from the pieces, context from chunks of the text.

Patterns here are written so that a Java matcher needs linear time and no recursion on any text:
possessive quantifiers where nothing that follows could use what they took, and a look-behind that
starts a run of one class only at its beginning (or, ``\\G``, where the last match ended).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,rank:int,s:int,e:int,v:string,b:string,a:string>"


def quoted(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    if '"' in pattern and "'" in pattern:
        pattern = pattern.replace("'", "\\x27")
    return f"r'{pattern}'" if "'" not in pattern else f'r"{pattern}"'


def matches(text: str, pattern: str) -> Column:
    return F.expr(f"regexp_extract_all({text}, {quoted(pattern)}, 0)")


#: lengths that are added up in one block
BLOCK = 256
#: code points in a chunk of a text
CHUNK = 4096


def _running(lengths: str) -> str:
    """Sum of the lengths before each place of an array that is not empty."""
    block = f"slice({lengths}, b * {BLOCK} + 1, {BLOCK})"
    sums = f"transform(sequence(0, (size({lengths}) - 1) DIV {BLOCK}), b -> aggregate({block}, 0, (a, y) -> a + y))"
    put = lambda values, start: f"aggregate({values}, named_struct('at', {start}, 'out', CAST(array() AS array<int>)), (a, y) -> named_struct('at', a.at + y, 'out', array_append(a.out, a.at)), a -> a.out)"
    return f"flatten(transform({put(sums, '0')}, (o, b) -> {put(block, 'o')}))"


def with_spans(frame: DataFrame, text: str, rules: list[tuple[str, str, str, Column | None]]) -> DataFrame:
    """``frame`` with an array ``s_<kind>`` of spans for each (kind, pattern, check, condition) of ``rules``.

    The check is SQL over ``x`` (v: the match, s, e: its place, b, a: the characters before and after it, or
    empty strings); a pattern is searched where the condition holds (None: everywhere).
    """
    kept = [F.col(c) for c in frame.columns]
    none = F.expr("CAST(array() AS array<string>)")
    out = frame.select(*kept, *[matches(text, p) if when is None else F.when(when, matches(text, p)).otherwise(none) for _, p, _, when in rules])
    out = out.toDF(*frame.columns, *[f"m_{k}" for k, *_ in rules])
    found = [F.col(f"m_{k}") for k, *_ in rules]
    out = out.select(*kept, *found, *[F.expr(f"CASE WHEN size(m_{k}) > 0 THEN split({text}, {quoted(p)}, -1) END").alias(f"g_{k}") for k, p, *_ in rules])
    gaps = [F.col(f"g_{k}") for k, *_ in rules]
    out = out.select(*kept, *found, *gaps, *[F.expr(f"transform(m_{k}, (x, i) -> length(g_{k}[i]) + length(x))").alias(f"l_{k}") for k, *_ in rules])
    out = out.select(*kept, *found, *gaps, *[F.expr(f"CASE WHEN size(m_{k}) > 0 THEN {_running(f'l_{k}')} END").alias(f"p_{k}") for k, *_ in rules])

    def spans(kind: str, rank: int, check: str) -> Column:
        m, g, p = f"m_{kind}", f"g_{kind}", f"p_{kind}"
        before = f"CASE WHEN {g}[i] <> '' THEN right({g}[i], 1) WHEN i > 0 THEN right(get({m}, i - 1), 1) ELSE '' END"
        after = f"CASE WHEN {g}[i + 1] <> '' THEN left({g}[i + 1], 1) ELSE coalesce(left(get({m}, i + 1), 1), '') END"
        placed = f"named_struct('kind', '{kind}', 'rank', {rank}, 's', {p}[i] + length({g}[i]), 'e', {p}[i] + length({g}[i]) + length(v), 'v', v, 'b', {before}, 'a', {after})"
        return F.expr(f"CASE WHEN size({m}) > 0 THEN filter(transform({m}, (v, i) -> {placed}), x -> {check}) ELSE CAST(array() AS array<{SPAN}>) END")

    return out.select(*kept, *[spans(k, i, check).alias(f"s_{k}") for i, (k, _, check, _) in enumerate(rules)])


def chunks(text: str) -> str:
    """The text in pieces of ``CHUNK`` code points."""
    return f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"


def around(pieces: str, start: str, n: str) -> str:
    """``n`` (less than a chunk) code points from place ``start`` on, from the chunks of a text."""
    k = f"(({start}) DIV {CHUNK})"
    return f"substring(concat(coalesce(get({pieces}, CAST({k} AS INT)), ''), coalesce(get({pieces}, CAST({k} + 1 AS INT)), '')), CAST(({start}) % {CHUNK} + 1 AS INT), CAST({n} AS INT))"


def alone(kind: str) -> str:
    """True if no character of the class ``kind`` stands directly before or after the match."""
    return f"NOT regexp_like(x.b, '{kind}') AND NOT regexp_like(x.a, '{kind}')"


def in_order(spans: str) -> str:
    """Sorted by start, then by the rank of the kind."""
    return f"array_sort({spans}, (l, r) -> CASE WHEN l.s < r.s THEN -1 WHEN l.s > r.s THEN 1 WHEN l.rank < r.rank THEN -1 WHEN l.rank > r.rank THEN 1 ELSE 0 END)"


def digest_text(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def luhn(value: str) -> str:
    """True if the digits of ``value`` pass the Luhn check."""
    d = f"regexp_replace({value}, '[^0-9]', '')"
    return f"""aggregate(transform(split(reverse({d}), ''), (c, i) -> CAST(c AS BIGINT) * (1 + i % 2)), 0L,
      (a, y) -> a + y DIV 10 + y % 10) % 10 = 0"""


def n_digits(value: str) -> str:
    return f"length(regexp_replace({value}, '[^0-9]', ''))"


def mod97(value: str) -> str:
    """True if an IBAN-like ``value`` leaves 1 modulo 97 after its first four characters went to the end."""
    v = f"replace({value}, ' ', '')"
    return f"""aggregate(split(concat(substring({v}, 5), substring({v}, 1, 4)), ''), 0,
      (a, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + ascii(c) - 48) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"""
