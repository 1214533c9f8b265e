"""Boolean trigram queries that a regular expression implies.

A pattern is walked as a tree. Neighbouring parts with few possible texts are multiplied into strings that
a match must contain one of; a string gives the AND of its trigrams, alternatives an OR, a sequence an AND.
Everything is in lower case, so a query holds for either case. A query is a list of sets of trigrams, of
which one must be there whole; ``None`` says that nothing is mandatory.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser

Query = list[frozenset[str]] | None
#: texts of a part, and characters of a class, up to which they are written out
MOST_TEXTS, MOST_CHARS = 64, 8


def _of_text(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(query: Query) -> Query:
    """Without alternatives that another one implies; None if one holds always."""
    if query is None or frozenset() in query:
        return None
    return [x for x in dict.fromkeys(query) if not any(y < x for y in query)]


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    return _least([x | y for x in a for y in b]) if len(a) * len(b) <= MOST_TEXTS else a


def _either(queries: list[Query]) -> Query:
    return None if any(q is None for q in queries) else _least([x for q in queries for x in q])


def _of_texts(texts: set[str]) -> Query:
    return _least([_of_text(t) for t in sorted(texts)])


def _chars(members) -> set[str] | None:
    """Characters of a class in lower case, or None for many."""
    out: set[str] = set()
    for kind, value in members:
        if kind is c.LITERAL:
            out.add(chr(value).lower())
        elif kind is c.RANGE and value[1] - value[0] < MOST_CHARS:
            out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def _part(op, value) -> tuple[set[str] | None, Query]:
    """(all texts of a part, if they are few; its query)"""
    if op is c.LITERAL:
        return {chr(value).lower()}, None
    if op is c.IN:
        return _chars(value), None
    if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return {""}, None
    if op is c.SUBPATTERN:
        return _sequence(value[3])
    if op is c.ATOMIC_GROUP:
        return _sequence(value)
    if op is c.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(texts is not None for texts, _ in parts) and len(every := set().union(*(texts for texts, _ in parts))) <= MOST_TEXTS:
            return every, None
        return None, _either([query if texts is None else _of_texts(texts) for texts, query in parts])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        least, most, inner = value
        texts, query = _sequence(inner)
        if texts is not None and most == 1:
            return texts | ({""} if not least else set()), None
        if texts is not None and least == most and len(texts) ** least <= MOST_TEXTS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in texts}
            return out, None
        return None, (query if texts is None else _of_texts(texts)) if least else None
    return None, None


def _sequence(parts) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, None, True
    for op, value in parts:
        texts, own = _part(op, value)
        if texts is not None and len(run) * len(texts) <= MOST_TEXTS:
            run = {a + b for a in run for b in texts}
            continue
        query, whole = _both(_both(query, _of_texts(run)), own), False
        run = {""} if texts is None else texts
    return (run, None) if whole else (None, _both(query, _of_texts(run)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams (lower case) one of which every match of ``pattern`` contains whole."""
    texts, query = _sequence(parser.parse(pattern))
    return query if texts is None else _of_texts(texts)
