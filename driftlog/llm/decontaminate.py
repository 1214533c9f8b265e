"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask of word positions; the hash of a window covers the masked positions and ignores the
rest, so a substituted word at an ignored position does not hide a copy. The masks below hit every
stretch of 13 words in which any two were substituted. Hashes of the test items are held in memory on
each worker; every window of every training text is looked up, and around each hit the two texts are
compared along the hit's diagonal. An overlap counts if in some 13 adjacent words of the item, or in the
whole item if that is shorter, at least four words in five agree, wherever the others stand. Its place is
the best-scoring stretch (a match gives 1, a substitution takes 4) if that has as many words, else the
window with most words that agree; ``trimmed`` leaves the latter overlaps out, so substitutions near the
ends of a short item hide it. An item of 8 to 12 words may have one substitution in five words, so it is
cut into one piece more than that, and one piece at least is whole: the pieces are looked up like seeds.
An item with fewer words than a mask spans (8) must be there word for word; ``least_item`` says from how many
words on, as a few common words say nothing about their origin.

Test items go to the workers in blocks of bounded size, each block against all texts; training texts are
never shuffled. Words are lower-cased and stripped of all but letters and digits.

Defined results: null, empty and word-less texts and items give no rows; each input row gives its own
rows, also where ids repeat; an item is reported once per text, with its longest overlap (then the first
place); other columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.shared import arrow_batches, id_and_text, tidy
from driftlog.llm.words import U, hash_texts, mix, split_words

#: positions that each mask looks at; together they hit 13 words with any two substituted (see the tests)
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
LEAST_WORDS = 13
#: words of the shortest item in which words may differ
LEAST_ITEM = max(m[-1] for m in MASKS) + 1
#: characters of test items that are held by a worker at once
BLOCK_CHARS = 16 << 20
_FILTER_BITS = 22
#: hits, and words, that are compared at once
PORTION = 1 << 21
_OTHER = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, matched int, overlap int, item_words int, first_word long, last_word long"


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each)"""
    flat, counts = split_words(pc.utf8_lower(texts))
    coded = flat.dictionary_encode()
    plain = pa.array([_OTHER.sub("", w) for w in coded.dictionary.to_pylist()], pa.string())
    there = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = there[at] if len(at) else np.zeros(0, bool)
    hashes = hash_texts(plain)[at[keep]] if len(at) else np.zeros(0, U)
    return hashes, np.bincount(owner[keep], minlength=len(counts))


def _windows(hashes: np.ndarray, counts: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed hash of each window, its first word's place); windows do not cross texts."""
    span = mask[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    odd = mix(np.arange(1, len(mask) + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt)) | U(1)
    out = hashes[mask[0] : mask[0] + n] * odd[0]
    for m, c in zip(mask[1:], odd[1:], strict=True):
        out += hashes[m : m + n] * c
    room = np.repeat(np.cumsum(counts), counts)[:n] - np.arange(n) >= span
    at = np.flatnonzero(room)
    return mix(out[at]), at


def _pieces(starts: np.ndarray, counts: np.ndarray, least_item: int) -> dict[int, list[int]]:
    """By size, the places of the pieces of items that are shorter than a window: one more than may have a substitution."""
    out: dict[int, list[int]] = {}
    for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if max(1, least_item) <= n < LEAST_ITEM:
            out.setdefault(n, []).append(start)
        if max(LEAST_ITEM, least_item) <= n < LEAST_WORDS:
            cuts = [n * k // (n // 5 + 1) for k in range(n // 5 + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                out.setdefault(hi - lo, []).append(start + lo)
    return out


class Seeds:
    """Seed hashes of a block of test items."""

    def __init__(self, item_ids: list, texts: list[str], least_item: int) -> None:
        hashes, counts = plain_words(pa.array(texts, pa.string()))
        self.ids, self.hashes, self.counts = item_ids, hashes, counts
        self.starts = np.cumsum(counts) - counts
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.tables, self.filter = [], np.zeros(1 << _FILTER_BITS, bool)
        short = _pieces(self.starts, counts, least_item)
        for k, mask in enumerate((*MASKS, *(tuple(range(size)) for size in sorted(short)))):
            seeds, at = _windows(hashes, counts, mask, k)
            if k >= len(MASKS):
                seeds, at = (x[np.isin(at, short[len(mask)])] for x in (seeds, at))
            order = np.argsort(seeds, kind="stable")
            self.tables.append((mask, seeds[order], at[order]))
            self.filter[seeds >> U(64 - _FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place of its first word on the texts' words, a word of the text): diagonals to compare, each once a portion."""
        for k, (mask, seeds, places) in enumerate(self.tables):
            got, at = _windows(hashes, counts, mask, k)
            maybe = np.flatnonzero(self.filter[got >> U(64 - _FILTER_BITS)])
            lo, hi = np.searchsorted(seeds, got[maybe], "left"), np.searchsorted(seeds, got[maybe], "right")
            some = hi > lo
            where, lo, n = at[maybe[some]], lo[some], (hi - lo)[some]
            ends = np.cumsum(n)
            begin = 0
            while begin < len(n):  # a seed of many items is taken in portions
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PORTION, "right")))
                size = n[begin:end]
                place = places[np.repeat(lo[begin:end] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                item, spot = self.item[place], np.repeat(where[begin:end], size)
                diagonal = spot - (place - self.starts[item])
                _, first = np.unique(np.stack([item, diagonal]), axis=1, return_index=True)
                yield item[first], diagonal[first], spot[first]
                begin = end


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """[start, end) of the best-scoring stretch (a match gives 1, a substitution takes 4), the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.flatnonzero(total[: end + 1] == low[end])[-1]), end


def best_window(same: np.ndarray, words: int) -> tuple[int, int]:
    """[start, end) of the window of so many words in which most agree, the first of equals; (0, 0) if under four in five."""
    total = np.concatenate([[0], np.cumsum(same)])
    agree = total[words:] - total[:-words]
    if not len(agree) or 5 * agree.max() < 4 * words:
        return 0, 0
    return int(agree.argmax()), int(agree.argmax()) + words


def _agreeing(same: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether in some window of ``least`` words of a row four words in five agree, or all of a few (``same``: the rows' words
    one after another)."""
    need = np.where(least < LEAST_ITEM, least, (4 * least + 4) // 5)
    start = np.cumsum(size) - size
    total = np.concatenate([[0], np.cumsum(same)])
    windows = np.maximum(0, size - least + 1)
    row = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + start[row]
    good = total[at + least[row]] - total[at] >= need[row]
    return np.bincount(row[good], minlength=len(size)) > 0


def _overlaps(seeds: Seeds, trimmed: bool, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int, int, int, int]]:
    """For (row, item) pairs that overlap: length, minus first word, words that agree, first and last word."""
    hashes, counts = plain_words(texts)
    ends, best, done = np.cumsum(counts), {}, set()
    for item, diagonal, where in seeds.hits(hashes, counts):
        row = np.searchsorted(ends, where, "right")
        lo, hi = np.maximum(diagonal, (ends - counts)[row]), np.minimum(diagonal + seeds.counts[item], ends[row])
        size, least = hi - lo, np.minimum(LEAST_WORDS, seeds.counts[item])
        shift = seeds.starts[item] - diagonal
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PORTION)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            n = size[a:b]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:b], n)
            every = hashes[at] == seeds.hashes[at + np.repeat(shift[a:b], n)]
            first = np.cumsum(n) - n
            # a best stretch that is long enough begins with such a window, too
            for k in np.flatnonzero(_agreeing(every, n, least[a:b])).tolist():
                i, r, begin = int(item[a + k]), int(row[a + k]), int(lo[a + k])
                if (i, begin, int(diagonal[a + k])) in done:
                    continue
                done.add((i, begin, int(diagonal[a + k])))
                same = every[first[k] : first[k] + n[k]]
                start, end = best_stretch(same)
                if end - start < least[a + k]:
                    start, end = (0, 0) if trimmed else best_window(same, int(least[a + k]))
                if end > start:
                    begin -= int(ends[r] - counts[r])
                    got = (end - start, -(begin + start), int(same[start:end].sum()), begin + start, begin + end - 1)
                    best[r, i] = max(best.get((r, i), got), got)
    return best


def _leaks(held, trimmed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds: Seeds = held.value
    for b in batches:
        ids, best = b.column("doc_id").to_pylist(), _overlaps(seeds, trimmed, b.column("text"))
        rows = [(ids[r], seeds.ids[i], m, size, int(seeds.counts[i]), first, last) for (r, i), (size, _, m, first, last) in sorted(best.items())]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = ["doc_id", "item_id", "matched", "overlap", "item_words", "first_word", "last_word"]
        yield pa.record_batch([pa.array([x[c] for x in rows], t) for c, t in enumerate(kinds)], names)


def _clean(held, trimmed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        clean = np.ones(b.num_rows, bool)
        clean[[row for row, _ in _overlaps(held.value, trimmed, pc.fill_null(b.column("text"), ""))]] = False
        yield b.filter(pa.array(clean))


def _blocks(benchmark: DataFrame, least_item: int) -> Iterator:
    """The test items' seeds, in blocks of bounded size, as broadcasts."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    n = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    for block in range(n):
        if got := items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).orderBy("item_id", "text").collect():
            yield spark.sparkContext.broadcast(Seeds([r["item_id"] for r in got], [r["text"] for r in got], least_item))


def find_leaks(docs: DataFrame, benchmark: DataFrame, trimmed: bool = True, least_item: int = LEAST_ITEM) -> DataFrame:
    """One row for each text and test item that overlap: how many words agree, and where in the text."""
    arrow_batches(docs.sparkSession)
    d, out = id_and_text(docs), None
    for held in _blocks(benchmark, least_item):
        found = d.mapInArrow(tidy(_leaks, held, trimmed), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, trimmed: bool = True, least_item: int = LEAST_ITEM) -> DataFrame:
    """``docs``, all columns, without the texts that overlap with a test item. Rows are judged one by one."""
    arrow_batches(docs.sparkSession)
    for held in _blocks(benchmark, least_item):
        docs = docs.mapInArrow(tidy(_clean, held, trimmed), docs.schema)
    return docs
