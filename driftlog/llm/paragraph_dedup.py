"""Substring deduplication: near-duplicate paragraphs, and passages repeated inside paragraphs.

Paragraphs. A paragraph is a line of a text with at least ``least_words`` words and, with ``blocks``, also
all lines between blank ones together, so that wrapped text is compared as a whole. Its set of word shingles
gets a MinHash signature in bands; a similarity of 0.8 collides in some band with probability
1 - (1 - 0.8**rows)**bands, 0.9998 for the defaults. Paragraphs that share a band key are joined as stars,
first inside a task and then between tasks, so a key never brings more rows to a task than there are
tasks; connected stars are a cluster, inside which the exact Jaccard similarity decides (see
``jaccard_join``). Linked paragraphs are a component; its first occurrence stays. Paragraphs shorter than a
shingle link if they are equal, and are reported but not removed.

Passages. A passage copied into the middle of a longer line leaves the line's similarity low, so no
paragraph method can see it. All runs of ``width`` words are hashed, and of every ``window`` adjacent ones
the smallest hash is selected: two texts that share ``width + window - 1`` words share a selected run. Runs
found in two documents are merged into stretches; the document with the smallest id keeps its own. The ends of
the others are then widened word by word as far as they agree with what they repeat.

Equal paragraphs are one class and stand for one in the search. Spans are places of words in a text.

Defined results: null and empty texts have no paragraphs; rows with a null id cannot be named and are left
out; rows that share an id count as one document, so nothing repeats between them alone; what repeats in
one document only stays; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.llm.components import components
from driftlog.llm.jaccard_join import CELLS, SMALL, _edges, _stars, block_plan, cluster_links, link_edges
from driftlog.llm.shared import Scratch, arrow_batches, id_and_text, spread_join, tidy, written
from driftlog.llm.words import U, distinct, mix, shingles, split_words, word_hashes


#: clustered classes, about 32 bytes each, that may be broadcast; more are joined by a shuffle of the texts
MOST_WANTED = 2_000_000


def paragraphs(texts: pa.Array, width: int, least_words: int, blocks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of each paragraph; its sorted distinct shingles, and how many."""
    lines = pc.split_pattern(texts, "\n")
    per_text = pc.list_value_length(lines).to_numpy().astype(np.int64)
    words, counts = split_words(lines.flatten())
    owner = np.repeat(np.arange(len(per_text)), per_text)
    first_line = np.cumsum(per_text) - per_text
    before = np.cumsum(counts) - counts
    first_word = before - before[np.minimum(first_line, max(0, len(before) - 1))][owner] if len(before) else before
    hashes = word_hashes(words)
    found = []
    for of, first, size, inside in [(owner, first_word, counts, hashes), *([_blocks(owner, first_word, counts, hashes)] if blocks else [])]:
        keep = size >= least_words
        found.append((of[keep], first[keep], size[keep], *distinct(*shingles(inside[np.repeat(keep, size)], size[keep], width))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(owner: np.ndarray, first_word: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first word, number of words, and hashes of all words) of the runs of two and more lines that are not blank."""
    full = counts > 0
    begins = full & np.r_[True, ~full[:-1] | (owner[1:] != owner[:-1])][: len(full)]
    block = np.cumsum(begins)[full] - 1
    size = np.bincount(block, weights=counts[full], minlength=int(begins.sum())).astype(np.int64)
    several = np.bincount(block, minlength=len(size)) > 1
    at = np.flatnonzero(begins)[several]
    return owner[at], first_word[at], size[several], hashes[np.repeat(several, size)]


def signatures(sets: np.ndarray, n: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of each set."""
    if not len(n):
        return np.zeros((0, bands), U)
    starts = np.cumsum(n) - n
    odd = mix(np.arange(1, bands * rows + 1, dtype=U)) | U(1)
    out = np.zeros((len(n), bands), U)
    for b in range(bands):
        key = np.full(len(n), b + 1, U)
        for k in range(b * rows, (b + 1) * rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(sets) * odd[k], starts))
        out[:, b] = key
    return out


def _find(width: int, least_words: int, blocks: bool, bands: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs with the hashes of their sets, and, once for each class of a task, band keys."""
    seen: set = set()
    for b in batches:
        text, first, words, sets, n = paragraphs(b.column("text"), width, least_words, blocks)
        if not len(n):
            continue
        starts = np.cumsum(n) - n
        sig_a = np.bitwise_xor.reduceat(sets, starts).view(np.int64)
        sig_b = np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), starts).view(np.int64)
        new = []
        for k in zip(n.tolist(), sig_a.tolist(), sig_b.tolist(), strict=True):
            new.append(k not in seen)
            seen.add(k)
        new = np.array(new)
        keys = iter(signatures(sets[np.repeat(new, n)], n[new], bands, rows))
        raw = [next(keys).tobytes() if x else None for x in new.tolist()]
        yield pa.record_batch(
            [b.column("doc_id").take(pa.array(text)), pa.array(first), pa.array(words), pa.array(n), pa.array(sig_a), pa.array(sig_b), pa.array(raw, pa.binary())],
            ["doc_id", "first_word", "words", "n", "sig_a", "sig_b", "keys"],
        )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of every band; nodes of the task that share a key are joined here, by a key of their own."""
    keys, nodes = [], []
    for b in batches:
        k = [np.frombuffer(x, U) for x in b.column("keys").to_pylist()]
        if k:
            keys.append(np.concatenate(k))
            nodes.append(np.repeat(b.column("sig_a").to_numpy(), [len(x) for x in k]))
    if keys:
        keys, pivots, x, y = _stars(np.concatenate(keys), np.concatenate(nodes))
        own = mix(mix(x.view(U)) + y.view(U))
        keys, nodes = np.concatenate([keys, own, own]).view(np.int64), np.concatenate([pivots, x, y])
        for at in range(0, len(keys), 100_000):
            yield pa.record_batch([pa.array(keys[at : at + 100_000]), pa.array(nodes[at : at + 100_000])], ["key", "node"])


def _sets(width: int, least_words: int, blocks: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the wanted paragraphs of each text (``wanted``: rows of node, cluster, side, copies)."""
    for b in batches:
        text, _, _, sets, n = paragraphs(b.column("text"), width, least_words, blocks)
        wanted = [{w["node"]: w for w in x} for x in b.column("wanted").to_pylist()]
        out, at = [], 0
        for t, k in zip(text.tolist(), n.tolist(), strict=True):
            s = sets[at : at + k]
            at += k
            if (w := wanted[t].pop(int(np.bitwise_xor.reduce(s).view(np.int64)), None)) is not None:
                out.append((w["node"], w["cluster"], w["side"], w["copies"], s.tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.record_batch([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], ["node", "cluster", "side", "copies", "shingles"])


def repeated_paragraphs(docs: DataFrame, width: int = 5, percent: int = 80, least_words: int = 1, bands: int = 12, rows: int = 3, blocks: bool = True) -> DataFrame:
    """Every occurrence of a paragraph that a near-duplicate of another document repeats."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch, set_scratch = Scratch(spark), Scratch(spark)
    d = id_and_text(docs).where("doc_id IS NOT NULL")
    p = set_scratch.written(d.mapInArrow(tidy(_find, width, least_words, blocks, bands, rows), "doc_id long, first_word long, words long, n long, sig_a long, sig_b long, keys binary"), "paragraphs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), p.count() * bands // CELLS + 1)
    keyed = p.where("keys IS NOT NULL").select("sig_a", "keys").mapInArrow(tidy(_keyed), "key long, node long").repartition(parts, "key")
    stars = scratch.written(keyed.mapInArrow(tidy(_edges), "a long, b long").distinct(), "paragraph-stars", parts)
    places = scratch.written(p.select("doc_id", "first_word", "words", "n", "sig_a", "sig_b"), "paragraph-places", parts)
    set_scratch.drop()  # the large table has served
    clusters = components(stars)

    first = F.struct("doc_id", "first_word")
    classes = places.groupBy("n", "sig_a", "sig_b").agg(F.min(first).alias("rep"), F.max("doc_id").alias("last_doc"), F.count("*").alias("copies"))
    classes = scratch.written(classes, "paragraph-classes", parts)
    wanted = classes.join(clusters, classes["sig_a"] == clusters["node"]).select(F.col("rep.doc_id").alias("rep"), "node", "n", "copies", F.col("label").alias("cluster"))
    wanted = scratch.written(wanted, "paragraph-clustered", parts)
    planned = scratch.written(block_plan(wanted, F.col("n") * 8, scratch), "paragraph-plan", parts)
    ids = planned.groupBy("rep").agg(F.collect_list(F.struct("node", "cluster", "side", "copies")).alias("wanted"))  # paragraphs of one text
    ids = F.broadcast(ids) if planned.count() <= MOST_WANTED else ids
    texts = d.join(ids, F.col("doc_id") == F.col("rep")).select("wanted", "text")
    sets = set_scratch.written(texts.mapInArrow(tidy(_sets, width, least_words, blocks), "node long, cluster long, side int, copies long, shingles binary"), "paragraph-sets")
    edges = scratch.written(link_edges(cluster_links(sets, planned, percent, set_scratch)).distinct(), "paragraph-links", parts)
    set_scratch.drop()
    labels = components(edges)

    named = classes.join(labels, classes["sig_a"] == labels["node"], "left").select("n", "sig_a", "sig_b", "rep", "last_doc", "copies", F.coalesce("label", "sig_a").alias("component"))
    named = scratch.written(named, "paragraph-components", parts)
    groups = named.groupBy("component").agg(F.min("rep").alias("keep"), F.max("last_doc").alias("last_doc"), F.count("*").alias("members")).where(F.col("keep.doc_id") < F.col("last_doc"))
    groups = scratch.written(groups, "paragraph-keepers", parts)
    kept = scratch.written(spread_join(named, groups.select("component", "keep", "members"), ["component"], "members").select("n", "sig_a", "sig_b", "keep", "copies"), "paragraph-groups", parts)
    out = spread_join(places, kept, ["n", "sig_a", "sig_b"], "copies").select(
        "doc_id", F.lit("paragraph").alias("kind"), "first_word", (F.col("first_word") + F.col("words") - 1).alias("last_word"),
        F.col("keep.doc_id").alias("keep_id"), ((F.struct("doc_id", "first_word") != F.struct("keep.doc_id", "keep.first_word")) & (F.col("words") >= width)).alias("removed"),
    )
    out = written(out, "repeated-paragraphs")
    scratch.drop()
    return out


# ---------------------------------------------------------------- passages

_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 2**64)


def _over(a: np.ndarray, n: int, pick) -> np.ndarray:
    """Smallest (or largest) of every ``n`` adjacent values."""
    got, size = a, 1
    while 2 * size <= n:
        got, size = pick(got[:-size], got[size:]), 2 * size
    return got if size == n else pick(got[: len(a) - n + 1], got[n - size :][: len(a) - n + 1])


def select_runs(hashes: np.ndarray, counts: np.ndarray, width: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the runs of ``width`` words that are smallest among ``window`` adjacent runs."""
    n = len(hashes) - width + 1
    if n < window:
        return np.zeros(0, U), np.zeros(0, np.int64)
    power = np.cumprod(np.r_[U(1), np.full(len(hashes) - 1, _BASE, U)])
    total = np.concatenate([np.zeros(1, U), np.cumsum(hashes * power)])
    back = np.cumprod(np.r_[U(1), np.full(n - 1, _INVERSE, U)])
    run = mix((total[width:] - total[:-width]) * back)
    run[np.repeat(np.cumsum(counts), counts)[:n] - np.arange(n) < width] = U(2**64 - 1)  # runs do not cross texts
    least = _over(run, window, np.minimum)
    padded = np.concatenate([np.zeros(window - 1, U), least, np.zeros(window - 1, U)])
    at = np.flatnonzero((_over(padded, window, np.maximum) == run) & (run != U(2**64 - 1)))
    return run[at], at


def _runs(width: int, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, counts = split_words(b.column("text"))
        run, at = select_runs(word_hashes(words), counts, width, window)
        ends = np.cumsum(counts)
        text = np.searchsorted(ends, at, "right")
        yield pa.record_batch([pa.array(run.view(np.int64)), b.column("doc_id").take(pa.array(text)), pa.array(at - (ends - counts)[text])], ["run", "doc_id", "at"])


def _contexts(reach: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of up to ``reach`` words before (side 0, the nearest first) or from (side 1) the places of a text that are asked for."""
    for b in batches:
        words, counts = split_words(b.column("text"))
        hashes, out, begin = word_hashes(words).view(np.int64), [], 0
        for doc_id, n, asked in zip(b.column("doc_id").to_pylist(), counts.tolist(), b.column("asked").to_pylist(), strict=True):
            own = hashes[begin : begin + n]
            begin += n
            for x in asked:
                at = min(x["at"], n)
                out.append((doc_id, x["at"], x["side"], (own[at : at + reach] if x["side"] else own[max(0, at - reach) : at][::-1]).tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        yield pa.record_batch([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], ["doc_id", "at", "side", "near"])


def _widened(docs: DataFrame, stretches: DataFrame, width: int, window: int, parts: int, scratch: Scratch) -> DataFrame:
    """How many words on, ``n``, a removed stretch and the text it repeats agree beyond its ends ``doc_id, at, side``.

    Fewer than ``window`` words, or there would be another selected run. Only texts with such ends are read again.
    """
    ends = stretches.where("removed").select("doc_id", F.inline(F.array(
        F.struct(F.col("first_word").alias("at"), F.lit(0).alias("side"), F.col("head.keep_id").alias("k_id"), F.col("head.keep_at").alias("k_at")),
        F.struct((F.col("last_word") + 1).alias("at"), F.lit(1).alias("side"), F.col("tail.keep_id").alias("k_id"), (F.col("tail.keep_at") + width).alias("k_at")),
    )))
    ends = scratch.written(ends, "passage-ends", parts)
    theirs = scratch.written(ends.groupBy("k_id", "k_at", "side").agg(F.count("*").alias("uses")), "passage-origins", parts)
    places = ends.select("doc_id", "at", "side").unionAll(theirs.select("k_id", "k_at", "side")).distinct()
    asked = scratch.written(places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "side")).alias("asked")), "passage-places", parts)  # places of one text
    few = F.broadcast(asked) if asked.count() <= SMALL else asked
    read = docs.join(few, "doc_id").select("doc_id", "text", "asked").mapInArrow(tidy(_contexts, window - 1), "doc_id long, at long, side int, near array<long>")
    near = scratch.written(read.groupBy("doc_id", "at", "side").agg(F.min("near").alias("near")), "passage-contexts", parts)
    theirs = theirs.join(near.select(F.col("doc_id").alias("k_id"), F.col("at").alias("k_at"), "side", F.col("near").alias("theirs")), ["k_id", "k_at", "side"])
    theirs = scratch.written(theirs, "passage-origin-contexts", parts)
    both = spread_join(ends, theirs, ["k_id", "k_at", "side"], "uses").join(near, ["doc_id", "at", "side"])
    first = F.expr("array_position(zip_with(near, theirs, (x, y) -> coalesce(x = y, false)), false)")  # 0: they agree as far as was read
    return both.select("doc_id", "at", "side", F.when(first == 0, F.least(F.size("near"), F.size("theirs"))).otherwise(first - 1).alias("n")).groupBy("doc_id", "at", "side").agg(F.max("n").alias("n"))


def repeated_passages(docs: DataFrame, width: int = 30, window: int = 20) -> DataFrame:
    """Stretches of words that another document has too: removed ones from end to end, a kept one as far as runs of it were selected."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    d = id_and_text(docs).where("doc_id IS NOT NULL")
    runs = scratch.written(d.mapInArrow(tidy(_runs, width, window), "run long, doc_id long, at long"), "selected-runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs.count() // CELLS + 1)
    # partial sums before the shuffle: a run that many documents share arrives as one row from each task
    shared = runs.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("keep"), F.max("doc_id").alias("last"), F.count("*").alias("times")).where("keep.doc_id < last")
    shared = scratch.written(shared.select("run", F.col("keep.doc_id").alias("keep_id"), F.col("keep.at").alias("keep_at"), "times"), "shared-runs", parts)
    found = spread_join(runs, shared, ["run"], "times").select("doc_id", "at", "keep_id", "keep_at", (F.col("doc_id") != F.col("keep_id")).alias("removed"))
    place = Window.partitionBy("doc_id", "removed").orderBy("at")
    found = found.withColumn("fresh", F.coalesce(F.col("at") > F.lag("at").over(place) + width, F.lit(True)).cast("long"))
    found = found.withColumn("stretch", F.sum("fresh").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    origin = F.struct("keep_id", "keep_at")
    out = found.groupBy("doc_id", "removed", "stretch").agg(F.min("at").alias("first_word"), (F.max("at") + width - 1).alias("last_word"), F.min("keep_id").alias("keep_id"), F.min_by(origin, "at").alias("head"), F.max_by(origin, "at").alias("tail"))
    out = scratch.written(out, "passage-stretches", parts)
    more = scratch.written(_widened(d, out, width, window, parts, scratch), "passage-widths", parts)
    before = more.where("side = 0").select("doc_id", F.col("at").alias("first_word"), F.lit(True).alias("removed"), F.col("n").alias("before"))
    after = more.where("side = 1").select("doc_id", (F.col("at") - 1).alias("last_word"), F.lit(True).alias("removed"), F.col("n").alias("after"))
    out = out.join(before, ["doc_id", "first_word", "removed"], "left").join(after, ["doc_id", "last_word", "removed"], "left")
    first, last = F.col("first_word") - F.coalesce("before", F.lit(0)), F.col("last_word") + F.coalesce("after", F.lit(0))
    out = written(out.select("doc_id", F.lit("passage").alias("kind"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), "keep_id", "removed"), "repeated-passages")
    scratch.drop()
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Paragraphs and passages: ``doc_id, kind, first_word, last_word, keep_id, removed``."""
    return repeated_paragraphs(docs).unionByName(repeated_passages(docs))
