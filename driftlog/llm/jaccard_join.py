"""N-gram Jaccard self-join by parity sketches.

A document's set of word shingles, each a 64-bit hash, is dealt into k cells; a cell is the XOR of the
hashes in it, so an element that only one of two sets has changes one cell at most: the number of cells
that differ, the Hamming distance over cells, lower-bounds the symmetric difference. Two documents of n
and m shingles with a Jaccard similarity of at least p % differ in at most D = (n + m)(100 - p)/(100 + p)
shingles, so with k > D they agree in at least k - D cells. By the pigeonhole principle they then share
one of the D + 1 cells that come first in any order that is the same for all. k is fixed for a size band
(sizes from a power of two to the next); a document that can pair with the band below has that band's
sketch too, and prefixes and cells of a band allow for partners of the band above. The order is by how often a cell occurs in the corpus, then by how many shingles it holds: all
cells are counted, by ranges of keys, so cells that nobody shares fill the prefix first and are not sent at
all, and unlike documents that share a passage do not meet.

Cells are the join keys. Documents that share one form a chain of stars, first inside a task and then
between tasks, so a key never brings more rows to a task than there are tasks. Connected stars are a
cluster; inside a cluster one-bit parity sketches, whose Hamming distance lower-bounds the symmetric
difference too, leave the pairs that the exact comparison of the sets then decides, all of them. A cluster of
any size is compared by pairs of blocks; what is emitted is, for each class, how many documents it links
with and one member of its component, never the pairs.

Equal sets are one class and stand for one document in all this. Classes are told apart by 128 bits of
hash and the size, shingles by 64 bits.

Defined results: a null or empty text, or one without words, has the empty set and links with nothing; a
text shorter than the shingle width is one shingle; rows that share an id are
separate documents; a null id is never the smallest, and a class with null ids alone links with nothing
(it counts in no ``n_links`` either) and has a null component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.components import components
from driftlog.llm.files import opened, whole_file
from driftlog.llm.shared import Scratch, arrow_batches, id_and_text, own_name, spread_join, tidy, written
from driftlog.llm.words import U, mix, shingle_sets

#: documents in a block of a cluster, blocks from which on blocks grow instead, documents in a block at most, and bytes of sets
BLOCK_DOCS, MANY_BLOCKS, MOST_BLOCK_DOCS, BLOCK_BYTES = 128, 32, 2048, 16 << 20
#: cells of a partition, and of a range of keys that are counted together
CELLS = 2_000_000
#: times that a task announces a key which several of its documents have
MOST_TOLD = 8
#: ids that may be broadcast
SMALL = 400_000
#: distinct shingles that are compared at a time
_COLUMNS = 4096


def most_apart(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Largest symmetric difference of two sets with ``n`` elements together."""
    return n * (100 - percent) // (100 + percent)


def largest_prefix(n: int, percent: int) -> int:
    """Cells that a set of ``n`` and any larger set it can link with cannot differ in, all of them."""
    return int(most_apart(n + 100 * n // percent, percent)) + 1


def n_cells(band: int, percent: int) -> int:
    """Cells of a band: more than a set of it and a partner, also one of the next band, can differ in."""
    return largest_prefix(2 ** (band + 1) - 1, percent) * 6 // 5 + 1


def _sketches(width: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, two hashes of the set, the cells of the own band and of the one below (or null), and the task's number."""
    part = TaskContext.get().partitionId()
    for b in batches:
        sets, counts = shingle_sets(b.column("text"), width)
        ends = np.cumsum(counts)
        sig_a, sig_b, own, low = [], [], [], []
        for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
            s = sets[e - n : e]
            sig_a.append(int(np.bitwise_xor.reduce(s)) if n else 0)
            sig_b.append(int(np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)))) if n else 0)
            band = n.bit_length() - 1
            own.append(_cells(s, n_cells(band, percent)).tobytes() if n else None)
            low.append(_cells(s, n_cells(band - 1, percent)).tobytes() if band > 0 and percent * n <= 100 * (2**band - 1) else None)
        yield pa.record_batch(
            [b.column("doc_id"), b.column("h"), pa.array(counts.astype(np.int64)), pa.array(np.array(sig_a, U).view(np.int64)), pa.array(np.array(sig_b, U).view(np.int64)), pa.array(own, pa.binary()), pa.array(low, pa.binary()), pa.array(np.full(len(counts), part, np.int32))],
            ["doc_id", "h", "n", "sig_a", "sig_b", "own", "low", "part"],
        )


def _cells(s: np.ndarray, k: int) -> np.ndarray:
    """XOR of the hashes that fall into each of ``k`` cells; the last four bits say how many fell there (15: or more)."""
    cell = ((s >> U(32)) % U(k)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out = np.zeros(k, U)
    held = np.minimum(np.diff(first, append=len(s)), 15).astype(U)
    out[cell[first]] = np.bitwise_xor.reduceat(s[order], first) & ~U(15) | held
    return out


def _keys(b: pa.RecordBatch, percent: int, seen: set) -> Iterator[tuple[np.ndarray, ...]]:
    """For the sketches of a batch (equal sets once a task): keys, how many elements each holds, their document's
    place, and by place nodes and prefix lengths."""
    keys, held, owner, nodes, lengths = [], [], [], [], []
    for n, a, s, own, low in zip(*(b.column(c).to_pylist() for c in ("n", "sig_a", "sig_b", "own", "low")), strict=True):
        if not n or (n, a, s) in seen:
            continue
        seen.add((n, a, s))
        band = n.bit_length() - 1
        # partners of the own band's cells may be of the next band, whose cells of this band they meet
        for raw, level, length in ((own, band, largest_prefix(n, percent)), (low, band - 1, int(most_apart(n + 2**band - 1, percent)) + 1)):
            if raw is not None:
                cells = np.frombuffer(raw, U)
                keys.append(mix(cells + U(0x9E3779B97F4A7C15) * np.arange(1, len(cells) + 1, dtype=U) + U((level + 1) * 0xD1B54A32D192ED03 % 2**64)))
                held.append(cells & U(15))
                owner.append(np.full(len(cells), len(nodes)))
                nodes.append(a)
                lengths.append(length)
    if keys:
        yield np.concatenate(keys), np.concatenate(held).astype(np.int64), np.concatenate(owner), np.array(nodes, np.int64), np.array(lengths)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        parts = b.column("part").to_numpy()
        first = np.flatnonzero(np.diff(parts, prepend=-1)).tolist()
        for lo, hi in zip(first, [*first[1:], len(parts)], strict=True):
            yield int(parts[lo]), b.slice(lo, hi - lo)


def _announce(percent: int, ranges: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All keys of each part, cut by ranges of keys: one row for a range and part, not for a key. Every part has a row in range 0."""
    held: dict[int, tuple[set, list]] = {}
    for part, b in _by_part(batches):
        seen, got = held.setdefault(part, (set(), []))
        got += [k for k, *_ in _keys(b, percent, seen)]
    for part, (_, got) in held.items():
        keys, n = np.unique(np.concatenate([np.zeros(0, U), *got]), return_counts=True)
        keys = np.repeat(keys, np.minimum(n, MOST_TOLD))
        cut = np.searchsorted((keys >> U(32)) * U(ranges) >> U(32), np.arange(ranges + 1, dtype=U)).tolist()
        rows = [(r, keys[cut[r] : cut[r + 1]].tobytes()) for r in range(ranges) if cut[r] < cut[r + 1] or not r]
        for at in range(0, len(rows), 200):
            some = rows[at : at + 200]
            yield pa.record_batch([pa.array([r for r, _ in some], pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([k for _, k in some], pa.binary())], ["range", "part", "keys"])


def _answers(rows: list[tuple[int, np.ndarray]], every: bool) -> pa.RecordBatch:
    """For each (part, keys it has) those that occur more than once, and how often: one sort of all keys. ``every``: also parts with none."""
    owner = np.repeat(np.arange(len(rows)), [len(k) for _, k in rows])
    keys = np.concatenate([k for _, k in rows])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    n = np.diff(first, append=len(keys))
    times = np.repeat(n, n)
    keep = times > 1
    keep[1:] &= (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])  # a part is answered once
    keys, times, owner = keys[keep], np.minimum(times[keep], 65_535).astype(np.uint16), owner[keep]
    by = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[by], np.arange(len(rows) + 1)).tolist()
    out = [(part, keys[by[lo:hi]].tobytes(), times[by[lo:hi]].tobytes()) for (part, _), lo, hi in zip(rows, cut, cut[1:], strict=False) if lo < hi or every]
    return pa.record_batch([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "keys", "often"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each part, those of its keys in a range that occur more than once in the corpus, and how often."""
    at, rows = -1, []
    for b in batches:
        for r, part, raw in zip(b.column("range").to_pylist(), b.column("part").to_pylist(), b.column("keys").to_pylist(), strict=True):
            if r != at and rows:
                yield _answers(rows, at == 0)
                rows = []
            at = r
            rows.append((part, np.frombuffer(raw, U)))
    if rows:
        yield _answers(rows, at == 0)


def _file_answers(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers to a part as one file of sorted keys, then how often; rows come sorted by part."""

    def write(part: int, rows: list[tuple[bytes, bytes]]) -> None:
        keys, often = np.frombuffer(b"".join(k for k, _ in rows), U), np.frombuffer(b"".join(n for _, n in rows), np.uint16)
        order = np.argsort(keys, kind="stable")
        with whole_file(f"{folder}/part-{part}") as out:
            out.write(keys[order].tobytes() + often[order].tobytes())

    at, rows = -1, []
    for b in batches:
        for part, keys, often in zip(*(b.column(c).to_pylist() for c in ("part", "keys", "often")), strict=True):
            if part != at and rows:
                write(at, rows)
                rows = []
            at = part
            rows.append((keys, often))
        yield pa.record_batch([pa.array(sorted(set(b.column("part").to_pylist())), pa.int32())], ["part"])
    if rows:
        write(at, rows)


def _shared_keys(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a part that others have. Every part has a file, with no keys at least: one that is missing is an error."""
    with opened(f"{folder}/part-{part}") as f:
        raw = f.read()
    n = len(raw) // 10
    return (np.frombuffer(raw[: 8 * n], U), np.frombuffer(raw[8 * n :], np.uint16)) if n else (np.zeros(1, U), np.ones(1, np.uint16))


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, the smallest node of each, and edges from other nodes to it)."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    pivot = np.repeat(nodes[first], np.diff(first, append=len(keys)))
    edges = np.unique(np.stack([nodes, pivot], 1)[nodes != pivot], axis=0)
    return keys[first], nodes[first], edges[:, 0], edges[:, 1]


def _prefixes(percent: int, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of cells in the prefixes that some other document has; nodes of the task that share a key
    are joined here, by a key of their own."""
    kept_keys, kept_nodes, at, seen = [], [], -1, set()
    for part, b in _by_part(batches):
        if part != at:
            at, seen = part, set()
            shared, times = _shared_keys(folder, part)
        for keys, held, owner, nodes, lengths in _keys(b, percent, seen):
            place = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
            often = np.where(shared[place] == keys, times[place], 1)
            # rare first, then those with more elements: one element can come from a passage that unlike texts share
            order = np.lexsort((keys, -held, often, owner))
            first = np.searchsorted(owner, np.arange(len(nodes)))  # owners are ascending before and after
            keep = order[np.arange(len(keys)) - first[owner] < lengths[owner]]
            keep = keep[often[keep] > 1]
            kept_keys.append(keys[keep])
            kept_nodes.append(nodes[owner[keep]])
    if not kept_keys:
        return
    keys, pivots, x, y = _stars(np.concatenate(kept_keys), np.concatenate(kept_nodes))
    own = mix(mix(x.view(U)) + y.view(U))
    keys, nodes = np.concatenate([keys, own, own]).view(np.int64), np.concatenate([pivots, x, y])
    for at in range(0, len(keys), 100_000):
        yield pa.record_batch([pa.array(keys[at : at + 100_000]), pa.array(nodes[at : at + 100_000])], ["key", "node"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the stars of a partition that has every row of its keys."""
    got = [(b.column("key").to_numpy(), b.column("node").to_numpy()) for b in batches if b.num_rows]
    if got:
        _, _, x, y = _stars(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        yield pa.record_batch([pa.array(x), pa.array(y)], ["a", "b"])


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the documents that stand for a class; another row with the same id has another set and goes."""
    for b in batches:
        sets, counts = shingle_sets(b.column("text"), width)
        ends = np.cumsum(counts).tolist()
        got = [sets[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]
        own = [len(x) > 0 and int(np.bitwise_xor.reduce(x).view(np.int64)) == node for x, node in zip(got, b.column("node").to_pylist(), strict=True)]
        out = pa.record_batch([*(b.column(c) for c in ("node", "cluster", "side", "copies")), pa.array([x.tobytes() for x in got], pa.binary())], ["node", "cluster", "side", "copies", "shingles"])
        yield out.filter(pa.array(own, pa.bool_()))


# ---------------------------------------------------------------- clusters


class Block:
    """Sets of classes, each once: nodes, how many documents each stands for, and sorted distinct shingles."""

    def __init__(self, rows: list[tuple[int, int, bytes]]) -> None:
        rows = sorted({node: (node, copies, raw) for node, copies, raw in rows}.values(), key=lambda r: (len(r[2]), r[0]))
        self.nodes = np.array([r[0] for r in rows], np.int64)
        self.copies = np.array([r[1] for r in rows], np.int64)
        self.sets = [np.frombuffer(r[2], U) for r in rows]
        self.size = np.array([len(x) for x in self.sets], np.int64)

    def sketches(self, words: int) -> np.ndarray:
        """One-bit parity sketches."""
        out = np.zeros((len(self.sets), words), U)
        for i, x in enumerate(self.sets):
            bit = (mix(x) % U(64 * words)).astype(np.int64)
            np.bitwise_xor.at(out[i], bit >> 6, U(1) << (bit & 63).astype(U))
        return out


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, by products of incidence matrices."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    several = n > 1
    place = np.cumsum(several) - 1
    keep = several[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float64)
    cuts = np.searchsorted(column, np.arange(0, int(several.sum()) + _COLUMNS, _COLUMNS)).tolist()
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        held = np.zeros((len(a) + len(b), _COLUMNS), np.float32)
        held[owner[lo:hi], column[lo:hi] - k * _COLUMNS] = 1
        out += held[: len(a)] @ held[len(a) :].T
    return out.astype(np.int64)


def linked_pairs(a: Block, b: Block, percent: int) -> np.ndarray:
    """Whether sets of two blocks link. Parity sketches leave the pairs whose sets are compared, all of them."""
    words = 1 << max(0, int(4 * max(a.size[-1], b.size[-1]) - 1).bit_length() - 6)  # at least four bits for each shingle of the largest set
    left = a.sketches(words)
    right = left if a is b else b.sketches(words)
    near = np.zeros((len(left), len(right)), bool)
    # sizes ascend: the partners that sizes allow are one stretch
    lo = np.searchsorted(100 * b.size, percent * a.size, "left")
    hi = np.searchsorted(percent * b.size, 100 * a.size, "right")
    for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        if x < y:
            near[i, x:y] = np.bitwise_count(right[x:y] ^ left[i]).sum(1, dtype=np.int64) <= most_apart(a.size[i] + b.size[x:y], percent)
    if a is b:
        near &= np.tri(len(left), k=-1, dtype=bool)
    rows, cols = np.nonzero(near)
    if not len(rows):
        return near
    if len(rows) <= 4 * (len(left) + len(right)):
        both = np.array([len(np.intersect1d(a.sets[i], b.sets[j], assume_unique=True)) for i, j in zip(rows.tolist(), cols.tolist(), strict=True)])
    else:
        r, c = np.unique(rows), np.unique(cols)
        both = _common([a.sets[i] for i in r.tolist()], [b.sets[j] for j in c.tolist()])[np.searchsorted(r, rows), np.searchsorted(c, cols)]
    near[rows, cols] = 100 * both >= percent * (a.size[rows] + b.size[cols] - both)
    return near | near.T if a is b else near


def _least_reached(linked: np.ndarray) -> np.ndarray:
    """For each member of a symmetric relation the smallest one it reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def pair_links(a: Block, b: Block, percent: int) -> pa.RecordBatch:
    """For members of two blocks (or of one, twice) that link: a member of the same component here, and the documents they link with."""
    linked = linked_pairs(a, b, percent)
    if a is b:
        nodes, links, whole = a.nodes, linked @ a.copies, linked
    else:
        nodes, links = np.concatenate([a.nodes, b.nodes]), np.concatenate([linked @ b.copies, a.copies @ linked])
        whole = np.block([[np.zeros((len(a.nodes),) * 2, bool), linked], [linked.T, np.zeros((len(b.nodes),) * 2, bool)]])
    some = np.flatnonzero(links > 0)
    to = nodes[some][_least_reached(whole[np.ix_(some, some)])] if len(some) else np.zeros(0, np.int64)
    return pa.record_batch([pa.array(nodes[some]), pa.array(to.astype(np.int64)), pa.array(links[some].astype(np.int64))], ["node", "to", "links"])


_LINKS = "node long, to long, links long"


def _by_cluster(names: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Groups of rows that come sorted by ``names``: their key, and (node, copies, shingles) of each row with a node."""
    at, rows = None, []
    for b in batches:
        for *key, node, copies, raw in zip(*(b.column(c).to_pylist() for c in (*names, "node", "copies", "shingles")), strict=True):
            if at != key:
                if at is not None:
                    yield tuple(at), rows
                at, rows = key, []
            if node is not None:
                rows.append((node, copies, raw))
    if at is not None:
        yield tuple(at), rows


def _small_links(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole clusters."""
    for _, rows in _by_cluster(("cluster",), batches):
        if len(rows) > 1:
            block = Block(rows)
            yield pair_links(block, block, percent)


_PART = struct.Struct("<qqq")


def _file_blocks(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file for each block of a large cluster, also for an empty one."""
    for (cluster, side), rows in _by_cluster(("cluster", "side"), batches):
        with whole_file(f"{folder}/{cluster}-{side}") as out:
            for node, copies, raw in rows:
                out.write(_PART.pack(node, copies, len(raw)) + raw)
        yield pa.record_batch([pa.array([cluster]), pa.array([side], pa.int32())], ["cluster", "side"])


def _read_block(folder: str, cluster: int, side: int) -> Block:
    with opened(f"{folder}/{cluster}-{side}") as f:
        raw, at, rows = f.read(), 0, []
    while at < len(raw):
        node, copies, n = _PART.unpack_from(raw, at)
        rows.append((node, copies, raw[at + _PART.size : at + _PART.size + n]))
        at += _PART.size + n
    return Block(rows)


def _pair_links(folder: str, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of pairs of blocks, read from their files."""
    for b in batches:
        for cluster, lo, hi in zip(*(b.column(c).to_pylist() for c in ("cluster", "lo", "hi")), strict=True):
            left = _read_block(folder, cluster, lo)
            right = left if lo == hi else _read_block(folder, cluster, hi)
            if len(left.nodes) and len(right.nodes):
                yield pair_links(left, right, percent)


def block_plan(nodes: DataFrame, size: Column, scratch: Scratch) -> DataFrame:
    """``nodes`` of clusters of two and more, with their ``side`` of so many ``blocks``."""
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("members"), F.sum(size).alias("bytes")).where("members > 1")
    by_docs = F.greatest(F.least(F.ceil(F.col("members") / BLOCK_DOCS), F.lit(MANY_BLOCKS)), F.ceil(F.col("members") / MOST_BLOCK_DOCS))
    sizes = scratch.written(sizes.select("cluster", F.greatest(by_docs, F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"), "members"), "cluster-sizes")
    return spread_join(nodes, sizes, ["cluster"], "members").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def cluster_links(sets: DataFrame, planned: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Every linked class of ``sets`` (node, cluster, side, copies, shingles): rows (``node``, ``to`` in its component, ``links``: documents).

    ``planned``: the clusters with their ``blocks``. Clusters of one block are groups of bounded size. A larger one is written
    in blocks, a file each, and every pair of blocks is one row of a task, however many blocks the cluster has.
    """
    spark = sets.sparkSession
    large = scratch.written(planned.where("blocks > 1").select("cluster", "blocks").distinct(), "large-clusters", 1)
    clusters, pairs = large.agg(F.count("*"), F.coalesce(F.sum(F.expr("blocks * (blocks + 1) div 2")), F.lit(0))).first()
    few = F.broadcast(large.select("cluster")) if clusters <= SMALL else large.select("cluster")
    small = sets.join(few, "cluster", "left_anti") if clusters else sets
    out = small.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(tidy(_small_links, percent), _LINKS)
    if not clusters:
        return scratch.written(out, "links")
    folder = scratch.path("blocks")
    every = large.select(F.lit(None).cast("long").alias("node"), "cluster", F.explode(F.expr("sequence(0, blocks - 1)")).alias("side"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("binary").alias("shingles"))
    dealt = sets.join(few, "cluster", "left_semi").unionByName(every).repartition("cluster", "side").sortWithinPartitions("cluster", "side")
    dealt.mapInArrow(tidy(_file_blocks, folder), "cluster long, side int").count()
    tasks = large.select("cluster", "blocks", F.explode(F.expr("sequence(0, blocks - 1)")).alias("lo")).select("cluster", "lo", F.explode(F.expr("sequence(lo, blocks - 1)")).alias("hi"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = scratch.written(tasks, "block-pairs")
    dealt = tasks.repartition(min(pairs, max(least, pairs // 32)))
    return scratch.written(out.unionAll(dealt.mapInArrow(tidy(_pair_links, folder, percent), _LINKS)), "links")


def link_edges(links: DataFrame) -> DataFrame:
    return links.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b"))


def join_groups(docs: DataFrame, width: int = 4, percent: int = 85, texts: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest id reachable by links), ``n_links`` (documents it links with).

    ``texts``: also ``h``, the hash of the text, and ``label``, the same for linked rows only.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch, sketch_scratch = Scratch(spark), Scratch(spark)
    d = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    s = sketch_scratch.written(d.mapInArrow(tidy(_sketches, width, percent), "doc_id long, h long, n long, sig_a long, sig_b long, own binary, low binary, part int"), "sketches")
    sketches = s.select("n", "sig_a", "sig_b", "own", "low", "part")

    # rarity: keys are counted by ranges, and each part of the table is told which of its keys others have
    cells = int(s.agg(F.sum(F.expr(f"n * {100 - percent} * 3 div {100 + percent} + 2"))).first()[0] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells // CELLS + 1)
    folder = sketch_scratch.path("shared-keys")
    told = sketches.mapInArrow(tidy(_announce, percent, parts), "range int, part int, keys binary").repartition(parts, "range").sortWithinPartitions("range")
    answers = told.mapInArrow(tidy(_answer), "part int, keys binary, often binary").repartition("part").sortWithinPartitions("part")
    answers.mapInArrow(tidy(_file_answers, folder), "part int").count()

    # candidates: stars of documents that share a rare cell
    keyed = sketches.mapInArrow(tidy(_prefixes, percent, folder), "key long, node long").repartition(parts, "key")
    stars = scratch.written(keyed.mapInArrow(tidy(_edges), "a long, b long").distinct(), "star-edges", parts)
    ids = scratch.written(s.select("doc_id", "h", "n", "sig_a", "sig_b"), "sketch-ids", parts)
    sketch_scratch.drop()  # the large table has served
    clusters = components(stars)

    # sets of one document of each clustered class
    classes = scratch.written(ids.where("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes", parts)
    wanted = classes.join(clusters, classes["sig_a"] == clusters["node"]).where("rep IS NOT NULL").select("rep", "node", "n", "copies", F.col("label").alias("cluster"))
    wanted = scratch.written(wanted, "clustered", parts)
    planned = scratch.written(block_plan(wanted, F.col("n") * 8, scratch), "cluster-plan", parts)
    few = F.broadcast(planned) if planned.count() <= SMALL else planned
    found = d.join(few, F.col("doc_id") == F.col("rep")).select("node", "cluster", "side", "copies", "text")
    set_scratch = Scratch(spark)
    sets = set_scratch.written(found.mapInArrow(tidy(_sets, width), "node long, cluster long, side int, copies long, shingles binary"), "sets")
    links = cluster_links(sets, planned, percent, set_scratch)
    degrees = scratch.written(links.groupBy("node").agg(F.sum("links").alias("links")), "degrees", parts)
    edges = scratch.written(link_edges(links).distinct(), "link-edges", parts)
    set_scratch.drop()
    labels = components(edges)

    linked = scratch.written(classes.join(labels, classes["sig_a"] == labels["node"]).select("node", "rep", "label"), "linked", parts)
    smallest = scratch.written(linked.groupBy("label").agg(F.min("rep").alias("smallest"), F.count("*").alias("members")), "smallest", parts)
    to = spread_join(linked, smallest, ["label"], "members").groupBy("node").agg(F.min("smallest").alias("smallest"), F.min("label").alias("label"))
    known = classes.join(to, classes["sig_a"] == to["node"], "left").drop("node").join(degrees, F.col("sig_a") == degrees["node"], "left")
    known = known.select(
        "n", "sig_a", "sig_b", "copies", F.coalesce("smallest", "rep").alias("component_id"), F.coalesce("label", "sig_a").alias("label"),
        F.when(F.col("rep").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    known = scratch.written(known, "class-links", parts)
    out = spread_join(ids.where("n > 0"), known, ["n", "sig_a", "sig_b"], "copies").select("doc_id", "h", "n", "component_id", "label", "n_links")
    empty = ids.where("n = 0").select("doc_id", "h", "n", F.col("doc_id").alias("component_id"), F.col("sig_a").alias("label"), F.lit(0).cast("long").alias("n_links"))
    out = written(out.unionByName(empty).withColumnRenamed("n", "n_shingles"), "groups", parts)
    scratch.drop()
    return out.select("doc_id", "n_shingles", "component_id", "n_links", *(["h", "label"] if texts else []))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each group of ``join_groups``: that with the smallest id.

    Rows that share an id and are linked are one document; rows with a null id all stay. Rows that share an id
    and are not linked are judged one by one if ``groups`` has the texts' hashes, else by their id alone.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    the_id, the_hash = own_name("near_id", docs, groups), own_name("near_hash", docs, groups)
    if "h" not in groups.columns:
        groups = groups.join(docs.select(F.col("doc_id").alias(the_id), text.alias("h")).distinct(), F.col("doc_id") == F.col(the_id)).withColumn("label", F.col("component_id"))
    groups = groups.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "label", "component_id", "h").agg(F.count("*").alias("n"))
    groups = written(groups, "near-groups")
    several = groups.where("doc_id = component_id").groupBy("doc_id", "label").agg(F.min("h").alias("first"), F.count("*").alias("texts")).where("texts > 1").select("doc_id", "label", "first")
    other = groups.join(several, ["doc_id", "label"]).where("doc_id = component_id AND h <> first")
    named = lambda t: t.select(F.col("doc_id").alias(the_id), F.col("h").alias(the_hash)).distinct()
    gone = written(named(groups.where("doc_id <> component_id").select("doc_id", "h").unionAll(other.select("doc_id", "h"))), "near-copies")
    again = written(named(groups.where("n > 1")), "repeated-ids")
    small = lambda t: F.broadcast(t) if t.count() <= SMALL else t
    same = (F.col("doc_id") == F.col(the_id)) & (text == F.col(the_hash))
    left = docs.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return left
    once = left.join(small(again), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(small(again), same, "left_anti").unionByName(once)
