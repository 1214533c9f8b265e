"""Token ids in files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 holds one chunk for each token, level k+1 one for
each token of level k whose id goes on. A level's continuation bitmap says which do, and its rank
directory (ones before each block of 512 bits) turns a place in a level into a place in the next. So any
token is read from a few places, without decoding a block.

Documents are written in ascending order of id, dealt out by range, in shard files of the shared folder.
A shard: magic, sizes, document ids and starts, then the levels. ``Shard`` reads one, whole or by place.

Defined results: null text is empty and gives the end id alone; repeated ids are written one after
another; null ids come first and are read back as null; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.llm.files import opened, whole_file
from driftlog.llm.shared import arrow_batches, id_and_text, new_path, one_per_task, tidy, written_one
from driftlog.llm.words import U, hash_bytes

MAGIC = b"DACTOK01"
BLOCK = 512
_HEAD = struct.Struct("<8sQQI")


# ---------------------------------------------------------------- codes


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        goes_on = rest > 0
        ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK), dtype=np.uint64) if len(goes_on) else np.zeros(0, np.uint64)
        rank = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])
        levels.append((chunks, np.packbits(goes_on, bitorder="little"), rank))
        rest = rest[goes_on]
        if not len(rest):
            return levels


def write_shard(out, doc_ids: np.ndarray, is_null: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
    levels = encode_levels(ids)
    out.write(_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels)))
    out.write(struct.pack(f"<{len(levels)}Q", *(len(c) for c, _, _ in levels)))
    out.write(doc_ids.astype("<i8").tobytes())
    out.write(np.packbits(is_null, bitorder="little").tobytes())
    out.write(starts.astype("<u8").tobytes())
    for chunks, bits, rank in levels:
        for a in (chunks, bits, rank.astype("<u8")):
            out.write(a.tobytes())


class Shard:
    """A shard file; ``token(i)`` reads one id, ``all()`` every one."""

    def __init__(self, uri: str) -> None:
        self.file = opened(uri)
        magic, self.n_docs, self.n_tokens, n_levels = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        self.sizes = struct.unpack(f"<{n_levels}Q", self.file.read(8 * n_levels))
        self.doc_ids = np.frombuffer(self.file.read(8 * self.n_docs), "<i8")
        self.is_null = np.unpackbits(np.frombuffer(self.file.read((self.n_docs + 7) // 8), np.uint8), bitorder="little")[: self.n_docs].astype(bool)
        self.starts = np.frombuffer(self.file.read(8 * self.n_docs), "<u8").astype(np.int64)
        at, self.places = self.file.tell(), []
        for n in self.sizes:
            bits, rank = at + n, at + n + (n + 7) // 8
            self.places.append((at, bits, rank))
            at = rank + 8 * ((n + BLOCK - 1) // BLOCK + 1)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, rank) in enumerate(self.places):
            value |= self._read(chunks + i, 1)[0] << (8 * level)
            if not self._read(bits + i // 8, 1)[0] >> (i % 8) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(np.frombuffer(self._read(bits + block * BLOCK // 8, (i % BLOCK + 7) // 8), np.uint8), bitorder="little")[: i % BLOCK]
            i = struct.unpack("<Q", self._read(rank + 8 * block, 8))[0] + int(inside.sum())
        return value

    def document(self, k: int) -> list[int]:
        end = self.starts[k + 1] if k + 1 < self.n_docs else self.n_tokens
        return [self.token(i) for i in range(self.starts[k], end)]

    def all(self) -> np.ndarray:
        goes_on, out = None, np.zeros(self.n_tokens, np.uint32)
        where = np.arange(self.n_tokens)
        for level, ((chunks, bits, _), n) in enumerate(zip(self.places, self.sizes, strict=True)):
            where = where if goes_on is None else where[goes_on]
            out[where] |= np.frombuffer(self._read(chunks, n), np.uint8).astype(np.uint32) << (8 * level)
            goes_on = np.unpackbits(np.frombuffer(self._read(bits, (n + 7) // 8), np.uint8), bitorder="little")[:n].astype(bool)
        return out


# ---------------------------------------------------------------- tokens

#: a space between white space, or at the end after white space: there a cut before a space is not a cut between the tokenizer's words
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_RUN = f"{_SPACE} ({_SPACE}|$)"


class Encoder:
    """Ids of whole texts by the tokenizers library, with a bounded cache of words.

    A byte-level BPE splits a text into words before it merges, and a new word starts at every single
    space that other characters surround. So a text may be cut there, every distinct piece encoded
    once by the library, and the ids joined. Texts with longer runs of white space, or in which the string
    of an added token stands, are encoded uncut, and so is every text if the tokenizer is of another kind.
    """

    def __init__(self, path: str, end_id: int, most: int = 2_000_000) -> None:
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.cut = not kind.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.uncut = "|".join([_RUN, *(re.escape(t["content"]) for t in kind.get("added_tokens", []) if t["content"])])
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for w, i in vocab.items() if w[:1] == "\u0120"]] = True
        self._clear()

    def _clear(self) -> None:
        """Known words by two hashes of 64 bits (no strings are kept): sorted first hash, second hash, place."""
        self.first, self.second, self.place = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.n, self.words = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(n.sum())), n

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each follow a space. Many go to the library as one text: where a word starts
        shows in the ids, as only its first token begins with a space. Words with white space at an end
        could run together with the next one and go alone."""
        plain = np.fromiter((w != "" and not w[0].isspace() and not w[-1].isspace() for w in words), bool, len(words))
        joined = [w for w, ok in zip(words, plain, strict=True) if ok]
        ids, _ = self._encoded([" " + " ".join(joined[i : i + 1000]) for i in range(0, len(joined), 1000)])
        start = np.flatnonzero(self.spaced[ids])
        if len(start) != len(joined):
            return self._encoded([" " + w for w in words])
        if plain.all():
            return ids, np.diff(start, append=len(ids))
        other_ids, other_n = self._encoded([" " + w for w, ok in zip(words, plain, strict=True) if not ok])
        n = np.empty(len(words), np.int64)
        n[plain], n[~plain] = np.diff(start, append=len(ids)), other_n
        out = np.empty(len(ids) + len(other_ids), np.uint32)
        mine = np.repeat(plain, n)
        out[mine], out[~mine] = ids, other_ids
        return out, n

    def _learn(self, words: list[str], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of new words, whose first hashes differ."""
        ids, n = self._words(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while self.words + len(n) > len(self.n):
            self.at, self.n = np.resize(self.at, 2 * len(self.at)), np.resize(self.n, 2 * len(self.n))
        self.ids[self.used : self.used + len(ids)] = ids
        self.n[self.words : self.words + len(n)] = n
        self.at[self.words : self.words + len(n)] = self.used + np.cumsum(n) - n
        place = np.arange(self.words, self.words + len(n))
        order = np.argsort(first)
        into = np.searchsorted(self.first, first[order])
        self.first, self.second, self.place = np.insert(self.first, into, first[order]), np.insert(self.second, into, second[order]), np.insert(self.place, into, place[order])
        self.used, self.words = self.used + len(ids), self.words + len(n)
        return place

    def _places(self, distinct: pa.Array) -> np.ndarray | None:
        """Places of words, new ones are learned; None if two words share a first hash."""
        first, second = hash_bytes(distinct, 0x2545F4914F6CDD1D), hash_bytes(distinct, 0xD1342543DE82EF95)
        out = np.full(len(first), -1, np.int64)
        if len(self.first):
            at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
            known = self.first[at] == first
            if (self.second[at[known]] != second[known]).any():
                return None
            out[known] = self.place[at[known]]
        if len(new := np.flatnonzero(out < 0)):
            if len(np.unique(first[new])) < len(new):
                return None
            out[new] = self._learn(distinct.take(pa.array(new)).to_pylist(), first[new], second[new])
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, each with the end id; number of ids of each text)"""
        if not self.cut:
            return self._uncut(texts)
        if self.words > self.most:
            self._clear()
        uncut = pc.match_substring_regex(texts, self.uncut)
        pieces = pc.split_pattern(pc.if_else(uncut, "", texts), " ")
        counts = pc.list_value_length(pieces).to_numpy()
        first = np.cumsum(counts) - counts
        flat = pieces.flatten()
        lead = pc.if_else(uncut, texts, flat.take(pa.array(first))).to_pylist()
        coded = flat.dictionary_encode()
        place = self._places(coded.dictionary)
        if place is None:
            self._clear()
            return self._uncut(texts)
        lead_ids, lead_n = self._encoded(lead)
        extra_at = self.used + np.cumsum(lead_n) - lead_n
        ids = np.concatenate([self.ids[: self.used], lead_ids, np.array([self.end_id], np.uint32)])
        at = np.concatenate([self.at[: self.words], extra_at, [len(ids) - 1]])
        n = np.concatenate([self.n[: self.words], lead_n, [1]])
        walk = place[coded.indices.to_numpy()]
        walk[first] = self.words + np.arange(len(texts))
        walk = np.insert(walk, first + counts, len(n) - 1)
        size = n[walk]
        ends = np.cumsum(size)
        out = ids[np.repeat(at[walk] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        whole = ends[np.cumsum(counts + 1) - 1]
        return out, np.diff(whole, prepend=0)

    def _uncut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self._encoded(texts.to_pylist())
        return np.insert(ids, np.cumsum(n), self.end_id), n + 1


_encoders: dict[tuple[str, int], Encoder] = {}


def _write(folder: str, tokenizer: str, end_id: int, shard_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if (encoder := _encoders.get((tokenizer, end_id))) is None:  # kept for the later tasks of this worker
        encoder = _encoders[tokenizer, end_id] = Encoder(tokenizer, end_id)
    part, held, total, made = TaskContext.get().partitionId(), [], 0, []

    def close() -> None:
        nonlocal held, total
        uri = f"{folder}/shard-{part:07d}-{len(made):04d}.dac"
        ids, n = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        with whole_file(uri) as out:
            write_shard(out, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.cumsum(n) - n, ids)
        made.append((part, len(made), uri, len(n), len(ids)))
        held, total = [], 0

    for b in batches:
        if not b.num_rows:
            continue
        doc_id = b.column("doc_id")
        ids, n = encoder(b.column("text"))
        held.append((pc.fill_null(doc_id, 0).to_numpy(), pc.is_null(doc_id).to_numpy(zero_copy_only=False), ids.astype(np.uint32), n))
        total += len(ids)
        if total >= shard_tokens:
            close()
    if held:
        close()
    if made:
        cols = list(zip(*made, strict=True))
        yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["part", "piece", "path", "n_docs", "n_tokens"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_tokens: int = 1 << 25, folder: str | None = None) -> DataFrame:
    """Encode and write every document; the manifest: one row per shard, with ``base``, the ids before it."""
    spark = docs.sparkSession
    arrow_batches(spark, size=32 << 20)
    folder = folder or new_path(spark, "tokens")
    d = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = written_one(d.mapInArrow(tidy(_write, folder, tokenizer, end_id, shard_tokens), "part int, piece int, path string, n_docs long, n_tokens long"), "token-shards")
    # one row per shard, not per document
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
            shard = Shard(path)
            ids = shard.all().astype("<u4")
            ends = np.append(shard.starts[1:], len(ids))
            raw = memoryview(ids.tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(shard.starts.tolist(), ends.tolist(), strict=True)), np.int64, shard.n_docs)
            out = pa.record_batch([pa.array(shard.doc_ids, mask=shard.is_null), pa.array(shard.starts + base), pa.array(ends - shard.starts), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    files = written_one(manifest.select("path", "base"), "token-manifest")
    return one_per_task(files, files.count()).mapInArrow(tidy(_read_shards), "doc_id long, start long, n_tokens long, ids_crc32 long")
