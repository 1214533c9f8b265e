"""Words, shingles and their hashes, over Arrow batches. All hashes are the same on every machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def hash_texts(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    from pandas.util import hash_array

    return hash_array(texts.to_numpy(zero_copy_only=False), categorize=False)


def hash_bytes(texts: pa.Array, base: int) -> np.ndarray:
    """64-bit hashes of strings by a polynomial in an odd ``base``, over Arrow's buffers, without Python strings."""
    if not len(texts):
        return np.zeros(0, U)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends -= ends[0]
    power = np.cumprod(np.r_[U(1), np.full(len(raw), base, U)])
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(raw.astype(U) + U(1)) * power[:-1])])
    back = np.cumprod(np.r_[U(1), np.full(len(raw), pow(base, -1, 2**64), U)])
    return mix((total[ends[1:]] - total[ends[:-1]]) * back[ends[:-1]] ^ np.diff(ends).astype(U) * U(0x9E3779B97F4A7C15))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of words of each): A-Z in lower case, cut at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # before leading and after trailing white space
    if empty.any():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(owner[empty], minlength=len(counts))
        flat = flat.filter(pa.array(~empty))
    return flat, counts


def word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    return hash_texts(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, U)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of ``width`` words, number of runs of each text); a shorter text is one run."""
    odd = mix(np.arange(1, width + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)  # unrelated multipliers: the order of words matters
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.cumsum(made) - made
    at = np.arange(int(made.sum())) - np.repeat(first, made) + np.repeat(starts, made)
    stop = np.repeat(ends, made)
    padded = np.concatenate([hashes, np.zeros(width, U)])
    out = np.zeros(len(at), U)
    for j in range(width):
        out += np.where(at + j < stop, padded[at + j] * odd[j], U(0))
    short = np.repeat(counts < width, made)
    out[short] += np.repeat(counts, made)[short].astype(U)
    return mix(out), made


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    ends = np.cumsum(counts).tolist()
    hashes, at = hashes.copy(), 0
    for e in ends:
        hashes[at:e].sort()
        at = e
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.bincount(owner[keep], minlength=len(counts))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = split_words(texts)
    return distinct(*shingles(word_hashes(words), counts, width))
