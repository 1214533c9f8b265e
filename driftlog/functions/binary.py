"""Checksums, hashes and Bloom filters over keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

# fixed values
TOMBSTONE_SIZE = 0xFFFFFFFF
MURMUR_MULTIPLIER, MURMUR_SHIFT, MURMUR_SEED = 0xC6A4A7935BD1E995, 47, 0x9747B28C
_WORD = 0xFFFFFFFFFFFFFFFF


def le32(n: Column) -> Column:
    """A number below 2**32 as four bytes, lowest first."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n.cast("bigint")), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))


def from_le(raw: Column) -> Column:
    """The number that up to seven bytes hold, lowest first."""
    digits = F.hex(raw)
    turned = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.octet_length(raw) - 1), lambda i: F.substring(digits, 2 * i + 1, F.lit(2)))), "")
    return F.when(F.octet_length(raw) > 0, F.conv(turned, 16, 10).cast("bigint"))


def record_bytes(key: Column, value: Column) -> Column:
    """A log record as bytes: checksum, both sizes, key and value; a null value is a tombstone."""
    size = F.coalesce(F.octet_length(value).cast("bigint"), F.lit(TOMBSTONE_SIZE))
    return F.concat(le32(record_crc(key, value)), le32(F.octet_length(key)), le32(size), key.cast("binary"), F.coalesce(value, F.lit("")).cast("binary"))


def parsed_record(raw: Column) -> Column:
    """``key``, ``value`` (null: a tombstone) and whether the stored checksum is right; null where the sizes do not fit."""
    part = lambda at, n: F.substring(raw, at, n)
    n_key, n_value = from_le(part(F.lit(5), F.lit(4))), from_le(part(F.lit(9), F.lit(4)))
    gone = n_value == TOMBSTONE_SIZE
    n = F.when(gone, F.lit(0)).otherwise(n_value)
    key = part(F.lit(13), n_key.cast("int")).cast("string")
    value = F.when(~gone, part((n_key + 13).cast("int"), n.cast("int")).cast("string"))
    fits = (F.octet_length(raw) >= 12) & (F.octet_length(raw) == 12 + n_key + n)
    return F.when(fits, F.struct(key.alias("key"), value.alias("value"), (from_le(part(F.lit(1), F.lit(4))) == record_crc(key, value)).alias("intact")))


def record_crc(key: Column, value: Column) -> Column:
    """CRC-32 of a log record: both sizes, then key and value; a null value is a tombstone."""
    size = F.coalesce(F.octet_length(value).cast("bigint"), F.lit(TOMBSTONE_SIZE))
    return F.crc32(F.concat(le32(F.octet_length(key)), le32(size), key.cast("binary"), F.coalesce(value, F.lit("")).cast("binary")))


def murmur64a(data: bytes, seed: int = MURMUR_SEED) -> int:
    """MurmurHash64A of one key."""
    h = seed ^ (len(data) * MURMUR_MULTIPLIER & _WORD)
    whole = len(data) - len(data) % 8
    for k in np.frombuffer(data[:whole], "<u8").tolist():
        k = k * MURMUR_MULTIPLIER & _WORD
        h = (h ^ ((k ^ (k >> MURMUR_SHIFT)) * MURMUR_MULTIPLIER & _WORD)) * MURMUR_MULTIPLIER & _WORD
    if rest := data[whole:]:
        h = (h ^ int.from_bytes(rest, "little")) * MURMUR_MULTIPLIER & _WORD
    h = (h ^ (h >> MURMUR_SHIFT)) * MURMUR_MULTIPLIER & _WORD
    return h ^ (h >> MURMUR_SHIFT)


def murmur64a_all(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(MurmurHash64A of each string as unsigned 64-bit numbers, whether it is there at all): all strings take a step together."""
    there = keys.notna().to_numpy()
    raw = [k.encode() if ok else b"" for k, ok in zip(keys, there, strict=True)]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    words = (size + 7) // 8
    flat = np.frombuffer(b"".join(r.ljust(8 * w, b"\x00") for r, w in zip(raw, words.tolist(), strict=True)), "<u8").astype(np.uint64)
    first = np.cumsum(words) - words
    m, shift = np.uint64(MURMUR_MULTIPLIER), np.uint64(MURMUR_SHIFT)
    h = np.uint64(MURMUR_SEED) ^ (size.astype(np.uint64) * m)
    order = np.argsort(-size, kind="stable")  # strings with more words first
    longest = (size // 8)[order]
    for step in range(int(longest[0]) if len(longest) else 0):
        at = order[: int(np.searchsorted(-longest, -step, "left"))]
        k = flat[first[at] + step] * m
        h[at] = (h[at] ^ ((k ^ (k >> shift)) * m)) * m
    tail = np.flatnonzero(size % 8)
    h[tail] = (h[tail] ^ flat[first[tail] + size[tail] // 8]) * m
    h = (h ^ (h >> shift)) * m
    return h ^ (h >> shift), there


@pandas_udf(LongType())
def murmur64a_udf(keys: pd.Series) -> pd.Series:
    """MurmurHash64A of a column of strings, as signed 64-bit numbers; null for null."""
    h, there = murmur64a_all(keys)
    return pd.Series(h.view(np.int64), dtype="Int64").where(pd.Series(there))


def bloom_bits(n: Column, p: float) -> Column:
    """Bits of a Bloom filter for ``n`` keys, before they are rounded up to bytes."""
    return F.ceil(-n * F.log(F.lit(p)) / F.pow(F.log(F.lit(2.0)), F.lit(2.0)))


def bloom_hashes(n: Column, p: float) -> Column:
    return F.ceil(bloom_bits(n, p) / n * F.log(F.lit(2.0)))


class BloomFilter:
    """A Bloom filter by double hashing: place i is (h1 + i * h2) mod m, h2 is h1 with its halves exchanged."""

    def __init__(self, n: int, p: float = 0.01) -> None:
        import math

        n = max(1, n)
        bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
        self.k, self.bytes = max(1, math.ceil(bits / n * math.log(2))), np.zeros((bits + 7) // 8, np.uint8)

    @classmethod
    def load(cls, k: int, raw: bytes) -> BloomFilter:
        out = cls(1)
        out.k, out.bytes = k, np.frombuffer(raw, np.uint8)
        return out

    def _places(self, keys: pd.Series) -> np.ndarray:
        h, _ = murmur64a_all(keys)
        turned = h >> np.uint64(32) | h << np.uint64(32)
        return (h[:, None] + np.arange(self.k, dtype=np.uint64) * turned[:, None]) % np.uint64(8 * len(self.bytes))

    def add_all(self, keys: pd.Series) -> None:
        at = self._places(keys).ravel()
        np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def add(self, key: str) -> None:
        self.add_all(pd.Series([key]))

    def may_contain(self, key: str) -> bool:
        at = self._places(pd.Series([key])).ravel()
        return bool((self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all())


def filter_rows(batches):
    """For ``mapInPandas`` over ``chunk, key``: a Bloom filter for each chunk of a batch, with the range of keys that it answers for."""
    for batch in batches:
        for chunk, rows in batch.groupby("chunk"):
            bloom = BloomFilter(len(rows))
            bloom.add_all(rows["key"])
            yield pd.DataFrame({"chunk": [chunk], "min_key": [rows["key"].min()], "max_key": [rows["key"].max()], "k": [bloom.k], "bits": [bloom.bytes.tobytes()]})
