"""WARC archives: pages to records, a normaliser of monolithic gzip files, and reading by offset index.

``write_archives`` writes each partition's records as one gzip stream, as many crawls arrive. No record of
such a file can be reached without inflating all that stands before it. ``normalise`` inflates a file once,
as a stream, writes every record as a gzip member of its own and a sidecar index of (offset, length), and
removes the stream. ``read_archives`` reads records by that index.

Of records with equal payloads of at least ``revisit_bytes`` bytes, that with the largest page id is the
response and the others are revisit records, which carry the digest and the length of the payload but not
its bytes, and refer to the response.

Defined results: null html is an empty payload; null url is written as ``urn:page:<id>``; a null page id
never outranks another; rows that repeat the id of a response are responses too; control characters in a
url are percent-encoded; other columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.files import opened, remove, whole_file
from driftlog.llm.shared import LEAST_HOT, MOST_HOT, arrow_batches, new_path, one_per_task, tidy, written, written_one

_INDEX = struct.Struct("<QQ")
_STEP = 1 << 20


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record; ``refers_to`` makes it a revisit without payload bytes."""
    name = f"urn:page:{page_id}"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; header names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("latin-1").split("\r\n")[1:]), payload


def _page(urn: str) -> int | None:
    page = urn.strip("<>").rpartition(":")[2]
    return None if page == "None" else int(page)


# ---------------------------------------------------------------- writing


def _write(folder: str, date: str, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uri, n = f"{folder}/part-{TaskContext.get().partitionId():07d}", 0
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    with whole_file(f"{uri}.stream.gz") as out:
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        while first is not None:
            for row in zip(*(first.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha1", "refers_to")), strict=True):
                out.write(squeeze.compress(record(*row, date)))
                n += 1
            first = next(batches, None)
        out.write(squeeze.flush())
    yield pa.record_batch([pa.array([uri]), pa.array([n])], ["archive", "n"])


def write_archives(pages: DataFrame, revisit_bytes: int = 1000, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Monolithic gzip archives, one per partition; returns (``archive``, ``n`` records) for each."""
    arrow_batches(pages.sparkSession)
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    # partial sums before the shuffle: a payload that many pages share arrives as one row from each task
    shared = p.where(F.col("size") >= revisit_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("sha1", "size", "keep", "n"), "shared-payloads")
    # payloads of many pages are broadcast, MOST_HOT at most as their pages add up; their pages are spread over the shuffle by page
    limit = max(LEAST_HOT, (shared.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(shared.where(F.col("n") > limit).select("sha1", "size", F.col("keep").alias("hot_keep"), F.lit(True).alias("hot")))
    cold = shared.where(F.col("n") <= limit).select(F.concat_ws("-", "sha1", "size").alias("key"), "keep")
    p = p.join(hot, ["sha1", "size"], "left")
    gone = F.col("hot") & ~F.col("page_id").eqNullSafe(F.col("hot_keep"))
    p = p.withColumn("payload", F.when(gone, F.lit(b"")).otherwise(F.col("payload"))).withColumn("key", F.when(F.col("hot"), F.concat(F.lit("page "), F.coalesce(F.col("page_id"), F.xxhash64("url")).cast("string"))).otherwise(F.concat_ws("-", "sha1", "size")))
    p = p.join(cold, "key", "left").withColumn("keep", F.coalesce("hot_keep", "keep"))
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    p = p.select("page_id", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "sha1", F.when(again, F.col("keep")).alias("refers_to"))
    return written_one(p.mapInArrow(tidy(_write, folder or new_path(pages.sparkSession, "warc"), date, level), "archive string, n long"), "warc-streams")


# ---------------------------------------------------------------- normalising


class _Stream:
    """Bytes of a gzip file of any number of members, inflated as they are asked for."""

    def __init__(self, file) -> None:
        self.file, self.inflate, self.held, self.at = file, zlib.decompressobj(31), bytearray(), 0

    def _more(self) -> bool:
        if self.at > _STEP:
            del self.held[: self.at]
            self.at = 0
        raw = self.inflate.unused_data if self.inflate.eof else b""
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        raw = raw or self.inflate.unconsumed_tail or self.file.read(_STEP)
        if not raw:
            return False
        self.held += self.inflate.decompress(raw, _STEP)
        return True

    def until(self, mark: bytes) -> int:
        """Place after ``mark``, from the current one; -1 at the end of the file."""
        start = 0
        while (i := self.held.find(mark, self.at + start)) < 0:
            start = max(0, len(self.held) - self.at - len(mark))
            if not self._more():
                return -1
        return i + len(mark) - self.at

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._more():
                raise EOFError("archive ends inside a record")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out


def records(file) -> Iterator[bytes]:
    """The records of a gzip file, whichever way it is cut into members."""
    stream = _Stream(file)
    while (n := stream.until(b"\r\n\r\n")) >= 0:
        head = stream.take(n)
        length = int(re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)[1])
        yield head + stream.take(length + 4)


def _normalise(level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column("archive").to_pylist():
            at, index, n = 0, bytearray(), 0
            with whole_file(f"{uri}.warc.gz") as out, opened(f"{uri}.stream.gz") as file:
                for raw in records(file):
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(raw) + squeeze.flush()
                    out.write(member)
                    index += _INDEX.pack(at, len(member))
                    at, n = at + len(member), n + 1
            with whole_file(f"{uri}.idx") as out:
                out.write(index)
            yield pa.record_batch([pa.array([uri]), pa.array([n])], ["archive", "n"])


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Rewrite monolithic archives as one member per record, with sidecar indexes."""
    tasks = one_per_task(archives, archives.count())
    return written_one(tasks.mapInArrow(tidy(_normalise, level), "archive string, n long"), "warc-archives")


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column("archive").to_pylist():
            try:
                remove(f"{uri}.stream.gz")
            except FileNotFoundError:  # a task that runs again
                pass
        yield b.select(["archive"])


def drop_streams(archives: DataFrame) -> int:
    """Remove the monolithic files of archives that are normalised; returns how many archives there are."""
    return archives.mapInArrow(tidy(_remover), "archive string").count()


# ---------------------------------------------------------------- reading


def read_index(uri: str) -> list[tuple[int, int]]:
    with opened(f"{uri}.idx") as file:
        return list(_INDEX.iter_unpack(file.read()))


def read_record(file, offset: int, length: int) -> bytes:
    """One record by its place, without touching any other."""
    file.seek(offset)
    return zlib.decompress(file.read(length), 31)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    made: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)
        made.clear()
        return out

    for b in batches:
        for uri in b.column("archive").to_pylist():
            with opened(f"{uri}.warc.gz") as file:
                for offset, length in read_index(uri):
                    warc, http, payload = parsed(read_record(file, offset, length))
                    revisit = warc["warc-type"] == "revisit"
                    # a revisit holds no payload: its headers state the length and the digest of the whole one
                    size = int(http["content-length"]) if revisit else len(payload)
                    sha1 = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
                    made.append((_page(warc["warc-record-id"]), warc["warc-target-uri"], size, sha1, warc["warc-type"], _page(warc["warc-refers-to"]) if revisit else None, uri, offset))
                    if len(made) >= 20_000:
                        yield flush()
    if made:
        yield flush()


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of normalised archives, read by the index."""
    tasks = one_per_task(archives.select("archive"), archives.count())
    return tasks.mapInArrow(tidy(_reader), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")
