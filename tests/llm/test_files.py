import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from driftlog.llm import token_store, warc
from driftlog.llm.queries import tokenizer_path
from driftlog.llm.token_store import Encoder, Shard, encode_levels, write_shard

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_cut_texts_have_the_ids_of_uncut_ones(library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "b.", "é", "　", "\xa0", "'s", "12", "\x1c", "​", "!", "foo", "<|endoftext|>", "\r\n", "\x85", "\U0001f600", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)] + ["", " ", "   ", "word " * 3000, "a <|endoftext|> b", "<|endoftext|>" * 9, "x <|endof text|>"]
    assert library("a <|endoftext|> b") == [64, 220, 50256, 275]
    encoder = Encoder(tokenizer_path(), 0, most=500)  # the cache is dropped now and then
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        ids, n = encoder(pa.array(some))
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [library(t) + [0] for t in some]


@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 5000])
def test_any_token_is_read_by_its_place(tmp_path, n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.4, rng.integers(0, 256, n), rng.integers(0, 2**32, n)).astype(np.uint32)
    starts = np.array([0, n // 3, n // 3, n // 2])
    with open(tmp_path / "s", "wb") as f:
        write_shard(f, np.array([5, 0, 7, 9]), np.array([False, True, False, False]), starts, ids)
    shard = Shard(str(tmp_path / "s"))
    assert shard.all().tolist() == ids.tolist()
    assert [shard.token(i) for i in (0, n // 2, n - 1)] == [ids[0], ids[n // 2], ids[n - 1]]
    assert [shard.token(i) for i in range(min(n, 600))] == ids[:600].tolist()
    assert shard.document(1) == [] and shard.document(3) == ids[n // 2 :].tolist() and shard.is_null.tolist() == [False, True, False, False]
    with pytest.raises(IndexError):
        shard.token(n)


def test_levels_hold_what_goes_on():
    (c0, b0, r0), (c1, b1, r1) = encode_levels(np.array([1, 300, 255, 65535], np.uint32))
    assert c0.tolist() == [1, 44, 255, 255] and c1.tolist() == [1, 255] and b0.tolist() == [0b1010] and r0.tolist() == [0, 2]


def test_documents_read_back(spark, library):
    rows = [(5, "five is here"), (None, "nobody"), (1, None), (3, "three"), (3, "three again"), (-2, "x" * 50_000), (4, "an end <|endoftext|> inside")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "0 AS start", "'t' AS tie")
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_tokens(token_store.write_tokens(docs, tokenizer_path(), shard_tokens=8)).collect()]
    want, at = {}, 0
    for i in (None, -2, 1, 3, 4, 5):
        for t in [t or "" for d, t in rows if d == i]:
            ids = library(t) + [0]
            want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for i, group in want.items():
        assert sorted((n, c) for d, _, n, c in got if d == i) == sorted(group)
    order = sorted(got, key=lambda r: r[1])
    for d, start, n, _ in order:
        assert start == at
        at += n
    assert [d for d, *_ in order] == [None, -2, 1, 3, 3, 4, 5]


def test_no_documents(spark):
    assert token_store.read_tokens(token_store.write_tokens(spark.createDataFrame([], DOCS), tokenizer_path())).count() == 0


PAGES = "page_id long, url string, html string"


def test_archives_read_back(spark):
    big, other = "<p>" + "é" * 700, "<p>" + "b" * 2000
    rows = [(1, "http://a", big), (2, None, big), (9, "http://c\r\nX: y", big), (4, "http://d", "small"), (5, "http://e", "small"), (6, "", None), (7, "http://g", other), (None, "http://h", other), (8, "http://i", ""), (9, "http://c", big)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS size", "'k' AS keep")
    archives = warc.normalise(warc.write_archives(pages))
    assert warc.drop_streams(archives) == archives.count()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(archives).collect())
    keep = {big: 9, other: 7}
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 1000 and i != keep[html]
        want.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keep[html] if again else None))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)


def test_a_record_is_reached_without_the_others(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}" * 50) for i in range(20)], PAGES).coalesce(1)
    archives = warc.normalise(warc.write_archives(pages, folder=f"file://{tmp_path}/w"))
    uri = archives.first()["archive"]
    index = warc.read_index(uri)
    assert len(index) == 20
    with warc.opened(f"{uri}.warc.gz") as f:
        head, _, payload = warc.parsed(warc.read_record(f, *index[13]))
    whole = gzip.decompress(open(uri.removeprefix("file://") + ".warc.gz", "rb").read())
    assert head["warc-record-id"] in whole.decode() and payload.startswith(b"page ")


def test_streams_of_any_cut():
    recs = [warc.record(i, f"http://x/{i}", bytes([65 + i % 26]) * (i * 997 % 5000), i * 997 % 5000, "00" * 20, None, "2024-01-01T00:00:00Z") for i in range(300)]
    whole = b"".join(recs)
    one = gzip.compress(whole)
    many = b"".join(gzip.compress(r) for r in recs)
    odd = gzip.compress(whole[:70_000]) + gzip.compress(whole[70_000:70_001]) + gzip.compress(whole[70_001:])
    for raw in (one, many, odd):
        assert list(warc.records(io.BytesIO(raw))) == recs
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(gzip.compress(whole[:-30]))))


def test_no_pages(spark):
    assert warc.read_archives(warc.normalise(warc.write_archives(spark.createDataFrame([], PAGES)))).count() == 0


def test_a_payload_of_many_pages_and_a_very_long_one(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_HOT", 3)  # more pages than that make a payload hot
    hot, few, long = "<h>" + "z" * 1500, "<f>" + "y" * 1500, "<l>" + "é" * 3_000_000
    rows = [(i, None, hot) for i in range(40)] + [(None, None, hot), (None, "http://n", hot), (39, "http://again", hot), (50, "u", few), (51, "u", few), (60, "u", long), (61, "u", long)]
    pages = spark.createDataFrame(rows, PAGES).repartition(4).selectExpr("*", "1 AS hot", "'k' AS key")
    archives = warc.normalise(warc.write_archives(pages))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in warc.read_archives(archives).collect())
    want = []
    for i, _, html in rows:
        b, keep = html.encode(), {hot: 39, few: 51, long: 61}[html]
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), *(("response", "None") if i == keep else ("revisit", str(keep)))))
    assert got == sorted(want)
