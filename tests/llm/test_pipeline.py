"""The pipeline against a plain version of what each stage decides, on its own input."""

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from driftlog.llm import decontaminate, mixing
from driftlog.llm.queries import TARGETS, tokenizer_path
from driftlog.llm.shared import read
from tests.llm.test_dedup import Union, shingle_set, words_of


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "leaks", "mixture", "tokens"]
    docs = read(spark, sf_dir, "documents").unionByName(spark.createDataFrame([(-1, "12 34", None, "s", 5), (-2, None, "en", "s", None)], read(spark, sf_dir, "documents").schema))
    docs.write.parquet(f"{tmp_path}/in")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = spark.read.parquet(f"{tmp_path}/{'in' if not kept else list(kept)[-1]}")
        out = stage(spark, before, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert kept[name].columns == docs.columns
    ids = lambda frame: [r["doc_id"] for r in frame.orderBy("doc_id").collect()]
    rows = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}

    start = rows(docs)
    assert set(ids(kept["language"])) == {i for i, t in start.items() if any(c.isalpha() for c in t or "")}

    texts, groups = rows(kept["language"]), Union()
    sets = {i: shingle_set(words_of(t), 5) for i, t in texts.items()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    assert ids(kept["near_copies"]) == sorted(i for i in sets if groups.find(i) == i)

    leaky = {r["doc_id"] for r in decontaminate.find_leaks(kept["near_copies"], read(spark, sf_dir, "benchmark")).collect()}
    assert leaky and ids(kept["leaks"]) == sorted(set(ids(kept["near_copies"])) - leaky)

    rates = {r["doc_id"]: r["rate"] for r in mixing.mix(kept["leaks"], read(spark, sf_dir, "labels"), TARGETS).collect()}
    times = collections.Counter(ids(kept["mixture"]))
    assert all(int(r) <= times[i] <= int(np.ceil(r)) for i, r in rates.items()) and set(times) <= set(rates)

    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, text in sorted((r["doc_id"], r["text"]) for r in kept["mixture"].collect()):
        tokens = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        at += len(tokens)
    assert [tuple(r) for r in kept["tokens"].orderBy("start").collect()] == want


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    n, total = out.agg(F.count("*"), F.sum("n_tokens")).first()
    last = out.orderBy(F.desc("start")).first()
    assert n > 100 and last["start"] + last["n_tokens"] == total


def test_empty_tables_run(spark, sf_dir, tmp_path):
    for empty in ("documents", "benchmark", "labels"):
        for name in ("documents", "benchmark", "labels"):
            frame = read(spark, sf_dir, name)
            (frame.limit(0) if name == empty else frame.where("item_id < 5") if name == "benchmark" else frame.where("doc_id < 40")).write.parquet(f"{tmp_path}/{empty}/{name}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{empty}")
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (out.count() > 0) == (empty != "documents")
