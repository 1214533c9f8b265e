import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlog.llm import files, words


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=8), max_size=20), st.integers(0, 3))
def test_hashes_of_bytes_tell_strings_apart(texts, skip):
    array = pa.array(["pad"] * skip + texts, pa.string()).slice(skip)
    got = words.hash_bytes(array, 0x2545F4914F6CDD1D).tolist()
    by_text = dict(zip(texts, got, strict=True))
    assert got == [by_text[t] for t in texts] and len(set(by_text.values())) == len(by_text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\tç", max_size=15), max_size=8), st.integers(1, 5))
def test_shingle_sets_match_their_definition(texts, width):
    sets, counts = words.shingle_sets(pa.array(texts, pa.string()), width)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        w = t.translate({66: 98}).split(" ")
        w = [x for part in w for x in part.replace("\n", " ").replace("\t", " ").split(" ") if x]
        want = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
        assert n == len(want)
        assert (np.diff(sets[at : at + n].astype(object)) > 0).all()
        at += n


def test_the_order_of_words_matters():
    sets, counts = words.shingle_sets(pa.array(["a b b a", "b a a b", "a b", "a b a"], pa.string()), 4)
    assert counts.tolist() == [1, 1, 1, 1] and len(set(sets.tolist())) == 4


def test_a_file_appears_when_it_is_whole(tmp_path):
    uri = f"file://{tmp_path}/deep/file"
    with pytest.raises(RuntimeError), files.whole_file(uri) as out:
        out.write(b"half")
        raise RuntimeError
    assert list((tmp_path / "deep").iterdir()) == []
    for text in (b"one", b"two"):  # written again, as by a task that runs again
        with files.whole_file(uri) as out:
            out.write(text)
    with files.opened(uri) as f:
        assert f.read() == b"two"


def test_joins_on_hot_keys_lose_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    from driftlog.llm import shared

    monkeypatch.setattr(shared, "LEAST_HOT", 5)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("v"))
    right = shared.written(left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most")).where("k <> 5"), "right")
    got = sorted(map(tuple, shared.spread_join(left, right, ["k"], "n").select("k", "v", "most").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "v", "most").collect())) and len(got) > 900
    none = right.where("k = 123456")
    assert shared.spread_join(left, shared.written(none, "none"), ["k"], "n").count() == 0


def test_tables_of_a_computation_go_together(spark):
    from driftlog.llm import shared

    scratch = shared.Scratch(spark)
    frame = scratch.written(spark.range(5), "some")
    paths = list(scratch.paths)
    assert frame.count() == 5 and len(paths) == 1
    scratch.drop()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) and scratch.paths == []
    assert shared.own_name("A", frame.selectExpr("id AS a", "id AS A_")) == "A__"
