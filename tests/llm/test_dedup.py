import collections
import hashlib
import random
import re

import numpy as np
import pytest

from driftlog.llm import exact_dedup, jaccard_join, paragraph_dedup
from driftlog.llm.components import components
from driftlog.llm.words import U

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^ \t-\r]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def words_of(t):
    return WORD.findall(lower(t or ""))


def shingle_set(words, width):
    return {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()


class Union:
    def __init__(self):
        self.root = {}

    def find(self, x):
        while self.root.setdefault(x, x) != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def corpus(seed, n=160, vocabulary=400):
    """Texts of all lengths, with copies, near copies of every degree, and passages that unlike texts share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    fresh = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, base, rows = fresh(60), fresh(150), []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and rows:
            w = words_of(rng.choice(rows)[1])
        elif kind <= 2 and rows:
            w = list(words_of(rng.choice(rows)[1]))
            for _ in range(rng.randrange(1, 5)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 3:
            w = list(base)
            for _ in range(rng.randrange(12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 4:
            w = fresh(rng.randrange(40)) + passage + fresh(rng.randrange(40))
        else:
            w = fresh(rng.choice([1, 2, 3, 4, 5, 6, 7, 12, 30, 90, 300]))
        rows.append((i, (" " if rng.random() < 0.8 else "\n").join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "é ß"), (n + 4, "É ß")]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 90)])
def test_join_groups_match_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    sets, groups, links = {i: shingle_set(words_of(t), width) for i, t in rows}, Union(), collections.Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
                links.update((a, b))
    docs = spark.createDataFrame(rows, DOCS).repartition(4).selectExpr("*", "1 AS node", "2 AS n", "'x' AS label")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join_groups(docs, width, percent).collect()}
    assert got == {i: (len(s), groups.find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("percent", "sizes"), [(85, [(15, 17), (30, 35), (60, 70), (127, 149), (28, 32), (64, 75)]), (80, [(28, 35), (120, 150), (15, 18), (13, 16), (52, 65)])])
def test_no_link_across_size_bands_is_lost(spark, percent, sizes):
    """Pairs whose sizes stand on both sides of a power of two: one the head of the other, or parted by cuts in its middle."""
    rng, rows = random.Random(percent), []
    for small, large in sizes:
        for k in range(300):
            w = [f"v{rng.randrange(10**9)}" for _ in range(large + 3)]
            cut = large - small
            other = w[:-cut] if k % 2 else w[cut:]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    got = jaccard_join.join_groups(spark.createDataFrame(rows, DOCS).repartition(8), 4, percent)
    assert got.where("n_links <> 1 OR component_id <> doc_id - doc_id % 2").count() == 0


def test_dense_and_sparse_verification_agree():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300).astype(U)
    rows = []
    for i in range(90):
        own = rng.integers(0, 2**63, int(rng.integers(0, 50))).astype(U)
        s = np.unique(np.concatenate([base[int(rng.integers(0, 30)) : int(rng.integers(270, 300))], own])) if i % 3 else np.unique(own)
        if len(s):
            rows.append((i, 1 + i % 4, s.tobytes()))
    rows += rows[:3]  # a class that is given twice counts once
    for a, b in ((jaccard_join.Block(rows), None), (jaccard_join.Block(rows[:40]), jaccard_join.Block(rows[40:87]))):
        other = b or a
        want = np.array([[100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) for y in other.sets] for x in a.sets])
        if b is None:
            np.fill_diagonal(want, False)
        assert (jaccard_join.linked_pairs(a, other, 85) == want).all() and want.any()
        assert (jaccard_join._common(a.sets, other.sets) == [[len(np.intersect1d(x, y)) for y in other.sets] for x in a.sets]).all()
        got = {r["node"]: r["links"] for r in jaccard_join.pair_links(a, other, 85).to_pylist()}
        assert got == {int(n): int(want[i] @ other.copies) for i, n in enumerate(a.nodes) if want[i].any()} | ({} if b is None else {int(n): int(a.copies @ want[:, j]) for j, n in enumerate(b.nodes) if want[:, j].any()})


def test_a_lost_file_of_shared_keys_is_an_error(tmp_path):
    (tmp_path / "part-1").write_bytes(b"")
    assert len(jaccard_join._shared_keys(str(tmp_path), 1)[0]) == 1
    with pytest.raises(FileNotFoundError):
        jaccard_join._shared_keys(str(tmp_path), 2)


def test_very_long_texts_join(spark):
    rng = random.Random(8)
    w = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-500])), (3, " ".join(w[:30_000])), (4, " ".join(reversed(w)))]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.join_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_small_blocks_find_the_same_links(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, DOCS)
    whole = sorted(map(tuple, jaccard_join.join_groups(docs).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 3)
    assert sorted(map(tuple, jaccard_join.join_groups(docs).collect())) == whole
    monkeypatch.setattr(jaccard_join, "MANY_BLOCKS", 2)
    monkeypatch.setattr(jaccard_join, "MOST_BLOCK_DOCS", 5)
    assert sorted(map(tuple, jaccard_join.join_groups(docs).collect())) == whole


def test_joining_with_repeated_and_null_ids(spark):
    same = "a b c d e f g"
    rows = [(7, same), (7, same), (3, same), (None, same), (7, "other words stand here now"), (None, "nobody has this text at all")]
    got = sorted(map(str, jaccard_join.join_groups(spark.createDataFrame(rows, DOCS)).collect()))
    want = [(7, 4, 3, 3), (7, 4, 3, 3), (3, 4, 3, 3), (None, 4, 3, 3), (7, 2, 7, 0), (None, 3, None, 0)]
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c}, n_links={d})" for a, b, c, d in want)
    assert jaccard_join.join_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_cells_bound_the_symmetric_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(6, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(U))
        b = np.unique(np.concatenate([a[rng.integers(0, 5) :], rng.integers(0, 2**63, rng.integers(0, 9)).astype(U)]))
        k = jaccard_join.n_cells(max(len(a), len(b)).bit_length() - 1, 85)
        differ = int((jaccard_join._cells(a, k) != jaccard_join._cells(b, k)).sum())
        assert differ <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_more_cells_than_linked_sets_can_differ_in(percent):
    for band in range(15):
        top = 2 ** (band + 1) - 1
        assert jaccard_join.n_cells(band, percent) > jaccard_join.most_apart(2 * top, percent)
        for n in range(2**band, min(top, 2**band + 300) + 1):  # the prefix never needs more cells than there are
            assert jaccard_join.most_apart(n + min(100 * n // percent, top), percent) < jaccard_join.n_cells(band, percent)
            # partners may be of the next band, where 100 * n // percent is the largest of them
            assert jaccard_join.largest_prefix(n, percent) > jaccard_join.most_apart(n + 100 * n // percent, percent)
            assert jaccard_join.largest_prefix(n, percent) < jaccard_join.n_cells(band, percent)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", 9), (2, "a b c d e f", 9), (2, "a b c d e f", 9), (5, "x y z q r s", 9), (5, "x y z q r s", 9), (None, "n n n n n", 9)]
    docs = spark.createDataFrame(rows, DOCS + ", component_id long")
    kept = jaccard_join.one_of_each(docs, jaccard_join.join_groups(docs))
    assert kept.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "5", "None"]


def test_unlike_texts_of_one_id_stay(spark):
    a, b, c = "a b c d e f", "p q r s t u", "k l m n o p"
    rows = [(5, a), (5, a), (5, b), (7, b), (7, c), (5, a + " "), (8, "g h i j k l"), (8, "z y x w v u"), (None, a)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", near_id int, NEAR_HASH int, h int")
    kept = jaccard_join.one_of_each(docs, jaccard_join.join_groups(docs, texts=True))
    assert kept.columns == docs.columns
    kept = [tuple(r)[:2] for r in kept.collect()]
    assert sorted((str(i), t.strip()) for i, t in kept) == sorted([("5", a), ("5", b), ("7", c), ("8", rows[6][1]), ("8", rows[7][1]), ("None", a)])


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rng, groups = random.Random(seed), Union()
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(250)] + [(5, 5), (-3, 2000), (None, 4)]
    for a, b in edges:
        if a is not None and a != b:
            groups.join(a, b)
    got = collections.defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r["label"]].add(r["node"])
    want = collections.defaultdict(set)
    for x in list(groups.root):
        want[groups.find(x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", " ", "same text", "same  text ", "same\ttext\n\n", "é b", "eb", "x" * 30_000, "x " * 30_000, f"own {i}"])) for i in range(300)] + [(400, None), (None, "same text, but more of it"), (7, "sametext")]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for norm, v in groups.items():
        v.sort()
        want += [(i, v[0][3], len(v), hashlib.sha256(norm.encode()).hexdigest()) for *_, i in v]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", "0 AS less", "1 AS size", "true AS head")
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got))) == sorted(map(str, want))
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_a_group_over_all_partitions_is_stitched(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 0 THEN concat('t', id) ELSE 'one  text' END AS text").repartition(8)
    got = exact_dedup.exact_groups(docs).where("group_size > 1").agg({"group_size": "max", "keep_id": "max", "kept": "count"}).first()
    assert got["max(group_size)"] == 3920 and got["max(keep_id)"] == 1
    assert exact_dedup.exact_groups(docs).where("kept").count() == 81


def paragraph_expectation(rows, width, percent, least):
    paras, groups = [], Union()
    for i, t in rows:
        at = 0
        for line in (t or "").split("\n"):
            w = words_of(line)
            if len(w) >= least:
                paras.append((i, at, len(w), shingle_set(w, width)))
            at += len(w)
    for a in range(len(paras)):
        groups.find(a)
        for b in range(a):
            x = len(paras[a][3] & paras[b][3])
            if 100 * x >= percent * len(paras[a][3] | paras[b][3]):
                groups.join(a, b)
    by = collections.defaultdict(list)
    for a in range(len(paras)):
        by[groups.find(a)].append(paras[a][:3])
    out = set()
    for v in by.values():
        if len({x[0] for x in v}) > 1:
            v.sort()
            out |= {(i, "paragraph", at, at + n - 1, v[0][0], j > 0) for j, (i, at, n) in enumerate(v)}
    return out


def test_paragraphs_match_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    lines = [[rng.choice(vocab) for _ in range(rng.choice([5, 26, 40, 80]))] for _ in range(40)]
    rows = []
    for i in range(80):
        text = []
        for line in rng.sample(lines, 3):
            w = list(line)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "\n\n")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 AS words", "2 AS keep")
    got = {tuple(r) for r in paragraph_dedup.repeated_paragraphs(docs, least_words=25, blocks=False).collect()}
    assert got == paragraph_expectation(rows, 5, 80, 25)


def test_short_lines_and_wrapped_paragraphs_are_found(spark):
    rng = random.Random(3)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    wrapped, short, tiny = fresh(96), " ".join(fresh(9)), "so it goes"
    wrap = lambda w, k: "\n".join(" ".join(w[i : i + k]) for i in range(0, len(w), k))
    near = ["other" if i in (5, 50) else w for i, w in enumerate(wrapped)]
    rows = [
        (1, wrap(wrapped, 12) + "\n\n" + " ".join(fresh(40))),
        (2, " ".join(fresh(7)) + "\n\n" + wrap(near, 11)),
        (3, short + "\n" + " ".join(fresh(30))),
        (4, " ".join(fresh(20)) + "\n" + short + "\n\n" + tiny),
        (5, tiny + "\n" + " ".join(fresh(12)) + "\n\n" + " ".join(fresh(3))),
        (6, ""),
        (7, "\n \n"),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = {tuple(r) for r in paragraph_dedup.repeated_spans(docs).where("kind = 'paragraph'").collect()}
    want = {(1, 0, 95, 1, False), (2, 7, 102, 1, True), (3, 0, 8, 3, False), (4, 20, 28, 3, True), (4, 29, 31, 4, False), (5, 0, 2, 4, False)}
    assert got == {(d, "paragraph", *x) for d, *x in want}


def test_passages_inside_lines_are_found(spark):
    rng = random.Random(2)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    passage, rows = fresh(51), []
    for i in range(30):
        rows.append((i, " ".join(fresh(rng.randrange(200)) + (passage if i % 3 == 0 else []) + fresh(rng.randrange(200)))))
    rows += [(50, " ".join(passage)), (51, " ".join(fresh(500))), (51, rows[1][1]), (60, None), (None, " ".join(passage))]
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    texts = dict(rows[:31])
    assert {r["doc_id"] for r in got} == {*range(0, 30, 3), 50, 1, 51}
    for r in got:
        if r["doc_id"] in texts and r["doc_id"] != 1:
            span = words_of(texts[r["doc_id"]])[r["first_word"] : r["last_word"] + 1]
            assert set(span) <= set(passage) and len(span) >= 30
            assert r["removed"] == (r["doc_id"] != 0) and r["keep_id"] == 0
            if r["removed"]:  # from end to end
                assert span == passage
    assert paragraph_dedup.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("width", "window"), [(3, 4), (30, 20), (2, 1)])
def test_every_shared_stretch_shares_a_selected_run(width, window):
    rng = np.random.default_rng(width)
    shared = rng.integers(0, 2**63, width + window - 1).astype(U)
    chosen = []
    for before, after in ((0, 0), (7, 3), (0, 50), (33, 0)):
        other = [rng.integers(0, 2**63, n).astype(U) for n in (before, after, 5)]
        flat = np.concatenate([other[0], shared, other[1], other[2]])
        run, _ = paragraph_dedup.select_runs(flat, np.array([len(flat) - 5, 5]), width, window)
        chosen.append(set(run.tolist()))
    assert set.intersection(*chosen)
