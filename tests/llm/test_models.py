import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlog.llm import decontaminate, langid, mixing
from driftlog.llm.queries import TARGETS
from driftlog.llm.shared import read

DOCS = "doc_id long, text string"


# ---------------------------------------------------------------- decontamination


def test_masks_hit_any_two_substitutions():
    for wrong in itertools.combinations(range(decontaminate.LEAST_WORDS), 2):
        assert any(all(s + m not in wrong for m in mask) for mask in decontaminate.MASKS for s in range(decontaminate.LEAST_WORDS - mask[-1]))


def brute_leaks(docs, items):
    """Best stretch of every alignment of every item on every text."""
    plain = lambda t: [w for w in (decontaminate._OTHER.sub("", x.lower()) for x in (t or "").split()) if w]
    out = {}
    for (r, (d, t)), (i, b) in itertools.product(enumerate(docs), items):
        w, q = plain(t), plain(b)
        for shift in range(-len(q) + 1, len(w)):
            pairs = [(w[shift + k] == q[k], shift + k) for k in range(len(q)) if 0 <= shift + k < len(w)]
            best = (0, 0)
            for a in range(len(pairs)):
                score = 0
                for e in range(a, len(pairs)):
                    score += 1 if pairs[e][0] else -4
                    best = max(best, (score, -a, e + 1), key=lambda x: x[:1])
            if best[0] > 0 and best[2] + best[1] >= min(13, len(q)):
                a, e = -best[1], best[2]
                got = (e - a, -pairs[a][1], sum(x for x, _ in pairs[a:e]))
                out[r, d, i] = max(out.get((r, d, i), got), got)
    return {(d, i, m, n) for (_, d, i), (n, _, m) in out.items()}


def test_leaks_match_brute_force(spark):
    rng = random.Random(1)
    fresh = lambda k: [f"u{rng.randrange(10**6)}" for _ in range(k)]
    items = [(i, " ".join(fresh(n))) for i, n in enumerate([14, 25, 40, 59])] + [(10, None), (11, "..."), (12, "Short, one here!")]
    docs = []
    for d in range(40):
        item = rng.choice(items[:4])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            item[rng.randrange(len(item))] = "changed"
        if d % 5 == 0:
            item = item[: rng.choice([6, 13, 14])]
        body = fresh(rng.randrange(30)) + ([x.capitalize() + "," for x in item] if d % 2 else []) + fresh(rng.randrange(30))
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "a short one here of all"), (1, docs[1][1]), (None, docs[3][1])]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "5 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(frame, bench).collect()
    want = brute_leaks(docs, [i for i in items if i[1] and len(i[1].split()) >= 8])
    found = {(r["doc_id"], r["item_id"], r["matched"], r["overlap"]) for r in got}
    certain = {x for x in want if x[2] >= x[3] - 2}
    assert certain <= found <= want and len(certain) > 10
    leaky = {r["doc_id"] for r in got}
    kept = decontaminate.without_leaks(frame, bench)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - leaky


def test_blocks_of_items_find_the_same(spark, monkeypatch, sf_dir):
    docs, bench = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole and whole
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize(("same", "want"), [("1111", (0, 4)), ("0110", (1, 3)), ("1110111111", (4, 10)), ("111111011111", (0, 12))])
def test_best_stretches(same, want):
    assert decontaminate.best_stretch(np.array([c == "1" for c in same])) == want


def test_no_stretch_without_a_match():
    start, end = decontaminate.best_stretch(np.zeros(4, bool))
    assert start == end


def test_short_items_must_be_there_whole(spark):
    docs = [(1, "x Some words, in a ROW y"), (2, "some words in one row"), (3, "five words here stand not whole: some words in a"), (4, "so it goes"), (5, None)]
    items = spark.createDataFrame([(1, "some words in a row"), (2, "so it goes"), (3, ""), (4, None)], "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS)
    found = lambda n: {(r["doc_id"], r["item_id"], r["first_word"], r["last_word"]) for r in decontaminate.find_leaks(frame, items, trimmed=False, least_item=n).collect()}
    assert found(8) == set() and found(5) == {(1, 1, 1, 5)} and found(1) == {(1, 1, 1, 5), (4, 2, 0, 2)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(frame, items, least_item=5).collect()} == {2, 3, 4, 5}


def test_a_phrase_of_many_items_and_very_long_texts(spark, monkeypatch):
    rng = random.Random(6)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    phrase = fresh(9)
    items = [(i, " ".join(fresh(8) + phrase + fresh(8))) for i in range(300)]
    text = []
    for _ in range(400):
        text += fresh(90) + phrase
    docs = [(1, " ".join(text)), (2, " ".join(text + items[7][1].split() + text + items[7][1].split()))]  # two equal overlaps: the first is told
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = [(2, 7, 25, 25, 25, len(text), len(text) + 24)]
    assert [tuple(r) for r in decontaminate.find_leaks(frame, bench, trimmed=False).collect()] == want
    monkeypatch.setattr(decontaminate, "PORTION", 5000)
    held = decontaminate.Seeds([i for i, _ in items], [t for _, t in items], 8)
    got = decontaminate._overlaps(held, False, pa.array([t for _, t in docs]))
    assert {k: v[0] for k, v in got.items()} == {(1, 7): 25}


def test_a_substitution_anywhere_leaves_a_leak(spark):
    rng = random.Random(5)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    items = {n: fresh(n) for n in (7, 8, 9, 10, 11, 12, 13, 15, 20)}
    docs, want = [], set()
    for n, item in items.items():
        for k in range(4):
            for wrong in itertools.combinations(range(n), k):
                if k == 3 and rng.random() > 0.05:
                    continue
                same = [i not in wrong for i in range(n)]
                w = min(13, n)
                if n >= 8 and any(5 * sum(same[a : a + w]) >= 4 * w for a in range(n - w + 1)):
                    want.add((len(docs), n))
                docs.append((len(docs), " ".join(fresh(rng.randrange(9)) + [w if s else "other" for w, s in zip(item, same, strict=True)] + fresh(rng.randrange(9)))))
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = decontaminate.find_leaks(frame, bench, trimmed=False).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) < len(docs)
    assert all(5 * r["matched"] >= 4 * r["overlap"] and r["overlap"] >= min(13, r["item_words"]) for r in got)
    kept = {r["doc_id"] for r in decontaminate.without_leaks(frame, bench, trimmed=False).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


# ---------------------------------------------------------------- languages


def plain_viterbi(scores, penalty):
    best = [(scores[0][k], [k]) for k in range(len(scores[0]))]
    for e in scores[1:]:
        best = [max(((s - penalty * (p[-1] != k) + e[k], p + [k]) for s, p in best), key=lambda x: x[0]) for k in range(len(e))]
    return max(best, key=lambda x: x[0])


@pytest.mark.parametrize("languages", [1, 2, 5])
def test_viterbi_finds_a_best_path(languages):
    rng = np.random.default_rng(languages)
    counts = np.array([0, 1, 30, 7, 0, 12, 2])
    scores = -rng.exponential(3, (int(counts.sum()), languages)).astype(np.float32)
    labels, at = langid.viterbi(scores, counts, 4.0), 0
    for n in counts:
        if n:
            e, got = scores[at : at + n].astype(float), labels[at : at + n]
            score = sum(e[i][got[i]] for i in range(n)) - 4.0 * int((got[1:] != got[:-1]).sum())
            assert score == pytest.approx(plain_viterbi(e.tolist(), 4.0)[0], abs=1e-3)
        at += n


@pytest.mark.parametrize("most", [3, 40, 100])
def test_viterbi_in_stretches_is_the_same(monkeypatch, most):
    rng = np.random.default_rng(most)
    counts = rng.integers(0, 40, 30)
    scores = -rng.exponential(3, (int(counts.sum()), 5)).astype(np.float32)
    whole = langid.viterbi(scores, counts, 4.0)
    monkeypatch.setattr(langid, "MOST_BACK", most)
    assert (langid.viterbi(scores, counts, 4.0) == whole).all()


def test_more_languages_than_a_byte_holds(spark):
    rows = [(i * 3 + j, f"w{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 20, f"l{i:03}") for i in range(300) for j in range(3)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 300
    got = {r["doc_id"]: r["lang_pred"] for r in langid.label(docs, model).collect()}
    assert sum(got[i] == x for i, _, x in rows) > 890


def test_equally_many_letters_give_the_first_language(spark):
    rows = [(i, x * 12, n) for i, (x, n) in enumerate([("αβγ ", "zz"), ("абв ", "aa")] * 10)]
    model = langid.learn(spark.createDataFrame(rows, DOCS + ", lang string"))
    got = langid.label(spark.createDataFrame([(1, "αβγ αβγ αβγ абв абв абв")], DOCS), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("aa", 0.5)]


def test_words_of_several_scripts():
    w = langid.read_words(pa.array(["Привет, world!", "12 ++", "", "漢字 ελλάδα"]))
    assert w.counts.tolist() == [2, 0, 0, 2] and [langid.NAMES[s] for s in w.script[w.place]] == ["cyrillic", "latin", "han", "greek"]


def test_scripts_narrow_candidates_and_spans_split_mixed_texts(spark):
    rng = random.Random(0)
    make = lambda alphabet, k: " ".join("".join(rng.choice(alphabet) for _ in range(6)) for _ in range(k))
    letters = {"aa": "abcde", "bb": "fghij", "cc": "абвгд"}
    rows = [(i, make(letters[x], 30), x) for i, x in enumerate([*letters] * 40)]
    model = langid.learn(spark.createDataFrame(rows, DOCS + ", lang string"))
    assert model.languages == ["aa", "bb", "cc"] and not model.uses[langid.NAMES.index("cyrillic")][:2].any()
    tests = [(1, make("abcde", 10) + " " + make("fghij", 20)), (2, "абв"), (3, None), (4, "123 ..."), (5, ""), (None, "fghij"), (6, "漢字"), (6, "abc " * 40_000)]
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 3), [tuple(s) for s in r["spans"]][:3]) for r in langid.label(spark.createDataFrame(tests, DOCS).selectExpr("*", "1 AS score"), model).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "bb", 0.667, [("aa", 0, 9), ("bb", 10, 29)]), (2, "cc", 1.0, [("cc", 0, 0)]), (3, "und", 0.0, []), (4, "und", 0.0, []), (5, "und", 0.0, []), (None, "bb", 1.0, [("bb", 0, 0)]), (6, "aa", 1.0, [("aa", 0, 0)]), (6, "aa", 1.0, [("aa", 0, 39_999)])],
        key=str,
    )
    kept = langid.with_language(spark.createDataFrame(tests, DOCS).selectExpr("*", "1 AS score"), model)
    assert kept.columns == ["doc_id", "text", "score"] and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "2", "6", "6", "None"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], DOCS + ", lang string")
    assert [r["lang_pred"] for r in langid.label(docs, langid.learn(docs)).collect()] == ["und"]
    assert langid.label(docs.limit(0), langid.learn(docs)).count() == 0


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    judged = langid.label(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    n, right = judged.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.99


# ---------------------------------------------------------------- mixing


@pytest.fixture(scope="module")
def soft(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    return mixing.written(mixing.posteriors(docs, mixing.learn(docs, labels)), "soft")


def test_posteriors_agree_with_labels(spark, soft):
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    best = F.when(F.col("p_toxic") >= 0.5, "toxic").when(F.col("p_poor") > F.col("p_good"), "poor").otherwise("good")
    truth = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("good")
    n, right = soft.join(labels, "doc_id").agg(F.count("*"), F.count_if(best == truth)).first()
    assert n > 300 and right / n > 0.9


def expected(rows, targets):
    tokens = {k: sum(r["rate"] * r["tokens"] * r[f"p_{k}"] for r in rows) for k in targets}
    return {k: v / sum(tokens.values()) for k, v in tokens.items()}


def plain_rates(rows, targets, steps=3000):
    """Projected gradient with arrays, by many small steps."""
    names = list(targets)
    p = np.array([[r[f"p_{k}"] for k in names] for r in rows])
    n = np.array([r["tokens"] for r in rows], float)
    mass = (p * n[:, None]).sum(0)
    share = np.array([targets[k] for k in names]) / sum(targets.values())
    total = mass[share.argmax()] / share.max()
    rate = np.ones(len(n))
    for _ in range(steps):
        apart = (rate[:, None] * n[:, None] * p).sum(0) - share * total
        rate = np.maximum(0, rate - p @ (apart / np.where(mass > 0, mass, 1)))
    return (rate[:, None] * n[:, None] * p).sum(0) / (rate[:, None] * n[:, None] * p).sum()


def test_rates_meet_the_targets(soft):
    rows = mixing.fit_rates(soft, TARGETS).collect()
    got = expected(rows, TARGETS)
    assert all(abs(got[k] - v) < 0.005 for k, v in TARGETS.items()) and min(r["rate"] for r in rows) >= 0
    plain = dict(zip(TARGETS, plain_rates(rows, TARGETS), strict=True))  # about as near as a long plain walk
    assert all(abs(got[k] - v) < abs(plain[k] - v) + 0.005 for k, v in TARGETS.items())


def test_shares_are_told(soft):
    fitted = mixing.fit_rates(soft, TARGETS)
    got = {r["domain"]: (r["target"], r["share"]) for r in mixing.shares(fitted, TARGETS).collect()}
    want = expected(fitted.collect(), TARGETS)
    assert set(got) == set(TARGETS) and all(t == TARGETS[k] and abs(x - want[k]) < 1e-9 for k, (t, x) in got.items())


@pytest.mark.parametrize(("targets", "most"), [({"good": 0.5, "poor": 0.5, "toxic": 0.0}, None), ({"good": 0.2, "poor": 0.7, "toxic": 0.1}, None), ({"good": 0.97, "poor": 0.03, "toxic": 0.0}, 2.0)])
def test_other_targets(soft, targets, most):
    rows = mixing.fit_rates(soft, targets, anchor="good", most=most).collect()
    got = expected(rows, targets)
    assert all(abs(got[k] - v) < 0.005 for k, v in targets.items()) and (most is None or max(r["rate"] for r in rows) <= most)


def test_targets_out_of_reach_are_told(spark):
    soft = spark.createDataFrame([(1, 5, 10, 1.0, 0.0, 0.0)], "doc_id long, h long, tokens long, p_good double, p_poor double, p_toxic double")
    with pytest.warns(UserWarning, match="no rates meet"):
        mixing.fit_rates(soft, TARGETS)


def test_held_out_documents_are_judged_well(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    learned = F.pmod(F.col("doc_id"), F.lit(4)) != 1
    soft = mixing.posteriors(docs, mixing.learn(docs, labels.where(learned)))
    best = F.when(F.col("p_toxic") >= 0.5, "toxic").when(F.col("p_poor") > F.col("p_good"), "poor").otherwise("good")
    truth = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("good")
    n, right = soft.join(labels.where(~learned), "doc_id").agg(F.count("*"), F.count_if(best == truth)).first()
    assert n > 50 and right / n > 0.9


def test_mixing_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (None, "words"), (3, None), (4, ""), (1, "other")], DOCS).selectExpr("*", "9 AS tokens", "8 AS rate")
    got = mixing.mix(docs, labels, TARGETS).collect()
    assert sorted((str(r["doc_id"]), r["tokens"]) for r in got) == [("1", 1), ("1", 3), ("1", 3), ("3", 0), ("4", 0), ("None", 1)]
    assert mixing.mix(docs.limit(0), labels, TARGETS).count() == 0 and mixing.mix(docs, labels.limit(0), TARGETS).count() == 6


def test_rates_decide_what_stays(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(2000)] + [(None, "x")], DOCS)
    mixed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.when(F.col("doc_id") < 1000, 0.25).otherwise(0.5).alias("rate"))
    kept = {r["doc_id"] for r in mixing.sampled(docs, mixed).collect()}
    assert 200 < sum(i is not None and i < 1000 for i in kept) < 300 and {None, *range(1000, 2000)} <= kept


def test_kept_tokens_meet_the_targets(spark):
    texts = [(i, f"t{i}") for i in range(20_000)]
    docs = spark.createDataFrame(texts, DOCS)
    poor = (F.col("doc_id") % 8 == 0).cast("double")  # a seventh of the good tokens, a ninth is asked for
    soft = docs.select("doc_id", F.xxhash64("text").alias("h"), F.lit(10).cast("long").alias("tokens"), (1 - poor).alias("p_good"), poor.alias("p_poor"), F.lit(0.0).alias("p_toxic"))
    kept = mixing.sampled(docs, mixing.fit_rates(soft, TARGETS), sure=1.0).select("doc_id").join(soft, "doc_id")
    good, bad = kept.agg(F.sum(F.col("tokens") * F.col("p_good")), F.sum(F.col("tokens") * F.col("p_poor"))).first()
    assert good == 175_000 and abs(bad / (good + bad) - TARGETS["poor"]) < 0.005


def test_rates_above_one_repeat(spark):
    docs = spark.createDataFrame([(i, f"t{i}", 1, 2, 3) for i in range(3000)], DOCS + ", mix_id int, MIX_HASH int, mix_times int")
    mixed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.when(F.col("doc_id") < 1000, 1.25).when(F.col("doc_id") < 2000, 3.0).otherwise(0.0).alias("rate"))
    kept = mixing.sampled(docs, mixed, sure=1.0)
    assert kept.columns == docs.columns
    times = collections.Counter(r["doc_id"] for r in kept.collect())
    assert set(times) == set(range(2000)) and all(times[i] == 3 for i in range(1000, 2000))
    assert 200 < sum(times[i] == 2 for i in range(1000)) < 300 and max(times[i] for i in range(1000)) == 2


def test_no_python_in_mixing(spark, soft):
    import re

    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    assert not re.search("Python|Arrow|Pandas", mixing.mix(docs, labels, TARGETS)._jdf.queryExecution().executedPlan().toString())
