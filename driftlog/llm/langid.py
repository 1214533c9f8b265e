"""Language of whole texts, and of the spans of mixed ones.

A word's script narrows the candidates to the languages that use that script; its character trigrams,
with word ends, score each candidate; Viterbi over the words, where a change of language costs a fixed
penalty, labels every word. Adjacent words with one label are a span. The text's language is the one with
the most letters, its score that language's share of the letters.

The model learns from at most ``per_language`` labelled rows of each language, chosen by a hash of the
id; its size is fixed by the number of hash buckets. Prediction uses nothing but the text.

Defined results: null text and text without letters give ``und`` and 0; where no row is labelled, every
text is ``und``; every input row gives one row; a word in a script that no language uses takes part with
equal scores; of languages with equally many letters the first by name wins; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.shared import arrow_batches, id_and_text, tidy
from driftlog.llm.words import U, mix

#: first code point of a script's blocks, in ascending order, and the script
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x323B0, "other"),
)
NAMES = tuple(sorted({name for _, name in SCRIPTS}))
BUCKETS = 1 << 16
#: code points after the last letter; what follows are marks of variation
LAST, MARKS = 0x33480, (0xE0100, 0xE01F0)
#: back pointers of Viterbi that are held at once
MOST_BACK = 32_000_000
#: a language uses a script if so much of its letters is in it
LEAST_SHARE = 0.005
#: most that one word can say against a language
FLOOR = -25.0


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: lower case if it is a letter or mark of one, else 0; its script's place in NAMES."""
    import unicodedata

    low = np.zeros(0x110000, np.uint32)
    for c in (*range(LAST), *range(*MARKS)):
        if (ch := chr(c)).isalpha() or (c > 0x2FF and unicodedata.category(ch)[0] == "M"):
            low[c] = ord(x) if len(x := ch.lower()) == 1 else c
    starts = np.array([a for a, _ in SCRIPTS])
    place = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return low, place[np.searchsorted(starts, np.arange(0x110000), "right") - 1]


@dataclass
class Words:
    """The words of a batch of texts, each distinct word once."""

    counts: np.ndarray  # words of each text
    place: np.ndarray  # for each word, its place among the distinct ones
    letters: np.ndarray  # letters of each distinct word
    script: np.ndarray  # script of each distinct word
    owner: np.ndarray  # for each trigram, its distinct word
    bucket: np.ndarray  # and its hash bucket


def read_words(texts: pa.Array) -> Words:
    """Words are what ASCII white space separates and has letters; other characters are dropped."""
    import pyarrow.compute as pc

    low, scripts = _letters()
    lists = pc.ascii_split_whitespace(texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code = np.frombuffer(" ".join([*distinct, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped, word = low[code], np.cumsum(code == 32) - (code == 32)
    keep = mapped > 0
    chars, word = mapped[keep], word[keep]
    letters = np.bincount(word, minlength=len(distinct)) if len(distinct) else np.zeros(0, np.int64)
    script = np.zeros(len(distinct), np.uint8)
    head = np.flatnonzero(np.diff(word, prepend=-1)) if len(word) else np.zeros(0, np.int64)
    script[word[head]] = scripts[chars[head]]
    # trigrams of "^word$": one for each letter, around it
    before, after = np.zeros(len(chars), np.uint64), np.zeros(len(chars), np.uint64)
    if len(chars) > 1:
        joined = word[1:] == word[:-1]
        before[1:][joined], after[:-1][joined] = chars[:-1][joined], chars[1:][joined]
    bucket = (mix(before * U(0x9E3779B1) + (chars.astype(U) << U(21)) + (after << U(42))) % U(BUCKETS)).astype(np.int64)
    place = coded.indices.to_numpy()
    used = letters[place] > 0 if len(place) else np.zeros(0, bool)
    texts_of = np.repeat(np.arange(len(counts)), counts)
    return Words(np.bincount(texts_of[used], minlength=len(counts)), place[used], letters, script, word, bucket)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # log probability of a bucket, by language
    uses: np.ndarray  # whether a language uses a script

    def scores(self, w: Words) -> np.ndarray:
        """Log probability of each distinct word by language, 0 for the best."""
        out = np.stack([np.bincount(w.owner, self.weights[w.bucket, k], len(w.letters)) for k in range(len(self.languages))], 1)
        use = self.uses[w.script]
        out = np.where(use, out, -np.inf)
        out[~use.any(1)] = 0
        return np.maximum(out - out.max(1, keepdims=True), FLOOR).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; all texts take one step at a time together, the longest first.

    Back pointers are held for a stretch of steps; of earlier stretches only the state at their start is
    kept, from which they are walked again.
    """
    rank = np.argsort(-counts, kind="stable")
    n_of, first = counts[rank], (np.cumsum(counts) - counts)[rank]
    steps, languages = int(counts.max(initial=0)), scores.shape[1]
    active = np.searchsorted(-n_of, -np.arange(steps), "left").tolist()  # texts with more words than t
    own = np.arange(languages, dtype=np.uint16)
    labels, state = np.zeros(len(scores), np.uint16), np.zeros((len(counts), languages), np.float32)
    cut, held = [0], 0
    for t, k in enumerate(active):
        held += k * languages
        if held > MOST_BACK:
            cut.append(t)
            held = k * languages
    cut = sorted({*cut, steps})

    def walk(start: int, end: int, back: list | None) -> None:
        for t in range(start, end):
            k = active[t]
            now = state[:k]
            if t:
                best = now.argmax(1)
                change = now[np.arange(k), best] - penalty
                if back is not None:
                    back.append(np.where(change[:, None] > now, best[:, None], own).astype(np.uint16))
                np.maximum(now, change[:, None], out=now)
            now += scores[first[:k] + t]

    starts = []
    for start, end in zip(cut, cut[1:], strict=False):
        starts.append(state[: active[start]].copy())
        if end < steps:
            walk(start, end, None)
    at = None
    for k, (start, end) in reversed(list(enumerate(zip(cut, cut[1:], strict=False)))):
        back: list = [] if start else [None]
        state[: len(starts[k])] = starts[k]
        walk(start, end, back)
        if at is None:
            at = np.zeros(len(counts), np.int64)
        for t in range(end - 1, start - 1, -1):
            n, later = active[t], active[t + 1] if t + 1 < steps else 0
            at[later:n] = state[later:n].argmax(1)  # texts that end here
            labels[first[:n] + t] = at[:n]
            if t:
                at[:n] = back[t - start][np.arange(n), at[:n]]
    return labels


# ---------------------------------------------------------------- learning


def _count(languages: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams and letters of a task's sample, by language: two tables of fixed size."""
    grams = np.zeros((BUCKETS, len(languages)), np.int64)
    script = np.zeros((len(NAMES), len(languages)), np.int64)
    number = {x: k for k, x in enumerate(languages)}
    for b in batches:
        lang = b.column("lang").to_pylist()
        w = read_words(b.column("text"))
        of_word = np.repeat(np.array([number[x] for x in lang], np.int64), w.counts)
        for k in set(of_word.tolist()):
            times = np.bincount(w.place[of_word == k], minlength=len(w.letters))
            grams[:, k] += np.bincount(w.bucket, times[w.owner], BUCKETS).astype(np.int64)
            script[:, k] += np.bincount(w.script, times * w.letters, len(NAMES)).astype(np.int64)
    yield pa.record_batch([pa.array([grams.tobytes()], pa.binary()), pa.array([script.tobytes()], pa.binary())], ["grams", "script"])


def learn(labelled: DataFrame, per_language: int = 3000, tasks: int = 16, smooth: float = 0.5) -> Model:
    """Fit on ``doc_id, text, lang``: at most about ``per_language`` rows of each language."""
    arrow_batches(labelled.sparkSession)
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), bool))
    part = F.broadcast(labelled.sparkSession.createDataFrame([(x, min(1.0, per_language / n)) for x, n in sizes.items()], "lang string, part double"))
    sample = rows.join(part, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("part") * (1 << 20)).repartition(tasks)
    grams, script = np.zeros((BUCKETS, len(languages)), np.int64), np.zeros((len(NAMES), len(languages)), np.int64)
    for r in sample.select("lang", "text").mapInArrow(tidy(_count, languages), "grams binary, script binary").toLocalIterator():
        grams += np.frombuffer(r["grams"], np.int64).reshape(grams.shape)
        script += np.frombuffer(r["script"], np.int64).reshape(script.shape)
    weights = np.log((grams + smooth) / (grams.sum(0) + smooth * BUCKETS))
    return Model(languages, weights, script >= LEAST_SHARE * np.maximum(1, script.sum(0)))


# ---------------------------------------------------------------- labelling


def predict(model: Model, penalty: float, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """(language, score, spans) of each text."""
    names = np.array([*model.languages, "und"], dtype=object)
    w = read_words(texts)
    n = len(w.counts)
    pred, score, spans = np.full(n, len(model.languages)), np.zeros(n), [[] for _ in range(n)]
    if model.languages and len(w.place):
        labels = viterbi(model.scores(w)[w.place], w.counts, penalty)
        text = np.repeat(np.arange(n), w.counts)
        share = np.zeros((n, len(model.languages)))
        np.add.at(share, (text, labels), w.letters[w.place])
        some = w.counts > 0
        pred[some] = share[some].argmax(1)
        score[some] = share[some].max(1) / share[some].sum(1)
        start = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])])
        begin = np.cumsum(w.counts) - w.counts
        for i, e in zip(start.tolist(), np.r_[start[1:], len(labels)].tolist(), strict=True):
            t = int(text[i])
            spans[t].append({"lang": names[labels[i]], "first": i - int(begin[t]), "last": e - 1 - int(begin[t])})
    return names[pred], np.clip(score, 0, 1), spans


def _label(held, penalty: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    for b in batches:
        pred, score, spans = predict(held.value, penalty, b.column("text"))
        yield pa.record_batch([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])


def label(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` (language, first and last word) of each row."""
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(model)
    return id_and_text(docs).mapInArrow(tidy(_label, held, penalty), "doc_id long, lang_pred string, score double, spans array<struct<lang:string, first:long, last:long>>")


def _known(held, penalty: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pred, _, _ = predict(held.value, penalty, b.column("text").fill_null(""))
        yield b.filter(pa.array(pred != "und", pa.bool_()))


def with_language(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """``docs``, all columns, without the rows whose ``lang_pred`` is ``und``. Rows are judged one by one, ids play no part."""
    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(_known, docs.sparkSession.sparkContext.broadcast(model), penalty), docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: one in four, by a checksum of the id (a null id is never held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
