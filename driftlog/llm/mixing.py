"""Mixing documents to target weights of domains, with soft membership.

Logistic models for toxic and for poor text, learned from a bounded sample of the labelled table over
hashed words and classes of shape, give every document a posterior over domains. Rates, one per document
and not negative, are then fitted so that the expected token total of each domain, sum(rate * tokens *
posterior), matches its target: least squares over the totals, solved by projected gradient over all
documents. A step moves every rate along its document's posteriors and projects it to what is allowed; the
gradient is scaled by the inverse of the products of posteriors over the documents that are still free to
move, and one aggregate over the documents tries several lengths of a step. What comes to the driver is a
few numbers for each domain. A rate above 1 repeats a document.

All of it is DataFrame expressions: a document's words are looked up in an array of weights of fixed size,
so nothing is exploded, joined or grouped by document.

Defined results: null text is empty and has no tokens: its rate follows its prior posterior and it weighs
nothing; every input row gives one row, so rows that share id and text share a rate; without usable labels
every document is in the first domain; a domain with target 0 is pressed towards 0; null ids are kept; other
columns are ignored; an empty table gives an empty result. Targets that no rates reach (a domain without a
document) are missed, with a warning; ``shares`` tells what the rates give.
"""

from __future__ import annotations

import warnings

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.shared import Scratch, id_and_text, own_name, written

DOMAINS = ("good", "poor", "toxic")
#: hash buckets of features
BUCKETS = 1 << 16
_SHAPE = "\x01"


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, h`` (hash of the text), ``tokens`` and ``f``: buckets of the distinct words and of shape features."""
    d = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    d = d.select("doc_id", "h", "text", F.expr(r"filter(split(lower(text), r'[^\p{L}\p{N}]+'), w -> w <> '')").alias("w"))
    d = d.select("doc_id", "h", F.size("w").cast("long").alias("tokens"), F.array_distinct("w").alias("f"), *[F.length(F.regexp_replace("text", p, "")).alias(n) for n, p in (("upper", "[^A-Z]+"), ("odd", "[^#$%&*|!@~^<>{}=_]+"))])
    per = lambda c: f"CAST(least(9, floor(6 * {c} / greatest(1, tokens))) AS INT)"
    shapes = f"array(concat('\x01u', {per('upper')}), concat('\x01o', {per('odd')}), concat('\x01r', CAST(floor(10 * size(f) / greatest(1, tokens)) AS INT)), concat('\x01n', CAST(least(14, floor(log2(1 + tokens))) AS INT)))"
    return d.select("doc_id", "h", "tokens", F.expr(f"transform(concat(f, {shapes}), w -> CAST(pmod(xxhash64(w), {BUCKETS}) AS INT))").alias("f"))


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, least_z: float = 4.0, penalty: float = 1e-5, steps: int = 60) -> DataFrame:
    """Weights, one row: ``t, q``: log odds for toxic and for poor text by bucket, ``bt, bq``: their biases.

    ``most_labelled``: bound of the sample of labelled rows, chosen by a hash of the id; ``least_z``: standard errors
    by which the classes must differ in having a word for its bucket to get a weight (shape features always do);
    ``penalty``: of the squared weights.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("t"), (1 - F.max("quality")).cast("double").alias("q"))
    share = most_labelled / max(most_labelled, lab.count())
    lab = lab.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).withColumnRenamed("doc_id", "id")
    sample = features(id_and_text(docs).join(lab.select("id"), F.col("doc_id") == F.col("id"), "left_semi")).dropDuplicates(["doc_id"]).join(lab, F.col("doc_id") == F.col("id"))
    sample = scratch.written(sample.select(F.expr("transform(array_distinct(f), x -> CAST(x AS STRING))").alias("f"), "t", "q"), "mix-sample")
    n, nt, nq = sample.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("q"), F.lit(0.0))).first()
    found = sample.select(F.explode("f").alias("f"), "t", "q").groupBy("f").agg(F.count("*").alias("c"), F.sum("t").alias("ct"), F.sum("q").alias("cq"))

    def z(c: str, total: float) -> Column:
        p1, p0, every = (F.col(c) + 0.5) / (total + 1.0), (F.col("c") - F.col(c) + 0.5) / (n - total + 1.0), (F.col("c") + 0.5) / (n + 1.0)
        return F.abs(p1 - p0) / F.sqrt(every * (1.0001 - every) * (1 / (total + 1.0) + 1 / (n - total + 1.0)))

    shapes = {str(r[0]) for r in spark.range(1).select(F.explode(F.expr(f"flatten(transform(array('u', 'o', 'r', 'n'), k -> transform(sequence(0, 14), i -> pmod(xxhash64(concat('{_SHAPE}', k, i)), {BUCKETS}))))"))).collect()}
    known = [r["f"] for r in found.select("f", F.greatest(z("ct", nt), z("cq", nq)).alias("z")).orderBy("f").collect() if r["z"] >= least_z or r["f"] in shapes]  # a row for each bucket
    weights, biases = [[0.0] * BUCKETS, [0.0] * BUCKETS], [-20.0, -20.0]
    if known:
        rows = scratch.written(CountVectorizerModel.from_vocabulary(known, inputCol="f", outputCol="x").transform(sample).select("x", "t", "q"), "mix-vectors", 4)
        for i, (c, total) in enumerate((("t", nt), ("q", nq))):
            if 0 < total < n:
                fit = LogisticRegression(featuresCol="x", labelCol=c, regParam=penalty, maxIter=steps, standardization=False).fit(rows)
                biases[i] = float(fit.intercept)
                for f, w in zip(known, fit.coefficients.toArray().tolist(), strict=True):
                    weights[i][int(f)] = w
            elif total:
                biases[i] = 20.0
    scratch.drop()
    return written(spark.createDataFrame([(*weights, *biases)], "t array<double>, q array<double>, bt double, bq double").coalesce(1), "mix-weights")


def posteriors(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``doc_id, h, tokens, p_good, p_poor, p_toxic`` of every row (``h``: hash of the text)."""
    d = features(docs).select("*", *[weights.select(c).scalar().alias(f"w_{c}") for c in ("t", "q", "bt", "bq")])
    odds = lambda c: F.expr(f"1 / (1 + exp(-aggregate(f, w_b{c}, (a, x) -> a + w_{c}[x])))")
    out = d.select("doc_id", "h", "tokens", F.round(odds("t"), 9).alias("p_toxic"), F.round(odds("q"), 9).alias("poor"))
    return out.select("doc_id", "h", "tokens", F.round((1 - F.col("p_toxic")) * (1 - F.col("poor")), 9).alias("p_good"), F.round((1 - F.col("p_toxic")) * F.col("poor"), 9).alias("p_poor"), "p_toxic")


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small system by elimination; a vanishing pivot leaves its unknown at 0."""
    rows = [[*m, r] for m, r in zip(matrix, right, strict=True)]
    n, least = len(rows), 1e-12 * max([abs(x) for m in matrix for x in m], default=0.0)
    for i in range(n):
        best = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        if abs(rows[i][i]) > least:
            for j in range(n):
                if j != i:
                    by = rows[j][i] / rows[i][i]
                    rows[j] = [x - by * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] if abs(rows[i][i]) > least else 0.0 for i in range(n)]


def fit_rates(soft: DataFrame, targets: dict[str, float], anchor: str | None = None, most: float | None = None, steps: int = 20, tolerance: float = 4e-3) -> DataFrame:
    """``soft`` with a column ``rate``, not negative (and at most ``most``, if given).

    ``targets``: share of the tokens for each domain. ``anchor``: the domain whose present tokens set the
    total (default: the domain with the largest target). ``tolerance``: of a domain's tokens against the total.
    """
    names = list(targets)
    anchor = anchor or max(names, key=lambda k: targets[k])
    soft = written(soft, "mix-soft")
    mass = soft.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p_{k}")), F.lit(0.0)).alias(k) for k in names]).first()
    share = {k: v / sum(targets.values()) for k, v in targets.items()}
    total = mass[anchor] / share[anchor]
    if not total:
        return soft.withColumn("rate", F.lit(1.0))
    bound = lambda r: f"greatest(0.0D, {r})" if most is None else f"least({most!r}D, greatest(0.0D, {r}))"
    along = lambda e: "(" + " + ".join(f"p_{k} * ({x!r}D)" for k, x in zip(names, e, strict=True)) + ")"
    moved: list[list[float]] = []

    def rate() -> Column:
        walk = ", ".join("array(" + ", ".join(f"{x!r}D" for x in e) + ")" for e in moved)
        step = " + ".join(f"p_{k} * e[{i}]" for i, k in enumerate(names))
        return F.expr(f"aggregate(array({walk}), {bound('1.0D')}, (r, e) -> {bound(f'r - ({step})')})") if moved else F.expr(bound("1.0D"))

    def tried(ways: list[list[float]]) -> list[tuple[float, list[float], list[list[float]]]]:
        """For each move: squared error, errors of the totals, and products of posteriors over what is free after it."""
        at = soft.withColumn("rate", rate()).select("tokens", *[f"p_{k}" for k in names], *[F.expr(bound(f"rate - {along(w)}")).alias(f"r{c}") for c, w in enumerate(ways)])
        free = lambda c: f"r{c} > 0" if most is None else f"r{c} > 0 AND r{c} < {most!r}D"
        sums = [F.expr(f"coalesce(sum(r{c} * tokens * p_{k}), 0.0D)") for c in range(len(ways)) for k in names]
        sums += [F.expr(f"coalesce(sum(CASE WHEN {free(c)} THEN tokens * p_{k} * p_{m} END), 0.0D)") for c in range(len(ways)) for i, k in enumerate(names) for m in names[i:]]
        got, n, out = list(at.agg(*sums).first()), len(names), []
        pairs = iter(got[n * len(ways) :])
        for c in range(len(ways)):
            apart = [got[n * c + i] - share[k] * total for i, k in enumerate(names)]
            matrix = [[0.0] * n for _ in names]
            for i in range(n):
                for j in range(i, n):
                    matrix[i][j] = matrix[j][i] = next(pairs)
            out.append((sum(a * a for a in apart) / total**2, apart, matrix))
        return out

    error, apart, matrix = tried([[0.0] * len(names)])[0]
    for _ in range(steps):
        if max(map(abs, apart)) <= tolerance * total:
            break
        plain = [a / mass[k] if mass[k] else 0.0 for a, k in zip(apart, names, strict=True)]
        scaled = _solved(matrix, apart)
        ways = [[round(x * by, 12) for x in way] for way, by in ((scaled, 1.0), (scaled, 0.5), (scaled, 0.2), (scaled, 0.05), (plain, 1.0))]
        results = tried(ways)
        best = min(range(len(ways)), key=lambda c: results[c][0])
        if results[best][0] >= error * 0.999:  # as near as rates come
            break
        moved.append(ways[best])
        error, apart, matrix = results[best]
    missed = {k: a / total for k, a in zip(names, apart, strict=True)}
    if max(map(abs, missed.values())) > 0.005:
        warnings.warn(f"no rates meet the targets; expected tokens are off by these parts of the total: {missed}", stacklevel=2)
    return soft.withColumn("rate", rate())


def shares(mixed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """What rates give: a row for each domain, with its ``target`` and its ``share`` of the expected tokens."""
    given = [F.coalesce(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{k}")), F.lit(0.0)).alias(k) for k in targets]
    whole = " + ".join(f"`{k}`" for k in targets)
    rows = ", ".join(f"named_struct('domain', '{k}', 'target', {v / sum(targets.values())!r}D, 'share', `{k}` / nullif({whole}, 0))" for k, v in targets.items())
    return mixed.agg(*given).select(F.expr(f"inline(array({rows}))"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """``doc_id, h, tokens, p_good, p_poor, p_toxic, rate`` of every row."""
    return fit_rates(posteriors(docs, learn(docs, labels)), targets, **options).withColumn("rate", F.round("rate", 6))


def sampled(docs: DataFrame, mixed: DataFrame, most_broadcast: int = 1_000_000, sure: float = 0.5) -> DataFrame:
    """``docs``, all columns, as the rates of ``mixed`` decide: the whole part of a rate says how often a document
    is there, and a hash of the document decides, with the rest as its chance, whether once more. Rates from ``sure``
    to 1 count as 1; only with a ``sure`` of 1 do the tokens follow the targets."""
    chance = F.pmod(F.xxhash64("doc_id", "h", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    times = F.when((F.col("rate") >= sure) & (F.col("rate") < 1), 1).otherwise(F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    the_id, the_hash, the_times = (own_name(n, docs) for n in ("mix_id", "mix_hash", "mix_times"))
    other = mixed.select(F.col("doc_id").alias(the_id), F.col("h").alias(the_hash), times.alias(the_times)).where(F.col(the_times) != 1).distinct()
    other = written(other, "mix-times")
    other = F.broadcast(other) if other.count() <= most_broadcast else other
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    out = docs.join(other, F.col("doc_id").eqNullSafe(F.col(the_id)) & (text == F.col(the_hash)), "left").withColumn(the_times, F.coalesce(the_times, F.lit(1)))
    return out.where(F.col(the_times) > 0).withColumn(the_times, F.explode(F.sequence(F.lit(1), F.col(the_times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
