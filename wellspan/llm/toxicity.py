"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives, a sample of all texts is unlabelled; no text is taken as clean. With
class prior ``pi`` the risk of a classifier ``g`` is

    pi * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - pi * E_pos[loss(-g)])

whose second part estimates the risk on clean texts; where it turns negative, the classifier has begun
to fit single texts, and the step goes the other way. The classifier is linear over the presence of
words and word beginnings, trained with numpy.

Fitting takes at most ``most_positive`` positives and about ``unlabelled`` other rows; scoring takes every
word of every text. Null and empty texts get the score of a text without any feature. Without positives
every score is the prior. Labels of a document that occur several times count once, toxic first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from wellspan.llm.common import Memo, fold, free_name, map_batches, spread_key, table, texts
from wellspan.session import materialize

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5)  # letters


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k)]


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Model:
    prior: float
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def __post_init__(self):
        self.number = {f: i for i, f in enumerate(self.names)}

    def numbers(self, word: str) -> tuple[int, ...]:
        return tuple(self.number[f] for f in features_of(word) if f in self.number)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def nn_risk_gradient(g: np.ndarray, positive: np.ndarray, prior: float, beta: float = 0.0):
    """Risk, and its gradient by ``g``, under the logistic loss; ``positive`` marks the positives."""
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    p = _sigmoid(g)
    as_positive, as_negative = np.logaddexp(0, -g), np.logaddexp(0, g)
    risk_p = prior * as_positive[positive].sum() / n_p
    risk_n = as_negative[~positive].sum() / n_u - prior * as_negative[positive].sum() / n_p
    by_n = np.where(positive, -prior / n_p, 1.0 / n_u) * p
    if risk_n < -beta:
        return risk_p, -by_n
    return risk_p + max(0.0, risk_n), np.where(positive, prior / n_p * (p - 1.0), 0.0) + by_n


def train(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, rounds: int = 400,
          rate: float = 0.05, lasso: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows at once; ``lasso`` takes weak features out. ``rows``: feature numbers of each text."""
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), lengths)
    w, bias = np.zeros(n_features + 1), float(np.log(prior / (1 - prior)))
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = np.bincount(of, w[flat], len(rows)) + w[-1]
        _, dg = nn_risk_gradient(g, positive, prior)
        grad = np.append(np.bincount(flat, dg[of], n_features), dg.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        pace = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - pace * m / (1 - 0.9**t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(0.0, np.abs(w[:-1]) - lasso * pace[:-1])
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic",
        most_positive: int = 1500, unlabelled: int = 6000, n_features: int = 2048, least_z: float = 4.0,
        prior: float | None = None) -> Model:
    """Learn from the toxic rows of ``labels`` and from ``docs`` without looking at other labels.

    Of the features that positives have more often than other rows, by at least ``least_z`` standard errors,
    the ``n_features`` clearest are used. ``prior`` is the share of toxic texts to assume; None takes the share among labelled rows.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(key).agg(F.max(toxic).alias("y"))
    n, n_toxic = marks.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    if prior is None:
        prior = min(0.5, max(0.001, (n_toxic or 0) / n)) if n else 0.05
    if not n_toxic:
        return Model(prior, bias=float(np.log(prior / (1 - prior))))
    chosen = marks.where("y = 1").orderBy(spread_key(key), key).limit(most_positive).select(key, F.lit(True).alias("_p"))
    rows = docs.select(key, F.col(text).alias("text")).where(F.col(text).isNotNull())
    total = rows.count()
    share = min(1 << 20, int(unlabelled / max(1, total) * (1 << 20)) + 1)
    # at most most_positive rows are broadcast
    sample = rows.join(F.broadcast(chosen), key, "left").where(
        F.col("_p") | (F.pmod(F.xxhash64(F.lit("unlabelled"), key), F.lit(1 << 20)) < share))
    sample = materialize(sample.select("text", F.coalesce("_p", F.lit(False)).alias("p"))
                         .groupBy("text").agg(F.max("p").alias("p")), "toxicity-sample")  # copies count once

    def words():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, mark = [], []
            for t, p in zip(texts(batch, "text"), batch.column("p").to_pylist()):
                own = {f for w in distinct_words(t) for f in features_of(w)}
                found.extend(own)
                mark.extend([p] * len(own))
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(mark, pa.bool_())], ["f", "p"])

        return step

    n_p, n_u = (r or 0 for r in sample.agg(F.sum(F.col("p").cast("int")), F.sum((~F.col("p")).cast("int"))).first())
    if not n_p:
        return Model(prior, bias=float(np.log(prior / (1 - prior))))
    counts = map_batches(sample, words, "f string, p boolean").groupBy("f").agg(
        F.sum(F.col("p").cast("int")).alias("c_p"), F.sum((~F.col("p")).cast("int")).alias("c_u"))
    # z of the difference between the shares of positives and of unlabelled rows that have the feature
    r_p, r_u = F.col("c_p") / F.lit(float(n_p)), F.col("c_u") / F.lit(float(max(1, n_u)))
    r = (F.col("c_p") + F.col("c_u")) / F.lit(float(n_p + n_u))
    z = (r_p - r_u) / F.sqrt(r * (1.0 - r) * F.lit(1.0 / n_p + 1.0 / max(1, n_u)))
    names = sorted(x["f"] for x in counts.where(r < 1.0).select("f", z.alias("z")).where(F.col("z") >= least_z).orderBy(
        F.desc("z"), "f").limit(n_features).collect())
    model = Model(prior, names)
    sent = spark.sparkContext.broadcast(model)  # n_features at most

    def numbers():
        memo = Memo(sent.value.numbers)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [sorted({i for w in distinct_words(t) for i in memo[w]}) for t in texts(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("p"), pa.array(own, pa.list_(pa.int32()))], ["p", "x"])

        return step

    got = map_batches(sample, numbers, "p boolean, x array<int>").toArrow()
    pairs = sorted(zip(got.column("p").to_pylist(), got.column("x").to_pylist()))  # the sums don't depend on task order
    model.weights, model.bias = train([np.array(x, np.int64) for _, x in pairs],
                                      np.array([p for p, _ in pairs], bool), len(names), prior)
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", predicted: str = "predicted") -> DataFrame:
    """``df`` plus the score (0 to 1) and ``predicted`` (1 from 0.5); columns of those names are replaced."""
    kept = [c for c in df.columns if c not in (out, predicted)]
    source = df.select(*kept)
    schema = StructType(source.schema.fields + [StructField(out, DoubleType()), StructField(predicted, IntegerType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        memo = Memo(own.numbers)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            g = []
            for t in texts(batch, text):
                found = set().union(*filter(None, map(memo.__getitem__, distinct_words(t))))
                g.append(own.bias + float(own.weights[sorted(found)].sum()) if found else own.bias)
                memo.trim()
            p = _sigmoid(np.array(g))
            return pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                [*kept, out, predicted])

        return step

    return map_batches(source, make, schema)


def keep(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows that aren't predicted toxic; columns as before."""
    out, predicted = free_name(df, "score"), free_name(df, "predicted")
    return score(df, model, text, out, predicted).where(F.col(predicted) == 0).select(*df.columns)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    part = fold("doc_id", 5)
    model = fit(docs.where(part != 0), labels.where(part != 0).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", F.coalesce(part == 0, F.lit(True)).alias("held_out"), "score", "predicted")
