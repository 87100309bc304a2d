"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Spark counts the vote patterns of the whole corpus (at most 3**10 of them);
expectation-maximisation over those counts estimates the prior and each
labeller's accuracy, without any true label.  Posterior labels of at most
``FIT_ROWS`` documents then train a linear scorer over hashed byte 4-grams,
which scores every whole text.

Edge cases: a text without words (null, empty, blank) gets score 0 and isn't
kept; texts of under four bytes are scored by the bias; rows are independent;
if all posteriors agree the scorer is the prior; documents of null id are judged
but not learnt from, as an id decides what is sampled (of repeated ids and texts
the first in order); an empty table gives an empty result; extra columns are
kept, and columns named as a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, named, packed, ship_package, unpacked
from tidemark.llm.doc_stats import document_stats_udf

FIT_ROWS = 6_000
BUCKET_BITS = 16
KEEP_SCORE = 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2


def labellers() -> dict[str, Column]:
    """Votes over the columns of ``doc_stats``; each is ABSTAIN, BAD or GOOD."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))

    def bad(when: Column) -> Column:
        return F.when(when, BAD).otherwise(ABSTAIN)

    def vote(bad_when: Column, good_when: Column) -> Column:
        return F.when(bad_when, BAD).when(good_when, GOOD).otherwise(ABSTAIN)

    stops = F.col("n_stops") / words
    return {
        "symbols": bad(F.col("n_symbols") / words > 0.3),
        "symbol_share": bad(F.col("n_symbols") / chars > 0.05),
        "pipes": bad(F.col("n_pipes") / words > 0.2),
        "bangs": bad(F.col("n_bangs") / words > 0.2),
        "capitals": bad(F.col("n_upper") / chars > 0.3),
        "repeats": bad(F.col("n_repeat_words") / words > 0.3),
        "duplicate_lines": bad(F.col("n_dup_lines") / lines > 0.3),
        "variety": vote((F.col("n_distinct") / words < 0.25) & (F.col("n_words") >= 40), F.col("n_distinct") / words > 0.5),
        "word_length": vote((chars / words < 2.5) | (chars / words > 9), (chars / words > 3.5) & (chars / words < 6.5)),
        "sentences": vote((stops < 0.01) & (F.col("n_words") >= 20), (stops > 0.03) & (stops < 0.25)),
    }


@dataclass(frozen=True)
class LabelModel:
    """``rates[k, v, c]``: chance that labeller k votes v on class c; ``prior[c]``."""

    prior: np.ndarray
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of class 1 (good) for each row of votes."""
        logs = np.tile(np.log(self.prior), (len(votes), 1))
        for k in range(votes.shape[1]):
            logs += np.log(self.rates[k, votes[:, k]])
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(axis=1)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and their counts.

    It starts from the belief that a vote for bad is rarely wrong and one for
    good often is, and adds one pseudo-count so that no rate is zero.
    """
    k = votes.shape[1]
    rates = np.tile(np.array([[0.4, 0.5], [0.4, 0.01], [0.2, 0.49]]), (k, 1, 1))
    model = LabelModel(np.array([0.2, 0.8]), rates)
    for _ in range(rounds):
        good = model.posterior(votes)
        weight = np.stack([(1 - good) * counts, good * counts], axis=1)
        prior = (weight.sum(axis=0) + 1) / (counts.sum() + 2)
        rates = np.ones((k, 3, 2))
        for j in range(k):
            for v in range(3):
                rates[j, v] += weight[votes[:, j] == v].sum(axis=0)
        model = LabelModel(prior, rates / rates.sum(axis=1, keepdims=True))
    return model


def with_votes(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` (of no column named here) with ``n_words`` and one column ``vote_<name>`` for each labeller."""
    ship_package(rows.sparkSession)
    stats = rows.withColumn("stats", document_stats_udf()(text)).select(*rows.columns, "stats.*")
    return stats.select(*rows.columns, "n_words", *(v.cast("int").alias(f"vote_{k}") for k, v in labellers().items()))


def buckets(data: bytes) -> np.ndarray:
    """Hashed byte 4-grams of a text."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, dtype=np.uint32)
    grams = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def fit_scorer(texts: list[bytes], targets: np.ndarray, rounds: int = 60, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression over square-rooted bucket shares, by AdaGrad on the whole sample."""
    size = 1 << BUCKET_BITS
    weights, bias = np.zeros(size), 0.0
    if not len(texts):
        return weights, bias
    found = [np.unique(buckets(t), return_counts=True) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(k) for k, _ in found])
    keys = np.concatenate([k for k, _ in found]).astype(np.int64)
    values = np.concatenate([c / max(1, c.sum()) for _, c in found])
    squares, bias_square = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, values * weights[keys], len(texts)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) / len(texts)
        grad = np.bincount(keys, values * error[row], size) + 1e-7 * weights
        squares += grad * grad
        weights -= rate * 10 * grad / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_square)
    return weights, float(bias)


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Estimate the labellers on all documents and the scorer on a bounded sample of them.

    The sample holds the ``fit_rows`` documents whose ids hash lowest.
    """
    names = [f"vote_{k}" for k in labellers()]
    rows = docs.select(named(doc_id).alias("id"), named(text).alias("text"))
    table = with_votes(rows, F.col("text")).groupBy(*names).count().toPandas().sort_values(names)
    model = fit_label_model(table[names].to_numpy(dtype=np.int64).reshape(-1, len(names)), table["count"].to_numpy(dtype=np.float64))
    picked = rows.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(fit_rows).withColumnRenamed("id", "picked")
    sample = with_votes(rows.join(F.broadcast(picked), F.col("id") == F.col("picked")).select("id", "text"), F.col("text"))
    sample = sample.where("n_words > 0").orderBy("id", "text").select("text", *names).limit(2 * fit_rows).toPandas()
    votes = sample[names].to_numpy(dtype=np.int64).reshape(-1, len(names))
    weights, bias = fit_scorer([t.encode("utf-8", "surrogatepass") for t in sample["text"]], model.posterior(votes))
    return QualityModel(model, weights, bias)


def classify(docs: DataFrame, model: QualityModel, keep_score: float = KEEP_SCORE, text: str = "text") -> DataFrame:
    """``docs`` with ``n_votes``, ``posterior``, ``score`` and ``kept``."""
    names = [f"vote_{k}" for k in labellers()]

    @F.pandas_udf("posterior double, score double")
    def scored(texts: pd.Series, votes: pd.Series) -> pd.DataFrame:
        table = np.array(votes.tolist(), dtype=np.int64).reshape(len(votes), len(names))
        scores = np.empty(len(texts))
        for i, text in enumerate(texts):
            b = buckets(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, dtype=np.uint32)
            scores[i] = model.bias + (model.weights[b].mean() if len(b) else 0.0)
        return pd.DataFrame({"posterior": model.labels.posterior(table), "score": 1 / (1 + np.exp(-np.clip(scores, -30, 30)))})

    voted = with_votes(packed(docs), field(text)).withColumn("found", scored(field(text), F.array(*names)))
    score = F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.col("found.score"))
    n_votes = sum((F.col(n) != ABSTAIN).cast("int") for n in names)
    return unpacked(voted, n_votes=n_votes, posterior=F.col("found.posterior"), score=score, kept=score >= keep_score)
