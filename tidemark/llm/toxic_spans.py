"""Toxic spans and document scores by a linear-chain conditional random field.

Training starts from documents labelled as a whole.  Words and word beginnings
whose document frequency is much higher in toxic than in clean documents label
the tokens of the toxic ones; all tokens of clean documents are labelled clean.
A two-state chain is fitted to those tokens by gradient ascent of the
conditional likelihood, and a two-feature logistic map from the chain's
marginals to document labels is fitted on the same documents.

Scoring runs forward-backward over every whole text.  The marginals aggregate
to a document score; runs of tokens above one half are the offending offsets.

Learning uses at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean documents
(lowest id hash first), so driver memory is bounded; only text is read.

Edge cases: null, empty and wordless texts get the score of a document without
toxic tokens; rows are independent; with no labels of both classes every score
is the share of toxic labels (0 if there are none); null ids aren't held out
and aren't learnt from; of repeated ids the fit takes rows in order of id and
text, up to twice its bound; an empty table gives an empty result; extra columns
are kept, and columns named as a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, packed, ship_package, unpacked
from tidemark.llm.decontaminate import normal_words
from tidemark.llm.quality_rules import labelled_sample

TOXIC_ROWS, CLEAN_ROWS = 1_500, 3_000
#: Tokens of a training chain; scoring takes whole documents.
CHAIN = 64
#: Beginnings of a word that are features beside the word itself.
PREFIXES = (4, 5, 6, 7, 8)
#: A feature labels tokens from this log-odds on, seen in so many toxic documents.
LABEL_ODDS, LABEL_DOCS = 2.5, 8
FEATURE_DOCS = 3
MEMO_WORDS = 300_000
#: Tokens that the fit works on at once.
BLOCK_TOKENS = 100_000
MARKED = 0.5

_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def word_features(word: bytes) -> list[str]:
    text = word.decode("utf-8", "replace")
    return ["=" + text, *("^" + text[:k] for k in PREFIXES if len(text) >= k)]


@dataclass(frozen=True)
class ChainModel:
    """Unary weights by feature, transitions as factors of (from, to), and the document map."""

    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    document: np.ndarray

    def unary(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in word_features(word))


def marginal_odds(u: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of every token of chains laid end to end.

    All chains advance together, longest first, so each step is one operation
    on the chains that are still running.  The marginal is odds / (1 + odds) of
    the product.
    """
    e = np.exp(np.clip(u, -30, 30))
    forward, backward = np.empty(len(u)), np.ones(len(u))
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    (t00, t01), (t10, t11) = t
    for step in range(longest):
        at = starts[: running[step]] + step
        if step == 0:
            forward[at] = e[at]
        else:
            before = np.minimum(forward[at - 1], 1e30)
            forward[at] = e[at] * (t01 + t11 * before) / (t00 + t10 * before)
    for step in range(longest - 2, -1, -1):
        at = starts[: running[step + 1]] + step
        after = np.minimum(e[at + 1] * backward[at + 1], 1e30)
        backward[at] = (t10 + t11 * after) / (t00 + t01 * after)
    return forward, backward


def chain_errors(u: np.ndarray, tags: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seen less expected: the tag of each token, and the four pairs of neighbours in total."""
    f, b = marginal_odds(u, lengths, t)
    odds = np.minimum(f * b, 1e30)
    inner = np.ones(len(u), dtype=bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    left = np.flatnonzero(inner)
    seen = np.bincount(tags[left] * 2 + tags[left + 1], minlength=4)
    before, after = np.minimum(f[left], 1e30), np.minimum(np.exp(np.clip(u[left + 1], -30, 30)) * b[left + 1], 1e30)
    joint = np.stack([np.full(len(left), t[0, 0]), t[0, 1] * after, t[1, 0] * before, t[1, 1] * before * after])
    return tags - odds / (1 + odds), seen - (joint / joint.sum(axis=0)).sum(axis=1)


def fit_chain(u_rows: tuple[np.ndarray, np.ndarray], words: np.ndarray, tags: np.ndarray, lengths: np.ndarray, n_words: int, n_features: int, rounds: int = 40) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam ascent of the mean conditional log-likelihood; returns weights, bias, log transitions.

    ``u_rows`` pairs each word with its features.
    """
    word_of, feature_of = u_rows
    w, bias, log_t = np.zeros(n_features), -4.0, np.zeros((2, 2))
    theta = np.concatenate([w, [bias], log_t.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    parts = blocks(lengths)
    for k in range(1, rounds + 1):
        w, bias, log_t = theta[:n_features], theta[n_features], theta[n_features + 1 :].reshape(2, 2)
        by_word = np.bincount(word_of, w[feature_of], n_words) + bias
        t = np.exp(log_t)
        own, total, pairs = np.zeros(n_words), 0.0, np.zeros(4)
        for at, block in parts:
            some, truth = words[at : at + block.sum()], tags[at : at + block.sum()].astype(np.int64)
            error, change = chain_errors(by_word[some], truth, block, t)
            own += np.bincount(some, error, n_words)
            total += error.sum()
            pairs += change
        grad = np.concatenate([np.bincount(feature_of, own[word_of], n_features), [total], pairs])
        grad -= np.concatenate([0.3 * w, [0.0], 0.3 * log_t.ravel()])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta + 0.25 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2)


def document_features(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: the logit of any token being toxic, and the expected toxic tokens."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    none = np.bincount(which, np.log1p(-np.minimum(marginals, 1 - 1e-9)), len(lengths))
    some = -np.expm1(none)
    logit = np.clip(np.log(np.maximum(some, 1e-9)) - none, -8, 8)
    return np.column_stack([np.ones(len(lengths)), logit, np.log1p(np.bincount(which, marginals, len(lengths)))])


def fit_document_map(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * beta)
    return beta


def blocks(lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Runs of chains with ``BLOCK_TOKENS`` tokens or so, and where each run begins."""
    ends = np.cumsum(lengths)
    cuts = np.flatnonzero(np.diff(ends // BLOCK_TOKENS)) + 1
    parts = np.split(lengths, cuts)
    starts = np.concatenate([[0], ends[cuts - 1]]).astype(np.int64)
    return list(zip(starts.tolist(), parts, strict=True))


def indexed(texts: list[str]) -> tuple[list[np.ndarray], dict[str, int], list[np.ndarray]]:
    """The word ids of each text, the ids of features, and the features of each word."""
    words: dict[bytes, int] = {}
    features: dict[str, int] = {}
    ids = []
    for text in texts:
        found = normal_words(text)
        ids.append(np.fromiter((words.setdefault(w, len(words)) for w in found), dtype=np.int32, count=len(found)))
    per_word = [np.array([features.setdefault(f, len(features)) for f in word_features(w)], dtype=np.int32) for w in words]
    return ids, features, per_word


def fit(texts: list[str], toxic: np.ndarray) -> ChainModel:
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        constant = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return ChainModel({}, -8.0, np.ones((2, 2)), np.array([constant, 0.0, 0.0]))
    ids, feature_ids, per_word = indexed(texts)
    n_words, n_features = len(per_word), len(feature_ids)
    counts = np.zeros((2, n_features), dtype=np.int64)
    for d, y in zip(ids, toxic.tolist(), strict=True):
        if len(d):
            counts[y, np.unique(np.concatenate([per_word[w] for w in np.unique(d).tolist()]))] += 1
    n = np.bincount(toxic, minlength=2)
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    kept = counts[1] >= FEATURE_DOCS
    telling = kept & (counts[1] >= LABEL_DOCS) & (odds >= LABEL_ODDS)
    word_of = np.repeat(np.arange(n_words, dtype=np.int32), [len(f) for f in per_word])
    feature_of = np.concatenate([*per_word, np.zeros(0, dtype=np.int32)])
    del per_word
    marked = np.bincount(word_of[telling[feature_of]], minlength=n_words) > 0
    names = [f for f, k in feature_ids.items() if kept[k]]
    new_id = np.cumsum(kept) - 1
    rows = (word_of[kept[feature_of]], new_id[feature_of[kept[feature_of]]])
    del word_of, feature_of, feature_ids
    words = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    lengths = np.array([len(d) for d in ids], dtype=np.int64)
    tags = (marked[words] & np.repeat(toxic.astype(bool), lengths)).astype(np.int8)
    chains = np.concatenate([[min(CHAIN, k - s) for s in range(0, k, CHAIN)] for k in lengths.tolist() if k] or [[]]).astype(np.int64)
    w, bias, log_t = fit_chain(rows, words, tags, chains, n_words, len(names))
    weights = {f: float(w[k]) for k, f in enumerate(names) if abs(w[k]) > 1e-4}
    by_word = np.bincount(rows[0], w[rows[1]], n_words) + bias
    x = []
    for at, block in blocks(lengths):
        forward, backward = marginal_odds(by_word[words[at : at + block.sum()]], block, np.exp(log_t))
        odds = np.minimum(forward * backward, 1e30)
        x.append(document_features(odds / (1 + odds), block))
    return ChainModel(weights, bias, np.exp(log_t), fit_document_map(np.concatenate(x), toxic.astype(np.float64)))


def train(docs: DataFrame, labels: DataFrame, wanted=None, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ChainModel:
    """Fit on a bounded sample of labelled documents; ``wanted`` limits it by id."""
    parts = [labelled_sample(docs, labels.where(F.col("toxic") == y), "toxic", n, wanted).orderBy("doc_id", "text").limit(2 * n) for y, n in ((1, toxic_rows), (0, clean_rows))]
    table = parts[0].unionByName(parts[1]).where("text is not null").toPandas().sort_values(["doc_id", "text", "label"])
    return fit(table["text"].tolist(), table["label"].to_numpy(dtype=np.int64))


class ChainScorer:
    """Scores batches of texts; remembers the unary weights of words."""

    def __init__(self, model: ChainModel):
        self.model, self.memo = model, {}

    def unaries(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.memo.get, words))
        if None in found:
            for k, value in enumerate(found):
                if value is None:
                    found[k] = self.memo[words[k]] = self.model.unary(words[k])
        return np.array(found, dtype=np.float64)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[list[int]]]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        us = [self.unaries(normal_words(t)) for t in texts]
        lengths = np.array([len(u) for u in us], dtype=np.int64)
        u = np.concatenate(us) if us else np.zeros(0)
        forward, backward = marginal_odds(u, lengths, self.model.transitions)
        odds = np.minimum(forward * backward, 1e30)
        marginals = odds / (1 + odds)
        z = document_features(marginals, lengths) @ self.model.document
        at = np.cumsum(lengths) - lengths
        spans = [marked_spans(t, marginals[s : s + n]) for t, s, n in zip(texts, at.tolist(), lengths.tolist(), strict=True)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def marked_spans(text: str | None, marginals: np.ndarray) -> list[list[int]]:
    """Code point offsets (start, end) of the runs of marked tokens."""
    hits = np.flatnonzero(marginals > MARKED)
    if not len(hits):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
    return [[places[r[0]][0], places[r[-1]][1]] for r in runs]


def score_toxicity(docs: DataFrame, model: ChainModel, cut: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``spans``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<array<long>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        scorer = model.__dict__.get("_scorer") or ChainScorer(model)
        model.__dict__["_scorer"] = scorer
        scores, spans = scorer.score(texts.tolist())
        return pd.DataFrame({"score": scores, "spans": spans})

    found = packed(docs).withColumn("found", scored(field(text)))
    return unpacked(found, score=F.col("found.score"), predicted=(F.col("found.score") >= cut).cast("int"), spans=F.col("found.spans"))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
