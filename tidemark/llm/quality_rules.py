"""Quality rules: fixed base limits, then boosted trees over document statistics.

The base limits fail short and self-repeating documents.  The trees are fitted
on at most ``TRAIN_ROWS`` labelled documents, those whose ids hash lowest, with
monotonic constraints: more symbols, repeated lines or repeated words never
raise a score.  Scoring covers every whole text.

Edge cases: null and empty texts have no words and fail the base limits; rows
are independent, so repeated rows agree; without labels of both classes the
trees give no verdict and the base limits alone decide; rows with null labels
or null ids aren't learnt from; an empty table gives an empty result; extra
columns are kept, and columns named as a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import boosted_trees
from tidemark.llm.common import field, packed, ship_package, unpacked
from tidemark.llm.doc_stats import COLUMNS, FEATURES, SCHEMA, document_stats, document_stats_udf, ratio_features

TRAIN_ROWS = 20_000
KEEP_SCORE = 0.5
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Direction in which a feature may move the score, where one is imposed.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, wanted=None) -> DataFrame:
    """``text`` and ``label`` of at most ``rows`` labelled ids, lowest id hash first.

    The chosen ids are bounded by ``rows``, so they are broadcast; repeated ids
    have all their rows.
    """
    picked = labels.select(F.col("doc_id").alias("_tm_id"), F.col(label).cast("int").alias("label")).where("_tm_id is not null and label in (0, 1)")
    if wanted is not None:
        picked = picked.where(wanted(F.col("_tm_id")))
    picked = picked.groupBy("_tm_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_tm_id"), "_tm_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_tm_id")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> boosted_trees.TreeArrays | None:
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", rows)
    table = sample.select("doc_id", "label", document_stats_udf()("text").alias("s")).select("doc_id", "label", "s.*")
    table = table.orderBy("doc_id", *COLUMNS).limit(2 * rows).toPandas()  # short rows, in an order that repeated ids don't upset
    signs = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return boosted_trees.fit(ratio_features(table), table["label"].to_numpy(dtype=np.float64), signs)


def judge_quality(docs: DataFrame, model: boosted_trees.TreeArrays | None, keep_score: float = KEEP_SCORE, text: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``score``, ``base_failed`` and ``kept``."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(SCHEMA + ", score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        stats = document_stats(texts.tolist())
        stats["score"] = model.score(ratio_features(stats)) if model is not None and len(stats) else 1.0
        return stats

    found = packed(docs).withColumn("s", scored(field(text)))
    stats = {c: F.col(f"s.{c}") for c in (*COLUMNS, "score")}
    failed = (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED_PERCENT * stats["n_words"])
    return unpacked(found, **stats, base_failed=failed, kept=~failed & (stats["score"] >= keep_score))
