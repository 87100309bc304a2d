"""Corpus pipeline: the stages that turn ``documents`` into a weighted training mix.

Edge cases: null and empty texts fail the base limits of the first stage, and
each later stage treats nulls as its operator says; repeated rows are near
duplicates, of which one stays; an empty table gives an empty result; extra
columns go through all stages as they are, whatever their names, but for those
that the last stage adds: ``domain``, ``epoch``, ``n_tokens``, ``n_tokens_before``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_spread, order_minhash, quality_rules, queries, source_mix
from tidemark.llm.common import field, named, read_table, written

#: What the operators of the first two stages read of a document.
READ = ("doc_id", "text", "source")


def carried(docs: DataFrame) -> DataFrame:
    """The columns of ``READ``, and the others as one struct ``row``, so that no result can take their names."""
    return docs.select(*READ, F.struct(*(named(c) for c in docs.columns if c not in READ)).alias("row"))


def restored(df: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``docs`` from a table that ``carried`` them."""
    return df.select(*(replaced.get(c, F.col(c) if c in READ else field(c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    model = quality_rules.train(docs, read_table(spark, sf_dir, "labels"))
    return restored(quality_rules.judge_quality(carried(docs), model).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without boilerplate lines; ``n_chars`` follows the text."""
    freed = line_spread.remove_boilerplate(carried(docs), queries.MIN_SITES)
    return restored(freed, docs, n_chars=F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return order_minhash.keep_one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-prefixes that fill the target weights."""
    mixed = source_mix.mix(docs, queries.mix_domain(), queries.MIX_WEIGHTS, share=queries.MIX_SHARE, max_epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED)
    return mixed.select(*docs.columns, "domain", "epoch", "n_tokens", "n_tokens_before")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", contamination),
    ("mixing sources to target weights", weighted_mix),
]

#: Stages 9 (trained trees) and 4 (minimum sketches) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage in turn, each to what the one before it kept."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
