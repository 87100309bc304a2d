"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_spread, order_minhash, page_text, quality_rules, source_mix, suffix_dedup, token_alignment, token_counts, toxic_spans, vector_links, weak_quality, whitening
from tidemark.llm.common import read_table

#: Sites from which on a line is boilerplate.
MIN_SITES = 10

#: Weights of the mix, by level of the tree; what isn't named weighs 1.
MIX_WEIGHTS = {"domain": {"web": 4, "news": 3, "books": 2, "forum": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 3, 17
MIX_DOMAIN_SQL = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'web' WHEN source IN ('src5', 'src6', 'src7', 'src8', 'src9') THEN 'news' WHEN source IN ('src10', 'src11', 'src12', 'src13', 'src14') THEN 'books' ELSE 'forum' END"


def mix_domain() -> Column:
    return F.expr(MIX_DOMAIN_SQL)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_digest(decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_quality.classify(docs, weak_quality.train(docs)).select("doc_id", "n_votes", "posterior", "score", "kept")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    grouped = order_minhash.with_groups(docs)
    return grouped.select("doc_id", F.col("group_id").alias("class_id"), F.col("is_first").alias("kept"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic_spans.train(docs, read_table(spark, sf_dir, "labels"), wanted=lambda c: ~toxic_spans.held_out(c))
    scored = toxic_spans.score_toxicity(docs, model)
    return scored.select("doc_id", toxic_spans.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = source_mix.mix(docs, mix_domain(), MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "n_tokens_before")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_main_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_spread.remove_boilerplate(docs, MIN_SITES).select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, read_table(spark, sf_dir, "labels"))
    judged = quality_rules.judge_quality(docs, model)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.with_links(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_tokens(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = white.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_order_minhash": op4_order_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_source_mix": op6_source_mix,
    "op7_page_text": op7_page_text,
    "op8_line_spread": op8_line_spread,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_embedding_links": op11_embedding_links,
    "op12_token_alignment": op12_token_alignment,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: DuckDB SQL of the queries that SQL expresses.
ORACLES: dict[str, str] = {
    "op6_source_mix": source_mix.oracle(MIX_DOMAIN_SQL, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED),
    "op8_line_spread": line_spread.oracle(MIN_SITES),
    "op11_embedding_links": vector_links.oracle(),
}
