"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm import decontam, jaccard, licences, line_dedup, ordinal, packing, prefix_trie, prefix_trie_sql, recurrent, sharding, simhash, spelling, toxicity, unit_dedup
from recengine.llm.common import table
from recengine.llm.registry import register

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op4_shard_tree")
def op4_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.layout(8)
    return (sharding.assign(table(spark, sf_dir, "documents"), tree, sharding.grown(tree))
            .withColumn("law", F.lit("key")))


@register("op7_concatenate_and_cut")
def op7_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@register("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@register("op6_repeated_units")
def op6_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeated_runs(table(spark, sf_dir, "documents"))


@register("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


@register("op10_licence_scan")
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@register("op3_toxicity_grammar")
def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_spaced_seeds")
def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.verified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_ordinal_quality")
def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@register("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(table(spark, sf_dir, "documents"))


@register("op12_prefix_trie", prefix_trie_sql.SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


@register("op11_recurrent_lm")
def op11_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(table(spark, sf_dir, "documents"))
