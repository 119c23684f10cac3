"""Documents to training sequences: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``.  Rows without a doc_id cannot be judged and go at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm import decontam, jaccard, line_dedup, ordinal, packing
from recengine.llm.common import table
from recengine.llm.queries import tokenizer_path
from recengine.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = ordinal.classify(docs, table(spark, sf_dir, "labels")).where("keep").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the other columns travel as one, whatever their names
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[docs[c] for c in others]) if others else F.lit(0)
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", rest.alias("__rest")))
    own = {c: F.col("__rest")[c].alias(c) for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text")}
    if "n_chars" in others:
        own["n_chars"] = F.char_length("kept").cast("bigint").alias("n_chars")
    return out.select(*[own[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = jaccard.join(docs).where("component_id = doc_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaked = decontam.verified(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
