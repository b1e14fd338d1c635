"""From raw documents to packed sequences: quality rules, toxicity, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import common, jaccard, packing, quality, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules; null and empty texts do not. Repeated rows are judged each for itself."""
    return quality.keep_quality(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity field, trained on labelled ones among them, scores below 0.3; a score of 0.3 goes.
    Repeated rows have the same score."""
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.sample_and_train(docs, labels, common.crc32_mod("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with five-word shingle similarity of 0.8 or more, the one with the smallest
    identifier; one of repeated rows; documents without identifier stay."""
    return jaccard.keep_one(docs, jaccard.similar(docs, k=5, percent=80))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 2048 tokens. Repeated rows are packed each
    for itself; pieces of one length are packed in the order of their identifiers."""
    return packing.pack(docs, size=2048)


STAGES = [("quality rules", quality_stage), ("toxicity", toxicity_stage), ("near duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can express neither the trained field nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialise(docs, name.replace(" ", "-"))
    return docs
