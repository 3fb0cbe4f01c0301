"""A corpus pipeline: documents in, the training corpus' token ids out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs, whatever they are called.

Null and empty texts, and texts without words, pass all stages: they score 0, are copies of nothing, hold no passage and no
window, and have no ids. Of rows that repeat id and text one stays; rows without a doc_id are judged by their text. Texts of
any length are judged whole. Empty tables give an empty result; without labels of both kinds nothing counts as toxic, and
without a benchmark nothing as contaminated. Ties: of a class of copies the least doc_id stays, and the first occurrence of a
passage in the least doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwork.llm import bpe, common, decontaminate, ngram_join, substring_dedup, toxicity


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity network rejects."""
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: that of the least doc_id."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With all but the first occurrence of repeated passages cut out of the texts."""
    return substring_dedup.cut_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded texts."""
    return bpe.digests(docs, bpe.tokenizer_path())


STAGES = [
    ("toxicity", toxic_documents),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("bpe", token_ids),
]

#: The network and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
