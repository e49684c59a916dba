"""A training-data pipeline over documents: what is poor, toxic or a copy goes, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and
returns the columns of documents; the last returns the pieces of packed sequences. Further columns of docs, and
any that are named like an operator's own, are left out.

A null or empty text fails the quality rules and goes; the later stages, given such texts, keep those that
aren't toxic, one of each id's copies, and pack them as their end alone. Null ids are kept like others and lose to any id.
Very long texts are judged and packed whole. Of rows that repeat, exact dedup leaves one. Without labels of both
classes no document is toxic. An empty table leads to an empty table of the same columns at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronotile.llm import common, exact, near, packing, quality, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Toxicity is a model's and packing a tokenizer's verdict: SQL can't state the pipeline's rows.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy v1 of the rules' ledger keeps."""
    return quality.keep_good(docs.select(COLUMNS), "v1")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by models of the labelled ones among docs."""
    return toxicity.keep_clean(docs.select(COLUMNS), common.table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.dedup(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the largest id."""
    return near.dedup(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
