"""A training corpus from documents: rules, classifier, near-duplicates, packing; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import count_rtree, packing, quality_cnn, quality_rules
from tessel.llm.common import stage, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the certified cutoffs of their language, each by its own text.

    Null and empty texts have no words and go; rows with a null or repeated doc_id are judged one by one; a table without
    lang is one stratum. Columns are those of docs, whatever their names; an empty table gives none of its rows.
    """
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"), whole=True).where("kept").select("_row.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier holds for good ones, each by its own text.

    Null and empty texts are scored as such; rows with a null or repeated doc_id are scored one by one. Columns are those
    of docs, whatever their names; an empty table gives no rows.
    """
    return quality_cnn.score(docs, table(spark, sf_dir, "labels"), whole=True).where("predicted = 1").select("_row.*")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one with the smallest doc_id; rows without an id all stay.

    If a doc_id is repeated, its rows are compared as documents of their own: those with other texts stay, and of tied
    rows the text with the lowest hash. Null and empty texts link with nothing and stay. Columns are those of docs,
    whatever their names; an empty table gives no rows.
    """
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        first = count_rtree.jaccard_components(named).where("doc_id = component_id").select("doc_id")
        return named.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    rows = stage(named.select(F.monotonically_increasing_id().alias("_no"), F.struct("*").alias("_row")), "rows")
    classes = count_rtree.jaccard_components(rows.select(F.col("_no").alias("doc_id"), "_row.text")).withColumnRenamed("doc_id", "_no")
    order = F.struct(F.col("_row.doc_id").alias("id"), F.xxhash64("_row.text").alias("hash"), "_no")
    first = classes.join(rows.select("_no", order.alias("order")), "_no").groupBy("component_id").agg(F.min("order")["_no"].alias("_no"))
    return rows.join(first, "_no", "left_semi").select("_row.*").unionByName(docs.where("doc_id is null"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences of 2048 tokens.

    Null text is empty: its piece is the end token. Rows with a null or repeated doc_id are packed one by one; other columns
    are dropped; an empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the fitted models nor the library's tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
