"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the
last return the columns of documents, whatever these are.

1. toxicity: rows whose score is over the fitted model's cut go; null and empty texts stay.
2. near_duplicates: of each group of rows connected by n-gram Jaccard similarity the one of least
   doc_id stays; rows without doc_id, or without words, stay.
3. decontamination: rows that string tiles of a benchmark item cover go.
4. mixture: rows are repeated or left out so that sources meet their target weights.
5. shards: rows get a column ``shard``.

Empty tables pass all stages as empty tables; extra columns stay, also when they are named like
columns that stages make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import jaccard, kdtree, mixing, tiling
from docquery.llm import toxicity as svm
from docquery.llm.shared import settle, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = svm.train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    rows = docs.select(F.struct("*").alias("row"), svm.toxicity(docs, model).alias("score"))
    return rows.where(F.col("score") <= F.lit(model.cut)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kdtree.shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: SQL can't express the fitted classifier and the tiling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
