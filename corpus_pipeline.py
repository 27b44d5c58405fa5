"""A corpus in four stages: quality, near-duplicates, source mixing, packing.

Each stage takes the documents that the one before it kept, as a table of the columns of ``documents``, and its decisions
take effect.  `run` writes every stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.llm import mixing, packing, quality, simhash
from strandmap.llm.shared import cut, word_count, written

#: Documents with a lower quality score go.
QUALITY_CUT = 0.3
#: Texts this similar in five-word shingles are one group.
SHINGLE, SIMILARITY = 5, 0.8
#: Padded words in a batch, and length buckets.
BUDGET, BUCKETS = 8192, 16


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = quality.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.fit(docs, labels)
    return quality.score(docs, model, to="__score").where(F.col("__score") >= QUALITY_CUT).select(*docs.columns)


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: the one of the smallest id.

    Of the documents without an id one of each group stays too, as they can't be told to be those with one.
    """
    return simhash.one_of_each(docs, k=SHINGLE, similarity=SIMILARITY)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs, word_count(F.col("text")))
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document (of every copy)."""
    lengths = docs.select("doc_id", word_count(F.col("text")).alias("n_words"))
    packed = packing.pack(cut(lengths), "n_words", BUDGET, BUCKETS)  # the texts are read once
    return packed.select("doc_id", F.col("length").alias("n_words"), "bucket", "padded", "batch", "place")


STAGES = [("quality", stage_quality), ("near-duplicates", stage_dedup), ("mixing", stage_mixing), ("packing", stage_packing)]

#: The classifier, the components and the rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
