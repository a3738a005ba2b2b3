"""From documents to packed training sequences: quality, exact copies, near copies, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremill.llm import exactdedup, mixing, packing, quality, simhash
from featuremill.session import cut_lineage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines read well; the classifier learns from two thirds of the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = quality.train(docs, labels)
    return docs.filter(quality.quality_score(F.col("text"), model) >= 0.5)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, the one with the largest id."""
    return exactdedup.keep_winners(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at three bits or fewer, the one with the smallest id."""
    return simhash.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken, taken twice, or taken in part."""
    used = ["doc_id", "text", "source", "n_chars"]
    rest = [c for c in docs.columns if c not in used]  # apart from the columns that the mix makes, whatever their names are
    sized = docs.select(*used, F.struct(F.lit(0).alias("__"), *[F.col(c) for c in rest]).alias("__other"), mixing.word_count(F.col("text")).alias("__words"))
    mixed = mixing.repeat_mixed(mixing.mix(sized, "__words"), "__words", n_chars="n_chars")
    return mixed.select(*[F.col(c) if c in used else F.col("__other").getField(c).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 2048."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier and the hash of the fingerprints cannot be written in SQL; the tests run the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
