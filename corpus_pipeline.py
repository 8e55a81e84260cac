"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft import ship
from geoweft.llm import decontam, langid, line_dedup, minhash_dedup, packing
from geoweft.plans.store import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share stay once; documents of which nothing is left go."""
    out = line_dedup.dedup_lines(docs)
    cut = F.col("removed_lines").isNotNull()
    kept = out.where(~cut | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of least doc_id."""
    ship(spark)
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as sequences of at most 4096 tokens."""
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("packing", packed)]

#: Language labels, alignment and packing are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
