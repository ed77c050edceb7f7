"""Training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
before the next one. All stages but the last return the columns of their input, in its order. Every stage sets the
size of the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm import decontamination, line_dedup, minhash, packing, quality_rules
from wavetable.llm.common import small_batches, written
from wavetable.llm.queries import byte_bpe, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than a tenth of their source's distinct documents hold; n_chars follows the text."""
    small_batches(spark)
    clean = line_dedup.drop_boilerplate(docs, host_col="source", copies_once=True)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    small_batches(spark)
    return minhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as token pieces in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_boilerplate),
    ("minhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: Learned trees, hash bands and tokenizers have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
