"""From documents to token ids: toxicity, near-dedup, surrogates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's documents; all
but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import mixing, pieces, pii, queries, simhash, toxicity
from leafmill.staging import materialize


def _small_batches(spark: SparkSession) -> None:
    """Texts are long: fewer rows go to Python at a time than Spark's 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; all others stay as they are."""
    _small_batches(spark)
    return toxicity.drop_toxic(docs, queries.toxicity_chain(spark, docs, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies at a Jaccard likeness of 0.8 or more of five-word shingles, the document with the least id stays."""
    _small_batches(spark)
    return simhash.drop_near_duplicates(docs, width=5, likeness=0.8, seed=42)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities give way to surrogates."""
    return pii.replace_entities(docs, queries.pii_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken_documents(docs, weights=(3, 1, 2), share=1.5, bound=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    _small_batches(spark)
    return pieces.encode(docs, queries._piece_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_copies),
    ("pii_surrogates", replace_private),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained classifier, drawn surrogates and drawn copies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
