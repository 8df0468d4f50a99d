"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes
each stage's rows to the shared folder and reads them again. All stages but the last return the
columns of documents. Nulls, empty texts, repeated rows and empty tables: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.bpe import encode_decode
from gridweave.llm.common import drop_stored, stored
from gridweave.llm.jaccard_join import drop_copies
from gridweave.llm.line_dedup import dedup_lines, drop_emptied
from gridweave.llm.mixing import mix_documents
from gridweave.llm.quality_qda import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents that were nothing else; n_chars is counted again."""
    names = docs.columns
    kept = drop_emptied(dedup_lines(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the first stays; rows without a word link to nothing and stay."""
    return drop_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and the text decoded from them."""
    return encode_decode(docs).withColumnRenamed("decoded", "text")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mixing),
    ("BPE", tokens),
]

#: The classifier can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
