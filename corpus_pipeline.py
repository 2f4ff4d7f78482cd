"""A corpus pipeline of five stages: from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back
as the next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import fresh_path, stored, table
from fathomline.llm.decontam import decontaminate
from fathomline.llm.mixing import mix
from fathomline.llm.neardup import near_duplicates
from fathomline.llm.quality import passing
from fathomline.llm.tokenout import default_tokenizer, token_output


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that break a quality rule."""
    return passing(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies (five-word shingles, similarity 0.8).

    Rows without doc_id stay.  Rows that repeat a doc_id are one document, of which the first by text stays.
    """
    found = near_duplicates(docs.select("doc_id", "text"), width=5)
    gone = found.filter("not kept and doc_id is not null").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = stored(left.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return left
    row = F.struct(*[F.col(c) for c in docs.columns])
    first = left.join(repeated, "doc_id").select(docs.columns).groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNotNull(), "text", F.xxhash64(*docs.columns))).alias("_row"))
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(first.select("_row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the sources' targets ask."""
    return mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return their documents: doc_id, start, n_tokens, ids_crc32."""
    found = token_output(docs, default_tokenizer())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", token_stage),
]

#: Near-duplicate search, entropy balancing and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
