"""The driver's tables as collections, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE_ROWS = 200  # consecutive ids of one source that make up a file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of files: id, document, file, chunk_index, parent_id and metadata, some of it missing."""
    docs = table(spark, sf_dir, "documents")
    block = F.floor(F.col("doc_id") / FILE_ROWS)
    own = W.partitionBy("source", block).orderBy("doc_id")
    out = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "lang", "source", "n_chars", F.concat("source", F.lit("/f"), block.cast("string")).alias("file"), (F.row_number().over(own) - 1).alias("chunk_index"))
    out = out.withColumn("parent_id", F.concat("file", F.lit("#"), F.floor(F.col("chunk_index") / 4).cast("string")))
    return out


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with quality and toxic, which many lack."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "lang", "source", "n_chars").join(labels, "id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


CHUNKS_SQL = """chunks AS (SELECT doc_id AS id, text AS document, lang, source, n_chars, source || '/f' || (doc_id // 200) AS file,
  row_number() OVER (PARTITION BY source, doc_id // 200 ORDER BY doc_id) - 1 AS chunk_index,
  source || '/f' || (doc_id // 200) || '#' || ((row_number() OVER (PARTITION BY source, doc_id // 200 ORDER BY doc_id) - 1) // 4) AS parent_id FROM documents)"""

LABELLED_SQL = "labelled AS (SELECT d.doc_id AS id, d.text AS document, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
