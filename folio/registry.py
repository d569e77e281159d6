"""The registry view over a ``documents`` table, and the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: the clock of every query that needs one
TODAY = "2024-06-30"

REGISTRY_SQL = """
reg AS (
    SELECT doc_id AS id, sha256(text) AS checksum, split_part(text, chr(10), 1) AS title, source AS category, lang AS subcategory,
           strftime(DATE '2023-01-01' + CAST(doc_id % 500 AS INTEGER), '%Y-%m-%d') AS date, [lang, source] AS tags,
           'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS filename, '/archive/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS path,
           text AS raw_text, n_chars AS size
    FROM documents
)"""


def registry(documents: DataFrame) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return documents.select(
        F.col("doc_id").alias("id"),
        F.sha2("text", 256).alias("checksum"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("category"),
        F.col("lang").alias("subcategory"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")), "yyyy-MM-dd").alias("date"),
        F.array("lang", "source").alias("tags"),
        name.alias("filename"),
        F.concat(F.lit("/archive/"), F.col("source"), F.lit("/"), name).alias("path"),
        F.col("text").alias("raw_text"),
        F.col("n_chars").alias("size"),
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark.read.parquet(f"{sf_dir}/documents.parquet"))
