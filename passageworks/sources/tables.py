"""Passages out of plain tables: (coll, grp, num, text) with a dense passage_id in canonical order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.ordering import dense_ids


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: coll is the language, grp the document, num the line from 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("lang").alias("coll"), F.col("doc_id").alias("grp"), F.posexplode(F.split("text", "\n")).alias("num", "text"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation: one collection, grp the conversation, num the turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.lit("all").alias("coll"), F.col("conv_id").alias("grp"), F.col("turn").cast("int").alias("num"), "text")


def numbered(rows: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """passage_id by (grp, num); ``sample`` has the groups' numbers alone."""
    return dense_ids(rows, ["grp", "num"], "passage_id", sample)
