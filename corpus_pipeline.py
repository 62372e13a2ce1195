"""Corpus pipeline: documents through language, copies, benchmark, secrets and tokens.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last
return the columns of documents; the last returns the tokenised corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.llm import aho_corasick, ball_simhash, markov, tree_bpe, word_first
from passageworks.llm.common import bounded_join, remainder, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a recognised language (null text, or no letter) go; repeated rows stay as they are; whole texts are read. Empty table: no rows."""
    model = word_first.fit_documents(docs, remainder("doc_id", 3) != 1)
    kept = [c for c in COLUMNS if c not in ("doc_id",)]
    found = word_first.identify(docs, model, keep=tuple(kept)).filter(F.col("lang_pred") != word_first.UNKNOWN)
    return found.select("doc_id", *(F.col(f"keep{k}").alias(c) for k, c in enumerate(kept)))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, Jaccard index of 0.8 or more) one row stays.

    It is the row of the smallest id (a null id comes last), of its rows that of the smallest hash of all columns. Equal rows
    count once. Null texts are one class. Very long texts are compared whole. Empty table: no rows.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_h1"), F.xxhash64(F.lit("row"), *COLUMNS).alias("_h2"))
    classes = stored(ball_simhash.near_copies(rows, keep=("doc_id", "_h1", "_h2")))
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h1", "_h2")).alias("k"))
    stays = best.select("k._h1", "k._h2", "label")
    counted = stored(stays.join(classes.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")), ["_h1", "_h2"]).select("_h1", "_h2", "_n"))
    once, more = (bounded_join(rows, counted.filter(f), ["_h1", "_h2"], F.lit(True)).select("_l.*") for f in ("_n = 1", "_n > 1"))
    return once.select(*COLUMNS).union(more.dropDuplicates(["_h1", "_h2"]).select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that holds a window of a benchmark item goes, however small a part of its text that is.

    Null and wordless texts hold none and stay; repeated rows go or stay together; an empty benchmark or table changes nothing.
    """
    found = aho_corasick.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.filter(F.col("n_hit") == 0).select(*(F.col(f"keep{k}").alias(c) for k, c in enumerate(COLUMNS)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; every row stays, null texts and repeated rows as they are. Empty table: no rows."""
    rest = tuple(c for c in COLUMNS if c not in ("doc_id", "text", "n_chars"))
    found = markov.scan(docs, markov.fit_documents(docs), keep=(*rest, "n_chars"))
    hit = F.size("found") > 0
    text = markov.redacted(F.col("_text"), F.col("found"))
    out = found.withColumn("clean", text)
    named = {c: F.col(f"keep{k}") for k, c in enumerate(rest)}
    named |= {"doc_id": F.col("doc_id"), "text": F.col("clean"), "n_chars": F.when(hit, F.length("clean").cast("bigint")).otherwise(F.col(f"keep{len(rest)}"))}
    return out.select(*(named[c].alias(c) for c in COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row, repeated ones too; null text has no tokens. Empty table: no rows."""
    return tree_bpe.encode_documents(docs, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [("language", language), ("copies", copies), ("benchmark", benchmark), ("secrets", secrets), ("tokens", tokens)]
#: A fitted language model and a tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
