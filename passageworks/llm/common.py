"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.durable import durable, folder

#: A key of more than one row in HOT_SHARE is hot; at most HOT_SHARE keys are.
HOT_SHARE = 1000
#: Most rows of a narrow table (a few numbers each) that a join sends to every executor.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch on its way to a Python worker.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; survives lost executors."""
    folder(df.sparkSession)
    return df.checkpoint()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into a few hundred rows, so Python objects of few texts live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def clean(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator reads; extra columns of any name do not reach it."""
    return small_batches(docs).select(*(F.col(f"`{c}`") for c in columns))


def small_batches(docs: DataFrame) -> DataFrame:
    """The same rows, after bounding the session's Arrow batches: one is held on both sides of each Python worker."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return docs


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder, where rows are many and compress well."""
    return durable(df)


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` joined to ``right`` (unique by ``key``), whatever part of ``left`` one key holds.

    Keys of more than one row in HOT_SHARE of ``left`` are at most HOT_SHARE, so their rows of ``right`` are
    broadcast; the others meet in a shuffle. Null keys meet nothing. ``left`` should be a written table.
    """
    rows = left.count()
    hot = checkpoint(right.join(F.broadcast(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT_SHARE > rows).select(key)), key, "left_semi"))
    often = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return often.unionByName(rest)


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], also: Column) -> DataFrame:
    """Inner join (aliases ``_l``, ``_r``) of wide ``left`` with narrow, written ``right``: by broadcast up to BROADCAST_ROWS rows, else by shuffle."""
    few = right.count() <= BROADCAST_ROWS
    on = also
    for key in keys:
        on = (F.col(f"_l.{key}") == F.col(f"_r.{key}")) & on
    return left.alias("_l").join((F.broadcast(right) if few else right).alias("_r"), on)
