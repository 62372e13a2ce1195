"""Intermediate tables that outlive lost executors, in the folder that the session names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process, by application, until ``forget`` removes them.
_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Unset: a new temporary one where driver and tasks are one process, else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet and read from there: later plans are short and never work them out again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Remove every table that ``durable`` wrote for this application; results that still read them are lost. Returns how many."""
    context = spark.sparkContext
    paths = _written.pop(context.applicationId, [])
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def bounded(df: DataFrame) -> DataFrame:
    """A table bounded by the stated batch of queries, worked out now and kept as rows in the plan."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
