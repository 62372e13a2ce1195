"""Sequential work on each key's rows, streamed: many small keys cost little, and only one key is held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 10_000


def each_key(df: DataFrame, keys: list[str], order: list[str | Column], work: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each key in ``order``; rows are dealt by key, sorted, and read as one stream."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            out += work(list(group))
            if len(out) >= BATCH:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
