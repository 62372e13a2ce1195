"""Newest query wins: of the queries that wait together, only each user's last one is answered."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passageworks.engine import SearchEngine


#: Users whose queries are answered in one search.
TOGETHER = 500


def newest(waiting: DataFrame, user: str = "user_id", order: str = "event_id") -> DataFrame:
    """Each user's row of the highest order."""
    rest = [c for c in waiting.columns if c != user]
    return waiting.groupBy(user).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(user, "_row.*")


def answer_newest(stream: DataFrame, engine: SearchEngine, sink: Callable[[DataFrame, int], None], checkpoint: str, *, user: str = "user_id", order: str = "event_id", typed: str = "typed") -> StreamingQuery:
    """Answer a stream of typed queries; a micro-batch is what waits together, and older queries in it are dropped.

    The driver holds TOGETHER users at a time, each such batch being one search.
    """

    def batch(waiting: DataFrame, number: int) -> None:
        wanted = newest(waiting, user, order).select(user, typed)
        answers = [answered(part) for part in batched(wanted.toLocalIterator(), TOGETHER)]
        if answers:
            sink(reduce(DataFrame.union, answers), number)

    def answered(rows: tuple[Row, ...]) -> DataFrame:
        found = engine.search_many([(k, r[typed]) for k, r in enumerate(rows)], live=True)
        kind = stream.schema[user].dataType.simpleString()
        users = stream.sparkSession.createDataFrame([(k, r[user]) for k, r in enumerate(rows)], f"qid int, {user} {kind}")
        return found.results.join(F.broadcast(users), "qid")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
