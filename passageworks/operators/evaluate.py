"""Judged queries: the rank of the first right result, and rates at one and three."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranks(results: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, rank): the first result that covers every passage of any answer; null if none does.

    ``answers`` is (qid, answer_no, passage_id); an answer may span several passages.
    """
    covered = results.withColumn("passage_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("span") - 1))).select("qid", "rank", "passage_id")
    needed = answers.groupBy("qid", "answer_no").agg(F.count_distinct("passage_id").alias("needed"))
    met = covered.join(F.broadcast(answers.distinct()), ["qid", "passage_id"]).groupBy("qid", "answer_no", "rank").agg(F.count_distinct("passage_id").alias("met"))
    right = met.join(F.broadcast(needed), ["qid", "answer_no"]).filter("met = needed").groupBy("qid").agg(F.min("rank").alias("rank"))
    return answers.select("qid").distinct().join(right, "qid", "left")


def rates(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """(judged, n, top1, top3) of each set of judged queries; ``sets`` is (qid, judged)."""
    return ranked.join(F.broadcast(sets), "qid").groupBy("judged").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 3).alias("top3"))


def timed(rates_: DataFrame, seconds: dict[int, float], sets: DataFrame) -> DataFrame:
    """``rates`` with the worst time of a query of each set; ``seconds`` has the time of each query id that was asked alone."""
    spark = rates_.sparkSession
    worst = spark.createDataFrame(list(seconds.items()), "qid int, seconds double").join(F.broadcast(sets), "qid").groupBy("judged").agg(F.max("seconds").alias("worst"))
    return rates_.join(worst, "judged", "left")
