"""Query terms and everything each may match, with weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passageworks.functions.text import is_stop, normalize, stem, within
from passageworks.operators.index import IndexTables

RARE_DF = 5
TAG_SHARE, TAG_WEIGHT = 0.12, 0.75
SYNONYM_RARE, SYNONYM_COMMON = 0.8, 0.5
PREFIX_WEIGHT, PREFIXES = 0.85, 30
TYPO_ONE, TYPO_TWO, TYPOS = 0.8, 0.6, 4
#: Terms past this many only count for word order.
SCORED_TERMS = 32


def described(terms: DataFrame) -> DataFrame:
    """Terms with norm, stem and stop; where every term of a query is a stop word none is one."""
    plain = terms.withColumn("norm", normalize(F.col("word"))).withColumn("stem", stem(F.col("norm"))).withColumn("_s", is_stop(F.col("stem")))
    every = F.min("_s").over(Window.partitionBy("qid"))
    return plain.withColumn("stop", F.col("_s") & ~F.col("required") & ~every & F.col("code").isNull()).drop("_s")


def distances(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qid, term_no, norm, stem, n, d): words of the text within one edit of a term, two from eight letters on.

    The terms are broadcast against one pass over the vocabulary; lengths and first tests run before
    the recurrence.
    """
    asked = terms.filter(F.length("norm") >= 4).select("qid", "term_no", F.col("norm").alias("asked"))
    most = F.when(F.length("asked") >= 8, 2).otherwise(1)
    near = vocab.filter("norm <> ''").join(F.broadcast(asked), F.abs(F.length("norm") - F.length("asked")) <= most)
    d = F.when(F.length("asked") >= 8, within(F.col("asked"), F.col("norm"), 2)).otherwise(within(F.col("asked"), F.col("norm"), 1))
    return near.withColumn("d", d).filter("d is not null").select("qid", "term_no", "asked", "norm", "stem", "n", "d")


def completions(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qid, term_no, norm, stem, n, place): the most frequent words that an open term begins, its own stem's left out."""
    opened = terms.filter(F.col("open") & (F.length("norm") >= 2)).select("qid", "term_no", F.col("norm").alias("begun"), F.col("stem").alias("own"))
    met = vocab.join(F.broadcast(opened), F.col("norm").startswith(F.col("begun")) & (F.col("stem") != F.col("own")))
    return met.withColumn("place", F.row_number().over(Window.partitionBy("qid", "term_no").orderBy(F.desc("n"), "norm"))).filter(F.col("place") <= PREFIXES)


def expand(terms: DataFrame, index: IndexTables) -> DataFrame:
    """(qid, term_no, kind, target, weight, why, ord): of each target of a term the heaviest way, of equal ones the first.

    ``terms`` comes from ``described``. Stop and required terms match their own stem alone.
    """
    known = index.frequencies.filter("kind = 'stem'").select(F.col("target").alias("stem"), "df")
    t = terms.join(F.broadcast(known.join(F.broadcast(terms.select("stem").distinct()), "stem", "left_semi")), "stem", "left")
    own = F.col("df").isNotNull()
    rare = F.coalesce(F.col("df"), F.lit(0)) < RARE_DF
    bound = F.col("stop") | F.col("required")
    shape = lambda df, kind, target, weight, why, order, sub: df.select("qid", "term_no", F.lit(kind).alias("kind"), target.alias("target"), weight.cast("double").alias("weight"), F.lit(why).alias("why"), F.lit(order).alias("ord"), sub.cast("int").alias("sub"))
    one, zero = F.lit(1.0), F.lit(0)

    used = index.frequencies.filter("kind = 'code'").select(F.col("target").alias("code"))
    direct = shape(t.filter("code is not null").join(used, "code", "left_semi"), "code", F.col("code"), one, "code", 0, zero)
    worded = t.filter("code is null").drop("code")
    exact = shape(worded.filter(own & (bound | (F.col("norm") != ""))), "stem", F.col("stem"), one, "exact", 0, zero)
    free = worded.filter(~bound & (F.col("norm") != ""))
    content = free.filter(~is_stop(F.col("stem")))
    shared = index.stem_codes.filter(F.col("share") / 255 >= TAG_SHARE)
    tags = shape(shared.join(F.broadcast(content.filter(own & ~rare)), "stem"), "code", F.col("code"), TAG_WEIGHT * F.sqrt(F.col("share") / 255), "code", 1, F.col("place"))
    spelled = index.transliterations.join(F.broadcast(free), "norm").select("qid", "term_no", F.posexplode("codes").alias("place", "c"))
    names = shape(spelled, "code", F.col("c"), one, "code", 2, F.col("place"))
    scale = F.when(rare, SYNONYM_RARE).otherwise(SYNONYM_COMMON)
    alike = shape(index.synonyms.withColumnRenamed("target", "other").join(F.broadcast(content), "stem"), "stem", F.col("other"), scale * F.col("weight") / 100, "synonym", 3, F.col("place"))
    begun = shape(completions(free, index.vocab), "stem", F.col("stem"), F.lit(PREFIX_WEIGHT), "prefix", 4, F.col("place"))
    found = direct.union(exact).union(tags).union(names).union(alike).union(begun)

    lost = free.join(F.broadcast(found.select("qid", "term_no").distinct()), ["qid", "term_no"], "left_anti")
    fixed = distances(lost, index.vocab).withColumn("place", F.row_number().over(Window.partitionBy("qid", "term_no").orderBy("d", F.desc("n"), "norm"))).filter(F.col("place") <= TYPOS)
    typos = shape(fixed, "stem", F.col("stem"), F.when(F.col("d") == 1, TYPO_ONE).otherwise(TYPO_TWO), "typo", 5, F.col("place"))
    best = Window.partitionBy("qid", "term_no", "kind", "target").orderBy(F.desc("weight"), "ord", "sub")
    first = Window.partitionBy("qid", "term_no", "kind", "target")
    ranked = found.union(typos).withColumn("_k", F.row_number().over(best)).withColumn("ord", F.min(F.col("ord") * 1000 + F.col("sub")).over(first))
    return ranked.filter("_k = 1").select("qid", "term_no", "kind", "target", "weight", "why", "ord")


def notes(terms: DataFrame, expansions: DataFrame, index: IndexTables) -> DataFrame:
    """(qid, term_no, note): the first repair of each term that only repairs match, as ``typed → word``."""
    lost = terms.join(F.broadcast(expansions.filter("why = 'typo'").select("qid", "term_no").distinct()), ["qid", "term_no"], "left_semi")
    best = distances(lost, index.vocab).groupBy("qid", "term_no", "asked").agg(F.min(F.struct("d", -F.col("n"), "norm")).alias("best"))
    return best.select("qid", "term_no", F.concat_ws(" → ", "asked", "best.norm").alias("note"))
