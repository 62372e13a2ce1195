"""Why a passage matched: marked words, short reasons, and segments for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passageworks.functions.text import WORD, words
from passageworks.operators.search import SearchResult

CODE_FACTOR, REASONS = 0.99, 4


def targets(expansions: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, kind, target, term_no, weight, why, typed, stop): the term that claims each target; heavier first, then earlier."""
    best = Window.partitionBy("qid", "kind", "target").orderBy(F.desc("weight"), "term_no")
    claimed = expansions.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k", "ord")
    return claimed.join(F.broadcast(terms.select("qid", "term_no", F.col("norm").alias("typed"), "stop")), ["qid", "term_no"])


def marks(tokens: DataFrame, claimed: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, passage_id, pos, norm, term_no, why, code, typed) of matched words.

    A word matches by its stem, or a little less by a code. An exact match of another form is ``form``; a match of a
    stop term is ``stop``. ``tokens`` carries qid, stem and codes; with ``pairs`` (qid, passage_id) the tokens are those of the index,
    and a word meets the claims, which the batch bounds, before it meets the passages: words that no query claims are never shuffled.
    """
    code = F.col("kind") == "code"
    claims = claimed.select("qid", F.struct("kind", "target").alias("key"), "term_no", F.when(code, F.col("weight") * CODE_FACTOR).otherwise(F.col("weight")).alias("weight"), "why", "typed", "stop")
    keys = F.concat(F.array(F.struct(F.lit("stem").alias("kind"), F.col("stem").alias("target"))), F.transform(F.coalesce("codes", F.array().cast("array<string>")), lambda c: F.struct(F.lit("code").alias("kind"), c.alias("target"))))
    own = [] if pairs is not None else ["qid"]
    each = tokens.select(*own, "passage_id", "pos", "norm", F.posexplode(keys).alias("place", "key"))
    met = each.join(F.broadcast(claims), [*own, "key"])
    if pairs is not None:
        met = met.join(pairs.select("qid", "passage_id").distinct(), ["qid", "passage_id"])
    by_stem = F.col("key.kind") == "stem"
    why = F.when(by_stem & F.col("stop"), "stop").when(by_stem & (F.col("why") == "exact") & (F.col("norm") != F.col("typed")), "form").otherwise(F.col("why"))
    first = Window.partitionBy("qid", "passage_id", "pos").orderBy(F.desc("weight"), "place")
    best = met.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    return best.select("qid", "passage_id", "pos", "norm", "term_no", why.alias("why"), F.when(~by_stem, F.col("key.target")).alias("code"), "typed")


def result_marks(found: SearchResult, results: DataFrame) -> DataFrame:
    """Marks of every passage of ``results``, once for each query that has it."""
    return marks(found.index.tokens, targets(found.expansions, found.terms), result_passages(results))


def reason(lexicon_name: Column) -> Column:
    arrow = F.concat_ws(" → ", "typed", "norm")
    return (
        F.when(F.col("why").isin("form", "prefix"), arrow)
        .when(F.col("why") == "typo", F.concat(arrow, F.lit(" (spelling)")))
        .when(F.col("why") == "synonym", F.concat_ws(" ≈ ", "typed", "norm"))
        .when((F.col("why") == "code") & (F.col("norm") != F.col("typed")), F.concat(arrow, F.lit(" ("), F.coalesce("code", F.lit("")), F.lit(" "), F.coalesce(lexicon_name, F.lit("")), F.lit(")")))
    )


def reasons(marked: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("qid", "passage_id")) -> DataFrame:
    """(…keys, reasons): at most four distinct reasons in word order; over the passages of a run if ``keys`` say so."""
    # sent whole, as it does not grow with the text: dealt by code, all words marked by their stem (code null) would meet in one task
    named = marked.join(F.broadcast(lexicon.select("code", "translit")), "code", "left").withColumn("reason", reason(F.col("translit"))).filter("reason is not null")
    first = named.groupBy(*keys, "reason").agg(F.min(F.struct("passage_id", "pos")).alias("at"))
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).filter(F.col("_k") <= REASONS)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "reason"))), lambda s: s["reason"]).alias("reasons"))


def result_passages(results: DataFrame) -> DataFrame:
    """(qid, first, passage_id) of every passage of ``results``."""
    return results.select("qid", "first", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("span") - 1)).alias("passage_id"))


def result_tokens(found: SearchResult, results: DataFrame) -> DataFrame:
    """Tokens of every passage of ``results`` with qid and first."""
    return found.index.tokens.join(result_passages(results), "passage_id")


def explain(found: SearchResult, limit: int = 40) -> DataFrame:
    """(qid, first, reasons) of the best ``limit`` results of each query, merged over the passages of a run."""
    shown = found.results.filter(F.col("rank") <= limit)
    return reasons(result_marks(found, shown).join(result_passages(shown).distinct(), ["qid", "passage_id"]), found.index.lexicon, ("qid", "first"))


def segments(passages: DataFrame, marked: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(qid, passage_id, segments, tail): each word with the text before it, flags, codes, and how it matched; tail follows the last word.

    ``passages`` has qid, passage_id and text; words and gaps are cut from the text, so any index will do. Flags and codes come from ``tokens``.
    """
    keys = ["qid", "passage_id"]
    how = marked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("why", "term_no")))).alias("_how"))
    cut = passages.select(*keys, "text").join(how, keys, "left")
    tagged = F.lit(None).cast("map<int,struct<flags:tinyint,codes:array<string>>>")
    if tokens is not None:
        own = tokens.join(passages.select("passage_id").distinct(), "passage_id", "left_semi").groupBy("passage_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("flags", "codes")))).alias("_tags"))
        cut, tagged = cut.join(own, "passage_id", "left"), F.col("_tags")

    # the text is cut after the joins, so that they hold it once and not as arrays of its words and gaps
    cut = cut.withColumn("_w", words(F.col("text"))).withColumn("_g", F.split("text", WORD, -1))

    def segment(word: Column, pos: Column) -> Column:
        tag, mark = F.try_element_at(tagged, pos), F.try_element_at(F.col("_how"), pos)
        return F.struct(
            pos.alias("pos"), F.get("_g", pos).alias("gap"), word.alias("word"), F.coalesce(tag["flags"], F.lit(0).cast("tinyint")).alias("flags"),
            F.coalesce(tag["codes"], F.array().cast("array<string>")).alias("codes"), mark["why"].alias("why"), mark["term_no"].alias("term_no"),
        )

    return cut.select(*keys, F.transform("_w", segment).alias("segments"), F.get("_g", F.size("_w")).alias("tail"))
