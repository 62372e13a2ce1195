"""Ranked passage search over batches of queries: scores, filters, word order, runs, heat and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passageworks.functions.durable import bounded, durable
from passageworks.functions.keyed import each_key
from passageworks.functions.text import flatten, normalize, stem, words
from passageworks.operators.expand import SCORED_TERMS, described, expand, notes
from passageworks.operators.index import IndexTables, corpus_size
from passageworks.plans.query import QueryParser, QueryTables, tables

K1, B = 1.2, 0.5
COVERAGE, STOP_WEIGHT = 1.5, 0.3
CLOSE, ORDER_BONUS = 300, 0.6
MOST_SPAN, SPAN_COST = 4, 0.8
HEAT, HEAT_POWER = 254.0, 0.7
#: Values of a batch that are pushed into a scan as a filter.
PUSHED = 20_000
#: Digits of a score that order results: sums of doubles differ in the last places from plan to plan.
ORDER_DIGITS = 9


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(weight: Column, idf_: Column, tf: Column, dl: Column, average: Column) -> Column:
    return weight * idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def pushed(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose column is one of the values of ``wanted``'s, which the batch bounds: as a filter that the scan takes up to PUSHED values, else by join."""
    values = sorted({r[0] for r in wanted.select(column).distinct().collect()})
    if len(values) <= PUSHED:
        return rows.filter(F.col(column).isin(values))
    return rows.join(F.broadcast(wanted.select(column).distinct()), column, "left_semi")


def term_scores(expansions: DataFrame, index: IndexTables) -> DataFrame:
    """(qid, passage_id, term_no, score, literal): the best way each term matches each passage.

    The targets of the batch are filters of the scans of frequencies and postings, which are written in order of target, so only
    row groups that hold one are read; the expansions are then broadcast.
    """
    n, average = index.size
    e = expansions.filter(F.col("term_no") < SCORED_TERMS)
    weighed = e.join(F.broadcast(pushed(index.frequencies, "target", e)), ["kind", "target"]).withColumn("idf", idf(F.lit(n), F.col("df")))
    met = pushed(index.postings, "target", e).join(F.broadcast(weighed.select("qid", "term_no", "kind", "target", "weight", "why", "idf")), ["kind", "target"])
    scored = met.join(index.lengths.select("passage_id", "dl"), "passage_id").withColumn("score", bm25(F.col("weight"), F.col("idf"), F.col("tf"), F.col("dl"), F.lit(average)))
    return scored.filter("score > 0").groupBy("qid", "passage_id", "term_no").agg(F.max("score").alias("score"), F.max(F.col("why") == "exact").alias("literal"))


def bit(term_no: Column) -> Column:
    return F.expr("shiftleft(1L, term_no)")


def passage_masks(per_term: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, passage_id, content, stop_score, mask, literal): sums over content and stop terms, and which content terms hit."""
    kinds = terms.select("qid", "term_no", "stop")
    joined = per_term.join(F.broadcast(kinds), ["qid", "term_no"])
    return joined.groupBy("qid", "passage_id").agg(
        F.sum(F.when(~F.col("stop"), F.col("score")).otherwise(0.0)).alias("content"),
        F.sum(F.when(F.col("stop"), F.col("score")).otherwise(0.0)).alias("stop_score"),
        F.bit_or(F.when(~F.col("stop"), bit(F.col("term_no"))).otherwise(F.lit(0).cast("bigint"))).alias("mask"),
        F.bit_or(F.when(~F.col("stop") & F.col("literal"), bit(F.col("term_no"))).otherwise(F.lit(0).cast("bigint"))).alias("literal"),
    )


def query_shape(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for each query: masks of content and required terms, their count, and the number of terms."""
    scored = F.col("term_no") < SCORED_TERMS
    shape = terms.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.coalesce(F.bit_or(F.when(scored & ~F.col("stop"), bit(F.col("term_no")))), F.lit(0).cast("bigint")).alias("content_mask"),
        F.coalesce(F.bit_or(F.when(scored & F.col("required"), bit(F.col("term_no")))), F.lit(0).cast("bigint")).alias("required_mask"),
    )
    return queries.join(shape, "qid").withColumn("n_content", F.greatest(F.bit_count("content_mask"), F.lit(1))).withColumn("runs", ~F.col("phrased") & (F.bit_count("content_mask") >= 2))


def excluded_passages(excluded: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, passage_id) of passages that hold an excluded stem or code; unknown words exclude nothing."""
    named = excluded.select("qid", F.when(F.col("code").isNotNull(), "code").otherwise("stem").alias("kind"), F.coalesce("code", stem(normalize(F.col("word")))).alias("target")).distinct()
    return pushed(postings, "target", named).join(F.broadcast(named), ["kind", "target"]).select("qid", "passage_id").distinct()


def candidates(masks: DataFrame, shape: DataFrame, q: QueryTables, index: IndexTables) -> DataFrame:
    """Passages of a content hit that pass exclusions, required terms, scopes and phrases, with their score."""
    rows = masks.join(F.broadcast(shape), "qid").filter((F.col("mask") != 0) & (F.col("mask").bitwiseAND(F.col("required_mask")) == F.col("required_mask")))
    rows = rows.join(excluded_passages(q.excluded, index.postings), ["qid", "passage_id"], "left_anti")
    rows = rows.join(index.lengths.select("passage_id", "coll", "grp"), "passage_id")
    allowed = F.broadcast(q.scopes.withColumn("_in", F.lit(True)))
    rows = rows.join(allowed, ["qid", "coll"], "left").filter(~F.col("scoped") | F.col("_in")).drop("_in")
    asked = q.phrases.groupBy("qid").agg(F.collect_list(flatten(F.col("phrase"))).alias("asked"))
    plain = rows.filter(~F.col("phrased"))
    phrased = rows.filter("phrased").join(F.broadcast(asked), "qid").join(index.passages.select("passage_id", "text"), "passage_id")
    flat = phrased.withColumn("_flat", flatten(F.col("text"))).filter(F.forall("asked", lambda p: F.col("_flat").contains(p)))
    kept = plain.unionByName(flat.select(*plain.columns))
    hit = F.bit_count(F.col("mask").bitwiseAND(F.col("content_mask")))
    return kept.withColumn("score", passage_score(F.col("content"), F.col("stop_score"), hit, F.col("n_content"))).withColumn("full", hit == F.col("n_content")).withColumn("is_literal", F.col("literal").bitwiseAND(F.col("content_mask")) == F.col("content_mask"))


def passage_score(content: Column, stop: Column, hit: Column, n_content: Column) -> Column:
    return content * F.pow(hit / n_content, COVERAGE) + STOP_WEIGHT * stop


def known_stems(terms: DataFrame, index: IndexTables) -> DataFrame:
    return pushed(index.frequencies.filter("kind = 'stem'"), "target", terms.select(F.col("stem").alias("target"))).select(F.col("target").alias("stem"))


def adjacent_pairs(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, pair_no, first_stem, second, pairs): neighbouring query terms whose stems both occur in the text."""
    typed = terms.select("qid", "term_no", "stem", "norm").join(F.broadcast(known.join(F.broadcast(terms.select("stem").distinct()), "stem", "left_semi").withColumn("known", F.lit(True))), "stem", "left")
    order = Window.partitionBy("qid").orderBy("term_no")
    both = typed.withColumn("second", F.lead("stem").over(order)).withColumn("_known", F.col("known") & F.lead("known").over(order)).filter("_known")
    return both.select("qid", F.col("term_no").alias("pair_no"), F.col("stem").alias("first_stem"), "second").withColumn("pairs", F.count(F.lit(1)).over(Window.partitionBy("qid")))


def order_bonus(rows: DataFrame, pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """``rows`` (qid, first, span, ...) with bonus: 1 + 0.6 x the part of the query's pairs found side by side.

    ``rows`` are bounded by the closer look, so their passages are a filter of the scan, and only their texts are stemmed.
    """
    wanted = rows.join(F.broadcast(pairs.select("qid").distinct()), "qid", "left_semi").select("qid", "first", "span").withColumn("passage_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("span") - 1)))
    words_ = pushed(passages, "passage_id", wanted).select("passage_id", F.transform(words(F.col("text")), lambda w: stem(normalize(w))).alias("stems"))
    line = wanted.join(words_, "passage_id").groupBy("qid", "first", "span").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", "stems"))), lambda s: s["stems"])).alias("stems"))
    bigrams = line.withColumn("bigrams", F.zip_with(F.slice("stems", F.lit(1), F.size("stems") - 1), F.slice("stems", F.lit(2), F.size("stems")), lambda a, b: F.concat_ws(" ", a, b))).filter(F.size("stems") > 1)
    found = bigrams.join(F.broadcast(pairs), "qid").groupBy("qid", "first", "span").agg((1 + ORDER_BONUS * F.sum(F.array_contains("bigrams", F.concat_ws(" ", "first_stem", "second")).cast("int")) / F.max("pairs")).alias("bonus"))
    return rows.join(F.broadcast(found), ["qid", "first", "span"], "left").withColumn("bonus", F.coalesce("bonus", F.lit(1.0)))


def run_candidates(seeds: DataFrame, masks: DataFrame, shape: DataFrame, index: IndexTables, excluded: DataFrame) -> DataFrame:
    """(qid, first, span, grp): runs of two to four passages of one group around a seed whose both ends anchor.

    An end anchors if it holds two content terms, one of which the rest of the run lacks. No passage of
    a run is excluded.
    """
    bounds = index.groups.select("coll", "grp", "first_id", "end_id")
    spans = seeds.filter("runs").select("qid", "passage_id", "coll", "grp", F.explode(F.array(*(F.lit(k) for k in range(2, MOST_SPAN + 1)))).alias("span"))
    starts = spans.join(bounds, ["coll", "grp"]).withColumn("first", F.explode(F.sequence(F.greatest(F.col("passage_id") - F.col("span") + 1, F.col("first_id")), F.col("passage_id"))))
    runs = starts.filter(F.col("first") + F.col("span") <= F.col("end_id")).select("qid", "coll", "grp", "first", "span").distinct()
    inside = runs.withColumn("passage_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("span") - 1)))
    hits = inside.join(masks.select("qid", "passage_id", "mask"), ["qid", "passage_id"], "left").join(excluded.withColumn("out", F.lit(True)), ["qid", "passage_id"], "left")
    last = F.col("first") + F.col("span") - 1
    zero = F.lit(0).cast("bigint")
    mask = F.coalesce("mask", zero)
    ends = hits.groupBy("qid", "coll", "grp", "first", "span").agg(
        F.bit_or(F.when(F.col("passage_id") == F.col("first"), mask).otherwise(zero)).alias("a"), F.bit_or(F.when(F.col("passage_id") == last, mask).otherwise(zero)).alias("z"),
        F.bit_or(F.when((F.col("passage_id") > F.col("first")) & (F.col("passage_id") < last), mask).otherwise(zero)).alias("inner"), F.max(F.coalesce("out", F.lit(False))).alias("out"),
    )
    anchors = lambda end, other: (F.bit_count(end) >= 2) & (F.col(end).bitwiseAND(F.bitwise_not(F.col("inner").bitwiseOR(F.col(other)))) != 0)
    return ends.filter(anchors("a", "z") & anchors("z", "a") & ~F.col("out")).select("qid", "coll", "grp", "first", "span")


def run_scores(runs: DataFrame, per_term: DataFrame, terms: DataFrame, shape: DataFrame) -> DataFrame:
    """Runs with score and full: each term's best over the run's passages, and a cost for each passage past the first."""
    inside = runs.withColumn("passage_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("span") - 1)))
    best = inside.join(per_term.select("qid", "passage_id", "term_no", "score"), ["qid", "passage_id"]).groupBy("qid", "coll", "grp", "first", "span", "term_no").agg(F.max("score").alias("score"))
    summed = best.join(F.broadcast(terms.select("qid", "term_no", "stop")), ["qid", "term_no"]).groupBy("qid", "coll", "grp", "first", "span").agg(
        F.sum(F.when(~F.col("stop"), F.col("score")).otherwise(0.0)).alias("content"), F.sum(F.when(F.col("stop"), F.col("score")).otherwise(0.0)).alias("stop_score"), F.count(F.when(~F.col("stop"), 1)).alias("hit")
    )
    whole = summed.join(F.broadcast(shape.select("qid", "n_content")), "qid")
    score = passage_score(F.col("content"), F.col("stop_score"), F.col("hit"), F.col("n_content")) * F.pow(F.lit(SPAN_COST), F.col("span") - 1)
    return whole.withColumn("score", score).withColumn("full", F.col("hit") == F.col("n_content")).select("qid", "coll", "grp", "first", "span", "score", "full")


GREEDY = "qid int, first bigint, span int, score double, full boolean"


def without_overlap(singles: DataFrame, runs: DataFrame) -> DataFrame:
    """Best first, each passage once. Runs never leave their group, so each (query, group) that has one is settled alone.

    Single passages of a group without runs cannot overlap and pass as they are.
    """

    def settle(rows: list[dict]) -> list[tuple]:
        taken, keep = set(), []
        for r in rows:
            inside = range(r["first"], r["first"] + r["span"])
            if taken.isdisjoint(inside):
                taken.update(inside)
                keep.append((r["qid"], r["first"], r["span"], r["score"], r["full"]))
        return keep

    keys = ["qid", "coll", "grp"]
    contested = runs.select(*keys).distinct()
    alone = singles.join(contested, keys, "left_anti").select("qid", "first", "span", "score", "full")
    rows = singles.join(contested, keys, "left_semi").unionByName(runs)
    return alone.union(each_key(rows, keys, [F.desc(F.round("score", ORDER_DIGITS)), F.col("first"), F.col("span")], settle, GREEDY))


@dataclass
class SearchResult:
    """Results of a batch, and what explanation and paging need."""

    results: DataFrame
    candidates: DataFrame
    terms: DataFrame
    expansions: DataFrame
    shape: DataFrame
    runs: DataFrame
    index: IndexTables
    asked: QueryTables
    qids: list[int]

    def heat(self) -> DataFrame:
        """(qid, passage_id, heat): 1 to 255 for each passage of each result."""
        top = self.results.groupBy("qid").agg(F.greatest(F.max("score"), F.lit(1e-6)).alias("top"))
        level = F.when(F.col("is_reference"), 255).otherwise((1 + F.floor(HEAT * F.pow(F.col("score") / F.col("top"), HEAT_POWER))).cast("int"))
        return self.results.join(F.broadcast(top), "qid").withColumn("heat", level).select("qid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("span") - 1)).alias("passage_id"), "heat")

    def dense_heat(self) -> DataFrame:
        """(qid, passage_id, heat) for every passage of the index and query of the batch: 0 where a passage is in no result."""
        hot = self.heat().groupBy("passage_id").agg(F.collect_list(F.struct("qid", "heat")).alias("hot"))
        level = lambda q: F.coalesce(F.array_max(F.transform(F.filter("hot", lambda h: h["qid"] == q), lambda h: h["heat"])), F.lit(0))
        every = F.transform(F.array(*(F.lit(q).cast("int") for q in self.qids)), lambda q: F.struct(q.alias("qid"), level(q).alias("heat")))
        # dealt by passage, and only then laid out for each query: the shuffle holds one row for each passage, not one for each pair
        return self.index.lengths.select("passage_id").join(hot, "passage_id", "left").select("passage_id", F.explode(every).alias("h")).select("h.qid", "passage_id", "h.heat")

    def hints(self) -> DataFrame:
        """(qid, coll, name, first): the collection that a query seems to name, and its first passage."""
        first = self.index.groups.groupBy("coll").agg(F.min("first_id").alias("first"))
        return self.asked.hints.join(self.index.collections.select("coll", "name"), "coll").join(F.broadcast(first), "coll").select("qid", "coll", "name", "first")

    def notes(self) -> DataFrame:
        """(qid, term_no, note): ``typed → word`` of each term that only a repaired spelling matches."""
        return notes(self.terms, self.expansions, self.index)

    def counts(self) -> DataFrame:
        """(qid, total, full_count, literal_count, collections); literal matches are counted before runs take passages in."""
        firsts = self.results.join(self.index.lengths.select(F.col("passage_id").alias("first"), "coll"), "first")
        own = firsts.groupBy("qid").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("full"), 1)).alias("full_count"), F.count_distinct("coll").alias("collections"), F.count(F.when(F.col("is_reference"), 1)).alias("_refs"))
        literal = self.candidates.groupBy("qid").agg(F.count(F.when(F.col("is_literal"), 1)).alias("_literal"))
        return own.join(literal, "qid", "left").select("qid", "total", "full_count", (F.coalesce("_literal", F.lit(0)) + F.col("_refs")).alias("literal_count"), "collections")

    def page(self, offset: int = 0, limit: int = 40) -> DataFrame:
        """One page of each query's results, each with the texts of its passages in order."""
        wanted = self.results.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
        each = wanted.withColumn("passage_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("span") - 1)))
        texts = each.join(self.index.passages.select("passage_id", "coll", "grp", "num", "text"), "passage_id")
        return texts.groupBy("qid", "rank", "first", "span", "score", "full").agg(F.array_sort(F.collect_list(F.struct("passage_id", "coll", "grp", "num", "text"))).alias("passages"))


def reference_rows(references: DataFrame, index: IndexTables) -> DataFrame:
    """(qid, first, span, score, full) of the passages that references name, in their order up to the first that is missing.

    Number 0 stands for 1, so a range from 0 gives passage 1 twice.
    """
    met = index.passages.join(F.broadcast(references.select("coll", "grp").distinct()), ["coll", "grp"], "left_semi").select("coll", "grp", "num", "passage_id")
    most = met.groupBy("coll", "grp").agg(F.max("num").alias("most"))
    wanted = references.join(F.broadcast(most), ["coll", "grp"]).filter(F.col("first") <= F.col("most"))
    each = wanted.select("qid", "coll", "grp", F.explode(F.sequence(F.col("first"), F.least(F.col("last"), F.col("most") + 1))).alias("v")).withColumn("num", F.greatest("v", F.lit(1)))
    found = each.join(met, ["coll", "grp", "num"], "left")
    gap = found.groupBy("qid").agg(F.min(F.when(F.col("passage_id").isNull(), F.col("v"))).alias("gap"))
    whole = found.join(F.broadcast(gap), "qid").filter(F.col("passage_id").isNotNull() & (F.col("gap").isNull() | (F.col("v") < F.col("gap"))))
    return whole.select("qid", F.col("passage_id").alias("first"), F.lit(1).alias("span"), F.lit(1.0).alias("score"), F.lit(True).alias("full"))


def closest(found: DataFrame) -> DataFrame:
    """The candidates that get the closer look: the best of each query by raw score, then id."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", ORDER_DIGITS)), "first"))
    return found.withColumn("place", place).filter(F.col("place") <= CLOSE)


def ordered(kept: DataFrame, canonical: bool = False) -> DataFrame:
    """Results with their rank: by score, or in text order with complete ones first.

    A query may have any number of results: they are ranked inside buckets, cut at quantiles of each query's own scores or
    passages, and the buckets' counts place them.
    """
    keys = [F.desc("full"), F.col("first")] if canonical else [F.desc(F.round("score", ORDER_DIGITS)), F.col("first")]
    value = F.when(F.col("full"), F.col("first")).otherwise(F.col("first") + (1 << 52)).cast("double") if canonical else -F.round("score", ORDER_DIGITS)
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = [k / parts for k in range(1, parts)] or [0.5]
    rows = kept.withColumn("_v", value)
    cuts = rows.groupBy("qid").agg(F.percentile_approx("_v", marks, 10_000).alias("_cuts"))
    dealt = rows.join(F.broadcast(cuts), "qid").withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts", "_v")
    sizes = dealt.groupBy("qid", "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.partitionBy("qid").orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("qid", "_b").orderBy(*keys))
    return dealt.withColumn("_p", place).join(F.broadcast(starts), ["qid", "_b"]).withColumn("rank", (F.col("_start") + F.col("_p")).cast("int")).drop("_b", "_p", "_start")


@dataclass
class Asked:
    """A batch's queries with their terms and everything each may match; bounded by the batch."""

    q: QueryTables
    terms: DataFrame
    expansions: DataFrame


def ask(batch: list[tuple[int, str]], index: IndexTables, parser: QueryParser, *, live: bool = False) -> Asked:
    q = tables(index.passages.sparkSession, batch, parser, live=live, coll_type=dict(index.passages.dtypes)["coll"])
    terms = bounded(described(q.terms))
    return Asked(q, terms, bounded(expand(terms, index)))


def search_many(batch: list[tuple[int, str]], index: IndexTables, parser: QueryParser, *, live: bool = False, canonical: bool = False, asked: Asked | None = None) -> SearchResult:
    """All queries of the batch in one plan: (qid, rank, first, span, score, full, is_reference).

    What any number of passages may match is written once and read from there. The closer look and the runs are bounded by the
    batch (CLOSE passages of each query), so they are kept as rows. ``asked`` is the batch's, if it is there already.
    """
    asked = asked or ask(batch, index, parser, live=live)
    q, terms, expansions = asked.q, asked.terms, asked.expansions
    per_term = durable(term_scores(expansions, index))
    masks = passage_masks(per_term, terms).persist()
    shape = bounded(query_shape(q.queries.filter(~F.col("referred")), terms))
    found = durable(candidates(masks, shape, q, index).withColumn("span", F.lit(1)).withColumn("first", F.col("passage_id")))
    close = bounded(closest(found))
    pairs = bounded(adjacent_pairs(terms, known_stems(terms, index)))
    near = order_bonus(close.select("qid", "first", "span"), pairs, index.passages)
    singles = found.join(F.broadcast(near), ["qid", "first", "span"], "left").withColumn("score", F.col("score") * F.coalesce("bonus", F.lit(1.0))).select("qid", "coll", "grp", "first", "span", "score", "full")
    runs = run_candidates(close, masks, shape, index, excluded_passages(q.excluded, index.postings))
    scored = bounded(run_scores(runs, per_term, terms, shape))
    lined = bounded(order_bonus(scored, pairs, index.passages).withColumn("score", F.col("score") * F.col("bonus")).select("qid", "coll", "grp", "first", "span", "score", "full"))
    kept = durable(without_overlap(singles, lined).withColumn("is_reference", F.lit(False)).union(reference_rows(q.references, index).withColumn("is_reference", F.lit(True))))
    ranked = durable(ordered(kept, canonical))
    masks.unpersist()
    return SearchResult(ranked.select("qid", "rank", "first", "span", "score", "full", "is_reference"), found, terms, expansions, shape, lined, index, q, [qid for qid, _ in batch])
