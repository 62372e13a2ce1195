"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passageworks.llm import aho_corasick, ball_simhash, ctw, hilbert, iblt, markov, skip_chain, string_kernel, tree_bpe, word_first
from passageworks.llm.common import remainder, table


def op1_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"), 8)


def op3_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return markov.counted(markov.scan(docs, markov.fit_documents(docs)))


def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id never teaches, and its held_out is null."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = string_kernel.fit_documents(docs, table(spark, sf_dir, "labels"), ~held_out)
    return string_kernel.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return skip_chain.scan(docs, skip_chain.fit_documents(docs)).drop("found")


def op6_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_simhash.ball_simhash(table(spark, sf_dir, "documents"), shingle=3)


def op7_word_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id never teaches, and its held_out is null."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = word_first.fit_documents(docs, ~held_out)
    return word_first.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id never teaches, and counts as held out."""
    return ctw.score_documents(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)


def op10_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aho_corasick.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_iblt, op2_hilbert, op3_markov, op4_string_kernel, op5_skip_chain, op6_ball_simhash, op7_word_first, op8_tree_bpe, op9_ctw, op10_aho_corasick)}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The other queries need XXH64, tokenizer files, regular expressions' offsets, quantile sketches or fitted models; plain
#: Python versions in tests/llm stand for SQL there.
SQL: dict[str, str] = {
    "op10_aho_corasick": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM i)),
grams AS (SELECT r, size, k, array_to_string(w[k : k + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM win) s WHERE len(w) >= size)),
met AS (SELECT grams.r, grams.k, grams.size, win.item_id FROM grams JOIN win USING (size, g)),
hits AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS spot FROM met) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""",
}
