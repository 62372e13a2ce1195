"""What must not grow faster than the input: seen in plans, and held to plain results on odd rows."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from passageworks.functions import text as T
from passageworks.functions.wordlists import IRREGULAR_FORMS
from passageworks.operators import explain
from passageworks.plans import catalog
from passageworks.sources import marked

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_marks_read_tokens_once_and_shuffle_claimed_words_alone(spark):
    lines = plan(catalog.marks_of(spark, FOLDER))
    assert sum("FileScan" in x and "codes" in x for x in lines) == 1
    assert not any("Exchange" in x and "codes" in x for x in lines)


def test_spelling_notes_need_no_search(spark, monkeypatch):
    def searched(*_, **__):
        raise AssertionError("a search ran")

    catalog.forget_searches()
    monkeypatch.setattr(catalog.search, "search_many", searched)
    assert catalog.spelling_notes(spark, FOLDER).count() > 0


def test_markup_of_a_batch_is_packed_a_few_rows_at_a_time():
    rows = ["[" + "{ab|G1,H2} " * 100 + "]"] * 2_000
    marked.parse_all(pa.array(rows[:1]))  # what Arrow imports at first is not counted
    tracemalloc.start()
    got = marked.parse_all(pa.array(rows))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(rows) and got[-1].as_py() == marked.parse_markup(rows[-1])
    assert most < 20e6  # all rows at once take some 100 MB


def test_stems_among_a_few_are_those_of_every_word(spark):
    said = [*IRREGULAR_FORMS, "the", "The's", "thee", "running", "runs", "run", "bodies", "body", "bodi", "blessedst", "xx", "é", "ss"]
    words = spark.createDataFrame([(w,) for w in said], "text string").withColumn("all", F.transform(T.words(F.col("text")), lambda w: T.stem(T.normalize(w))))
    for asked in (["the"], ["run", "body"], ["go", "be", "come"]):
        rows = words.select("all", T.stems_among(F.col("text"), asked).alias("few")).collect()
        assert any(r["few"] for r in rows) and all(r["few"] == [s for s in r["all"] if s in asked] for r in rows)


def test_exclusion_reads_texts_once(spark):
    assert sum("FileScan" in x and "text#" in x for x in plan(catalog.exclude_term(spark, FOLDER))) == 1


def test_line_scores_read_no_text_again(spark):
    assert not any("FileScan" in x and "text#" in x for x in plan(catalog.bm25_documents(spark, FOLDER)))


def test_dense_heat_is_laid_out_after_the_shuffle(spark):
    """The row of each query is made by the last operator: no join or exchange stands above it."""
    lines = plan(catalog.dense_heat(spark, FOLDER))
    first = next(k for k, x in enumerate(lines) if "Generate" in x)
    assert not any("Join" in x or "Exchange" in x for x in lines[:first])


def test_segments_join_whole_texts(spark):
    """A text is cut into words and gaps above the joins, so no join holds these arrays."""
    passages = spark.createDataFrame([(0, 0, "ab cd")], "qid int, passage_id bigint, text string")
    marked_ = spark.createDataFrame([(0, 0, 1, "exact", 0)], "qid int, passage_id bigint, pos int, why string, term_no int")
    lines = plan(explain.segments(passages, marked_))
    join = next(k for k, x in enumerate(lines) if "Join" in x)
    assert not any("regexp_extract_all" in x for x in lines[join:]) and any("regexp_extract_all" in x for x in lines[:join])


def test_reasons_deal_nothing_by_code(spark):
    lexicon = spark.range(1).selectExpr("'G1' AS code", "'x' AS translit")
    marked_ = spark.createDataFrame([(0, 0, 1, "a", 0, "form", None, "b")], "qid int, passage_id bigint, pos int, norm string, term_no int, why string, code string, typed string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not any("hashpartitioning(code" in x for x in plan(explain.reasons(marked_, lexicon)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
