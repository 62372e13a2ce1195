from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from passageworks.functions.ordering import carried, dense_ids
from passageworks.sources import marked
from passageworks.streaming.latest import newest


def test_markup():
    got = marked.parse_markup("a {b c|H1,H2} [d [e]] <f")
    assert got["text"] == "a b c d e f" and got["spans"] == [{"start": 2, "end": 5, "codes": ["H1", "H2"]}]
    assert got["italic"] == [{"start": 8, "end": 9}, {"start": 6, "end": 9}] and got["red"] == [{"start": 10, "end": 11}]
    for bad in ("[a", "{a", "a>"):
        with pytest.raises(ValueError, match="mark|unopened"):
            marked.parse_markup(bad)


def test_stripped(spark):
    assert spark.range(1).select(marked.stripped(F.lit("The {LORD|H1} [is] <x>"))).first()[0] == "The LORD is x"


def test_unknown_collection_is_an_error(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("ZZZ\t1\t1\ttext\n")
    with pytest.raises(Exception, match="unknown collection ZZZ"):
        marked.read_marked(spark, str(tmp_path / "x.tsv"), marked.collections(spark))[0].collect()


def test_synonym_files(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("tired\tweary:80 worn:20 faint:30\n")
    assert [tuple(r) for r in marked.read_weighted_synonyms(spark, str(tmp_path / "w.tsv")).collect()] == [("tired", "weary", 80), ("tired", "faint", 30)]


def test_usfm(spark):
    lines = [r"\c 1", r"\d A song", r"\v 1 \w In|strong=\"H0007\"\w* the \add very\add* start\f + note\f*", r"\q1 it was", r"\v 2 \wj Yes\wj*"]
    frame = spark.createDataFrame([(0, k, line.replace('\\"', '"')) for k, line in enumerate(lines)], "coll int, line int, value string")
    assert sorted((r["num"], r["text"]) for r in marked.usfm_verses(frame).collect()) == [(0, "A song"), (1, "{In|H7} the [very] start it was"), (2, "<Yes>")]


def test_senses_and_outside_text(spark):
    senses = spark.createDataFrame([("glad", 0, "happy", False), ("glad", 2, "happy", False), ("glad", 0, "merry", True), ("glad", 0, "glad", False), ("glad", 0, "a-b", False)], "key string, sense_rank int, word string, similar boolean")
    assert {r["word"]: r["weight"] for r in marked.weighted_senses(senses).collect()} == {"happy": 100, "merry": 60}
    passages = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 1, 2)], "passage_id bigint, coll int, grp int, num int")
    outside = spark.createDataFrame([(0, 1, "[1] one [2] two [3] three")], "coll int, grp int, text string")
    assert {r["passage_id"]: r["other"] for r in marked.join_outside(passages, outside).collect()} == {0: "one", 1: "two three"}
    said = spark.range(1).select(marked.spoken(F.lit("¶ AND the LORD's ARMY-MAN said: I ¶")), marked.spoken(F.lit("GO"), F.lit("Genesis 1")), marked.spoken(F.lit("GO"), F.lit(None).cast("string"))).first()
    assert tuple(said) == ("And the Lord's Army-Man said: I ¶", "Genesis 1. Go", "Go")
    groups = spark.createDataFrame([(0, 3, 17)], "coll int, grp int, first_id bigint")
    assert [tuple(r) for r in marked.headings(groups, marked.collections(spark)).collect()] == [(17, "Genesis 3")]


def test_titles_go_to_the_next_passage(spark, tmp_path):
    """Also across groups; of several titles in a row the last counts; a compressed file reads the same."""
    import gzip

    text = "".join(f"GEN\t{g}\t{n}\ttext {g} {n}\n" for g in range(1, 60) for n in range(0 if g % 3 == 0 else 1, 4)).replace("GEN\t7\t1\ttext 7 1\nGEN\t7\t2\ttext 7 2\nGEN\t7\t3\ttext 7 3\n", "GEN\t7\t0\tlone [title]\n")
    (tmp_path / "x.tsv").write_text(text)
    with gzip.open(tmp_path / "y.tsv.gz", "wt") as out:
        out.write(text)
    wanted, pending, passages = {}, None, []
    for line in text.splitlines():
        _, g, n, words = line.split("\t")
        if n == "0":
            pending = words
            continue
        if pending:
            wanted[len(passages)] = pending.replace("[", "").replace("]", "")
            pending = None
        passages.append((len(passages), int(g), int(n)))
    for name in ("x.tsv", "y.tsv.gz"):
        read, titles = marked.read_marked(spark, str(tmp_path / name), marked.collections(spark))
        assert sorted((r["passage_id"], r["grp"], r["num"]) for r in read.collect()) == passages
        assert {r["passage_id"]: r["title"] for r in titles.collect()} == wanted


def test_carried_values(spark):
    import random

    rng = random.Random(4)
    rows = [(p, k, rng.choice([None, None, None, k])) for p in "ab" for k in range(300)]
    frame = spark.createDataFrame(rows, "p string, k bigint, v bigint")
    last, wanted = {}, []
    for p, k, v in rows:
        last[p] = v if v is not None else last.get(p)
        wanted.append((p, k, last[p]))
    assert sorted(tuple(r) for r in carried(frame, "p", "k", c=F.col("v")).select("p", "k", "c").collect()) == wanted


def test_build_command(spark, tmp_path, capsys):
    from passageworks import build_index

    (tmp_path / "text.tsv").write_text("GEN\t1\t1\tIn the {beginning|H7225}\nGEN\t1\t2\tthe earth\n")
    (tmp_path / "lexicon.tsv").write_text("H7225\tl\treshith\tp\td\tdef\tuse\n")
    (tmp_path / "weighted.tsv").write_text("soil\tearth:80\n")
    (tmp_path / "hand.tsv").write_text("# none\nstart\tbeginning\n")
    assert build_index.build(spark, str(tmp_path), str(tmp_path / "out")) == {"passages": 2, "words": 5, "surface forms": 4, "stems": 4, "synonym keys": 2}
    assert build_index.main([]) == 2 and "usage" in capsys.readouterr().err


def test_dense_ids(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 97).alias("a"), F.col("id").alias("b")).union(spark.createDataFrame([(None, 1)], "a bigint, b bigint"))
    got = [tuple(r) for r in dense_ids(rows, ["a", "b"], "k").orderBy("k").select("k", "a", "b").collect()]
    assert [r[0] for r in got] == list(range(501)) and [r[1:] for r in got[1:]] == sorted(r[1:] for r in got[1:]) and got[0][1] is None


def test_newest(spark):
    waiting = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 3, "c")], "user_id bigint, event_id bigint, typed string")
    assert sorted(tuple(r) for r in newest(waiting).select("user_id", "event_id", "typed").collect()) == [(1, 9, "b"), (2, 3, "c")]


def test_stream_answers_newest(spark, tmp_path):
    from passageworks.engine import SearchEngine
    from passageworks.operators import index
    from passageworks.plans.query import QueryParser
    from passageworks.streaming.latest import answer_newest

    passages = spark.createDataFrame([(0, "a", 1, 1, "green pastures"), (1, "a", 1, 2, "still waters")], "passage_id bigint, coll string, grp bigint, num int, text string")
    engine = SearchEngine(index.build(passages).stored(), QueryParser([]))
    spark.createDataFrame([(7, 1, "green"), (7, 2, "waters")], "user_id bigint, event_id bigint, typed string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id bigint, event_id bigint, typed string").parquet(str(tmp_path / "in"))
    seen = []
    query = answer_newest(stream, engine, lambda rows, _: seen.extend(tuple(r) for r in rows.select("user_id", "first").collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert seen == [(7, 1)]
