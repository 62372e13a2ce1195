"""A small tagged text with values worked out by hand from the formulas."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from passageworks.engine import SearchEngine
from passageworks.operators import browse, evaluate, explain, index, layout
from passageworks.sources import marked

TEXT = """PSA\t23\t0\tA Psalm of David.
PSA\t23\t1\tThe {LORD|H3068} [is] my {shepherd|H7462}; I shall not {want|H2637}.
PSA\t23\t2\tHe maketh me to {lie down|H7257} in {green|H1877} {pastures|H4999}: he {leadeth|H5095} me beside the {still|H4496} {waters|H4325}.
JHN\t11\t35\t<{Jesus|G2424} {wept|G1145}.>
"""
LEXICON = "H7462\tra'ah\tra`ah\traw-aw\tprime root; compare H01877 and G26\tto tend\tfeed\nH1877\tdeshe\tdeshe'\tdeh-sheh\t\tgrass\t\nbad\tx\tx\tx\tx\tx\tx\n"
QUERIES = ["jesus wept", "lord waters", "lord shepherd want green pastures waters", '"green pastures"', '"pastures green"', "shepherd -want", "shepherd in:nt", "shepherd in:nowhere", "H7257", "ps 23", "shepherb", "pas*", "", "the", "deshe", "meadow", " ".join(f"word{k}" for k in range(40))]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("marked")
    (folder / "text.tsv").write_text(TEXT)
    (folder / "lexicon.tsv").write_text(LEXICON)
    (folder / "hand.tsv").write_text("# comment\n\nmeadow\tgreen nosuchword\n")
    known = marked.collections(spark)
    passages, titles = marked.read_marked(spark, str(folder / "text.tsv"), known)
    built = index.build(passages, tokens=index.marked_tokens(passages), lexicon=marked.read_lexicon(spark, str(folder / "lexicon.tsv")), synonym_sources=marked.read_hand_synonyms(spark, str(folder / "hand.tsv")), titles=titles, collections=known, scopes=marked.scopes(spark))
    built.write(str(folder / "index"))
    return SearchEngine(index.IndexTables.read(spark, str(folder / "index")))


@pytest.fixture(scope="module")
def found(engine):
    return engine.search_many(list(enumerate(QUERIES)))


@pytest.fixture(scope="module")
def results(found):
    out = {}
    for r in found.results.orderBy("qid", "rank").collect():
        out.setdefault(QUERIES[r["qid"]], []).append((r["first"], r["span"], round(r["score"], 6), r["full"]))
    return out


def test_single(results):
    assert results["jesus wept"] == [(2, 1, 3.983676, True)]


def test_no_run_without_anchors(results):
    assert results["lord waters"] == [(0, 1, 0.346776, False), (1, 1, 0.286090, False)]


def test_run_swallows_its_passages(results):
    assert results["lord shepherd want green pastures waters"] == [(0, 2, 4.811556, True)]


def test_phrases(results):
    assert [r[:2] for r in results['"green pastures"']] == [(1, 1)] and '"pastures green"' not in results


def test_exclusion_and_scope(results):
    assert not {"shepherd -want", "shepherd in:nt", "shepherd in:nowhere", ""} & set(results)


def test_code_reference_prefix_typo_name_synonym(results):
    assert results["H7257"][0][:2] == (1, 1)
    assert results["ps 23"] == [(0, 1, 1.0, True), (1, 1, 1.0, True)]
    assert results["shepherb"] == [(0, 1, pytest.approx(0.8 * 0.980829, abs=2e-6), True)]
    assert results["pas*"] == [(1, 1, pytest.approx(0.85 * 0.809184, abs=2e-6), True)]
    assert results["deshe"][0][:2] == (1, 1) and results["meadow"] == [(1, 1, pytest.approx(0.8 * 0.809184, abs=2e-6), True)]


def test_stop_words_alone_count(results):
    assert [r[0] for r in results["the"]] == [0, 1]


def test_heat_and_counts(found):
    heat = {(r["qid"], r["passage_id"]): r["heat"] for r in found.heat().collect()}
    assert heat[1, 0] == 255 and heat[1, 1] == 222 and heat[9, 0] == 255 and heat[2, 1] == 255
    counts = {r["qid"]: (r["total"], r["full_count"], r["literal_count"], r["collections"]) for r in found.counts().collect()}
    assert counts[0] == (1, 1, 1, 1) and counts[2] == (1, 1, 0, 1) and counts[9] == (2, 2, 2, 1)


def test_results_never_overlap(found):
    for qid in range(len(QUERIES)):
        ids = [r["first"] + k for r in found.results.filter(F.col("qid") == qid).collect() for k in range(r["span"])]
        assert len(ids) == len(set(ids))


def test_page(found):
    page = found.page(limit=1).filter("qid = 2").first()
    assert [p["num"] for p in page["passages"]] == [1, 2]


def test_index_tables(engine):
    own = engine.index
    assert {r["title"] for r in own.titles.collect()} == {"A Psalm of David."}
    tokens = {(r["passage_id"], r["surface"]): (r["flags"], r["codes"]) for r in own.tokens.collect()}
    assert tokens[0, "is"] == (1, []) and tokens[2, "wept"] == (2, ["G1145"]) and tokens[1, "lie"][1] == tokens[1, "down"][1] == ["H7257"] and tokens[0, "The"][1] == []
    assert own.postings.filter("target = 'H7257'").first()["tf"] == 2
    assert {r["norm"] for r in own.transliterations.collect()} == {"raah", "deshe"}
    assert [(r["stem"], r["target"], r["weight"]) for r in own.synonyms.collect()] == [("meadow", "green", 100)]


def test_explanations(engine):
    got = engine.search_many([(0, "shepherb pas* leading meadow")])
    reasons = {r["first"]: r["reasons"] for r in explain.explain(got).collect()}
    flat = [x for r in reasons.values() for x in r]
    assert "shepherb → shepherd (spelling)" in flat and "pas → pastures" in flat and "leading → leadeth" in flat and "meadow ≈ green" in flat
    tokens = explain.result_tokens(got, got.results).drop("first")
    marked_words = explain.marks(tokens, explain.targets(got.expansions, got.terms))
    texts = tokens.select("qid", "passage_id").distinct().join(got.index.passages.select("passage_id", "text"), "passage_id")
    rows = explain.segments(texts, marked_words, got.index.tokens).join(texts, ["qid", "passage_id"]).collect()
    assert rows and all(r["text"] == "".join(s["gap"] + s["word"] for s in r["segments"]) + r["tail"] for r in rows)
    first = next(r for r in rows if r["passage_id"] == 0)["segments"]
    assert [(s["word"], s["flags"], s["codes"]) for s in first if s["word"] in ("is", "shepherd")] == [("is", 1, []), ("shepherd", 0, ["H7462"])]
    assert any(s["why"] == "typo" and s["word"] == "shepherd" for s in first)


def test_segments_of_plain_passages(spark):
    """No offsets in the index, text before the first and after the last word, no words, and no text."""
    texts = ["«Ab’s», cd-ef! (gh) …", "…", "", "x"]
    passages = spark.createDataFrame([(k, "c", 1, k, t) for k, t in enumerate(texts)], "passage_id bigint, coll string, grp int, num int, text string")
    built = index.build(passages)
    marked = spark.createDataFrame([(0, 0, 1, "exact", 0)], "qid int, passage_id bigint, pos int, why string, term_no int")
    rows = explain.segments(passages.select(F.lit(0).alias("qid"), "passage_id", "text"), marked, built.tokens).collect()
    assert {r["passage_id"]: "".join(s["gap"] + s["word"] for s in r["segments"]) + r["tail"] for r in rows} == dict(enumerate(texts))
    assert [(s["word"], s["why"]) for r in rows if r["passage_id"] == 0 for s in r["segments"]] == [("Ab’s", None), ("cd-ef", "exact"), ("gh", None)]


def test_notes_hints_and_gaps(engine):
    got = engine.search_many([(0, "shepherb"), (1, "shepherd"), (2, "john"), (3, "ps 23:0-2"), (4, "ps 23:1-9"), (5, "ps 23:2-9"), (6, "jn 11:35"), (7, "ps 23:9")])
    assert [(r["qid"], r["note"]) for r in got.notes().collect()] == [(0, "shepherb → shepherd")]
    assert [(r["qid"], r["name"], r["first"]) for r in got.hints().collect()] == [(2, "John", 2)]
    first = {}
    for r in got.results.orderBy("rank").collect():
        first.setdefault(r["qid"], []).append(r["first"])
    assert (first[3], first[4], first[5], first[6], first.get(7)) == ([0, 0, 1], [0, 1], [1], [2], None)


def test_the_scan_takes_the_targets(engine, tmp_path):
    """Only row groups of the asked targets are read: the filter stands in the plan of the postings' scan."""
    from passageworks.operators import search

    engine.index.write(f"{tmp_path}/index")
    spark = engine.index.passages.sparkSession
    own = index.IndexTables.read(spark, f"{tmp_path}/index")
    expansions = spark.createDataFrame([(0, 0, "stem", "wept", 1.0, "exact", 0)], "qid int, term_no int, kind string, target string, weight double, why string, ord int")
    plan = search.term_scores(expansions, own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(target,wept)") + plan.count("In(target, [wept])") >= 2, plan


def test_dense_heat(found):
    own = found.dense_heat().filter("qid in (0, 1)").collect()
    assert {(r["qid"], r["passage_id"]): r["heat"] for r in own} == {(0, 0): 0, (0, 1): 0, (0, 2): 255, (1, 0): 255, (1, 1): 222, (1, 2): 0}


def test_ranks_in_buckets(spark):
    import random

    rng = random.Random(2)
    rows = [(q, "c", 1, k, 1, rng.randrange(9) / 4, rng.random() < 0.5) for q in (1, 2, 3) for k in range(rng.randrange(1, 200))]
    frame = spark.createDataFrame(rows, "qid int, coll string, grp int, first bigint, span int, score double, full boolean")
    from passageworks.operators import search

    for canonical, key in ((False, lambda r: (-r[5], r[3])), (True, lambda r: (not r[6], r[3]))):
        wanted = [(q, k + 1, r[3]) for q in (1, 2, 3) for k, r in enumerate(sorted((r for r in rows if r[0] == q), key=key))]
        assert sorted((r["qid"], r["rank"], r["first"]) for r in search.ordered(frame, canonical).collect()) == wanted


def test_browsing(engine):
    own = engine.index
    rows = browse.read_group(own, 1).orderBy("num").collect()
    assert [(r["num"], r["title"], r["previous"], r["next"]) for r in rows] == [(1, "A Psalm of David.", -1, -1), (2, None, -1, -1)]
    spark = own.passages.sparkSession
    near = browse.window(own.passages, own.groups, spark.createDataFrame([(1,)], "passage_id bigint"), 5).collect()
    assert sorted(r["passage_id"] for r in near) == [0, 1]
    entry = browse.lexicon_entries(own, spark.createDataFrame([("H7462",), ("H9999",)], "code string")).orderBy("code").collect()
    assert entry[0]["df"] == 1 and entry[0]["renderings"][0]["norm"] == "shepherd" and entry[1]["lemma"] is None and entry[1]["df"] is None
    assert sorted(tuple(r) for r in browse.cross_links(own.lexicon).collect()) == [("H7462", "G26"), ("H7462", "H1877")]
    asked = spark.createDataFrame([("JHN.11.35",), ("PSA.23",), ("PSA.99.1",)], "address string")
    assert {r["address"]: r["passage_id"] for r in browse.resolve_addresses(asked, own).collect()} == {"JHN.11.35": 2, "PSA.23": 0, "PSA.99.1": -1}
    assert '"num":1' in browse.as_json(own.passages.select("num")).first()["json"]
    steps = {by: sorted((r["passage_id"], r["stepped"]) for r in browse.step_passage(own.passages, own.groups, own.passages.select("passage_id"), by).collect()) for by in (-1, 1, 5)}
    assert steps == {-1: [(0, 0), (1, 0), (2, 2)], 1: [(0, 1), (1, 1), (2, 2)], 5: [(0, 1), (1, 1), (2, 2)]}
    chapter = json.loads(browse.chapter_json(own, 1).first()["json"])
    assert chapter["name"] == "Psalms 23" and chapter["title"] == "A Psalm of David." and [v["id"] for v in chapter["verses"]] == [0, 1] and chapter["prev"] == -1
    entry = json.loads(browse.lexicon_json(own, spark.createDataFrame([("H7462",), ("H9999",)], "code string")).first()["json"])
    assert (entry["code"], entry["verses"], entry["uses"], entry["lang"], entry["renderings"]) == ("H7462", 1, 1, "hebrew", [{"word": "shepherd", "n": 1}])
    assert {name: df.count() for name, df in browse.metadata(own).items()} == {"collections": 66, "groups": 2, "titles": 1, "texts": 3}


def test_evaluation(found):
    spark = found.results.sparkSession
    answers = spark.createDataFrame([(0, 0, 2), (1, 0, 1), (2, 0, 0), (2, 0, 1), (5, 0, 0)], "qid int, answer_no int, passage_id bigint")
    ranks = {r["qid"]: r["rank"] for r in evaluate.ranks(found.results, answers).collect()}
    assert ranks == {0: 1, 1: 2, 2: 1, 5: None}
    rates = evaluate.rates(evaluate.ranks(found.results, answers), spark.createDataFrame([(q, "all") for q in (0, 1, 2, 5)], "qid int, judged string")).first()
    assert (rates["n"], rates["top1"], rates["top3"]) == (4, 2, 3)
    sets = spark.createDataFrame([(q, "all") for q in (0, 1)], "qid int, judged string")
    timed = evaluate.timed(evaluate.rates(evaluate.ranks(found.results, answers), sets), {0: 0.5, 1: 0.7}, sets).first()
    assert (timed["n"], timed["worst"]) == (2, 0.7)


def test_layout(engine):
    boxes = layout.treemap(engine.index.passages, aspect=9.0).collect()
    for level in ("collection", "group", "passage"):
        assert abs(sum(b["w"] * b["h"] for b in boxes if b["level"] == level) - 3.0) < 1e-9
    spark = engine.index.passages.sparkSession
    frame = spark.createDataFrame(boxes, layout.treemap(engine.index.passages).schema)
    assert sorted(r["level"] for r in layout.pick(frame, 0.1, 0.1).collect()) == ["collection", "group", "passage"]
    assert layout.visible(frame, 0.0, 0.0, 3.0, 1.0).count() == len(boxes)
    assert layout.treemap(engine.index.passages.limit(0)).count() == 0
    assert layout.split([], 0, 0, 1, 1) == [] and layout.split([1, 1], 0, 0, 1, 2) == [(0, 0, 1, 1.0), (0, 1.0, 1, 1.0)]


def plain_split(weights, box):
    """By the definition: of all places to cut the one nearest to half of the weight (of two as near the later), across the longer side."""
    x, y, w, h = box
    if len(weights) < 2:
        return [box] * len(weights)
    whole = sum(weights)
    cut = min(range(1, len(weights)), key=lambda k: (abs(2 * sum(weights[:k]) - whole), -k))
    part = sum(weights[:cut]) / whole
    a, b = ((x, y, w * part, h), (x + w * part, y, w * (1 - part), h)) if w >= h else ((x, y, w, h * part), (x, y + h * part, w, h * (1 - part)))
    return plain_split(weights[:cut], a) + plain_split(weights[cut:], b)


def test_treemap_equals_definition(spark):
    """All levels over lines of documents, testaments one below the other whatever the aspect."""
    from passageworks.plans import catalog

    passages = catalog.lines(spark, "/root/testdata/sf0.001")
    order = [r["coll"] for r in passages.groupBy("coll").agg(F.min("passage_id").alias("m")).orderBy("m").collect()]
    sections = spark.createDataFrame([(c, k // 2, k) for k, c in enumerate(order)], "coll string, testament int, section int")
    rows = sorted((r["passage_id"], r["coll"], r["grp"], len(r["text"].encode()) + 30) for r in passages.collect())
    total = sum(r[3] for r in rows)
    top, wanted, at = 0.0, {}, {}
    for t in range((len(order) + 1) // 2):
        colls = order[2 * t : 2 * t + 2]
        share = sum(r[3] for r in rows if r[1] in colls) / total
        for c, box in zip(colls, plain_split([sum(r[3] for r in rows if r[1] == c) for c in colls], (0.0, top, 1.5, share)), strict=True):
            wanted["collection", c] = box
            groups = list(dict.fromkeys(r[2] for r in rows if r[1] == c))
            inside = {g: [r for r in rows if r[1] == c and r[2] == g] for g in groups}
            for g, gbox in zip(groups, plain_split([sum(r[3] for r in inside[g]) for g in groups], box), strict=True):
                wanted["group", c, g] = gbox
                for r, pbox in zip(inside[g], plain_split([r[3] for r in inside[g]], gbox), strict=True):
                    wanted["passage", r[0]] = pbox
        top += share
    for b in layout.treemap(passages, 1.5, sections).collect():
        key = {"collection": ("collection", b["coll"]), "group": ("group", b["coll"], b["grp"]), "passage": ("passage", b["passage_id"])}[b["level"]]
        at[key] = (b["x"], b["y"], b["w"], b["h"])
    assert at.keys() == wanted.keys() and all(abs(p - q) < 1e-9 for k in at for p, q in zip(at[k], wanted[k], strict=True))
