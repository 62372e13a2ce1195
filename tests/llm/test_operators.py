"""Units of the operators: curves, peeling, joins of token sequences, models and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passageworks.llm import aho_corasick, ball_simhash, components, ctw, hilbert, iblt, markov, skip_chain, string_kernel, tree_bpe, word_first
from tests.llm import brute

TENTH = "/root/testdata/sf0.1"


def test_hilbert_steps_are_unit_steps(spark):
    cells = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    rows = sorted(tuple(r) for r in cells.select(hilbert.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3), "x", "y", "z").collect())
    assert [r[0] for r in rows] == list(range(512))
    assert {sum(abs(p - q) for p, q in zip(a[1:], b[1:], strict=True)) for a, b in zip(rows, rows[1:], strict=False)} == {1}


def test_hilbert_shards_prune(spark):
    """A shard spans few languages, though rows come in no order of language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = hilbert.hilbert_shards(docs).join(docs.select("doc_id", "lang"), "doc_id")
    spans = placed.groupBy("shard").agg(F.count_distinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert spans < 4


def test_sketch_recovers_differences():
    rng = np.random.default_rng(1)
    sets = [(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)), np.unique(rng.integers(0, 1 << 63, m, dtype=np.uint64))) for n, m in [(0, 0), (5, 0), (40, 50), (3000, 10), (900, 900)]]
    pairs = [(np.union1d(a, b[:5]), np.union1d(b, a[:7])) for a, b in sets]
    for (a, b), (left, right) in zip(pairs, iblt.differences([p[0] for p in pairs], [p[1] for p in pairs]), strict=True):
        assert set(left.tolist()) == set(a.tolist()) - set(b.tolist()) and set(right.tolist()) == set(b.tolist()) - set(a.tolist())


def test_sketch_fingerprint_ignores_nothing_but_order():
    one, two = iblt.digests("a b.\nc d.\na b."), iblt.digests("c d.\na b.\na b.")
    assert iblt.text_of(iblt.build([one]), 0, 3) == iblt.text_of(iblt.build([two]), 0, 3)
    assert set(iblt.digests("a b.\nc d.").tolist()) != set(one.tolist())


@pytest.mark.parametrize("seed", range(6))
def test_tree_bpe_on_unsplit_text(seed):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(seed)
    bpe = tree_bpe.encoder(leaf=16)
    alphabet = ["ab", "aaaa é", "  \n\t x", "0123456789abcdef", "the ing'sn't", "日本語🙂a-"][seed]
    for size in (0, 1, 15, 16, 17, 40, 333, 5000):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        ids = library.encode(text, add_special_tokens=False).ids
        before = bpe.joins
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == text
        assert size <= 16 or bpe.joins > before


def test_tree_bpe_leaves_run_at_once():
    """Two halves meet at a barrier, which each passes only while the other waits there."""
    import threading

    both, bpe = threading.Barrier(2, timeout=20), tree_bpe.encoder(leaf=16)
    assert bpe.leaves(lambda p: both.wait() and None or [len(p)], ["ab", "c"]) == [[2], [1]]


def test_tree_bpe_on_whole_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = tree_bpe.encoder(leaf=64)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in [*texts, " ".join(texts[:40]), "x" * 5000, " " * 3000, "a  " * 900, "\n\n \t" * 500]:
        assert bpe.encode(text or "") == library.encode(text or "", add_special_tokens=False).ids


def test_tree_bpe_join_equals_whole():
    bpe = tree_bpe.encoder(leaf=16)
    rng = random.Random(5)
    for _ in range(200):
        raw = bytes(rng.choice(b"abcdeingthr") for _ in range(rng.randrange(2, 300)))
        cut = rng.randrange(1, len(raw))
        single = bpe.core.encode_single_piece
        assert bpe.join(single(raw[:cut]), single(raw[cut:])) == single(raw)


def test_ball_links_match_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), flips)) for b in base for flips in (0, 1, 2, 2, 3)} | {0, (1 << 64) - 1, 1 << 63}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    labels = {r["node"] % (1 << 64): r["label"] for r in components.components(ball_simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))).collect()}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 2:
                assert labels[a] == labels[b]
    wanted = brute_components(fps)
    assert len({labels.get(f, ("own", f)) for f in fps}) == wanted


def brute_components(fps) -> int:
    left, count = set(fps), 0
    while left:
        todo, count = [left.pop()], count + 1
        while todo:
            a = todo.pop()
            near = {b for b in left if (a ^ b).bit_count() <= 2}
            left -= near
            todo += near
    return count


def test_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in components.components(edges).collect()} == {0}


def test_blocks_of_the_benchmark_agree(spark, edge_dir):
    docs, items = spark.read.parquet(f"{edge_dir}/documents.parquet"), spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    whole = aho_corasick.decontaminate(docs, items).collect()
    cut = aho_corasick.decontaminate(docs, items, most_words=1).collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut))
    text = next(r["text"] for r in docs.collect() if r["doc_id"] == 10)
    span = next(r["spans"] for r in whole if r["doc_id"] == 10)[0]
    assert text[span["start"] : span["end"]].startswith("One, two-three") and text[span["start"] : span["end"]].endswith("fourteen")


def test_markov_adds_random_strings_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = markov.fit_documents(docs)
    rows = [(1, "key qZ8xK1bP0sT5vLw3RyUe7Jd2Qm end"), (2, "the internationalization_of_everything_here and /usr/local/share/applications/index"), (3, "9233A8ECF7C5B09FE5949719B6B82BC439E9329B")]
    found = {r["doc_id"]: r["spans"] for r in markov.counted(markov.scan(spark.createDataFrame(rows, "doc_id int, text string"), model)).collect()}
    assert found == {1: "markov:4:30", 2: "", 3: "markov:0:40"}


def test_redaction(spark):
    frame = spark.createDataFrame([("é ab cd ef", [(2, 0, 4, "x"), (3, 0, 7, "y"), (8, 0, 10, "x")]), ("none", [])], "t string, f array<struct<start:int,k:int,end:int,kind:string>>")
    assert [r[0] for r in frame.select(markov.redacted(F.col("t"), F.col("f"))).collect()] == ["é [SECRET] [SECRET]", "none"]


def held_out_accuracy(rows, name, wanted):
    good = [r[name] == wanted[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in wanted]
    return sum(good) / len(good)


def test_language_accuracy_held_out(spark):
    from passageworks.llm.queries import op7_word_first

    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{TENTH}/documents.parquet").select("doc_id", "lang").collect()}
    assert held_out_accuracy(op7_word_first(spark, TENTH).collect(), "lang_pred", langs) > 0.98


def test_language_backs_off_to_shorter_grams():
    model = word_first.WordFirst.fit([("en", "the", 9), ("en", "shing", 5), ("de", "der", 9), ("de", "schung", 5)])
    assert model.predict("the")[0] == "en" and model.predict("schunger")[0] == "de" and model.predict("xshingx")[0] == "en"
    assert model.predict("123 !")[0] == "und" and model.predict(None) == ("und", 0.0)


def plain_backoff(rows, text):
    """(language, score) by the definition, in dictionaries: known words by log frequency, others by their longest known n-grams."""
    from math import exp, log

    langs = sorted({r[0] for r in rows})

    def table(counted):
        keys = {k for _, k in counted}
        total = {lang: sum(n for (x, _), n in counted.items() if x == lang) + 0.5 * len(keys) for lang in langs}
        return keys, lambda lang, k: log(counted.get((lang, k), 0) + 0.5) - log(total[lang])

    words = table({(lang, w): n for lang, w, n in rows})
    shorter = {}
    for size in range(5, 0, -1):
        counted = {}
        for lang, w, n in rows:
            for g in word_first.grams(w, size):
                counted[lang, g] = counted.get((lang, g), 0) + n
        shorter[size] = table(counted)
    total = dict.fromkeys(langs, 0.0)
    for word in word_first.words_of(text):
        if word in words[0]:
            mine = {lang: words[1](lang, word) for lang in langs}
        else:
            mine = dict.fromkeys(langs, 0.0)
            for size in range(5, 0, -1):
                found = [g for g in word_first.grams(word, size) if g in shorter[size][0]]
                if found:
                    mine = {lang: sum(shorter[size][1](lang, g) for g in found) / len(found) for lang in langs}
                    break
        total = {lang: total[lang] + mine[lang] for lang in langs}
    best = max(langs, key=lambda lang: total[lang])
    return best, 1 / sum(exp(min(0, total[lang] - total[best])) for lang in langs)


def test_language_scores_equal_definition():
    rng = random.Random(3)
    rows = [(lang, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))), rng.randrange(1, 9)) for lang, letters in (("a", "abcd"), ("b", "bcde"), ("c", "xyzé")) for _ in range(80)]
    rows = [(lang, w, n) for (lang, w), n in {(lang, w): n for lang, w, n in rows}.items()]
    model = word_first.WordFirst.fit(rows)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdexyzéq") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6)))
        lang, score = model.predict(text)
        wanted = plain_backoff(rows, text)
        assert lang == wanted[0] and abs(score - wanted[1]) < 1e-4


def test_sparse_and_whole_tables_agree(monkeypatch):
    rng = random.Random(5)
    items = [(lang, f"w{k}", rng.randrange(1, 99)) for k in range(50) for lang in range(7) if rng.random() < 0.4]
    whole = word_first.Scores.of(items, 7)
    monkeypatch.setattr(word_first, "CELLS", 0)
    sparse = word_first.Scores.of(items, 7)
    assert whole.whole is not None and sparse.whole is None
    for few in ([], [0], [3, 3, 1], list(range(len(whole.row)))):
        assert np.allclose(sparse.total(few), whole.total(few), atol=1e-3)


def test_words_keep_their_marks():
    assert word_first.words_of("हिन्दी भाषा, ภาษาไทย É e\u0301a 12") == ["हिन्दी", "भाषा", "ภาษาไทย", "é", "e\u0301a"]


def test_language_of_scripts_with_marks_held_out(spark):
    words = {"hi": "यह है और में की से को पर नहीं किताब पानी लड़का लड़की स्कूल दिल्ली हिन्दी बोलते खाना घर मेरा".split(), "mr": "हे आहे आणि मध्ये ची पासून ला वर नाही पुस्तक पाणी मुलगा मुलगी शाळा मुंबई मराठी बोलतात जेवण घर माझे".split(), "th": "นี่คือ และ ใน ของ จาก ไม่ หนังสือ น้ำ เด็กชาย เด็กหญิง โรงเรียน กรุงเทพ ภาษาไทย พูด อาหาร บ้าน".split()}
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for k, lang in enumerate(rng.choice(list(words)) for _ in range(300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = word_first.fit_documents(docs, F.col("doc_id") % 3 != 1)
    found = {r["doc_id"]: r["lang_pred"] for r in word_first.identify(docs, model).collect()}
    held = [(k, lang) for k, _, lang in rows if k % 3 == 1]
    assert sum(found[k] == lang for k, lang in held) >= 0.97 * len(held)
    assert model.predict("किताबों")[0] == "hi" and model.predict("पुस्तकात")[0] == "mr" and model.predict("ภาษา")[0] == "th"


def test_more_than_a_thousand_languages(spark):
    own = lambda k: f"own{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)}word"
    rows = [(3 * k, f"{own(k)} same", f"l{k:04d}") for k in range(1101)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = word_first.fit_documents(docs, F.lit(True))
    assert len(model.langs) == 1101
    assert [model.predict(f"{own(k)} same")[0] for k in (0, 999, 1000, 1100)] == ["l0000", "l0999", "l1000", "l1100"]


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels = spark.read.parquet(f"{TENTH}/documents.parquet"), spark.read.parquet(f"{TENTH}/labels.parquet")
    return string_kernel.fit_documents(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def test_toxicity_held_out(spark, toxic_model):
    from passageworks.llm.queries import op4_string_kernel

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{TENTH}/labels.parquet").collect()}
    rows = op4_string_kernel(spark, TENTH).collect()
    assert held_out_accuracy(rows, "predicted", labels) > 0.96
    toxic = [r["predicted"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1]
    assert sum(toxic) / len(toxic) > 0.85


def test_toxicity_tolerates_gaps(toxic_model):
    filler = "Then of reing the onand anly to that erre with hati."
    plain, *broken = toxic_model.scores([filler, f"{filler} pathetic worthless {filler}", f"{filler} path-etic worth*less {filler}", f"{filler} patheetic worthlless {filler}"])
    assert plain < 0.5 and all(b > 0.5 for b in broken)


def test_kernel_windows_equal_landmark_sums():
    texts = ["abcdefghij", " the insul", "insult   a"]
    z = string_kernel.dense([" insult ", " plain "])
    alpha = np.array([0.7, -0.2])
    model = string_kernel.ToxicKernel((alpha @ z).astype(np.float32), 0.0, np.zeros(4))
    direct = string_kernel.kernel(texts, z) @ alpha
    assert abs(direct).max() > 1
    for text, value in zip(texts, direct, strict=True):
        assert abs(model.windows(string_kernel.symbols(text))[0] - value) < 1e-4


def plain_score(model, text):
    """The score by its definition, symbol by symbol."""
    from math import exp, log

    x = string_kernel.symbols(f" {text or ''}" + " " * (string_kernel.WINDOW + 4)).tolist()
    weight = lambda k: sum(string_kernel.DECAY**gap * float(model.weights[(x[k] << 10) | (x[k + i] << 5) | x[k + j]]) for i, j, gap in string_kernel.PATTERNS if k + j < len(x))
    each = [weight(k) for k in range(len(x))]
    values = [sum(each[k : k + string_kernel.WINDOW]) + model.bias for k in range(len(x))]
    heat = sum(max(v, 0) for v in values)
    evidence = [max(-5, min(5, max(values))) - 0.25 * log(len(x) / 1000), log(1 + heat), log(heat / (len(x) / 1000) + 0.05), 1]
    return 1 / (1 + exp(-sum(a * b for a, b in zip(evidence, model.scale, strict=True))))


def test_toxicity_scores_equal_definition(toxic_model):
    for text in [None, "", "the and of", "you pathetic, worthless clown", "Ein Satz. " * 9]:
        assert abs(toxic_model.scores([text])[0] - plain_score(toxic_model, text)) < 1e-3


def test_toxicity_of_planted_insults(spark, toxic_model):
    """One, two or four insults put into clean texts that the model never saw, whole and with a stray character inside."""
    docs = spark.read.parquet(f"{TENTH}/documents.parquet").join(spark.read.parquet(f"{TENTH}/labels.parquet").filter("toxic = 0"), "doc_id")
    held = docs.filter("crc32(cast(doc_id as string)) % 5 = 0 and lang = 'en' and length(text) between 200 and 6000").orderBy("doc_id").limit(200)
    texts, rng = [r["text"] for r in held.collect()], random.Random(1)
    insults = "pathetic idiot worthless disgusting stupid clown scum loser moron".split()

    def planted(text, n, broken):
        words = text.split(" ")
        for _ in range(n):
            word = rng.choice(insults)
            at = rng.randrange(1, len(word))
            words.insert(rng.randrange(len(words)), word[:at] + rng.choice("-*._") + word[at:] if broken else word)
        return " ".join(words)

    caught = {(n, broken): float((toxic_model.scores([planted(t, n, broken) for t in texts]) >= 0.5).mean()) for n in (0, 1, 2, 4) for broken in (False, True)}
    assert caught[0, False] < 0.03 and caught[1, False] > 0.4 and caught[2, False] > 0.8 and caught[4, False] > 0.95 and caught[2, True] > 0.2 and caught[4, True] > 0.7, caught


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet(f"{TENTH}/documents.parquet")
    return skip_chain.fit_documents(docs.filter("crc32(cast(doc_id as string)) % 5 <> 0"))


def test_skip_chain_adds_repeats_of_clear_mentions(spark, field):
    """On texts that the field never saw: bare repeats of their mentions are added, strings of the same form are not."""
    held = spark.read.parquet(f"{TENTH}/documents.parquet").filter("crc32(cast(doc_id as string)) % 5 = 0 and text rlike '[0-9@]'").orderBy("doc_id").collect()
    rng = np.random.default_rng(11)
    wanted = added = right = 0
    for row in held:
        text, repeats = skip_chain.taught(row["text"], rng)
        base = skip_chain.base_spans(text)
        repeats = {(s, k + 4, e) for s, k, e in repeats if not any(a < e and s < b for a, _, b in base)}
        found = set(field.added(text, base))
        wanted, added, right = wanted + len(repeats), added + len(found), right + len(found & repeats)
    assert wanted > 80 and right >= 0.9 * wanted and right >= 0.95 * added, (wanted, added, right)


def test_skip_chain_reaches_across_the_document(field):
    """A repeat after thousands of words and other mentions takes its label, a number without a clear mention does not."""
    text = "call +1 (559) 555-3817 now " + "word 555-0000 here " * 3000 + "or 555-3817 and 555-9911, write jo.81@mail7.example.com or jo.81 but not al.42"
    base = skip_chain.base_spans(text)
    found = {text[s:e] for s, _, e in field.added(text, base)}
    assert found == {"555-3817", "jo.81"}
    assert not field.added("nothing but 555-3817 and jo.81 here", [])
    long = "9" * 90
    assert skip_chain.graph(f"{long}1 {long}2").hubs == 0 and skip_chain.graph(f"{long}1 x {long}1").hubs == 1


def test_skip_chain_marginals_equal_enumeration():
    """On a graph without loops message passing is exact: against the sum over all labellings."""
    from itertools import product

    rng = np.random.default_rng(2)
    model = skip_chain.SkipChain(rng.normal(size=(5, skip_chain.SIZE)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    g = skip_chain.Graph([0, 2, 4, 6], [1, 3, 5, 7], [[1], [2, 3], [4], [5]], np.array([(0, 1)]), np.array([(1, 0), (2, 0), (3, 0)]), 1)
    for known in (np.array([0, 0, 3, 0]), np.zeros(4, int)):
        p = np.zeros((4, 5))
        for *y, hub in product(range(5), repeat=5):
            if not known[2] or (y[2] == 3 and hub == 3):
                z = sum(model.token[y[i], f] for i in range(4) if not known[i] for f in g.features[i]) + model.chain[y[0], y[1]] + sum(model.skip[hub, y[i]] for i in (1, 2, 3))
                for i in range(4):
                    p[i, y[i]] += np.exp(z)
        assert np.allclose(model.marginals(g, known), p / p.sum(axis=1, keepdims=True), atol=1e-3)


def test_base_spans_on_hard_text():
    for text in ["a@b@c.d e@f.g.h", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.0255", "4111-1111 1111 1111 4111111111111112", "+1 (234) 567 8901 +12 +1((((((( 2", "x" * 3000 + "@y.z", "@@@ a@ @b.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0"]:
        assert skip_chain.named(skip_chain.base_spans(text)) == brute.named(brute.personal(text))


def fitted_tree(texts, most=10_000):
    joined, starts = ctw.framed(texts)
    fourth, context, target = ctw.contexts(joined)
    runs = (fourth.astype(np.int64) << 32) | (context.astype(np.int64) << 8) | target
    keep = np.ones(len(runs), bool)
    for start in starts[1:]:
        keep[start - ctw.DEPTH : start] = False
    counts = lambda keys: np.unique(keys, return_counts=True)
    middle, deep = runs[keep] & 0xFFFFFFFF, runs[keep]
    threes = {int(c) for c in counts(middle >> 8)[0][:most]}
    middle = middle[np.isin(middle >> 8, list(threes))]
    deep = deep[np.isin((deep >> 8) & 0xFFFFFF, list(threes))]
    fours = {int(c) for c in counts(deep >> 8)[0][:most]}
    deep = deep[np.isin(deep >> 8, list(fours))]
    return ctw.ContextTree.fit(*counts(deep), *counts(middle), *counts(runs[keep] & 0xFFFFFF)), threes, fours


def direct_score(texts, text, threes, fours):
    """Weighted mixture of one text, from the definition: one binary tree for each bit prefix, by recursion."""
    from functools import lru_cache
    from math import exp, lgamma, log, log10, pi

    seen = []
    for t in texts:
        line = b"\0" * 4 + t + b"\0"
        seen += [(line[k - 4 : k], line[k]) for k in range(4, len(line))]

    def node(context, depth):
        if depth == 3 and int.from_bytes(context[-3:], "big") not in threes:
            return "rest", context[-2:]
        if depth == 4 and int.from_bytes(context, "big") not in fours:
            return "rest", context[-3:]
        return "own", context[4 - depth :]

    def counts(context, depth, prefix):
        name = node(context, depth)
        found = [b for c, b in seen if node(c, depth) == name and f"{b:08b}".startswith(prefix)]
        ones = sum(f"{b:08b}"[len(prefix)] == "1" for b in found)
        return len(found) - ones, ones

    leaf = lambda context, depth: depth == 4 or node(context, depth)[0] == "rest"
    block = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - log(pi) - lgamma(a + b + 1)

    @lru_cache(None)
    def weighted(context, depth, prefix):
        own = block(*counts(context, depth, prefix))
        return own if leaf(context, depth) else log(0.5) + log(exp(own) + exp(under(context, depth, prefix)))

    @lru_cache(None)
    def under(context, depth, prefix):
        children = {node(c, depth + 1): c for c, _ in seen if node(c, depth) == node(context, depth)}
        return sum(weighted(c, depth + 1, prefix) for c in children.values())

    def known(context, depth):
        return depth <= 4 and any(node(c, depth) == node(context, depth) for c, _ in seen)

    def chance(context, depth, prefix):
        a, b = counts(context, depth, prefix)
        own = (b + 0.5) / (a + b + 1)
        if leaf(context, depth) or not known(context, depth + 1):
            return own
        share = 1 / (1 + exp(under(context, depth, prefix) - block(a, b)))
        return share * own + (1 - share) * chance(context, depth + 1, prefix)

    line, total = b"\0" * 4 + text + b"\0", 0.0
    for k in range(4, len(line)):
        byte = f"{line[k]:08b}"
        for bit in range(8):
            one = chance(line[k - 4 : k], 0, byte[:bit])
            total += log10(one if byte[bit] == "1" else 1 - one)
    return total


@pytest.mark.parametrize("most", [10_000, 7])
def test_context_tree_equals_definition(most):
    texts = [b"abracadabra", b"the cat sat on the mat", b"", b"\0a"]
    tree, threes, fours = fitted_tree(texts, most)
    assert np.allclose((10.0 ** tree.table.astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    asked = [b"abra cat", b"the dog", b"", "é".encode()]
    for text, score in zip(asked, tree.scores(asked, tree.rows()), strict=True):
        assert abs(score - direct_score(texts, text, threes, fours)) < 1e-3


@pytest.mark.parametrize("most", [10_000, 7])
def test_scores_have_every_context(spark, most):
    """However few contexts travel with the texts, scores are those of the tree in which every context has its own node."""
    texts = [b"abracadabra", b"the cat sat on the mat", b"", b"the bra"]
    _, threes, fours = fitted_tree(texts)
    asked = ["abra cat", "the dog", "zabrac", "é"]
    rows = [(k, t.decode()) for k, t in enumerate(texts)] + [(10 + k, t) for k, t in enumerate(asked)]
    found = ctw.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 10, most=most)
    for row in found.collect():
        assert abs(row["score"] - direct_score(texts, dict(rows)[row["doc_id"]].encode(), threes, fours)) < 1e-3


def test_pipeline_stages(spark):
    """Each stage against plain Python, on what its predecessor kept."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "copies", "benchmark", "secrets", "tokens"]
    kept = stages["language"](spark, docs, folder)
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))
    unique = stages["copies"](spark, kept, folder)
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in rows}
    stay = {r["doc_id"] for r in unique.collect()}
    assert len({tuple(texts[i]) for i in stay}) == len(stay)
    gone = {tuple(t) for t in texts.values()} - {tuple(texts[i]) for i in stay}
    grams = lambda t: {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))}
    for t in gone:
        assert any(len(grams(t) & grams(u)) >= 0.8 * len(grams(t) | grams(u)) for u in {tuple(x) for x in texts.values()} - {t})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    fair = stages["benchmark"](spark, unique, folder)
    found = brute.contamination([(r["doc_id"], r["text"]) for r in unique.collect()], items)
    assert sorted(r["doc_id"] for r in fair.collect()) == sorted(f[0] for f in found if not f[2])
    safe = stages["secrets"](spark, fair, folder)
    for r in safe.collect():
        assert not brute.secrets(r["text"]) and r["n_chars"] == len(r["text"])
    assert safe.count() == fair.count()
    for stage in (kept, unique, fair, safe):
        assert stage.columns == columns
    ids = stages["tokens"](spark, safe, folder)
    assert {r["doc_id"]: r["decoded_sha256"] for r in ids.collect()} == {r["doc_id"]: brute.sha(r["text"]) for r in safe.collect()}


def test_benchmark_stage_drops_a_long_text_with_one_passage(spark, edge_dir):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, "filler words " * 4000 + passage + " more filler" * 4000, "en", "s", 1), (2, "filler words " * 4000, "en", "s", 1), (3, None, None, None, None), (4, passage[4:], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, edge_dir).collect()) == [2, 3, 4]


def test_pipeline_runs_on_edge_cases(spark, edge_dir, empty_dir):
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, edge_dir).collect()}
    assert kept == {1, 7, 8, 12, None}
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_hilbert_cuts_whole_strings(spark):
    """Values that share a long prefix still fall into bins of their own, in order, by exact counts."""
    rows = [(k, "x", "en", f"https://site{k % 40:02d}.example.org/") for k in range(800)] + [(None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    edges = hilbert.value_edges(docs, "source", 8)
    assert edges == [f"https://site{k:02d}.example.org/" for k in (4, 9, 14, 19, 24, 29, 34)]
    assert hilbert.value_edges(docs.filter("doc_id % 40 < 1 or doc_id % 40 = 7"), "source", 8) == ["https://site00.example.org/"] * 4 + ["https://site07.example.org/"] * 3
    assert hilbert.value_edges(docs.limit(0), "source", 8) == []
    curves = {}
    for r in hilbert.placed(docs, 4, "doc_id", "text", ("lang", "source"), 5, ("source",)).collect():
        curves.setdefault(r["keep0"], set()).add(r["curve"])
    assert all(len(c) == 1 for c in curves.values()) and len({c for s in curves.values() for c in s}) >= 32


def test_hilbert_shards_lose_and_double_no_row(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, None), (None, None)] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", "clash", 5) for i, t in rows], "doc_id bigint, text string, lang string, source string, shard string, slot int")
    hilbert.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(str(tuple(r)) for r in back.select("doc_id", "text", "lang", "source", "shard_", "slot").collect()) == sorted(str(tuple(r)) for r in docs.collect())
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [5, 5, 5, 6]


def test_spans_of_long_texts_overlap_as_by_all_pairs(spark):
    rng = random.Random(2)
    others, at = [], 0
    for _ in range(700):
        at += rng.randrange(1, 9)
        others.append((at, at := at + rng.randrange(1, 6)))
    spans = [(k, k + rng.randrange(1, 7)) for k in range(0, at, 3)]
    frame = spark.createDataFrame([(spans, others)], "s array<struct<start:int,end:int>>, o array<struct<start:int,end:int>>")
    found = frame.select(F.transform("s", lambda s: markov.meets_any(s, F.col("o")))).first()[0]
    assert found == [any(a < e and s < b for a, b in others) for s, e in spans]
    spans.sort()
    text = "".join(rng.choice("abcé") for _ in range(at + 20))
    runs = []
    for s, e in spans:
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    out, last = [], 0
    for s, e in runs:
        out += [text[last:s], "[SECRET]"]
        last = e
    frame = spark.createDataFrame([(text, [(s, 0, e, "x") for s, e in spans])], "t string, f array<struct<start:int,k:int,end:int,kind:string>>")
    assert frame.select(markov.redacted(F.col("t"), F.col("f"))).first()[0] == "".join(out) + text[last:]


def test_fingerprints_of_any_ids(spark):
    """String ids, an id that most rows share and rows without one: the successor is the next row in descending order."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + [None, *"abcxyz"]), f"text {k}. of many parts {rng.random()}.") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    order = [(r["doc_id"], r["text"]) for r in sorted(docs.selectExpr("*", "xxhash64(text) AS h").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or "", ~r["h"]), reverse=True)]
    found = {r["edited_sha256"]: r["doc_id"] for r in iblt.fingerprint_edits(docs).collect()}
    wanted = {brute.sha(iblt.edited(t, order[(k + 1) % len(order)][1])): i for k, (i, t) in enumerate(order)}
    assert len(found) == 300 and found == wanted


def test_sketch_grows_until_it_peels():
    rng = np.random.default_rng(5)
    left, right = (np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)) for _ in range(2))
    ((a, b),) = iblt.differences([left], [right])
    assert len(a) == len(left) and len(b) == len(right)
