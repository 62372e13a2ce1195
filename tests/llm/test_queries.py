"""Every operator's query against plain Python, on edge cases, empty tables and the smallest tables."""

from __future__ import annotations

import zlib

import pytest
from tests.llm import brute

from passageworks.llm import iblt
from passageworks.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def run(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(found, wanted):
    assert sorted(found, key=key) == sorted(wanted, key=key)


@pytest.fixture(params=["edge", "small"])
def folder(request, edge_dir):
    return edge_dir if request.param == "edge" else SMALL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert run(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_returned_once(spark, edge_dir, name):
    same([(r["doc_id"],) for r in run(spark, name, edge_dir)], [(i,) for i, _ in documents(spark, edge_dir)])


def test_op1(spark, folder):
    by_hash = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    rows = [(r["doc_id"], r["text"]) for r in sorted(by_hash, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))]
    wanted = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        part = len(text) // 3
        changed = text[: len(text) - part] + after[:part]
        own, new, nxt = (set(iblt.digests(t).tolist()) for t in (text, changed, after))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        wanted.append((i, len(text), brute.sha(changed), round(like(own, new), 9), round(like(own, nxt), 9)))
    found = run(spark, "op1_iblt", folder)
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found], wanted)
    texts = dict(documents(spark, folder))
    prints = {}
    for r in found:
        prints.setdefault(texts[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_op2(spark, folder):
    found = run(spark, "op2_hilbert", folder)
    texts = documents(spark, folder)
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in found], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts])
    sizes = [sum(r["shard"] == k for r in found) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and {r["law"] for r in found} == {"rows"} and {r["grown_shard"] for r in found} == {None}
    for k in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sizes[k]))
    ordered = [r["curve"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)


def test_op3(spark, folder):
    wanted = []
    for i, text in documents(spark, folder):
        spans = brute.secrets(text)
        wanted.append((i, *(sum(s[3] == kind for s in spans) for kind in ("assign", "access", "hex")), brute.sha(brute.named(spans))))
    found = run(spark, "op3_markov", folder)
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found], wanted)
    texts = {i: t for i, t in documents(spark, folder)}
    for r in found:
        assert set(brute.named(brute.secrets(texts[r["doc_id"]])).split(",")) <= set(r["spans"].split(",")) | {""}


def test_op4(spark, folder):
    for r in run(spark, "op4_string_kernel", folder):
        assert r["held_out"] == (None if r["doc_id"] is None else brute.remainder(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op5(spark, folder):
    wanted = []
    for i, text in documents(spark, folder):
        spans = brute.personal(text)
        wanted.append((i, *(sum(s[3] == kind for s in spans) for kind in ("email", "ip", "card", "phone")), brute.sha(brute.named(spans))))
    found = run(spark, "op5_skip_chain", folder)
    same([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found], wanted)


def test_op6(spark, folder):
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op6_ball_simhash", folder)], brute.classes(documents(spark, folder)))


def test_op7(spark, folder):
    texts = documents(spark, folder)
    known = {None if t is None else any(c.isalpha() for c in t) for _, t in texts}
    assert known
    by_id = {i: t for i, t in texts}
    for r in run(spark, "op7_word_first", folder):
        lettered = any(c.isalpha() for c in by_id[r["doc_id"]] or "")
        assert (r["lang_pred"] != "und") == lettered and 0 <= r["score"] <= 1


def test_op8(spark, folder):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    wanted = []
    for i, text in documents(spark, folder):
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False))))
    same([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op8_tree_bpe", folder)], wanted)


def test_op9(spark, folder):
    found = run(spark, "op9_ctw", folder)
    same([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found], [(*w[:4], round(w[4], 5)) for w in brute.unigram(documents(spark, folder))])
    assert all(r["score"] <= 0 for r in found)


def test_op10(spark, folder):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = run(spark, "op10_aho_corasick", folder)
    same([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found], brute.contamination(documents(spark, folder), items))
