from __future__ import annotations

import pytest

from passageworks.plans.query import QueryParser

PARSER = QueryParser()
CODES = [c.code for c in PARSER.collections]


@pytest.mark.parametrize(("typed", "code"), [("jn", "JHN"), ("1 cor", "1CO"), ("I Corinthians", "1CO"), ("phil", "PHP"), ("Song of Solomon", "SNG"), ("rev", "REV"), ("jo", None), ("1 john", "1JN"), ("", None)])
def test_find(typed, code):
    found = PARSER.find(typed)
    assert (None if found is None else CODES[found]) == code


@pytest.mark.parametrize(("typed", "wanted"), [("jn 3:16", ("JHN", 3, 16, 16)), ("1 cor 13:4-7", ("1CO", 13, 4, 7)), ("ps23", ("PSA", 23, 1, 999)), ("1 john", None), ("love", None), ("gen 1-2", None), ("gen1.1", ("GEN", 1, 1, 1)), ("is 40", ("ISA", 40, 1, 999)), ("jn 3:9-2", ("JHN", 3, 9, 9))])
def test_reference(typed, wanted):
    found = PARSER.reference(typed)
    assert (found and (CODES[found.coll], found.grp, found.first, found.last)) == wanted


def test_phrases_and_marks():
    q = PARSER.parse('green “still waters” -want in:nt past* "open ended')
    assert q.phrases == ["still waters", "open ended"] and [i.word for i in q.excluded] == ["want"]
    assert [(i.word, i.required, i.open) for i in q.items] == [("still", True, False), ("waters", True, False), ("open", True, False), ("ended", True, False), ("green", False, False), ("past", False, True)]
    assert len(q.scope) == 27


def test_scope_of_unknown_name_is_empty():
    assert PARSER.parse("love in:nowhere").scope == []
    assert len(PARSER.parse("love in:ot in:jn").scope) == 40


def test_live_typing_leaves_the_last_word_open():
    assert [i.open for i in PARSER.parse("green past", live=True).items] == [False, True]
    assert [i.open for i in PARSER.parse("green past ", live=True).items] == [False, False]


def test_codes_and_hint():
    q = PARSER.parse("H07257 waters")
    assert q.items[0].code == "H7257" and q.reference is None
    assert CODES[PARSER.parse("genesis").hint] == "GEN" and PARSER.parse('"x" jn 3:16').reference is None
