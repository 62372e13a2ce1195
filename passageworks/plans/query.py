"""The query language: words, "phrases", prefix*, -exclusions, in:scopes, references and concept codes.

One query string is parsed on the driver; a batch of them becomes small DataFrames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from passageworks.functions.wordlists import COLLECTIONS, SCOPES

WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CODE = re.compile(r"([HhGg])\+?0*([1-9][0-9]{0,3})")
ORDINALS = {"iii": "3", "ii": "2", "i": "1", "first": "1", "second": "2", "third": "3"}


@dataclass(frozen=True)
class Collection:
    coll: object
    code: str
    name: str
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reference:
    coll: object
    grp: int
    first: int
    last: int


@dataclass
class Item:
    word: str
    required: bool = False
    open: bool = False
    code: str | None = None


@dataclass
class ParsedQuery:
    items: list[Item] = field(default_factory=list)
    excluded: list[Item] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    scope: list[object] | None = None
    reference: Reference | None = None
    hint: object | None = None


def canonical() -> list[Collection]:
    rows = [line.split("|") for line in COLLECTIONS.strip().splitlines()]
    return [Collection(k, code, name, tuple(aliases.split())) for k, (code, name, _, aliases) in enumerate(rows)]


def squash(name: str) -> str:
    low = name.lower()
    bare = "".join(c for c in low if c.isalnum())
    for spelled, digit in ORDINALS.items():
        if low.startswith(f"{spelled} "):
            return digit + bare[len(spelled) :]
    return bare


def code_of(word: str) -> str | None:
    found = CODE.fullmatch(word)
    return found[1].upper() + found[2] if found else None


class QueryParser:
    """Parser over a list of collections; the canonical ones by default."""

    def __init__(self, collections: list[Collection] | None = None) -> None:
        self.collections = canonical() if collections is None else collections
        self.by_name = {}
        for c in reversed(self.collections):
            self.by_name |= {squash(c.name): c.coll} | dict.fromkeys(c.aliases, c.coll)
        self.ranges: dict[str, list[object]] = {}
        codes = [c.code for c in self.collections]
        for pair in SCOPES.split():
            name, ends = pair.split("=")
            first, last = ends.split("-")
            if first in codes and last in codes:
                self.ranges[name] = [c.coll for c in self.collections[codes.index(first) : codes.index(last) + 1]]

    def find(self, typed: str) -> object | None:
        """Exact name or alias, else the only name that starts so (three characters at least)."""
        key = squash(typed)
        if not key:
            return None
        if key in self.by_name:
            return self.by_name[key]
        hits = [c.coll for c in self.collections if squash(c.name).startswith(key)] if len(key.encode()) >= 3 else []
        return hits[0] if len(hits) == 1 else None

    def scope(self, name: str) -> list[object]:
        if name in self.ranges:
            return self.ranges[name]
        found = self.find(name)
        return [] if found is None else [found]

    def reference(self, typed: str) -> Reference | None:
        """``name chapter[:verse[-verse]]``; a bare name, or a range of chapters, is none."""
        found = re.fullmatch(r"(.*?)([0-9 :.\-–]*)", typed.strip(), re.S)
        name, numbers = found[1].strip(), found[2].strip()
        if not numbers or not any(c.isalpha() for c in name):
            return None
        coll = self.find(name)
        parts = [p for p in re.split(r"[:. ]", numbers) if p]
        if coll is None or not parts or not parts[0].isdigit():
            return None
        if len(parts) == 1:
            return Reference(coll, int(parts[0]), 1, 999)
        ends = re.split("[-–]", parts[1])
        if not ends[0].isdigit() or (len(ends) > 1 and ends[1] and not ends[1].isdigit()):
            return None
        first = int(ends[0])
        last = int(ends[1]) if len(ends) > 1 and ends[1] else first
        return Reference(coll, int(parts[0]), first, max(first, last))

    def parse(self, typed: str, live: bool = False) -> ParsedQuery:
        out = ParsedQuery()
        phrases, rest = quoted(typed)
        out.phrases = [p for p in phrases if p.strip()]
        plain: list[str] = []
        for token in "".join(rest).split():
            if token.startswith("in:"):
                out.scope = (out.scope or []) + self.scope(token[3:].lower())
            elif token.startswith("-") and len(token) > 1:
                out.excluded.append(Item(token[1:], code=code_of(token[1:])))
            else:
                plain.append(token)
        whole = " ".join(plain)
        if not out.phrases:
            out.reference = self.reference(whole)
            if out.reference:
                return out
            if len(whole.encode()) >= 3 and not re.search("[0-9]", whole):
                out.hint = self.find(whole)
        ends_open = live and not typed[-1:].isspace() and not typed.endswith('"')
        out.items = [Item(w, required=True) for p in out.phrases for w in WORDS.findall(p)]
        for k, token in enumerate(plain):
            word = token.rstrip("*")
            if code_of(word):
                out.items.append(Item(word, code=code_of(word)))
                continue
            parts = WORDS.findall(word)
            opened = token.endswith("*") or (ends_open and k == len(plain) - 1)
            out.items += [Item(p, open=opened and j == len(parts) - 1) for j, p in enumerate(parts)]
        return out


def quoted(typed: str) -> tuple[list[str], list[str]]:
    """Phrases and the rest: opened by any double quote mark, closed by a straight or right one."""
    phrases, rest, k = [], [], 0
    while k < len(typed):
        if typed[k] in '"“”':
            ends = [e for e in (typed.find('"', k + 1), typed.find("”", k + 1)) if e >= 0]
            end = min(ends) if ends else len(typed)
            phrases.append(typed[k + 1 : end])
            k = end + 1
        else:
            rest.append(typed[k])
            k += 1
    return phrases, rest


@dataclass
class QueryTables:
    """A batch of parsed queries as DataFrames keyed by qid; bounded by the batch that the caller states."""

    queries: DataFrame
    terms: DataFrame
    excluded: DataFrame
    phrases: DataFrame
    scopes: DataFrame
    references: DataFrame
    hints: DataFrame


def tables(spark: SparkSession, batch: list[tuple[int, str]], parser: QueryParser, *, live: bool = False, coll_type: str = "int") -> QueryTables:
    parsed = [(qid, typed, parser.parse(typed, live)) for qid, typed in batch]
    make = spark.createDataFrame
    return QueryTables(
        make([(q, t, p.scope is not None, bool(p.phrases), p.reference is not None) for q, t, p in parsed], "qid int, typed string, scoped boolean, phrased boolean, referred boolean"),
        make([(q, k, i.word, i.required, i.open, i.code) for q, _, p in parsed for k, i in enumerate(p.items)], "qid int, term_no int, word string, required boolean, open boolean, code string"),
        make([(q, i.word, i.code) for q, _, p in parsed for i in p.excluded], "qid int, word string, code string"),
        make([(q, phrase) for q, _, p in parsed for phrase in p.phrases], "qid int, phrase string"),
        make([(q, c) for q, _, p in parsed for c in sorted(set(p.scope or []), key=str)], f"qid int, coll {coll_type}"),
        make([(q, p.reference.coll, p.reference.grp, p.reference.first, p.reference.last) for q, _, p in parsed if p.reference], f"qid int, coll {coll_type}, grp bigint, first int, last int"),
        make([(q, p.hint) for q, _, p in parsed if p.hint is not None], f"qid int, coll {coll_type}"),
    )
