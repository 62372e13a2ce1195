"""The search engine's front: one query or a batch over index tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from passageworks.operators.index import IndexTables
from passageworks.operators.search import SearchResult, search_many
from passageworks.plans.query import QueryParser


@dataclass
class SearchEngine:
    index: IndexTables
    parser: QueryParser = field(default_factory=QueryParser)

    def search(self, typed: str, *, live: bool = False, canonical: bool = False) -> SearchResult:
        return self.search_many([(0, typed)], live=live, canonical=canonical)

    def search_many(self, batch: list[tuple[int, str]], *, live: bool = False, canonical: bool = False) -> SearchResult:
        return search_many(batch, self.index, self.parser, live=live, canonical=canonical)
