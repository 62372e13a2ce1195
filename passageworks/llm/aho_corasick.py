"""Benchmark decontamination with one Aho-Corasick automaton over windows of normalised words."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.common import clean, slices, small_batches

WINDOW = 13
#: Benchmark words of one automaton, which has up to WINDOW nodes for each letter of its code. Beyond that the text is scanned once for each so many words.
MOST_WORDS = 200_000
#: Letters of the alphabet in which known words are coded: the automaton looks for a node's next letter among so many at most.
LETTERS = 32
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every other ASCII byte that is no word character into a space.
NORMAL = bytes(c if WORD.fullmatch(bytes([c])) else 32 for c in LOWER)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


@dataclass
class Items:
    """Benchmark items as lists of words; the name of an item without an id is None."""

    names: list[str | None]
    words: list[list[bytes]]

    def automaton(self, window: int) -> Automaton:
        """One automaton over coded words: every window of every item leads to its size and the items that have it."""
        known = {w: None for words in self.words for w in words}
        digits = next(d for d in range(1, 99) if LETTERS**d >= len(known))
        # a first letter of its own kind, so that a match can only begin where a word does
        codes = {w: "".join(chr((64 if d == digits - 1 else 1) + k // LETTERS**d % LETTERS) for d in range(digits - 1, -1, -1)) for k, w in enumerate(known)}
        found = ahocorasick.Automaton()
        for name, words in zip(self.names, self.words, strict=True):
            line = [codes[w] for w in words]
            size = min(window, len(line))
            for k in range(len(line) - size + 1):
                key = "".join(line[k : k + size])
                value = found.get(key, None)
                if value is None:
                    found.add_word(key, (size, {name}))
                else:
                    value[1].add(name)
        if len(found):
            found.make_automaton()
        return Automaton(found, codes)


@dataclass
class Automaton:
    found: ahocorasick.Automaton
    codes: dict[bytes, str]

    def scan(self, text: str | None) -> tuple[np.ndarray, set[str | None], int]:
        """(marks of hit words, items with an occurring window, number of words), in one pass over the words; unknown words are one sign."""
        words = words_of(text)
        hit, items = np.zeros(len(words) + 1, np.int32), set()
        if words and len(self.found):
            code = self.codes.get
            line = [code(w, "\0") for w in words]
            ends = list(self.found.iter("".join(line)))
            if ends:
                at = np.cumsum(np.fromiter(map(len, line), np.int64, len(line))) - 1
                for last, (_, (size, names)) in zip(np.searchsorted(at, [e for e, _ in ends]).tolist(), ends, strict=True):
                    hit[last - size + 1] += 1
                    hit[last + 1] -= 1
                    items |= names
        return np.cumsum(hit[:-1]) > 0, items, len(words)


def blocks_of(rows: Iterable[tuple[object, str | None]], most_words: int = MOST_WORDS) -> Iterator[Items]:
    """All items that have words, in one block up to ``most_words`` (and the item that passes it)."""
    block, size = Items([], []), 0
    for item, text in rows:
        words = words_of(text)
        if words:
            block.names.append(None if item is None else str(item))
            block.words.append(words)
            size += len(words)
        if size > most_words:
            yield block
            block, size = Items([], []), 0
    if block.words or not size:
        yield block


def spans_of(text: str, marks: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code point offsets of the original text."""
    raw = text.encode()
    at = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(LOWER))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    out = []
    for first, past in edges.reshape(-1, 2):
        start = len(raw[: at[first][0]].decode())
        out.append({"start": start, "end": start + len(raw[at[first][0] : at[past - 1][1]].decode())})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW, most_words: int = MOST_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, keep0, ...) for every row.

    Each text is normalised and scanned once by one automaton over all benchmark windows. A benchmark of more than
    ``most_words`` words comes in blocks of that size, each task holding one block's automaton at a time and reading
    its rows again for the next; the result is the same. Null or
    wordless text has no words and is clean; null or wordless items have no window; an item without an id counts
    in n_items and has no name in the digest; equal windows of several items count for each (so do items of one id once);
    repeated rows are each returned; very long texts are scanned whole; other columns are not read; an empty benchmark hits nothing,
    an empty table gives no rows. ``spans`` are runs of hit words in code points of the original text, end exclusive.
    """
    context = docs.sparkSession.sparkContext
    stated = clean(benchmark, item_col, item_text_col).distinct().toLocalIterator()
    sent = [context.broadcast(block) for block in blocks_of(((r[0], r[1]) for r in stated), most_words)]

    def packed(batch: pa.RecordBatch, seen: list[tuple[np.ndarray, set[str | None], int]]) -> pa.RecordBatch:
        hits = [int(m.sum()) for m, _, _ in seen]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([n for _, _, n in seen], pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array([len(items) for _, items, _ in seen], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest() for _, items, _ in seen], pa.string()),
                pa.array([h > 0 and 20 * h >= n for h, (_, _, n) in zip(hits, seen, strict=True)], pa.bool_()),
                pa.array([spans_of(t.as_py(), m) if h else [] for t, h, (m, _, _) in zip(batch.column(1), hits, seen, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                *batch.columns[2:],
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *(f"keep{k}" for k in range(len(keep)))],
        )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent[0].value.automaton(window)
        for batch in slices(batches):
            yield packed(batch, [automaton.scan(t) for t in batch.column(1).to_pylist()])

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, set[str | None]]] = {}
        with tempfile.TemporaryFile() as spool:
            writer = None
            for batch in batches:
                writer = writer or pa.ipc.new_stream(spool, batch.schema)
                writer.write_batch(batch)
            if writer is None:
                return
            writer.close()
            for block in sent:
                automaton, row = block.value.automaton(window), 0
                spool.seek(0)
                for batch in slices(pa.ipc.open_stream(spool)):
                    for text in batch.column(1).to_pylist():
                        marks, items, _ = automaton.scan(text)
                        if items:
                            old = found.get(row, (False, set()))
                            found[row] = old[0] | marks, old[1] | items
                        row += 1
                del automaton, block._value
            spool.seek(0)
            row = 0
            for batch in slices(pa.ipc.open_stream(spool)):
                seen = []
                for text in batch.column(1).to_pylist():
                    n = len(words_of(text))
                    seen.append((*found.get(row, (np.zeros(n, bool), set())), n))
                    row += 1
                yield packed(batch, seen)

    kind = docs.schema[id_col].dataType.simpleString()
    kept = "".join(f", keep{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    wanted = small_batches(docs).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *(F.col(f"`{c}`").alias(f"keep{k}") for k, c in enumerate(keep)))
    return wanted.mapInArrow(once if len(sent) == 1 else in_blocks, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>" + kept)
