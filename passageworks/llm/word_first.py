"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.common import bounded_join, checkpoint, clean, slices

UNKNOWN = "und"
#: Combining marks and joiners: they continue a word, as vowel signs do in many scripts. None lies before U+0300, which is quick to see.
MARKS = "".join(re.escape(chr(c)) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M") + "\u200c\u200d"
LETTERS, BEYOND, MARKED, WORDS = re.compile(r"[^\W\d_]+"), re.compile("[\u0300-\U0010ffff]"), re.compile(f"[{MARKS}]"), re.compile(rf"[^\W\d_](?:[^\W\d_]|[{MARKS}])*")
#: The fitting sample, picked by a hash of id and language: about SAMPLE_PER_LANG documents of each language, SAMPLE_DOCS in
#: all, none of more than FIT_CHARS code points. Every word of the sample counts.
SAMPLE_PER_LANG, SAMPLE_DOCS, FIT_CHARS = 1000, 100_000, 20_000
LONGEST = 5
SMOOTH = 0.5
#: Numbers in an executor's memory of unseen words before it starts anew, and distinct words that a counting task holds.
MEMORY, HELD = 400_000, 100_000
#: Numbers of a table that is kept with a number for every language, which is faster.
CELLS = 8_000_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters with their marks."""
    low = (text or "").lower()
    found = LETTERS.findall(low) if low.isascii() or not BEYOND.search(low) or not MARKED.search(low) else WORDS.findall(low)
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, size: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + size] for k in range(len(padded) - size + 1)]


@dataclass
class Scores:
    """Smoothed log frequency of each key in each language, kept only where it was seen.

    A key that a language lacks has that language's ``base``; ``above`` is what the others have beyond it,
    at ``starts[row]`` to ``starts[row + 1]``. A table that is small enough is ``whole`` instead, with a number for every language.
    """

    row: dict[str, int]
    base: np.ndarray
    starts: np.ndarray | None = None
    lang: np.ndarray | None = None
    above: np.ndarray | None = None
    whole: np.ndarray | None = None

    @classmethod
    def of(cls, items: Iterable[tuple[int, str, int]], langs: int) -> Scores:
        """From distinct (number of the language, key) and count."""
        row: dict[str, int] = {}
        rows, columns, counts = [], [], []
        for lang, key, n in items:
            rows.append(row.setdefault(key, len(row)))
            columns.append(lang)
            counts.append(n)
        order = np.argsort(np.array(rows, np.int64), kind="stable")
        columns_, counts_ = np.array(columns, np.int32)[order], np.array(counts, np.float64)[order]
        total = np.bincount(columns_, counts_, langs) + SMOOTH * len(row) if langs else np.zeros(0)
        starts = np.concatenate(([0], np.cumsum(np.bincount(np.array(rows, np.int64), minlength=len(row)))))
        base, above = np.log(SMOOTH) - np.log(np.maximum(total, SMOOTH)), (np.log(counts_ + SMOOTH) - np.log(SMOOTH)).astype(np.float32)
        if len(row) * langs > CELLS:
            return cls(row, base, starts, columns_, above)
        whole = np.tile(base.astype(np.float32), (len(row), 1))
        whole[np.repeat(np.arange(len(row)), np.diff(starts)), columns_] += above
        return cls(row, base, whole=whole)

    def total(self, rows: list[int]) -> np.ndarray:
        """Sum of the log frequencies of keys, by language."""
        if not rows:
            return np.zeros(len(self.base))
        if self.whole is not None:
            return self.whole[rows].sum(axis=0, dtype=np.float64)
        at = np.array(rows)
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        places = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.base * len(at) + np.bincount(self.lang[places], self.above[places], len(self.base))


@dataclass
class WordFirst:
    """Per-language log frequencies of words and of n-grams from LONGEST characters down to one.

    Unseen words are remembered as further rows; the memory starts anew when it is full.
    """

    langs: list[str]
    words: Scores
    shorter: list[tuple[int, Scores]]
    unseen: dict[str, int] = field(default_factory=dict)
    memory: np.ndarray | None = None

    @classmethod
    def fit(cls, rows: list[tuple[str, str, int]]) -> WordFirst:
        """From (language, word, count)."""
        langs = sorted({r[0] for r in rows})
        at = {lang: k for k, lang in enumerate(langs)}

        def counted(size: int) -> Scores:
            sums: Counter[tuple[int, str]] = Counter()
            for lang, word, n in rows:
                for g in grams(word, size):
                    sums[at[lang], g] += n
            return Scores.of(((lang, g, n) for (lang, g), n in sums.items()), len(langs))

        return cls(langs, Scores.of(((at[lang], w, n) for lang, w, n in rows), len(langs)), [(size, counted(size)) for size in range(LONGEST, 0, -1)])

    def back_off(self, word: str) -> np.ndarray:
        """Mean log frequency of the word's longest n-grams that are known at all."""
        for size, known in self.shorter:
            if found := [known.row[g] for g in grams(word, size) if g in known.row]:
                return (known.total(found) / len(found)).astype(np.float32)
        return np.zeros(len(self.langs), np.float32)

    def remembered(self, word: str) -> int:
        """Row of an unseen word, now in the memory."""
        k = self.unseen[word] = len(self.unseen)
        if k == len(self.memory):
            self.memory = np.vstack([self.memory, np.zeros_like(self.memory)])
        self.memory[k] = self.back_off(word)
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if self.memory is None or self.memory.size > MEMORY:
            self.unseen, self.memory = {}, np.zeros((1024, len(self.langs)), np.float32)
        known, unseen = [], []
        row, memory = self.words.row.get, self.unseen.get
        for word in words:
            k = row(word)
            if k is not None:
                known.append(k)
            else:
                k = memory(word)
                unseen.append(self.remembered(word) if k is None else k)
        total = self.words.total(known) + self.memory[unseen].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def fit_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample_per_lang: int = SAMPLE_PER_LANG, sample_docs: int = SAMPLE_DOCS, fit_chars: int = FIT_CHARS) -> WordFirst:
    """Fit on rows where ``train`` holds and the language is known; every language is learned.

    The sample of labelled rows is bounded: each language's rows are picked by hash at the rate that yields
    ``sample_per_lang`` of them (fewer where languages are so many that all would pass ``sample_docs``), texts over ``fit_chars``
    code points are passed over, and the words are counted on the executors before the driver gets them.
    """
    labelled = docs.filter(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = checkpoint(labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")))
    each = min(sample_per_lang, sample_docs / max(1, sizes.count()))
    hashed = F.pmod(F.xxhash64(F.col("_l.i").cast("string"), F.col("_l.l")), F.lit(1_000_003))
    picked = bounded_join(labelled.filter(F.length("t") <= fit_chars), sizes, ["l"], hashed * F.col("_r.n") < each * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["l", "w", "n"])

        counts: Counter[tuple[str, str]] = Counter()
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in words_of(text))
            if len(counts) > HELD:
                yield out()
                counts.clear()
        yield out()

    counted = picked.select("_l.l", "_l.t").mapInArrow(count, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n"))
    return WordFirst.fit(sorted((r["l"], r["w"], r["n"]) for r in counted.collect()))


def identify(docs: DataFrame, model: WordFirst, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, keep0, keep1, ...) for every row, over whole texts.

    Text that is null or has no letter: ``und`` with score 0. Nothing learned: ``und``. Ties go to the
    alphabetically first language. Score is the posterior of the predicted language under equal priors.
    Null ids and repeated rows: each is returned. Very long texts are read whole. Other columns, of whatever name, are not read.
    Empty table: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for part in slices(batches, 64):
            found = [fitted.predict(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *part.columns[2:]],
                ["doc_id", "lang_pred", "score", *(f"keep{k}" for k in range(len(keep)))],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double" + "".join(f", keep{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    return clean(docs, id_col, text_col, *keep).mapInArrow(run, schema)
