"""Toxicity: support vector machine on a gapped subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.common import clean, slices

#: Symbols: a-z 0-25, accented vowels 26-27, other accented letters 28, digits 29, space 30, anything else 31.
SYMBOLS, SPACE = 32, 30
#: Subsequences of three symbols with up to two symbols skipped; each skipped one costs this factor.
DECAY = 0.6
PATTERNS = [(1, 2, 0), (1, 3, 1), (2, 3, 1), (1, 4, 2), (2, 4, 2), (3, 4, 2)]
#: Start positions of a window whose subsequences are summed into one kernel value.
WINDOW = 10
#: Bounds of the fitting sample: labelled documents of each class, and the code points of each.
SAMPLE_TOXIC, SAMPLE_CLEAN, FIT_CHARS = 1500, 2500, 20_000
LANDMARKS = 240
#: Windows taken from each fitting text: its hottest stretches (apart from each other) if toxic, at random if clean.
HOT_WINDOWS, CLEAN_WINDOWS = 8, 6
#: A stretch of a toxic text teaches the machine if it is hotter than the hottest stretch of this part of the clean texts, in each round.
CLEAR = (0.5, 0.8, 0.9)
#: Characters that are put inside copies of teaching windows, of either class, so that the machine meets broken words.
STRAY = "-*.x_'a"
#: Short strings whose kernel values are worked out at a time, to bound the driver's memory.
KERNEL_ROWS = 64


def symbol_table() -> np.ndarray:
    table = np.full(0x3000, 31, np.uint8)
    for code in range(len(table)):
        char = chr(code)
        base = unicodedata.normalize("NFD", char.lower())[:1]
        if char.isspace():
            table[code] = SPACE
        elif char.isdigit():
            table[code] = 29
        elif "a" <= base <= "z":
            plain = char.lower() == base
            table[code] = ord(base) - 97 if plain else 28 if base not in "aeiou" else 26 if char.lower() in "éáíóú" else 27
        elif char.lower() in "ßæœø":
            table[code] = 28
    return table


TABLE = symbol_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return TABLE[np.minimum(codes, len(TABLE) - 1)]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel features of short strings: (row, subsequence, weight)."""
    rows, keys, weights = [], [], []
    for k, text in enumerate(texts):
        x = symbols(text).astype(np.int32)
        for i, j, gap in PATTERNS:
            if len(x) > j:
                code = (x[: len(x) - j] << 10) | (x[i : len(x) - j + i] << 5) | x[j:]
                keys.append(code)
                rows.append(np.full(len(code), k, np.int32))
                weights.append(np.full(len(code), DECAY**gap))
    if not keys:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(weights)


def dense(texts: list[str]) -> np.ndarray:
    row, key, weight = features(texts)
    out = np.zeros((len(texts), SYMBOLS**3), np.float32)
    np.add.at(out, (row, key), weight)
    return out


def kernel(texts: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each text with each landmark (given by its features)."""
    out = np.zeros((len(texts), len(landmarks)), np.float32)
    for at in range(0, len(texts), KERNEL_ROWS):
        row, key, weight = features(texts[at : at + KERNEL_ROWS])
        order = np.argsort(row, kind="stable")
        row, key, weight = row[order], key[order], weight[order].astype(np.float32)
        if len(row):
            first = np.flatnonzero(np.concatenate(([True], np.diff(row) != 0)))
            out[at + row[first]] = np.add.reduceat(weight[:, None] * landmarks[:, key].T, first, axis=0)
    return out


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    ones = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(ones.shape[1]), np.eye(ones.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (ones @ w) < 1
        a, c = ones[active], cost[active][:, None]
        after = np.linalg.solve(ridge + 2 * a.T @ (c * a), 2 * a.T @ (c[:, 0] * y[active]))
        if np.allclose(after, w, atol=1e-6):
            break
        w = after
    return w[:-1], float(w[-1])


@dataclass
class ToxicKernel:
    """The fitted machine: its landmarks' features folded into one weight for each subsequence.

    A kernel value is the dot product of subsequence features, so the machine's sum over landmarks is
    the dot product with one weight vector, and every window of a long text is scored in one pass.
    """

    weights: np.ndarray
    bias: float
    scale: np.ndarray

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Machine value of the window that starts at each position of a symbol array."""
        at = np.zeros(len(x) + WINDOW, np.float32)
        y = x.astype(np.int32)
        for i, j, gap in PATTERNS:
            if len(y) > j:
                code = (y[: len(y) - j] << 10) | (y[i : len(y) - j + i] << 5) | y[j:]
                at[: len(code)] += np.float32(DECAY**gap) * self.weights[code]
        total = np.concatenate(([0.0], np.cumsum(at, dtype=np.float64)))
        return total[WINDOW : WINDOW + len(x)] - total[: len(x)] + self.bias

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text: its highest window (a long text has a high one by chance sooner), and log total and log density of the heat above zero."""
        spaced = [f" {t or ''}" + " " * (WINDOW + 4) for t in texts]
        if not texts:
            return np.zeros((0, 3))
        values = self.windows(symbols("".join(spaced)))
        starts = np.cumsum([0, *map(len, spaced[:-1])])
        thousands = np.array([len(t) for t in spaced]) / 1000
        top = np.clip(np.maximum.reduceat(values, starts), -5, 5)
        heat = np.add.reduceat(np.maximum(values, 0), starts)
        return np.stack([top - 0.25 * np.log(thousands), np.log1p(heat), np.log(heat / thousands + 0.05)], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.evidence(texts) @ self.scale[:3] + self.scale[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def hottest(self, text: str, most: int = 1) -> list[tuple[float, str]]:
        """(value, window) of the hottest windows, hottest first, none within a window of another."""
        padded = f" {text} "
        values = self.windows(symbols(padded))[: len(padded)].copy()
        found = []
        while len(found) < most:
            k = int(np.argmax(values))
            if not np.isfinite(values[k]):
                break
            found.append((float(values[k]), (padded + " " * (WINDOW + 4))[k : k + WINDOW + 4]))
            values[max(0, k - WINDOW) : k + WINDOW + 1] = -np.inf
        return found

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], seed: int = 7) -> ToxicKernel:
        """From (text, toxic), by multiple-instance rounds. Two thirds of the rows fit the machine, the rest scale its values to odds.

        Which stretches make a text toxic is not labelled. Log ratios of the rates of subsequences in toxic and in clean texts say
        where to look first; then in each round the machine learns the hottest stretches of toxic texts (those that are clear of
        the clean texts' hottest), whole and with a stray character inside, against random and hottest stretches
        of clean texts, broken in the same way, and says anew which stretches are hottest. Landmarks are such stretches of either class.
        """
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        learn, scale_on = [rows[k] for k in order[: 2 * len(rows) // 3]], [rows[k] for k in order[2 * len(rows) // 3 :]]
        toxic, clean_ = [t.lower() for t, y in learn if y], [t.lower() for t, y in learn if not y]
        if not toxic or not clean_:
            return cls(np.zeros(SYMBOLS**3, np.float32), 0.0, np.array([0, 0, 0, -1.0 if not toxic else 1.0]))
        rates = [rate_of(toxic), rate_of(clean_)]
        model = cls((np.log(rates[0]) - np.log(rates[1])).astype(np.float32), 0.0, np.array([1.0, 0, 0, 0]))

        def cut(text: str, n: int) -> list[str]:
            padded = f" {text} " + " " * (WINDOW + 4)
            return [padded[k : k + WINDOW + 4] for k in rng.integers(0, max(1, len(text)), n)]

        def broken(window: str) -> str:
            at = int(rng.integers(2, WINDOW))
            return (window[:at] + STRAY[rng.integers(len(STRAY))] + window[at:])[: WINDOW + 4]

        random_ones = [c for text in clean_ for c in cut(text, CLEAN_WINDOWS)]
        negatives = random_ones + [broken(c) for c in random_ones[::2]]
        z = whiten = None
        for clear_of in CLEAR:
            cold = [model.hottest(text)[0] for text in clean_]
            least = float(np.quantile([v for v, _ in cold], clear_of))
            clear = [(v, w) for text in toxic for v, w in model.hottest(text, HOT_WINDOWS) if v > least] or [max(model.hottest(text)[0] for text in toxic)]
            negatives += [w for _, w in cold] + [broken(w) for _, w in cold]
            positives = [w for _, w in clear] + [broken(w) for _, w in clear]
            if z is None:
                z, whiten = landmarks([w for _, w in sorted(clear, reverse=True)], [w for _, w in cold] + random_ones, rng)
            texts = positives + negatives
            y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
            cost = np.where(y > 0, 10.0 / len(positives), 30.0 / len(negatives)) * 20
            w, model.bias = machine(kernel(texts, z) @ whiten, y, cost)
            model.weights = ((whiten @ w) @ z).astype(np.float32)
        found, y = np.vstack([model.evidence([t for t, _ in scale_on[k : k + 64]]) for k in range(0, len(scale_on), 64)]) if scale_on else np.zeros((0, 3)), np.array([toxic for _, toxic in scale_on], float)
        model.scale = logistic(found, y)
        return model


def rate_of(texts: list[str]) -> np.ndarray:
    """Smoothed rate of each subsequence in texts, by kernel weight."""
    total = np.full(SYMBOLS**3, 0.5)
    for text in texts:
        _, keys, weights = features([f" {text} "])
        total += np.bincount(keys, weights, SYMBOLS**3)
    return total / total.sum()


def landmarks(hot: list[str], other: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Features of distinct landmark windows, half of them from ``hot``, and the map that makes their kernel the identity."""
    picked = list(dict.fromkeys(hot))
    picked = [picked[k] for k in sorted(rng.permutation(len(picked))[: LANDMARKS // 2])]
    rest = list(dict.fromkeys(other))
    picked += [rest[k] for k in sorted(rng.permutation(len(rest))[: LANDMARKS // 2])]
    z = dense(picked)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    return z, vectors[:, keep] / np.sqrt(values[keep])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    ones = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(ones.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ones @ w, -30, 30)))
        w += np.linalg.solve(ones.T @ (ones * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), ones.T @ (y - p) - ridge * w)
    return w


def fit_documents(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, fit_chars: int = FIT_CHARS) -> ToxicKernel:
    """Fit on a bounded sample of the labelled rows where ``train`` holds.

    About ``sample_toxic`` and ``sample_clean`` labelled documents of at most ``fit_chars`` code points are
    picked by a hash of the id and come to the driver. Rows whose label or text is null are not used.
    """
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).filter("y is not null").groupBy("i").agg(F.max("y").alias("y"))
    rows = docs.filter(train).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.length("t") <= fit_chars)
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    rate = F.when(F.col("y") == 1, min(1.0, sample_toxic / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample_clean / max(1, sizes.get(0, 0))))
    picked = marks.filter(F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("toxic")), F.lit(1_000_003)) < rate * 1_000_003)
    got = rows.join(F.broadcast(picked), "i").select("i", "t", "y").collect()
    return ToxicKernel.fit([(r["t"], int(r["y"])) for r in sorted(got, key=lambda r: (r["i"], r["t"]))])


def score_documents(docs: DataFrame, model: ToxicKernel, id_col: str = "doc_id", text_col: str = "text", *, spans: bool = False) -> DataFrame:
    """(doc_id, score, predicted[, hottest]) for every row, over whole texts.

    Null or empty text has the score of a text without evidence. Null ids and repeated rows: each is returned; a score of just 0.5
    predicts 1. Very long texts are scored whole. Other columns, of whatever name, are not read. Empty
    table: no rows. ``hottest`` is the stretch with the highest value (ties: the first).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for part in slices(batches, 64):
            texts = part.column(1).to_pylist()
            scores = fitted.scores(texts)
            columns = [part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]
            if spans:
                columns.append(pa.array([fitted.hottest(t or "")[0][1] for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "hottest"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return clean(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int" + ", hottest string" * spans)
