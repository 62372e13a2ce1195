"""Language-model scores: context-tree weighting over binary-decomposed byte contexts, and a word unigram base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passageworks.llm.common import BROADCAST_ROWS, slices, small_batches, spread_join, stored

#: Bytes of context. Every context has a node of its own. The values of the most frequent four-byte contexts go to every task, with
#: those of two bytes and fewer (CONTEXTS + 256^2 + 257 rows of 256 values at most); places in other contexts meet theirs in a join.
DEPTH = 4
CONTEXTS = 32_768
#: Deepest contexts worked on at a time, to bound the driver's memory.
ROWS = 2048
#: A word is frequent if it is at least one in so many tokens: its counts travel with the documents.
FREQUENT = 50_000
#: Distinct byte runs or words that a task holds before it passes them on.
HELD = 300_000
#: The end of a text as a word (no word holds a space), and as bytes of context.
END = b" "


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument up by eight; good to 12 digits for x > 0."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a run with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def bits(counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of bit ``level`` after each prefix of earlier bits, for rows of 256 byte counts."""
    split = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(axis=3)
    return split[:, :, 0], split[:, :, 1]


def extended(logs: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log10 probabilities of bit prefixes, each made one bit longer by the probability of a one."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.stack([logs + np.log10(1 - p), logs + np.log10(p)], axis=2).reshape(len(p), 2 * logs.shape[1])


def summed(counts: np.ndarray, parent: np.ndarray, parents: int) -> np.ndarray:
    out = np.zeros((parents, counts.shape[1]))
    np.add.at(out, parent, counts)
    return out


@dataclass
class Counts:
    """Byte counts after contexts, kept sparse: (owner, byte, n) in order of owner."""

    owner: np.ndarray
    byte: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, owner: np.ndarray, byte: np.ndarray, n: np.ndarray) -> Counts:
        order = np.argsort(owner, kind="stable")
        return cls(owner[order], byte[order], n[order])

    def rows(self, first: int, past: int) -> np.ndarray:
        part = np.zeros((past - first, 256))
        mine = slice(np.searchsorted(self.owner, first), np.searchsorted(self.owner, past))
        np.add.at(part, (self.owner[mine] - first, self.byte[mine]), self.n[mine])
        return part


@dataclass
class Part:
    """Some kept three-byte contexts and all that lies below them."""

    first: int
    counts: np.ndarray
    parent: np.ndarray
    below: np.ndarray
    owner: np.ndarray
    rows: np.ndarray

    def inner(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each context: estimate of a one, weight of its own estimate, and log probability of all at and below it."""
        zeros, ones = bits(self.counts, bit)
        block = block_probability(zeros, ones)
        under = summed(block_probability(*bits(self.below, bit)), self.owner, len(self.counts))
        return (ones + 0.5) / (zeros + ones + 1.0), weight(block, under), np.logaddexp(block, under) - math.log(2)


    @classmethod
    def of(cls, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Part]:
        """(contexts of four, three and two bytes, ascending, and the part) of all runs that some three-byte contexts have."""
        fours, at = np.unique(gram >> 8, return_inverse=True)
        below = np.zeros((len(fours), 256))
        np.add.at(below, (at, gram & 255), n)
        threes, owner = np.unique(fours & 0xFFFFFF, return_inverse=True)
        twos, parent = np.unique(threes & 0xFFFF, return_inverse=True)
        return fours, threes, twos, cls(0, summed(below, owner, len(threes)), parent, below, owner, np.arange(len(fours)))

    def logs(self, mixtures: list[tuple[np.ndarray, np.ndarray]], parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each byte where a context ends here, and in each context below; ``parent`` leads to rows of ``mixtures``."""
        ended, found = np.zeros((len(self.counts), 1)), np.zeros((len(self.below), 1))
        for bit, (mixed, above) in enumerate(mixtures):
            estimate, own, _ = self.inner(bit)
            mixed, above = mixed[parent], above[parent]
            ended = extended(ended, mixed + above * estimate)
            mixed, above = mixed + above * own * estimate, above * (1 - own)
            zeros, ones = bits(self.below, bit)
            found = extended(found, mixed[self.owner] + above[self.owner] * (ones + 0.5) / (zeros + ones + 1.0))
        return ended, found


def weight(block: np.ndarray, under: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(under - block, -700, 700)))


@dataclass
class Upper:
    """The tree down to two bytes: log10 probabilities where a context ends at the root, one or two bytes, and by bit what is mixed on the way there and the weight still to give."""

    twos: np.ndarray
    ones: np.ndarray
    logs: list[np.ndarray]
    mixtures: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, twos: np.ndarray, two: np.ndarray, below: list[np.ndarray]) -> Upper:
        """From the byte counts of the contexts of two bytes, and by bit the log probability of all that lies below each."""
        ones, parent_two = np.unique(twos & 255, return_inverse=True)
        one = summed(two, parent_two, len(ones))
        root = one.sum(axis=0, keepdims=True) if len(one) else np.zeros((1, 256))
        upper = [(root, np.zeros(1, np.int64)), (one, np.zeros(len(ones), np.int64)), (two, parent_two)]
        logs = [np.zeros((len(counts), 1)) for counts, _ in upper]
        mixtures = []
        for bit in range(8):
            estimates, blocks = [], []
            for counts, _ in upper:
                zeros, ones_ = bits(counts, bit)
                estimates.append((ones_ + 0.5) / (zeros + ones_ + 1.0))
                blocks.append(block_probability(zeros, ones_))
            under, own = below[bit], [np.zeros(0)] * len(upper)
            for depth in range(len(upper) - 1, -1, -1):
                own[depth] = weight(blocks[depth], under)
                weighted = np.logaddexp(blocks[depth], under) - math.log(2)
                under = summed(weighted, upper[depth][1], len(upper[depth - 1][0])) if depth else weighted
            # from the root down: the sum so far of weight times estimate, and the weight still to give
            mixed, above = np.zeros_like(estimates[0]), np.ones_like(estimates[0])
            for depth, (_, parent) in enumerate(upper):
                if depth:
                    mixed, above = mixed[parent], above[parent]
                logs[depth] = extended(logs[depth], mixed + above * estimates[depth])
                mixed, above = mixed + above * own[depth] * estimates[depth], above * (1 - own[depth])
            mixtures.append((mixed, above))
        return cls(twos, ones, logs, mixtures)

    def row_of_two(self, at_two: int) -> np.ndarray:
        """The row of every context of two bytes in a table that has those of two bytes from ``at_two`` on, then one byte, then the root."""
        at_one = at_two + len(self.twos)
        row_of_two = np.full(1 << 16, at_one + len(self.ones), np.int32)
        for k, byte in enumerate(self.ones):
            row_of_two[byte::256] = at_one + k
        row_of_two[self.twos] = at_two + np.arange(len(self.twos))
        return row_of_two


@dataclass
class ContextTree:
    """Log10 probability of each byte in each context.

    ``table`` rows: the kept four-byte contexts, the shared rest of each kept three-byte context, the shared
    rest of each two-byte context, then each one-byte context, then the root. ``row_of_two``, ``three`` and
    ``four`` lead from context bytes to rows.
    """

    table: np.ndarray
    row_of_two: np.ndarray
    three: np.ndarray
    four: np.ndarray

    @classmethod
    def fit(cls, deep: np.ndarray, deep_n: np.ndarray, middle: np.ndarray, middle_n: np.ndarray, shallow: np.ndarray, shallow_n: np.ndarray) -> ContextTree:
        """From counts of runs of five and four bytes (of the kept contexts) and of three bytes (of all)."""
        threes, twos = np.unique(middle >> 8), np.unique(shallow >> 8)
        fours = np.unique(deep >> 8)
        fours = fours[np.argsort(np.searchsorted(threes, fours & 0xFFFFFF), kind="stable")]
        parent_four, parent_three = np.searchsorted(threes, fours & 0xFFFFFF), np.searchsorted(twos, threes & 0xFFFF)
        by_code = np.argsort(fours)
        four = Counts.of(by_code[np.searchsorted(fours[by_code], deep >> 8)] if len(fours) else deep, deep & 255, deep_n)
        three = Counts.of(np.searchsorted(threes, middle >> 8), middle & 255, middle_n)
        two = np.zeros((len(twos), 256))
        np.add.at(two, (np.searchsorted(twos, shallow >> 8), shallow & 255), shallow_n)
        rest = two.copy()
        np.subtract.at(rest, (parent_three[three.owner], three.byte), three.n)

        def parts() -> Iterator[Part]:
            for at in range(0, len(threes), ROWS):
                past = min(at + ROWS, len(threes))
                a, z = np.searchsorted(parent_four, at), np.searchsorted(parent_four, past)
                counts, kept, owner = three.rows(at, past), four.rows(a, z), parent_four[a:z] - at
                left = counts - summed(kept, owner, past - at)
                yield Part(at, counts, parent_three[at:past], np.vstack([kept, left]), np.concatenate([owner, np.arange(past - at)]), np.concatenate([np.arange(a, z), len(fours) + np.arange(at, past)]))

        # log probability of all that lies below each two-byte context, by bit
        below = [block_probability(*bits(rest, bit)) for bit in range(8)]
        for part in parts():
            for bit in range(8):
                np.add.at(below[bit], part.parent, part.inner(bit)[2])
        upper = Upper.fit(twos, two, below)
        logs, mixtures, ones = upper.logs, upper.mixtures, upper.ones
        table = np.zeros((len(fours) + len(threes) + len(twos) + len(ones) + 1, 256), np.float32)
        for part in parts():
            ended, found = part.logs(mixtures, part.parent)
            # a context all of whose continuations are kept has no rest: other continuations end in it
            bare = part.below.sum(axis=1) == 0
            found[bare] = ended[part.owner[bare]]
            table[part.rows] = found
        at_two = len(fours) + len(threes)
        for at in range(0, len(twos), ROWS):
            some, found = slice(at, min(at + ROWS, len(twos))), np.zeros((len(rest[at : at + ROWS]), 1))
            for bit, (mixed, above) in enumerate(mixtures):
                zeros, ones_ = bits(rest[some], bit)
                found = extended(found, mixed[some] + above[some] * (ones_ + 0.5) / (zeros + ones_ + 1.0))
            table[at_two + at : at_two + at + len(found)] = np.where(rest[some].sum(axis=1, keepdims=True) == 0, logs[2][some], found)
        # a context never seen below a one-byte context or the root ends there
        at_one = at_two + len(twos)
        table[at_one:-1], table[-1] = logs[1], logs[0]
        return cls(table, upper.row_of_two(at_two), threes.astype(np.int64), fours.astype(np.int64))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of every context of three bytes, and the kept row that a fourth byte leads to from there (or -1)."""
        out = np.tile(self.row_of_two, 256)
        out[self.three] = len(self.four) + np.arange(len(self.three), dtype=np.int32)
        ahead = np.full((len(self.three) + 1, 256), -1, np.int32)
        ahead[np.searchsorted(self.three, self.four & 0xFFFFFF), self.four >> 24] = np.arange(len(self.four), dtype=np.int32)
        return out, ahead.ravel()

    def scores(self, texts: list[bytes], rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log10 probability of each text's bytes and of its end."""
        if not texts:
            return np.zeros(0)
        joined, starts = framed(texts)
        fourth, context, target = contexts(joined)
        row = rows[0][context]
        kept = row - np.int32(len(self.four))
        kept[(kept < 0) | (kept >= len(self.three))] = len(self.three)
        far = rows[1][kept * 256 + fourth]
        row = np.where(far >= 0, far, row)
        values = self.table.ravel()[row.astype(np.int64) * 256 + target]
        values[np.add.outer(starts[1:], np.arange(-DEPTH, 0)).ravel() if len(starts) > 1 else []] = 0
        return np.add.reduceat(values.astype(np.float64), starts)


@dataclass
class KeptTree:
    """What travels of the whole tree: rows of the most frequent four-byte contexts, then of two bytes, one byte and the root.

    ``seen``: every three-byte context of the training texts, ``four`` the kept contexts, both ascending. A place in a seen three-byte context whose four
    bytes are not kept is open: its value is worked out elsewhere. In one not seen a context ends at two bytes or fewer.
    """

    table: np.ndarray
    row_of_two: np.ndarray
    seen: np.ndarray
    four: np.ndarray

    def rows(self) -> tuple[np.ndarray, np.ndarray, int]:
        """By three-byte context: a row, -1 (open) or -2 - k, where the k-th stretch of the second table leads from a fourth byte to a row or -1."""
        threes = np.unique(self.four & 0xFFFFFF)
        out = np.tile(self.row_of_two, 256)
        out[self.seen] = -1
        out[threes] = -2 - np.arange(len(threes), dtype=np.int32)
        ahead = np.full((len(threes) + 1, 256), -1, np.int32)
        ahead[np.searchsorted(threes, self.four & 0xFFFFFF), self.four >> 24] = np.arange(len(self.four), dtype=np.int32)
        return out, ahead.ravel(), len(threes)

    def scores(self, texts: list[bytes], rows: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, list[bytes]]:
        """Log10 probability of each text's bytes and its end but for open places, and those: pairs of run and count, packed."""
        if not texts:
            return np.zeros(0), []
        joined, starts = framed(texts)
        fourth, context, target = contexts(joined)
        first = rows[0][context]
        far = rows[1][np.where(first < -1, -2 - first, rows[2]) * 256 + fourth]
        row = np.where(first < -1, far, first)
        own = np.ones(len(row), bool)
        own[np.add.outer(starts[1:], np.arange(-DEPTH, 0)).ravel() if len(starts) > 1 else []] = False
        values = self.table.ravel()[np.maximum(row, 0).astype(np.int64) * 256 + target]
        values[(row < 0) | ~own] = 0
        at = np.flatnonzero((row < 0) & own)
        runs = (fourth[at].astype(np.int64) << 32) | (context[at].astype(np.int64) << 8) | target[at]
        cuts = np.searchsorted(at, starts[1:])
        open_ = [np.stack(np.unique(part, return_counts=True), axis=1).astype("<i8").tobytes() if len(part) else b"" for part in np.split(runs, cuts)]
        return np.add.reduceat(values.astype(np.float64), starts), open_


def framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts side by side, each after DEPTH zero bytes and before one; and where each one's first target lies."""
    pad = b"\0" * DEPTH
    joined = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    sizes = np.array([len(t) + DEPTH + 1 for t in texts])
    return joined, np.cumsum(np.concatenate(([0], sizes[:-1])))


def contexts(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fourth byte back, last three bytes, next byte) at each place."""
    x = joined.astype(np.int32)
    return x[:-4], (x[1:-3] << 16) | (x[2:-2] << 8) | x[3:-1], x[4:]


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def learn(docs: DataFrame) -> DataFrame:
    """(word, gram, n, trained) partial counts of ``docs(text, train)``: words frequent in their task, byte runs of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        total, grams, sizes = 0, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in grams])).astype(np.int64)

        for part in slices(batches):
            texts = [lowered(t) for t in part.column(0).to_pylist()]
            for text in texts:
                tokens = text.split()
                words.update(tokens)
                total += len(tokens) + 1
            if len(words) > HELD:
                # a word rarer than this so far can still be frequent, but then mostly from later texts; one that is missed
                # only travels as a rare word, which changes no result
                words = Counter({w: n for w, n in words.items() if n * 8 * FREQUENT >= total})
            trained = [t for t, train in zip(texts, part.column(1).to_pylist(), strict=True) if train]
            if trained:
                joined, starts = framed(trained)
                fourth, context, target = contexts(joined)
                keep = np.ones(len(target), bool)
                keep[np.add.outer(starts[1:], np.arange(-DEPTH, 0)).ravel() if len(starts) > 1 else []] = False
                grams.append(np.unique(((fourth.astype(np.int64) << 32) | (context.astype(np.int64) << 8) | target)[keep], return_counts=True))
                sizes += len(grams[-1][0])
                if sizes > 4 * HELD:
                    grams = [merged()]
                    sizes = 0
        often = [w for w, n in words.items() if n * 2 * FREQUENT >= total]
        if often:
            yield pa.RecordBatch.from_arrays([pa.array(often, pa.binary()), pa.nulls(len(often), pa.int64()), pa.array([words[w] for w in often], pa.int64()), pa.array([total] + [0] * (len(often) - 1), pa.int64())], ["word", "gram", "n", "total"])
        if grams:
            keys, counts = merged()
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part.astype(np.int64)), pa.array(counts[k : k + 100_000]), pa.nulls(len(part), pa.int64())], ["word", "gram", "n", "total"])

    return docs.mapInArrow(run, "word binary, gram bigint, n bigint, total bigint").groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def by_two(runs: DataFrame) -> DataFrame:
    """``runs(gram, n, asked)`` with all of a two-byte context in one task, ordered by three-byte context."""
    low = lambda mask: F.shiftright(F.col("gram"), 8).bitwiseAND(F.lit(mask))
    return runs.withColumns({"two": low(0xFFFF), "three": low(0xFFFFFF)}).repartition("two").sortWithinPartitions("two", "three").select("gram", "n", "asked")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, n, asked) of ``by_two`` in stretches of some ten thousand rows and whole three-byte contexts."""
    held: list[np.ndarray] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 8 * ROWS):
            held.append(np.stack([np.asarray(c, np.int64) for c in batch.slice(at, 8 * ROWS).columns]))
            rows = np.concatenate(held, axis=1)
            three = (rows[0] >> 8) & 0xFFFFFF
            cut = np.flatnonzero(three != three[-1])
            held = [rows[:, cut[-1] + 1 :]] if len(cut) else [rows]
            if len(cut):
                yield tuple(rows[:, : cut[-1] + 1])
    if held:
        yield tuple(np.concatenate(held, axis=1))


def fit_upper(runs: DataFrame) -> tuple[Upper, np.ndarray]:
    """The tree's upper part, under which every context of ``runs`` has its own node, and the three-byte contexts. The driver gets 256 counts and sums by two-byte context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, _ in blocks(batches):
            _, threes, twos, part = Part.of(gram, n)
            sums = [summed(part.inner(bit)[2], part.parent, len(twos)) for bit in range(8)]
            packed = np.concatenate([summed(part.counts, part.parent, len(twos)), *sums], axis=1)
            third = [(threes[part.parent == k] >> 16).astype(np.uint8).tobytes() for k in range(len(twos))]
            yield pa.RecordBatch.from_arrays([pa.array(twos), pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(third, pa.binary())], ["two", "sums", "third"])

    found = by_two(runs).mapInArrow(run, "two bigint, sums binary, third binary").toArrow()
    codes = np.asarray(found.column("two"), np.int64)
    twos, at = np.unique(codes, return_inverse=True)
    sums = np.zeros((len(twos), 511))
    for k, raw in zip(at, found.column("sums").to_pylist(), strict=True):
        sums[k] += np.frombuffer(raw)
    seen = [(np.frombuffer(raw, np.uint8).astype(np.int64) << 16) | two for two, raw in zip(codes, found.column("third").to_pylist(), strict=True)]
    below = [sums[:, 255 + (1 << bit) : 255 + (2 << bit)] for bit in range(8)]
    return Upper.fit(twos, sums[:, :256], below), np.unique(np.concatenate([np.zeros(0, np.int64), *seen]))


def fit_tree(runs: DataFrame, upper: Upper, seen: np.ndarray, most: int) -> KeptTree:
    """Rows of the ``most`` most frequent four-byte contexts of ``runs``; the driver gets no others."""
    sent = runs.sparkSession.sparkContext.broadcast(upper)
    four = F.shiftright("gram", 8)
    top = F.broadcast(stored(runs.groupBy(four.alias("context")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "context").limit(most).select("context")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, asked in blocks(batches):
            fours, _, twos, part = Part.of(gram, n)
            kept = np.isin(fours, gram[asked > 0] >> 8)
            if kept.any():
                logs = part.logs(sent.value.mixtures, np.searchsorted(sent.value.twos, twos)[part.parent])[1][kept].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(fours[kept]), pa.array([row.tobytes() for row in logs], pa.binary())], ["four", "logs"])

    flagged = runs.select("gram", "n").join(top, four == F.col("context"), "left").select("gram", "n", F.col("context").isNotNull().cast("bigint").alias("asked"))
    found = by_two(flagged).mapInArrow(run, "four bigint, logs binary").toArrow()
    codes = np.asarray(found.column("four"), np.int64)
    order = np.argsort(codes)
    rows = np.frombuffer(b"".join(found.column("logs").to_pylist()), np.float32).reshape(-1, 256)[order]
    table = np.concatenate([rows, *(logs.reshape(-1, 256).astype(np.float32) for logs in upper.logs[::-1])])
    return KeptTree(table, upper.row_of_two(len(codes)), seen, codes[order])


def open_values(runs: DataFrame, upper: Upper, asked: DataFrame) -> DataFrame:
    """(gram, value) of every distinct run of ``asked(gram)``: its log10 probability, in three-byte contexts that ``runs`` has."""
    sent = runs.sparkSession.sparkContext.broadcast(upper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, asked in blocks(batches):
            three, wanted = (gram >> 8) & 0xFFFFFF, gram[asked > 0]
            known = (asked == 0) & np.isin(three, (wanted >> 8) & 0xFFFFFF)
            if not len(wanted):
                continue
            fours, threes, twos, part = Part.of(gram[known], n[known])
            ended, found = part.logs(sent.value.mixtures, np.searchsorted(sent.value.twos, twos)[part.parent])
            at = np.minimum(np.searchsorted(fours, wanted >> 8), len(fours) - 1)
            values = np.where(fours[at] == wanted >> 8, found[at, wanted & 255], ended[np.searchsorted(threes, (wanted >> 8) & 0xFFFFFF), wanted & 255])
            yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(values)], ["gram", "value"])

    both = runs.select("gram", "n", "asked").union(asked.select("gram").distinct().select("gram", F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    return stored(by_two(both).mapInArrow(run, "gram bigint, value double"))


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", most: int = CONTEXTS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Counts come from all rows where ``train`` holds (null: not). ``score`` is the tree's log10 probability
    of the whole text, A-Z lower-cased, and its end; ``base_score`` that of its words under add-half unigrams.
    Rare words meet in a shuffle by word, where their training count is summed; frequent words (a
    bounded list) stay with their document as numbers, so no task receives a frequent word's rows. Null
    text counts as empty: one token, its end. Null ids and repeated rows: each is returned, null ids as held out wherever ``train`` is null. Values
    of the ``most`` most frequent contexts travel to the texts, places in others meet theirs in a shuffle by run: the result is the same. Very long texts are scored whole. Other columns, of whatever name,
    are not read. No training rows: c, N and V are 0. Empty table: no rows.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = stored(learn(rows.select("text", "train")))
    runs = counts.filter("gram is not null").select("gram", "n", F.lit(0).cast("bigint").alias("asked"))
    upper, seen = fit_upper(runs)
    tree = fit_tree(runs, upper, seen, most)
    total = counts.agg(F.sum("total")).first()[0] or 0
    # a task leaves out a word only well below the threshold, so what is counted here finds every frequent word
    often = [bytes(r["word"]) for r in counts.filter(F.col("word").isNotNull() & (F.col("n") * 4 * FREQUENT >= total)).select("word").orderBy("word").collect()]
    sent_tree, sent_often = context.broadcast(tree), context.broadcast(often)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, number = sent_tree.value, {w: k for k, w in enumerate(sent_often.value)}
        rows_of = fitted.rows()
        for part in slices(batches, 256):
            rids, trains = part.column(0).to_pylist(), part.column(3).to_pylist()
            texts = [lowered(t) for t in part.column(2).to_pylist()]
            scores, open_ = fitted.scores(texts, rows_of)
            words, owners, times = [], [], []
            sums, packed, tokens = [], [], []
            for rid, text in zip(rids, texts, strict=True):
                counted = Counter(text.split())
                tokens.append(counted.total() + 1)
                pairs = [(number[w], n) for w, n in counted.items() if w in number]
                packed.append(np.array(pairs, "<u4").tobytes())
                rare = [w for w in counted if w not in number] if len(pairs) < len(counted) else []
                words += rare
                owners += [rid] * len(rare)
                times += [counted[w] for w in rare]
                sums.append(END + rid.to_bytes(8, "little"))
            flags = dict(zip(rids, trains, strict=True))
            n, m = len(words), len(rids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words + sums, pa.binary()), pa.array(owners + rids, pa.int64()), pa.array(times + [0] * m, pa.int32()),
                    pa.array([flags[r] for r in owners] + trains, pa.bool_()),
                    pa.concat_arrays([pa.nulls(n, part.column(1).type), pa.concat_arrays([part.column(1)])]),
                    pa.array([None] * n + tokens, pa.int64()), pa.array([None] * n + scores.tolist(), pa.float64()), pa.array([None] * n + [len(t) for t in texts], pa.int64()), pa.array([None] * n + packed, pa.binary()), pa.array([None] * n + open_, pa.binary()),
                ],
                ["word", "rid", "tf", "train", "id", "n_tokens", "score", "n_bytes", "packed", "open"],
            )

    flat = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "text", "train").mapInArrow(scan, f"word binary, rid bigint, tf int, train boolean, id {kind}, n_tokens bigint, score double, n_bytes bigint, packed binary, open binary")
    same = Window.partitionBy("word")
    met = flat.withColumn("c", F.sum(F.when(F.col("train"), F.col("tf")).otherwise(0)).over(same)).withColumn("first", F.min("rid").over(same) == F.col("rid"))
    per_text = stored(
        met.groupBy("rid").agg(
            F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum(((F.col("c") > 0) & F.col("first")).cast("bigint")).alias("kinds"),
            F.max("train").alias("train"), F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"), F.max("n_bytes").alias("n_bytes"), F.max("packed").alias("packed"), F.max("open").alias("open"),
        )
    )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            pairs = [np.frombuffer(raw, "<i8").reshape(-1, 2) for raw in part.column(1).to_pylist()]
            both = np.concatenate(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(0)), [len(p) for p in pairs])), pa.array(both[:, 0]), pa.array(both[:, 1])], ["rid", "gram", "times"])

    asked = stored(per_text.filter(F.length("open") > 0).select("rid", "open").mapInArrow(opened, "rid bigint, gram bigint, times bigint"))
    added = stored(spread_join(asked, open_values(runs, upper, asked), "gram").groupBy("rid").agg(F.sum(F.col("times") * F.col("value")).alias("added")))
    scored = per_text.drop("open").join(F.broadcast(added) if added.count() <= BROADCAST_ROWS else added, "rid", "left").withColumn("score", F.col("score") + F.coalesce("added", F.lit(0.0)))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(sent_often.value), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pairs = np.frombuffer(raw, "<u4").reshape(-1, 2)
                found[pairs[:, 0]] += pairs[:, 1]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["k", "n"])

    known = np.zeros(len(often), np.int64)
    for r in per_text.filter("train").select("packed").mapInArrow(frequent, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        known[r["k"]] = r["n"]
    sums = per_text.agg(F.sum(F.when(F.col("train"), F.col("n_tokens"))).alias("n"), F.count(F.when(F.col("train"), 1)).alias("texts"), F.sum("kinds").alias("kinds")).first()
    trained, texts = sums["n"] or 0, sums["texts"]
    vocabulary = (sums["kinds"] or 0) + int((known > 0).sum()) + (texts > 0)
    norm = math.log10(trained + 0.5 * (vocabulary + 1))
    sent_known = context.broadcast((np.log10(known + 0.5), known > 0))
    end = math.log10(texts + 0.5)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, seen = sent_known.value
        for batch in batches:
            pairs = [np.frombuffer(raw, "<u4").reshape(-1, 2) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float((logs[p[:, 0]] * p[:, 1]).sum()) for p in pairs], pa.float64()), pa.array([int((seen[p[:, 0]] * p[:, 1]).sum()) for p in pairs], pa.int64()), *batch.columns[2:]], ["doc_id", "often", "often_known", "rare", "known", "train", "n_tokens", "score", "n_bytes"])

    last = scored.select("id", "packed", "rare", "known", "train", "n_tokens", "score", "n_bytes").mapInArrow(finish, f"doc_id {kind}, often double, often_known bigint, rare double, known bigint, train boolean, n_tokens bigint, score double, n_bytes bigint")
    return last.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.col("often_known") + F.lit(int(texts > 0))).alias("n_known"), F.lit(trained).cast("bigint").alias("train_tokens"),
        (F.col("rare") + F.col("often") + F.lit(end) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score", (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
