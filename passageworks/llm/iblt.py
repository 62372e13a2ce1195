"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph pieces."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from passageworks.llm.common import clean, shuffle_width, slices
from passageworks.llm.hilbert import value_edges

#: Cells of a stored fingerprint: three rows of this many. Comparisons retry with GROWTH times as many.
ROW_CELLS = 8
GROWTH = 4
#: Parts into which the rows of one id are dealt, by a hash of the text, where the id ends a bucket.
SUBS = 64
#: A paragraph is a line; it is cut further after sentences, so a text of one line has several pieces.
SENTENCE_ENDS = (". ", "! ", "? ", " | ")
#: A piece without such a cut that is longer than this is cut after words picked by their hash.
LONG_PIECE = 128
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
SHIFT = np.uint64(32)


def pieces(text: str) -> list[bytes]:
    out: list[bytes] = []
    for end in SENTENCE_ENDS:
        text = text.replace(end, f"{end[:-1]}\n")
    for piece in text.split("\n"):
        if len(piece) <= LONG_PIECE:
            if piece:
                out.append(piece.encode())
            continue
        run: list[bytes] = []
        for word in piece.encode().split(b" "):
            run.append(word)
            if xxhash.xxh32_intdigest(word) % 8 == 0:
                out.append(b" ".join(run))
                run = []
        if run:
            out.append(b" ".join(run))
    return out


def digests(text: str | None) -> np.ndarray:
    """One distinct 64-bit digest for each piece; the k-th repetition of a piece has its own."""
    parts = pieces(text or "")
    first = list(map(xxhash.xxh64_intdigest, parts))
    if len(set(first)) < len(first):
        seen: dict[bytes, int] = {}
        for k, part in enumerate(parts):
            n = seen.get(part, 0)
            seen[part] = n + 1
            if n:
                first[k] = xxhash.xxh64_intdigest(part, n)
    return np.unique(np.array(first, np.uint64))


@dataclass
class Sketches:
    """One sketch for each of ``n`` texts, side by side: counts, key sums and check sums (by xor)."""

    n: int
    width: int
    counts: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.n, self.width, self.counts - other.counts, self.keys ^ other.keys, self.checks ^ other.checks)

    def packed(self, k: int) -> bytes:
        cells = slice(k * 3 * self.width, (k + 1) * 3 * self.width)
        return self.counts[cells].astype("<i2").tobytes() + self.keys[cells].astype("<u8").tobytes() + self.checks[cells].astype("<u4").tobytes()


def check_of(keys: np.ndarray) -> np.ndarray:
    return ((keys * MULTIPLIERS[3]) >> SHIFT).astype(np.uint32)


def cells_of(keys: np.ndarray, owners: np.ndarray, width: int, row: int) -> np.ndarray:
    mixed = keys * MULTIPLIERS[row]
    return owners * (3 * width) + row * width + ((mixed ^ (mixed >> SHIFT)) % np.uint64(width)).astype(np.int64)


def build(sets: list[np.ndarray], width: int = ROW_CELLS) -> Sketches:
    n = len(sets)
    out = Sketches(n, width, np.zeros(n * 3 * width, np.int64), np.zeros(n * 3 * width, np.uint64), np.zeros(n * 3 * width, np.uint32))
    keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(n), [len(s) for s in sets])
    checks = check_of(keys)
    for row in range(3):
        at = cells_of(keys, owners, width, row)
        out.counts += np.bincount(at, minlength=len(out.counts))
        np.bitwise_xor.at(out.keys, at, keys)
        np.bitwise_xor.at(out.checks, at, checks)
    return out


def peel(sketch: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, sign) of every recovered digest, and which texts peeled to nothing."""
    width, found = sketch.width, []
    counts, keys, checks, taken = sketch.counts.copy(), sketch.keys.copy(), sketch.checks.copy(), 0
    while taken <= len(counts):  # a cell that is pure by chance could go on for ever; no true recovery exceeds the cells
        pure = np.flatnonzero((np.abs(counts) == 1) & (check_of(keys) == checks))
        if not len(pure):
            break
        owners, got, signs = pure // (3 * width), keys[pure], counts[pure]
        order = np.lexsort((got, owners))
        owners, got, signs = owners[order], got[order], signs[order]
        new = np.concatenate(([True], (np.diff(owners) != 0) | (got[1:] != got[:-1])))
        owners, got, signs = owners[new], got[new], signs[new]
        found.append((owners, got, signs))
        taken += len(got)
        for row in range(3):
            at = cells_of(got, owners, width, row)
            np.subtract.at(counts, at, signs)
            np.bitwise_xor.at(keys, at, got)
            np.bitwise_xor.at(checks, at, check_of(got))
    empty = ((counts == 0) & (keys == 0)).reshape(sketch.n, -1).all(axis=1)
    owner, key, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return owner, key, sign, empty


def differences(left: list[np.ndarray], right: list[np.ndarray], base: tuple[Sketches, Sketches] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of texts the digests that only the left and only the right one has.

    The base sketches are subtracted and peeled; pairs that do not peel to nothing are sketched anew with
    GROWTH times the cells, and so on until all have: from about as many cells as digests on, nearly every sketch peels.
    """
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(left)
    open_, width = list(range(len(left))), ROW_CELLS
    while open_:
        a, b = base if base and width == ROW_CELLS else (build([left[k] for k in open_], width), build([right[k] for k in open_], width))
        owner, key, sign, empty = peel(a.minus(b))
        bounds = np.argsort(owner, kind="stable")
        owner, key, sign = owner[bounds], key[bounds], sign[bounds]
        cuts = np.searchsorted(owner, np.arange(len(open_) + 1))
        for i, k in enumerate(open_):
            if empty[i]:
                keys, signs = key[cuts[i] : cuts[i + 1]], sign[cuts[i] : cuts[i + 1]]
                out[k] = keys[signs > 0], keys[signs < 0]
        open_ = [k for i, k in enumerate(open_) if not empty[i]]
        width *= GROWTH
    return out


def likeness(a: np.ndarray, b: np.ndarray, only: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared pieces over all pieces; 1 for two texts without any."""
    apart, both = len(only[0]) + len(only[1]), len(a) + len(b)
    return 1.0 if both == 0 else (both - apart) / (both + apart)


def text_of(sketch: Sketches, k: int, n: int) -> str:
    return f"iblt{3 * sketch.width}:{n}:{base64.b64encode(sketch.packed(k)).decode()}"


def edited(text: str, following: str) -> str:
    part = len(text) // 3
    return text[: len(text) - part] + following[:part]


def quantiles(docs: DataFrame, id_col: str, parts: int) -> list:
    """At most ``parts`` - 1 distinct ids, descending, that cut the rows into about equal runs; ids of any ordered type."""
    if isinstance(docs.schema[id_col].dataType, NumericType):
        found = docs.agg(F.percentile_approx(id_col, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    else:
        found = value_edges(docs, id_col, parts)
    return sorted(set(found or []), reverse=True)


def bucket_of(cuts: list, kind: str) -> Column:
    """Bucket of a row in descending order of id, nulls last. The rows of a cutting id are buckets of their own, dealt by text."""
    table = F.array(*map(F.lit, cuts)).cast(f"array<{kind}>")
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length(), -1, -1)))
    above = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & (F.get(table, low + step - 1) > F.col("id")), low + step).otherwise(low)) if cuts else F.lit(0)
    own = F.get(table, above) == F.col("id") if cuts else F.lit(False)
    sub = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 64 - SUBS.bit_length() + 1)
    place = F.when(F.col("id").isNull(), F.lit(2 * len(cuts) + 2)).otherwise(2 * above + F.coalesce(own, F.lit(False)).cast("int"))
    return place.cast("bigint") * SUBS + F.when(F.col("id").isNull() | own, sub).otherwise(F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, extra, id, text): rows dealt by descending id, each bucket followed by a copy of the next bucket's first row.

    So every row's successor lies in its own partition, and no task sees the whole order; the rows of one id, or without one,
    are dealt by a hash of their text. One id and count for each bucket comes to the driver, at most (2 x partitions + 2) x SUBS.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))
    parts, kind = shuffle_width(spark), docs.schema[id_col].dataType.simpleString()
    dealt = narrow.withColumn("bucket", bucket_of(quantiles(narrow, "id", parts), kind))
    heads = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", F.bitwise_not("h").alias("h"))).alias("first")).orderBy("bucket").collect()
    total, before, part = sum(r["n"] for r in heads), 0, {}
    for r in heads:
        part[r["bucket"]] = min(parts - 1, before * parts // total)
        before += r["n"]
    turns = [(r["first"]["id"], ~r["first"]["h"], heads[k - 1]["bucket"], part[heads[k - 1]["bucket"]]) for k, r in enumerate(heads)]
    firsts = F.broadcast(spark.createDataFrame(turns, f"head {kind}, head_h bigint, before bigint, before_part int"))
    placed = F.broadcast(spark.createDataFrame(list(part.items()), "bucket bigint, part int"))
    marked = dealt.join(placed, "bucket").join(firsts, F.col("id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"), F.col("part"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"), F.col("before_part").alias("part"))))
    rows = marked.select("id", "h", "text", F.explode(places).alias("place")).select("place.*", "id", "h", "text")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket", "extra", F.desc_nulls_last("id"), "h", "text").select("bucket", "extra", "id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, only_before, only_after).

    ``edited`` is the text with its last third replaced by the start of the next text in descending id
    order (after the last: the first). Likeness is the Jaccard index of pieces, from the digests that
    subtracting and peeling the two sketches recovers; ``only_before`` and ``only_after`` count the
    digests that the edit removed and added. Null or empty text: no pieces, likeness 1 to another such,
    0 to any other. Rows of equal id, and those without one (which come last), are ordered by a hash of their text. One row: its own successor.
    Ids may be of any ordered type. Very long texts are cut whole. Other columns, of whatever name, are not read. Empty table: no
    rows. Equal texts have equal fingerprints.
    """
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)

    def finish(rows: list[tuple[int, str, np.ndarray]]) -> pa.RecordBatch:
        """All rows but the last, each with the next as its successor."""
        here, following = rows[:-1], rows[1:]
        changed = [edited(t, n) for (_, t, _), (_, n, _) in zip(here, following, strict=True)]
        own, after, nexts = [r[2] for r in here], [digests(t) for t in changed], [r[2] for r in following]
        mine, theirs = build(own), build(after)
        edits = differences(own, after, (mine, theirs))
        turns = differences(own, nexts)
        columns = {
            "doc_id": pa.array([r[0] for r in here], id_type),
            "n_chars": pa.array([len(r[1]) for r in here], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            "fingerprint": pa.array([text_of(mine, k, len(s)) for k, s in enumerate(own)], pa.string()),
            "edited_fingerprint": pa.array([text_of(theirs, k, len(s)) for k, s in enumerate(after)], pa.string()),
            "near_edited": pa.array([likeness(*x) for x in zip(own, after, edits, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(*x) for x in zip(own, nexts, turns, strict=True)], pa.float64()),
            "only_before": pa.array([len(e[0]) for e in edits], pa.int64()),
            "only_after": pa.array([len(e[1]) for e in edits], pa.int64()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, closed = None, [], False
        for part in slices(batches, 256):
            for b, extra, i, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if b != bucket:
                    bucket, rows, closed = b, [], False
                if not closed:
                    rows.append((i, text or "", digests(text)))
                    closed = extra
                    if extra or len(rows) > 256:
                        yield finish(rows)
                        rows = [] if extra else rows[-1:]

    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, only_before bigint, only_after bigint"
    return with_next(clean(docs, id_col, text_col), id_col, text_col).mapInArrow(run, schema)
