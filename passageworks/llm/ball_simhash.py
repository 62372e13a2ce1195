"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passageworks.llm.common import bounded_join, checkpoint, clean, slices, spread_join, stored
from passageworks.llm.components import components

SEED = 42
BITS = 64
#: Near copies: fingerprints of TABLE_BITS bits for each text, two to a 64-bit word. They only find most links of large groups
#: early, at two bits in any one; every other link comes from shared shingles, whatever these are.
TABLES, TABLE_BITS = 2, 32
#: Parity words of a shingle set: as many bits as differ, so many members at least are not common.
PARITY = 8
#: Shingles are ordered by how many texts of a sample hold them: one text in SAMPLE_SHARE, but SAMPLE_TEXTS at least; those of
#: two or more, OFTEN at most. Any order gives the same links; this one keeps the groups that share a shingle small.
SAMPLE_SHARE, SAMPLE_TEXTS, OFTEN = 100, 20_000, 1_000_000
#: Groups up to this size are compared side by side, larger ones row by row.
SMALL_GROUP = 16
#: A row of a larger group is first looked at with so many of its nearest, then with WIDER times as many of those still of another class, and so on.
NEAREST, WIDER = 8, 8
#: Each byte as eight lanes of one bit, most significant first, so that byte sums of 255 rows count bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8).copy().view(np.uint64)[:, 0]
MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], np.uint64)


def shingles_of(text: str | None, shingle: int) -> list[bytes]:
    """Word shingles, repeats included; fewer words than ``shingle`` form one, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    whole, count = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    return [whole[a:b] for a, b in zip(starts, stops, strict=True)]


def ones_of(raw: np.ndarray) -> np.ndarray:
    """How many rows of a byte matrix have each bit set."""
    lanes = np.add.reduceat(LANES[raw], np.arange(0, len(raw), 255), axis=0)
    return lanes.view(np.uint8).reshape(len(lanes), -1).sum(axis=0, dtype=np.int64)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: bit set where over half the shingle hashes have it.

    Words are runs of anything but space and U+0009..U+000D after lower-casing A-Z; fewer words than
    ``shingle`` form one shingle; no words (or null) give 0.
    """
    found = shingles_of(text, shingle)
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in found), np.uint64, len(found)).astype(">u8")
    return int(np.packbits(ones_of(hashes.view(np.uint8).reshape(-1, 8)) * 2 > len(found)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = pa.array([simhash(t, shingle) for t in part.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return clean(docs, id_col, text_col).mapInArrow(run, f"id {kind}, fp bigint")


def ball(fp: Column, bits: int) -> Column:
    """A fingerprint of ``bits`` bits and all that differ from it in one."""
    flips = [1 << k if k < 63 else -(1 << 63) for k in range(bits)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(flip).cast("bigint")) for flip in flips))


def near_links(reps: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints of ``reps(fp)`` that differ in at most two bits.

    Each fingerprint emits the 65 values within one bit of it. Two fingerprints within two bits share
    a value, and all that share one are within two bits of each other, so linking each to the least
    of its value loses no link of a component. A value has at most 65 emitters: no group can be hot.
    """
    met = reps.select("fp", F.explode(ball(F.col("fp"), BITS)).alias("variant")).withColumn("head", F.min("fp").over(Window.partitionBy("variant")))
    return (
        met.filter("fp <> head")
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= 2)
        .select(F.col("head").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )


def ball_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): SimHash classes of all rows at two or fewer differing bits.

    component_id is the smallest id reachable over links, the row's own included. Rows of equal
    fingerprint collapse to one representative before any link is sought. Null or wordless text:
    fingerprint zero, linked like any other. Repeated rows: each is returned. Null ids: returned, and
    never chosen as component_id unless the whole component has none. Ties (a bit set in just half the hashes):
    the bit is 0. Very long texts are read whole. Other columns, of whatever name, are not read. Empty table: no rows.
    """
    fps = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    reps = checkpoint(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    labels = components(near_links(reps))
    known = checkpoint(reps.join(labels, reps.fp == labels.node, "left").select("fp", "rep", "n", F.coalesce("label", "fp").alias("label")))
    least = known.groupBy("label").agg(F.min("rep").alias("component"))
    classes = checkpoint(spread_join(known, least, "label").select("fp", "component"))
    return spread_join(fps, classes, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending."""
    found = shingles_of(text, shingle)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in found), np.uint64, len(found)))


def wide_simhash(grams: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit fingerprints of a shingle set, each under its own mixing of the hashes."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(grams), 1 << 12):
        x = grams[at : at + (1 << 12), None] + np.arange(1, words + 1, dtype=np.uint64) * MIX[2]
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        x ^= x >> np.uint64(31)
        ones += ones_of(x.view(np.uint8).reshape(len(x), 8 * words))
    return np.packbits(ones * 2 > len(grams)).view(np.int64)


def parity(grams: np.ndarray, words: int = PARITY) -> np.ndarray:
    """For each residue of the hashes one bit: whether an odd number of the set's members has it."""
    odd = np.bincount((grams % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(grams: np.ndarray) -> bytes:
    """Parities of at least four residues a member, PARITY times a power of two words."""
    words = PARITY
    while 16 * words < len(grams):
        words *= 2
    return parity(grams, words).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits that differ in two wide parities; the wider one is folded to the residues of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(w.reshape(-1, size), axis=0) for w in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def rarest(grams: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first fifth of a set, and one more, by sampled count and hash.

    Of two sets with a Jaccard index of 0.8 or more at least 4/5 of each are common, so the first common member is here in both.
    """
    held = np.zeros(len(grams), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        held = np.where(often[at] == grams, counts[at], 0)
    return grams[np.argsort(held, kind="stable")[: len(grams) - (4 * len(grams) + 4) // 5 + 1]]


def often_shared(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, ascending, that two or more distinct texts of a sample of ``texts(text, t1, t2, ...)`` hold, and of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams, held = np.unique(np.concatenate([shingle_set(t, shingle) for t in part.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(held)], ["gram", "held"])

    share = max(1, min(SAMPLE_SHARE, texts.count() // SAMPLE_TEXTS))
    some = texts.filter(F.pmod("t1", F.lit(share)) == 0).select("text", "t1", "t2").dropDuplicates(["t1", "t2"]).select("text")
    found = some.mapInArrow(run, "gram bigint, held bigint").groupBy("gram").agg(F.sum("held").alias("held")).filter("held > 1")
    found = found.orderBy(F.desc("held"), "gram").limit(OFTEN).toArrow()
    grams = np.asarray(found.column("gram"), np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.asarray(found.column("held"), np.int64)[order]


def shingle_fingerprints(texts: DataFrame, shingle: int, words: int) -> DataFrame:
    """(rest..., node, n, f0, f1, ..., p0, p1, ..., wide, first) for every row of ``texts(text, rest...)``; node is a hash of the whole shingle set, first its rarest members."""
    sent = texts.sparkSession.sparkContext.broadcast(often_shared(texts, shingle))
    names = ["node", "n", *(f"f{k}" for k in range(words)), *(f"p{k}" for k in range(PARITY)), "wide", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = sent.value
        for part in slices(batches):
            sets = [shingle_set(t, shingle) for t in part.column(0).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            marks = np.array([np.concatenate([wide_simhash(s, words), parity(s)]) for s in sets], np.int64).reshape(-1, words + PARITY)
            first = [rarest(s, often, counts).view(np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(marks[:, k]) for k in range(words + PARITY)), pa.array([wide_parity(s) for s in sets], pa.binary()), lists], [*part.schema.names[1:], *names])

    rest = ", ".join(f"{name} {kind}" for name, kind in texts.dtypes[1:])
    return texts.mapInArrow(run, f"{rest}, node bigint, n int, " + ", ".join(f"{name} bigint" for name in names[2:-2]) + ", wide binary, first array<bigint>")


def ball_pairs(reps: DataFrame, words: range) -> DataFrame:
    """Distinct (a, b), a < b, of ``reps(rid, f0, f1, ...)`` with a fingerprint in one of ``words`` within two bits of each other's.

    Each 32-bit fingerprint emits all values within one bit. All that share a value stand in the order of their numbers, and each
    meets the one before it, so a value that many sets emit costs as many comparisons as it has sets, never all
    pairs; sets that are alike share many values, with other sets between them there.
    """
    low = F.lit((1 << TABLE_BITS) - 1)
    fps = [half for k in words for half in (F.col(f"f{k}").bitwiseAND(low), F.shiftrightunsigned(f"f{k}", TABLE_BITS))]
    flips = F.transform(F.sequence(F.lit(0), F.lit(TABLE_BITS)), lambda k: F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.pow(F.lit(2), k - 1).cast("bigint")))
    keys = F.flatten(F.transform(F.array(*(fp + F.lit(t << TABLE_BITS) for t, fp in enumerate(fps))), lambda fp: F.transform(F.col("flips"), lambda flip: fp.bitwiseXOR(flip))))
    met = reps.withColumn("flips", flips).select("rid", F.explode(keys).alias("key"))
    before = F.lag("rid").over(Window.partitionBy("key").orderBy("rid"))
    return met.withColumn("other", before).filter("other is not null").select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).distinct()


def differing(marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ in the parities of rows ``a`` and ``b``."""
    return np.bitwise_count((marks[a] ^ marks[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)


def may_be_alike(n: np.ndarray, left: np.ndarray, marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets of rows ``a`` and ``b`` can have a Jaccard index of 4/5, for all that their sizes, the members ``left`` from a first common one on, and their parities tell."""
    both = n[a] + n[b]
    found = (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])) & (9 * np.minimum(left[a], left[b]) >= 4 * both)
    at = np.flatnonzero(found)
    a, b = (np.broadcast_to(x, found.shape)[at] for x in (a, b))
    found[at] = 9 * differing(marks, a, b) <= both[at]
    return found


def group_pairs(key: np.ndarray, rid: np.ndarray, was: np.ndarray, label: np.ndarray, n: np.ndarray, left: np.ndarray, marks: np.ndarray, low: int = 0, high: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (rows of two) of ``rid`` of one key and of two labels that may be alike, and the keys that have more of them; rows stand by key and rid.

    In groups over SMALL_GROUP the pairs of a row are ranked, nearest first, by what does not change from round to round (``was``,
    the labels before the first); those of the ranks ``low`` to ``high`` are given whose labels differ by now. So over all rounds each pair is given
    or has become one of a class. Small groups are done in the first round.
    """
    found, more = [], []
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((start, [len(key)])))
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    for step in range(1, min(SMALL_GROUP, len(key)) if low == 0 else 0):
        a = np.flatnonzero(small[step:] & (key[step:] == key[:-step]) & (label[step:] != label[:-step]))
        if len(a):
            a = a[may_be_alike(n, left, marks, a, a + step)]
            found.append(np.stack([rid[a], rid[a + step]], axis=1))
    for at in np.flatnonzero(sizes > SMALL_GROUP):
        rows = np.arange(start[at], start[at] + sizes[at])
        if (label[rows] == label[rows[0]]).all():
            continue
        labels, which, times = np.unique(was[rows], return_inverse=True, return_counts=True)
        # each row that is not of the commonest label against the rows of that label and those before it
        main = which == times.argmax()
        for k in np.flatnonzero(~main):
            others = rows[(main | (np.arange(len(rows)) < k)) & (which != which[k])]
            others = others[may_be_alike(n, left, marks, rows[k], others)]
            if len(others) > high or low:
                far = differing(marks, np.full(len(others), rows[k]), others) / (n[rows[k]] + n[others])
                others = others[np.lexsort((rid[others], far))]
                if (label[others[high:]] != label[rows[k]]).any():
                    more.append(key[start[at]])
                others = others[low:high]
                others = others[label[others] != label[rows[k]]]
            found.append(np.stack([np.full(len(others), rid[rows[k]]), rid[others]], axis=1))
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs, np.unique(np.array(more, np.int64))


def sharers(reps: DataFrame) -> DataFrame:
    """(key, rid, place) of ``reps(rid, first)``: the rarest members that two sets share."""
    held = reps.select("rid", F.posexplode("first").alias("place", "key"))
    same = Window.partitionBy("key")
    return held.withColumns({"low": F.min("rid").over(same), "high": F.max("rid").over(same)}).filter("low <> high").select("key", "rid", "place")


def shared_pairs(shared: DataFrame, reps: DataFrame, known: DataFrame, low: int = 0, high: int = NEAREST) -> DataFrame:
    """(key, a, b): distinct a < b, of ``reps(rid, n, p0, ...)`` under two labels of ``known(rid, was, label)`` that may have a Jaccard index of 4/5; and a row with a key of ``shared`` for each group that has more than were asked for (``group_pairs``).

    Sets of that index share one of their rarest members. Size, place and parity of the set go with each; who shares one meets
    in one group, and what sizes, places and parities rule out goes there.
    """
    marks = [f"p{k}" for k in range(PARITY)]
    met = shared.join(reps.join(known, "rid").select("rid", "was", "label", F.col("n").cast("bigint").alias("n"), *marks), "rid")
    met = met.select("key", "rid", "was", "label", "n", (F.col("n") - F.col("place")).alias("left"), *marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last = [], None

        def pairs() -> pa.RecordBatch:
            rows = np.concatenate(open_)
            found, more = group_pairs(*(rows[:, k] for k in range(6)), np.ascontiguousarray(rows[:, 6:]), low, high)
            none = [pa.nulls(k, pa.int64()) for k in (len(found), len(more))]
            columns = [pa.concat_arrays(x) for x in ((none[0], pa.array(more)), (pa.array(found[:, 0]), none[1]), (pa.array(found[:, 1]), none[1]))]
            return pa.RecordBatch.from_arrays(columns, ["key", "a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(c, np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            # the last key may go on in the next batch
            cut = np.searchsorted(rows[:, 0], rows[-1, 0])
            if cut or rows[-1, 0] != last:
                open_.append(rows[:cut])
                yield pairs()
                open_ = [rows[cut:]]
            else:
                open_.append(rows)
            last = rows[-1, 0]
        if open_:
            yield pairs()

    return met.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(run, "key bigint, a bigint, b bigint").distinct()


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known(rid, was, label)`` after ``links(a, b)``: components are sought between classes, not between rows, so a link within one costs nothing more."""
    a, b = (known.select(F.col("rid").alias(side), F.col("label").alias(f"l{side}")) for side in "ab")
    between = links.join(a, "a").join(b, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    found = components(between).toDF("label", "least")
    names = checkpoint(known.select("label").distinct().join(found, "label", "left").select("label", F.coalesce("least", "label").alias("least")))
    return stored(spread_join(known, names, "label").select("rid", "was", F.col("least").alias("label")))


def not_apart(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that the wide parities of ``reps(rid, n, wide, ...)`` do not rule out: far fewer bytes than whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4))
            some = pa.array([9 * apart(v, w) <= n for n, v, w in zip(sizes, x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(some)

    a, b = (reps.select(F.col("rid").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}")) for side in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "wide_a", "wide_b").mapInArrow(run, "a bigint, b bigint")


def near_copies(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 5, tables: int = TABLES) -> DataFrame:
    """(keep..., label) for every row: classes of rows linked by a Jaccard index of 0.8 or more of word shingles, no link left out.

    Rows of one shingle set collapse first. Ball hashing finds most links of large groups: links are sought between sets of which one of
    ``tables`` 32-bit fingerprints (an even number) differs in at most two bits. Then every two sets that are not of one class by then and share
    one of their rarest shingles (``shared_pairs``) are looked at, in rounds: in large groups each row meets its nearest first, and only those that are
    still of another class after that meet in the next. Every candidate is verified on the whole sets.
    Texts of fewer words than ``shingle`` form one shingle; null and wordless texts are one class; repeated rows are each
    returned, with one label; very long texts are read whole; other columns are not read. Empty table: no rows.
    """
    words = tables // 2
    named = [f"k{j}" for j in range(len(keep))]
    texts = clean(docs, text_col, *keep).toDF("text", *named).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(SEED), F.col("text"))})
    base = stored(shingle_fingerprints(texts, shingle, words))
    fs, ps = [f"f{k}" for k in range(words)], [f"p{k}" for k in range(PARITY)]
    reps = base.groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct("t1", "t2", *named[:1])).alias("at"), *(F.min(f).alias(f) for f in fs + ps), F.min("wide").alias("wide"), F.first("first").alias("first"))
    reps = stored(reps.withColumn("rid", F.monotonically_increasing_id()))
    wordy = reps.filter("n > 0")
    a, b = (reps.select(F.col("rid").alias(side), F.struct("n", *ps).alias(f"of_{side}")) for side in "ab")
    differ = sum((F.bit_count(F.col(f"of_a.{p}").bitwiseXOR(F.col(f"of_b.{p}"))) for p in ps), F.lit(0))
    least, most = F.least("of_a.n", "of_b.n"), F.greatest("of_a.n", "of_b.n")
    alike = (5 * least >= 4 * most) & (9 * differ <= least + most)
    near = stored(ball_pairs(wordy, range(words)).join(a, "a").join(b, "b").filter(alike).select("a", "b"))
    first = verified(near, texts, reps, shingle, named[0])
    known = reps.join(components(first).withColumnRenamed("node", "rid"), "rid", "left").select("rid", F.coalesce("label", "rid").alias("label"))
    known = stored(known.select("rid", F.col("label").alias("was"), "label"))
    shared, tried, low, high = stored(sharers(wordy)), None, 0, NEAREST
    while True:
        found = stored(shared_pairs(shared, wordy, known, low, high))
        pairs = found.filter("a is not null").select("a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        links = verified(stored(not_apart(pairs, reps)), texts, reps, shingle, named[0])
        if links.limit(1).count():
            known = merged(known, links)
        more = found.filter("key is not null").select("key")
        if not more.limit(1).count():
            break
        shared, low, high = stored(shared.join(more, "key", "left_semi")), high, WIDER * high
        tried = pairs if tried is None else tried.union(pairs)
    classes = reps.join(known, "rid").select("node", "label")
    return spread_join(base, classes, "node").select(*(F.col(n).alias(c) for n, c in zip(named, keep, strict=True)), "label")


def verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, shingle: int, first: str) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole shingle sets have a Jaccard index of 4/5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["rid", "grams"])

    asked = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    where = stored(reps.join(asked, "rid", "left_semi").select("rid", "at.*").withColumnRenamed(first, "first_key"))
    met = bounded_join(texts.withColumnRenamed(first, "first_key"), where, ["t1", "t2"], F.col("_l.first_key").eqNullSafe(F.col("_r.first_key"))).select("_r.rid", "_l.text")
    sets = stored(met.dropDuplicates(["rid"]).mapInArrow(run, "rid bigint, grams array<bigint>"))
    both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return stored(both.filter(9 * shared >= 4 * (F.size("s") + F.size("t"))).select("a", "b"))
