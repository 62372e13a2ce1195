"""Shards along a Hilbert curve over several metadata dimensions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passageworks.llm.common import checkpoint, shuffle_width, stored

#: Bits of each dimension; with three dimensions the curve has 2^15 cells, which bounds the cell table.
BITS = 5


def hilbert_index(bins: list[Column], bits: int = BITS) -> Column:
    """Distance along the Hilbert curve of a cell with one bin of ``bits`` bits for each dimension."""
    n = len(bins)

    def step(x: Column, k: Column) -> Column:
        q = F.pow(F.lit(2), F.lit(bits - 1) - F.floor(k / n)).cast("bigint")
        i = (k % n).cast("int")
        there, first = F.get(x, i), F.get(x, F.lit(0))
        hit = there.bitwiseAND(q) != 0
        t = F.when(hit, q - 1).otherwise(first.bitwiseXOR(there).bitwiseAND(q - 1))
        return F.transform(x, lambda v, j: v.bitwiseXOR(F.when((j == 0) & (hit | (i != 0)), t).when((j == i) & ~hit & (i != 0), t).otherwise(F.lit(0).cast("bigint"))))

    cell = F.array(*(b.cast("bigint") for b in bins))
    turned = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), cell, step)
    gray = F.aggregate(turned, F.array().cast("array<bigint>"), lambda out, v: F.concat(out, F.array(v.bitwiseXOR(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0).cast("bigint"))))))

    def interleave(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        t = F.aggregate(F.sequence(F.lit(1), F.lit(bits - 1)), F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseXOR(F.when(F.pmod(F.floor(last / F.pow(F.lit(2), k)), F.lit(2)) == 1, F.pow(F.lit(2), k).cast("bigint") - 1).otherwise(F.lit(0).cast("bigint"))))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(bits * n - 1)),
            F.lit(0).cast("bigint"),
            lambda acc, k: acc * 2 + F.pmod(F.floor(F.get(x, (k % n).cast("int")).bitwiseXOR(t) / F.pow(F.lit(2), F.lit(bits - 1) - F.floor(k / n))), F.lit(2)),
        )

    return F.get(F.transform(F.array(gray), interleave), F.lit(0)).cast("bigint")


def placed(docs: DataFrame, shards: int, id_col: str, text_col: str, strings: tuple[str, ...], bits: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, curve, keep0, ...) for every row; see ``hilbert_shards``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    dims = [f"d{i}" for i in range(len(strings))]
    narrow = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
            *(F.col(f"`{c}`").cast("string").alias(d) for c, d in zip(strings, dims, strict=True)), *(F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)),
        )
    )
    parts = 1 << bits
    found = narrow.agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("size", [k / parts for k in range(1, parts)], 10_000).alias("size")).first()
    rows, edges = found["rows"], [value_edges(narrow, d, parts) for d in dims] + [found["size"] or []]
    bins = [sum((F.coalesce(F.col(d) > e, F.lit(False)).cast("int") for e in marks), F.lit(0)) for d, marks in zip([*dims, "size"], edges, strict=True)]
    cell = sum((b * (1 << bits * i) for i, b in enumerate(bins)), F.lit(0))
    kept = [f"keep{i}" for i in range(len(keep))]
    binned = narrow.select("doc_id", "size", "text_crc32", cell.alias("cell"), F.pmod("salt", F.lit(shuffle_width(spark))).alias("salt"), *kept)

    counts = checkpoint(binned.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n")))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("curve", hilbert_index([F.floor(F.col("cell") / (1 << bits * i)) % (1 << bits) for i in range(len(bins))], bits))
    cells = cells.withColumn("before", F.sum("n").over(Window.orderBy("curve")) - F.col("n")).select("cell", "curve", "before")
    salts = counts.withColumn("inside", F.sum("n").over(Window.partitionBy("cell").orderBy("salt")) - F.col("n"))
    starts = salts.join(F.broadcast(cells), "cell").select("cell", "salt", "curve", (F.col("before") + F.col("inside")).alias("start"))

    place = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("text_crc32", "size", "doc_id")) - 1
    ranked = binned.join(starts, ["cell", "salt"]).withColumn("rank", (F.col("start") + place).cast("bigint"))
    shard = F.expr(f"rank * {shards} div {max(rows, 1)}")
    slot = F.expr(f"rank - (shard * {rows}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "curve", *kept)


def value_edges(df: DataFrame, column: str, parts: int) -> list[str]:
    """Ascending values at the ends of ``parts`` equal runs of rows (one value may end several), from exact counts of all values.

    Counts of distinct values are ranged and added up within each range; one sum for each range and ``parts`` - 1 values
    at most come to the driver. Nulls are not counted.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange(shuffle_width(df.sparkSession), "v").withColumn("p", F.spark_partition_id()))
    before, total = [], 0
    for r in sorted(ranged.groupBy("p").agg(F.sum("n").alias("n")).collect()):
        before.append((r["p"], total))
        total += r["n"]
    if not total:
        return []
    starts = df.sparkSession.createDataFrame(before, "p int, start bigint")
    upto = ranged.join(F.broadcast(starts), "p").withColumn("upto", F.col("start") + F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    mark = lambda c: F.least(F.floor(c * parts / total), F.lit(parts - 1))
    crossed = upto.select("v", (mark(F.col("upto")) - mark(F.col("upto") - F.col("n"))).alias("times")).filter("times > 0")
    return [v for v, times in sorted((r["v"], r["times"]) for r in crossed.collect()) for _ in range(times)]


def hilbert_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row.

    Dimensions are the string columns and the text's size, each cut at quantiles of its whole values into
    2^bits bins. Rows are ordered by curve index and cut into runs whose counts differ by one at most
    (law ``rows``). A cell may hold any part of all rows, so within it rows are ranked by salt (a hash of
    the row's place in the input): a (cell, salt) is ranked in one task and the counts of all give its place. Null text: size 1
    and crc32 0; null metadata sorts first; null and repeated ids are rows like any other; equal rows take slots in any order;
    very long texts count whole; other columns, of whatever name, are not read; empty table: no rows.
    """
    found = placed(docs, shards, id_col, text_col, strings, bits)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> None:
    """Write every row of ``docs``, all columns, as one folder for each shard, rows in curve order, for file pruning.

    Rows travel whole through the ranking, so repeated and null ids lose or double none. The column ``shard`` is the folder's;
    a column of ``docs`` with that name is written as ``shard_``.
    """
    names = docs.columns
    found = placed(docs, shards, id_col, text_col, strings, bits, tuple(names))
    rows = found.select("shard", F.col("slot").alias("_slot"), *(F.col(f"keep{i}").alias("shard_" if c == "shard" else c) for i, c in enumerate(names)))
    rows.repartition("shard", F.floor(F.col("_slot") / 1_000_000)).sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
