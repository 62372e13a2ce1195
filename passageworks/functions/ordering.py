"""Dense row numbers in a global order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def buckets(df: DataFrame, key: str, parts: int) -> Column:
    """Ordered bucket of a numeric key, cut at its quantiles; nulls come first."""
    cuts = sorted(set(df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    if not cuts:
        return F.lit(0).cast("bigint")
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k).cast("bigint") for k in range(len(cuts).bit_length() - 1, -1, -1)))
    found = F.aggregate(steps, F.lit(0).cast("bigint"), lambda low, step: F.when(F.get(table, low + step - 1) < F.col(key), low + step).otherwise(low))
    return F.when(F.col(key).isNull(), F.lit(0).cast("bigint")).otherwise(found)


def dense_ids(df: DataFrame, keys: list[str], name: str, sample: DataFrame | None = None, salt: str | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of ``keys``, the first of which is a whole number.

    Rows are ranked inside quantile buckets of the first key; the counts of the buckets, one number
    for each, place them. Rows of one first key stay together. ``sample`` has the first key's values where they
    are cheaper to read than the rows themselves. With ``salt`` each of that column's values is numbered alone; its values in
    a bucket, and so the counts, are assumed few.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [salt] if salt else []
    dealt = df.withColumn("_bucket", buckets(df if sample is None else sample, keys[0], parts))
    order = Window.partitionBy(*own).orderBy("_bucket") if own else None
    if own:
        sizes = dealt.groupBy(*own, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
        before = sizes.withColumn("_start", F.sum("_c").over(order) - F.col("_c")).drop("_c")
    else:
        starts, total = [], 0
        for bucket, size in sorted((r["_bucket"], r["count"]) for r in dealt.groupBy("_bucket").count().collect()):
            starts.append((bucket, total))
            total += size
        before = df.sparkSession.createDataFrame(starts, "_bucket bigint, _start bigint")
    place = F.row_number().over(Window.partitionBy(*own, "_bucket").orderBy(*keys)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), [*own, "_bucket"]).withColumn(name, F.col("_start") + F.col("_place")).drop("_bucket", "_place", "_start")


def carried(df: DataFrame, part: str, order: str, **values: Column) -> DataFrame:
    """``df`` with each named value's last known one so far in ``order`` (a whole number) within ``part``.

    Rows are dealt by quantile buckets of the order, so a part of any size is many tasks; the last value of each bucket, a
    few rows for each part, is carried on to the next ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"_v_{name}": value for name, value in values.items()}).withColumn("_bucket", buckets(df, order, parts))
    ends = dealt.groupBy(part, "_bucket").agg(*(F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(order, f"_v_{n}")))[f"_v_{n}"].alias(f"_e_{n}") for n in values))
    past = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(part, "_bucket", *(F.last(f"_e_{n}", ignorenulls=True).over(past).alias(f"_b_{n}") for n in values))
    here = Window.partitionBy(part, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(F.broadcast(before), [part, "_bucket"])
    found = met.withColumns({n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(here), F.col(f"_b_{n}")) for n in values})
    return found.drop("_bucket", *(f"_{k}_{n}" for n in values for k in "vb"))
