"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes up to which a side whose size the optimiser knows may be broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimiser's estimate of its size is under the limit, else df as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def exact_sum(column: str | Column, scale: int = 4) -> Column:
    """A sum that doesn't depend on the order of rows: over decimals, given back as double."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")


def as_of_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row at or before left_time for the same key; null where there is none.

    One shuffle by key of the union of both sides and one running last(); no pair of rows is ever built. Right rows
    with a null key or time match nothing, and neither do left rows with one, which stay with nulls and aren't shuffled.
    Of right rows of one time the one whose values are greatest counts, in the order of values.
    """
    kinds = dict(right.dtypes)
    there = F.col(on).isNotNull() & F.col(left_time).isNotNull()
    row = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    carried = F.struct(*[F.lit(None).cast(kinds[v]).alias(f"v{i}") for i, v in enumerate(values)])
    a = left.where(there).select(F.col(on).alias("key"), F.col(left_time).alias("time"), F.lit(1).alias("side"), row(left), carried.alias("held"))
    none = F.lit(None).cast(a.schema["row"].dataType).alias("row")
    held = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("held")
    b = right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull()).select(F.col(on).alias("key"), F.col(right_time).alias("time"), F.lit(0).alias("side"), none, held)
    w = W.partitionBy("key").orderBy("time", "side", "held").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = F.last(F.when(F.col("side") == 0, F.col("held")), ignorenulls=True).over(w)
    joined = a.union(b).withColumn("last", seen).where("side = 1").select("row", "last")
    alone = left.where(~F.coalesce(there, F.lit(False))).select(row(left), carried.alias("last"))
    out = joined.union(alone)
    return out.select(*[F.col("row").getField(c).alias(c) for c in left.columns], *[F.col("last").getField(f"v{i}").alias(v) for i, v in enumerate(values)])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at < high: ranges are cut at multiples of width and meet points in an equi-join on the cell."""
    cell = F.floor(F.col(at) / width)
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    left = points.withColumn("_cell", cell)
    right = ranges.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(cells))
    return left.join(right, "_cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each partition to k rows a group before the shuffle."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k)


def median_by_counts(df: DataFrame, key: str, value: str, at: float = 0.5, name: str = "median") -> DataFrame:
    """The exact percentile of value for each key, null values aside, without gathering a key's rows.

    percentile() holds every value of a group; here rows are counted by key and value first, which combines before
    the shuffle, and only different values with their counts meet, however many rows a hot key has.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("many"))
    return counts.groupBy(key).agg(F.percentile(F.col(value), F.lit(at), F.col("many")).alias(name))


def gap_fill(df: DataFrame, key: str, time: str, step: str, values: list[str], carry: bool = False) -> DataFrame:
    """A row for each step between a key's first and last time, with df's values where it has that time, else null.

    step is an interval, such as '1 DAY'; times off the grid from a key's first are left out. With carry, the last value
    that isn't null goes on. Rows with a null key or time take no part.
    """
    there = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    ends = there.groupBy(key).agg(F.min(time).alias("low"), F.max(time).alias("high"))
    grid = ends.select(F.col(key), F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {step}"))).alias(time))
    out = grid.join(there.select(key, time, *values), [key, time], "left")
    if carry:
        w = W.partitionBy(key).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.select(key, time, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
    return out


def top_sum(df: DataFrame, key: str, weight: str, k: int) -> DataFrame:
    """The k keys with the largest sums of weight, largest first, ties by key. Exact; a top-k is all that is sorted."""
    sums = df.groupBy(key).agg(exact_sum(weight).alias("total"))
    return sums.orderBy(F.desc("total"), key).limit(k)
