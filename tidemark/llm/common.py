"""What the corpus operators share: reading, shared scratch tables, lineage cuts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import cut, drop_cut, shared_dir

__all__ = ["crc_mod", "cut", "deal", "draw", "drop_cut", "even_keys", "fields", "join_dealt", "partitions", "power_of_two", "prepare", "read", "row_of", "share", "shared_dir"]

#: Keys that hold at least this part of all rows are joined by broadcast: there can't be more of them than its inverse.
HOT = 1000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and keeps Arrow batches small for long texts."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def draw(key: str, seed: int):
    """A number in [0, 1) from a row's id, the same in every run."""
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)


def share(wanted: int, there: int) -> float:
    return 1.0 if there <= wanted else wanted / there


def row_of(df: DataFrame):
    """All columns of df as one struct, so that columns added beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def fields(df: DataFrame, **new) -> list:
    """The columns of df again, out of the struct that row_of() made; new ones instead of those named."""
    return [(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in df.columns]


def power_of_two(at_least: float) -> int:
    n = 1
    while n < at_least:
        n *= 2
    return n


def hot(total: int):
    """Whether a key with many rows of total is one of at most HOT keys that hold the most."""
    return F.col("many") * HOT >= total


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """left joined with right, which has a row for each key and says in many how many of the total rows of left have it.

    The rows of a frequent key stay where they are: right's rows for such keys, HOT at most, are broadcast.
    """
    few = F.broadcast(right.where(hot(total)))
    rest = left.join(few.select(*keys), keys, "left_anti").join(right.where(~hot(total)), keys)
    return left.join(few, keys).unionByName(rest)


#: Tasks to which groups are dealt one by one; more groups than that are dealt by hash, which is even enough then.
TASKS = 1 << 15


def even_keys(spark: SparkSession, n: int) -> list[int] | range:
    """n numbers of which hash partitioning into n partitions puts one into each, in order of partition.

    Groups that have these as keys are dealt one to a task; keys 0, 1, 2 and so on would often share one. Beyond TASKS
    they are just those.
    """
    if n > TASKS:
        return range(n)
    found: dict[int, int] = {}
    start, wide = 0, 16 * n
    while len(found) < n:
        ids = spark.range(start, start + wide, 1, 1).select(F.col("id").cast("int").alias("k"))
        for r in ids.groupBy(F.expr(f"pmod(hash(k), {n})").alias("p")).agg(F.min("k").alias("k")).collect():
            found.setdefault(r["p"], r["k"])
        start += wide
    return [found[p] for p in range(n)]


def deal(rows: DataFrame, fragments: int) -> DataFrame:
    """rows, by frag, in as many partitions as there are fragments, TASKS at most, unless the session has more."""
    return rows.repartition(min(fragments, TASKS), "frag") if fragments >= partitions(rows.sparkSession) else rows
