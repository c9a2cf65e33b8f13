"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fields, row_of

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts):
    """A whole number below 2**32 from the parts' digest."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")


def targets(totals: DataFrame, weights=(5, 2, 1), share: float = 1.5, at_most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, take the weights in turn. Every target is min(cap, level * weight) with
    cap = at_most * source_size; the level is where targets add up to share of all sizes, which is what handing the
    excess over a cap to the others by weight, again and again, ends in. The table has a row for each source.
    """
    n = len(weights)
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % n + 1).cast("int"))
    t = totals.withColumn("turn", turn).withColumn("weight", weight)
    everything = W.partitionBy()
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("turn"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = (
        t.withColumn("budget", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("filled", F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * at_most)
        .withColumn("left", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("left"))
        .withColumn("open", F.col("source_size") * at_most > F.col("level") * F.col("weight"))
    )
    # the first source, by cap per weight, whose cap is above the level sets the level of all behind it
    first = F.min(F.when(F.col("open"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "turn", "level"))).over(everything)
    t = t.withColumn("level", F.coalesce(first["level"], F.lit(float("inf"))))
    return t.select("source", "source_size", F.least(F.col("source_size") * at_most, F.col("level") * F.col("weight")).alias("target"))


def tie_breaker(text: str = "text"):
    """What tells rows of one id and size apart: a digest of the text, which also stands in for a null id."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _placed(rows: DataFrame, sized: DataFrame, weights, share: float, at_most: float, seed: int, spread: int) -> DataFrame:
    """rows (id, source, size, tie and others) with source_size, target and copies. sized: the same id, source, size, tie."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, weights, share, at_most)
    key = F.coalesce(F.col("id").cast("string"), F.col("tie"))
    salt = _uniform(F.lit(f"{seed}|"), key) % spread
    size_class = F.floor(F.sqrt(F.col("size").cast("double")))
    celled = lambda df: df.withColumn("class", size_class).withColumn("salt", salt)
    cell = ["source", "class", "salt"]
    along = W.partitionBy("source").orderBy("class", "salt").rowsBetween(W.unboundedPreceding, -1)
    starts = celled(sized).groupBy(*cell).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    known = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).select(
        starts["source"].alias("of"), F.col("class").alias("c"), F.col("salt").alias("s"), "before", "source_size", "target"
    )
    offset = _uniform(F.lit(f"{seed}|source|"), F.coalesce("of", F.lit(""))) / F.lit(4294967296.0)
    placed = celled(rows).withColumn("turn", F.row_number().over(W.partitionBy(*cell).orderBy("size", "id", "tie")))
    joined = placed.join(known, placed["source"].eqNullSafe(known["of"]) & (placed["class"] == known["c"]) & (placed["salt"] == known["s"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    edge = lambda place: F.floor(place * rate + offset)
    place = F.col("before") + F.col("turn")
    return joined.withColumn("copies", (edge(place) - edge(place - 1)).cast("long"))


def mix_sized(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, at_most: float = 2.0, seed: int = 17, spread: int = 64) -> DataFrame:
    """mix() of rows whose words are counted: id, source, size, tie. Gives id, size, source_size, target, copies."""
    return _placed(sized, sized, weights, share, at_most, seed, spread).select("id", "size", "source_size", "target", "copies")


def _mixed(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, at_most: float = 2.0, seed: int = 17, spread: int = 64) -> DataFrame:
    named = docs.select(F.col("doc_id").alias("id"), "source", word_count().alias("size"), tie_breaker().alias("tie"), row_of(docs))
    return _placed(named, cut(named.drop("row")), weights, share, at_most, seed, spread)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    Within a source every document expects target / source_size copies. Documents stand in order of size class, then
    salt, size, id and a digest of the text; the expected copies are summed along that order, one offset in [0, 1) from
    the seed and the source's name is added, and a document is emitted once for each whole number that its step crosses.
    Neighbours in that order are of like size, so the words taken come near the target. A rerun gives the same answer:
    rows that nothing in that order tells apart have the same id and text.

    The order is never built in one task: a row's place is the number of rows in earlier cells of (size class, salt),
    from a table of at most sqrt(largest size) * spread cells a source, plus its place in its own cell. A source with
    a third of all rows is so dealt over thousands of cells, and rows without an id by their text. Text is shuffled once.

    Null text and text without words have size 0 and take 0 words; a source of size 0 gets target 0 and no copies. A
    null source is a source of its own. Null ids and repeated rows are rows like any other, and an empty table stays
    empty. Columns of docs with the names of the added ones (size, source_size, target, copies) are replaced; any
    other name may be used.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    return _mixed(docs, **options).select(*fields(docs), "size", "source_size", "target", "copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with the columns of docs, whatever their names."""
    taken = _mixed(docs, **options).where("copies > 0")
    return taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*fields(docs))
