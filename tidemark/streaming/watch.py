"""Streams: scripts as they arrive, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.lineage import Lineage, analyze
from tidemark.sources.scripts import scripts_in


def watch_scripts(spark: SparkSession, folder: str, out: str, checkpoint: str, dialect: str = "generic", once: bool = True, files: int = 1000) -> StreamingQuery:
    """Analyzes projects as their .sql files under folder arrive, and writes the lineage records to out/batch=number/kind=...

    A file's project is its folder. A batch names the projects that it touches, and those are analyzed anew over all
    their files, so a project that spans batches is whole in its last one; current() reads that. A batch has its own
    folder, which a batch that runs again overwrites. files is the most that a batch takes.
    """
    arrived = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", "*.sql").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
        .schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    )

    def batch(df: DataFrame, number: int) -> None:
        # as many folders as the batch has files, at most
        touched = sorted(r[0] for r in df.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect())
        if touched:
            found = scripts_in(spark, touched, dialect, recursive=False)
            analyze(found).records.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={number}")

    writer = arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def current(spark: SparkSession, out: str) -> Lineage:
    """The lineage of every project that watch_scripts() wrote to out: that of the last batch that touched it."""
    rows = spark.read.option("basePath", out).parquet(out)
    last = rows.groupBy("project_id").agg(F.max("batch").alias("batch"))
    return Lineage(rows.join(last, ["project_id", "batch"], "left_semi").drop("batch"))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type, tumbling or sliding; on a stream, with a watermark, so that state is bounded."""
    kind = dict(events.dtypes)["ts"]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return counted.select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a gap; one row each. On a stream, with a watermark."""
    kind = dict(events.dtypes)["ts"]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").cast(kind).alias("start"), "n")


def event_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The events of folder/table.parquet as a stream, on any file system."""
    at = f"{folder}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(at).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(at)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)  # a stream reads folders only


def run_to_files(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over all that is there, and writes what each batch says to out/batch=number."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Of each key what the last batch that run_to_files() wrote says about it."""
    rows = spark.read.option("basePath", out).parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, *[F.col("v").getField(c).alias(c) for c in values])


def running_totals(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(user_id, events, longest_gap): a user's events so far and the longest time between two of them, in seconds.

    A stateful operator over batches in order of time: the state of a user is a count, the latest time and the gap, in
    whole microseconds. A batch may bring a user's events in any order and in several frames: their times are put
    together and sorted. Events without a time count and have no gap.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames, state):
        import numpy as np
        import pandas as pd

        count, last, gap = state.get if state.exists else (0, None, 0)
        times = []
        for frame in frames:
            count += len(frame)
            times.append(frame["at"].dropna().to_numpy("int64"))
        at = np.sort(np.concatenate(times))
        if last is not None:
            at = np.concatenate([[last], at[at > last]])
        if len(at):
            last = int(at[-1])
            gap = max(gap, int(np.diff(at).max(initial=0)))
        state.update((count, last, gap))
        yield pd.DataFrame({"user_id": [key[0]], "events": [count], "longest_gap": [gap / 1e6]})

    timed = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(update, "user_id long, events long, longest_gap double", "count long, last long, gap long", "update", GroupStateTimeout.NoTimeout)
