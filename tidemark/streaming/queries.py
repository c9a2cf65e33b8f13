"""Windows over events, as a batch and as a stream that has ended."""

from __future__ import annotations

import uuid

from tidemark.catalog import query, read
from tidemark.scratch import shared_dir
from tidemark.streaming import watch

_TUMBLE = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL"
_SLIDE = """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total
  FROM events, range(0, 2) r(k) GROUP BY ALL"""
_SESSION = """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""


def _streamed(spark, sf, operator, keys: list[str], mode: str = "update"):
    """What operator says of the events as a stream, after all of it: the last word on each key."""
    base = f"{shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    watch.run_to_files(operator(watch.event_stream(spark, sf, "events")), f"{base}/out", f"{base}/checkpoint", mode)
    return watch.newest(spark, f"{base}/out", keys)


@query(_TUMBLE)
def stream_tumbling_batch(spark, sf):
    return watch.event_windows(read(spark, sf, "events"))


@query(_TUMBLE)
def stream_tumbling(spark, sf):
    return _streamed(spark, sf, watch.event_windows, ["start", "event_type"])


@query(_SLIDE)
def stream_sliding(spark, sf):
    return _streamed(spark, sf, lambda e: watch.event_windows(e, slide="30 minutes"), ["start", "event_type"])


@query(_SESSION)
def stream_sessions_batch(spark, sf):
    return watch.sessions(read(spark, sf, "events"))


@query("""SELECT user_id, count(*) AS events, coalesce(max(gap), 0) AS longest_gap FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000.0::DOUBLE AS gap FROM events) GROUP BY user_id""")
def stream_stateful(spark, sf):
    return _streamed(spark, sf, watch.running_totals, ["user_id"])


@query(_SESSION)
def stream_sessions(spark, sf):
    """Sessions merge as events come, so a batch may take back what an earlier one said; the whole table is one batch here."""
    base = f"{shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    watch.run_to_files(watch.sessions(watch.event_stream(spark, sf, "events")), f"{base}/out", f"{base}/checkpoint", "complete")
    return spark.read.parquet(f"{base}/out").where("batch = 0").drop("batch")
