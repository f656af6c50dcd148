"""Queries over event time: windows, sessions, and streams that end with what a table gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.plans.registry import Registry, table
from loomstone.session import shared_path
from loomstone.streaming import events as E

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def _timed(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _micros(df):
    return df.withColumns({"start": F.unix_micros("start"), "finish": F.unix_micros("finish")})



def _aggregates():
    return [F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")]


@_R.add(
    "q_tumbling",
    """
    SELECT epoch_us(b) AS start, epoch_us(b + INTERVAL 1 HOUR) AS finish, event_type, count(*) AS n, round(sum(value), 3) AS total
    FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events) GROUP BY ALL
    """,
)
def tumbling(spark, sf_dir):
    return _micros(E.tumbling(_timed(spark, sf_dir), "ts", "1 hour", ["event_type"], _aggregates()))


@_R.add(
    "q_sliding",
    """
    WITH t AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS b FROM (SELECT *, unnest(range(0, 3)) AS i FROM events))
    SELECT epoch_us(b) AS start, epoch_us(b + INTERVAL 3 HOUR) AS finish, count(*) AS n, round(sum(value), 3) AS total FROM t GROUP BY ALL
    """,
)
def sliding(spark, sf_dir):
    return _micros(E.sliding(_timed(spark, sf_dir), "ts", "3 hours", "1 hour", [], _aggregates()))


@_R.add(
    "q_session",
    """
    WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 8 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
    SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 8 HOUR) AS finish, user_id, count(*) AS n, round(sum(value), 3) AS total FROM b GROUP BY user_id, s
    """,
)
def session(spark, sf_dir):
    return _micros(E.sessions(_timed(spark, sf_dir), "ts", "8 hours", ["user_id"], _aggregates()))


@_R.add(
    "q_stream_totals",
    "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1",
)
def stream_totals(spark, sf_dir):
    """Totals of a stream over the file, run to its end: what the table gives."""
    schema = table(spark, sf_dir, "events").schema
    stream = E.replay(spark, f"{sf_dir}/events.parquet*", schema)
    totals = stream.groupBy("event_type").agg(*_aggregates())
    return E.run_to_end(totals, spark, shared_path(spark, "stream-totals"), "complete")


@_R.add("q_stream_merge", "SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE value > 50")
def stream_merge(spark, sf_dir):
    """Two streams as one, run to their end."""
    schema = table(spark, sf_dir, "events").schema
    make = lambda: E.replay(spark, f"{sf_dir}/events.parquet*", schema)
    both = E.merge(make().filter("event_type = 'click'").select("event_id"), make().filter("value > 50").select("event_id"))
    return E.run_to_end(both, spark, shared_path(spark, "stream-merge"))


@_R.add("q_stream_gather", "SELECT user_id, max(value) AS state FROM events GROUP BY 1")
def stream_gather(spark, sf_dir):
    """A fold with state over each user's values; a stream of one batch ends with one state per user."""
    stream = E.replay(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    folded = E.gather(stream.select("user_id", "value"), "user_id", "value", max, float("-inf"))
    found = E.run_to_end(folded, spark, shared_path(spark, "stream-gather"), "update")
    return found.groupBy("user_id").agg(F.max("state").alias("state"))
