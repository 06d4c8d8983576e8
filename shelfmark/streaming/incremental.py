"""Streaming and incremental forms (group P) over Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.registry import query
from shelfmark.runtime import shared_dir
from shelfmark.streaming.keyed import BUCKETS, KeyedTable


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of files, with a time that watermarks accept.

    The path is given as a pattern, which a file source takes for a file as well as for a folder.
    """
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")
    return raw.select(F.col("event_id").alias("path"), F.col("ts").cast("timestamp").alias("captured_at"), F.col("user_id").alias("camera"), F.col("event_type").alias("kind"), "value")


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append") -> list[dict]:
    """Run a stream over what is there now, batch by batch; progress lives in the shared folder. Returns the batches' reports."""
    place = f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return [json.loads(p.json) for p in run.recentProgress]


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream emits; a batch that runs again replaces its own folder."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/out-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(place if mode == "complete" else f"{place}/batch={number}")

    drain(stream, write, mode)
    return spark.read.schema(stream.schema).parquet(place).select(stream.columns)


def windowed_counts(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of tumbling or sliding windows; rows later than the watermark are dropped and show in the progress metrics."""
    w = F.window("captured_at", size, slide) if slide else F.window("captured_at", size)
    return stream.withWatermark("captured_at", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("began"), "kind", "n")


def settled(stream: DataFrame, quiet: str, late: str = "10 minutes") -> DataFrame:
    """Bursts of changes that were followed by a quiet period."""
    groups = stream.withWatermark("captured_at", late).groupBy(F.session_window("captured_at", quiet).alias("w"), "camera")
    return groups.agg(F.count("*").alias("n")).select("camera", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def ingest_new(stream: DataFrame, target: str, key: str = "path", buckets: int = BUCKETS) -> KeyedTable:
    """Adds rows with unseen keys to a table in hash buckets; a batch reads the buckets that it touches, and one that runs again adds nothing."""
    table = KeyedTable(stream.sparkSession, target, stream.schema, key, buckets)
    drain(stream, lambda batch, number: table.insert_new(batch) and None)
    return table


def upsert_stream(stream: DataFrame, target: str, key: str = "path", columns: list[str] | None = None, order: str | None = None, buckets: int = BUCKETS) -> KeyedTable:
    """Keeps the latest values of each key in a table in hash buckets; a batch replaces the buckets that it touches."""
    table = KeyedTable(stream.sparkSession, target, stream.schema, key, buckets)
    drain(stream, lambda batch, number: table.upsert(batch, columns, order) and None)
    return table


def retrain_triggers(stream: DataFrame, threshold: int = 25, idle_seconds: int = 60, late: str = "0 seconds") -> DataFrame:
    """Fires for a scope once it has enough new rows and was idle in event time; the counter is then used up, else kept."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            if count >= threshold:
                yield pd.DataFrame({"camera": [key[0]], "n": [count]})
                state.remove()
            else:
                state.update((count,))
            return
        newest = None
        for pdf in batches:
            count += len(pdf)
            top = pdf["captured_at"].max()
            newest = top if newest is None else max(newest, top)
        state.update((count,))
        if newest is not None:
            at = int(newest.timestamp() * 1000) + idle_seconds * 1000
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))

    return stream.withWatermark("captured_at", late).groupBy("camera").applyInPandasWithState(step, "camera long, n long", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def progress(stream: DataFrame) -> DataFrame:
    """The latest heartbeat and the failures of each run so far."""
    return stream.groupBy("camera").agg(F.max("captured_at").alias("heartbeat"), F.count("*").alias("seen"), F.count_if(F.col("kind") == "error").alias("failed"))


def emitted(stream: DataFrame, high: float) -> DataFrame:
    """Named events for rows above a threshold."""
    return stream.where(F.col("value") >= high).select("path", F.lit("high_score").alias("event"), F.round("value", 2).alias("value"))


def _events(v) -> DataFrame:
    return event_stream(v.spark, f"{v.sf_dir}/events.parquet")


SECOND = "yyyy-MM-dd HH:mm:ss"


@query("p1_incremental_ingest", "SELECT event_id AS path, event_type AS kind FROM events")
def _(v):
    target = f"{shared_dir(v.spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    stream = _events(v).select("path", "kind")
    return ingest_new(stream, target).read().select("path", "kind")


@query("p2_settled_changes", "WITH s AS (SELECT *, sum(CASE WHEN captured_at - prev < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY camera ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(captured_at) OVER (PARTITION BY camera ORDER BY captured_at) AS prev FROM shot)) SELECT camera, strftime(min(captured_at), '%Y-%m-%d %H:%M:%S') AS began, count(*)::BIGINT AS n FROM s GROUP BY camera, g")
def _(v):
    return run_to_table(settled(_events(v), "30 minutes"), "complete").select("camera", F.date_format("began", SECOND).alias("began"), "n")


@query("p3_retrain_triggers")
def _(v):
    return run_to_table(retrain_triggers(_events(v)))


@query("p4_scan_progress", "SELECT user_id AS camera, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS heartbeat, count(*)::BIGINT AS seen, count(*) FILTER (event_type = 'error')::BIGINT AS failed FROM events GROUP BY 1")
def _(v):
    return run_to_table(progress(_events(v)), "complete").select("camera", F.date_format("heartbeat", SECOND).alias("heartbeat"), "seen", "failed")


@query("p6_streaming_scenes", "WITH s AS (SELECT *, sum(CASE WHEN captured_at - prev < INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY camera ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(captured_at) OVER (PARTITION BY camera ORDER BY captured_at) AS prev FROM shot)) SELECT camera, strftime(min(captured_at), '%Y-%m-%d %H:%M:%S') AS began, count(*)::BIGINT AS n FROM s GROUP BY camera, g HAVING count(*) >= 2")
def _(v):
    return run_to_table(settled(_events(v), "2 hours"), "complete").where("n >= 2").select("camera", F.date_format("began", SECOND).alias("began"), "n")


@query("p7_live_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS began, event_type AS kind, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def _(v):
    return run_to_table(windowed_counts(_events(v), "1 hour"), "complete").select(F.date_format("began", SECOND).alias("began"), "kind", "n")


@query("p7_sliding_counts", "SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS began, event_type AS kind, count(*)::BIGINT AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS b FROM events) GROUP BY 1, 2")
def _(v):
    return run_to_table(windowed_counts(_events(v), "1 hour", "15 minutes"), "complete").select(F.date_format("began", SECOND).alias("began"), "kind", "n")


@query("p8_threshold_events", "SELECT event_id AS path, 'high_score' AS event, round(value, 2) AS value FROM events WHERE value >= 100")
def _(v):
    return run_to_table(emitted(_events(v), 100))


@query("p5_batch_order")
def _(v):
    """After new rows: only cameras with rows past the watermark run again, bursts first, then scenes and labels."""
    from shelfmark.operators.sessions import lead, sessions, stale_runs

    stale = stale_runs(v.shot.withColumnRenamed("camera", "run"), F.lit("2024-01-29 12:00:00").cast("timestamp")).where("stale").select(F.col("run").alias("camera"))
    rows = v.shot.join(stale, "camera", "left_semi")
    led = lead(sessions(rows, 1800, ["camera"]), ["camera", "session"])
    return led.groupBy("camera").agg(F.max("session").alias("scenes"), F.count_if("is_lead").alias("leads"))
