"""Streaming operators whose state ends: settled sessions, bursts by any member, and progress counters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.registry import query
from shelfmark.runtime import shared_dir
from shelfmark.streaming.incremental import SECOND, _events, drain, run_to_table
from shelfmark.streaming.keyed import KeyedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark: SparkSession):
    """State with timers needs a store on disk; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def settled_sessions(stream: DataFrame, quiet: str, late: str = "10 minutes", by: str = "camera") -> DataFrame:
    """Runs of changes of one key, each emitted once, when the watermark has passed its quiet period; its state goes then. To be run in append mode."""
    groups = stream.withWatermark("captured_at", late).groupBy(F.session_window("captured_at", quiet).alias("w"), by)
    return groups.agg(F.count("*").alias("n"), F.max("captured_at").alias("newest")).select(by, F.col("w.start").alias("began"), "newest", "n")


#: Groups of cameras that share a state, and rows of a list in a state.
GROUPS, PACKED = 256, 20_000
WAITING, MEMBER = ["none", "camera", "at", "path", "hash", "person"], ["none", "camera", "at", "path", "hash", "person", "burst"]


class Bursts(StatefulProcessor):
    """Rows wait until the watermark has passed them, then join in time order: to their camera's open burst if they match any member of it, else to a new one.

    The cameras of a group share a state, whose rows are packed as numbers, so a batch costs as many calls as there are groups. Times are microseconds.
    """

    def __init__(self, rapid: float, window: float, bits: int):
        self.rapid, self.window, self.bits = rapid * 1e6, window * 1e6, bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.members = handle.getListState("members", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = np.concatenate([pdf[WAITING].to_numpy(np.int64) for pdf in rows])
        self.waiting.appendList(self._packed(fresh))
        # a timer for each row's time would do as well; the earliest sets the next one when it fires
        self.handle.registerTimer(max(int(fresh[:, 2].min()) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, reach = timerValues.getCurrentWatermarkInMs() * 1000, max(self.rapid, self.window)
        waiting = self._rows(self.waiting, WAITING)
        passed = waiting[:, 2] <= mark
        ready, rest = waiting[passed], waiting[~passed]
        ready = ready[np.lexsort(ready.T[3::-1])]  # by camera, time and path
        open_: dict[tuple[int, int], list[tuple]] = {}
        for none, camera, *member in self._rows(self.members, MEMBER).tolist():
            open_.setdefault((none, camera), []).append(tuple(member))
        named = []
        for none, camera, at, path, code, person in ready.tolist():
            members = open_.get((none, camera), [])
            fits = any(self._matches(at, code, person, m) for m in members)
            burst = members[0][4] if fits else path
            open_[none, camera] = [*(m for m in (members if fits else []) if at - m[0] <= reach), (at, path, code, person, burst)]
            named.append(burst)
        kept = np.array([(*k, *m) for k, members in open_.items() for m in members if mark - m[0] <= reach], np.int64).reshape(-1, len(MEMBER))
        self._keep(self.waiting, rest)
        self._keep(self.members, kept)
        # the next row that waits, or the time when a member can't be reached any more
        later = [int(t.min()) for t in (rest[:, 2], kept[:, 2] + int(reach)) if len(t)]
        if later:
            self.handle.registerTimer(max(min(later), mark) // 1000 + 1)
        if named:
            yield pd.DataFrame({"camera": pd.arrays.IntegerArray(ready[:, 1].copy(), ready[:, 0] > 0), "path": ready[:, 3], "burst": named})

    def _matches(self, at: int, code: int, person: int, member: tuple) -> bool:
        gap, far = at - member[0], ((code ^ member[2]) & (2**64 - 1)).bit_count()
        return (gap <= self.rapid and far <= 2 * self.bits and person == member[3]) or (gap <= self.window and far <= self.bits)

    @staticmethod
    def _packed(rows: np.ndarray) -> list[tuple]:
        return [(rows[k : k + PACKED].tobytes(),) for k in range(0, len(rows), PACKED)]

    @staticmethod
    def _rows(state, columns: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(x[0]) for x in state.get()), np.int64).reshape(-1, len(columns))

    def _keep(self, state, rows: np.ndarray) -> None:
        if len(rows):
            state.put(self._packed(rows))
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def bursts(stream: DataFrame, rapid: float, window: float, bits: int, late: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """Rows ``camera, path, burst`` of a stream of ``camera, path, captured_at, hash, person``; a burst is named by its first row.

    A row is emitted once the watermark has passed it. Rows behind the watermark are dropped, and counted (``late_rows``). What can't be reached any more leaves the state. To be run
    in append mode within ``rocks_state``. A task holds what waits of one of the ``groups`` of cameras, whose number stays the same as long as a stream's checkpoint is used.
    """
    rows = stream.select(
        F.pmod(F.xxhash64("camera"), F.lit(groups)).alias("group"), F.col("camera").isNull().cast("long").alias("none"), F.coalesce(F.col("camera").cast("long"), F.lit(0)).alias("camera"),
        F.unix_micros("captured_at").alias("at"), "captured_at", "path", "hash", "person",
    ).withWatermark("captured_at", late)
    return rows.groupBy("group").transformWithStateInPandas(Bursts(rapid, window, bits), "camera long, path long, burst long", "Append", "EventTime")


def replay(stream: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """What a stream emits over all that is there, and its ``late_rows``, and the ``state_rows`` that are left."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/out-{uuid.uuid4().hex}"
    with rocks_state(spark):
        done = drain(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/batch={number}"))
    states = [s for p in done for s in p["stateOperators"]]
    counts = {"late_rows": sum(s["numRowsDroppedByWatermark"] for s in states), "state_rows": states[-1]["numRowsTotal"] if states else 0}
    return spark.read.schema(stream.schema).parquet(place).select(stream.columns), counts


def keep_progress(stream: DataFrame, target: str, buckets: int = 64) -> KeyedTable:
    """Heartbeat and counts of each run in a keyed table: a batch reads and replaces its runs' buckets alone.

    Each row remembers the last batch that it counted, so a batch that runs again after a crash counts nothing twice.
    """
    spark = stream.sparkSession
    schema = spark.createDataFrame([], "camera long, heartbeat timestamp, seen long, failed long, batch long").schema
    table = KeyedTable(spark, target, schema, "camera", buckets)

    def write(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("camera").agg(F.max("captured_at").alias("heartbeat"), F.count("*").alias("seen"), F.count_if(F.col("kind") == "error").alias("failed"))
        old = table.read(table.touched(new)).select("camera", F.col("heartbeat").alias("_h"), F.col("seen").alias("_s"), F.col("failed").alias("_f"), F.col("batch").alias("_b"))
        met = new.join(old, "camera", "left").where(F.col("_b").isNull() | (F.col("_b") < number))
        zero = lambda c: F.coalesce(c, F.lit(0))
        table.upsert(met.select("camera", F.greatest("heartbeat", "_h").alias("heartbeat"), (F.col("seen") + zero("_s")).alias("seen"), (F.col("failed") + zero("_f")).alias("failed"), F.lit(number).cast("long").alias("batch")))

    drain(stream, write)
    return table


SETTLED = """WITH s AS (SELECT *, sum(CASE WHEN captured_at - prev < INTERVAL {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY camera ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(captured_at) OVER (PARTITION BY camera ORDER BY captured_at) AS prev FROM shot))
  SELECT camera, strftime(min(captured_at), '%Y-%m-%d %H:%M:%S') AS began, count(*)::BIGINT AS n FROM s GROUP BY camera, g HAVING max(captured_at) + INTERVAL {gap} <= (SELECT max(captured_at) FROM shot) - INTERVAL 10 MINUTE"""


@query("p2_settled_once", SETTLED.format(gap="30 MINUTE"))
def _(v):
    return run_to_table(settled_sessions(_events(v), "30 minutes")).select("camera", F.date_format("began", SECOND).alias("began"), "n")


@query("p4_progress_table", "SELECT user_id AS camera, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS heartbeat, count(*)::BIGINT AS seen, count(*) FILTER (event_type = 'error')::BIGINT AS failed FROM events GROUP BY 1")
def _(v):
    table = keep_progress(_events(v), f"{shared_dir(v.spark).rstrip('/')}/progress-{uuid.uuid4().hex}")
    return table.read().select("camera", F.date_format("heartbeat", SECOND).alias("heartbeat"), "seen", "failed")


@query("p6_streaming_bursts")
def _(v):
    rows = _events(v).withColumn("hash", F.xxhash64(F.floor("value"))).withColumn("person", F.col("camera") % 5)
    return replay(bursts(rows, 1800, 7200, 24))[0]
