"""Streams against their batch forms, replayed from files in any order, and keyed tables after crashes."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.streaming import incremental, keyed, stateful

START = datetime.datetime(2024, 3, 1)
KIND = "camera long, path long, captured_at timestamp, hash long, person long, kind string"


def shots():
    rng, out, clock = random.Random(4), [], 0
    for i in range(160):
        clock += rng.choice([1, 2, 5, 40, 400])
        out.append((i % 3, i, START + datetime.timedelta(seconds=clock), rng.choice([0, 1, 3, 2**40 - 1, -1]), i % 2, rng.choice(["ok", "error"])))
    return out


def files(spark, tmp_path, rows, seed, parts=6):
    """The rows in files that arrive in some order; a last one holds a far later row of another camera, which moves the watermark on."""
    rng, place = random.Random(seed), str(tmp_path / f"in{seed}")
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if seed else rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], KIND).coalesce(1).write.mode("append").parquet(place)
    spark.createDataFrame([(-1, 10**6, START + datetime.timedelta(days=9), 0, 0, "ok")], KIND).coalesce(1).write.mode("append").parquet(place)
    rng.random()
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(place)


def plain_bursts(rows, rapid, window, bits):
    out = {}
    for camera in {r[0] for r in rows}:
        members = []
        for r in sorted((r for r in rows if r[0] == camera), key=lambda r: (r[2], r[1])):
            def near(m, r=r):
                gap, far = (r[2] - m[2]).total_seconds(), ((r[3] ^ m[3]) & (2**64 - 1)).bit_count()
                return (gap <= rapid and far <= 2 * bits and r[4] == m[4]) or (gap <= window and far <= bits)

            members = [*members, r] if any(map(near, members)) else [r]
            out[r[1]] = members[0][1]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_bursts_are_those_of_a_loop_and_state_ends(spark, tmp_path, seed):
    rows = shots()
    found, counts = stateful.replay(stateful.bursts(files(spark, tmp_path, rows, seed), 4, 60, 3, late="2 days"))
    got = {r["path"]: r["burst"] for r in found.collect() if r["camera"] >= 0}
    assert got == plain_bursts(rows, 4, 60, 3) and len(set(got.values())) < len(got)
    assert counts["late_rows"] == 0 and counts["state_rows"] <= 2  # only the far row waits


def test_late_rows_are_counted(spark, tmp_path):
    rows, place = shots(), str(tmp_path / "late")
    for part in (rows, [(-1, 10**6, START + datetime.timedelta(days=9), 0, 0, "ok")], [(0, 999, START, 0, 0, "ok")]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(place)
    _, counts = stateful.replay(stateful.bursts(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(place), 4, 60, 3, late="1 hour"))
    assert counts["late_rows"] == 1


def test_settled_sessions_are_emitted_once(spark, tmp_path):
    rows, want = shots(), []
    for camera in range(3):
        run = []
        for r in sorted((r for r in rows if r[0] == camera), key=lambda r: r[2]):
            if run and (r[2] - run[-1]).total_seconds() >= 300:
                want.append((camera, run[0], run[-1], len(run)))
                run = []
            run.append(r[2])
        want.append((camera, run[0], run[-1], len(run)))
    found, counts = stateful.replay(stateful.settled_sessions(files(spark, tmp_path, rows, 1), "300 seconds", late="2 days"))
    got = [tuple(r) for r in found.collect() if r["camera"] >= 0]
    assert sorted(got) == sorted(want) and counts["state_rows"] <= 1


def test_progress_counts_a_repeated_batch_once(spark, tmp_path):
    rows = shots()
    table = stateful.keep_progress(files(spark, tmp_path, rows, 1), str(tmp_path / "progress"), buckets=4)
    got = {r["camera"]: (r["heartbeat"], r["seen"], r["failed"]) for r in table.read().collect() if r["camera"] >= 0}
    assert got == {c: (max(r[2] for r in rows if r[0] == c), sum(r[0] == c for r in rows), sum(r[0] == c and r[5] == "error" for r in rows)) for c in range(3)}


def table(spark, path):
    return keyed.KeyedTable(spark, str(path), spark.createDataFrame([], "path long, a string, b long").schema, buckets=8)


def test_a_batch_reads_and_replaces_its_buckets_alone(spark, tmp_path):
    held = table(spark, tmp_path / "t")
    assert held.read().collect() == [] and held.insert_new(spark.range(100).selectExpr("id as path", "'x' as a", "id as b")) == 100
    assert held.insert_new(spark.range(90, 110).selectExpr("id as path", "'y' as a", "id as b")) == 10
    batch = spark.createDataFrame([(5, "new", None), (5, None, None), (200, "z", 1), (None, "q", 1)], "path long, a string, b long")
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    changed = held.upsert(batch)
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert {k for k in after if after[k] != before.get(k)} == {f"bucket={b}" for b in changed} and len(changed) <= 2
    rows = {r["path"]: (r["a"], r["b"]) for r in held.read().collect()}
    assert len(rows) == held.read().count() == 111 and rows[5] == ("new", 5) and rows[95] == ("x", 95) and rows[105] == ("y", 105) and rows[200] == ("z", 1)
    held.upsert(batch)
    assert {r["path"]: (r["a"], r["b"]) for r in held.read().collect()} == rows


def test_a_batch_that_breaks_off_can_run_again(spark, tmp_path, monkeypatch):
    held = table(spark, tmp_path / "t")
    batch = spark.range(40).selectExpr("id as path", "'x' as a", "id as b")
    real = keyed.stash
    calls = []

    def broken(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(df)

    monkeypatch.setattr(keyed, "stash", broken)
    with pytest.raises(RuntimeError):
        held.insert_new(batch)
    monkeypatch.setattr(keyed, "stash", real)
    half = batch.where("path % 2 = 0")
    held.insert_new(half)  # as if a part of the files had been written
    assert held.insert_new(batch) == 20 and held.insert_new(batch) == 0 and held.read().count() == 40


def test_streams_into_keyed_tables(spark, tmp_path):
    rows = shots()
    stream = files(spark, tmp_path, [*rows, *rows[:30]], 1).select("path", "kind", F.col("camera").alias("b"))
    assert incremental.ingest_new(stream, str(tmp_path / "i"), buckets=8).read().count() == len(rows) + 1
    assert incremental.upsert_stream(stream, str(tmp_path / "u"), buckets=8).read().count() == len(rows) + 1
