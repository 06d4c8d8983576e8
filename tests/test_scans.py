"""Scans over blocks against plain loops, with blocks far smaller than a session."""

import datetime
import itertools
import random

import numpy as np
import pytest

from shelfmark.operators import scans, sessions

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def best_sequence(emit, move):
    """Of all label sequences the one with the largest score, and each label's share of all sequences' weight."""
    n, m = emit.shape
    found, weight = {}, np.zeros((n, m))
    for seq in itertools.product(range(m), repeat=n):
        score = sum(emit[t, s] for t, s in enumerate(seq)) + sum(move[a, b] for a, b in itertools.pairwise(seq))
        found[seq] = score
        for t, s in enumerate(seq):
            weight[t, s] += np.exp(score)
    best = max(found, key=found.get)
    return best, [weight[t, s] / weight[t].sum() for t, s in enumerate(best)]


@pytest.mark.parametrize("block_rows", [2, 5, 1000])
def test_smoothing_equals_all_sequences(spark, block_rows):
    rng = np.random.default_rng(3)
    rows, want, clock = [], {}, 0
    move = scans.transitions(3, 0.6, 0.3, 0.5)
    for _ in range(5):
        clock += 100_000
        n = int(rng.integers(1, 9))
        probs = rng.dirichlet(np.ones(3) * 0.6, n)
        first = len(rows)
        for p in probs:
            clock += 60
            rows.append((len(rows), at(clock), p.tolist()))
        state, sure = best_sequence(np.log(probs + 1e-9), move)
        want |= {first + k: (s, c) for k, (s, c) in enumerate(zip(state, sure, strict=True))}
    rows += [(900, None, [0.2, 0.3, 0.5]), (901, at(clock + 5), None), (902, at(clock + 6), [0.1, 0.9])]
    got = scans.smooth_labels(spark.createDataFrame(rows, "path long, captured_at timestamp, probs array<double>"), 3, gap_seconds=3600, block_rows=block_rows).collect()
    assert {r["path"]: r["state"] for r in got} == {k: s for k, (s, _) in want.items()} | {900: None, 901: None, 902: None}
    assert {r["path"]: r["confidence"] for r in got if r["path"] < 900} == pytest.approx({k: c for k, (_, c) in want.items()}, abs=1e-6)


def test_one_long_stretch_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    probs = rng.dirichlet(np.ones(4), 600)
    df = spark.createDataFrame([(i, at(i), p.tolist()) for i, p in enumerate(probs)], "path long, captured_at timestamp, probs array<double>")
    move = scans.transitions(4, 0.6, 0.3, 0.5)
    state, sure = scans.decode(np.log(probs + 1e-9), move)
    got = sorted(scans.smooth_labels(df, 4, block_rows=50).collect())
    assert [r["state"] for r in got] == state.tolist()
    assert [r["confidence"] for r in got] == pytest.approx(sure.tolist(), abs=1e-9)


def test_no_weight_is_each_rows_best_label(spark):
    df = spark.createDataFrame([(i, at(i), [0.4, 0.6] if i == 2 else [0.9, 0.1]) for i in range(4)], "path long, captured_at timestamp, probs array<double>")
    assert [r["state"] for r in sorted(scans.smooth_labels(df, 2, weight=0).collect())] == [0, 0, 1, 0]
    assert [r["state"] for r in sorted(scans.smooth_labels(df, 2, stay=0.95, forward=0, weight=1).collect())] == [0, 0, 0, 0]
    assert scans.smooth_labels(df.limit(0), 2).collect() == []


def sweeps(steps, s):
    """From a run's steps (dx, dy, inliers in millionths): its accepted stretches of frames."""
    count, out, here = len(steps) + 1, [], 0

    def fits(step, axis, sign):
        if step is None or step[2] < s["min_inliers"]:
            return False
        a, b = step[axis], step[1 - axis]
        return abs(a) <= s["max_step"] * 1e6 and a * sign >= -s["back_tolerance"] * 1e6 and abs(b) <= max(s["step_ortho_abs"] * 1e6, s["step_ortho_ratio"] * abs(a))

    while here < count - 1:
        options = []
        for rank, (axis, sign) in enumerate([(0, 1), (0, -1), (1, 1), (1, -1)]):
            length = len(list(itertools.takewhile(lambda step: fits(step, axis, sign), steps[here:])))
            if length + 1 >= s["min_frames"]:
                part = steps[here : here + length]
                options.append((abs(sum(p[axis] for p in part)), here + length, -rank, abs(sum(p[1 - axis] for p in part))))
        if not options or steps[here] is None or steps[here][2] < s["min_inliers"]:
            here += 1
            continue
        drift, end, _, ortho = max(options)
        if drift >= s["min_drift"] * 1e6 and ortho <= max(s["max_ortho"] * 1e6, s["ortho_ratio"] * drift):
            out.append((here, end, drift, ortho))
            here = end + 1
        else:
            here = max(end, here + 1)
    return out


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_sweeps_equal_plain_loops(spark, block_rows):
    rng, rows, want = random.Random(9), [], set()
    settings = scans.SWEEP | {"min_frames": 3, "min_drift": 0.2, "min_inliers": 10}
    for run in range(12):
        n, steps, way = rng.randint(1, 70), [], (0.1, 0.0)
        for _ in range(n - 1):
            if rng.random() < 0.15:
                way = rng.choice([(0.1, 0.0), (-0.1, 0.0), (0.0, 0.12), (0.0, -0.1), (0.0, 0.0), (0.08, 0.08)])
            step = (way[0] + rng.uniform(-0.03, 0.03), way[1] + rng.uniform(-0.03, 0.03), rng.choice([5, 30, 30, 30, 30, 30, 30, 30]))
            steps.append(None if rng.random() < 0.03 else (round(step[0] * 1e6), round(step[1] * 1e6), step[2]))
        for k in range(n):
            step = steps[k] if k < n - 1 else (300_000, 0, 99)  # the last frame's step leads out of the run
            rows.append((run, run * 1000 + k, at(run * 50 + k), *((None, None, None) if step is None else (step[0] / 1e6, step[1] / 1e6, step[2]))))
        for first, end, drift, ortho in sweeps(steps, settings):
            want |= {(run, run * 1000 + k, first, round(drift / 1e6, 6), round(ortho / 1e6, 6)) for k in range(first, end + 1)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run long, path long, captured_at timestamp, dx double, dy double, inliers int")
    got = scans.panorama_segments(df, settings, block_rows=block_rows).collect()
    assert {(r["run"], r["path"], r["segment"], round(r["drift"], 6), round(r["ortho"], 6)) for r in got} == want and len(got) == len(want) > 50
    assert scans.panorama_segments(df.limit(0)).collect() == []


def scenes(times, labels, least, most):
    """Starts of parts: held label changes, then the widest gap again and again."""
    n, starts = len(times), {0}
    stretches = [(k, len(list(g))) for k, g in itertools.groupby(labels)]
    place = 0
    for label, length in stretches:
        if place >= least and length >= least and label is not None and n >= 2 * least:
            starts.add(place)
        place += length
    parts = list(itertools.pairwise([*sorted(starts), n]))
    while large := [p for p in parts if p[1] - p[0] > most]:
        a, b = large[0]
        parts.remove(large[0])
        cut = min(range(a + 1, b), key=lambda i: (-(times[i] - times[i - 1]), abs(i - a - (b - a) / 2), i))
        parts += [(a, cut), (cut, b)]
    return {i: a for a, b in parts for i in range(a, b)}


@pytest.mark.parametrize("block_rows", [9, 10_000])
def test_scenes_equal_plain_loops(spark, block_rows):
    rng, rows, want = random.Random(2), [], {}
    for session in range(6):
        n, clock, label, times, labels = rng.choice([1, 2, 5, 40, 90, 200]), session * 10**6, "a", [], []
        for _ in range(n):
            clock += rng.choice([1, 1, 2, 30, 400])
            label = rng.choice(["a", "b", None]) if rng.random() < 0.2 else label
            times.append(clock)
            labels.append(label)
        rows += [(session, session * 1000 + k, at(t), x) for k, (t, x) in enumerate(zip(times, labels, strict=True))]
        want |= {session * 1000 + k: a for k, a in scenes(times, labels, 3, 11).items()}
    df = spark.createDataFrame(rows, "session long, path long, captured_at timestamp, kind string").repartition(3)
    got = scans.split_scenes(df, 3, 11, block_rows=block_rows).collect()
    assert {r["path"]: r["part"] for r in got} == want and len(got) == len(want)


def test_a_long_even_session_splits(spark):
    df = spark.range(3000).selectExpr("id as path", "timestamp_seconds(1700000000 + id) as captured_at", "'a' as kind")
    got = scans.split_scenes(sessions.sessions(df, 60), 3, 40, block_rows=200).groupBy("part").count().collect()
    assert sum(r["count"] for r in got) == 3000 and max(r["count"] for r in got) <= 40 and min(r["count"] for r in got) >= 20


@pytest.mark.parametrize("block_rows", [3, 11, 1000])
def test_bursts_in_blocks_equal_a_plain_walk(spark, block_rows):
    rng = random.Random(5)
    rows, clock = [], 0
    for path in range(160):
        clock += rng.choice([0, 1, 2, 3, 3, 9 if path < 120 else 70])
        rows.append((path, at(clock), rng.choice([0, 3, 7, 31, 2**40 - 1]), rng.randrange(3)))
    want, members, session, number, before = {}, [], 0, 0, None
    for path, when, code, person in rows:
        if before is None or (when - before).total_seconds() > 12:
            session, number, members = session + 1, 0, []
        before = when
        near = [((when - t).total_seconds(), (code ^ h).bit_count(), p) for t, h, p in members]
        if not any((gap <= 2 and far <= 4 and p == person) or (gap <= 12 and far <= 2) for gap, far, p in near):
            members, number = [], number + 1
        members.append((when, code, person))
        want[path] = (session, number)
    df = spark.createDataFrame(rows, "path long, captured_at timestamp, hash long, person long").repartition(5)
    got = {r["path"]: (r["session"], r["burst"]) for r in sessions.bursts(df, 2, 12, 2, block_rows).collect()}
    assert got == want and len({s for s, _ in want.values()}) > 1 and max(n for _, n in want.values()) > 5


@pytest.mark.parametrize("block", [1, 4, 50])
def test_walks_over_blocks_meet_the_places_of_a_plain_walk(spark, block):
    rng, rows, want = random.Random(4), [], set()
    for first in (0, 37, 40, 90):
        last = {0: 36, 37: 39, 40: 89, 90: 129}[first]
        ahead = {p: p + rng.choice([1, 1, 2, 5, 17]) for p in range(first, last + 1)}
        rows += [(p // block, p, first, ahead[p] if ahead[p] <= last else None) for p in ahead]
        at_ = first
        while at_ <= last:
            want.add(at_)
            at_ = ahead[at_]
    df = spark.createDataFrame(rows, "block int, pos long, first long, next long").repartition(3)
    got = [r["pos"] for r in scans._walked(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_no_scan_sums_a_frame_anew_for_each_row(spark):
    df = spark.createDataFrame([(p % 2, p, at(p), 0.1, 0.0, 20) for p in range(20)], "run long, path long, captured_at timestamp, dx double, dy double, inliers int")
    seen = []
    inner = scans.stash
    scans.stash = lambda d, *rest: (seen.append(d._jdf.queryExecution().analyzed().toString()), inner(d, *rest))[1]
    try:
        scans.panorama_segments(df, {"min_frames": 3, "min_drift": 0.1, "min_inliers": 15}, 5).collect()
    finally:
        scans.stash = inner
    assert seen and not any("unboundedfollowing" in plan.lower() for plan in seen)


def test_near_counts_equal_the_pairs_and_make_none(spark):
    rng = random.Random(2)
    rows = [(p, at(rng.choice([0, 5, 10, 11, 40, 300]) + p % 3)) for p in range(60)] + [(60, at(9000)), (61, None), (10, at(6))]
    df = spark.createDataFrame(rows, "path long, captured_at timestamp")
    seeds = df.where("path % 10 = 0")
    want = {r["seed"]: r["n"] for r in sessions.near_in_time(seeds, df, 10).groupBy("seed").count().withColumnRenamed("count", "n").collect()}
    found = scans.near_counts(seeds, df, 10)
    assert {r["seed"]: r["near"] for r in found.collect()} == want and 60 not in want
