"""Small exact cases of the operators."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import scalars
from shelfmark.operators import browse, collection_sets, preference, scans, scoring, sessions, similarity
from shelfmark.operators.components import connected_components
from shelfmark.sources import tables

START = dt.datetime(2024, 1, 1)


def shots(spark, rows):
    return spark.createDataFrame([(i, START + dt.timedelta(seconds=s) if s is not None else None, *r) for i, (s, *r) in enumerate(rows)], "path long, captured_at timestamp, camera long, ev int, kind string, aggregate double")


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(1, 12)] + [(100, k) for k in range(101, 140)] + [(7000, 7000), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, **{i: 100 for i in range(100, 140)}, 7000: 7000}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sessions_across_ranges(spark):
    times = [0, 5, 20, 21, 100, 101, 102, 500]
    df = shots(spark, [(t, 1, 0, "a", 1.0) for t in times])
    got = [r["session"] for r in sessions.sessions(df, 10).orderBy("path").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 3, 4]
    assert [r["session"] for r in sessions.sessions(df, 10, ["camera"]).orderBy("path").collect()] == got


def test_brackets_need_even_steps_one_way_and_span(spark):
    rows = [(0, 1, 0, "a", 1.0), (1, 1, 1, "a", 1.0), (2, 1, 2, "a", 1.0), (60, 1, 0, "a", 1.0), (61, 1, 1, "a", 1.0), (62, 1, 0, "a", 1.0), (0, 2, 0, "a", 1.0), (1, 2, 1, "a", 1.0), (2, 2, 5, "a", 1.0)]
    got = sessions.brackets(shots(spark, rows)).orderBy("path").collect()
    assert [(r["path"], r["offset"]) for r in got] == [(0, 1), (1, 0), (2, -1)]


def test_bursts_match_any_member_and_null_times_stand_alone(spark):
    df = spark.createDataFrame([(0, START, 0, 1), (1, START + dt.timedelta(seconds=100), 2**40 - 1, 1), (2, START + dt.timedelta(seconds=200), 1, 1), (3, None, 0, 1)], "path long, captured_at timestamp, hash long, person long")
    got = {r["path"]: (r["session"], r["burst"]) for r in sessions.bursts(df, 5, 3600, 4).collect()}
    assert got[0] != got[1] and got[3] not in (got[0], got[1], got[2])


def test_scenes_split_where_a_label_holds_and_at_the_widest_gap(spark):
    df = shots(spark, [(t, 1, 0, k, 1.0) for t, k in [(0, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "b"), (6, "b")]]).withColumn("session", F.lit(1).cast("long"))
    assert [r["part"] for r in scans.split_scenes(df, 3, 100).orderBy("path").collect()] == [0, 0, 0, 0, 4, 4, 4]
    wide = shots(spark, [(t, 1, 0, "a", 1.0) for t in (0, 1, 10, 11)]).withColumn("session", F.lit(1).cast("long"))
    assert [r["part"] for r in scans.split_scenes(wide, 3, 2).orderBy("path").collect()] == [0, 0, 2, 2]


def test_auto_cull_first_decision_wins(spark):
    a = spark.createDataFrame([(1, "x", 9.0), (2, "x", 1.0)], "path long, grp string, aggregate double")
    b = spark.createDataFrame([(2, "y", 9.0), (3, "y", 1.0), (4, "y", 9.0)], "path long, grp string, aggregate double")
    got = {r["path"]: (r["source"], r["keep"]) for r in sessions.auto_cull({"a": a, "b": b}, 90).collect()}
    assert got == {1: ("a", True), 2: ("a", False), 3: ("b", False), 4: ("b", True)}


def test_hamming_pairs_are_exact(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    values = [*base.tolist(), *(int(b ^ 0b111) for b in base[:10])]
    df = spark.createDataFrame(list(enumerate(values)), "vec_id long, hash long")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(values), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 5}
    assert {(r["a"], r["b"]) for r in similarity.hamming_pairs(df, 5).collect()} == want


def test_cosine_pairs_are_exact(spark):
    v = np.random.default_rng(1).normal(size=(40, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if u[i] @ u[j] >= 0.5}
    assert {(r["a"], r["b"]) for r in similarity.cosine_pairs(df, 0.5, block_rows=5).collect()} == want


def test_nearest_owner_is_alike_by_broadcast_and_by_blocks(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(30, 4)))], "vec_id long, embedding array<double>")
    owners = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(9, 4)))], "owner int, centroid array<double>")
    one = {tuple(r) for r in similarity.nearest_owner(df, owners, 0.3).collect()}
    assert one and one == {tuple(r) for r in similarity.nearest_owner(df, owners, 0.3, most=0, block_rows=5).collect()}


def test_merge_chains_and_cycles(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 11)], "src long, dst long")
    got = {r["s"]: r["d"] for r in similarity.resolve_chains(pairs).collect()}
    assert (got[1], got[2], got[3]) == (4, 4, 4) and got[10] == got[11] == 10


def test_density_clusters_leave_noise(spark):
    v = [[1.0, 0.0], [0.99, 0.1], [0.98, 0.15], [0.0, 1.0], [-1.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in similarity.density_clusters(df, 0.95, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: None, 4: None}


def test_index_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 3, 3, 2)], "x double")
    assert scoring.index_percentile(df, ("x",), 50).first()["value"] == 3
    assert scoring.index_percentile(df, ("x",), 100).first()["value"] == 5
    assert scoring.index_percentile(df, ("x",), 0).first()["value"] == 1


def test_weights_sum_to_a_hundred():
    assert scoring.normalise_weights({"a": 1, "b": 1, "c": 1}) == {"a": 33, "b": 33, "c": 34}
    assert scoring.normalise_weights({}) == {}


def test_zero_variance_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    from shelfmark.operators.dashboards import pearson

    assert df.agg(pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_global_rank_is_gapless(spark):
    df = spark.createDataFrame([(i, float(i * 7919 % 101)) for i in range(300)], "path long, x double")
    rows = browse.global_rank(df, [F.col("x").asc(), F.col("path").asc()]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(300))
    assert [(r["x"], r["path"]) for r in rows] == sorted((r["x"], r["path"]) for r in rows)


def test_set_dedup_keeps_the_first_of_overlapping_sets(spark):
    rows = [("a", p, 1) for p in range(10)] + [("b", p, 2) for p in range(5, 15)] + [("c", p, 3) for p in range(12, 20)] + [("d", 99, 4)]
    kept = {r["name"] for r in collection_sets.deduplicated(spark.createDataFrame(rows, "name string, path long, priority int")).collect()}
    assert kept == {"a", "c", "d"}


def test_ranker_finds_the_deciding_metric(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(size=(400, 3))
    rows = spark.createDataFrame([(i, i + 1, float(x[1] > 0), 1.0, x.tolist()) for i, x in enumerate(d)], "a_path long, b_path long, y double, weight double, d array<double>")
    w = preference.fit_logistic(rows, 3, rounds=10)
    assert np.argmax(np.abs(w)) == 1 and preference.accuracy(rows, w) > 0.9


def test_auc_of_perfect_and_constant_scores(spark):
    df = spark.createDataFrame([(1.0, 0, 5.0), (2.0, 0, 5.0), (3.0, 1, 5.0)], "s double, y int, c double")
    assert preference.auc(df, "s", "y").first()["auc"] == 1.0
    assert preference.auc(df, "c", "y").first()["auc"] == 0.5


def test_colour_difference_of_published_pairs():
    cases = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644)]
    for one, two, want in cases:
        assert scalars.ciede2000(*map(np.array, one), *map(np.array, two)) == pytest.approx(want, abs=1e-4)


def test_time_formats_and_rationals(spark):
    df = spark.createDataFrame([("2024:05:06 07:08:09",), ("2024-05-06T07:08:09.5",), ("2024/05/06 07:08:09",), ("no",), (None,)], "t string")
    assert [r[0] is not None for r in df.select(scalars.parse_time(F.col("t"))).collect()] == [True, True, True, False, False]
    df = spark.createDataFrame([("1/250",), ("0.5",), ("1/0",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.rational(F.col("t"))).collect()] == [0.004, 0.5, None, None, None]


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"SourceFile": "a.jpg", "CreateDate": "2024:01:01 00:00:00", "ISO": 100}\n')
    assert tables.read_metadata(spark, str(tmp_path / "m.json")).first()["taken"] == "2024:01:01 00:00:00"
    (tmp_path / "v.txt").write_text("1 77 0 0 0 0 0 0 0 0 0 4 1 2 9\n")
    row = tables.read_votes(spark, str(tmp_path / "v.txt")).first()
    assert (row["image"], row["mos"], row["score"]) == (77, 10.0, 10.0)
    side = tmp_path / "side"
    side.mkdir()
    (side / "a.xmp").write_text("<x><r:Rating xmlns:r='u'>4</r:Rating><d:subject xmlns:d='v'><li>sea</li><li>sun</li></d:subject></x>")
    row = tables.read_sidecars(spark, str(side)).first()
    assert row["rating"] == 4 and row["keywords"] == ["sea", "sun"] and row["label"] is None
    (side / "b.JPG").write_bytes(b"1")
    assert tables.discover(spark, str(side)).count() == 1


def test_upsert_keeps_what_is_not_declared(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "path long, x double, y string")
    new = spark.createDataFrame([(2, 9.0), (3, 3.0)], "path long, x double")
    got = {tuple(r) for r in collection_sets.upsert(old, new, "path", ["x"]).collect()}
    assert got == {(1, 1.0, "a"), (2, 9.0, "b"), (3, 3.0, None)}


def greedy_pairs(rows, per_item, total, gap, pool, sampled):
    """Label pairs by plain nested loops over all items."""
    used, out = {}, []

    def put(c, a, b):
        if a != b and len(out) < total and used.get(a, 0) < per_item and used.get(b, 0) < per_item:
            out.append((c, a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1

    for c in sorted({r[0] for r in rows}):
        own = sorted(r[1:] for r in rows if r[0] == c)
        liked, lost = [r[0] for r in own if r[2] == 1], [r[0] for r in own if r[3] == 1]
        rated = sorted(((-(r[1] or 0), r[0]) for r in own if r[1] and r[3] != 1))
        plain = [r[0] for r in own if not r[1] and r[2] != 1 and r[3] != 1][:pool]
        for a in liked:
            for b in lost:
                put(c, a, b)
        for s, a in rated:
            for t, b in rated:
                if t - s >= gap:
                    put(c, a, b)
        for k, a in enumerate(liked):
            for m in range(min(sampled, len(plain))):
                put(c, a, plain[(sampled * k + m) % len(plain)])
    return out


def test_label_pairs_match_plain_loops(spark):
    from shelfmark.operators.preference import label_pairs

    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2, 3, 4, 5]), int(rng.random() < 0.3), int(rng.random() < 0.2)) for i in range(160)]
    df = spark.createDataFrame(rows, "category string, path long, star_rating int, is_favorite int, is_rejected int")
    for caps in ((6, 2000, 2, 500, 2), (3, 2000, 2, 5, 2), (6, 70, 3, 500, 1)):
        got = [tuple(r) for r in label_pairs(df, *caps).collect()]
        assert got == greedy_pairs(rows, *caps)
    assert label_pairs(df.limit(0)).count() == 0


def test_crossed_sets_sort_no_rows(spark):
    rows = [(p, dt.datetime(2020 + p % 3, 1 + p % 12, 3), "c%d" % (p % 2), "l%d" % (p % 4), None if p == 7 else p % 5 * 1.5) for p in range(60)]
    df = spark.createDataFrame(rows, "path long, date_taken timestamp, camera string, lens string, aggregate double")
    found = collection_sets.crossed_sets(df, [("year", "camera"), ("camera", "lens")], 10)
    want = {}
    for path, taken, camera, lens, score in rows:
        for key in (("year", "camera", str(taken.year), camera), ("camera", "lens", camera, lens)):
            want.setdefault(key, []).append((float("-inf") if score is None else -score, path))
    assert {(r["one"], r["two"], r["a"], r["b"]): (r["n"], r["best"]) for r in found.collect()} == {k: (len(v), min(v)[1]) for k, v in want.items() if len(v) >= 10}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
