"""Odd rows and brute force for smaller features."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import browse, collection_sets, diagnostics, predicates, preference, scoring, similarity


def greedy(sets, share, own):
    kept = []
    for name, _, items in sorted(sets, key=lambda s: (s[1], s[0])):
        if not any(len(items & other) > share * (len(items) if own else min(len(items), len(other))) for _, other in kept):
            kept.append((name, items))
    return {name for name, _ in kept}


@pytest.mark.parametrize("of", ["smaller", "own"])
def test_dedup_equals_a_pass_in_order(spark, of):
    rng = random.Random(3)
    sets = [(f"s{i}", rng.randint(0, 3), set(rng.sample(range(40), rng.randint(1, 12)))) for i in range(40)]
    rows = [(n, p, k) for n, k, items in sets for p in items] + [(None, 1, 1), ("s1", None, 0)]
    got = {r["name"] for r in collection_sets.deduplicated(spark.createDataFrame(rows, "name string, path long, priority int"), 0.3, of).collect()}
    assert got == greedy(sets, 0.3, of == "own")
    assert collection_sets.deduplicated(spark.createDataFrame([], "name string, path long, priority int")).collect() == []


def test_gated_labels(spark):
    rows = [(1, [(0.5, "a"), (0.3, "b")]), (2, [(0.5, "a"), (0.49, "b")]), (3, [(0.05, "a"), (0.01, "b")]), (4, None), (5, [(0.5, "a")]), (6, [(0.5, "a"), (0.45, "b")])]
    df = spark.createDataFrame(rows, "id int, scores array<struct<score:double,label:string>>")
    rules = [{"when": F.col("id") == 6, "boost": {"b": 0.2, "none": 1.0}}, {"when": F.lit(None).cast("boolean"), "boost": {"b": 9.0}}]
    got = {r["id"]: (r["m"]["label"], r["m"]["score"]) if r["m"] else None for r in df.select("id", similarity.gated_labels(F.col("scores"), rules, 0.1, 0.02).alias("m")).collect()}
    assert got == {1: ("a", 0.5), 2: ("other", 0.5), 3: ("other", 0.05), 4: None, 5: ("a", 0.5), 6: ("b", 0.45)}


def test_visible_by_grants_of_many_lengths(spark):
    df = spark.createDataFrame([(1, "a/b/c"), (2, "a/b"), (3, "ab"), (4, None), (5, "x"), (1, "a/b/c")], "path int, place string")
    grants = spark.createDataFrame([(1, "a/b"), (1, "a/b/c"), (1, "x"), (2, "zzz"), (1, None)], "user_id int, prefix string")
    assert sorted(r["path"] for r in predicates.visible_to(df, grants, 1).collect()) == [1, 1, 2, 5]
    assert predicates.visible_to(df, grants, 2).collect() == predicates.visible_to(df, grants, 9).collect() == []


def test_gaps_count_equal_best_scores(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 1.0), ("b", 4.0), ("b", 2.5), ("b", None), ("c", 1.0)], "g string, aggregate double")
    got = {r["day"]: (r["n"], r["best"], r["second"], r["gap"]) for r in browse.group_gaps(df, F.col("g"), "day").collect()}
    assert got == {"a": (3, 5.0, 5.0, 0.0), "b": (2, 4.0, 2.5, 1.5)}


def test_culling_pairs_turn_through_the_kept(spark):
    rows = [(1, "g", 9.0, True), (2, "g", 8.0, True), (3, "g", 7.0, True), (4, "g", 1.0, False), (5, "g", 1.0, False), (6, "g", 1.0, False), (7, "h", 1.0, False), (8, "i", 9.0, True)]
    got = preference.culling_pairs(spark.createDataFrame(rows, "path long, grp string, aggregate double, keep boolean"), "grp", 2, 12).collect()
    assert {(r["a_path"], r["b_path"]) for r in got} == {(1, 4), (2, 5), (1, 6)}


def test_timeline_tells_whether_days_follow(spark):
    df = spark.sql("select id as path, timestamp_seconds(1700000000 + id * 86400) as date_taken, double(id) as aggregate from range(5)")
    assert {r["more"] for r in browse.timeline_page(df, 3, 2).collect()} == {True} and {r["more"] for r in browse.timeline_page(df, 5, 2).collect()} == {False}


def test_steps_after_the_sum(spark):
    base = {"aesthetic": 8.0, "tech_sharpness": 5.0, "comp_score": 5.0, "exposure": 5.0}
    rows = [(1, 0, 0, 0, 0), (2, 1, 0, 0, 0), (3, 0, 1, 1, 0), (4, 0, 1, 1, 1), (5, None, None, None, None)]
    df = spark.createDataFrame([(*base.values(), *r) for r in rows], ", ".join(f"{c} double" for c in base) + ", path int, is_blink int, shadow_clipped int, highlight_clipped int, is_silhouette int")
    got = {r["path"]: r["score"] for r in scoring.full_score(df, {"portrait": {"min_aesthetic": 6}}).collect()}
    whole = 0.3 * 8 + 0.7 * 5
    assert got == pytest.approx({1: whole, 2: whole / 2, 3: whole - 1.5, 4: whole, 5: whole})


def test_inflation_of_repeated_metrics(spark):
    df = spark.range(50).selectExpr("double(id) as a", "double(id) as b", "double(id * 7 % 11) as c")
    seen = diagnostics.moments(df, ["a", "b", "c"])
    assert diagnostics.inflation(seen, ["a", "b"])["a"] == float("inf") and diagnostics.inflation(seen, ["a", "c"])["a"] == pytest.approx(1 / (1 - seen["r_a_c"] ** 2))


def test_panoramas_stay_whole_and_kinds_come_in_order(spark):
    from shelfmark.operators import sessions

    group = lambda rows: spark.createDataFrame(rows, "path long, grp string, aggregate double")
    kinds = {"bracket": group([(1, "a", 9.0), (2, "a", 1.0), (3, "b", 5.0)]), "burst": group([(1, "x", 9.0), (3, "x", 2.0), (4, "x", 8.0), (9, "x", 1.0)]), "scene": group([(3, "s", 2.0), (5, "t", 1.0), (6, "t", 9.0)])}
    got = {r["path"]: (r["source"], r["keep"]) for r in sessions.auto_cull(kinds, whole=spark.createDataFrame([(9,), (9,), (None,)], "path long")).collect()}
    assert got == {9: ("panorama", True), 1: ("bracket", True), 2: ("bracket", False), 3: ("burst", False), 4: ("burst", True), 5: ("scene", False), 6: ("scene", True)}


def test_brackets_must_look_alike(spark):
    from shelfmark.operators import sessions

    df = spark.sql("select id as path, 1 as camera, timestamp_seconds(1700000000 + id) as captured_at, int(id) as ev, if(id < 3, 0L, if(id = 4, -1L, 0L)) as hash from range(6)")
    assert {r["path"] for r in sessions.brackets(df, hash_col="hash").collect()} == {0, 1, 2, 3} and {r["path"] for r in sessions.brackets(df).collect()} == set(range(6))


def test_rounded_texts_are_those_of_sql(spark):
    import duckdb

    from shelfmark.functions.scalars import round_scaled

    values = [k / 80 for k in range(801)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", round_scaled(F.col("x"), 3).cast("string").alias("t")).collect()
    want = {x: duckdb.execute("SELECT round(?::DOUBLE, 3)::VARCHAR", [x]).fetchone()[0] for x in values}
    assert {r["x"]: r["t"] for r in got} == want and want[4.0375] == "4.037"
