"""Vector joins, groups, choice and index against brute force."""

import itertools

import numpy as np
import pytest

from shelfmark.operators import similarity, vectors

KIND = "vec_id long, embedding array<double>, score double, label long"
ODD = [(900, None, 1.0, 0), (901, [1.0, 2.0], 1.0, 0), (902, [float("nan")] * 6, 1.0, 0), (903, [None] * 6, 1.0, 0), (904, [float("inf")] + [0.0] * 5, 1.0, 0), (905, [0.0] * 6, 5.0, 0)]


def clustered(n=240, spread=0.12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    v = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, 6))
    v[7], v[8] = v[3], v[3]
    return v


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist(), float(i * 37 % 11), i % 3) for i, x in enumerate(v)] + ODD, KIND)


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("least,rows", [(0.95, 20), (0.5, 15), (0.85, 1000), (-0.3, 30)])
def test_pairs_are_exact_whatever_the_cells(spark, least, rows):
    v = clustered()
    u = unit(v)
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if u[i] @ u[j] >= least}
    got = vectors.cosine_pairs(frame(spark, v), least, block_rows=rows).where("a < 900 and b < 900").collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_one_dense_cell_is_cut(spark):
    v = np.ones((90, 6)) + 0.001 * np.random.default_rng(0).normal(size=(90, 6))
    got = vectors.cosine_pairs(frame(spark, v), 0.99, block_rows=8).where("b < 900")
    assert got.count() == got.distinct().count() == 90 * 89 // 2


def test_cells_that_cannot_meet_are_skipped(spark):
    assert vectors.skipped_share(frame(spark, clustered(spread=0.02)), 0.97, pivots=10) > 0.5


def test_groups_have_sizes_and_best(spark):
    v = clustered(60, 0.01)
    u = unit(v)
    owner = list(range(len(v)))
    for i, j in itertools.combinations(range(len(v)), 2):
        if u[i] @ u[j] >= 0.98:
            a, b = owner[i], owner[j]
            owner = [min(a, b) if o in (a, b) else o for o in owner]
    groups = {c: [i for i, o in enumerate(owner) if o == c] for c in set(owner)}
    want = {(c, len(m), min(m, key=lambda i: (-(i * 37 % 11), i)), tuple(m)) for c, m in groups.items() if 2 <= len(m) <= 6}
    got = vectors.similarity_groups(frame(spark, v), 0.98, max_size=6, block_rows=10).collect()
    assert {(r["component"], r["count"], r["best"], tuple(r["members"])) for r in got} == want and want


def test_choice_equals_a_loop(spark):
    v = clustered(50)
    df = frame(spark, v).withColumnRenamed("vec_id", "path")
    rows = [(i, x, float(i * 37 % 11) / 10, i % 3) for i, x in enumerate(unit(v))] + [(905, np.zeros(6), 0.5, 0)]
    want = set()
    for label in range(3):
        left, chosen = [r for r in rows if r[3] == label], []
        while left and len(chosen) < 6:
            best = max(left, key=lambda r: (round(0.6 * r[2] - 0.4 * max([c[1] @ r[1] for c in chosen], default=0.0), 9), -r[0]))
            left = [r for r in left if r[0] != best[0]]
            chosen.append(best)
            want.add((label, best[0], len(chosen)))
    got = vectors.mmr(df.withColumn("score", df.score / 10), "label", 6, 0.6).collect()
    assert {(r["label"], r["path"], r["rank"]) for r in got} == want


def test_index_finds_most_neighbours(spark):
    v = clustered(1500, 0.6, 3)
    u = unit(v)
    df = frame(spark, v)
    index = vectors.VectorIndex(df, lists=24)
    asked = df.where("vec_id % 50 = 0 and vec_id < 900").selectExpr("vec_id as k", "embedding as v")
    got = index.search(asked, 5).collect()
    right = 0
    for q in range(0, 900, 50):
        near = sorted((-round(float(u[q] @ u[j]), 9), j) for j in range(len(v)) if j != q)[:5]
        found = [(r["rank"], r["neighbour"]) for r in got if r["k"] == q]
        assert sorted(x for x, _ in found) == list(range(1, 6))
        right += len({j for _, j in near} & {j for _, j in found})
    assert right >= 0.9 * 90
    assert index.compared_share(asked) < 0.6
    exact = index.search(asked.where("k = 0"), 5, probes=24).orderBy("rank").collect()
    assert [r["neighbour"] for r in exact] == [j for _, j in sorted((-round(float(u[0] @ u[j]), 9), j) for j in range(1, len(v)))[:5]]


def test_empty_and_odd_tables(spark):
    nothing = frame(spark, clustered(10)).limit(0)
    assert vectors.cosine_pairs(nothing, 0.5).collect() == [] and vectors.mmr(nothing.withColumnRenamed("vec_id", "path"), "label", 3, 0.5).collect() == []
    index = vectors.VectorIndex(nothing)
    assert index.search(nothing.selectExpr("vec_id as k", "embedding as v"), 3).collect() == []
    owners = spark.createDataFrame([(1, [1.0] * 6), (2, [1.0, 2.0])], "owner int, centroid array<double>")
    assert {r["vec_id"] for r in similarity.nearest_owner(spark.createDataFrame(ODD, KIND), owners, -1.0).collect()} <= {901, 905}


@pytest.mark.parametrize("spread", [0.0, 1.0, 40.0])
def test_the_best_in_reach_are_those_of_all_pairs(spark, spread, monkeypatch):
    from shelfmark.operators import collection_sets

    monkeypatch.setattr(collection_sets, "RANGE_ROWS", 2)
    rng = np.random.default_rng(12)
    rows = [(p, float(np.round(spread * rng.random(), 1)), None if p % 9 == 0 else float(rng.integers(0, 6))) for p in range(200)] + [(200, None, 1.0), (201, 500.0, 1.0)]
    items = spark.createDataFrame(rows, "path long, x double, score double")
    seeds = [(p, x) for p, x, _ in rows if p % 7 == 0 or p > 199]
    found = collection_sets.best_in_reach(spark.createDataFrame(seeds, "seed long, at double"), items, 0.3, 4).collect()
    for seed, place in seeds:
        near = [(-9 if s is None else s, -p) for p, x, s in rows if place is not None and x is not None and abs(place - x) <= 0.3 and p != seed]
        assert sorted(r["path"] for r in found if r["seed"] == seed) == sorted(-p for _, p in sorted(near, reverse=True)[:4])


def test_the_best_alike_are_those_of_all_pairs(spark, monkeypatch):
    from shelfmark.operators import collection_sets

    for name, size in (("SEED_ROWS", 5), ("ITEM_ROWS", 30), ("COLUMNS", 4)):
        monkeypatch.setattr(collection_sets, name, size)
    rng = np.random.default_rng(13)
    vectors = rng.normal(size=(120, 5))
    rows = [(p, None if p == 3 else [0.0] * 5 if p == 4 else [1.0, 2.0] if p == 5 else v.tolist(), None if p % 9 == 0 else float(rng.integers(0, 6))) for p, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "path long, embedding array<double>, score double")
    found = collection_sets.best_alike(items.where("path % 6 < 2").selectExpr("path AS seed", "embedding"), items, 0.4, 3).collect()
    plain = {p: np.array(v) / np.linalg.norm(v) for p, v, _ in rows if v and any(v)}
    assert found
    for seed in (p for p in range(120) if p % 6 < 2):
        near = [(-9 if s is None else s, -p) for p, _, s in rows if p != seed and p in plain and seed in plain and len(plain[p]) == len(plain[seed]) and plain[p] @ plain[seed] >= 0.4]
        assert sorted(r["path"] for r in found if r["seed"] == seed) == sorted(-p for _, p in sorted(near, reverse=True)[:3])


def test_lists_are_searched_in_blocks_with_ties_by_key(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SEARCH_ROWS", 9)
    monkeypatch.setattr(vectors, "PRODUCT_ROWS", 4)
    rng = np.random.default_rng(14)
    base = rng.normal(size=(70, 6))
    rows = [(p, (base[p] if p < 70 else base[p % 3]).tolist()) for p in range(110)]  # copies of three
    df = spark.createDataFrame([*rows, (110, [0.0] * 6)], "vec_id long, embedding array<double>")
    index = vectors.VectorIndex(df, lists=4)
    asked = [(p, v) for p, v in rows if p % 4 == 0] + [(200, [0.0] * 6), (201, [1.0, 2.0]), (202, None), (203, [float("nan")] * 6)]
    found = index.search(spark.createDataFrame(asked, "k long, v array<double>"), 5, probes=4).collect()
    unit = {p: np.array(v) / np.linalg.norm(v) for p, v in rows}
    for p in (p for p, _ in asked[:-4]):
        want = sorted((-round(float(unit[p] @ unit[o]), 9), o) for o in unit if o != p)[:5]
        assert [r["neighbour"] for r in sorted((r for r in found if r["k"] == p), key=lambda r: r["rank"])] == [o for _, o in want]
    assert {r["k"] for r in found} == {p for p, _ in asked[:-4]}
