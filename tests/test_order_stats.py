"""Ranks, quantiles and totals over many blocks against plain computing."""

import random

import numpy as np
import pytest

from shelfmark.operators import order_stats, scoring

ROWS = [1, 7, 10_000]


def table(n=400):
    rng = random.Random(8)
    out = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randint(0, 40)), rng.random(), None]), rng.random(), rng.choice([0, 1, None])) for _ in range(n)]
    return [("c", 1.0, 0.5, 1), ("d", None, 0.5, 1), *out]


def frame(spark):
    return spark.createDataFrame(table(), "g string, x double, y double, label int").repartition(3)


def ranks(values):
    values = np.array(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


@pytest.mark.parametrize("rows", ROWS)
def test_average_ranks(spark, rows):
    got = order_stats.average_rank(frame(spark), ["g"], "x", "r", rows).collect()
    want = []
    for g in ("a", "b", "c", "d", None):
        part = [(x, y) for h, x, y, _ in table() if h == g and x is not None]
        want += [(g, x, y, r) for (x, y), r in zip(part, ranks([x for x, _ in part]), strict=True)]
    assert sorted(((r["g"], r["x"], r["y"], r["r"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", ROWS)
def test_quantiles(spark, rows):
    got = {r["g"]: (r["n"], r["q"]) for r in order_stats.quantiles(frame(spark), ["g"], "x", [0, 0.1, 0.5, 0.77, 1], rows).collect()}
    for g in ("a", "b", "c", None):
        values = [x for h, x, _, _ in table() if h == g and x is not None]
        assert got[g][0] == len(values) and got[g][1] == pytest.approx(np.quantile(values, [0, 0.1, 0.5, 0.77, 1]).tolist())
    assert "d" not in got


@pytest.mark.parametrize("rows", ROWS)
def test_auc_and_rank_correlation(spark, rows):
    got = {r["g"]: r["auc"] for r in order_stats.auc(frame(spark), "x", "label", ["g"], block_rows=rows).collect()}
    rho = {r["g"]: r["rho"] for r in order_stats.spearman(frame(spark), ["g"], "x", "y", rows).collect()}
    for g in ("a", "b", None):
        p, q = ([x for h, x, _, t in table() if h == g and x is not None and t == k] for k in (1, 0))
        assert got[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in q]))
        part = [(x, y) for h, x, y, _ in table() if h == g and x is not None]
        assert rho[g] == pytest.approx(np.corrcoef(ranks([x for x, _ in part]), ranks([y for _, y in part]))[0, 1])


def test_nothing(spark):
    nothing = frame(spark).limit(0)
    assert order_stats.quantiles(nothing, ["g"], "x", [0.5]).collect() == order_stats.auc(nothing, "x", "label").collect() == []


def test_weights_are_those_of_a_plain_search(spark):
    rng = np.random.default_rng(6)
    x = rng.random((150, 3))
    y = np.round(np.exp(3 * (0.7 * x[:, 0] + 0.3 * x[:, 2])) + 0.2 * rng.random(150), 1)
    names = ("p", "q", "r")
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "p double, q double, r double, y double")
    found = scoring.fit_weights(df, "y", names, candidates=8, rounds=3)
    draws, best, spread = np.random.default_rng(3), np.full(3, 1 / 3), 1.0
    for _ in range(3):
        tried = scoring.candidates_near(best, spread, 8, draws)
        rho = [np.corrcoef(ranks(np.round(x @ w, 9)), ranks(y))[0, 1] for w in tried]
        best, spread = tried[int(np.argmax(np.round(rho, 12)))], spread / 2
    assert list(found.values()) == pytest.approx(best.tolist()) and found["p"] > found["q"]


def test_bounds_hold_the_rank_correlations_and_leave_the_best(spark):
    rng = np.random.default_rng(8)
    x = rng.random((400, 3))
    y = np.round(2 * x[:, 0] + x[:, 1] + rng.random(400), 1)
    names = ("p", "q", "r")
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "p double, q double, r double, y double")
    ranked = scoring.ranked_target(df, "y", names)
    tried = scoring.candidates_near(np.full(3, 1 / 3), 1.0, 8, rng)
    tried = np.vstack([tried, tried[3]])
    exact = np.array([np.corrcoef(ranks(np.round(x @ w, 9)), ranks(y))[0, 1] for w in tried])
    assert scoring.rank_correlations(ranked, names, tried) == pytest.approx(exact)
    for bins in (7, 64):
        lower, upper = scoring.rank_bounds(ranked, names, tried, bins)
        assert (lower <= exact).all() and (exact <= upper).all()
    assert (upper - lower < 0.2).all()
    assert scoring.best_candidate(ranked, names, tried, (7, 64)) == scoring.best_candidate(ranked, names, tried, ()) == int(np.argmax(np.round(exact, 12)))


def test_each_column_is_correlated_over_its_own_known_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), None if a > 0.7 else float(round(b, 1)), None if b > 0.9 else float(round(a + b, 1)), 1.0) for a, b in rng.random((90, 2))]
    df = spark.createDataFrame(rows, "p double, q double, y double, flat double")
    found = {r["name"]: (r["n"], r["rho"]) for r in order_stats.spearman_each(df, ("p", "q", "flat"), "y", 11).collect()}
    for at, name in enumerate("pq"):
        part = [(r[at], r[2]) for r in rows if r[at] is not None and r[2] is not None]
        assert found[name] == (len(part), pytest.approx(np.corrcoef(ranks([a for a, _ in part]), ranks([b for _, b in part]))[0, 1]))
    assert found["flat"][1] is None
