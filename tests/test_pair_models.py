"""Batched fits against NumPy on the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import pair_models as models

KIND = "a_path long, b_path long, category string, y double, weight double, d array<double>"


def table(n=240, seed=2):
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(n, 3))
    y = np.where(rng.random(n) < 1 / (1 + np.exp(-d @ [1.5, -0.7, 0.0])), 1.0, 0.0)
    y[::17] = 0.5
    return [(i, i + 1000, ["p", "q", None][i % 3], float(y[i]), [1.0, 0.7, 0.5][i % 3], d[i].tolist()) for i in range(n)]


def plain(rows, c=1.0, offset=None):
    d, y, w = (np.array([r[k] for r in rows]) for k in (5, 3, 4))
    off = np.zeros(len(rows)) if offset is None else d @ np.array(offset)
    x, yy, ww, oo = np.vstack([d, -d]), np.r_[y, 1 - y], np.r_[w, w], np.r_[off, -off]
    out = np.zeros(d.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(oo + x @ out)))
        out = out - np.linalg.solve((x * (ww * p * (1 - p))[:, None]).T @ x + np.eye(len(out)) / c, x.T @ (ww * (p - yy)) + out / c)
    return out


def test_all_models_converge_at_once(spark):
    rows = table()
    df = spark.createDataFrame([*rows, (1, 2, "p", None, 1.0, [1.0, 1.0, 1.0]), (1, 2, "p", 1.0, 1.0, [1.0, None, 1.0])], KIND).withColumn("model", F.coalesce("category", F.lit("none")))
    got = models.fit_many(df, 3, c=0.5)
    for name in ("p", "q", "none"):
        assert got[name] == pytest.approx(plain([r for r in rows if (r[2] or "none") == name], 0.5), abs=1e-7)


def test_separable_pairs_stay_finite(spark):
    rows = [(i, i + 50, "p", 1.0, 1.0, [1.0 + i, 0.0, 0.0]) for i in range(20)]
    assert models.fit_many(spark.createDataFrame(rows, KIND).withColumn("model", F.lit(1)), 3)[1] == pytest.approx(plain(rows), abs=1e-7)


def test_folds_and_gate(spark):
    rows = table(600)
    df = spark.createDataFrame(rows, KIND)
    cut = {(r["a_path"]): r["f"] for r in df.select("a_path", models._fold(5).alias("f")).collect()}
    want = []
    for fold in range(5):
        w = plain([r for r in rows if cut[r[0]] != fold])
        test = [r for r in rows if cut[r[0]] == fold and r[3] != 0.5]
        want.append((fold, len(test), np.mean([(np.dot(r[5], w) > 0) == (r[3] == 1) for r in test]), np.mean([(r[5][2] > 0) == (r[3] == 1) for r in test])))
    got = sorted(map(tuple, models.cross_validated(df, 3, F.col("d")[2]).select("fold", "n", "learned", "baseline").collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2:] for g in got] == [pytest.approx(w[2:]) for w in want]
    free = models.gated_heads(df, 3, F.col("d")[2]).first()
    assert not free["gated"] and free["gain"] > 2 and free["weights"] == pytest.approx(plain(rows), abs=1e-7)
    held = models.gated_heads(df, 3, F.col("d")[0] * 1.5 - F.col("d")[1] * 0.7).first()
    assert held["gated"]
    assert models.gated_heads(df.limit(5), 3, F.col("d")[2]).collect() == []


def test_bootstrap_equals_fits_on_the_same_counts(spark):
    rows = table(150)
    df = spark.createDataFrame(rows, KIND)
    got = models.bootstrap(df, 3, replicates=4).collect()
    even = df.crossJoin(spark.range(4).selectExpr("cast(id as int) as model")).select("a_path", "model", (F.pmod(F.xxhash64("a_path", "b_path", "model"), F.lit(1 << 30)) / (1 << 30)).alias("u")).collect()
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    for m in range(4):
        counts = {r["a_path"]: int((r["u"] >= edges).sum()) for r in even if r["model"] == m}
        want = plain([(*r[:4], r[4] * counts[r[0]], r[5]) for r in rows if counts[r[0]]])
        assert [r["weight"] for r in sorted(got) if r["replicate"] == m] == pytest.approx(want.tolist(), abs=1e-7)
        assert 0.7 < sum(counts.values()) / 150 < 1.3


def test_prior_is_an_offset(spark):
    rows, prior = table(), [0.8, 0.0, 0.3]
    got = {r["scope"]: r for r in models.blended_with_prior(spark.createDataFrame(rows, KIND), 3, prior, "category").collect()}
    for name in ("p", "q", ""):
        part = [r for r in rows if (r[2] or "") == name]
        delta, lam = plain(part, offset=prior), len(part) / (len(part) + 50)
        assert got[name]["lam"] == pytest.approx(lam) and got[name]["weights"] == pytest.approx(np.array(prior) + lam * delta, abs=1e-7)


def test_keepers_fall_back_to_the_heuristic(spark):
    items = spark.createDataFrame([(i, float(i % 5), float(i % 3), 1.0, 2.0, float(i % 7), i // 10) for i in range(60)], "path long, aesthetic double, tech_sharpness double, comp_score double, exposure double, aggregate double, grp long")
    pair = lambda col: spark.createDataFrame([(i, j, "p", "culling", "a" if col(i) > col(j) else "b") for i in range(60) for j in range(i) if col(i) != col(j) and (i + j) % 4 == 0], "a_path long, b_path long, category string, source string, winner string")
    learned = models.keepers(items, pair(lambda i: i % 5), "grp").collect()
    assert all(r["learned"] for r in learned) and sum(r["prob"] for r in learned) == pytest.approx(6.0)
    top = max((r for r in learned if r["grp"] == 0), key=lambda r: r["prob"])
    assert top["path"] % 5 == 4
    assert not models.keepers(items, pair(lambda i: i % 7), "grp").first()["learned"]
    assert not models.keepers(items, pair(lambda i: i % 7).limit(0), "grp").first()["learned"]
