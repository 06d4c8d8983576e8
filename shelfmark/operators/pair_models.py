"""Pairwise logistic models, many at once: folds, bootstrap replicates, scopes and prior offsets are models of one batched Newton fit."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.operators.preference import group_softmax, shot_metrics, training_rows
from shelfmark.registry import query
from shelfmark.runtime import stash
from shelfmark.sources.views import METRICS

#: Models of one fit; each has a vector and a matrix of sums on the driver.
MOST_MODELS = 10_000
#: Inverse strength of the ridge, least gain in points of a head over what it replaces, pairs below which a scope learns nothing, and the pairs at which a scope trusts itself by half.
C, LEAST_GAIN, LEAST_PAIRS, HALF_TRUST = 1.0, 2.0, 20, 50.0
FOLDS, REPLICATES = 5, 100


def fit_many(rows: DataFrame, size: int, c: float = C, rounds: int = 30, tolerance: float = 1e-9) -> dict:
    """Converged weights of every ``model`` in ``rows``: ``model, y, weight, d`` and, if there, ``offset`` (a fixed part of the logit).

    Each pair counts both ways round, so no side is favoured; ties have ``y`` 0.5. A round is one pass: rows meet their model's weights, and gradients and curvatures of all models are summed by
    Spark. The step is halved while a model's loss would rise. Nulls in ``y``, ``weight`` or ``d`` leave a row out.
    """
    use = rows.where(F.col("model").isNotNull() & F.col("y").isNotNull() & F.col("weight").isNotNull() & F.forall("d", lambda x: x.isNotNull()))
    use = use if "offset" in rows.columns else use.withColumn("offset", F.lit(0.0))
    names = [r["model"] for r in use.select("model").distinct().limit(MOST_MODELS + 1).collect()]
    if len(names) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models in one fit")
    kind = rows.schema["model"].dataType
    held = {m: np.zeros(size) for m in names}
    loss_before: dict = dict.fromkeys(names, math.inf)
    last, open_models = dict(held), set(names)
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    for _ in range(rounds):
        if not open_models:
            break
        table = rows.sparkSession.createDataFrame([(m, held[m].tolist()) for m in sorted(open_models, key=str)], f"_m {kind.simpleString()}, _w array<double>")
        d, w = F.col("d"), F.col("weight")
        z = reduce(lambda a, i: a + d[i] * F.col("_w")[i], range(size), F.col("offset"))
        p = 1 / (1 + F.exp(-F.col("_z")))
        # twice: each pair and its mirror
        loss = 2 * w * (F.greatest(F.col("_z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs(F.col("_z")))) - F.col("y") * F.col("_z"))
        met = use.join(F.broadcast(table), F.col("model") == F.col("_m")).withColumn("_z", z)
        sums = met.groupBy("model").agg(F.sum(loss).alias("loss"), *[F.sum(2 * w * (p - F.col("y")) * d[i]).alias(f"g{i}") for i in range(size)], *[F.sum(2 * w * p * (1 - p) * d[i] * d[j]).alias(f"h{i}_{j}") for i, j in cells]).collect()
        for s in sums:
            m = s["model"]
            now = s["loss"] + held[m] @ held[m] / (2 * c)
            if now > loss_before[m] + 1e-12 * abs(now):
                held[m] = (held[m] + last[m]) / 2
                continue
            h = np.zeros((size, size))
            for i, j in cells:
                h[i, j] = h[j, i] = s[f"h{i}_{j}"]
            step = np.linalg.solve(h + np.eye(size) / c, np.array([s[f"g{i}"] for i in range(size)]) + held[m] / c)
            last[m], loss_before[m], held[m] = held[m], now, held[m] - step
            if np.abs(step).max() < tolerance:
                open_models.discard(m)
    return held


def _logit(weights: Column | list[float], size: int) -> Column:
    return reduce(lambda a, i: a + F.col("d")[i] * (weights[i] if isinstance(weights, Column) else float(weights[i])), range(size), F.lit(0.0))


def _fold(folds: int) -> Column:
    return F.pmod(F.xxhash64("a_path", "b_path", F.lit(21)), F.lit(folds)).cast("int")


def accuracy(rows: DataFrame, z: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows ``by, n, accuracy``: how often the side with the larger logit won; ties are left out."""
    right = ((z > 0) == (F.col("y") == 1)).cast("double")
    return rows.where("y <> 0.5").groupBy(*by).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def cross_validated(rows: DataFrame, size: int, baseline: Column, folds: int = FOLDS, scope: str | None = None, c: float = C) -> DataFrame:
    """Rows ``scope, fold, n, learned, baseline``: the accuracy on each fold of a fit on the others, beside that of ``baseline``, a logit. All folds of all scopes are one fit."""
    held = stash(rows.withColumn("scope", F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")).withColumn("fold", _fold(folds)))
    dealt = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("part <> fold").withColumn("model", F.concat_ws("\n", "scope", F.col("part").cast("string")))
    fits = fit_many(dealt, size, c)
    if not fits:
        return held.limit(0).selectExpr("scope", "fold", "0L as n", "0.0D as learned", "0.0D as baseline")
    table = rows.sparkSession.createDataFrame([(m, w.tolist()) for m, w in fits.items()], "model string, w array<double>")
    tested = held.withColumn("model", F.concat_ws("\n", "scope", F.col("fold").cast("string"))).join(F.broadcast(table), "model", "left").withColumn("w", F.coalesce("w", F.array(*[F.lit(0.0)] * size)))
    own = accuracy(tested, _logit(F.col("w"), size), ["scope", "fold"]).withColumnRenamed("accuracy", "learned")
    return own.join(accuracy(held, baseline, ["scope", "fold"]).select("scope", "fold", F.col("accuracy").alias("baseline")), ["scope", "fold"])


def bootstrap(rows: DataFrame, size: int, replicates: int = REPLICATES, c: float = C) -> DataFrame:
    """Rows ``replicate, dim, weight``: converged fits on resampled pairs. A pair's count in a replicate is a Poisson number of mean 1 from the hash of both, so it doesn't depend on how rows are dealt."""
    even = F.pmod(F.xxhash64("a_path", "b_path", "model"), F.lit(1 << 30)) / (1 << 30)
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    count = reduce(lambda a, e: a + (even >= float(e)).cast("int"), edges, F.lit(0))
    dealt = stash(rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", count).where("k > 0").withColumn("weight", F.col("weight") * F.col("k")).select("model", "y", "weight", "d"))
    fits = fit_many(dealt, size, c)
    return rows.sparkSession.createDataFrame([(int(m), i, float(x)) for m, w in sorted(fits.items()) for i, x in enumerate(w)], "replicate int, dim int, weight double")


def gated_heads(rows: DataFrame, size: int, baseline: Column, scope: str | None = None, least_gain: float = LEAST_GAIN, least_pairs: int = LEAST_PAIRS, c: float = C) -> DataFrame:
    """Rows ``scope, n, cv, baseline, gain, gated, weights``: a head for each scope with enough pairs; ``gated`` where its accuracy on held-out folds is not ``least_gain`` points above the baseline's."""
    named = rows.withColumn("scope", F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit(""))
    large = stash(named.groupBy("scope").agg(F.count("*").alias("pairs")).where(F.col("pairs") >= least_pairs))
    kept = stash(named.join(F.broadcast(large) if large.count() <= MOST_MODELS else large, "scope").drop("pairs"))
    cv = cross_validated(kept, size, baseline, scope="scope", c=c).groupBy("scope").agg(F.avg("learned").alias("cv"), (F.sum(F.col("baseline") * F.col("n")) / F.sum("n")).alias("baseline"))
    fits = fit_many(kept.withColumn("model", F.col("scope")), size, c)
    table = rows.sparkSession.createDataFrame([(m, w.tolist()) for m, w in fits.items()], "scope string, weights array<double>")
    gain = (F.col("cv") - F.col("baseline")) * 100
    return large.join(cv, "scope").join(table, "scope").select("scope", F.col("pairs").alias("n"), "cv", "baseline", gain.alias("gain"), (gain < least_gain).alias("gated"), "weights")


def blended_with_prior(rows: DataFrame, size: int, prior: list[float], scope: str, c: float = C, half_trust: float = HALF_TRUST) -> DataFrame:
    """Rows ``scope, n, lam, delta, weights``: each scope's departure from a prior, fitted with the prior's logit as offset, and taken over by ``n / (n + half_trust)``."""
    named = stash(rows.withColumn("model", F.coalesce(F.col(scope).cast("string"), F.lit(""))).withColumn("offset", _logit(prior, size)))
    fits = fit_many(named, size, c)
    table = rows.sparkSession.createDataFrame([(m, w.tolist()) for m, w in fits.items()], "scope string, delta array<double>")
    lam = F.col("n") / (F.col("n") + half_trust)
    sized = named.groupBy(F.col("model").alias("scope")).agg(F.count("*").alias("n")).join(table, "scope").withColumn("lam", lam)
    return sized.withColumn("weights", F.zip_with(F.array(*[F.lit(float(x)) for x in prior]), "delta", lambda a, b: a + F.col("lam") * b))


def keepers(items: DataFrame, pairs: DataFrame, group: str, metrics: tuple[str, ...] = METRICS, heuristic: str = "aggregate", **options) -> DataFrame:
    """Rows ``group, path, prob, learned``: the chance of each item to be its group's keeper, by a head trained on culling pairs, or by the heuristic score where the head doesn't beat it."""
    rows = training_rows(pairs.where("source = 'culling'"), items, (*metrics, heuristic))
    size = len(metrics)
    head = gated_heads(stash(rows.withColumn("lead", F.col("d")[size]).withColumn("d", F.slice("d", 1, size))), size, F.col("lead"), **options).first()
    use = head is not None and not head["gated"]
    score = reduce(lambda a, i: a + F.coalesce(F.col(metrics[i]), F.lit(0.0)) * head["weights"][i], range(size), F.lit(0.0)) if use else F.col(heuristic)
    return group_softmax(items.withColumn("_score", score), group, "_score").select(group, "path", "prob", F.lit(use).alias("learned"))


def pair_rows(v) -> DataFrame:
    return stash(training_rows(v.pref, shot_metrics(v)))


MEAN = [1 / len(METRICS)] * len(METRICS)


@query("m9_folds")
def _(v):
    return cross_validated(pair_rows(v), len(METRICS), _logit(MEAN, len(METRICS)), scope="category").select("scope", "fold", "n", F.round("learned", 5).alias("learned"), F.round("baseline", 5).alias("baseline"))


@query("m9_bootstrap_intervals")
def _(v):
    found = bootstrap(pair_rows(v), len(METRICS))
    return found.groupBy("dim").agg(F.percentile("weight", [0.025, 0.5, 0.975]).alias("q")).select("dim", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "mid", "high"))])


@query("m10_gated_rankers")
def _(v):
    heads = gated_heads(pair_rows(v), len(METRICS), _logit(MEAN, len(METRICS)), scope="category")
    return heads.select("scope", "n", F.round("gain", 4).alias("gain"), "gated", *[F.round(F.col("weights")[i], 6).alias(m) for i, m in enumerate(METRICS)])


@query("m11_blended_rankers")
def _(v):
    found = blended_with_prior(pair_rows(v), len(METRICS), [0.1, 0.0, 0.0, 0.0], "category")
    return found.select("scope", "n", F.round("lam", 5).alias("lam"), *[F.round(F.col("weights")[i], 6).alias(m) for i, m in enumerate(METRICS)])


@query("m13_keeper_head")
def _(v):
    items = shot_metrics(v).join(v.shot.select("path", "camera"), "path")
    return keepers(items, v.pref, "camera").withColumn("prob", F.round("prob", 6))
