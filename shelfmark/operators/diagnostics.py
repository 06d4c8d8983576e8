"""Diagnostics of a scoring: thirteen kinds of issues, each a row with its metric and the figure that shows it."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators.dashboards import pearson
from shelfmark.operators.order_stats import at_index, spearman_each, value_counts
from shelfmark.operators.scoring import WEIGHTS
from shelfmark.registry import query
from shelfmark.runtime import stash
from shelfmark.sources.views import METRICS

#: Thresholds. Fixed values, to be overridden by name.
LIMITS = {
    "signal_mean": 7.5, "signal_weight": 0.10, "dominant": 0.5, "dominant_excess": 0.15, "low_weight": 0.15, "low_correlation": 0.2, "collinear": 0.85, "category_rows": 50, "imbalance": 0.5,
    "skew": 0.3, "ceiling": 0.95, "floor": 0.30, "floor_width": 0.5, "fences": 2.5, "disagreement": 4.0, "least_rows": 50, "range": 4.0, "drift": 0.1,
}
#: What weighs more is reported first. Fixed values.
PRIORITY = {
    "underutilized_signal": 70, "missing_data": 70, "dominant_correlation": 60, "category_imbalance": 55, "metric_disagreement": 55, "normalization_compressed": 55, "collinearity": 50, "floor_clustering": 50,
    "skewed_distribution": 45, "normalization_drift": 45, "low_correlation_high_weight": 40, "score_ceiling": 40, "score_outliers": 25,
}
SCHEMA = "issue string, metric string, other string, value double, n long"


def expected_correlation(weight: float, metrics: int, spread: float, target_spread: float) -> float:
    """What correlation with the total a weight explains; a total without spread explains the weight alone."""
    return min(0.95, max(0.0, weight * math.sqrt(metrics) * spread / target_spread)) if target_spread else weight


def moments(df: DataFrame, names: list[str]) -> dict:
    """Means, deviations, ranges, missing values and all pairwise correlations in one pass; one row reaches the driver."""
    sums = [x for m in names for x in (F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"m_{m}"), F.stddev_pop(m).alias(f"s_{m}"), F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"))]
    pairs = [pearson(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"r_{a}_{b}") for a, b in combinations(names, 2)]
    return df.agg(F.count("*").alias("rows"), *sums, *pairs).first().asDict()


def inflation(seen: dict, names: list[str]) -> dict[str, float]:
    """Variance inflation factors: the diagonal of the inverse of the correlation matrix (infinite if it has none)."""
    import numpy as np

    r = np.eye(len(names))
    for (i, a), (j, b) in combinations(list(enumerate(names)), 2):
        r[i, j] = r[j, i] = seen[f"r_{a}_{b}"] or 0.0
    if np.linalg.matrix_rank(r) < len(names):
        return dict.fromkeys(names, math.inf)
    return dict(zip(names, np.diag(np.linalg.inv(r)).tolist(), strict=True))


def diagnose(df: DataFrame, weights: dict[str, float] | None = None, target: str = "aggregate", category: str = "category", base: str = "aesthetic", earlier: dict[str, float] | None = None, **limits: float) -> DataFrame:
    """Rows ``issue, metric, other, value, n, priority, confidence``.

    ``weights`` are the metrics' shares, ``earlier`` the 90th percentiles of an earlier normalisation, by metric. Three passes over the rows (moments, order statistics, counts beyond
    what these found) and one over categories; only sums for each metric reach the driver. Correlations with the target are of ranks, those between metrics plain. An empty table has no issues.
    """
    at, weights = LIMITS | limits, weights or {m: w / 100 for m, w in WEIGHTS["default"].items()}
    names = list(weights)
    everything, spark = [*names, target], df.sparkSession
    df = stash(df.select(*dict.fromkeys([*everything, base, category])))  # every pass reads what is written here, not the joins behind it
    seen = moments(df, everything)
    inline = lambda cols: F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in cols]))
    place = lambda p: F.least(F.floor(F.col("k_all") * p / 100), F.col("k_all") - 1)
    picks = at_index(value_counts(df.select(inline(everything)), ["metric"], "x"), ["metric"], "x", {f"p{p}": place(p) for p in (25, 75, 90)}).collect()
    q = {r["metric"]: r for r in picks}
    rho = {r["name"]: r["rho"] for r in spearman_each(df, tuple(names), target).collect()}
    iqr = {m: q[m]["p75"] - q[m]["p25"] for m in q}
    floor = [F.count_if(F.col(m) <= seen[f"lo_{m}"] + at["floor_width"]).alias(f"f_{m}") if m in q else F.lit(0).alias(f"f_{m}") for m in names]
    far = F.abs(F.col(base) - F.col(target)) > at["disagreement"]
    gaps = [F.avg(F.when(far, F.col(m) - F.col(base))).alias(f"g_{m}") for m in names if m != base]
    low, high = (q[target]["p25"] - at["fences"] * iqr[target], q[target]["p75"] + at["fences"] * iqr[target]) if target in q else (0.0, 0.0)
    outside = (F.col(target) < low) | (F.col(target) > high)
    beyond = df.agg(*floor, F.count_if(outside).alias("outside"), F.count_if(far).alias("far"), *gaps).first()
    out: list[tuple] = []
    for m in names:
        w, n, r = weights[m], seen[f"n_{m}"], rho.get(m)
        if not n:
            continue
        if seen[f"m_{m}"] > at["signal_mean"] and w <= at["signal_weight"] and not (r or 0) > at["dominant"]:
            out.append(("underutilized_signal", m, None, seen[f"m_{m}"], n))
        expected = expected_correlation(w, len(names), seen[f"s_{m}"], seen[f"s_{target}"] or 0.0)
        if r is not None and r > at["dominant"] and r > expected + at["dominant_excess"]:
            out.append(("dominant_correlation", m, target, r, n))
        if r is not None and w >= at["low_weight"] and abs(r) < at["low_correlation"]:
            out.append(("low_correlation_high_weight", m, target, r, n))
        if n >= at["least_rows"]:
            if seen[f"hi_{m}"] > 0 and q[m]["p90"] / seen[f"hi_{m}"] > at["ceiling"]:
                out.append(("score_ceiling", m, None, q[m]["p90"] / seen[f"hi_{m}"], n))
            if beyond[f"f_{m}"] / n > at["floor"]:
                out.append(("floor_clustering", m, None, beyond[f"f_{m}"] / n, n))
        if earlier and earlier.get(m) and abs(q[m]["p90"] - earlier[m]) / earlier[m] > at["drift"]:
            out.append(("normalization_drift", m, None, abs(q[m]["p90"] - earlier[m]) / earlier[m], n))
    for a, b in combinations(sorted(names), 2):
        r = seen[f"r_{a}_{b}"] if f"r_{a}_{b}" in seen else seen[f"r_{b}_{a}"]
        if r is not None and r > at["collinear"]:
            less, more = (b, a) if weights[b] <= weights[a] else (a, b)
            out.append(("collinearity", less, more, r, seen["rows"]))
    for m in everything:
        n, width = seen[f"n_{m}"], (seen[f"hi_{m}"] or 0) - (seen[f"lo_{m}"] or 0)
        if n >= at["least_rows"]:
            if width > 0 and iqr[m] / width < at["skew"]:
                out.append(("skewed_distribution", m, None, iqr[m] / width, n))
            if width < at["range"]:
                out.append(("normalization_compressed", m, None, width, n))
        if n < seen["rows"]:
            out.append(("missing_data", m, None, float(seen["rows"] - n), seen["rows"]))
    if beyond["outside"] and seen[f"n_{target}"] > at["least_rows"]:
        out.append(("score_outliers", target, None, float(beyond["outside"]), seen[f"n_{target}"]))
    if beyond["far"]:
        known = [m for m in names if m != base and beyond[f"g_{m}"] is not None]
        most = min(known, key=lambda m: (-round(abs(beyond[f"g_{m}"]), 9), m), default=None)
        out.append(("metric_disagreement", base, most, float(beyond["far"]), seen["rows"]))
    means = df.where(F.col(target).isNotNull()).groupBy(F.col(category).alias("metric")).agg(F.count("*").alias("n"), F.avg(target).alias("mean"))
    large = means.where(F.col("n") > at["category_rows"])
    overall = large.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))
    gap = large.join(F.broadcast(overall)).withColumn("value", F.col("all") - F.col("mean")).where((F.col("value") > at["imbalance"]) | (-F.col("value") > 1.5 * at["imbalance"]))
    found = spark.createDataFrame(out, SCHEMA).unionByName(gap.select(F.lit("category_imbalance").alias("issue"), "metric", F.lit(None).cast("string").alias("other"), "value", "n"))
    level = F.when(F.col("n") >= 500, "high").when(F.col("n") >= 100, "medium").otherwise("low")
    return found.withColumn("priority", F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("issue"))).withColumn("confidence", level)


#: Limits under which the given tables show each kind.
SHOWN = {"signal_mean": 4.9, "signal_weight": 0.20, "dominant": 0.002, "dominant_excess": -0.9, "low_weight": 0.15, "collinear": -0.05, "category_rows": 50, "imbalance": 0.001, "skew": 0.45, "ceiling": 0.5, "floor": 0.001, "fences": 0.3, "disagreement": 4.0, "range": 11.0, "drift": 0.01}


def oracle(limits: dict[str, float], weights: dict[str, float], earlier: dict[str, float]) -> str:
    """SQL for the diagnosis of ``scored``, some of whose values are left out."""
    at = {k: f"{v!r}::DOUBLE" for k, v in (LIMITS | limits).items()}
    names = list(weights)
    everything = [*names, "aggregate"]
    pick = lambda m, p: f"list_sort(list({m}) FILTER ({m} IS NOT NULL))[least(floor(count({m}) * {p} / 100)::BIGINT, count({m}) - 1) + 1]"
    stats = ", ".join(x for m in everything for x in (f"count({m}) AS n_{m}", f"avg({m}) AS m_{m}", f"stddev_pop({m}) AS s_{m}", f"min({m}) AS lo_{m}", f"max({m}) AS hi_{m}", *(f"{pick(m, p)} AS p{p}_{m}" for p in (25, 75, 90))))
    rank = lambda m: f"(rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0)::DOUBLE"
    rho = ", ".join(f"(SELECT corr(x, y) FROM (SELECT {rank(m)} AS x, {rank('aggregate')} AS y FROM base WHERE {m} IS NOT NULL)) AS rho_{m}" for m in names)
    pairs = ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a, b in combinations(sorted(names), 2))
    parts = []
    for m in names:
        w = f"{weights[m]!r}::DOUBLE"
        expected = f"CASE WHEN s_aggregate = 0 THEN {w} ELSE least(0.95, greatest(0, {w} * sqrt({len(names)}) * s_{m} / s_aggregate)) END"
        parts += [
            f"SELECT 'underutilized_signal' AS issue, '{m}' AS metric_key, NULL AS other, m_{m} AS value, n_{m} AS n FROM s, h WHERE m_{m} > {at['signal_mean']} AND {w} <= {at['signal_weight']} AND rho_{m} <= {at['dominant']}",
            f"SELECT 'dominant_correlation', '{m}', 'aggregate', rho_{m}, n_{m} FROM s, h WHERE rho_{m} > {at['dominant']} AND rho_{m} > {expected} + {at['dominant_excess']}",
            f"SELECT 'low_correlation_high_weight', '{m}', 'aggregate', rho_{m}, n_{m} FROM s, h WHERE {w} >= {at['low_weight']} AND abs(rho_{m}) < {at['low_correlation']}",
            f"SELECT 'score_ceiling', '{m}', NULL, p90_{m} / hi_{m}, n_{m} FROM s WHERE n_{m} >= 50 AND hi_{m} > 0 AND p90_{m} / hi_{m} > {at['ceiling']}",
            f"SELECT 'floor_clustering', '{m}', NULL, f / n_{m}, n_{m} FROM s, (SELECT count(*) FILTER ({m} <= lo_{m} + {at['floor_width']}) AS f FROM base, s) WHERE n_{m} >= 50 AND f / n_{m} > {at['floor']}",
        ]
        if m in earlier:
            parts.append(f"SELECT 'normalization_drift', '{m}', NULL, abs(p90_{m} - {earlier[m]!r}) / {earlier[m]!r}, n_{m} FROM s WHERE abs(p90_{m} - {earlier[m]!r}) / {earlier[m]!r} > {at['drift']}")
    for a, b in combinations(sorted(names), 2):
        less, more = (b, a) if weights[b] <= weights[a] else (a, b)
        parts.append(f"SELECT 'collinearity', '{less}', '{more}', r_{a}_{b}, (SELECT count(*) FROM base) FROM r WHERE r_{a}_{b} > {at['collinear']}")
    for m in everything:
        parts += [
            f"SELECT 'skewed_distribution', '{m}', NULL, (p75_{m} - p25_{m}) / (hi_{m} - lo_{m}), n_{m} FROM s WHERE n_{m} >= 50 AND hi_{m} > lo_{m} AND (p75_{m} - p25_{m}) / (hi_{m} - lo_{m}) < {at['skew']}",
            f"SELECT 'normalization_compressed', '{m}', NULL, hi_{m} - lo_{m}, n_{m} FROM s WHERE n_{m} >= 50 AND hi_{m} - lo_{m} < {at['range']}",
            f"SELECT 'missing_data', '{m}', NULL, (c - n_{m})::DOUBLE, c FROM s, (SELECT count(*) AS c FROM base) WHERE n_{m} < c",
        ]
    outside = f"aggregate < p25_aggregate - {at['fences']} * (p75_aggregate - p25_aggregate) OR aggregate > p75_aggregate + {at['fences']} * (p75_aggregate - p25_aggregate)"
    parts.append(f"SELECT 'score_outliers', 'aggregate', NULL, o::DOUBLE, n_aggregate FROM s, (SELECT count(*) FILTER ({outside}) AS o FROM base, s) WHERE o > 0 AND n_aggregate > 50")
    gaps = " UNION ALL ".join(f"SELECT '{m}' AS name, avg({m} - aesthetic) AS g, count(*) AS f FROM base WHERE abs(aesthetic - aggregate) > {at['disagreement']}" for m in names if m != "aesthetic")
    parts.append(f"SELECT 'metric_disagreement', 'aesthetic', arg_min(name, (-round(abs(g), 9), name)), max(f)::DOUBLE, (SELECT count(*) FROM base) FROM ({gaps}) HAVING max(f) > 0")
    parts.append(f"SELECT 'category_imbalance', category, NULL, a - mean, n FROM c, (SELECT sum(n * mean) / sum(n) AS a FROM c) WHERE a - mean > {at['imbalance']} OR mean - a > 1.5 * {at['imbalance']}")
    order = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())
    return f"""WITH base AS (SELECT * REPLACE (CASE WHEN path % 50 <> 0 THEN comp_score END AS comp_score) FROM scored), s AS (SELECT {stats} FROM base), h AS (SELECT {rho}), r AS (SELECT {pairs} FROM base),
        c AS (SELECT category, count(*) AS n, avg(aggregate) AS mean FROM base GROUP BY 1 HAVING count(*) > {at['category_rows']})
        SELECT issue, metric_key, other, round(value, 4) AS value, n::BIGINT AS n, CASE issue {order} END::INTEGER AS priority, CASE WHEN n >= 500 THEN 'high' WHEN n >= 100 THEN 'medium' ELSE 'low' END AS confidence FROM ({' UNION ALL '.join(parts)})"""


EARLIER = {"aesthetic": 6.0, "exposure": 9.0}


@query("g21_all_issues", oracle(SHOWN, {m: w / 100 for m, w in WEIGHTS["default"].items()}, EARLIER))
def _(v):
    rows = v.scored.withColumn("comp_score", F.when(F.col("path") % 50 != 0, F.col("comp_score")))
    found = diagnose(rows, earlier=EARLIER, **SHOWN)
    return found.withColumnRenamed("metric", "metric_key").withColumn("value", F.round("value", 4))


@query("g21_inflation", None)
def _(v):
    factors = inflation(moments(v.scored, list(METRICS)), list(METRICS))
    return v.metric.limit(1).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric_key"), F.lit(f).alias("factor")) for m, f in factors.items()])))
