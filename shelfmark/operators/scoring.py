"""Scoring, normalisation and calibration (group G), data quality (group H)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.functions.scalars import round_scaled
from shelfmark.operators.dashboards import pearson
from shelfmark.operators.order_stats import at_index, average_rank, quantiles, spearman, spearman_each, value_counts
from shelfmark.operators.predicates import first_failure, matches_rule
from shelfmark.registry import query
from shelfmark.runtime import shuffle_width, stash, sweep
from shelfmark.sources.views import METRICS

#: Category rules in priority order, and weights in percent for each category.
RULES = {"portrait": {"min_exposure": 6}, "sharp": {"min_tech_sharpness": 6}, "fine": {"min_aesthetic": 6}}
WEIGHTS = {
    "portrait": {"aesthetic": 30, "tech_sharpness": 20, "comp_score": 20, "exposure": 30},
    "sharp": {"aesthetic": 20, "tech_sharpness": 50, "comp_score": 15, "exposure": 15},
    "fine": {"aesthetic": 60, "tech_sharpness": 10, "comp_score": 20, "exposure": 10},
    "default": {"aesthetic": 40, "tech_sharpness": 25, "comp_score": 20, "exposure": 15},
}


def clamp(c: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def category_of(rules: dict[str, dict] = RULES, override: str | None = None) -> Column:
    """A known override, else the first rule that matches, else ``default``."""
    out = F.lit("default")
    for name, rule in reversed(rules.items()):
        out = F.when(matches_rule(rule), name).otherwise(out)
    return F.coalesce(F.when(F.col(override).isin(*rules, "default"), F.col(override)), out) if override else out


def normalise_weights(weights: dict[str, float], total: int = 100) -> dict[str, int]:
    """Whole weights with a given sum; the last one takes the remainder."""
    if not weights:
        return {}
    scale = total / sum(weights.values())
    names = list(weights)
    out = {n: round(weights[n] * scale) for n in names[:-1]}
    out[names[-1]] = total - sum(out.values())
    return out


def weighted(weights: dict[str, dict[str, float]], category: str = "kind") -> Column:
    """Sum of clamped metrics by the weights of the row's category; one expression, so it stays in the JVM."""
    out = F.lit(None).cast("double")
    for name, own in weights.items():
        share = sum(own.values())
        total = F.lit(0.0)
        for metric, weight in own.items():
            total = total + clamp(F.coalesce(F.col(metric), F.lit(0.0))) * F.lit(weight / share)
        out = F.when(F.col(category) == name, total).otherwise(out)
    return out


def penalties() -> Column:
    """Deductions for noise, for two far ends, and for too strong colour."""
    noise = F.when(F.col("tech_sharpness") < 3, (3 - F.col("tech_sharpness")) * 0.2).otherwise(0.0)
    ends = F.when((F.col("exposure") < 1) | (F.col("exposure") > 9), 0.5).otherwise(0.0)
    strong = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("comp_score") - 8) * 0.5)
    return noise + ends + strong


def score(df: DataFrame, rules: dict[str, dict] = RULES, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """``kind`` and ``score``: category, weighted sum, penalties, bounds."""
    return df.withColumn("kind", category_of(rules)).withColumn("score", clamp(weighted(weights) - penalties()))


#: What categories change in the steps after the weighted sum. Faces lose half for a blink, the default counts clipping one and a half times, silhouettes not at all, and night scenes no strong colour.
STEPS = {
    "blink": {"portrait": 0.5, "portrait_bw": 0.5, "group_portrait": 0.5}, "clipping": {"default": 1.5, "silhouette": 0.0}, "strong_colour": {"night": 0.0, "astro": 0.0, "concert": 0.0},
    "noise": {}, "bonus": {},
}


def _of_kind(values: dict[str, float], otherwise: float, kind: str = "kind") -> Column:
    out = F.lit(float(otherwise))
    for name, value in values.items():
        out = F.when(F.col(kind) == name, float(value)).otherwise(out)
    return out


def full_score(df: DataFrame, rules: dict[str, dict] = RULES, weights: dict[str, dict[str, float]] = WEIGHTS, steps: dict[str, dict[str, float]] = STEPS, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """``kind`` and ``score`` by all steps: weighted sum, blink multiplier, bonus, clipping, noise, far ends and strong colour, bounds.

    Reads ``is_blink``, ``is_silhouette``, ``shadow_clipped`` and ``highlight_clipped`` (nulls count as 0): clipped shadows cost half a point, clipped highlights one, silhouettes neither; one expression, so it stays in the JVM.
    """
    flag = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    kinds = df.withColumn("kind", category_of(rules))
    multiplied = weighted(weights) * F.when(flag("is_blink") > 0, _of_kind(steps.get("blink", {}), 1.0)).otherwise(1.0)
    clipped = F.when(flag("is_silhouette") > 0, 0.0).otherwise(flag("shadow_clipped") * 0.5 + flag("highlight_clipped"))
    noise = F.when(F.col("tech_sharpness") < 3, (3 - F.col("tech_sharpness")) * 0.2).otherwise(0.0)
    ends = F.when((F.col("exposure") < 1) | (F.col("exposure") > 9), 0.5).otherwise(0.0)
    strong = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("comp_score") - 8) * 0.5)
    total = multiplied + _of_kind(steps.get("bonus", {}), 0.0) - clipped * _of_kind(steps.get("clipping", {}), 1.0) - noise * _of_kind(steps.get("noise", {}), 1.0) - ends - strong * _of_kind(steps.get("strong_colour", {}), 1.0)
    return kinds.withColumn("score", clamp(total, low, high))


def index_percentile(df: DataFrame, metrics: tuple[str, ...], p: float, by: list[str] = [], least: int = 1) -> DataFrame:  # noqa: B006
    """The value at index ``min(int(n * p / 100), n - 1)`` of each sorted metric, exactly."""
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])))
    keys = [*by, "metric"]
    pick = F.least(F.floor(F.col("k_all") * p / 100), F.col("k_all") - 1)
    return at_index(value_counts(long, keys, "x"), keys, "x", {"value": pick}).where(F.col("n") >= least)


def normalised(raw: Column, own: Column, overall: Column) -> Column:
    """Raw over the category's percentile, else the overall one, times ten; without either the raw value."""
    base = F.coalesce(F.nullif(own, F.lit(0.0)), F.nullif(overall, F.lit(0.0)))
    return F.when(base.isNull(), raw).otherwise(clamp(raw / base * 10))


def candidates_near(best: np.ndarray, spread: float, count: int, rng: np.random.Generator) -> np.ndarray:
    """The best weights so far and others around them, each summing to 1."""
    tried = np.vstack([best, np.abs(best + spread * rng.normal(size=(count, len(best))) / 2) + 1e-9])
    return tried / tried.sum(axis=1, keepdims=True)


#: Ranges of sums in which a pass over the rows bounds all candidates; and the slack of a bound for rounding.
BINS, ROUNDING = (4096,), 1e-9
#: Rows that a task counts or sorts at once, and rows of one candidate that a task ranks.
COUNTED_ROWS, RANKED_ROWS = 1 << 17, 1 << 19


def ranked_target(df: DataFrame, target: str, metrics: tuple[str, ...]) -> DataFrame:
    """The metrics, nulls as 0, and ``_rt``, the rank of the target, of the rows that have one; written once for all rounds."""
    known = df.where(F.col(target).isNotNull()).select(F.col(target).alias("_t"), *[F.coalesce(F.col(m), F.lit(0.0)).cast("double").alias(m) for m in metrics])
    return stash(average_rank(stash(known), [], "_t", "_rt").drop("_t"))


def rank_ends(ranked: DataFrame, metrics: tuple[str, ...]) -> tuple[int, np.ndarray, float]:
    """The count of rows, each metric's least and largest value, and the squares of the target's ranks around their mean."""
    found = ranked.agg(F.count("*").alias("n"), F.sum("_rt").alias("s"), F.sum(F.col("_rt") * F.col("_rt")).alias("q"), *[f(m).alias(f"{k}_{m}") for m in metrics for k, f in (("lo", F.min), ("hi", F.max))]).first()
    n = found["n"]
    return n, np.array([[found[f"lo_{m}"], found[f"hi_{m}"]] for m in metrics], float), found["q"] - found["s"] * found["s"] / n if n else 0.0


def _blocks(batches, names: list[str]):
    """The columns of Arrow batches, many batches at a time: what a block costs whatever its rows is then shared by many rows."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        size += batch.num_rows
        if size >= COUNTED_ROWS:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _whole_sums(values: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Weighted sums in whole billionths, as doubles."""
    total = np.zeros(len(values[0]))
    for x, weight in zip(values, weights, strict=True):
        total += x * weight
    return np.floor(total * 1e9 + 0.5)


def _equal_together(sums: np.ndarray, n: np.ndarray | None, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each sum once, in order, with its count and the total of ``r``; all are whole numbers."""
    low, bits = int(sums.min()), len(sums).bit_length()
    if int(sums.max()) - low < 1 << 62 - bits:  # a sum and its place in one number: sorting these is faster than sorting places
        both = np.sort((sums - low << bits) | np.arange(len(sums)))
        sums, order = (both >> bits) + low, both & ((1 << bits) - 1)
    else:
        order = np.argsort(sums)
        sums = sums[order]
    first = np.flatnonzero(np.concatenate([[True], sums[1:] != sums[:-1]]))
    if len(first) == len(sums):
        return sums, np.ones(len(sums), np.int64) if n is None else n[order], r[order]
    return sums[first], np.diff(first, append=len(sums)) if n is None else np.add.reduceat(n[order], first), np.add.reduceat(r[order], first)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes each, if they fit."""
    return x.astype(np.int32) if abs(int(x.min())) < 1 << 31 and abs(int(x.max())) < 1 << 31 else x


def rank_correlations(ranked: DataFrame, metrics: tuple[str, ...], tried: np.ndarray, ends: tuple[int, np.ndarray, float] | None = None, ranked_rows: int = RANKED_ROWS) -> list[float]:
    """The rank correlation of each candidate's weighted sum, in whole billionths, with the target's ranks.

    Tasks sort each candidate's sums of a block, with equal ones together, and deal them as packed numbers (steps from sum to sum, and ranks) to ranges of sums; a range is ranked by itself, and the driver adds up what the ranges, a row each,
    leave to the ranks before them. Which range a sum falls into comes from a sample, and changes no rank.
    """
    rows, _, squares = ends or rank_ends(ranked, metrics)
    if not rows:
        return [-2.0] * len(tried)
    middle, names, parts = (rows + 1) / 2, [*metrics, "_rt"], -(-rows // ranked_rows)
    splits = np.zeros((len(tried), 0))
    if parts > 1:
        some = ranked.select(*metrics).sample(min(1.0, max(2000, 200 * parts) / rows), 1).toPandas()
        splits = np.array([np.quantile(_whole_sums([some[m].to_numpy() for m in metrics], w), np.arange(1, parts) / parts) if len(some) else np.zeros(parts - 1) for w in tried])

    def packed(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

    def deal(batches):
        for *values, rank in _blocks(batches, names):
            twice = (2 * (rank - middle)).astype(np.int64)
            for k, weights in enumerate(tried):
                sums, n, r = _equal_together(_whole_sums(values, weights).astype(np.int64), None, twice)
                cuts = np.concatenate([[0], np.searchsorted(sums, splits[k]), [len(sums)]])
                steps = np.diff(sums, prepend=sums[0])
                steps[cuts[:-1][cuts[:-1] < len(sums)]] = 0
                columns = {"tried": np.full(parts, k), "part": np.arange(parts), "size": np.diff(cuts), "low": sums[np.minimum(cuts[:-1], len(sums) - 1)]}
                lists = [packed(_narrow(steps), cuts), packed(_narrow(r), cuts), packed(_narrow(n), cuts) if len(n) < len(rank) else pa.nulls(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), *lists], names=[*columns, "steps", "r", "n"])

    def numbers(raw: bytes | None, size: int) -> np.ndarray:
        return np.ones(size, np.int64) if raw is None else np.frombuffer(raw, np.int32 if len(raw) == 4 * size else np.int64).astype(np.int64)

    def place(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sums, r = (np.concatenate(c) for c in zip(*[(row["low"] + np.cumsum(numbers(row["steps"], row["size"])), numbers(row["r"], row["size"])) for row in rows], strict=True))
        n = np.concatenate([numbers(row["n"], row["size"]) for row in rows]) if any(row["n"] is not None for row in rows) else None
        sums, n, r = _equal_together(sums, n, r)
        rank = np.cumsum(n) - n + (n + 1) / 2 - (n.sum() + 1) / 2
        r = r / 2
        return pa.Table.from_pylist([{"tried": rows[0]["tried"], "part": rows[0]["part"], "n": int(n.sum()), "xx": float((n * rank * rank).sum()), "xy": float((rank * r).sum()), "y": float(r.sum())}])

    pieces = ranked.select(*names).mapInArrow(deal, "tried long, part long, size long, low long, steps binary, r binary, n binary").where("size > 0")
    dealt = pieces.repartition(max(1, min(len(tried) * parts, max(shuffle_width(ranked.sparkSession), len(tried) * parts // 16))), "tried", "part")
    found = dealt.groupBy("tried", "part").applyInArrow(place, "tried long, part long, n long, xx double, xy double, y double").toPandas()  # candidates x ranges rows
    out = []
    for k in range(len(tried)):
        of = found[found["tried"] == k].sort_values("part")
        n = of["n"].to_numpy(float)
        before = np.cumsum(n) - n + (n + 1) / 2 - middle
        xx, xy = float((of["xx"] + n * before * before).sum()), float((of["xy"] + before * of["y"]).sum())
        out.append(xy / (np.sqrt(xx) * np.sqrt(squares)) if xx > 0 and squares > 0 else -2.0)
    return out


def rank_bounds(ranked: DataFrame, metrics: tuple[str, ...], tried: np.ndarray, bins: int, ends: tuple[int, np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A lower and an upper bound of each candidate's rank correlation, from one pass that counts sums in ``bins`` ranges.

    A range's mean rank is exact, as equal sums lie in one range. What ranks do within a range is bounded by the spread of its ranks on both sides (Cauchy-Schwarz).
    """
    rows, edges, _ = ends or rank_ends(ranked, metrics)
    if not rows:
        return np.full(len(tried), -2.0), np.full(len(tried), 1.0)
    middle, names = (rows + 1) / 2, [*metrics, "_rt"]
    reach = tried[:, :, None] * edges[None]
    low = np.floor(reach.min(axis=2).sum(axis=1) * 1e9) - 1
    width = np.maximum(np.ceil(reach.max(axis=2).sum(axis=1) * 1e9) + 2 - low, bins) / bins

    def count(batches):
        n, s, q = (np.zeros((len(tried), bins)) for _ in range(3))
        for *values, rank in _blocks(batches, names):  # counting touches all ranges of a candidate
            rank = rank - middle
            square = rank * rank
            for k, weights in enumerate(tried):
                at = np.clip((_whole_sums(values, weights) - low[k]) / width[k], 0, bins - 1).astype(np.int64)
                for into, weight in ((n, None), (s, rank), (q, square)):
                    into[k] += np.bincount(at, weight, bins)
        cell = np.flatnonzero(n)
        for at in range(0, len(cell), COUNTED_ROWS):
            some = cell[at : at + COUNTED_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n.ravel()[some], s.ravel()[some], q.ravel()[some])], names=["cell", "n", "s", "q"])

    cells = ranked.select(*names).mapInArrow(count, "cell long, n double, s double, q double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).toPandas()  # candidates x bins rows
    n, s, q = (np.zeros(len(tried) * bins) for _ in range(3))
    for into, name in ((n, "n"), (s, "s"), (q, "q")):
        into[cells["cell"].to_numpy()] = cells[name].to_numpy()
    n, s, q = (x.reshape(len(tried), bins) for x in (n, s, q))
    rank = np.cumsum(n, axis=1) - n + (n + 1) / 2 - middle
    spread = n * (n * n - 1) / 12 * (n > 0)
    least, cover = (n * rank * rank).sum(axis=1), (rank * s).sum(axis=1)
    loose = np.sqrt(spread * np.maximum(0, q - s * s / np.maximum(n, 1))).sum(axis=1)
    size = np.sqrt(q.sum(axis=1))
    small, large = np.sqrt(least) * size, np.sqrt(least + spread.sum(axis=1)) * size
    with np.errstate(divide="ignore", invalid="ignore"):
        lower = np.where(cover >= loose, (cover - loose) / large, (cover - loose) / small)
        upper = np.where(cover + loose >= 0, (cover + loose) / small, (cover + loose) / large)
    known = (least > 0) & (size > 0)
    return np.where(known, lower - ROUNDING, -2.0), np.where(known, upper + ROUNDING, 1.0)


def best_candidate(ranked: DataFrame, metrics: tuple[str, ...], tried: np.ndarray, bins: tuple[int, ...] = BINS, ends: tuple[int, np.ndarray, float] | None = None) -> int:
    """The first candidate of largest rank correlation. Passes that bound all correlations leave those that can be it, and if more than one is left these are ranked."""
    left = np.arange(len(tried))
    ends = ends or rank_ends(ranked, metrics)
    for count in bins:
        lower, upper = rank_bounds(ranked, metrics, tried[left], count, ends)
        left = left[upper >= lower.max()]
        if len(left) == 1:
            return int(left[0])
    return int(left[np.argmax(np.round(rank_correlations(ranked, metrics, tried[left], ends), 12))])


def fit_weights(df: DataFrame, target: str, metrics: tuple[str, ...] = METRICS, candidates: int = 24, rounds: int = 3, seed: int = 3) -> dict[str, float]:
    """Weights on the simplex of largest rank correlation with the target; each round judges all its candidates in one pass and narrows around the best, the first of equals."""
    rng = np.random.default_rng(seed)
    best, spread = np.full(len(metrics), 1 / len(metrics)), 1.0
    ranked = ranked_target(df, target, metrics)
    ends = rank_ends(ranked, metrics)
    for _ in range(rounds):
        tried = candidates_near(best, spread, candidates, rng)
        best, spread = tried[best_candidate(ranked, metrics, tried, ends=ends)], spread / 2
        sweep(df.sparkSession)  # a round's shuffle files go before the next one's come
    return dict(zip(metrics, best.tolist(), strict=True))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 for each class."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = cells.where("t = p").select(F.col("t").alias("label"), F.col("n").alias("hits"))
    rows = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("actual"))
    cols = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("claimed"))
    out = rows.join(cols, "label", "full").join(hit, "label", "left").fillna(0)
    precision, recall = F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "actual"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select("label", "actual", "claimed", "hits", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def violations(df: DataFrame, rules: dict[str, Column], key: str = "path") -> DataFrame:
    """Rows ``rule, path`` of all rows that break a rule; a rule is the condition of a fault."""
    faults = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(faults).alias("rule"), F.col(key).alias("path"))


def outliers(df: DataFrame, metrics: tuple[str, ...] = METRICS, sigmas: float = 3.0, key: str = "path") -> DataFrame:
    """Values outside mean and ``sigmas`` population deviations; constant metrics have none."""
    long = df.select(F.col(key), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics]))).where("x is not null")
    stats = long.groupBy("metric").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.join(F.broadcast(stats), "metric").where((F.col("s") > 0) & (F.abs(F.col("x") - F.col("m")) > sigmas * F.col("s"))).select("metric", key)


def issues(df: DataFrame, weights: dict[str, float] = WEIGHTS["default"], target: str = "aggregate") -> DataFrame:
    """Scoring diagnostics over all metrics in one pass: rows ``issue, metric, value``."""
    stats = df.agg(
        F.count("*").alias("n"),
        *[x for m in weights for x in (F.avg(m).alias(f"m_{m}"), F.stddev_pop(m).alias(f"s_{m}"), F.skewness(m).alias(f"k_{m}"), pearson(F.col(m), F.col(target)).alias(f"r_{m}"),
          F.avg(F.when(F.col(m) >= 9.5, 1.0).otherwise(0.0)).alias(f"c_{m}"), F.avg(F.when(F.col(m) <= 0.5, 1.0).otherwise(0.0)).alias(f"f_{m}"), F.avg(F.when(F.col(m).isNull(), 1.0).otherwise(0.0)).alias(f"z_{m}"))],
    )
    total = sum(weights.values())
    rows = []
    for m, w in weights.items():
        tests = {
            "low_correlation_high_weight": (F.abs(f"r_{m}") < 0.1, f"r_{m}", w / total >= 0.25), "underused": (F.abs(f"r_{m}") > 0.5, f"r_{m}", w / total < 0.2), "ceiling": (F.col(f"c_{m}") > 0.02, f"c_{m}", True),
            "floor": (F.col(f"f_{m}") > 0.02, f"f_{m}", True), "skew": (F.abs(f"k_{m}") > 0.4, f"k_{m}", True), "missing": (F.col(f"z_{m}") > 0.05, f"z_{m}", True), "compressed": (F.col(f"s_{m}") < 1.2, f"s_{m}", True),
        }
        rows += [F.struct(F.lit(name).alias("issue"), F.lit(m).alias("metric"), F.when(test & F.lit(applies), F.round(value, 3)).alias("value")) for name, (test, value, applies) in tests.items()]
    return stats.select(F.inline(F.array(*rows))).where("value is not null")


def damped(current: Column, proposed: Column, step: float = 3.0) -> Column:
    return F.least(current + step, F.greatest(current - step, proposed))


ORACLE_KIND = "CASE WHEN exposure >= 6 THEN 'portrait' WHEN tech_sharpness >= 6 THEN 'sharp' WHEN aesthetic >= 6 THEN 'fine' ELSE 'default' END"
ORACLE_PENALTY = "(CASE WHEN tech_sharpness < 3 THEN (3 - tech_sharpness) * 0.2 ELSE 0 END + CASE WHEN exposure < 1 OR exposure > 9 THEN 0.5 ELSE 0 END + least(1.0, greatest(0.0, comp_score - 8) * 0.5))"
ORACLE_WEIGHTED = "CASE kind " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"{m} * {w / 100}" for m, w in own.items()) for k, own in WEIGHTS.items()) + " END"
ORACLE_SCORED = f"SELECT *, greatest(0, least(10, {ORACLE_WEIGHTED} - {ORACLE_PENALTY})) AS score FROM (SELECT *, {ORACLE_KIND} AS kind FROM scored)"


@query("flagship_scored_categories", f"SELECT kind, count(*)::BIGINT AS n, round(avg(score), 3) AS mean, round(max(score), 3) AS best, round(avg(aesthetic), 3) AS aesthetic FROM ({ORACLE_SCORED}) GROUP BY 1")
def _(v):
    return score(v.scored).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"), F.round(F.max("score"), 3).alias("best"), F.round(F.avg("aesthetic"), 3).alias("aesthetic"))


@query("g1_category_assignment", f"SELECT path, CASE WHEN status = 'F' THEN 'fine' ELSE {ORACLE_KIND} END AS kind FROM scored")
def _(v):
    return v.scored.withColumn("forced", F.when(F.col("status") == "F", "fine").when(F.col("status") == "P", "unknown")).select("path", category_of(override="forced").alias("kind"))


@query("g2_metric_vector", "SELECT path, round(least(10, aesthetic), 3) || ';' || round(CASE WHEN camera = 'BUILDING' THEN 5.0 ELSE comp_score END, 3) AS vector FROM scored")
def _(v):
    mono = F.when(F.col("camera") == "BUILDING", 5.0).otherwise(F.col("comp_score"))
    return v.scored.select("path", F.concat_ws(";", round_scaled(clamp(F.col("aesthetic")), 3).cast("string"), round_scaled(mono, 3).cast("string")).alias("vector"))


@query("g3_penalties", f"SELECT path, round({ORACLE_PENALTY}, 4) AS penalty FROM metric")
def _(v):
    return v.metric.select("path", F.round(penalties(), 4).alias("penalty"))


@query("g4_aggregate", f"SELECT path, kind, round(score, 9) AS score FROM ({ORACLE_SCORED})")
def _(v):
    return score(v.scored).select("path", "kind", F.round("score", 9).alias("score"))


FLAGS = {"is_blink": (11, 3), "shadow_clipped": (5, 2), "highlight_clipped": (7, 3), "is_silhouette": (13, 2)}
OWN_STEPS = STEPS | {"bonus": {"fine": 0.3}, "noise": {"sharp": 0.5}}


@query("g4_all_steps", f"""WITH f AS (SELECT *, {ORACLE_KIND} AS kind, {", ".join(f"(path % {a} < {b})::INTEGER AS {name}" for name, (a, b) in FLAGS.items())} FROM scored)
  SELECT path, kind, round(greatest(0, least(10, ({ORACLE_WEIGHTED}) * CASE WHEN is_blink = 1 AND kind = 'portrait' THEN 0.5 ELSE 1 END + CASE WHEN kind = 'fine' THEN 0.3 ELSE 0 END
  - CASE WHEN is_silhouette = 1 THEN 0 ELSE shadow_clipped * 0.5 + highlight_clipped END * CASE WHEN kind = 'default' THEN 1.5 ELSE 1 END
  - CASE WHEN tech_sharpness < 3 THEN (3 - tech_sharpness) * 0.2 ELSE 0 END * CASE WHEN kind = 'sharp' THEN 0.5 ELSE 1 END - CASE WHEN exposure < 1 OR exposure > 9 THEN 0.5 ELSE 0 END - least(1.0, greatest(0.0, comp_score - 8) * 0.5))), 9) AS score FROM f""")
def _(v):
    rows = v.scored.withColumns({name: (F.col("path") % a < b).cast("int") for name, (a, b) in FLAGS.items()})
    return full_score(rows, steps=OWN_STEPS).select("path", "kind", F.round("score", 9).alias("score"))


@query("g5_weight_table", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{m}', {w / 100}::DOUBLE)" for k, own in WEIGHTS.items() for m, w in own.items()) + ") t(kind, metric, weight) WHERE kind IN (SELECT kind FROM (SELECT " + ORACLE_KIND + " AS kind FROM metric))")
def _(v):
    weights = v.spark.createDataFrame([(k, m, w / sum(own.values())) for k, own in WEIGHTS.items() for m, w in own.items()], "kind string, metric string, weight double")
    return weights.join(v.metric.select(category_of().alias("kind")).distinct(), "kind", "left_semi")


@query("g6_whole_weights", """WITH c AS (SELECT category, count(*) AS n FROM item GROUP BY 1), r AS (SELECT category, round(n * (100.0::DOUBLE / sum(n) OVER ()))::BIGINT AS w, row_number() OVER (ORDER BY category DESC) AS k FROM c)
  SELECT category, CASE WHEN k = 1 THEN 100 - (sum(w) FILTER (k > 1) OVER ())::BIGINT ELSE w END AS weight FROM r""")
def _(v):
    counts = v.item.groupBy("category").agg(F.count("*").alias("n"))  # a row a category reaches the driver
    whole = normalise_weights({r["category"]: r["n"] for r in sorted(counts.collect(), key=lambda r: r["category"])})
    return v.item.select("category").distinct().select("category", F.element_at(F.create_map(*[F.lit(x) for pair in whole.items() for x in pair]), F.col("category")).cast("bigint").alias("weight"))


@query("g7_bulk_rescore", f"SELECT path, round(CASE WHEN kind = 'sharp' THEN score ELSE aggregate END, 9) AS aggregate FROM ({ORACLE_SCORED})")
def _(v):
    return score(v.scored).select("path", F.round(F.when(F.col("kind") == "sharp", F.col("score")).otherwise(F.col("aggregate")), 9).alias("aggregate"))


LONG = "SELECT path, unnest(['aesthetic', 'tech_sharpness', 'comp_score', 'exposure']) AS metric_name, unnest([aesthetic, tech_sharpness, comp_score, exposure]) AS x FROM metric"
PICK = "list_sort(list(x))[least(floor(count(*) * 90 / 100)::BIGINT, count(*) - 1) + 1]"


@query("g8_percentiles", f"SELECT metric_name AS metric_key, round({PICK}, 5) AS value, count(*)::BIGINT AS n FROM ({LONG}) GROUP BY 1")
def _(v):
    return index_percentile(v.metric, METRICS, 90).select(F.col("metric").alias("metric_key"), F.round("value", 5).alias("value"), "n")


@query("g9_percentiles_by_category", f"SELECT category, metric_name AS metric_key, round({PICK}, 5) AS value FROM ({LONG}) l JOIN item ON item.path = l.path GROUP BY 1, 2 HAVING count(*) >= 50")
def _(v):
    return index_percentile(v.scored, METRICS, 90, ["category"], 50).select("category", F.col("metric").alias("metric_key"), F.round("value", 5).alias("value"))


@query("g10_normalise", "WITH p AS (SELECT category, list_sort(list(aesthetic))[least(floor(count(*) * 0.9)::BIGINT, count(*) - 1) + 1] AS v FROM scored GROUP BY 1) SELECT path, round(least(10, aesthetic / v * 10), 4) AS x FROM scored JOIN p ON p.category = scored.category")
def _(v):
    own = index_percentile(v.scored, ("aesthetic",), 90, ["category"], 50).select("category", F.col("value").alias("own"))
    overall = index_percentile(v.scored, ("aesthetic",), 90).select(F.col("value").alias("overall"))
    rows = v.scored.join(F.broadcast(own), "category", "left").join(F.broadcast(overall))
    return rows.select("path", F.round(normalised(F.col("aesthetic"), F.col("own"), F.col("overall")), 4).alias("x"))


@query("g11_percentile_drift", f"WITH a AS (SELECT metric_name, {PICK} AS v FROM ({LONG}) WHERE path % 2 = 0 GROUP BY 1), b AS (SELECT metric_name, {PICK} AS v FROM ({LONG}) GROUP BY 1) SELECT a.metric_name AS metric_key, round(abs(b.v - a.v) / a.v, 4) AS drift, abs(b.v - a.v) / a.v > 0.1 AS stale FROM a JOIN b ON a.metric_name = b.metric_name")
def _(v):
    old = index_percentile(v.metric.where("path % 2 = 0"), METRICS, 90).select("metric", F.col("value").alias("old"))
    drift = F.try_divide(F.abs(F.col("value") - F.col("old")), F.col("old"))
    return index_percentile(v.metric, METRICS, 90).join(old, "metric").select(F.col("metric").alias("metric_key"), F.round(drift, 4).alias("drift"), (drift > 0.1).alias("stale"))


@query("g12_pearson", "SELECT category, round(corr(aesthetic, exposure), 4) AS r FROM scored GROUP BY 1 HAVING count(*) >= 10")
def _(v):
    return v.scored.groupBy("category").agg(F.count("*").alias("n"), F.round(pearson(F.col("aesthetic"), F.col("exposure")), 4).alias("r")).where("n >= 10").drop("n")


RANKS = "(rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2.0)::DOUBLE"


@query("g13_spearman", f"SELECT lang, round(corr(rx, ry), 4) AS rho FROM (SELECT lang, {RANKS.format(p='lang', x='n_chars')} AS rx, {RANKS.format(p='lang', x='quality')} AS ry FROM label) GROUP BY 1")
def _(v):
    return spearman(v.label, ["lang"], "n_chars", "quality").select("lang", F.round("rho", 4).alias("rho"))


@query("g14_metric_srcc", f"SELECT m AS metric_key, round(corr(rx, ry), 4) AS rho FROM (SELECT m, {RANKS.format(p='m', x='x')} AS rx, {RANKS.format(p='m', x='aggregate')} AS ry FROM (SELECT metric_name AS m, x, aggregate FROM ({LONG}) l JOIN item ON item.path = l.path)) GROUP BY 1")
def _(v):
    return spearman_each(v.scored, METRICS, "aggregate").select(F.col("name").alias("metric_key"), F.round("rho", 4).alias("rho"))


@query("g15_baseline_table", "SELECT category, round(corr(aesthetic, aggregate), 4) AS plcc, round(avg(abs(aesthetic - aggregate)), 4) AS mae FROM scored GROUP BY 1")
def _(v):
    return v.scored.groupBy("category").agg(F.round(pearson(F.col("aesthetic"), F.col("aggregate")), 4).alias("plcc"), F.round(F.avg(F.abs(F.col("aesthetic") - F.col("aggregate"))), 4).alias("mae"))


@query("g16_confusion", """WITH c AS (SELECT quality AS t, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM label), k AS (SELECT unnest([0, 1]) AS label_value)
  SELECT label_value AS label_key, actual, claimed, hits, round(hits / claimed, 4) AS prec, round(hits / actual, 4) AS recall FROM (SELECT label_value, count(*) FILTER (t = label_value)::BIGINT AS actual, count(*) FILTER (p = label_value)::BIGINT AS claimed, count(*) FILTER (t = label_value AND p = label_value)::BIGINT AS hits FROM c, k GROUP BY 1)""")
def _(v):
    rows = v.label.select(F.col("quality").cast("int").alias("t"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("p"))
    return classification_report(rows, "t", "p").select(F.col("label").alias("label_key"), "actual", "claimed", "hits", F.col("precision").alias("prec"), "recall")


@query("g17_priority_conflicts", f"SELECT least(kind, camera) AS a, greatest(kind, camera) AS b, count(*)::BIGINT AS n FROM (SELECT {ORACLE_KIND} AS kind, lower(camera) AS camera FROM scored) GROUP BY 1, 2")
def _(v):
    rows = v.scored.select(category_of().alias("kind"), F.lower("camera").alias("camera"))
    return rows.groupBy(F.least("kind", "camera").alias("a"), F.greatest("kind", "camera").alias("b")).agg(F.count("*").alias("n"))


@query("g18_boundaries", "SELECT quality = (n_chars > 1000)::INTEGER AS correct, count(*)::BIGINT AS n, round(quantile_cont(n_chars::DOUBLE, 0.1), 2) AS p10, round(quantile_cont(n_chars::DOUBLE, 0.9), 2) AS p90 FROM label GROUP BY 1")
def _(v):
    correct = F.col("quality") == (F.col("n_chars") > 1000).cast("int")
    q = quantiles(v.label.withColumn("correct", correct), ["correct"], "n_chars", [0.1, 0.9])
    return q.select("correct", "n", F.round(F.col("q")[0], 2).alias("p10"), F.round(F.col("q")[1], 2).alias("p90"))


@query("g19_weight_fit")
def _(v):
    found = fit_weights(v.scored, "aggregate")
    return v.metric.limit(1).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("weight")) for m, w in found.items()])))


@query("g20_modifier_fit")
def _(v):
    """For each category the factor among a few that brings its mean score nearest to its mean rating."""
    rows = score(v.scored).select("category", "score", "aggregate", F.explode(F.array(*[F.lit(x / 10) for x in range(5, 16)])).alias("factor"))
    fit = rows.groupBy("category", "factor").agg(F.avg(F.pow(F.col("score") * F.col("factor") - F.col("aggregate"), 2)).alias("error"))
    return fit.groupBy("category").agg(F.min_by("factor", F.struct("error", "factor")).alias("factor"))


@query("g21_diagnostics", "WITH s AS (SELECT round(skewness(aesthetic), 3) AS k, stddev_pop(aesthetic) AS d, corr(aesthetic, aggregate) AS r FROM scored) SELECT 'low_correlation_high_weight' AS issue, 'aesthetic' AS metric_key, round(r, 3) AS value FROM s WHERE abs(r) < 0.1 UNION ALL SELECT 'compressed', 'aesthetic', round(d, 3) FROM s WHERE d < 1.2")
def _(v):
    return issues(v.scored).where("metric = 'aesthetic' and issue in ('low_correlation_high_weight', 'compressed')").withColumnRenamed("metric", "metric_key")


@query("g22_oscillation", "SELECT camera AS target, path, abs(ev - prev) <= 1 AS back, least(ev_now + 3, greatest(ev_now - 3, ev)) AS damped FROM (SELECT camera, path, ev, lag(ev, 2) OVER (PARTITION BY camera ORDER BY captured_at, path) AS prev, lag(ev) OVER (PARTITION BY camera ORDER BY captured_at, path) AS ev_now FROM shot) WHERE prev IS NOT NULL")
def _(v):
    w = W.partitionBy("camera").orderBy("captured_at", "path")
    rows = v.shot.withColumn("prev", F.lag("ev", 2).over(w)).withColumn("now", F.lag("ev").over(w)).where("prev is not null")
    return rows.select(F.col("camera").alias("target"), "path", (F.abs(F.col("ev") - F.col("prev")) <= 1).alias("back"), damped(F.col("now"), F.col("ev"), 3).cast("int").alias("damped"))


@query("g23_simulation", f"SELECT kind, round(avg(score), 3) AS before, round(avg(least(10, score * 1.1)), 3) AS after FROM ({ORACLE_SCORED}) GROUP BY 1")
def _(v):
    return score(v.scored).groupBy("kind").agg(F.round(F.avg("score"), 3).alias("before"), F.round(F.avg(F.least(F.lit(10.0), F.col("score") * 1.1)), 3).alias("after"))


@query("g24_critique", f"SELECT path, metric_name AS best, round(x, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY x DESC, metric_name) AS rn FROM ({LONG})) WHERE rn = 1")
def _(v):
    parts = F.array(*[F.struct(F.col(m).alias("x"), F.lit(m).alias("metric")) for m in METRICS])
    ranked = F.array_sort(F.transform(parts, lambda s: F.struct((-s["x"]).alias("minus"), s["metric"].alias("metric"))))
    return v.metric.select("path", ranked[0]["metric"].alias("best"), F.round(-ranked[0]["minus"], 4).alias("value"))


@query("g25_category_trail", "SELECT path, concat_ws(',', CASE WHEN NOT exposure >= 6 THEN 'portrait:min_exposure' ELSE 'portrait:ok' END, CASE WHEN NOT tech_sharpness >= 6 THEN 'sharp:min_tech_sharpness' ELSE 'sharp:ok' END, CASE WHEN NOT aesthetic >= 6 THEN 'fine:min_aesthetic' ELSE 'fine:ok' END) AS trail FROM metric")
def _(v):
    return v.metric.select("path", F.concat_ws(",", *[F.concat(F.lit(f"{n}:"), F.coalesce(first_failure(r), F.lit("ok"))) for n, r in RULES.items()]).alias("trail"))


@query("g26_axis_score", "SELECT a.vec_id, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) * 5, 4) AS score FROM vec a, (SELECT embedding FROM vec WHERE vec_id = 0) b")
def _(v):
    from shelfmark.functions.scalars import cosine

    axis = F.broadcast(v.vec.where("vec_id = 0").select(F.col("embedding").alias("axis")))
    return v.vec.join(axis).select("vec_id", F.round((cosine("embedding", "axis") + 1) * 5, 4).alias("score"))


@query("g27_derived_flags", "SELECT path, n_parts >= 4 AND exposure < 5 AS is_group, exposure < 2 AND aesthetic > 5 AS is_silhouette FROM metric")
def _(v):
    return v.metric.select("path", ((F.col("n_parts") >= 4) & (F.col("exposure") < 5)).alias("is_group"), ((F.col("exposure") < 2) & (F.col("aesthetic") > 5)).alias("is_silhouette"))


@query("h1_score_ranges", "SELECT rule, path FROM (SELECT path, unnest(list_filter([CASE WHEN aesthetic NOT BETWEEN 0 AND 9.5 THEN 'aesthetic' END, CASE WHEN exposure < 0.2 THEN 'exposure' END], lambda x: x IS NOT NULL)) AS rule FROM metric)")
def _(v):
    return violations(v.metric, {"aesthetic": ~F.col("aesthetic").between(0, 9.5), "exposure": F.col("exposure") < 0.2})


@query("h2_face_consistency", "SELECT rule, path FROM (SELECT path, unnest(list_filter([CASE WHEN n_parts = 1 AND exposure > 8 THEN 'ratio' END, CASE WHEN n_parts > 8 AND comp_score < 2 THEN 'count' END], lambda x: x IS NOT NULL)) AS rule FROM metric)")
def _(v):
    return violations(v.metric, {"ratio": (F.col("n_parts") == 1) & (F.col("exposure") > 8), "count": (F.col("n_parts") > 8) & (F.col("comp_score") < 2)})


@query("h3_type_corruption", "SELECT path FROM (SELECT path, CASE WHEN path % 97 = 0 THEN 'x' ELSE ev::VARCHAR END AS raw FROM shot) WHERE raw IS NOT NULL AND try_cast(raw AS DOUBLE) IS NULL")
def _(v):
    raw = v.shot.select("path", F.when(F.col("path") % 97 == 0, "x").otherwise(F.col("ev").cast("string")).alias("raw"))
    return raw.where(F.col("raw").isNotNull() & F.col("raw").try_cast("double").isNull()).select("path")


@query("h4_histogram_integrity", "SELECT path FROM metric WHERE greatest(aesthetic, exposure) - least(aesthetic, exposure) < 0.05")
def _(v):
    h = F.array("aesthetic", "exposure")
    return v.metric.where((F.size(h) == 2) & (F.array_max(h) - F.array_min(h) < 0.05)).select("path")


@query("h5_embedding_integrity", "SELECT count(*) FILTER (embedding IS NULL)::BIGINT AS missing, count(*) FILTER (len(embedding) <> 64)::BIGINT AS odd, count(*)::BIGINT AS n FROM vec")
def _(v):
    usual = F.broadcast(v.vec.agg(F.mode(F.size("embedding")).alias("usual")))
    return v.vec.join(usual).agg(F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.size("embedding") != F.col("usual")).alias("odd"), F.count("*").alias("n"))


@query("h6_boolean_flags", "SELECT path FROM (SELECT path, ev % 4 AS flag FROM shot) WHERE flag NOT IN (0, 1)")
def _(v):
    return v.shot.where(~(F.col("ev") % 4).isin(0, 1)).select("path")


@query("h7_referential", "SELECT 'orphan' AS fault, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0) UNION ALL SELECT 'empty', count(*)::BIGINT FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(v):
    owners = v.table("orders").where("o_orderkey % 50 <> 0")
    orphan = v.table("lineitem").join(owners, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    empty = v.table("orders").join(v.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return orphan.agg(F.lit("orphan").alias("fault"), F.count("*").alias("n")).unionByName(empty.agg(F.lit("empty").alias("fault"), F.count("*").alias("n")))


@query("h8_outliers", f"SELECT metric_name AS metric_key, path FROM (SELECT *, avg(x) OVER (PARTITION BY metric_name) AS m, stddev_pop(x) OVER (PARTITION BY metric_name) AS s FROM ({LONG})) WHERE abs(x - m) > 2.5 * s")
def _(v):
    return outliers(v.metric, sigmas=2.5).withColumnRenamed("metric", "metric_key")


@query("h9_vocabulary", "SELECT path, camera FROM item WHERE camera NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') OR (camera = 'BUILDING' AND aggregate >= 9)")
def _(v):
    return v.item.where(~F.col("camera").isin("BUILDING", "MACHINERY", "FURNITURE") | ((F.col("camera") == "BUILDING") & (F.col("aggregate") >= 9))).select("path", "camera")


@query("h10_report", "SELECT rule, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([CASE WHEN aesthetic > 9 THEN 'high' END, CASE WHEN exposure < 0.5 THEN 'dark' END, CASE WHEN comp_score < 1 THEN 'flat' END], lambda x: x IS NOT NULL)) AS rule FROM metric) GROUP BY 1")
def _(v):
    return violations(v.metric, {"high": F.col("aesthetic") > 9, "dark": F.col("exposure") < 0.5, "flat": F.col("comp_score") < 1}).groupBy("rule").agg(F.count("*").alias("n"))


def cleanup_plan(gone: DataFrame, total: DataFrame, children: dict[str, DataFrame], key: str = "path") -> DataFrame:
    """Rows ``child, n`` to delete with the gone items; refuses to delete everything."""
    refused = F.broadcast(total.agg(F.count("*").alias("_all")).join(gone.agg(F.count("*").alias("_gone"))).where("_gone < _all"))
    out = None
    for name, child in children.items():
        part = child.join(gone, key, "left_semi").join(refused).agg(F.lit(name).alias("child"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("h11_cleanup_plan", "SELECT 'tags' AS child, count(*)::BIGINT AS n FROM item_tag WHERE path IN (SELECT path FROM item WHERE status = 'P') UNION ALL SELECT 'metrics', count(*)::BIGINT FROM metric WHERE path IN (SELECT path FROM item WHERE status = 'P')")
def _(v):
    return cleanup_plan(v.item.where("status = 'P'").select("path"), v.item, {"tags": v.item_tag, "metrics": v.metric})


@query("h12_orphan_persons", "SELECT s_suppkey AS person FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 7 <> 0)")
def _(v):
    return v.table("supplier").select(F.col("s_suppkey").alias("person")).join(v.table("lineitem").where("l_suppkey % 7 <> 0").select(F.col("l_suppkey").alias("person")), "person", "left_anti")
