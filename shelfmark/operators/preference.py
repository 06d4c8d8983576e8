"""Pairwise preferences (group M)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from shelfmark.operators.browse import global_rank, percentile_rank
from shelfmark.operators.order_stats import auc
from shelfmark.registry import query
from shelfmark.runtime import stash
from shelfmark.sources.views import METRICS

SOURCE_WEIGHT = {"vote": 1.0, "culling": 0.7, "rating": 0.5}


def canonical(pairs: DataFrame) -> DataFrame:
    """One row for each unordered pair, the smaller path first, the latest vote kept."""
    flipped = F.when(F.col("a_path") <= F.col("b_path"), F.col("winner")).when(F.col("winner") == "a", "b").when(F.col("winner") == "b", "a").otherwise(F.col("winner"))
    rows = pairs.select(F.least("a_path", "b_path").alias("a_path"), F.greatest("a_path", "b_path").alias("b_path"), flipped.alias("winner"), "category", "source", "voted_at", "user_id")
    return rows.groupBy("a_path", "b_path").agg(F.max_by(F.struct("winner", "category", "source", "voted_at", "user_id"), F.struct("voted_at", "source", "winner", "category", "user_id")).alias("r")).select("a_path", "b_path", "r.*")


def culling_pairs(decided: DataFrame, group: str, keeps: int = 2, cap: int = 12) -> DataFrame:
    """Each rejected shot against kept ones in turn, at most ``cap`` pairs a group. Only a group's first ranks are looked at, so none is gathered."""
    kept = decided.where("keep").select(group, "path", F.row_number().over(W.partitionBy(group).orderBy(F.desc("aggregate"), "path")).alias("n")).where(F.col("n") <= keeps)
    lost = decided.where("not keep").select(group, F.col("path").alias("b_path"), F.row_number().over(W.partitionBy(group).orderBy("path")).alias("i")).where(F.col("i") <= cap)
    sizes = kept.groupBy(group).agg(F.count("*").alias("size"))
    turned = lost.join(sizes, group).withColumn("n", (F.col("i") - 1) % F.col("size") + 1)
    return turned.join(kept.withColumnRenamed("path", "a_path"), [group, "n"]).select(group, "a_path", "b_path", F.lit("a").alias("winner"))


def label_pairs(items: DataFrame, per_item: int = 6, total: int = 2000, gap: int = 2, pool: int = 500, sampled: int = 2) -> DataFrame:
    """Pairs from labels within a category: favourite over rejected, then stars ``gap`` apart, then favourite over unlabelled.

    An item takes part in at most ``per_item`` pairs, all categories together give at most ``total``, in the order of
    category, rule and path. No pair needs an item beyond the first ``depth`` of its class: at most
    ``2 * total / per_item`` items are used up, and each other one gives a pair while partners are left. So
    the walk in order sees a number of rows that the feature's caps bound, whatever the table's size.
    Unlabelled items are taken in turn from the first ``pool`` ones.
    """
    depth = total + 2 * total // per_item + 1
    fav, rej, stars = F.col("is_favorite") == 1, F.col("is_rejected") == 1, F.coalesce(F.col("star_rating"), F.lit(0))
    named = F.array(F.when(fav, "favourite"), F.when(rej, "rejected"), F.when((stars > 0) & ~F.coalesce(rej, F.lit(False)), F.concat(F.lit("stars "), stars)),
                    F.when(~F.coalesce(fav, F.lit(False)) & ~F.coalesce(rej, F.lit(False)) & (stars == 0), "plain"))
    classed = items.select("category", "path", stars.alias("stars"), F.explode(F.array_compact(named)).alias("class"))
    rank = F.row_number().over(W.partitionBy("category", "class").orderBy("path"))
    # bounds as literals, so each task passes on its first rows alone
    plain = F.col("class") == "plain"
    first = classed.where(plain).withColumn("n", rank).where(F.col("n") <= pool).unionByName(classed.where(~plain).withColumn("n", rank).where(F.col("n") <= depth))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[int, int] = {}
        out: list[tuple[str, int, int]] = []
        room = lambda x: used.get(x, 0) < per_item

        def put(better: int, worse: list[int], most: int | None = None) -> None:
            for other in worse[:most]:
                if len(out) >= total or not room(better):
                    return
                if other != better and room(other):
                    out.append((category, better, other))
                    used[better], used[other] = used.get(better, 0) + 1, used.get(other, 0) + 1

        for category, rows in pdf.sort_values(["category", "path"]).groupby("category", sort=True):
            held = {name: part["path"].tolist() for name, part in rows.groupby("class")}
            rated = sorted(((int(name.split()[1]), paths) for name, paths in held.items() if name.startswith("stars ")), reverse=True)
            favourites, plain = held.get("favourite", []), held.get("plain", [])
            for item in favourites:
                put(item, held.get("rejected", []))
            for high, better in rated:
                worse = [p for low, paths in rated if high - low >= gap for p in paths if room(p)]
                for item in better:
                    put(item, worse)
                    worse = [p for p in worse if room(p)] if len(worse) and not room(worse[0]) else worse
            for k, item in enumerate(favourites):
                put(item, [plain[(sampled * k + m) % len(plain)] for m in range(min(sampled, len(plain)))])
        return pd.DataFrame(out, columns=["category", "a_path", "b_path"])

    return first.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "category string, a_path long, b_path long")


def merged_sources(votes: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Synthetic pairs beneath real votes: a vote on a pair wins."""
    return votes.unionByName(synthetic.join(votes, ["a_path", "b_path"], "left_anti"))


def next_pairs(items: DataFrame, compared: DataFrame, n: int, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Neighbours by score that were not compared yet, the closest first; bounds restrict the pool."""
    ranked = global_rank(items.where(F.col("aggregate").between(low, high)).select("path", "aggregate"), [F.col("aggregate").asc(), F.col("path").asc()])
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col("path").alias("other"), F.col("aggregate").alias("score"))
    pairs = ranked.join(after, "rank").select(F.least("path", "other").alias("a_path"), F.greatest("path", "other").alias("b_path"), F.round(F.col("score") - F.col("aggregate"), 6).alias("gap"))
    return pairs.join(compared, ["a_path", "b_path"], "left_anti").orderBy("gap", "a_path").limit(n)


def training_rows(pairs: DataFrame, items: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows ``y, weight, d``: difference vectors with the winner's side and the source's weight; ties are half."""
    side = lambda s: items.select(F.col("path").alias(f"{s}_path"), F.array(*metrics).alias(f"v{s}"))
    weight = F.lit(0.0)
    for name, w in SOURCE_WEIGHT.items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    y = F.when(F.col("winner") == "a", 1.0).when(F.col("winner") == "b", 0.0).when(F.col("winner") == "tie", 0.5)
    joined = pairs.join(side("a"), "a_path").join(side("b"), "b_path")
    return joined.select("a_path", "b_path", "category", y.alias("y"), weight.alias("weight"), F.zip_with("va", "vb", lambda a, b: a - b).alias("d")).where("y is not null")


def fit_logistic(rows: DataFrame, size: int, ridge: float = 1e-3, rounds: int = 25, simplex: bool = False, offset: str | None = None) -> np.ndarray:
    """Weights of a pairwise logistic model: Spark sums gradient and curvature of all rows, the driver takes Newton (or projected) steps."""
    w = np.full(size, 1 / size) if simplex else np.zeros(size)
    base = F.col(offset) if offset else F.lit(0.0)
    for _ in range(rounds):
        z = base
        for i, x in enumerate(w):
            z = z + F.col("d")[i] * float(x)
        p = 1 / (1 + F.exp(-z))
        err, curve = (p - F.col("y")) * F.col("weight"), p * (1 - p) * F.col("weight")
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        s = rows.agg(F.count("*").alias("n"), *[F.sum(err * F.col("d")[i]).alias(f"g{i}") for i in range(size)], *[F.sum(curve * F.col("d")[i] * F.col("d")[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
        if not s["n"]:
            return w
        grad = np.array([s[f"g{i}"] for i in range(size)]) + ridge * s["n"] * w
        hess = np.zeros((size, size))
        for i, j in pairs:
            hess[i, j] = hess[j, i] = s[f"h{i}_{j}"]
        step = np.linalg.solve(hess + (ridge * s["n"] + 1e-9) * np.eye(size), grad)
        new = w - step
        if simplex:
            new = np.maximum(new, 0)
            new = new / new.sum() if new.sum() else np.full(size, 1 / size)
        if np.abs(new - w).max() < 1e-8:
            return new
        w = new
    return w


def accuracy(rows: DataFrame, w: np.ndarray) -> float:
    z = sum((F.col("d")[i] * float(x) for i, x in enumerate(w)), F.lit(0.0))
    right = F.when(F.col("y") == 0.5, None).otherwise(((z > 0) == (F.col("y") == 1)).cast("double"))
    return float(rows.agg(F.coalesce(F.avg(right), F.lit(0.0))).first()[0])


def cross_validated(rows: DataFrame, size: int, folds: int = 4) -> list[tuple[int, float, float]]:
    """(fold, learned accuracy, mean-weight baseline); the fold is a hash of the pair."""
    held = rows.withColumn("fold", F.pmod(F.xxhash64("a_path", "b_path"), F.lit(folds)))
    out = []
    for k in range(folds):
        w = fit_logistic(held.where(F.col("fold") != k), size, rounds=8)
        test = held.where(F.col("fold") == k)
        out.append((k, accuracy(test, w), accuracy(test, np.full(size, 1 / size))))
    return out


def bootstrap_fits(rows: DataFrame, size: int, replicates: int = 8, strata: int = 4096) -> DataFrame:
    """Weights on resampled rows: each row's Poisson-like count in a replicate comes from a hash; one replicate's sums are one small group."""
    count = lambda r: F.element_at(F.array(*[F.lit(x) for x in (0, 0, 0, 1, 1, 1, 2, 3)]), (F.pmod(F.xxhash64("a_path", "b_path", r), F.lit(8)) + 1).cast("int"))
    dealt = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", count("replicate")).where("k > 0")
    # one least-squares step from zero needs only sums, so replicates never gather their rows
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    d = F.col("d")
    sums = dealt.groupBy("replicate").agg(*[F.sum(F.col("k") * F.col("weight") * (F.col("y") - 0.5) * d[i]).alias(f"g{i}") for i in range(size)], *[F.sum(F.col("k") * F.col("weight") * 0.25 * d[i] * d[j]).alias(f"h{i}_{j}") for i, j in pairs])

    def solve(batches):
        for pdf in batches:
            for _, s in pdf.iterrows():
                h = np.zeros((size, size))
                for i, j in pairs:
                    h[i, j] = h[j, i] = s[f"h{i}_{j}"]
                w = np.linalg.solve(h + 1e-6 * np.eye(size), np.array([s[f"g{i}"] for i in range(size)]))
                yield pd.DataFrame({"replicate": int(s["replicate"]), "dim": range(size), "weight": w})

    return sums.mapInPandas(solve, "replicate long, dim int, weight double")


def group_softmax(df: DataFrame, group: str, score: str) -> DataFrame:
    top = F.max(score).over(W.partitionBy(group))
    e = df.withColumn("_e", F.exp(F.col(score) - top))
    return e.withColumn("prob", F.col("_e") / F.sum("_e").over(W.partitionBy(group))).drop("_e")


def shot_metrics(v) -> DataFrame:
    return v.shot.select("path", "aggregate", (F.col("ev") / 10.0).alias("aesthetic"), (F.col("camera") % 10).cast("double").alias("tech_sharpness"), F.length("kind").cast("double").alias("comp_score"), (F.col("path") % 7).cast("double").alias("exposure"))


@query("m1_canonical_pairs", "SELECT least(a_path, b_path) AS a_path, greatest(a_path, b_path) AS b_path, arg_max(CASE WHEN a_path <= b_path THEN winner WHEN winner = 'a' THEN 'b' WHEN winner = 'b' THEN 'a' ELSE winner END, voted_at) AS winner FROM (SELECT CASE WHEN user_id % 2 = 0 THEN b_path ELSE a_path END AS a_path, CASE WHEN user_id % 2 = 0 THEN a_path ELSE b_path END AS b_path, winner, voted_at FROM pref) GROUP BY 1, 2")
def _(v):
    even = F.col("user_id") % 2 == 0
    turned = v.pref.withColumns({"a_path": F.when(even, F.col("b_path")).otherwise(F.col("a_path")), "b_path": F.when(even, F.col("a_path")).otherwise(F.col("b_path"))})
    return canonical(turned).select("a_path", "b_path", "winner")


@query("m2_culling_pairs", """WITH g AS (SELECT camera, list(path ORDER BY -aggregate, path) FILTER (aggregate >= 8)[1:2] AS k, list(path ORDER BY path) FILTER (aggregate < 8)[1:12] AS r FROM shot GROUP BY 1)
  SELECT camera, k[(i % len(k)) + 1] AS a_path, r[i + 1] AS b_path FROM g, unnest(range(12)) t(i) WHERE len(k) > 0 AND i < len(r)""")
def _(v):
    return culling_pairs(v.shot.withColumn("keep", F.col("aggregate") >= 8), "camera").select("camera", "a_path", "b_path")


@query("m3_label_pairs")
def _(v):
    return label_pairs(v.overlay.join(v.shot.select("path", F.col("kind").alias("category")), "path"))


@query("m4_votes_win", "SELECT a_path, b_path, winner FROM pref WHERE source = 'vote' UNION ALL SELECT a_path, b_path, 'a' FROM pref WHERE source <> 'vote' AND category = 'click'")
def _(v):
    votes = v.pref.where("source = 'vote'").select("a_path", "b_path", "winner")
    return merged_sources(votes, v.pref.where("category = 'click'").select("a_path", "b_path", F.lit("a").alias("winner")))


@query("m5_next_pairs", "SELECT least(path, other) AS a_path, greatest(path, other) AS b_path, round(nxt - aggregate, 6) AS gap FROM (SELECT path, aggregate, lead(path) OVER (ORDER BY aggregate, path) AS other, lead(aggregate) OVER (ORDER BY aggregate, path) AS nxt FROM shot WHERE aggregate BETWEEN 5.5 AND 8.5) t WHERE other IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pref p WHERE p.a_path = least(path, other) AND p.b_path = greatest(path, other)) ORDER BY gap, a_path LIMIT 30")
def _(v):
    return next_pairs(v.shot, v.pref.select("a_path", "b_path"), 30, 5.5, 8.5)


@query("m5_least_compared", """WITH seen AS (SELECT path, count(*) AS k FROM (SELECT unnest([a_path, b_path]) AS path FROM pref WHERE category = 'view') GROUP BY 1)
  SELECT s.path, coalesce(k, 0)::BIGINT AS n FROM shot s LEFT JOIN seen USING (path) ORDER BY n, aggregate DESC, s.path LIMIT 40""")
def _(v):
    seen = v.pref.where("category = 'view'").select(F.explode(F.array("a_path", "b_path")).alias("path")).groupBy("path").agg(F.count("*").alias("k"))
    return v.shot.join(seen, "path", "left").select("path", F.coalesce("k", F.lit(0)).alias("n"), "aggregate").orderBy("n", F.desc("aggregate"), "path").limit(40).select("path", "n")


#: Candidates of the learning-value choice, a limit of the feature; drawn by a hash of their ids.
CANDIDATE_POOL = 200


@query("m6_learning_value", f"""WITH pool AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {CANDIDATE_POOL})
  SELECT a.vec_id AS a, b.vec_id AS b, round((1 - list_cosine_similarity(a.v, b.v)) * CASE WHEN a.label <> b.label THEN 2.0::DOUBLE ELSE 1.0 END, 5) AS value FROM pool a JOIN pool b ON a.vec_id < b.vec_id ORDER BY value DESC, a, b LIMIT 20""")
def _(v):
    from shelfmark.functions.scalars import cosine

    pool = v.vec.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(CANDIDATE_POOL)
    pairs = pool.alias("a").join(pool.alias("b"), F.col("a.vec_id") < F.col("b.vec_id"))
    value = (1 - cosine("a.embedding", "b.embedding")) * F.when(F.col("a.label") != F.col("b.label"), 2.0).otherwise(1.0)
    return pairs.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(value, 5).alias("value")).orderBy(F.desc("value"), "a", "b").limit(20)


@query("m7_training_set", "SELECT a_path, b_path, CASE winner WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.0 ELSE 0.5 END::DOUBLE AS y, CASE source WHEN 'vote' THEN 1.0 WHEN 'culling' THEN 0.7 ELSE 0.5 END::DOUBLE AS weight, round(a.ev / 10.0 - b.ev / 10.0, 4) AS d0 FROM pref JOIN shot a ON a.path = a_path JOIN shot b ON b.path = b_path")
def _(v):
    return training_rows(v.pref, shot_metrics(v)).select("a_path", "b_path", "y", "weight", F.round(F.col("d")[0], 4).alias("d0"))


def _weights(v, w) -> DataFrame:
    return v.pref.limit(1).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(x)).alias("weight")) for m, x in zip(METRICS, w, strict=True)])))


@query("m8_weight_fit")
def _(v):
    return _weights(v, fit_logistic(stash(training_rows(v.pref, shot_metrics(v))), len(METRICS), simplex=True, rounds=10))


@query("m9_cross_validation")
def _(v):
    found = cross_validated(stash(training_rows(v.pref, shot_metrics(v))), len(METRICS))
    return v.pref.limit(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(a).alias("learned"), F.lit(b).alias("baseline")) for k, a, b in found])))


@query("m9_bootstrap")
def _(v):
    fits = bootstrap_fits(training_rows(v.pref, shot_metrics(v)), len(METRICS))
    return fits.groupBy("dim").agg(F.percentile("weight", [0.05, 0.5, 0.95]).alias("q")).select("dim", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "mid", "high"))])


@query("m10_ranker")
def _(v):
    rows = stash(training_rows(v.pref, shot_metrics(v)))
    both = rows.unionByName(rows.withColumn("y", 1 - F.col("y")).withColumn("d", F.transform("d", lambda x: -x)))
    return _weights(v, fit_logistic(both, len(METRICS), rounds=8))


@query("m11_prior_blend", "SELECT category, round(n / (n + 50.0::DOUBLE), 5) AS lam FROM (SELECT category, count(*) AS n FROM pref GROUP BY 1)")
def _(v):
    return v.pref.groupBy("category").agg(F.round(F.count("*") / (F.count("*") + 50.0), 5).alias("lam"))


@query("m12_learned_scores", "SELECT path, round((row_number() OVER (ORDER BY round(0.5 * aesthetic + 0.5 * exposure, 9), path) - 1) * 10.0::DOUBLE / greatest(1, count(*) OVER () - 1), 4) AS learned FROM metric")
def _(v):
    rows = v.metric.select("path", F.round(0.5 * F.col("aesthetic") + 0.5 * F.col("exposure"), 9).alias("s"))
    return percentile_rank(rows, "s").select("path", F.round("percentile", 4).alias("learned"))


@query("m13_keeper_softmax", "SELECT path, round(exp(aggregate - max(aggregate) OVER (PARTITION BY camera)) / sum(exp(aggregate - m)) OVER (PARTITION BY camera), 5) AS prob FROM (SELECT *, max(aggregate) OVER (PARTITION BY camera) AS m FROM shot)")
def _(v):
    return group_softmax(v.shot, "camera", "aggregate").select("path", F.round("prob", 5).alias("prob"))


@query("m14_metric_auc", "SELECT lang, count(*) FILTER (quality = 1)::BIGINT AS positives, round((sum(CASE WHEN quality = 1 THEN r END) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1)), 5) AS auc FROM (SELECT lang, quality, (rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0)::DOUBLE AS r FROM label) GROUP BY 1 HAVING count(*) FILTER (quality = 1) >= 5 AND count(*) FILTER (quality <> 1) >= 5")
def _(v):
    return auc(v.label, "n_chars", "quality", ["lang"], 5).select("lang", "positives", F.round("auc", 5).alias("auc"))


@query("m14_point_biserial", "SELECT lang, round(corr(n_chars::DOUBLE, quality::DOUBLE), 5) AS r FROM label GROUP BY 1")
def _(v):
    from shelfmark.operators.dashboards import pearson

    return v.label.groupBy("lang").agg(F.round(pearson(F.col("n_chars"), F.col("quality")), 5).alias("r"))


@query("m15_baseline_accuracy", "SELECT category, round(avg(CASE WHEN (a.ev > b.ev) = (winner = 'a') THEN 1.0::DOUBLE ELSE 0.0 END), 5) AS acc FROM pref JOIN shot a ON a.path = a_path JOIN shot b ON b.path = b_path WHERE winner <> 'tie' GROUP BY 1")
def _(v):
    side = lambda s: v.shot.select(F.col("path").alias(f"{s}_path"), F.col("ev").alias(f"{s}_ev"))
    rows = v.pref.where("winner <> 'tie'").join(side("a"), "a_path").join(side("b"), "b_path")
    return rows.groupBy("category").agg(F.round(F.avg(((F.col("a_ev") > F.col("b_ev")) == (F.col("winner") == "a")).cast("double")), 5).alias("acc"))


@query("m16_user_scope", "SELECT a_path FROM (SELECT a_path, nullif(user_id, 7) AS u FROM pref) WHERE u = 3 OR u IS NULL")
def _(v):
    return v.pref.select("a_path", F.nullif("user_id", F.lit(7)).alias("u")).where("u = 3 or u is null").select("a_path")


