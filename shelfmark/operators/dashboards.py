"""Value counts and dashboards (group D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.scalars import rational
from shelfmark.registry import query
from shelfmark.sources.views import METRICS


def value_counts(df: DataFrame, column: str, least: int = 1, limit: int | None = None) -> DataFrame:
    """Values with their counts, most frequent first, ties by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return out.orderBy(F.desc("n"), "value").limit(limit) if limit else out


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """Each row's percentage; the counts are small, their total joins as one row."""
    return counts.join(F.broadcast(counts.agg(F.sum(n).alias("_all")))).withColumn("share", F.round(100.0 * F.col(n) / F.col("_all"), 2)).drop("_all")


def half_points(column: str) -> Column:
    return F.round(F.col(column) * 2) / 2


def ladder(column: Column, cuts: list[float], names: list[str]) -> Column:
    """The name of the half-open interval a value lies in."""
    out = F.when(column.isNotNull(), F.lit(names[-1]))
    for cut, name in zip(reversed(cuts), reversed(names[:-1]), strict=True):
        out = F.when(column < cut, name).otherwise(out)
    return out


def pearson(x: Column, y: Column) -> Column:
    """Correlation, null where it is undefined."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def metric_bounds(df: DataFrame, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows ``metric, low, high`` in one pass."""
    held = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    one = df.agg(*[x for c in columns for x in (F.min(held(c)).alias(f"low_{c}"), F.max(held(c)).alias(f"high_{c}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in columns])))


def metric_histogram(df: DataFrame, bins: int = 20, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows ``metric, bin, n`` of equal bins between the bounds; the top edge falls in the last one."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in columns]))).where("x is not null")
    place = F.floor(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")) * bins)
    placed = long.join(F.broadcast(metric_bounds(df, columns)), "metric").withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.coalesce(place, F.lit(0)))).cast("int"))
    return placed.groupBy("metric", "bin").agg(F.count("*").alias("n"))


def folder_level(df: DataFrame, prefix: str = "", place: str = "place", score: str = "aggregate", key: str = "path") -> DataFrame:
    """Children below a prefix: name, count, best cover, and whether they hold items directly."""
    rest = F.substring(F.col(place), F.lit(len(prefix) + 1), F.length(place))
    child = F.substring_index(rest, "/", 1)
    held = df.where(F.col(place).startswith(prefix)).withColumn("child", child).withColumn("direct", ~F.contains(rest, F.lit("/")))
    return held.groupBy("child").agg(F.count("*").alias("n"), F.min_by(key, F.struct(-F.col(score), F.col(key))).alias("cover"), F.bool_or("direct").alias("direct"))


def map_clusters(df: DataFrame, zoom: int) -> DataFrame:
    """Grid cells of 180 / 2^zoom degrees: centre of mass, count, best item."""
    cell = 180.0 / 2 ** max(zoom, 2)
    grid = df.groupBy(F.floor(F.col("lat") / cell).alias("row"), F.floor(F.col("lon") / cell).alias("col"))
    return grid.agg(F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"), F.count("*").alias("n"), F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("best"))


def bucketed_means(df: DataFrame, axis: Column, metrics: list[str], least: int, by: str | None = None) -> DataFrame:
    """Means of metrics along an axis, where a bucket has enough rows."""
    keys = [axis.alias("bucket"), *([F.col(by).alias("grp")] if by else [])]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 3).alias(m) for m in metrics]).where(F.col("n") >= least)


def rule_overlap(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows ``a, b, n``: rows that match both rules; ``a = b`` counts one rule. The rules are few."""
    matched = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(rules.items())]), lambda x: x.isNotNull())
    rows = df.select(matched.alias("m")).select("m", F.posexplode("m").alias("i", "a"))
    return rows.select("a", F.explode(F.slice("m", F.col("i") + 1, F.size("m"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("d1_overview", "SELECT count(*)::BIGINT AS n, round(avg(aggregate), 3) AS mean_aggregate, round(avg(aesthetic), 3) AS mean_aesthetic, round(avg(comp_score), 3) AS mean_comp, strftime(min(date_taken), '%Y-%m-%d') AS first, strftime(max(date_taken), '%Y-%m-%d') AS last, count(DISTINCT camera)::BIGINT AS cameras FROM scored")
def _(v):
    mean = lambda c: F.round(F.avg(c), 3)
    return v.scored.agg(
        F.count("*").alias("n"), mean("aggregate").alias("mean_aggregate"), mean("aesthetic").alias("mean_aesthetic"), mean("comp_score").alias("mean_comp"),
        F.date_format(F.min("date_taken"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("date_taken"), "yyyy-MM-dd").alias("last"), F.count_distinct("camera").alias("cameras"),
    )


@query("d2_half_point_histogram", "SELECT round(aggregate * 2) / 2 AS bin, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share FROM item GROUP BY 1")
def _(v):
    return with_share(v.item.groupBy(half_points("aggregate").alias("bin")).agg(F.count("*").alias("n")))


@query("d3_top_entities", "SELECT lens, count(*)::BIGINT AS n, round(avg(aggregate), 3) AS mean FROM item GROUP BY 1 HAVING count(*) >= 10 ORDER BY avg(aggregate) DESC, lens LIMIT 20")
def _(v):
    groups = v.item.groupBy("lens").agg(F.count("*").alias("n"), F.avg("aggregate").alias("m")).where("n >= 10")
    return groups.orderBy(F.desc("m"), "lens").limit(20).select("lens", "n", F.round("m", 3).alias("mean"))


@query("d4_category_stats", """SELECT s.category, n, share, mean_aggregate, mean_exposure, camera FROM (SELECT category, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share, round(avg(aggregate), 3) AS mean_aggregate, round(avg(exposure), 3) AS mean_exposure FROM scored GROUP BY 1) s
  JOIN (SELECT category, camera FROM (SELECT category, camera, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, camera) AS rn FROM scored GROUP BY 1, 2) WHERE rn = 1) m ON m.category = s.category""")
def _(v):
    from shelfmark.operators.browse import mode_per_key

    stats = v.scored.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("aggregate"), 3).alias("mean_aggregate"), F.round(F.avg("exposure"), 3).alias("mean_exposure"))
    return with_share(stats).join(mode_per_key(v.scored, "category", "camera").drop("n"), "category")


@query("d5_gear_report", """SELECT camera, lens, count(*)::BIGINT AS n, round(avg(aggregate), 3) AS mean, round(avg(aesthetic), 3) AS aesthetic FROM scored GROUP BY GROUPING SETS ((camera), (lens), (camera, lens)) HAVING count(*) >= 5""")
def _(v):
    return v.spark.sql("SELECT camera, lens, count(*) AS n, round(avg(aggregate), 3) AS mean, round(avg(aesthetic), 3) AS aesthetic FROM {items} GROUP BY GROUPING SETS ((camera), (lens), (camera, lens)) HAVING count(*) >= 5", items=v.scored)


@query("d6_usage_history", "SELECT camera, string_agg(m || '=' || n, ',' ORDER BY m) AS history FROM (SELECT camera, strftime(date_taken, '%Y-%m') AS m, count(*) AS n FROM item GROUP BY 1, 2) GROUP BY 1")
def _(v):
    months = v.item.groupBy("camera", F.date_format("date_taken", "yyyy-MM").alias("m")).agg(F.count("*").alias("n"))
    return months.groupBy("camera").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("m", "n"))), lambda x: F.concat_ws("=", x["m"], x["n"])), ",").alias("history"))


@query("d7_iso_buckets", "SELECT CASE WHEN iso < 200 THEN 'low' WHEN iso < 800 THEN 'mid' WHEN iso < 1200 THEN 'high' ELSE 'extreme' END AS bucket, count(*)::BIGINT AS n FROM (SELECT n_parts * 100 AS iso FROM metric) GROUP BY 1")
def _(v):
    return v.metric.groupBy(ladder(F.col("n_parts") * 100, [200, 800, 1200], ["low", "mid", "high", "extreme"]).alias("bucket")).agg(F.count("*").alias("n"))


@query("d8_aperture_counts", "SELECT round(floor(l_quantity * 4) / 10, 1) AS f_stop, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def _(v):
    return v.table("lineitem").groupBy(F.round(F.floor(F.col("l_quantity") * 4) / 10, 1).alias("f_stop")).agg(F.count("*").alias("n"))


@query("d9_focal_buckets", "SELECT CASE WHEN f < 24 THEN 'wide' WHEN f < 70 THEN 'normal' ELSE 'tele' END AS bucket, count(*)::BIGINT AS n FROM (SELECT coalesce(nullif(p_size, 10), p_partkey % 200) AS f FROM part) GROUP BY 1")
def _(v):
    f = F.coalesce(F.nullif("p_size", F.lit(10)), F.col("p_partkey") % 200)
    return v.table("part").groupBy(ladder(f, [24, 70], ["wide", "normal", "tele"]).alias("bucket")).agg(F.count("*").alias("n"))


@query("d10_shutter_buckets", "SELECT CASE WHEN s IS NULL THEN 'unknown' WHEN s < 0.02 THEN 'fast' WHEN s < 0.1 THEN 'medium' ELSE 'slow' END AS bucket, count(*)::BIGINT AS n FROM (SELECT 1.0::DOUBLE / nullif(ev, 0) AS s FROM shot) GROUP BY 1")
def _(v):
    s = rational(F.concat(F.lit("1/"), F.col("ev").cast("string")))
    return v.shot.groupBy(F.coalesce(ladder(s, [0.02, 0.1], ["fast", "medium", "slow"]), F.lit("unknown")).alias("bucket")).agg(F.count("*").alias("n"))


@query("d11_timeline_counts", "SELECT strftime(date_taken, '%Y-%m') AS month, count(*)::BIGINT AS n, round(avg(aggregate), 3) AS mean FROM item GROUP BY 1")
def _(v):
    return v.item.groupBy(F.date_format("date_taken", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("aggregate"), 3).alias("mean"))


@query("d12_heatmap", "SELECT dayofweek(captured_at)::INTEGER AS weekday, hour(captured_at)::INTEGER AS hour, count(*)::BIGINT AS n FROM shot GROUP BY 1, 2")
def _(v):
    return v.shot.groupBy((F.dayofweek("captured_at") - 1).alias("weekday"), F.hour("captured_at").alias("hour")).agg(F.count("*").alias("n"))


@query("d13_busiest_days", "SELECT strftime(captured_at, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM shot GROUP BY 1 ORDER BY n DESC, day LIMIT 10")
def _(v):
    return v.shot.groupBy(F.date_format("captured_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(10)


@query("d14_bucketed_means", "SELECT floor(exposure)::BIGINT AS bucket, count(*)::BIGINT AS n, round(avg(aggregate), 3) AS aggregate, round(avg(aesthetic), 3) AS aesthetic FROM scored GROUP BY 1 HAVING count(*) >= 5")
def _(v):
    return bucketed_means(v.scored, F.floor("exposure"), ["aggregate", "aesthetic"], 5)


@query("d15_bucketed_by_group", "SELECT hour(captured_at)::INTEGER AS bucket, kind AS grp, count(*)::BIGINT AS n, round(avg(aggregate), 3) AS aggregate FROM shot WHERE kind IN (SELECT kind FROM shot GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 3) GROUP BY 1, 2 HAVING count(*) >= 5")
def _(v):
    top = v.shot.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(3)
    return bucketed_means(v.shot.join(F.broadcast(top), "kind", "left_semi"), F.hour("captured_at"), ["aggregate"], 5, "kind")


@query("d16_category_histograms", "SELECT category, floor(aggregate)::BIGINT AS bin, count(*)::BIGINT AS n FROM item GROUP BY 1, 2")
def _(v):
    return v.item.groupBy("category", F.floor("aggregate").alias("bin")).agg(F.count("*").alias("n"))


@query("d17_correlations", "SELECT category, round(corr(aesthetic, aggregate), 4) AS aesthetic, round(corr(tech_sharpness, aggregate), 4) AS tech_sharpness, round(corr(comp_score, aggregate), 4) AS comp_score, round(corr(exposure, aggregate), 4) AS exposure FROM scored GROUP BY 1 HAVING count(*) >= 10")
def _(v):
    return v.scored.groupBy("category").agg(F.count("*").alias("n"), *[F.round(pearson(F.col(m), F.col("aggregate")), 4).alias(m) for m in METRICS]).where("n >= 10").drop("n")


@query("d18_metric_sample", "SELECT path, aesthetic, exposure FROM scored WHERE category = '3-MEDIUM' ORDER BY path LIMIT 5000")
def _(v):
    return v.scored.where("category = '3-MEDIUM'").orderBy("path").limit(5000).select("path", "aesthetic", "exposure")


@query("d19_rule_overlap", """WITH m AS (SELECT path, unnest(list_filter([CASE WHEN aesthetic >= 5 THEN 'a' END, CASE WHEN exposure >= 4 THEN 'e' END, CASE WHEN aggregate >= 5 THEN 'g' END], lambda x: x IS NOT NULL)) AS r FROM scored)
  SELECT x.r AS a, y.r AS b, count(*)::BIGINT AS n FROM m x JOIN m y ON x.path = y.path AND x.r <= y.r GROUP BY 1, 2""")
def _(v):
    return rule_overlap(v.scored, {"a": F.col("aesthetic") >= 5, "e": F.col("exposure") >= 4, "g": F.col("aggregate") >= 5})


@query("d20_value_counts", "SELECT 'camera' AS kind, camera AS value, count(*)::BIGINT AS n FROM item GROUP BY 2 UNION ALL SELECT 'category', category, count(*)::BIGINT FROM item GROUP BY 2 UNION ALL SELECT 'status', status, count(*)::BIGINT FROM item GROUP BY 2")
def _(v):
    long = v.item.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("camera", "category", "status")])))
    return long.where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("d21_tag_counts", "SELECT tag AS value, count(*)::BIGINT AS n FROM part_tag GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def _(v):
    return value_counts(v.part_tag, "tag", limit=50)


@query("d22_person_counts", "SELECT l_suppkey AS person, count(DISTINCT l_orderkey)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 600 OR l_suppkey IN (1, 2)")
def _(v):
    counts = v.table("lineitem").select("l_suppkey", "l_orderkey").distinct().groupBy(F.col("l_suppkey").alias("person")).agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= 600) | F.col("person").isin(1, 2))


@query("d23_numeric_counts", "SELECT round(aesthetic, 1) AS value, count(*)::BIGINT AS n FROM metric WHERE n_parts = 1 GROUP BY 1")
def _(v):
    return v.metric.where("n_parts = 1").groupBy(F.round("aesthetic", 1).alias("value")).agg(F.count("*").alias("n"))


@query("d24_colour_counts", "SELECT CASE WHEN s < 0.1 THEN 'neutral' WHEN h < 90 OR h >= 300 THEN 'warm' ELSE 'cool' END AS value, count(*)::BIGINT AS n FROM (SELECT path % 360 AS h, tech_sharpness / 10 AS s FROM metric) GROUP BY 1")
def _(v):
    from shelfmark.functions.scalars import colour_temperature

    rows = v.metric.select((F.col("path") % 360).alias("h"), (F.col("tech_sharpness") / 10).alias("s"))
    return rows.groupBy(colour_temperature("h", "s").alias("value")).agg(F.count("*").alias("n"))


@query("d25_metric_ranges", """WITH long AS (SELECT unnest(['aesthetic', 'tech_sharpness', 'comp_score', 'exposure']) AS metric, unnest([aesthetic, tech_sharpness, comp_score, exposure]) AS x FROM metric),
  b AS (SELECT metric, min(x) AS lo, max(x) AS hi FROM long GROUP BY 1)
  SELECT long.metric, least(19, greatest(0, floor((x - lo) / (hi - lo) * 20)))::INTEGER AS bin, count(*)::BIGINT AS n FROM long JOIN b ON b.metric = long.metric GROUP BY 1, 2""".replace("WITH long", "WITH metric_rows AS (SELECT * FROM metric), long").replace("FROM metric),\n  b", "FROM metric_rows),\n  b"))
def _(v):
    return metric_histogram(v.metric)


@query("d26_type_counts", "SELECT count(*) FILTER (aggregate >= 8)::BIGINT AS top_picks, count(*) FILTER (tech_sharpness >= 6)::BIGINT AS sharp, count(*) FILTER (category = '1-URGENT')::BIGINT AS urgent FROM scored")
def _(v):
    return v.scored.agg(F.count_if(F.col("aggregate") >= 8).alias("top_picks"), F.count_if(F.col("tech_sharpness") >= 6).alias("sharp"), F.count_if(F.col("category") == "1-URGENT").alias("urgent"))


@query("d27_hidden_summary", "SELECT count(*)::BIGINT AS n, count(*) FILTER (kind = 'error')::BIGINT AS errors, count(*) FILTER (ev < 10)::BIGINT AS dark, count(*) FILTER (camera % 5 = 0 AND aggregate < 2)::BIGINT AS weak FROM shot")
def _(v):
    return v.shot.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("ev") < 10).alias("dark"), F.count_if((F.col("camera") % 5 == 0) & (F.col("aggregate") < 2)).alias("weak"))


@query("d28_filtered_count", "SELECT count(*)::BIGINT AS n FROM item WHERE aggregate >= 5 AND camera = 'BUILDING'")
def _(v):
    return v.item.where("aggregate >= 5 and camera = 'BUILDING'").agg(F.count("*").alias("n"))


@query("d29_folder_level", "SELECT string_split(place, '/')[1] AS child, count(*)::BIGINT AS n, min_by(path, (-aggregate, path)) AS cover, bool_or(NOT contains(place, '/')) AS direct FROM folder GROUP BY 1")
def _(v):
    return folder_level(v.folder)


@query("d30_map_clusters", "SELECT floor(lat / 22.5)::BIGINT AS \"row\", floor(lon / 22.5)::BIGINT AS col, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, count(*)::BIGINT AS n, min_by(path, (-score, path)) AS best FROM geo GROUP BY 1, 2")
def _(v):
    return map_clusters(v.geo, 3)


@query("d31_map_points", "SELECT path, lat, lon FROM geo WHERE lat BETWEEN -45 AND 45 ORDER BY score DESC, path LIMIT 200")
def _(v):
    return v.geo.where("lat between -45 and 45").orderBy(F.desc("score"), "path").limit(200).select("path", "lat", "lon")


@query("d24_hue_counts", "SELECT CASE WHEN h >= 345 OR h < 15 THEN 'red' WHEN h < 45 THEN 'orange' WHEN h < 70 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 195 THEN 'cyan' WHEN h < 255 THEN 'blue' WHEN h < 300 THEN 'purple' ELSE 'magenta' END AS value, count(*)::BIGINT AS n FROM (SELECT path % 360 AS h FROM metric) GROUP BY 1")
def _(v):
    from shelfmark.operators.predicates import hue_name

    return v.metric.select((F.col("path") % 360).alias("h")).groupBy(hue_name("h").alias("value")).agg(F.count("*").alias("n"))


@query("d33_comparison_stats", "SELECT winner, category, count(*)::BIGINT AS n FROM pref GROUP BY 1, 2")
def _(v):
    return v.pref.groupBy("winner", "category").agg(F.count("*").alias("n"))


def coverage(items: DataFrame, pairs: DataFrame, score: str = "aggregate") -> DataFrame:
    """Compared items by five score bins."""
    seen = pairs.select(F.explode(F.array("a_path", "b_path")).alias("path")).distinct()
    bins = items.join(seen.withColumn("seen", F.lit(1)), "path", "left").groupBy(F.least(F.lit(4), F.floor(F.col(score) / 2)).alias("bin")).agg(F.count("*").alias("n"), F.count("seen").alias("compared"))
    return bins.withColumn("share", F.round(100.0 * F.col("compared") / F.col("n"), 2))


@query("d34_comparison_coverage", """SELECT least(4, floor(aggregate / 2))::BIGINT AS bin, count(*)::BIGINT AS n, count(p)::BIGINT AS compared, round(100.0::DOUBLE * count(p) / count(*), 2) AS share FROM shot
  LEFT JOIN (SELECT DISTINCT unnest([a_path, b_path]) AS p FROM pref WHERE source = 'vote') ON p = path GROUP BY 1""")
def _(v):
    return coverage(v.shot, v.pref.where("source = 'vote'"))


def coverage_report(items: DataFrame, pairs: DataFrame, score: str = "aggregate") -> DataFrame:
    """One row: ``pairs``, the count of compared sides in five score bins, ``evenness`` from 0 to 100 (100 less the mean relative deviation from even bins), and ``advice``.

    Sides without a score fall in no bin. Advice asks for pairs up to 30 and 50, for bins below a tenth of all sides, and warns where one side wins over 70 % of decided pairs.
    """
    scores = items.select(F.col("path").alias("_p"), F.col(score).alias("_x"))
    sides = pairs.select("winner", F.posexplode(F.array("a_path", "b_path")).alias("side", "_p")).join(scores, "_p", "left")
    inside = lambda i: F.count_if(F.col("_x").isNotNull() & (F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.col("_x") / 2))) == i)).alias(f"bin{i}")
    won = lambda w: F.count_if((F.col("winner") == w) & (F.col("side") == 0)).alias(f"won_{w}")
    found = sides.agg(F.count_if(F.col("side") == 0).alias("pairs"), *[inside(i) for i in range(5)], won("a"), won("b"))
    bins = F.array(*[F.col(f"bin{i}") for i in range(5)])
    total = F.aggregate(bins, F.lit(0).cast("bigint"), lambda a, x: a + x)
    spread = F.aggregate(F.transform(bins, lambda x: F.abs(x - F.col("_t") / 5) / (F.col("_t") / 5)), F.lit(0.0), lambda a, x: a + x)
    even = F.when(F.col("_t") > 0, F.greatest(F.lit(0.0), 100 - spread / 5 * 100)).otherwise(0.0)
    share = F.try_divide(F.col("won_a"), F.col("won_a") + F.col("won_b"))
    advice = [F.when(F.col("pairs") < 30, "enable").when(F.col("pairs") < 50, "more"), *[F.when((F.col("_t") > 0) & (F.col(f"bin{i}") * 100 < 10 * F.col("_t")), f"bin {2 * i}-{2 * i + 2}") for i in range(5)], F.when((share > 0.7) | (share < 0.3), "unbalanced")]
    return found.withColumn("_t", total).select("pairs", *[f"bin{i}" for i in range(5)], even.alias("evenness"), F.concat_ws(",", *advice).alias("advice"))


@query("d34_coverage_report", """WITH s AS (SELECT p.winner, unnest([0, 1]) AS side, unnest([a_path, b_path]) AS path FROM pref p WHERE source = 'vote'), x AS (SELECT winner, side, aggregate AS x FROM s LEFT JOIN shot ON shot.path = s.path),
  b AS (SELECT count(*) FILTER (side = 0)::BIGINT AS pairs, """ + ", ".join(f"count(*) FILTER (least(4, floor(x / 2)) = {i})::BIGINT AS bin{i}" for i in range(5)) + """, count(x) AS t, (count(*) FILTER (side = 0 AND winner = 'a') / count(*) FILTER (side = 0 AND winner IN ('a', 'b'))) AS w FROM x)
  SELECT pairs, bin0, bin1, bin2, bin3, bin4, round(greatest(0, 100 - (""" + " + ".join(f"abs(bin{i} - t / 5) / (t / 5)" for i in range(5)) + """) / 5 * 100), 6) AS evenness,
  concat_ws(',', CASE WHEN pairs < 30 THEN 'enable' WHEN pairs < 50 THEN 'more' END, """ + ", ".join(f"CASE WHEN bin{i} * 100 < 10 * t THEN 'bin {2 * i}-{2 * i + 2}' END" for i in range(5)) + """, CASE WHEN w > 0.7 OR w < 0.3 THEN 'unbalanced' END) AS advice FROM b""")
def _(v):
    return coverage_report(v.shot, v.pref.where("source = 'vote'")).withColumn("evenness", F.round("evenness", 6))


@query("d35_history_page", "SELECT a_path, b_path, winner FROM pref WHERE category = 'view' AND winner = 'b' AND voted_at >= TIMESTAMP '2024-01-05' ORDER BY voted_at DESC, a_path LIMIT 50 OFFSET 50")
def _(v):
    held = v.pref.where("category = 'view' and winner = 'b' and voted_at >= timestamp'2024-01-05'")
    return held.orderBy(F.desc("voted_at"), "a_path").offset(50).limit(50).select("a_path", "b_path", "winner")


@query("d36_scan_summary", "SELECT count(*)::BIGINT AS scanned, count(*) FILTER (aggregate IS NOT NULL)::BIGINT AS scored, count(*) FILTER (kind = 'error')::BIGINT AS failed, count(*) FILTER (kind <> 'error' AND ev < 5)::BIGINT AS hidden FROM shot")
def _(v):
    ok = F.col("kind") != "error"
    return v.shot.agg(F.count("*").alias("scanned"), F.count("aggregate").alias("scored"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.col("ev") < 5)).alias("hidden"))


@query("d37_label_inventory", "SELECT quality, toxic, lang, count(*)::BIGINT AS n FROM label GROUP BY 1, 2, 3")
def _(v):
    return v.label.groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))


@query("d38_quartiles", "SELECT category, count(*)::BIGINT AS n, round(quantile_cont(aggregate::DOUBLE, 0.25), 4) AS q1, round(quantile_cont(aggregate::DOUBLE, 0.5), 4) AS q2, round(quantile_cont(aggregate::DOUBLE, 0.75), 4) AS q3 FROM item GROUP BY 1")
def _(v):
    from shelfmark.operators.order_stats import quantiles

    q = quantiles(v.item, ["category"], "aggregate", [0.25, 0.5, 0.75])
    return q.select("category", "n", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


@query("d39_comparison_health", "SELECT coalesce(nullif(source, 'rating'), 'vote') AS source, count(*)::BIGINT AS n, count(*) FILTER (winner = 'tie')::BIGINT AS ties FROM pref GROUP BY 1")
def _(v):
    return v.pref.groupBy(F.coalesce(F.nullif("source", F.lit("rating")), F.lit("vote")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("winner") == "tie").alias("ties"))


@query("d40_unreviewed_groups", "SELECT count(*)::BIGINT AS groups, sum(n)::BIGINT AS members FROM (SELECT camera, strftime(captured_at, '%Y-%m-%d %H') AS h, count(*) AS n FROM shot GROUP BY 1, 2 HAVING count(*) >= 2)")
def _(v):
    groups = v.shot.groupBy("camera", F.date_format("captured_at", "yyyy-MM-dd HH")).agg(F.count("*").alias("n")).where("n >= 2")
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("members"))


@query("d41_comparison_needs", "SELECT category, greatest(0, 1000 - count(*))::BIGINT AS needed FROM pref GROUP BY 1")
def _(v):
    return v.pref.groupBy("category").agg(F.greatest(F.lit(0), F.lit(1000) - F.count("*")).alias("needed"))


@query("d42_client_picks", "SELECT camera AS album, count(*) FILTER (kind = 'purchase')::BIGINT AS picked, arg_max(path, (captured_at, path)) AS newest FROM shot GROUP BY 1")
def _(v):
    return v.shot.groupBy(F.col("camera").alias("album")).agg(F.count_if(F.col("kind") == "purchase").alias("picked"), F.max_by("path", F.struct("captured_at", "path")).alias("newest"))


@query("d43_dominant_category", "SELECT camera AS grp, coalesce(max(CASE WHEN rk = 1 THEN nullif(kind, 'error') END), max(CASE WHEN mk = 1 THEN kind END)) AS category FROM (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY aggregate DESC, path) AS rk, row_number() OVER (PARTITION BY camera ORDER BY n DESC, kind) AS mk FROM (SELECT *, count(*) OVER (PARTITION BY camera, kind) AS n FROM shot)) GROUP BY 1")
def _(v):
    from shelfmark.operators.browse import mode_per_key

    best = v.shot.groupBy("camera").agg(F.max_by("kind", F.struct(F.col("aggregate"), -F.col("path"))).alias("best"))
    return best.join(mode_per_key(v.shot, "camera", "kind"), "camera").select(F.col("camera").alias("grp"), F.coalesce(F.nullif("best", F.lit("error")), "kind").alias("category"))


@query("d32_snapshot", "SELECT 'category' AS summary, category AS value, count(*)::BIGINT AS n FROM item GROUP BY 2 UNION ALL SELECT 'month', strftime(date_taken, '%m'), count(*)::BIGINT FROM item GROUP BY 2 UNION ALL SELECT 'bin', floor(aggregate)::INTEGER::VARCHAR, count(*)::BIGINT FROM item GROUP BY 2")
def _(v):
    return snapshot(v.item)


def snapshot(items: DataFrame) -> DataFrame:
    """Several summaries in one pass over the items, as rows ``summary, value, n``."""
    parts = {"category": F.col("category"), "month": F.date_format("date_taken", "MM"), "bin": F.floor("aggregate").cast("string")}
    long = items.select(F.inline(F.array(*[F.struct(F.lit(k).alias("summary"), c.alias("value")) for k, c in parts.items()])))
    return long.groupBy("summary", "value").agg(F.count("*").alias("n"))


def full_snapshot(items: DataFrame, tags: DataFrame, faces: DataFrame, at) -> DataFrame:
    """Rows ``summary, value, n, updated_at``: twelve kinds of counts in three passes.

    One pass over ``items`` (``is_blink``, ``in_burst``, ``is_lead``, ``camera``, ``lens``, ``category``, ``pattern``, ``f_stop``, ``focal``) gives the total, the counts without blinks, without
    bursts' other shots and without both, and those of each camera, lens, category, pattern, aperture (one decimal) and whole focal length; one over ``tags`` each tag's, one over ``faces`` each person's items. Null values have no row, null flags
    count as unset.
    """
    open_eyes = F.coalesce(F.col("is_blink"), F.lit(0)) == 0
    shown = (F.coalesce(F.col("in_burst"), F.lit(0)) == 0) | (F.coalesce(F.col("is_lead"), F.lit(0)) == 1)
    one = lambda name, holds: F.struct(F.lit(name).alias("summary"), F.when(holds, F.lit("")).alias("value"))
    counts = [one("total", F.lit(True)), one("without_blinks", open_eyes), one("without_bursts", shown), one("without_both", open_eyes & shown)]
    values = {"camera": F.nullif("camera", F.lit("")), "lens": F.nullif("lens", F.lit("")), "category": F.col("category"), "pattern": F.nullif("pattern", F.lit("")), "aperture": F.round("f_stop", 1).cast("string"), "focal": F.round("focal").cast("int").cast("string")}
    long = items.select(F.inline(F.array(*counts, *[F.struct(F.lit(k).alias("summary"), c.alias("value")) for k, c in values.items()]))).where("value is not null")
    found = long.groupBy("summary", "value").agg(F.count("*").alias("n"))
    tagged = tags.where("tag is not null").groupBy(F.lit("tag").alias("summary"), F.col("tag").alias("value")).agg(F.count("*").alias("n"))
    people = faces.where("person is not null").select("person", "path").distinct().groupBy(F.lit("person").alias("summary"), F.col("person").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return found.unionByName(tagged).unionByName(people).withColumn("updated_at", F.lit(at))


@query("d32_full_snapshot", """WITH i AS (SELECT *, (path % 11 = 0)::INTEGER AS is_blink, (path % 4 < 2)::INTEGER AS in_burst, (path % 4 = 1)::INTEGER AS is_lead, CASE WHEN path % 7 > 0 THEN status ELSE '' END AS pattern, (path % 32)::DOUBLE / 8 + 1 AS f_stop, path % 50 + 10 AS focal FROM item),
  f AS (SELECT *, is_blink = 0 AS eyes, in_burst = 0 OR is_lead = 1 AS shown FROM i), r AS (SELECT 'total' AS summary, '' AS value, count(*) AS n FROM f UNION ALL SELECT 'without_blinks', '', count(*) FROM f WHERE eyes UNION ALL SELECT 'without_bursts', '', count(*) FROM f WHERE shown
  UNION ALL SELECT 'without_both', '', count(*) FROM f WHERE eyes AND shown UNION ALL SELECT 'camera', camera, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'lens', lens, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY 2
  UNION ALL SELECT 'pattern', pattern, count(*) FROM f WHERE pattern <> '' GROUP BY 2 UNION ALL SELECT 'aperture', round(f_stop, 1)::VARCHAR, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'focal', focal::VARCHAR, count(*) FROM f GROUP BY 2
  UNION ALL SELECT 'tag', tag, count(*) FROM item_tag GROUP BY 2 UNION ALL SELECT 'person', l_suppkey::VARCHAR, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2) SELECT summary, value, n::BIGINT AS n, 1700000000 AS updated_at FROM r""")
def _(v):
    flag = lambda c: c.cast("int")
    items = v.item.withColumns({"is_blink": flag(F.col("path") % 11 == 0), "in_burst": flag(F.col("path") % 4 < 2), "is_lead": flag(F.col("path") % 4 == 1), "pattern": F.when(F.col("path") % 7 > 0, F.col("status")).otherwise(""), "f_stop": (F.col("path") % 32).cast("double") / 8 + 1, "focal": F.col("path") % 50 + 10})
    faces = v.table("lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("path"))
    return full_snapshot(items, v.item_tag, faces, 1_700_000_000)


@query("d44_statistics_report", "SELECT category, camera, count(*)::BIGINT AS n, round(avg(aggregate), 3) AS mean, round(var_pop(aggregate), 3) AS variance FROM scored GROUP BY GROUPING SETS ((category), (camera), ())")
def _(v):
    return v.spark.sql("SELECT category, camera, count(*) AS n, round(avg(aggregate), 3) AS mean, round(var_pop(aggregate), 3) AS variance FROM {items} GROUP BY GROUPING SETS ((category), (camera), ())", items=v.scored)
