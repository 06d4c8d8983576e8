"""Order, pages, groups and set operations (group E), sources and sinks (group A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.plans.query_spec import QuerySpec, ordered
from shelfmark.registry import query
from shelfmark.runtime import shuffle_width, stash
from shelfmark.sources import tables

DAY = "yyyy-MM-dd"


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smaller."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def group_heroes(df: DataFrame, group: Column, score: str = "aggregate", key: str = "path") -> DataFrame:
    """Size and best item of each group, in one aggregation."""
    return df.groupBy(group.alias("grp")).agg(F.count("*").alias("n"), F.min_by(key, F.struct(-F.col(score), F.col(key))).alias("hero"))


def group_gaps(df: DataFrame, group: Column, name: str, score: str = "aggregate") -> DataFrame:
    """Rows ``name, n, best, second, gap`` of groups of two and more scores, by aggregates alone: the second is the best one's equal if there are several, else the largest below."""
    counts = df.where(F.col(score).isNotNull()).groupBy(group.alias(name), F.col(score).alias("_s")).agg(F.count("*").alias("_k"))
    # of the two largest values, each with its count
    top = counts.groupBy(name).agg(F.sum("_k").alias("n"), F.max(F.struct("_s", "_k")).alias("b"))
    below = counts.join(top.select(name, F.col("b._s").alias("_top")), name).where("_s < _top").groupBy(name).agg(F.max("_s").alias("_next"))
    found = top.where("n >= 2").join(below, name, "left").withColumn("second", F.when(F.col("b._k") > 1, F.col("b._s")).otherwise(F.col("_next")))
    return found.select(name, "n", F.col("b._s").alias("best"), "second", (F.col("b._s") - F.col("second")).alias("gap"))


def top_per_group(df: DataFrame, group: str, n: int, score: str = "aggregate", key: str = "path") -> DataFrame:
    w = W.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(key).asc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def timeline_page(df: DataFrame, limit: int, per_group: int, cursor: str | None = None, older: bool = True) -> DataFrame:
    """The next ``limit`` days before (or after) the cursor with their best items and ``more``, whether other days follow."""
    days = df.withColumn("day", F.date_format("date_taken", DAY))
    if cursor:
        days = days.where(F.col("day") < cursor if older else F.col("day") > cursor)
    found = [r["day"] for r in days.select("day").distinct().orderBy(F.desc("day") if older else F.asc("day")).limit(limit + 1).collect()]
    return top_per_group(days.where(F.col("day").isin(found[:limit])), "day", per_group).withColumn("more", F.lit(len(found) > limit))


def on_this_day(df: DataFrame, month_day: str, before_year: int, per_year: int) -> DataFrame:
    held = df.where((F.date_format("date_taken", "MM-dd") == month_day) & (F.year("date_taken") < before_year)).withColumn("year", F.year("date_taken"))
    return top_per_group(held.withColumn("total", F.count("*").over(W.partitionBy("year"))), "year", per_year)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """A gapless rank over the whole table without one window over it: range partitions, then offsets from their counts."""
    dealt = df.repartitionByRange(4 * shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    held = stash(dealt.withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = held.groupBy("_pid").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return held.join(F.broadcast(first), "_pid").withColumn(name, F.col("_first") + F.col("_at")).drop("_pid", "_at", "_first")


def percentile_rank(df: DataFrame, score: str, key: str = "path", top: float = 10.0) -> DataFrame:
    """Rank by score scaled to 0 to ``top``; the key breaks ties."""
    ranked = global_rank(df, [F.col(score).asc_nulls_first(), F.col(key).asc()])
    count = df.count()
    return ranked.withColumn("percentile", F.lit(top) * F.col("rank") / F.lit(max(1, count - 1)))


def worst_share(df: DataFrame, keep_percent: float, cap: int, score: str = "aggregate", key: str = "path") -> DataFrame:
    """What falls below the best ``keep_percent``: the count kept is rounded up; at most ``cap``, worst first."""
    import math

    total = df.count()
    drop = min(cap, total - math.ceil(total * keep_percent / 100))
    return df.orderBy(F.col(score).asc_nulls_first(), F.col(key).asc()).limit(max(0, drop))


def interleaved(df: DataFrame, kind: str, priority: str, order: list[Column]) -> DataFrame:
    """Round robin across kinds: each kind's first, then each kind's second."""
    turn = F.row_number().over(W.partitionBy(kind).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", priority, kind)


@query("e1_mode_per_key", "SELECT camera, lens, n FROM (SELECT camera, lens, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY camera ORDER BY count(*) DESC, lens) AS rn FROM item GROUP BY 1, 2) WHERE rn = 1")
def _(v):
    return mode_per_key(v.item, "camera", "lens")


@query("e2_group_heroes", "SELECT strftime(date_taken, '%Y-%m') AS grp, count(*)::BIGINT AS n, min_by(path, (-aggregate, path)) AS hero FROM item GROUP BY 1")
def _(v):
    return group_heroes(v.item, F.date_format("date_taken", "yyyy-MM"))


@query("e3_timeline", """SELECT day, path, rn::INTEGER AS rn FROM (SELECT strftime(date_taken, '%Y-%m-%d') AS day, path, row_number() OVER (PARTITION BY strftime(date_taken, '%Y-%m-%d') ORDER BY aggregate DESC NULLS LAST, path) AS rn FROM item
  WHERE strftime(date_taken, '%Y-%m-%d') IN (SELECT DISTINCT strftime(date_taken, '%Y-%m-%d') AS d FROM item WHERE strftime(date_taken, '%Y-%m-%d') < '2000-01-01' ORDER BY d DESC LIMIT 30)) WHERE rn <= 4""")
def _(v):
    return timeline_page(v.item, 30, 4, "2000-01-01").select("day", "path", "rn")


@query("e4_calendar", "SELECT year(date_taken)::INTEGER AS y, month(date_taken)::INTEGER AS m, count(*)::BIGINT AS n, count(DISTINCT date_taken::DATE)::BIGINT AS days, min_by(path, (-aggregate, path)) AS hero FROM item GROUP BY 1, 2")
def _(v):
    return v.item.groupBy(F.year("date_taken").alias("y"), F.month("date_taken").alias("m")).agg(
        F.count("*").alias("n"), F.count_distinct(F.to_date("date_taken")).alias("days"), F.min_by("path", F.struct(-F.col("aggregate"), F.col("path"))).alias("hero")
    )


@query("e5_memories", """SELECT year, path, total, rn::INTEGER AS rn FROM (SELECT year(date_taken)::INTEGER AS year, path, count(*) OVER (PARTITION BY year(date_taken))::BIGINT AS total,
  row_number() OVER (PARTITION BY year(date_taken) ORDER BY aggregate DESC NULLS LAST, path) AS rn FROM item WHERE strftime(date_taken, '%m-%d') = '05-17' AND year(date_taken) < 2000) WHERE rn <= 3""")
def _(v):
    return on_this_day(v.item, "05-17", 2000, 3).select("year", "path", "total", "rn")


@query("e6_offset_page", "SELECT path, aggregate FROM item WHERE status = 'P' ORDER BY aggregate DESC NULLS LAST, path LIMIT 40 OFFSET 80")
def _(v):
    return QuerySpec([F.col("status") == "P"], page=3, per_page=40).rows(v.item).select("path", "aggregate")


@query("e7_sort_nulls", "SELECT path, stars FROM (SELECT path, star_rating AS stars FROM overlay) ORDER BY stars ASC NULLS LAST, path LIMIT 500")
def _(v):
    return v.overlay.select("path", F.col("star_rating").alias("stars")).orderBy(*ordered("stars", False, last_both_ways=("stars",))).limit(500)


@query("e8_bottom_percent", "SELECT path, aggregate FROM item ORDER BY aggregate ASC NULLS FIRST, path LIMIT least(5000, (SELECT count(*) - ceil(count(*) * 85 / 100.0)::BIGINT FROM item))")
def _(v):
    return worst_share(v.item, 85, 5000).select("path", "aggregate")


@query("e10_percentile_rank", "SELECT path, round((row_number() OVER (ORDER BY aesthetic, path) - 1) * 10.0::DOUBLE / greatest(1, count(*) OVER () - 1), 4) AS percentile FROM metric")
def _(v):
    return percentile_rank(v.metric, "aesthetic").select("path", F.round("percentile", 4).alias("percentile"))


@query("e11_group_gap", "SELECT day, n, round(best - second, 4) AS gap FROM (SELECT strftime(captured_at, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, max(aggregate) AS best, list_sort(list(aggregate), 'DESC')[2] AS second FROM shot GROUP BY 1) WHERE n >= 2")
def _(v):
    return group_gaps(v.shot, F.date_format("captured_at", DAY), "day").select("day", "n", F.round("gap", 4).alias("gap"))


@query("e12_union_all", "SELECT 'urgent' AS kind, count(*)::BIGINT AS n FROM item WHERE category = '1-URGENT' UNION ALL SELECT 'open', count(*)::BIGINT FROM item WHERE status = 'O'")
def _(v):
    return v.item.where("category = '1-URGENT'").agg(F.lit("urgent").alias("kind"), F.count("*").alias("n")).unionByName(v.item.where("status = 'O'").agg(F.lit("open").alias("kind"), F.count("*").alias("n")))


@query("e13_union_distinct", "SELECT count(*)::BIGINT AS n FROM (SELECT a_path FROM pref WHERE winner = 'a' UNION SELECT b_path FROM pref WHERE winner = 'a')")
def _(v):
    won = v.pref.where("winner = 'a'")
    return won.select("a_path").union(won.select("b_path")).distinct().agg(F.count("*").alias("n"))


@query("e14_except_delta", "(SELECT path, 'gone' AS side FROM (SELECT path FROM item WHERE path % 3 < 2 EXCEPT SELECT path FROM item WHERE path % 3 > 0)) UNION ALL (SELECT path, 'new' FROM (SELECT path FROM item WHERE path % 3 > 0 EXCEPT SELECT path FROM item WHERE path % 3 < 2))")
def _(v):
    old, new = v.item.where("path % 3 < 2").select("path"), v.item.where("path % 3 > 0").select("path")
    return old.exceptAll(new).withColumn("side", F.lit("gone")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


@query("e15_distinct_in_order", "SELECT camera, list_aggregate(list_transform(list_sort(list(struct_pack(at := first_at, kind := kind))), lambda x: x.kind), 'string_agg', ',') AS kinds FROM (SELECT camera, kind, min(captured_at) AS first_at FROM shot GROUP BY 1, 2) GROUP BY 1")
def _(v):
    first = v.shot.groupBy("camera", "kind").agg(F.min("captured_at").alias("at"))
    return first.groupBy("camera").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


@query("e16_interleave", "SELECT path, category, turn::INTEGER AS turn FROM (SELECT path, category, row_number() OVER (PARTITION BY category ORDER BY aggregate DESC, path) AS turn FROM item) ORDER BY turn, category LIMIT 100")
def _(v):
    return interleaved(v.item, "category", "category", [F.desc("aggregate"), F.asc("path")]).limit(100).select("path", "category", "turn")


@query("e17_person_order", "SELECT s_suppkey AS person, coalesce(best, 0) AS best FROM supplier LEFT JOIN (SELECT l_suppkey, max(aggregate) AS best FROM lineitem JOIN item ON path = l_orderkey GROUP BY 1) ON l_suppkey = s_suppkey ORDER BY best DESC, person LIMIT 20")
def _(v):
    best = v.table("lineitem").join(v.item, F.col("path") == F.col("l_orderkey")).groupBy("l_suppkey").agg(F.max("aggregate").alias("b"))
    people = v.table("supplier").join(best, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(F.col("s_suppkey").alias("person"), F.coalesce("b", F.lit(0.0)).alias("best"))
    return people.orderBy(F.desc("best"), "person").limit(20)


@query("e9_weighted_sample")
def _(v):
    pool = v.item.orderBy(F.desc("aggregate"), "path").limit(200)
    return pool.orderBy(F.xxhash64("path", F.lit(11)), "path").limit(50).select("path", "aggregate")


@query("a1_pruned_scan", "SELECT path, date_taken, aggregate, NULL::INTEGER AS iso FROM item")
def _(v):
    from shelfmark.sources.tables import with_columns

    return with_columns(v.item, {"path": "bigint", "date_taken": "timestamp", "aggregate": "double", "iso": "int"})


@query("a2_media_paths", """SELECT DISTINCT replace(place, '/./', '/') || suffix AS path FROM (SELECT place, unnest(['.JPG', '.html', '.dng']) AS suffix FROM folder) WHERE suffix <> '.html'""")
def _(v):
    named = v.folder.select(F.explode(F.array(*[F.concat(x, F.lit(s)) for s in (".JPG", ".html", ".dng") for x in (F.col("place"), F.concat(F.lit("./"), F.col("place")), F.regexp_replace("place", "/", "/.//"))])).alias("path"))
    return tables.media_paths(named)


@query("a5_metadata_lines", """SELECT path, strftime(date_taken, '%Y:%m:%d 00:00:00') AS taken, CASE WHEN path % 3 <> 0 THEN (path % 7 * 100)::DOUBLE END AS iso, aggregate AS f_stop, '1/' || (path % 9 + 1) AS shutter FROM (SELECT path::VARCHAR AS name, * FROM item)""".replace("SELECT path,", "SELECT name AS path,", 1))
def _(v):
    taken = F.date_format("date_taken", "yyyy:MM:dd 00:00:00")
    fields = F.struct(
        F.col("path").cast("string").alias("SourceFile"), F.when(F.col("path") % 2 == 0, taken).alias("DateTimeOriginal"), taken.alias("CreateDate"), F.when(F.col("path") % 3 != 0, (F.col("path") % 7 * 100).cast("double")).alias("ISO"),
        F.col("aggregate").alias("FNumber"), F.concat(F.lit("1/"), (F.col("path") % 9 + 1).cast("string")).alias("ExposureTime"),
    )
    return tables.parse_metadata(v.item.select(F.to_json(fields).alias("value")))


@query("a7_sidecar_texts", """SELECT path, star_rating AS rating, CASE WHEN is_favorite = 1 THEN 'Select' END AS label, CASE WHEN is_rejected = 1 THEN 'kind,rejected' ELSE 'kind' END AS keywords, '2024-01-' || lpad((path % 28 + 1)::VARCHAR, 2, '0') AS dated FROM overlay""")
def _(v):
    lead = F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:xmp="u:xmp" xmlns:dc="u:dc" xmlns:rdf="u:rdf">')
    words = F.concat(F.lit("<dc:subject><rdf:Bag><rdf:li>kind</rdf:li>"), F.when(F.col("is_rejected") == 1, "<rdf:li>rejected</rdf:li>").otherwise(""), F.lit("</rdf:Bag></dc:subject>"))
    rating = F.when(F.col("star_rating").isNotNull(), F.concat(F.lit("<xmp:Rating>"), F.col("star_rating").cast("string"), F.lit("</xmp:Rating>"))).otherwise("")
    label = F.when(F.col("is_favorite") == 1, "<xmp:Label>Select</xmp:Label>").otherwise("")
    dated = F.concat(F.lit("<xmp:MetadataDate>2024-01-"), F.lpad((F.col("path") % 28 + 1).cast("string"), 2, "0"), F.lit("</xmp:MetadataDate>"))
    texts = v.overlay.select("path", F.concat(lead, rating, label, words, dated, F.lit("</x:xmpmeta>")).alias("x"))
    return tables.parse_sidecars(texts).withColumn("keywords", F.array_join("keywords", ","))


@query("a3_drop_paired_raw", "SELECT file FROM (SELECT 'p' || (path // 2) || CASE path % 4 WHEN 0 THEN '.raw' WHEN 1 THEN '.jpg' WHEN 2 THEN '.raw' ELSE '.png' END AS file FROM item) f WHERE NOT (file LIKE '%.raw' AND regexp_extract(file, '^(.*)\\.', 1) IN (SELECT 'p' || (path // 2) FROM item WHERE path % 4 = 1))")
def _(v):
    from shelfmark.sources.tables import without_paired_raw

    suffix = F.element_at(F.array(F.lit(".raw"), F.lit(".jpg"), F.lit(".raw"), F.lit(".png")), (F.col("path") % 4).cast("int") + 1)
    return without_paired_raw(v.item.select(F.concat(F.lit("p"), F.floor(F.col("path") / 2), suffix).alias("file")))


@query("a4_metadata_parse", "SELECT event_id AS path, CAST(json_extract_string(props, '$.k') AS INTEGER) AS ev, coalesce(json_extract_string(props, '$.at'), strftime(ts, '%Y')) AS taken, CASE WHEN value < 1000 THEN round(value, 3) END AS v FROM events")
def _(v):
    parsed = F.from_json("props", "k int, at string")
    finite = F.when(~F.isnan("value") & (F.abs("value") < 1000), F.round("value", 3))
    return v.table("events").select(F.col("event_id").alias("path"), parsed["k"].alias("ev"), F.coalesce(parsed["at"], F.date_format("ts", "yyyy")).alias("taken"), finite.alias("v"))


@query("a6_vote_means", "SELECT path, round(s / c, 4) AS mos, round((s / c - 1) / 9 * 10, 4) AS score FROM (SELECT l_orderkey AS path, sum((l_linenumber) * l_quantity) AS s, sum(l_quantity) AS c FROM lineitem GROUP BY 1)")
def _(v):
    votes = v.table("lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("mark"), F.col("l_quantity").alias("n"))).alias("votes"))
    total = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x["mark"] * x["n"])
    count = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x["n"])
    return votes.select("path", F.round(total / count, 4).alias("mos"), F.round((total / count - 1) / 9 * 10, 4).alias("score"))


@query("a8_export_rows", "SELECT path, category, camera, lens, aggregate FROM item ORDER BY aggregate DESC, path LIMIT 1000")
def _(v):
    return v.item.orderBy(F.desc("aggregate"), "path").limit(1000).select("path", "category", "camera", "lens", "aggregate")


@query("a9_nested_export", "SELECT path, to_json({'aggregate': aggregate::VARCHAR, 'aesthetic': aesthetic::VARCHAR}) AS scores FROM scored WHERE category = '2-HIGH'")
def _(v):
    text = lambda c: F.col(c).cast("string")
    return v.scored.where("category = '2-HIGH'").select("path", F.to_json(F.struct(text("aggregate").alias("aggregate"), text("aesthetic").alias("aesthetic"))).alias("scores"))


@query("a10_rating_rows", "SELECT o.path, o.star_rating, o.is_favorite FROM overlay o WHERE o.path IN (SELECT path FROM shot WHERE aggregate >= 5 AND kind = 'purchase')")
def _(v):
    return v.overlay.join(v.shot.where("aggregate >= 5 and kind = 'purchase'"), "path", "left_semi").select("path", "star_rating", "is_favorite")


@query("a11_sidecar_payload", "SELECT l_orderkey AS path, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS people FROM lineitem GROUP BY 1")
def _(v):
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("people"))


@query("a12_serving_copy", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0)")
def _(v):
    source = v.vec.drop("embedding")
    return source.join(source.where("vec_id % 4 = 0"), "vec_id", "left_anti")


@query("a13_sync_delta", """SELECT coalesce(n.path, o.path) AS path, coalesce(n.r, 0) AS rating FROM (SELECT path, greatest(star_rating, is_favorite * 5) AS r FROM overlay WHERE path % 2 = 0 AND (star_rating > 0 OR is_favorite = 1)) n
  FULL JOIN (SELECT path, star_rating AS r FROM overlay WHERE star_rating > 0) o ON n.path = o.path WHERE n.r IS DISTINCT FROM o.r""")
def _(v):
    now = v.overlay.where("path % 2 = 0 and (star_rating > 0 or is_favorite = 1)").select("path", F.greatest("star_rating", F.col("is_favorite") * 5).alias("r"))
    before = v.overlay.where("star_rating > 0").select("path", F.col("star_rating").alias("old"))
    return now.join(before, "path", "full").where(~F.col("r").eqNullSafe(F.col("old"))).select("path", F.coalesce("r", F.lit(0)).alias("rating"))


@query("a14_longest_prefix", "SELECT path, arg_max(target, length(prefix)) AS target FROM folder JOIN (VALUES ('th', 'T'), ('thr', 'R'), ('b', 'B')) m(prefix, target) ON starts_with(place, prefix) GROUP BY path")
def _(v):
    from shelfmark.sources.tables import map_by_prefix

    return map_by_prefix(v.folder, "place", {"th": "T", "thr": "R", "b": "B"}).select("path", "target")


@query("a15_unscanned", "SELECT o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(v):
    return v.item.select("path").join(v.metric, "path", "left_anti")


@query("a16_scanned_before", "SELECT path FROM item WHERE path NOT IN (SELECT path FROM item WHERE date_taken >= TIMESTAMP '1999-01-01')")
def _(v):
    return v.item.select("path").join(v.item.where("date_taken >= timestamp'1999-01-01'"), "path", "left_anti")


@query("a17_scanned_since", "SELECT path FROM item WHERE NOT (date_taken >= TIMESTAMP '1999-01-01' AND status = 'O')")
def _(v):
    return v.item.select("path").join(v.item.where("date_taken >= timestamp'1999-01-01' and status = 'O'"), "path", "left_anti")


@query("a18_failed_paths", "SELECT DISTINCT path FROM shot WHERE kind = 'error' AND camera = (SELECT max(camera) FROM shot WHERE kind = 'error')")
def _(v):
    failed = v.shot.where("kind = 'error'")
    return failed.join(F.broadcast(failed.agg(F.max("camera").alias("camera"))), "camera", "left_semi").select("path").distinct()


@query("a19_resumable_run", "SELECT camera AS run, strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS beat FROM shot GROUP BY 1 HAVING max(captured_at) < TIMESTAMP '2024-01-28 20:00:00' ORDER BY max(captured_at) DESC, run LIMIT 1")
def _(v):
    runs = v.shot.groupBy(F.col("camera").alias("run")).agg(F.max("captured_at").alias("b")).where("b < timestamp'2024-01-28 20:00:00'")
    return runs.orderBy(F.desc("b"), "run").limit(1).select("run", F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("beat"))
