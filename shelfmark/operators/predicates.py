"""Filters and joins of the catalogue (groups B and C)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.plans.query_spec import QuerySpec, composite, ranges
from shelfmark.registry import query
from shelfmark.runtime import shuffle_width

#: Hues in degrees, from the first edge up to, without, the second. Fixed values.
HUES = {
    "red": [(0, 15), (345, 360)], "orange": [(15, 45)], "yellow": [(45, 70)], "green": [(70, 165)], "cyan": [(165, 195)], "blue": [(195, 255)], "purple": [(255, 300)], "magenta": [(300, 345)],
}


def starts_with(column: str, prefix: str) -> Column:
    """Case-insensitive prefix; a prefix cut at U+FFFD is compared up to there."""
    return F.lower(F.col(column)).startswith(prefix.split("�")[0].lower())


def with_tags(items: DataFrame, tags: DataFrame, any_of: list[str] = (), all_of: list[str] = (), none_of: list[str] = (), key: str = "path") -> DataFrame:
    """Items by tags, by semi and anti joins."""
    out = items
    if any_of:
        out = out.join(tags.where(F.col("tag").isin(*any_of)), key, "left_semi")
    for tag in all_of:
        out = out.join(tags.where(F.col("tag") == tag), key, "left_semi")
    if none_of:
        out = out.join(tags.where(F.col("tag").isin(*none_of)), key, "left_anti")
    return out


def hue_bucket(column: str, name: str) -> Column:
    return reduce(or_, [(F.col(column) >= a) & (F.col(column) < b) for a, b in HUES[name]])


def hue_name(column: str) -> Column:
    out = F.lit(None).cast("string")
    for name in HUES:
        out = F.when(hue_bucket(column, name), name).otherwise(out)
    return out


def visible_flag(flag: Column, group: Column) -> Column:
    """Leads and rows without a group or a flag stay visible."""
    return (flag == 1) | flag.isNull() | group.isNull()


def tier_bounds(column: str, cuts: list[float], tier: int) -> Column:
    """Tier 0 lies below the first cut; bounds are half open."""
    low = F.col(column) >= cuts[tier - 1] if tier else F.lit(True)
    return low & (F.col(column) < cuts[tier]) if tier < len(cuts) else low


def box_around(lat: float, lon: float, km: float) -> Column:
    """A box in degrees, wider in longitude away from the equator."""
    import math

    d = km / 111.0
    wide = d / max(0.01, math.cos(math.radians(lat)))
    return F.col("lat").between(lat - d, lat + d) & F.col("lon").between(lon - wide, lon + wide)


def in_bounds(south: float, west: float, north: float, east: float) -> Column:
    """Map bounds; west beyond east means that the box crosses the antimeridian."""
    across = (F.col("lon") >= west) | (F.col("lon") <= east) if west > east else F.col("lon").between(west, east)
    return F.col("lat").between(south, north) & across


def path_prefix(column: str, prefix: str) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.col(column), "\\\\", "/"), "/+", "/")
    return plain.startswith(prefix.rstrip("/") + "/")


def visible_to(df: DataFrame, grants: DataFrame, user: int, column: str = "place") -> DataFrame:
    """Rows below any directory granted to the user; no grant, no rows.

    A row's beginning of each length that the user's grants have meets the grants by equality; so there is no comparison of each row with each grant, however many there are.
    """
    own = grants.where((F.col("user_id") == user) & F.col("prefix").isNotNull()).select("prefix").distinct()
    lengths = [r["n"] for r in own.select(F.length("prefix").alias("n")).distinct().collect()]  # as many as prefixes have lengths
    if not lengths:
        return df.limit(0)
    out = df
    for n in lengths:
        granted = own.where(F.length("prefix") == n).withColumnRenamed("prefix", f"_p{n}")
        out = out.join(granted, F.when(F.length(column) >= n, F.substring(column, 1, n)) == F.col(f"_p{n}"), "left")
    return out.where(F.coalesce(*[F.col(f"_p{n}") for n in lengths]).isNotNull()).drop(*[f"_p{n}" for n in lengths])


def matches_rule(rule: dict) -> Column:
    """Numeric bounds, exact values and tags; a null fails a bound.

    ``any_tags`` and ``all_tags`` must be among the row's ``tags`` (an array of strings, null for none), ``excluded_tags`` must not; case doesn't count.
    """
    parts = [F.coalesce(F.col(k[4:]) >= v, F.lit(False)) for k, v in rule.items() if k.startswith("min_")]
    parts += [F.coalesce(F.col(k[4:]) <= v, F.lit(False)) for k, v in rule.items() if k.startswith("max_")]
    parts += [F.coalesce(F.col(k[3:]) == v, F.lit(False)) for k, v in rule.items() if k.startswith("is_")]
    if any(k in rule for k in ("any_tags", "all_tags", "excluded_tags")):
        own = F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
        has = lambda names: [F.coalesce(F.array_contains(own, n.lower()), F.lit(False)) for n in names]
        parts += [reduce(or_, has(rule["any_tags"]))] if rule.get("any_tags") else []
        parts += has(rule.get("all_tags", []))
        parts += [~x for x in has(rule.get("excluded_tags", []))]
    return reduce(and_, parts, F.lit(True))


def first_failure(rule: dict) -> Column:
    """The first key of the rule that a row fails, else null."""
    return F.coalesce(*[F.when(~matches_rule({k: v}), F.lit(k)) for k, v in rule.items()], F.lit(None).cast("string"))


def suggest_bounds(rule: dict, margin: float = 0.1) -> list[Column]:
    """For each bound that a row fails, the bound that would let it in, with a margin."""
    out = []
    for k, v in rule.items():
        value = F.col(k[4:])
        moved = value * (1 - margin) if k.startswith("min_") else value * (1 + margin)
        out.append(F.struct(F.lit(k).alias("bound"), F.lit(float(v)).alias("old"), F.when(~matches_rule({k: v}), moved).alias("new")))
    return out


def like_any(columns: list[str], term: str) -> Column:
    """A case-insensitive substring in any of the columns; wildcards in the term stand for themselves."""
    held = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(or_, [F.col(c).ilike(f"%{held}%") for c in columns])


def member_of(items: DataFrame, members: DataFrame, key: str = "path") -> DataFrame:
    return items.join(members, key, "left_semi")


def top_pick_score() -> Column:
    """Portraits weigh the face terms, other items the composition."""
    with_face = 0.4 * F.col("aggregate") + 0.3 * F.col("aesthetic") + 0.3 * F.col("tech_sharpness")
    return F.when(F.col("exposure") >= 5, with_face).otherwise(0.5 * F.col("aggregate") + 0.3 * F.col("aesthetic") + 0.2 * F.col("comp_score"))


@query("b1_composite_filter", "SELECT path, aggregate FROM scored WHERE aggregate >= 3 AND tech_sharpness <= 6 AND camera = 'BUILDING' AND category = '1-URGENT'")
def _(v):
    params = {"type": "1-URGENT", "min_aggregate": "3", "max_tech_sharpness": 6, "min_exposure": "bad", "camera": "BUILDING"}
    return QuerySpec(composite(params, ["aggregate", "tech_sharpness", "exposure"], ["camera", "category"])).where(v.scored).select("path", "aggregate")


@query("b2_range_filters", "SELECT path, aesthetic, comp_score FROM metric WHERE aesthetic >= 4 AND aesthetic <= 6 AND comp_score >= 2.5")
def _(v):
    return QuerySpec(ranges({"min_aesthetic": 4, "max_aesthetic": "6", "min_comp_score": 2.5, "max_comp_score": "nan"}, ["aesthetic", "comp_score"])).where(v.metric).select("path", "aesthetic", "comp_score")


@query("b3_equality_filters", "SELECT path, lens FROM item WHERE camera = 'MACHINERY' AND status = 'O' AND lens IS NOT NULL")
def _(v):
    return v.item.where((F.col("camera") == "MACHINERY") & (F.col("status") == "O") & F.col("lens").isNotNull()).select("path", "lens")


@query("b4_lens_prefix", "SELECT path, lens FROM item WHERE lens ILIKE 'nation_1%' ESCAPE '\\' AND lower(lens) LIKE 'nation%'")
def _(v):
    return v.item.where(F.col("lens").rlike("(?i)^nation.1")).where(starts_with("lens", "NATION�x")).select("path", "lens")


@query("b5_tag_filters", """SELECT path, aggregate FROM item WHERE path IN (SELECT path FROM item_tag WHERE tag IN ('red', 'blue')) AND path IN (SELECT path FROM item_tag WHERE tag = 'widget')
  AND path NOT IN (SELECT path FROM item_tag WHERE tag IN ('bolt', 'ring'))""")
def _(v):
    return with_tags(v.item, v.item_tag, ["red", "blue"], ["widget"], ["bolt", "ring"]).select("path", "aggregate")


@query("b6_all_persons", "SELECT l_orderkey AS path FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_suppkey % 10 = 1) > 0 AND count(*) FILTER (l_suppkey % 10 = 2) > 0")
def _(v):
    faces = v.table("lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_suppkey") % 10).alias("person"))
    out = faces.select("path").distinct()
    for person in (1, 2):
        out = out.join(faces.where(F.col("person") == person), "path", "left_semi")
    return out


@query("b7_junk_filter", "SELECT path, kind FROM shot WHERE kind IS NOT NULL AND kind <> 'view' AND kind = 'error'")
def _(v):
    return v.shot.where(F.col("kind").isNotNull() & (F.col("kind") != "view") & (F.col("kind") == "error")).select("path", "kind")


@query("b8_override_filter", "SELECT path FROM shot WHERE path IN (SELECT event_id FROM events WHERE value > 100)")
def _(v):
    forced = v.table("events").where("value > 100").select(F.col("event_id").alias("path"))
    return v.shot.join(forced, "path", "left_semi").select("path")


@query("b9_quality_tiers", "SELECT path, CASE WHEN aggregate < 2 THEN 0 WHEN aggregate < 4 THEN 1 WHEN aggregate < 6 THEN 2 ELSE 3 END AS tier FROM item")
def _(v):
    tier = F.lit(None).cast("int")
    for t in range(4):
        tier = F.when(tier_bounds("aggregate", [2, 4, 6], t), t).otherwise(tier)
    return v.item.select("path", tier.alias("tier"))


@query("b10_hue_buckets", """SELECT bucket, count(*)::BIGINT AS n FROM (SELECT CASE WHEN h >= 345 OR h < 15 THEN 'red' WHEN h < 45 THEN 'orange' WHEN h < 70 THEN 'yellow' WHEN h < 165 THEN 'green'
  WHEN h < 195 THEN 'cyan' WHEN h < 255 THEN 'blue' WHEN h < 300 THEN 'purple' ELSE 'magenta' END AS bucket FROM (SELECT path % 360 AS h FROM item)) GROUP BY bucket""")
def _(v):
    return v.item.select((F.col("path") % 360).alias("h")).groupBy(hue_name("h").alias("bucket")).agg(F.count("*").alias("n"))


@query("b11_hide_toggles", "SELECT path FROM (SELECT path, nullif(ev % 3, 2) AS flag, nullif(camera % 4, 0) AS grp FROM shot) WHERE flag = 1 OR flag IS NULL OR grp IS NULL")
def _(v):
    flags = v.shot.select("path", F.nullif(F.col("ev") % 3, F.lit(2)).alias("flag"), F.nullif(F.col("camera") % 4, F.lit(0)).alias("grp"))
    return flags.where(visible_flag(F.col("flag"), F.col("grp"))).select("path")


@query("b12_preferences", """SELECT s.path, coalesce(o.star_rating, 0) AS stars, coalesce(o.is_favorite, 0) AS favorite FROM shot s LEFT JOIN overlay o ON o.path = s.path
  WHERE coalesce(o.star_rating, 0) >= 1 AND coalesce(o.is_rejected, 0) = 0""")
def _(v):
    joined = v.shot.join(v.overlay, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.where((zero("star_rating") >= 1) & (zero("is_rejected") == 0)).select("path", zero("star_rating").alias("stars"), zero("is_favorite").alias("favorite"))


@query("b13_date_range", "SELECT path, strftime(date_taken, '%Y-%m-%d') AS day FROM item WHERE date_taken::DATE BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'")
def _(v):
    day = F.to_date("date_taken")
    return v.item.where(day.between("1996-03-01", "1996-06-30")).select("path", F.date_format("date_taken", "yyyy-MM-dd").alias("day"))


@query("b14_album_membership", "SELECT path, aggregate FROM item WHERE path IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def _(v):
    return member_of(v.item, v.table("lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("path"))).select("path", "aggregate")


@query("b15_gps_radius", "SELECT path FROM geo WHERE lat BETWEEN 21.0 - 3000 / 111.0 AND 21.0 + 3000 / 111.0 AND lon BETWEEN 0.3 - (3000 / 111.0) / cos(radians(21.0)) AND 0.3 + (3000 / 111.0) / cos(radians(21.0))")
def _(v):
    return v.geo.where(box_around(21.0, 0.3, 3000)).select("path")


@query("b16_path_prefix", "SELECT path, place FROM folder WHERE starts_with(regexp_replace(replace(place, '\\', '/'), '/+', '/', 'g'), 'ththre.example.com/')")
def _(v):
    return v.folder.where(path_prefix("place", "ththre.example.com")).select("path", "place")


@query("b17_visibility", "SELECT path FROM folder WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT substr(place, 1, 3) AS prefix FROM folder WHERE path % 10 = 3) g WHERE starts_with(folder.place, g.prefix))")
def _(v):
    grants = v.folder.select((F.col("path") % 10).alias("user_id"), F.substring("place", 1, 3).alias("prefix"))
    return visible_to(v.folder, grants, 3).select("path")


@query("b18_top_picks", """SELECT path, round(s, 9) AS score FROM (SELECT path, CASE WHEN exposure >= 5 THEN 0.4 * aggregate + 0.3 * aesthetic + 0.3 * tech_sharpness
  ELSE 0.5 * aggregate + 0.3 * aesthetic + 0.2 * comp_score END AS s FROM scored) WHERE s >= 6.01234567""")
def _(v):
    return v.scored.select("path", top_pick_score().alias("s")).where("s >= 6.01234567D").select("path", F.round("s", 9).alias("score"))


@query("b19_type_presets", "SELECT path FROM scored WHERE tech_sharpness >= 6 AND aggregate <= 9")
def _(v):
    return QuerySpec(composite({"type": "sharp", "max_aggregate": 9}, ["aggregate", "tech_sharpness"], ["category"])).where(v.scored).select("path")


@query("b20_map_bounds", "SELECT path FROM geo WHERE lat BETWEEN -60 AND 60 AND (lon >= 100 OR lon <= -100)")
def _(v):
    return v.geo.where(in_bounds(-60, 100, 60, -100)).select("path")


@query("b21_curated", "SELECT path FROM scored WHERE aggregate >= 5 AND category IN ('1-URGENT', '2-HIGH') AND aesthetic IS NOT NULL AND status <> 'F'")
def _(v):
    return v.scored.where((F.col("aggregate") >= 5) & F.col("category").isin("1-URGENT", "2-HIGH") & F.col("aesthetic").isNotNull() & (F.col("status") != "F")).select("path")


RULE = {"min_aesthetic": 4.5, "max_exposure": 6.0, "is_camera": "BUILDING"}


@query("b22_rule_matcher", """SELECT path, coalesce(aesthetic >= 4.5 AND exposure <= 6.0 AND camera = 'BUILDING', false) AS matched,
  CASE WHEN NOT coalesce(aesthetic >= 4.5, false) THEN 'min_aesthetic' WHEN NOT coalesce(exposure <= 6.0, false) THEN 'max_exposure' WHEN NOT coalesce(camera = 'BUILDING', false) THEN 'is_camera' END AS failed FROM scored""")
def _(v):
    return v.scored.select("path", matches_rule(RULE).alias("matched"), first_failure(RULE).alias("failed"))


TAG_RULE = {"min_aggregate": 2.0, "any_tags": ["Bolt", "gear"], "all_tags": ["small"], "excluded_tags": ["red"]}


@query("b22_tag_rules", """WITH t AS (SELECT path, list(tag) AS tags FROM item_tag GROUP BY 1), r AS (SELECT i.path, aggregate, coalesce(tags, []) AS tags FROM item i LEFT JOIN t ON t.path = i.path),
  c AS (SELECT path, coalesce(aggregate >= 2.0, false) AS a, list_contains(tags, 'bolt') OR list_contains(tags, 'gear') AS b, list_contains(tags, 'small') AS c, NOT list_contains(tags, 'red') AS d FROM r)
  SELECT path, a AND b AND c AND d AS matched, CASE WHEN NOT a THEN 'min_aggregate' WHEN NOT b THEN 'any_tags' WHEN NOT c THEN 'all_tags' WHEN NOT d THEN 'excluded_tags' END AS failed FROM c""")
def _(v):
    tagged = v.item.join(v.item_tag.groupBy("path").agg(F.collect_set("tag").alias("tags")), "path", "left")
    return tagged.select("path", matches_rule(TAG_RULE).alias("matched"), first_failure(TAG_RULE).alias("failed"))


@query("b23_filter_suggestions", """SELECT path, bound, old, round(new, 4) AS new FROM (
  SELECT path, 'min_aesthetic' AS bound, 4.5::DOUBLE AS old, CASE WHEN NOT aesthetic >= 4.5 THEN aesthetic * 0.9 END AS new FROM metric UNION ALL
  SELECT path, 'max_exposure', 6.0::DOUBLE, CASE WHEN NOT exposure <= 6.0 THEN exposure * 1.1 END FROM metric) WHERE new IS NOT NULL""")
def _(v):
    rule = {k: RULE[k] for k in ("min_aesthetic", "max_exposure")}
    rows = v.metric.select("path", F.explode(F.array(*suggest_bounds(rule))).alias("s")).select("path", "s.*").where("new is not null")
    return rows.withColumn("new", F.round("new", 4))


@query("b24_person_search", "SELECT s_suppkey AS person, s_name AS name FROM supplier WHERE (s_suppkey = 42 OR s_name ILIKE '%0042%') AND s_acctbal IS NOT NULL AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)")
def _(v):
    term = "0042"
    people = v.table("supplier").where((F.col("s_suppkey") == int(term)) | like_any(["s_name"], term)).where("s_acctbal is not null")
    return people.join(v.table("lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"))


@query("b25_album_list", "SELECT c_custkey AS album, c_name AS name, coalesce(n, 0)::BIGINT AS members FROM customer LEFT JOIN (SELECT owner, count(*) AS n FROM item GROUP BY owner) i ON owner = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%1%' ORDER BY members DESC, album LIMIT 25")
def _(v):
    counts = v.item.groupBy("owner").agg(F.count("*").alias("n"))
    albums = v.table("customer").where((F.col("c_mktsegment") == "BUILDING") & like_any(["c_name"], "1"))
    out = albums.join(counts, F.col("owner") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("album"), F.col("c_name").alias("name"), F.coalesce("n", F.lit(0)).alias("members"))
    return out.orderBy(F.desc("members"), "album").limit(25)


@query("b26_like_search", "SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%' OR lang ILIKE '%license%'")
def _(v):
    return v.table("documents").where(like_any(["text", "source", "lang"], "license")).select("doc_id")


@query("c1_left_overlay", "SELECT s.path, o.star_rating, o.is_favorite FROM shot s LEFT JOIN overlay o ON o.path = s.path AND o.user_id = s.camera")
def _(v):
    return v.shot.join(v.overlay.withColumnRenamed("user_id", "camera"), ["path", "camera"], "left").select("path", "star_rating", "is_favorite")


@query("c2_three_way", "SELECT s_name AS person, p_name AS item, count(*)::BIGINT AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def _(v):
    joined = v.table("lineitem").join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(v.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy(F.col("s_name").alias("person"), F.col("p_name").alias("item")).agg(F.count("*").alias("n"))


#: Pairs that a task counts at once, on the average.
PAIRS_A_TASK = 1_000_000


def co_appearing(members: DataFrame, group: str, member: str) -> DataFrame:
    """Unordered pairs within a group with their number of shared groups; groups are single items, so they are small.

    Groups and pairs are dealt to so many tasks that each has about ``PAIRS_A_TASK`` pairs, whatever the table's size; tasks pass on their counts of pairs.
    """
    rows = members.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g is not null and m is not null")
    pairs = rows.groupBy("g").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
    tasks = max(shuffle_width(members.sparkSession), int(pairs // PAIRS_A_TASK) + 1)
    dealt = rows.withColumn("p", F.pmod(F.xxhash64("g"), F.lit(16 * tasks))).repartition(tasks, "p")
    sets = dealt.groupBy("p", "g").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    once = sets.select("p", "ms", F.posexplode("ms").alias("at", "a")).select("p", "a", F.explode(F.slice("ms", F.col("at") + 2, F.size("ms"))).alias("b"))
    counts = once.groupBy("p", "a", "b").agg(F.count("*").alias("n"))
    return counts.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("together"))


@query("c3_co_appearance", """SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*)::BIGINT AS together FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a
  JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 12""")
def _(v):
    return co_appearing(v.table("lineitem"), "l_orderkey", "l_suppkey").where("together >= 12")


@query("c4_semi_join", "SELECT path FROM item WHERE EXISTS (SELECT 1 FROM item_tag t WHERE t.path = item.path AND tag = 'gear')")
def _(v):
    return v.item.join(v.item_tag.where("tag = 'gear'"), "path", "left_semi").select("path")


@query("c5_anti_join", "SELECT path FROM item WHERE NOT EXISTS (SELECT 1 FROM item_tag t WHERE t.path = item.path)")
def _(v):
    return v.item.join(v.item_tag, "path", "left_anti").select("path")


@query("c6_pair_sides", "SELECT a_path, b_path, winner, a.aggregate AS a_score, b.aggregate AS b_score FROM pref LEFT JOIN shot a ON a.path = a_path LEFT JOIN shot b ON b.path = b_path WHERE source = 'vote'")
def _(v):
    side = lambda s: v.shot.select(F.col("path").alias(f"{s}_path"), F.col("aggregate").alias(f"{s}_score"))
    return v.pref.where("source = 'vote'").join(side("a"), "a_path", "left").join(side("b"), "b_path", "left").select("a_path", "b_path", "winner", "a_score", "b_score")


@query("c7_scalar_lookup", "SELECT path, (SELECT star_rating FROM overlay o WHERE o.path = s.path) AS stars FROM shot s WHERE kind = 'click'")
def _(v):
    return v.shot.where("kind = 'click'").join(v.overlay.select("path", F.col("star_rating").alias("stars")), "path", "left").select("path", "stars")


@query("c8_top_of_cell", "SELECT round(lat / 10) AS cell, min_by(path, (-score, path)) AS best FROM geo GROUP BY 1")
def _(v):
    return v.geo.groupBy(F.round(F.col("lat") / 10).alias("cell")).agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("best"))


@query("c9_stored_vs_actual", "SELECT path, n_parts % 5 AS stored, n AS actual FROM metric JOIN (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) ON l_orderkey = path WHERE n_parts % 5 <> n")
def _(v):
    actual = v.table("lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("actual"))
    return v.metric.select("path", (F.col("n_parts") % 5).alias("stored")).join(actual, "path", "left").where("stored <> actual")


@query("c11_match_by_stem", "SELECT doc_id, quality FROM (SELECT doc_id || '.jpg' AS file FROM documents) f JOIN labels l ON try_cast(regexp_extract(file, '^([^.]+)', 1) AS BIGINT) = l.doc_id")
def _(v):
    files = v.table("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"))
    stem = F.regexp_extract("file", "^([^.]+)", 1).try_cast("bigint")
    return files.select(stem.alias("doc_id")).join(v.table("labels"), "doc_id").select("doc_id", "quality")


@query("c12_seed_window", "SELECT s.path AS seed, count(*)::BIGINT AS near FROM shot s JOIN shot o ON o.captured_at BETWEEN s.captured_at - INTERVAL 1 DAY AND s.captured_at + INTERVAL 1 DAY AND o.path <> s.path WHERE s.path % 500 = 0 GROUP BY 1")
def _(v):
    from shelfmark.operators.scans import near_counts

    return near_counts(v.shot.where("path % 500 = 0"), v.shot, 86400).select("seed", "near")
