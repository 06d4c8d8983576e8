"""Themed collections (group N) and table mutations as jobs (group O)."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.functions.scalars import season, short_id
from shelfmark.operators.browse import top_per_group
from shelfmark.operators.predicates import co_appearing, hue_name
from shelfmark.operators.similarity import ALIKE, REACHED
from shelfmark.operators.vectors import alike_components
from shelfmark.plans.query_spec import QuerySpec, composite
from shelfmark.registry import query
from shelfmark.runtime import forget, stash


def sets_by(df: DataFrame, key: Column, least: int, most: int, score: str = "aggregate") -> DataFrame:
    """Rows ``name, path, rank``: the best items of each group that is large enough."""
    named = df.withColumn("name", key).where("name is not null")
    big = named.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return top_per_group(named.join(big, "name"), "name", most, score).select("name", "path", F.col("rn").alias("rank"), "n")


#: The least count of a set in each dimension. Fixed values where the dimension is of the catalogue; others have 8.
DIMENSIONS = {
    "year": 20, "month": 8, "week": 8, "weekday": 20, "weekend": 20, "season": 10, "quarter": 15, "day": 3, "decade": 20, "camera": 15, "lens": 10, "category": 10, "status": 20, "band": 10,
    "star": 10, "hue": 10, "initial": 10, "owner": 3, "gear": 8,
}


def dimension(name: str) -> Column:
    """The key expression of a dimension; null where a row has none."""
    taken = F.col("date_taken")
    return {
        "year": lambda: F.date_format(taken, "yyyy"), "month": lambda: F.date_format(taken, "yyyy-MM"), "week": lambda: F.date_format(F.date_trunc("week", taken), "yyyy-MM-dd"), "weekday": lambda: (F.dayofweek(taken) - 1).cast("string"),
        "weekend": lambda: F.when(F.dayofweek(taken).isin(1, 7), "weekend").when(taken.isNotNull(), "workday"), "season": lambda: season("date_taken"), "quarter": lambda: F.concat_ws("-", F.date_format(taken, "yyyy"), F.quarter(taken).cast("string")),
        "day": lambda: F.date_format(taken, "yyyy-MM-dd"), "decade": lambda: (F.floor(F.year(taken) / 10) * 10).cast("string"), "camera": lambda: F.col("camera"), "lens": lambda: F.col("lens"), "category": lambda: F.col("category"), "status": lambda: F.col("status"),
        "band": lambda: F.floor("aggregate").cast("string"), "star": lambda: F.least(F.lit(5), F.floor(F.col("aggregate") / 2 + 0.5)).cast("string"), "hue": lambda: hue_name("hue"), "initial": lambda: F.substring("lens", 1, 1),
        "owner": lambda: F.col("owner").cast("string"), "gear": lambda: F.concat_ws(" / ", "camera", "lens"),
    }[name]()


def dimension_sets(df: DataFrame, names: list[str], least: int) -> DataFrame:
    """Counts and best item of every value of every dimension, in one pass over exploded keys."""
    keys = F.array(*[F.struct(F.lit(n).alias("dim"), dimension(n).alias("value")) for n in names])
    rows = df.select("path", "aggregate", F.inline(keys)).where("value is not null")
    return rows.groupBy("dim", "value").agg(F.count("*").alias("n"), F.min_by("path", F.struct(-F.col("aggregate"), F.col("path"))).alias("best")).where(F.col("n") >= least)


#: Dimensions that the same columns decide; any other one decides itself, as a column of its name behind ``_``.
DECIDED = {
    ("date_taken",): ("year", "month", "week", "weekday", "weekend", "season", "quarter", "day", "decade"), ("camera", "lens"): ("camera", "lens", "initial", "gear"),
    ("_band", "_star"): ("band", "star"),
}


def dimension_members(df: DataFrame, least: dict[str, int] | None = None, most: int = 40) -> DataFrame:
    """Rows ``dim, value, n, path, rank``: the best ``most`` items of every value of every dimension that has enough items, all dimensions in one pass.

    An item is ranked once for all dimensions that the same columns decide, in the finest sets of these, such as days; only their best and their counts go on to months and years.
    """
    least = least or DIMENSIONS
    decided = {n: columns for columns, names in DECIDED.items() for n in names}
    groups: dict[tuple[str, ...], list[str]] = {}
    for n in least:
        groups.setdefault(decided.get(n, (f"_{n}",)), []).append(n)
    finest = ["_of", "_k0", "_k1"]

    def decider(name: str) -> Column:
        return F.to_date(name) if name == "date_taken" else dimension(name[1:]) if name[0] == "_" else F.col(name)

    def members(sets: DataFrame, *kept: str) -> DataFrame:
        """The finest sets' rows as rows of each dimension."""
        own = {c: F.when(F.col("_of") == k, F.col(f"_k{at}")).cast("date" if c == "date_taken" else "string") for k, columns in enumerate(groups) for at, c in enumerate(columns)}
        value = lambda n: F.col(f"_{n}") if f"_{n}" in own else dimension(n)
        keys = [F.when(F.col("_of") == k, F.array(*[F.struct(F.lit(n).alias("dim"), value(n).alias("value"), F.lit(least[n]).alias("_least")) for n in names])) for k, names in enumerate(groups.values())]
        return sets.withColumns(own).select(*kept, F.inline(F.coalesce(*keys))).where("value is not null")

    slots = [F.struct(F.lit(k).alias("_of"), *[(decider(columns[at]) if at < len(columns) else F.lit(None)).cast("string").alias(f"_k{at}") for at in (0, 1)]) for k, columns in enumerate(groups)]
    rows = df.select("path", "aggregate", F.inline(F.array(*slots)))

    def best(sets: DataFrame, by: list[str]) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("aggregate").desc_nulls_last(), F.col("path").asc()))
        return sets.withColumn("rank", rank).where(F.col("rank") <= most)  # tasks pass on their first ranks alone

    found = best(members(best(rows, finest), "path", "aggregate"), ["dim", "value"])
    counts = members(rows.groupBy(*finest).agg(F.count("*").alias("n")), "n")
    sizes = counts.groupBy("dim", "value").agg(F.sum("n").alias("n"), F.first("_least").alias("_l")).where(F.col("n") >= F.col("_l")).drop("_l")
    return found.drop("aggregate", "_least").join(sizes, ["dim", "value"]).select("dim", "value", "n", "path", "rank")


#: Dimensions that the month of a date decides, and the most combinations of keys that are counted as one.
MONTHLY, BLOCK_CELLS = ("year", "month", "season", "quarter", "decade"), 100


def _crossings(counts: dict[str, int], wanted: set[frozenset[str]]) -> dict[tuple[str, ...], set[frozenset[str]]]:
    """Sets of keys, each with the wanted pairs that it counts: keys of few values share a block, and any two blocks make a set, so there are never more sets than pairs."""
    blocks: list[list[str]] = []
    sizes: list[int] = []
    for key in sorted(counts, key=lambda k: (-counts[k], k)):
        at = next((i for i, size in enumerate(sizes) if size * counts[key] <= BLOCK_CELLS), None)
        if at is None:
            blocks, sizes = [*blocks, [key]], [*sizes, counts[key]]
        else:
            blocks[at].append(key)
            sizes[at] *= counts[key]
    unions = [(*x, *y) for i, x in enumerate(blocks) for y in blocks[i + 1 :]] or [tuple(blocks[0])]
    out: dict[tuple[str, ...], set[frozenset[str]]] = {}
    for pair in wanted:
        out.setdefault(next(u for u in unions if pair <= set(u)), set()).add(pair)
    return out


def crossed_sets(df: DataFrame, pairs: list[tuple[str, str]], least: int) -> DataFrame:
    """Rows ``one, two, a, b, n, best``: counts and best item of every pair of values, for all pairs of dimensions.

    An item is counted in a few sets of many dimensions, not in each pair; only the sets' counts and largest scores go on to the pairs. A second pass looks for the items of the scores that won.
    """
    from shelfmark.operators.scans import few

    key = lambda n: "date_taken" if n in MONTHLY else f"_{n}"
    value = lambda n: dimension(n) if n in MONTHLY else F.col(f"_{n}")
    of = {key(n): F.trunc("date_taken", "month") if n in MONTHLY else dimension(n) for p in pairs for n in p}
    rated = F.when(F.col("aggregate").isNull(), float("inf")).when(F.isnan("aggregate"), float("-inf")).otherwise(F.col("aggregate"))
    rows = stash(df.select("path", rated.alias("_rated"), *[c.alias(k) for k, c in of.items()]))
    counts = rows.agg(*[F.approx_count_distinct(k).alias(k) for k in of]).first().asDict()
    sets = _crossings({k: n + 1 for k, n in counts.items()}, {frozenset((key(x), key(y))) for x, y in pairs})
    number = lambda held: sum(1 << len(of) - 1 - at for at, k in enumerate(of) if k not in held)  # noqa: E731  (as grouping_id does)
    # counts and largest scores are numbers, so tasks add them up in place and sort nothing
    cells = stash(rows.groupingSets([[F.col(k) for k in held] for held in sets], *[F.col(k) for k in of]).agg(F.count("*").alias("n"), F.max("_rated").alias("_top"), F.grouping_id().alias("_set")))
    struct = lambda x, y: F.struct(F.lit(x).alias("one"), F.lit(y).alias("two"), value(x).alias("a"), value(y).alias("b"))
    crossed = [F.when(F.col("_set") == number(held), F.array(*[struct(x, y) for x, y in pairs if frozenset((key(x), key(y))) in own])) for held, own in sets.items()]
    names, place = ["one", "two", "a", "b"], ["_set", *of]
    members = cells.select(*place, "n", "_top", F.inline(F.coalesce(*crossed))).where("a is not null and b is not null")
    large = few(stash(members.groupBy(*names).agg(F.sum("n").alias("n"), F.max("_top").alias("_most")).where(F.col("n") >= least)))
    won = stash(members.drop("n").join(large, names).where(F.col("_top") == F.col("_most")).drop("_most"))

    tops = few(won.select(F.col("_top").alias("_rated")).distinct())
    slots = [F.struct(F.lit(number(held)).cast("long").alias("_set"), *[(F.col(k) if k in held else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in of]) for held in sets]
    near = rows.join(tops, "_rated", "left_semi").select("path", "_rated", F.inline(F.array(*slots)))
    asked = few(won.select(*[F.col(c).alias(f"_of_{c}") for c in place], "_top").distinct())
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in place]
    best = near.join(asked, [F.col("_rated") == F.col("_top"), *same]).groupBy(*[f"_of_{c}" for c in place]).agg(F.min("path").alias("best"))
    return won.join(best, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in place]).groupBy(*names).agg(F.first("n").alias("n"), F.min("best").alias("best"))


def deduplicated(sets: DataFrame, most_shared: float = 0.2, of: str = "smaller") -> DataFrame:
    """``name`` of the sets that stay: in order of priority (then name) one goes if it shares more than a part of the smaller set, or of its ``own`` size, with an earlier kept one.

    Overlaps come from a join on items. Each round keeps all sets that precede their undecided neighbours and drops the neighbours behind them, so the result is that of one pass in order,
    and no group of overlapping sets is gathered. Null names and items take no part.
    """
    known = sets.where("name is not null and path is not null").select("name", "path", "priority").distinct()
    sizes = stash(known.groupBy("name").agg(F.count_distinct("path").alias("size"), F.min("priority").alias("priority")))
    items = known.select("name", "path").distinct()
    pairs = items.alias("a").join(items.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.name") < F.col("b.name")))
    shared = pairs.groupBy(F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg(F.count("*").alias("both"))
    side = lambda s: sizes.select(F.col("name").alias(s), F.col("size").alias(f"n{s}"), F.struct("priority", "name").alias(f"o{s}"))
    met = shared.join(side("a"), "a").join(side("b"), "b")
    first = F.col("oa") < F.col("ob")
    met = met.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("later"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"), "both", F.when(first, F.col("nb")).otherwise(F.col("na")).alias("own"), F.least("na", "nb").alias("smaller"))
    edges = stash(met.where(F.col("both") > most_shared * F.col(of)).select("later", "earlier"))
    open_sets = sizes.select("name")
    kept: DataFrame | None = None
    while True:
        keep = stash(open_sets.join(edges.select(F.col("later").alias("name")).distinct(), "name", "left_anti"))
        kept = keep if kept is None else kept.unionByName(keep)
        gone = edges.join(keep, F.col("earlier") == F.col("name"), "left_semi").select(F.col("later").alias("name")).distinct()
        decided = stash(keep.unionByName(gone))
        old_sets, old_edges = open_sets, edges
        open_sets = stash(open_sets.join(decided, "name", "left_anti"))
        left = edges.join(decided, F.col("later") == F.col("name"), "left_anti")
        edges = stash(left.join(decided, F.col("earlier") == F.col("name"), "left_anti"))
        for table in (old_sets, old_edges, decided):
            forget(table)
        if open_sets.isEmpty():
            return kept


def people_sets(faces: DataFrame, items: DataFrame, most: int, least: int = 1, most_shared: float = 0.5) -> DataFrame:
    """Rows ``person, path, rank``: each person's best items; in the order of persons one goes if over half of its set is in the set of an earlier one that stays."""
    best = stash(top_per_group(faces.select("person", "path").distinct().join(items, "path"), "person", most).select("person", "path", F.col("rn").alias("rank")))
    large = best.groupBy("person").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sets = best.join(large, "person", "left_semi")
    stay = deduplicated(sets.select(F.col("person").alias("name"), "path", F.col("person").alias("priority")), most_shared, "own")
    return sets.join(stay.select(F.col("name").alias("person")), "person", "left_semi").select("person", "path", "rank")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values over old ones for the declared columns where they are given; new rows join, others stay."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = old.join(fresh, key, "full")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def latest(df: DataFrame, key: str, stamp: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(stamp, *[c for c in rest if c != stamp])).alias("r")).select(key, "r.*")


def reassigned(faces: DataFrame, moves: DataFrame, key: str = "face", owner: str = "person") -> DataFrame:
    """Faces with moved owners."""
    return faces.join(moves.select(key, F.col(owner).alias("_to")), key, "left").withColumn(owner, F.coalesce("_to", owner)).drop("_to")


def appended(album: DataFrame, new: DataFrame) -> DataFrame:
    """Members with the next positions; those in it already stay where they are. A position needs only the album's own order."""
    fresh = new.join(album, ["album", "path"], "left_anti")
    last = album.groupBy("album").agg(F.max("position").alias("last"))
    w = W.partitionBy("album").orderBy("path")
    placed = fresh.join(last, "album", "left").withColumn("position", F.coalesce("last", F.lit(0)) + F.row_number().over(w))
    return album.select("album", "path", "position").unionByName(placed.select("album", "path", "position"))


def newer_wins(stored: DataFrame, sidecar: DataFrame, key: str = "path") -> DataFrame:
    """A sidecar's rating wins if it is at least as new; tags unite."""
    joined = stored.join(sidecar.select(key, F.col("rating").alias("_r"), F.col("stamp").alias("_s"), F.col("tags").alias("_t")), key, "left")
    newer = F.col("_s").isNotNull() & (F.col("stamp").isNull() | (F.col("_s") >= F.col("stamp")))
    return joined.select(key, F.when(newer, F.coalesce("_r", "rating")).otherwise(F.col("rating")).alias("rating"), F.array_sort(F.array_union("tags", F.coalesce("_t", F.array().cast("array<string>")))).alias("tags"))


@query("n1_people_sets", """WITH RECURSIVE f AS (SELECT DISTINCT l_suppkey AS person, l_orderkey AS path FROM lineitem),
  b AS (SELECT * FROM (SELECT person, i.path, row_number() OVER (PARTITION BY person ORDER BY aggregate DESC, i.path) AS rank FROM f JOIN item i ON i.path = f.path) WHERE rank <= 10),
  z AS (SELECT person, count(*) AS n FROM b GROUP BY 1), o AS (SELECT y.person AS later, x.person AS earlier FROM b x JOIN b y ON x.path = y.path AND x.person < y.person JOIN z ON z.person = y.person GROUP BY y.person, x.person, z.n HAVING count(*) > 0.5 * z.n),
  p AS (SELECT person, row_number() OVER (ORDER BY person) AS i FROM z), g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
    SELECT g.i + 1, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.later = p.person AND list_contains(g.kept, o.earlier)) THEN g.kept ELSE list_append(g.kept, p.person) END FROM g JOIN p ON p.i = g.i + 1)
  SELECT person, path, rank::INTEGER AS rank FROM b WHERE person IN (SELECT unnest(kept) FROM g WHERE i = (SELECT max(i) FROM g))""")
def _(v):
    faces = v.table("lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("path"))
    return people_sets(faces, v.item, 10)


@query("n2_seasonal", """SELECT name, path, rank::INTEGER AS rank FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY aggregate DESC, path) AS rank FROM (SELECT path, aggregate, (year(date_taken) + CASE WHEN month(date_taken) = 12 THEN 1 ELSE 0 END) || '-' ||
  CASE WHEN month(date_taken) IN (12, 1, 2) THEN 'winter' WHEN month(date_taken) <= 5 THEN 'spring' WHEN month(date_taken) <= 8 THEN 'summer' ELSE 'autumn' END AS name FROM item)) WHERE rank <= 12""")
def _(v):
    return sets_by(v.item, season("date_taken"), 1, 12).select("name", "path", "rank")


@query("n3_golden", "SELECT path, aggregate FROM item WHERE aggregate >= (SELECT aggregate FROM item ORDER BY aggregate DESC, path LIMIT 1 OFFSET (SELECT round(count(*) * 0.01)::BIGINT FROM item)) ORDER BY aggregate DESC, path LIMIT 50")
def _(v):
    n = v.item.count()
    cut = v.item.orderBy(F.desc("aggregate"), "path").offset(round(n * 0.01)).limit(1).select(F.col("aggregate").alias("cut"))
    return v.item.join(F.broadcast(cut), F.col("aggregate") >= F.col("cut")).orderBy(F.desc("aggregate"), "path").limit(50).select("path", "aggregate")


@query("n4_visual_story", f"""WITH RECURSIVE e AS ({ALIKE} 0.33), {REACHED}, s AS (SELECT component, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, component LIMIT 5),
  t AS (SELECT component, label, count(*) AS k FROM g JOIN s USING (component) JOIN vec ON vec_id = node GROUP BY 1, 2)
  SELECT component, array_to_string(list(label::VARCHAR ORDER BY k DESC, label)[1:2], ' & ') AS title FROM t GROUP BY 1""")
def _(v):
    groups = alike_components(v.vec, 0.33)
    sizes = groups.groupBy("component").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "component").limit(5)
    tags = groups.join(F.broadcast(sizes), "component").join(v.vec.select(F.col("vec_id").alias("node"), "label"), "node").groupBy("component", "label").agg(F.count("*").alias("k"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("m"), F.col("label")))), 1, 2)
    return tags.groupBy("component").agg(F.array_join(F.transform(best, lambda x: x["label"].cast("string")), " & ").alias("title"))


@query("n5_this_week", "SELECT path, strftime(date_taken, '%Y-%m-%d') AS day FROM item WHERE strftime(date_taken, '%m-%d') IN ('05-14', '05-15', '05-16', '05-17', '05-18', '05-19', '05-20') AND year(date_taken) < 2000")
def _(v):
    days = [f"05-{d}" for d in range(14, 21)]
    return v.item.where(F.date_format("date_taken", "MM-dd").isin(*days) & (F.year("date_taken") < 2000)).select("path", F.date_format("date_taken", "yyyy-MM-dd").alias("day"))


@query("n6_places", "SELECT round(round_even(lat / 0.5, 0) * 0.5, 2) AS lat, round(round_even(lon / 0.5, 0) * 0.5, 2) AS lon, count(*)::BIGINT AS n FROM geo GROUP BY 1, 2 HAVING count(*) >= 3")
def _(v):
    cell = lambda c: F.round(F.bround(F.col(c) / 0.5) * 0.5, 2)
    return v.geo.groupBy(cell("lat").alias("lat"), cell("lon").alias("lon")).agg(F.count("*").alias("n")).where("n >= 3")


@query("n7_person_pairs", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*)::BIGINT AS together FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) BETWEEN 1 AND 12")
def _(v):
    return co_appearing(v.table("lineitem"), "l_orderkey", "l_suppkey").where("together <= 12")


#: Axes of a discovery, the first of equals counts.
AXES = ("time", "similar", "person", "tag", "location", "mood")


def _best(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` rows of best ``score`` of each group; tasks pass on their first ranks alone."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc_nulls_last(), F.col("path").asc()))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


#: Items of the narrowest range that has a list of its own, vectors of a block of seeds and of items, and columns of a product.
RANGE_ROWS, SEED_ROWS, ITEM_ROWS, COLUMNS = 32, 8192, 16384, 2048


def _cover(low: int, high: int) -> list[tuple[int, int]]:
    """The fewest ranges ``level, number`` of 2 ** level places each that make up the places from ``low`` to ``high``."""
    out, level, high = [], 0, high + 1
    while low < high:
        if low % 2:
            out.append((level, low))
            low += 1
        if high % 2:
            high -= 1
            out.append((level, high))
        low, high, level = low // 2, high // 2, level + 1
    return out


def best_in_reach(seeds: DataFrame, items: DataFrame, reach: float, most: int) -> DataFrame:
    """Rows ``seed, path, score``: of the items (``path, x, score``) with ``|x - at| <= reach`` the ``most`` best of each seed (``seed, at``), itself left out.

    Ranges of x, halved down to a few items, each have their best items. A seed takes those of the ranges that lie within its reach, and of the ranges at both ends the
    items themselves, the best of each x. So no seed meets all that it reaches.
    """
    ends = items.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    span = float(ends["high"] - ends["low"]) if ends["n"] else 0.0
    held = ends["n"] * min(1.0, 2 * reach / span) if span > 0 else 0
    parts = 1 << max(2, min(20, int(held / RANGE_ROWS).bit_length()))
    width, low = (2.0 * reach / parts) or 1.0, float(ends["low"] or 0)
    levels = parts.bit_length()
    spot = F.floor((F.col("x").cast("double") - low) / width)
    kept = _best(items.where(F.col("x").isNotNull()), ["x"], most + 1).withColumn("_spot", spot)
    lists = _best(kept.select("path", "score", F.col("_spot"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("number", F.expr("shiftright(_spot, level)")), ["level", "number"], most + 1)

    def cover(batches):
        for pdf in batches:
            out = []
            for seed, at in zip(pdf["seed"], pdf["at"], strict=True):
                first, last = (int(np.floor((float(at) + way * reach - low) / width)) for way in (-1, 1))
                inside = _cover(first + 2, last - 2)
                # a level of -1: the items themselves
                out += [(seed, at, level, number) for level, number in inside] + [(seed, at, -1, n) for n in sorted({*range(first - 1, min(first + 2, last + 2)), *range(max(last - 1, first + 2), last + 2)})]
            yield pd.DataFrame(out, columns=["seed", "at", "level", "number"])

    types = {f.name: f.dataType.simpleString() for f in seeds.schema.fields}
    wanted = seeds.where("at is not null").select("seed", "at").mapInPandas(cover, f"seed {types['seed']}, at {types['at']}, level int, number long")
    whole = wanted.where("level >= 0").join(lists, ["level", "number"]).select("seed", "path", "score")
    single = wanted.where("level < 0").join(kept.withColumnRenamed("_spot", "number"), "number").where(F.abs(F.col("at") - F.col("x")) <= reach).select("seed", "path", "score")
    return _best(whole.unionByName(single).where("path <> seed"), ["seed"], most)


def best_alike(seeds: DataFrame, items: DataFrame, least: float, most: int) -> DataFrame:
    """Rows ``seed, path, score``: the ``most`` best items of cosine ``least`` or more to each seed, itself left out.

    Blocks of seeds meet blocks of items, each in products of bounded size, the best items first, and a seed that has found enough leaves its block. All pairs of blocks meet.
    """
    seeds, items = (df.where("embedding is not null").select(*names, F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("size")) for df, names in ((seeds, ["seed"]), (items, ["path", "score"])))
    rows, columns = max(1, -(-seeds.count() // SEED_ROWS)), max(1, -(-items.count() // ITEM_ROWS))
    left = seeds.withColumn("i", F.pmod(F.xxhash64("seed"), F.lit(rows)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = items.withColumn("j", F.pmod(F.xxhash64("path"), F.lit(columns)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def units(vectors: pd.Series) -> np.ndarray:
        v = np.array(vectors.tolist(), float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.full_like(v, np.nan), where=size > 0)  # NaN is like nothing

    def meet(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"seed": asked["seed"].iloc[:0], "path": found["path"].iloc[:0], "score": found["score"].iloc[:0]})]
        if len(asked) and len(found):
            found = found.sort_values(["score", "path"], ascending=[False, True], na_position="last")
            names, keys, scores, every, other = asked["seed"].to_numpy(), found["path"].to_numpy(), found["score"].to_numpy(), units(asked["v"]), units(found["v"])
            for at in range(0, len(names), COLUMNS):
                open_, count = np.arange(at, min(at + COLUMNS, len(names))), np.zeros(min(COLUMNS, len(names) - at), np.int64)
                for to in range(0, len(keys), COLUMNS):
                    near = (every[open_] @ other[to : to + COLUMNS].T >= least) & (keys[None, to : to + COLUMNS] != names[open_][:, None])
                    met = np.cumsum(near, axis=1) + count[:, None]
                    a, b = np.nonzero(near & (met <= most))
                    out.append(pd.DataFrame({"seed": names[open_[a]], "path": keys[to + b], "score": scores[to + b]}))
                    still, count = met[:, -1] < most, met[:, -1]
                    open_, count = open_[still], count[still]
                    if not len(open_):
                        break
        return pd.concat([p for p in out if len(p)] or out[:1])

    pairs = left.groupBy("i", "j", "size").cogroup(right.groupBy("i", "j", "size")).applyInPandas(lambda l, r: meet(l, r), f"seed {kinds['path']}, path {kinds['path']}, score {kinds['score']}")  # noqa: E741
    return _best(pairs, ["seed"], most)


def seed_axes(seeds: DataFrame, items: DataFrame, hours: float, least_cosine: float, km: float, mood: float, most: int = 40, score: str = "aggregate") -> dict[str, DataFrame]:
    """For each axis the rows ``seed, path`` of the ``most`` best items near a seed: in time, by vector, with the same person or tag, by place, and by mood (a number).

    No seed meets all that is near it: times and moods have ranges with their best items, persons, tags and places each have their best items, and places meet in
    buckets as wide as the reach. Only vectors are compared one by one, in blocks. Items need ``path, captured_at, embedding, person, tag, lat, lon, mood`` and
    the score; nulls are near nothing, and no seed is near itself.
    """
    from shelfmark.functions.scalars import haversine
    from shelfmark.operators.sessions import micros

    rated = lambda *columns: items.select("path", F.col(score).alias("score"), *columns)
    asked = lambda *columns: seeds.select(F.col("path").alias("seed"), *columns)

    def same(column: str) -> DataFrame:
        best = _best(rated(F.col(column).alias("_v")).where("_v is not null"), ["_v"], most + 1)
        return _best(asked(F.col(column).alias("_v")).join(best, "_v").where("path <> seed"), ["seed"], most)

    def placed() -> DataFrame:
        width = km / 111.0
        known = "lat is not null and lon is not null"
        bucket = F.floor(F.col("lat") / width)
        best = _best(rated("lat", "lon").where(known), ["lat", "lon"], most + 1).withColumn("_b", bucket)
        spots = seeds.where(known).select("lat", "lon").distinct().withColumn("_b", F.explode(F.sequence(bucket - 1, bucket + 1))).withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"})
        near = spots.join(best, "_b").where(haversine("s_lat", "s_lon", "lat", "lon") <= km).drop("lat", "lon", "_b")
        lists = _best(near, ["s_lat", "s_lon"], most + 1)
        return _best(asked(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).join(lists, ["s_lat", "s_lon"]).where("path <> seed"), ["seed"], most)

    found = {
        "time": best_in_reach(asked(micros("captured_at").alias("at")), rated(micros("captured_at").alias("x")), int(hours * 3600) * 1_000_000, most), "similar": best_alike(asked("embedding"), rated("embedding"), least_cosine, most),
        "person": same("person"), "tag": same("tag"), "location": placed(), "mood": best_in_reach(asked(F.col("mood").alias("at")), rated(F.col("mood").alias("x")), mood, most),
    }
    return {name: rows.select("seed", "path") for name, rows in found.items()}


def seeded_discovery(axes: dict[str, DataFrame], items: DataFrame, most: int = 40, least: int = 8, score: str = "aggregate") -> DataFrame:
    """Rows ``seed, axis, path, rank``: each seed's axis with the most items, at most ``most`` of them counting, and these, the best first; seeds without an axis of ``least`` items have none. Ties go to the earlier axis."""
    rows = None
    for place, name in enumerate(n for n in AXES if n in axes):
        part = axes[name].distinct().select("seed", F.lit(name).alias("axis"), F.lit(place).alias("_place"), "path")
        rows = part if rows is None else rows.unionByName(part)
    scored = rows.join(items.select("path", F.col(score).alias("_score")), "path")
    ranked = stash(scored.withColumn("rank", F.row_number().over(W.partitionBy("seed", "axis").orderBy(F.col("_score").desc_nulls_last(), F.col("path").asc()))).where(F.col("rank") <= most))
    counts = ranked.groupBy("seed", "axis", "_place").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = counts.groupBy("seed").agg(F.max_by("axis", F.struct(F.col("n"), -F.col("_place"))).alias("axis"))
    return ranked.join(best, ["seed", "axis"]).select("seed", "axis", "path", "rank")


@query("n8_six_axes", """WITH i AS (SELECT s.path, captured_at, camera % 40 AS person, kind || ev % 4 AS tag, (ev % 25) * 2.0::DOUBLE - 24 AS lat, (ev % 5) * 2.0::DOUBLE AS lon, aggregate AS mood, aggregate, e.embedding FROM shot s JOIN vec e ON e.vec_id = s.path),
  p AS (SELECT a.path AS seed, b.*, abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)) <= 36000000000 AS t, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2 AS v, a.person = b.person AS w, a.tag = b.tag AS g,
    2 * 6371.0 * asin(sqrt(pow(sin((radians(a.lat) - radians(b.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(a.lon) - radians(b.lon)) / 2), 2))) <= 100 AS l, abs(a.mood - b.mood) <= 0.2 AS m FROM i a JOIN i b ON a.path <> b.path AND a.path % 20 = 0),
  x AS (SELECT seed, path, aggregate, unnest([0, 1, 2, 3, 4, 5]) AS place, unnest([t, v, w, g, l, m]) AS near FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY seed, place ORDER BY aggregate DESC, path) AS rank FROM x WHERE near),
  k AS (SELECT * FROM r WHERE rank <= 12), c AS (SELECT seed, place, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 5), b AS (SELECT seed, arg_max(place, (n, -place)) AS place FROM c GROUP BY 1)
  SELECT k.seed, ['time', 'similar', 'person', 'tag', 'location', 'mood'][k.place + 1] AS axis, k.path, k.rank::INTEGER AS rank FROM k JOIN b ON b.seed = k.seed AND b.place = k.place""")
def _(v):
    shots = v.shot.join(v.vec, F.col("vec_id") == F.col("path"))
    items = shots.select("path", "captured_at", (F.col("camera") % 40).alias("person"), F.concat("kind", (F.col("ev") % 4).cast("string")).alias("tag"), ((F.col("ev") % 25) * 2.0 - 24).alias("lat"), ((F.col("ev") % 5) * 2.0).alias("lon"), F.col("aggregate").alias("mood"), "aggregate", "embedding")
    held = stash(items)
    return seeded_discovery(seed_axes(held.where("path % 20 = 0"), held, 10, 0.2, 100, 0.2, 12), held, 12, 5)


@query("n8_seeded_discovery")
def _(v):
    from shelfmark.operators.sessions import near_in_time

    seeds = v.shot.where("path % 400 = 0")
    time = near_in_time(seeds, v.shot, 7200).groupBy("seed").agg(F.count("*").alias("n")).select("seed", F.lit("time").alias("axis"), "n")
    kinds = v.shot.groupBy("camera", "kind").agg(F.count("*").alias("n"))
    alike = seeds.join(kinds, ["camera", "kind"]).select(F.col("path").alias("seed"), F.lit("person").alias("axis"), F.col("n") - 1)
    both = time.union(alike)
    return both.groupBy("seed").agg(F.max_by("axis", F.struct("n", "axis")).alias("axis"), F.max("n").alias("n"))


@query("n9_progress", "SELECT y, round(m, 4) AS mean, round(m / prev - 1, 4) AS gain FROM (SELECT y, m, lag(m) OVER (ORDER BY y) AS prev FROM (SELECT year(date_taken)::INTEGER AS y, avg(aggregate) AS m FROM item GROUP BY 1)) WHERE m / prev - 1 >= -0.05")
def _(v):
    years = v.item.groupBy(F.year("date_taken").alias("y")).agg(F.avg("aggregate").alias("m"))
    gained = years.withColumn("gain", F.col("m") / F.lag("m").over(W.orderBy("y")) - 1)  # one row a year
    return gained.where("gain >= -0.05").select("y", F.round("m", 4).alias("mean"), F.round("gain", 4).alias("gain"))


@query("n10_palette_mood", "SELECT month, CASE WHEN s >= 5.05 THEN 'vivid' WHEN mono >= 0.25 THEN 'mono' ELSE 'soft' END AS mood FROM (SELECT strftime(date_taken, '%Y-%m') AS month, avg(tech_sharpness) AS s, avg(CASE WHEN camera = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS mono FROM scored GROUP BY 1)")
def _(v):
    months = v.scored.groupBy(F.date_format("date_taken", "yyyy-MM").alias("month")).agg(F.avg("tech_sharpness").alias("s"), F.avg(F.when(F.col("camera") == "BUILDING", 1.0).otherwise(0.0)).alias("mono"))
    return months.select("month", F.when(F.col("s") >= 5.05, "vivid").when(F.col("mono") >= 0.25, "mono").otherwise("soft").alias("mood"))


@query("n11_favourites", "SELECT strftime(captured_at, '%Y-%W') AS period, count(*) FILTER (is_favorite = 1)::BIGINT AS favourites, count(*) FILTER (star_rating = 4)::BIGINT AS four_stars FROM shot JOIN overlay ON overlay.path = shot.path GROUP BY 1")
def _(v):
    from shelfmark.functions.scalars import week_of_year

    rows = v.shot.join(v.overlay.drop("user_id"), "path")
    return rows.groupBy(F.concat_ws("-", F.date_format("captured_at", "yyyy"), week_of_year("captured_at")).alias("period")).agg(F.count_if(F.col("is_favorite") == 1).alias("favourites"), F.count_if(F.col("star_rating") == 4).alias("four_stars"))


@query("n12_dimension_sets", "SELECT dim, value, count(*)::BIGINT AS n, min_by(path, (-aggregate, path)) AS best FROM (SELECT path, aggregate, unnest(['year', 'weekday', 'camera', 'lens', 'status', 'band']) AS dim, unnest([strftime(date_taken, '%Y'), dayofweek(date_taken)::VARCHAR, camera, lens, status, floor(aggregate)::INTEGER::VARCHAR]) AS value FROM item) GROUP BY 1, 2 HAVING count(*) >= 20")
def _(v):
    return dimension_sets(v.item, ["year", "weekday", "camera", "lens", "status", "band"], 20)


@query("n13_cross_dimension_sets", "SELECT camera, status, category, count(*)::BIGINT AS n FROM item GROUP BY GROUPING SETS ((camera, status), (camera, category), (status, category)) HAVING count(*) >= 50")
def _(v):
    return v.spark.sql("SELECT camera, status, category, count(*) AS n FROM {items} GROUP BY GROUPING SETS ((camera, status), (camera, category), (status, category)) HAVING count(*) >= 50", items=v.item)


#: The dimensions in SQL over ``item`` with ``hue``.
DIMENSION_SQL = {
    "year": "strftime(date_taken, '%Y')", "month": "strftime(date_taken, '%Y-%m')", "week": "strftime(date_trunc('week', date_taken), '%Y-%m-%d')", "weekday": "dayofweek(date_taken)::VARCHAR", "weekend": "CASE WHEN dayofweek(date_taken) IN (0, 6) THEN 'weekend' ELSE 'workday' END",
    "season": "(year(date_taken) + CASE WHEN month(date_taken) = 12 THEN 1 ELSE 0 END) || '-' || CASE WHEN month(date_taken) IN (12, 1, 2) THEN 'winter' WHEN month(date_taken) <= 5 THEN 'spring' WHEN month(date_taken) <= 8 THEN 'summer' ELSE 'autumn' END",
    "quarter": "strftime(date_taken, '%Y') || '-' || quarter(date_taken)", "day": "strftime(date_taken, '%Y-%m-%d')", "decade": "(year(date_taken) // 10 * 10)::VARCHAR", "camera": "camera", "lens": "lens", "category": "category", "status": "status",
    "band": "floor(aggregate)::INTEGER::VARCHAR", "star": "least(5, floor(aggregate / 2 + 0.5))::INTEGER::VARCHAR",
    "hue": "CASE WHEN hue >= 345 OR hue < 15 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 70 THEN 'yellow' WHEN hue < 165 THEN 'green' WHEN hue < 195 THEN 'cyan' WHEN hue < 255 THEN 'blue' WHEN hue < 300 THEN 'purple' ELSE 'magenta' END",
    "initial": "substr(lens, 1, 1)", "owner": "owner::VARCHAR", "gear": "camera || ' / ' || lens",
}
#: Each of eight dimensions with each other one.
CROSSED = [(x, y) for i, x in enumerate(("year", "season", "camera", "lens", "category", "status", "band", "hue")) for y in ("year", "season", "camera", "lens", "category", "status", "band", "hue")[i + 1 :]]
HUED = "SELECT *, path % 360 AS hue FROM item"


@query("n12_all_dimensions", f"""WITH d AS (SELECT path, aggregate, unnest([{", ".join(f"'{k}'" for k in DIMENSION_SQL)}]) AS dim, unnest([{", ".join(DIMENSION_SQL.values())}]) AS value FROM ({HUED})),
  r AS (SELECT *, count(*) OVER (PARTITION BY dim, value) AS n, row_number() OVER (PARTITION BY dim, value ORDER BY aggregate DESC, path) AS rank FROM d WHERE value IS NOT NULL)
  SELECT dim, value, n::BIGINT AS n, path, rank::INTEGER AS rank FROM r WHERE rank <= 12 AND n >= CASE dim {" ".join(f"WHEN '{k}' THEN {n}" for k, n in DIMENSIONS.items())} END""")
def _(v):
    return dimension_members(v.item.withColumn("hue", F.col("path") % 360), most=12)


@query("n13_all_crossed", f"""WITH d AS (SELECT path, aggregate, unnest([{", ".join(f"'{x}'" for x, _ in CROSSED)}]) AS one, unnest([{", ".join(f"'{y}'" for _, y in CROSSED)}]) AS two, unnest([{", ".join(DIMENSION_SQL[x] for x, _ in CROSSED)}]) AS a, unnest([{", ".join(DIMENSION_SQL[y] for _, y in CROSSED)}]) AS b FROM ({HUED}))
  SELECT one, two, a, b, count(*)::BIGINT AS n, min_by(path, (-aggregate, path)) AS best FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10""")
def _(v):
    return crossed_sets(v.item.withColumn("hue", F.col("path") % 360), CROSSED, 10)


@query("n14_best_per_dimension", "SELECT lens AS name, path, rank::INTEGER AS rank FROM (SELECT lens, path, row_number() OVER (PARTITION BY lens ORDER BY aesthetic DESC, path) AS rank FROM scored) WHERE rank <= 5")
def _(v):
    return sets_by(v.scored, F.col("lens"), 1, 5, "aesthetic").select("name", "path", "rank")


@query("n15_cover_pick")
def _(v):
    top = sets_by(v.item, F.col("lens"), 5, 5)
    pick = F.pmod(F.xxhash64("name", F.lit(20240101)), F.lit(5)) + 1
    return top.where(F.col("rank") == pick).select("name", "path")


@query("n16_global_dedup")
def _(v):
    a = sets_by(v.item, F.concat(F.lit("lens "), F.col("lens")), 1, 20).withColumn("priority", F.lit(1))
    b = sets_by(v.item, F.concat(F.lit("nation "), F.col("lens")), 1, 15).withColumn("priority", F.lit(2))
    c = sets_by(v.item, F.col("camera"), 1, 30).withColumn("priority", F.lit(3))
    return deduplicated(a.unionByName(b).unionByName(c))


@query("n17_set_titles", "SELECT day, CASE WHEN count(*) OVER (PARTITION BY substr(day, 1, 7)) > 1 THEN day ELSE substr(day, 1, 7) END AS title FROM (SELECT strftime(captured_at, '%Y-%m-%d') AS day FROM shot GROUP BY 1 HAVING count(*) >= 330)")
def _(v):
    days = v.shot.groupBy(F.date_format("captured_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).where("n >= 330")
    month = F.substring("day", 1, 7)
    return days.select("day", F.when(F.count("*").over(W.partitionBy(month)) > 1, F.col("day")).otherwise(month).alias("title"))


@query("n18_saved_filter", "SELECT path, aggregate FROM item WHERE camera = 'FURNITURE' AND aggregate >= 6.5 ORDER BY aggregate DESC, path LIMIT 1")
def _(v):
    saved = json.loads('{"camera": "FURNITURE", "min_aggregate": "6.5"}')
    return QuerySpec(composite(saved, ["aggregate"], ["camera"]), per_page=1).rows(v.item).select("path", "aggregate")


@query("n19_suggested_context", "SELECT camera AS album, arg_max(kind, (n, kind)) AS moment, round(max(n) / sum(n)::DOUBLE, 4) AS share FROM (SELECT camera, kind, count(*) AS n FROM shot GROUP BY 1, 2) GROUP BY 1")
def _(v):
    kinds = v.shot.groupBy("camera", "kind").agg(F.count("*").alias("n"))
    return kinds.groupBy(F.col("camera").alias("album")).agg(F.max_by("kind", F.struct("n", "kind")).alias("moment"), F.round(F.max("n") / F.sum("n"), 4).alias("share"))


@query("o1_upsert", "SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NOT NULL AND n.aggregate IS NOT NULL THEN n.aggregate ELSE o.aggregate END AS aggregate, o.status FROM (SELECT path, aggregate, status FROM item WHERE path % 3 <> 0) o FULL JOIN (SELECT path, CASE WHEN path % 2 = 0 THEN 1.5::DOUBLE END AS aggregate FROM item WHERE path % 5 = 0) n ON n.path = o.path")
def _(v):
    new = v.item.where("path % 5 = 0").select("path", F.when(F.col("path") % 2 == 0, 1.5).alias("aggregate"))
    return upsert(v.item.where("path % 3 <> 0").select("path", "aggregate", "status"), new, "path", ["aggregate"])


@query("o2_insert_or_ignore", "SELECT path, tag FROM part_tag WHERE path % 2 = 0 UNION ALL SELECT path, 'new' FROM part_tag WHERE path % 2 = 1 AND path % 3 = 0 AND tag < 'h'")
def _(v):
    old = v.part_tag.where("path % 2 = 0")
    return insert_or_ignore(old, v.part_tag.where("path % 3 = 0 and tag < 'h'").select("path", F.lit("new").alias("tag")), "path")


@query("o3_tag_resync", "SELECT DISTINCT p_partkey AS path, trim(t) AS tag FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part) WHERE trim(t) <> ''")
def _(v):
    return v.table("part").select(F.col("p_partkey").alias("path"), F.explode(F.split("p_name", " ")).alias("t")).select("path", F.trim("t").alias("tag")).where("tag <> ''").distinct()


@query("o4_batch_update", "SELECT path, CASE WHEN path % 10 = 1 AND user_id % 2 = 0 THEN 1 ELSE is_rejected END::INTEGER AS is_rejected FROM overlay")
def _(v):
    visible = v.overlay.where("path % 10 = 1 and user_id % 2 = 0").select("path", F.lit(1).alias("is_rejected"))
    return upsert(v.overlay.select("path", "is_rejected"), visible, "path", ["is_rejected"])


@query("o5_reassign", "SELECT person, count(*)::BIGINT AS n FROM (SELECT CASE WHEN label = 3 THEN 4 ELSE label END AS person FROM vec) GROUP BY 1")
def _(v):
    faces = v.vec.select(F.col("vec_id").alias("face"), F.col("label").alias("person"))
    return reassigned(faces, faces.where("person = 3").select("face", F.lit(4).alias("person"))).groupBy("person").agg(F.count("*").alias("n"))


@query("o6_album_append", "SELECT camera AS album, path, row_number() OVER (PARTITION BY camera ORDER BY path % 2, path)::BIGINT AS position FROM shot")
def _(v):
    w = W.partitionBy("album").orderBy("path")
    rows = v.shot.select(F.col("camera").alias("album"), "path")
    old = rows.where("path % 2 = 0").withColumn("position", F.row_number().over(w).cast("bigint"))
    return appended(old, rows).withColumn("position", F.col("position").cast("bigint"))


@query("o7_context_overrides", "SELECT path, CASE WHEN path % 11 = 0 THEN 'manual' ELSE 'album ' || camera END AS context FROM shot WHERE path % 11 = 0 OR camera % 10 = 0")
def _(v):
    manual = v.shot.where("path % 11 = 0").select("path", F.lit("manual").alias("context"))
    return insert_or_ignore(manual, v.shot.where("camera % 10 = 0").select("path", F.concat(F.lit("album "), F.col("camera").cast("string")).alias("context")), "path")


@query("o8_newer_wins", "SELECT path, CASE WHEN path % 3 = 0 AND path % 2 = 0 THEN 5 ELSE ev % 5 END::INTEGER AS rating, CASE WHEN path % 3 = 0 AND kind < 'side' THEN kind || ',side' WHEN path % 3 = 0 THEN 'side,' || kind ELSE kind END AS tags FROM shot")
def _(v):
    stored = v.shot.select("path", (F.col("ev") % 5).alias("rating"), F.col("captured_at").alias("stamp"), F.array("kind").alias("tags"))
    later = F.expr("CASE WHEN path % 2 = 0 THEN captured_at + INTERVAL 1 HOUR ELSE captured_at - INTERVAL 1 HOUR END")
    sidecar = v.shot.where("path % 3 = 0").select("path", F.lit(5).alias("rating"), later.alias("stamp"), F.array(F.lit("side")).alias("tags"))
    return newer_wins(stored, sidecar).select("path", "rating", F.array_join("tags", ",").alias("tags"))


@query("o9_viewer_sync", "SELECT s.path, CASE WHEN coalesce(o.star_rating, 0) <> 0 THEN o.star_rating ELSE s.ev % 5 END::INTEGER AS rating FROM shot s LEFT JOIN overlay o ON o.path = s.path")
def _(v):
    joined = v.shot.join(v.overlay.select("path", "star_rating"), "path", "left")
    return joined.select("path", F.when(F.coalesce("star_rating", F.lit(0)) != 0, F.col("star_rating")).otherwise(F.col("ev") % 5).alias("rating"))


@query("o10_sequence_overrides", "SELECT path, CASE WHEN path % 4 = 0 THEN NULL ELSE 'forced' END AS kind, path % 2 = 0 AS pending FROM shot WHERE path % 6 = 0 OR path % 4 = 0")
def _(v):
    forced = v.shot.where("path % 6 = 0 and path % 4 <> 0").select("path", F.lit("forced").alias("kind"))
    cleared = v.shot.where("path % 4 = 0").select("path", F.lit(None).cast("string").alias("kind"))
    return forced.unionByName(cleared).withColumn("pending", F.col("path") % 2 == 0)


@query("o11_weight_snapshots", "SELECT kind AS category, path AS snapshot, round(aggregate, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY captured_at DESC, path) AS rn FROM shot) WHERE rn <= 5")
def _(v):
    w = W.partitionBy("kind").orderBy(F.desc("captured_at"), "path")
    return v.shot.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select(F.col("kind").alias("category"), F.col("path").alias("snapshot"), F.round("aggregate", 4).alias("weight"))


@query("o2_latest_by_key", "SELECT camera, arg_max(kind, (captured_at, path)) AS kind FROM shot GROUP BY 1")
def _(v):
    return latest(v.shot.select("camera", "kind", F.struct("captured_at", "path").alias("stamp")), "camera", "stamp").select("camera", "kind")


@query("n12_set_ids", "SELECT lens, substr(md5('lens|' || lens), 1, 12) AS id FROM item GROUP BY 1")
def _(v):
    return v.item.select("lens").distinct().withColumn("kind", F.lit("lens")).select("lens", short_id("kind", "lens").alias("id"))
