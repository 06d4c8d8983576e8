"""Sessions and sequences over capture times (group I)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.registry import query
from shelfmark.runtime import shuffle_width, stash

TIME = "captured_at"


def micros(column) -> Column:
    """Microseconds of a timestamp with or without a time zone."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def near_in_time(seeds: DataFrame, rows: DataFrame, seconds: int, key: str = "path", time: str = TIME) -> DataFrame:
    """Rows ``seed, path`` within ``seconds`` of a seed: an equi join on time buckets, each seed dealt to the three it can reach."""
    bucket = lambda c: F.floor(micros(c) / F.lit(seconds * 1_000_000))
    left = seeds.select(F.col(key).alias("seed"), F.col(time).alias("_at")).withColumn("_b", F.explode(F.sequence(bucket(F.col("_at")) - 1, bucket(F.col("_at")) + 1)))
    right = rows.select(F.col(key), F.col(time).alias("_t"), bucket(F.col(time)).alias("_b"))
    gap = F.abs(micros("_t") - micros("_at"))
    return left.join(right, "_b").where((gap <= seconds * 1_000_000) & (F.col(key) != F.col("seed"))).select("seed", key)


def sessions(df: DataFrame, seconds: float, by: list[str] = [], time: str = TIME, key: str = "path", name: str = "session") -> DataFrame:  # noqa: B006
    """Runs whose neighbours lie at most ``seconds`` apart; numbered from 1 in time order.

    With ``by`` each key's rows are one window. Without, time ranges are cut apart by range
    partitioning: each finds its own breaks, and small per-range totals join them.
    """
    limit = int(seconds * 1_000_000)
    if by:
        w = W.partitionBy(*by).orderBy(time, key)
        broken = df.withColumn("_new", F.when(micros(time) - F.lag(micros(time)).over(w) <= limit, 0).otherwise(1))
        return broken.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    dealt = stash(df.repartitionByRange(2 * shuffle_width(df.sparkSession), time, key).withColumn("_p", F.spark_partition_id()))
    w = W.partitionBy("_p").orderBy(time, key)
    gap = micros(time) - F.lag(micros(time)).over(w)
    broken = dealt.withColumn("_new", F.when(gap.isNull(), 0).when(gap <= limit, 0).otherwise(1))
    parts = broken.groupBy("_p").agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.sum("_new").alias("breaks"))
    edge = W.orderBy("_p")  # one row for each range
    joined = parts.withColumn("_join", F.when(micros("lo") - F.lag(micros("hi")).over(edge) <= limit, 0).otherwise(1))
    before = F.coalesce(F.sum("breaks").over(edge.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.sum("_join").over(edge.rowsBetween(W.unboundedPreceding, 0))
    offsets = joined.withColumn("_first", before).select("_p", "_first")
    local = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    return broken.withColumn("_local", local).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_first") + F.col("_local")).drop("_p", "_new", "_local", "_first")


def adaptive_gap(df: DataFrame, by: str, floor_seconds: float, factor: float, time: str = TIME, key: str = "path") -> DataFrame:
    """For each key ``max(floor, factor x upper median of positive gaps)``."""
    w = W.partitionBy(by).orderBy(time, key)
    gaps = df.withColumn("d", (micros(time) - F.lag(micros(time)).over(w)) / 1e6).where("d > 0")
    n, rn = F.count("*").over(W.partitionBy(by)), F.row_number().over(W.partitionBy(by).orderBy("d"))
    return gaps.withColumn("n", n).withColumn("rn", rn).where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select(by, F.greatest(F.lit(float(floor_seconds)), F.col("d") * factor).alias("gap"))


def scene_summary(scened: DataFrame, session: str = "session", time: str = TIME, label: str = "kind", weight: str = "aggregate") -> DataFrame:
    totals = scened.groupBy(session, label).agg(F.sum(weight).alias("_w"))
    dominant = totals.groupBy(session).agg(F.min_by(label, F.struct(-F.round("_w", 6), F.col(label))).alias("dominant"))
    stats = scened.groupBy(session).agg(F.count("*").alias("n"), F.min(time).alias("began"), F.max(time).alias("ended"), F.min_by("path", F.struct(-F.col(weight), F.col("path"))).alias("best"))
    return stats.join(dominant, session)


def widest_gaps(df: DataFrame, group: str, time: str = "captured_at", key: str = "path") -> DataFrame:
    """Rows ``group, cut, gap``: the row that follows a group's widest gap, of equal gaps the one nearest the group's middle; groups of one row have none."""
    order = W.partitionBy(group).orderBy(time, key)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    placed = df.select(group, key, (micros - F.lag(micros).over(order)).alias("gap"), (F.row_number().over(order) - 1).alias("at"))
    sized = placed.join(df.groupBy(group).agg(F.count("*").alias("n")), group).where("gap is not null")
    best = F.max(F.struct("gap", (-F.abs(F.col("at") - F.col("n") / 2)).alias("near"), (-F.col("at")).alias("early"), F.col(key).alias("cut")))
    return sized.groupBy(group).agg(best.alias("b")).select(group, "b.cut", "b.gap")


def _last_matches(times: np.ndarray, hashes: np.ndarray, people: np.ndarray, rapid: float, window: float, bits: int) -> np.ndarray:
    """For each row of a stretch in time order the place of the last earlier row that it matches, else -1; all rows look back one step further at once until they match or time is out of reach."""
    found, left, back = np.full(len(times), -1), np.arange(1, len(times)), 1
    while len(left):
        at = left - back
        gap, far = times[left] - times[at], np.bitwise_count(hashes[left] ^ hashes[at])
        fits = ((gap <= rapid) & (far <= 2 * bits) & (people[left] == people[at])) | ((gap <= window) & (far <= bits))
        found[left[fits]] = at[fits]
        left = left[~fits & (gap <= max(rapid, window)) & (at > 0)]
        back += 1
    return found


def _next_start(last: np.ndarray, start: int, at: int) -> int:
    """The first place from ``at`` on whose last match lies before ``start``, so that it begins a burst; the length where there is none."""
    for i in range(at, len(last)):
        if last[i] < start:
            return i
    return len(last)


def _crossings(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a block does to a burst that comes in, for the sessions at its two ends: rows ``session, block, lasts, exits, breaks``.

    A burst that began at ``s`` first breaks at a row whose last match lies before ``s``; of these only rows count whose last match lies before all earlier ones'. From such a row
    on nothing before it matters: where the last burst then begins, and how many have begun.
    """
    pdf = pdf.sort_values("pos", kind="stable")
    first, out = int(pdf["pos"].iloc[0]), []
    for session in dict.fromkeys((pdf["session"].iloc[0], pdf["session"].iloc[-1])):
        part = pdf[pdf["session"] == session]
        base, last = int(part["pos"].iloc[0]), part["last"].tolist()
        lowest = np.minimum.accumulate(last)
        heads = [0, *(np.flatnonzero(lowest[1:] < lowest[:-1]) + 1).tolist()]
        known: dict[int, tuple[int, int]] = {}
        for head in reversed(heads):
            met, at = [head], head
            while (at := _next_start(last, base + at, at + 1)) < len(last) and at not in known:
                met.append(at)
            exit_at, count = known[at] if at < len(last) else (met[-1], 0)
            for place in reversed(met):
                known[place] = (exit_at, count := count + 1)
        out.append((session, pdf["block"].iloc[0], [int(last[h]) for h in heads], [base + known[h][0] for h in heads], [known[h][1] for h in heads]))
    return pd.DataFrame(out, columns=["session", "block", "lasts", "exits", "breaks"])


def _carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """One session's blocks, a few numbers each: where the burst that enters each block began, and its number."""
    pdf, start, number, out = pdf.sort_values("block"), np.iinfo(np.int64).max, 0, []
    for row in pdf.itertuples():
        out.append((row.session, row.block, start, number))
        for last, leaves, breaks in zip(row.lasts, row.exits, row.breaks, strict=True):
            if last < start:
                start, number = leaves, number + breaks
                break
    return pd.DataFrame(out, columns=["session", "block", "start", "number"])


#: Rows of a block of shots.
BURST_ROWS = 20_000


def bursts(df: DataFrame, rapid: float, window: float, bits: int, block_rows: int = BURST_ROWS) -> DataFrame:
    """Greedy runs where a shot joins if it matches any member: soon after one of the same person, or alike within the window.

    A shot matches a member of the burst that began at ``s`` just if the last shot that it matches lies at ``s`` or later. So blocks of shots in time order, each with
    the shots before it that the tests can reach, find each shot's last match; blocks tell what they do to a burst that comes in, and number their
    shots with what does come in. A session of any length is so dealt to as many tasks as it has blocks. A null time is a burst of its own.
    """
    from shelfmark.operators.scans import few, numbered

    reach = max(rapid, window)
    timed = sessions(df.where("captured_at is not null"), reach).select(F.col("session").cast("long").alias("session"), "path", micros(TIME).alias("at"), "hash", "person")
    rows = stash(numbered(timed, [F.col("session"), F.col("at"), F.col("path")], block_rows))
    began = rows.groupBy("block").agg(F.min("at").alias("began"), F.min("session").alias("entered"))
    limit = F.lit(round(reach * 1e6))
    # each block's shots go to the later blocks that they reach: blocks meet in buckets of time as wide as the reach
    bucket = lambda c: F.floor(F.col(c) / F.lit(max(1, round(reach * 1e6))))
    ends = rows.groupBy("block").agg(F.max("at").alias("ended"), F.max("session").alias("entered")).withColumn("_b", F.explode(F.array(bucket("ended"), bucket("ended") + 1)))
    ahead = ends.join(began.withColumnRenamed("block", "to").withColumn("_b", bucket("began")), ["_b", "entered"]).where((F.col("to") > F.col("block")) & (F.col("began") - F.col("ended") <= limit))
    ahead = few(stash(ahead.select("block", "to", "began", "entered")))
    guests = rows.join(ahead, "block").where((F.col("session") == F.col("entered")) & (F.col("began") - F.col("at") <= limit)).select("session", "path", "at", "hash", "person", "pos", F.col("to").alias("block"), F.lit(False).alias("own"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        place, session, last = pdf["pos"].to_numpy(), pdf["session"].to_numpy(), np.full(len(pdf), -1)
        found = _last_matches(pdf["at"].to_numpy() / 1e6, pdf["hash"].to_numpy(np.int64).view(np.uint64), pdf["person"].to_numpy(), rapid, window, bits)
        hit = found >= 0
        hit[hit] = session[found[hit]] == session[hit]
        last[hit] = place[found[hit]]
        return pdf.assign(last=last)[pdf["own"]][["session", "path", "block", "pos", "last"]]

    kind = df.schema["path"].dataType.simpleString()
    matched = stash(rows.select("session", "path", "at", "hash", "person", "pos", "block", F.lit(True).alias("own")).unionByName(guests).groupBy("block").applyInPandas(match, f"session long, path {kind}, block int, pos long, last long"))
    links = matched.groupBy("block").applyInPandas(_crossings, "session long, block int, lasts array<long>, exits array<long>, breaks array<long>").groupBy("session").applyInPandas(_carried, "session long, block int, start long, number long")

    def number(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf, given = pdf.sort_values("pos", kind="stable"), {r.session: (r.start, r.number) for r in known.itertuples()}
        burst, now = np.zeros(len(pdf), np.int64), None
        for i, (session, place, last) in enumerate(zip(pdf["session"], pdf["pos"], pdf["last"], strict=True)):
            if session != now:
                now, (start, count) = session, given.get(session, (np.iinfo(np.int64).max, 0))
            if last < start:
                start, count = place, count + 1
            burst[i] = count
        return pdf.assign(burst=burst)[["session", "path", "burst"]]

    done = matched.groupBy("block").cogroup(links.groupBy("block")).applyInPandas(number, f"session long, path {kind}, burst long")
    return done.unionByName(df.where("captured_at is null").select(F.lit(None).cast("long").alias("session"), "path", F.col("path").cast("long").alias("burst")))


def lead(df: DataFrame, group: list[str], score: str = "aggregate", time: str = TIME, key: str = "path") -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.desc(score), F.asc(time), F.asc(key))
    return df.withColumn("is_lead", F.row_number().over(w) == 1)


def brackets(df: DataFrame, gap: float = 3, step: float = 0.5, span: float = 1, uneven: float = 0.34, least: int = 3, by: str = "camera", hash_col: str | None = None, bits: int = 10) -> DataFrame:
    """Exposure brackets: runs of one camera with close times and steps of exposure in one direction; wide and even enough.

    With ``hash_col``, a signed number of 64 bits, neighbours must also look alike: at most ``bits`` differ; a null hash is like none. Rows ``path, run, offset`` with the base frame at the middle rung.
    """
    w = W.partitionBy(by).orderBy(TIME, "path")
    alike = F.coalesce(F.bit_count(F.col(hash_col).bitwiseXOR(F.lag(hash_col).over(w))) <= bits, F.lit(False)) if hash_col else F.lit(True)
    steps = df.withColumn("_s", F.col("ev") - F.lag("ev").over(w)).withColumn("_t", (micros(TIME) - F.lag(micros(TIME)).over(w)) / 1e6).withColumn("_like", alike)
    joins = (F.col("_t") <= gap) & (F.abs("_s") >= step) & F.col("_like")
    before = F.lag(F.when(joins, F.col("_s"))).over(w)
    same_way = before.isNull() | (F.signum(before) == F.signum("_s"))
    broken = steps.withColumn("_new", F.when(joins & same_way, 0).otherwise(1))
    runs = broken.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    inner = F.when(F.col("_new") == 0, F.abs("_s"))
    good = runs.groupBy(by, "run").agg(F.count("*").alias("n"), (F.max("ev") - F.min("ev")).alias("_w"), (F.max(inner) - F.min(inner)).alias("_u")).where((F.col("n") >= least) & (F.col("_w") >= span) & (F.col("_u") <= uneven))
    kept = runs.join(good.select(by, "run", "n"), [by, "run"])
    rung = F.row_number().over(W.partitionBy(by, "run").orderBy("ev", "path"))
    based = kept.withColumn("_r", rung)
    base = F.max(F.when(F.col("_r") == F.floor(F.col("n") / 2) + 1, F.col("ev"))).over(W.partitionBy(by, "run"))
    return based.withColumn("offset", base - F.col("ev")).select(by, "run", "path", "n", "offset")


def keep_split(df: DataFrame, group: list[str], strictness: float, min_keep: int, score: str = "aggregate") -> DataFrame:
    """``keep``: the best of each group and all within a margin of it, but at least ``min_keep``."""
    margin = (100 - strictness) / 100 * 5
    w = W.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(F.desc(score), "path"))
    return df.withColumn("keep", (F.col(score) >= F.max(score).over(w) - margin) | (rank <= min_keep))


def cull_reason(df: DataFrame, group: list[str]) -> DataFrame:
    """Why a shot falls behind its group's best: the first reason that holds."""
    best = df.groupBy(*group).agg(F.max_by(F.struct("path", "aggregate", "ev"), F.struct(F.col("aggregate"), -F.col("path"))).alias("b"))
    behind = df.join(best, group)
    reason = F.when(F.col("path") == F.col("b.path"), "best").when(F.col("kind") == "error", "failed").when(F.col("ev") < F.col("b.ev") - 30, "darker").when(F.col("aggregate") < F.col("b.aggregate") - 3, "weaker").otherwise("similar")
    return behind.withColumn("reason", reason).drop("b")


def auto_cull(groups: dict[str, DataFrame], strictness: float = 50, min_keep: int = 1, score: str = "aggregate", whole: DataFrame | None = None) -> DataFrame:
    """Rows ``path, source, keep``: kinds in the given order, the first decision for a shot wins; groups left with one row are skipped.

    Shots of ``whole`` (a ``path`` each, frames of panoramas) are kept before all kinds, as ``panorama``.
    """
    done = None if whole is None else stash(whole.where("path is not null").select("path").distinct().select("path", F.lit("panorama").alias("source"), F.lit(True).alias("keep")))
    for name, df in groups.items():
        left = df if done is None else df.join(done.select("path"), "path", "left_anti")
        sized = left.where("grp is not null").withColumn("_n", F.count("*").over(W.partitionBy("grp")))  # in the same place as the ranks, so rows are dealt once
        part = stash(keep_split(sized, ["grp"], strictness, min_keep, score).where("_n >= 2").select("path", F.lit(name).alias("source"), "keep"))
        done = part if done is None else done.unionByName(part)
    return done


def reconciled(found: DataFrame, suppressed: DataFrame, forced: DataFrame) -> DataFrame:
    """Detected runs without those that touch a suppressed shot, plus the forced runs."""
    bad = found.join(suppressed, "path", "left_semi").select("run").distinct()
    return found.join(bad, "run", "left_anti").select("run", "path").unionByName(forced.select("run", "path"))


def stale_runs(runs: DataFrame, watermark, stamp: str = TIME) -> DataFrame:
    """Runs that hold a row newer than the watermark, or one without a stamp: only these are measured again."""
    return runs.groupBy("run").agg(F.bool_or(F.col(stamp).isNull() | (F.col(stamp) > watermark)).alias("stale"))


def trips(df: DataFrame, home_km: float, gap_hours: float, least: int) -> DataFrame:
    """Runs away from home; home is each person's most frequent half-degree cell."""
    from shelfmark.functions.scalars import haversine

    cell = lambda c: F.bround(F.col(c) / 0.5) * 0.5
    counts = df.groupBy("camera", cell("lat").alias("la"), cell("lon").alias("lo")).agg(F.count("*").alias("n"))
    home = counts.groupBy("camera").agg(F.min_by(F.struct("la", "lo"), F.struct(-F.col("n"), F.col("la"), F.col("lo"))).alias("h"))
    away = df.join(home, "camera").where(haversine("lat", "lon", "h.la", "h.lo") >= home_km).drop("h")
    runs = sessions(away, gap_hours * 3600, ["camera"], name="trip")
    return runs.groupBy("camera", "trip").agg(F.count("*").alias("n"), F.min(TIME).alias("began"), F.max(TIME).alias("ended")).where(F.col("n") >= least)


GAPS = "SELECT *, captured_at - lag(captured_at) OVER (ORDER BY captured_at, path) <= INTERVAL 15 MINUTE AS near FROM shot"
SCENED = f"SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (ORDER BY captured_at, path ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM ({GAPS})"
HOURLY = "SELECT *, camera::VARCHAR || ' ' || strftime(captured_at, '%Y-%m-%d %H') AS grp FROM shot"


def hourly(v) -> DataFrame:
    return v.shot.withColumn("grp", F.concat_ws(" ", F.col("camera").cast("string"), F.date_format(TIME, "yyyy-MM-dd HH")))


@query("i1_scenes", f"SELECT path, session FROM ({SCENED})")
def _(v):
    return sessions(v.shot, 15 * 60).select("path", "session")


@query("i2_adaptive_gap", "SELECT camera, round(greatest(3600.0, d * 3), 3) AS gap FROM (SELECT camera, d, row_number() OVER (PARTITION BY camera ORDER BY d) AS rn, count(*) OVER (PARTITION BY camera) AS n FROM (SELECT camera, (epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (PARTITION BY camera ORDER BY captured_at, path)) / 1e6 AS d FROM shot) WHERE d > 0) WHERE rn = n // 2 + 1")
def _(v):
    return adaptive_gap(v.shot, "camera", 3600, 3).select("camera", F.round("gap", 3).alias("gap"))


@query("f25_widest_gap", """WITH g AS (SELECT camera, path, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY camera) AS n, epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER w AS gap FROM shot WINDOW w AS (PARTITION BY camera ORDER BY captured_at, path))
  SELECT camera, path AS cut, gap FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY camera ORDER BY gap DESC, abs(pos - n / 2.0), pos) = 1""")
def _(v):
    return widest_gaps(v.shot, "camera")


@query("i5_scene_summary", f"""SELECT s.session, count(*)::BIGINT AS n, strftime(min(captured_at), '%Y-%m-%d %H:%M:%S') AS began, min_by(path, (-aggregate, path)) AS best, any_value(d.kind) AS dominant FROM ({SCENED}) s
  JOIN (SELECT session, kind, row_number() OVER (PARTITION BY session ORDER BY round(sum(aggregate), 6) DESC, kind) AS rn FROM ({SCENED}) GROUP BY 1, 2) d ON d.session = s.session AND d.rn = 1 GROUP BY 1""")
def _(v):
    return scene_summary(sessions(v.shot, 15 * 60)).select("session", "n", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), "best", "dominant")


@query("i6_bursts")
def _(v):
    shots = v.shot.select("path", TIME, F.xxhash64(F.col("ev")).alias("hash"), (F.col("camera") % 5).alias("person"))
    return bursts(shots, 15, 300, 24)


@query("i7_shared_person", "SELECT path, ev % 3 = 0 OR camera % 5 = ev % 5 AS shares FROM shot")
def _(v):
    mine = F.when(F.col("ev") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array((F.col("ev") % 5).cast("bigint")))
    return v.shot.select("path", ((F.size(mine) == 0) | F.arrays_overlap(mine, F.array(F.col("camera") % 5))).alias("shares"))


@query("i8_group_lead", "SELECT path, session FROM (SELECT path, session, row_number() OVER (PARTITION BY session ORDER BY aggregate DESC, captured_at, path) AS rn FROM (" + SCENED + ")) WHERE rn = 1")
def _(v):
    return lead(sessions(v.shot, 15 * 60), ["session"]).where("is_lead").select("path", "session")


@query("i9_brackets", """WITH s AS (SELECT *, ev - lag(ev) OVER w AS st, (epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER w) / 1e6 AS dt FROM shot WINDOW w AS (PARTITION BY camera ORDER BY captured_at, path)),
  b AS (SELECT *, lag(CASE WHEN dt <= 7200 AND abs(st) >= 5 THEN st END) OVER (PARTITION BY camera ORDER BY captured_at, path) AS pb FROM s),
  r AS (SELECT *, sum(CASE WHEN dt <= 7200 AND abs(st) >= 5 AND (pb IS NULL OR sign(pb) = sign(st)) THEN 0 ELSE 1 END) OVER (PARTITION BY camera ORDER BY captured_at, path ROWS UNBOUNDED PRECEDING) AS run FROM b),
  f AS (SELECT *, row_number() OVER (PARTITION BY camera, run ORDER BY captured_at, path) = 1 AS first_row FROM r),
  g AS (SELECT camera, run, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 3 AND max(ev) - min(ev) >= 10 AND max(CASE WHEN NOT first_row THEN abs(st) END) - min(CASE WHEN NOT first_row THEN abs(st) END) <= 60)
  SELECT path, n::BIGINT AS n FROM f JOIN g ON g.camera = f.camera AND g.run = f.run""")
def _(v):
    return brackets(v.shot, 7200, 5, 10, 60).select("path", "n")


LIKE9 = "bit_count(xor(hash, lag(hash) OVER w)) <= 1"


@query("i9_gated_brackets", f"""WITH h AS (SELECT *, (ev // 20)::BIGINT AS hash FROM shot), s AS (SELECT *, ev - lag(ev) OVER w AS st, (epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER w) / 1e6 AS dt, coalesce({LIKE9}, false) AS alike FROM h WINDOW w AS (PARTITION BY camera ORDER BY captured_at, path)),
  j AS (SELECT *, coalesce(dt <= 7200 AND abs(st) >= 5 AND alike, false) AS fits FROM s), b AS (SELECT *, lag(CASE WHEN fits THEN st END) OVER (PARTITION BY camera ORDER BY captured_at, path) AS pb FROM j),
  r AS (SELECT *, CASE WHEN fits AND (pb IS NULL OR sign(pb) = sign(st)) THEN 0 ELSE 1 END AS fresh FROM b), t AS (SELECT *, sum(fresh) OVER (PARTITION BY camera ORDER BY captured_at, path ROWS UNBOUNDED PRECEDING) AS run FROM r),
  g AS (SELECT camera, run, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 3 AND max(ev) - min(ev) >= 10 AND max(CASE WHEN fresh = 0 THEN abs(st) END) - min(CASE WHEN fresh = 0 THEN abs(st) END) <= 60)
  SELECT path, n::BIGINT AS n FROM t JOIN g ON g.camera = t.camera AND g.run = t.run""")
def _(v):
    return brackets(v.shot.withColumn("hash", F.floor(F.col("ev") / 20).cast("bigint")), 7200, 5, 10, 60, hash_col="hash", bits=1).select("path", "n")


@query("i10_base_offset", "SELECT path, (base - ev)::INTEGER AS off FROM (SELECT path, ev, max(CASE WHEN rn = n // 2 + 1 THEN ev END) OVER (PARTITION BY grp) AS base FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ev, path) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM (" + HOURLY + ")))")
def _(v):
    w = W.partitionBy("grp")
    ranked = hourly(v).withColumn("rn", F.row_number().over(w.orderBy("ev", "path"))).withColumn("n", F.count("*").over(w))
    base = F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("ev"))).over(w)
    return ranked.select("path", (base - F.col("ev")).alias("off"))


@query("i11_lead_promotion", "SELECT grp, min_by(path, (abs(ev - 50), path)) AS lead FROM (" + HOURLY + ") GROUP BY grp HAVING count(*) >= 2 AND bool_and(ev >= 20)")
def _(v):
    groups = hourly(v).groupBy("grp").agg(F.count("*").alias("n"), F.bool_and(F.col("ev") >= 20).alias("all_in"), F.min_by("path", F.struct(F.abs(F.col("ev") - 50), F.col("path"))).alias("lead"))
    return groups.where("n >= 2 and all_in").select("grp", "lead")


@query("i13_kind_by_span", "SELECT grp, CASE WHEN max(ev) - min(ev) >= 40 THEN 'hdr' ELSE 'plain' END AS kind FROM (" + HOURLY + ") GROUP BY 1 HAVING count(*) >= 2")
def _(v):
    return hourly(v).groupBy("grp").agg(F.count("*").alias("n"), F.when(F.max("ev") - F.min("ev") >= 40, "hdr").otherwise("plain").alias("kind")).where("n >= 2").drop("n")


@query("i14_reconcile", "SELECT session AS run, path FROM (" + SCENED + ") WHERE session NOT IN (SELECT session FROM (" + SCENED + ") WHERE path % 101 = 0) UNION ALL SELECT -1, path FROM shot WHERE path < 3")
def _(v):
    found = stash(sessions(v.shot, 15 * 60).select(F.col("session").alias("run"), "path"))
    return reconciled(found, v.shot.where("path % 101 = 0").select("path"), v.shot.where("path < 3").select(F.lit(-1).cast("bigint").alias("run"), "path"))


@query("i15_stale_runs", "SELECT camera AS run, bool_or(captured_at > TIMESTAMP '2024-01-29 00:00:00') AS stale FROM shot GROUP BY 1")
def _(v):
    return stale_runs(v.shot.withColumnRenamed("camera", "run"), F.lit("2024-01-29 00:00:00").cast("timestamp"))


@query("i16_trips", """WITH e AS (SELECT s.*, n_nationkey * 7.0 - 84 + CAST(ev % 10 AS DOUBLE) AS lat, n_regionkey * 60.0 - 120 AS lon FROM shot s JOIN nation ON n_nationkey = ev % 25),
  c AS (SELECT camera, round_even(lat / 0.5, 0) * 0.5 AS la, round_even(lon / 0.5, 0) * 0.5 AS lo, count(*) AS n FROM e GROUP BY 1, 2, 3), h AS (SELECT camera, min_by((la, lo), (-n, la, lo)) AS p FROM c GROUP BY 1),
  a AS (SELECT e.*, pow(sin((radians(p[1]) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(p[1])) * pow(sin((radians(p[2]) - radians(lon)) / 2), 2) AS hv FROM e JOIN h ON h.camera = e.camera),
  w AS (SELECT *, CASE WHEN epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (PARTITION BY camera ORDER BY captured_at, path) <= 86400000000 THEN 0 ELSE 1 END AS nw FROM a WHERE 2 * 6371.0 * atan2(sqrt(hv), sqrt(1 - hv)) >= 50),
  t AS (SELECT *, sum(nw) OVER (PARTITION BY camera ORDER BY captured_at, path ROWS UNBOUNDED PRECEDING)::BIGINT AS trip FROM w) SELECT camera, trip, count(*)::BIGINT AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 8""")
def _(v):
    place = v.table("nation").select("n_nationkey", "n_regionkey")
    rows = v.shot.join(F.broadcast(place), F.col("n_nationkey") == F.col("ev") % 25).select("*", (F.col("n_nationkey") * 7.0 - 84 + (F.col("ev") % 10).cast("double")).alias("lat"), (F.col("n_regionkey") * 60.0 - 120).alias("lon"))
    return trips(rows, 50, 24, 8).select("camera", "trip", "n")


@query("i17_segment_ranges", "SELECT camera, count(*) FILTER (d IS NULL OR d > 21600)::BIGINT AS segments FROM (SELECT camera, (epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER (PARTITION BY camera ORDER BY captured_at, path)) / 1e6 AS d FROM shot) GROUP BY 1")
def _(v):
    return sessions(v.shot, 21600, ["camera"]).groupBy("camera").agg(F.max("session").alias("segments"))


@query("i18_group_feed", "SELECT grp, count(*)::BIGINT AS n, min_by(path, (-aggregate, path)) AS best, string_agg(path::VARCHAR, ',' ORDER BY aggregate DESC, path) AS members FROM (" + HOURLY + ") GROUP BY 1 HAVING count(*) >= 2")
def _(v):
    members = F.array_sort(F.collect_list(F.struct((-F.col("aggregate")).alias("m"), F.col("path"))))
    groups = hourly(v).groupBy("grp").agg(F.count("*").alias("n"), members.alias("m")).where("n >= 2")
    return groups.select("grp", "n", F.col("m")[0]["path"].alias("best"), F.array_join(F.transform("m", lambda x: x["path"].cast("string")), ",").alias("members"))


@query("i19_redundant_brackets", "SELECT grp FROM (" + HOURLY + ") GROUP BY 1 HAVING count(*) >= 2 AND min_by(ev, (aggregate, path)) BETWEEN 10 AND 90 AND bool_and(ev <> 0)")
def _(v):
    groups = hourly(v).groupBy("grp").agg(F.count("*").alias("n"), F.min_by("ev", F.struct("aggregate", "path")).alias("base"), F.bool_and(F.col("ev") != 0).alias("measured"))
    return groups.where("n >= 2 and base between 10 and 90 and measured").select("grp")


@query("i20_cull_reason", """SELECT s.path, CASE WHEN s.path = b.p THEN 'best' WHEN kind = 'error' THEN 'failed' WHEN ev < b.e - 30 THEN 'darker' WHEN aggregate < b.a - 3 THEN 'weaker' ELSE 'similar' END AS reason FROM (""" + HOURLY + """) s
  JOIN (SELECT grp, min_by(path, (-aggregate, path)) AS p, max(aggregate) AS a, min_by(ev, (-aggregate, path)) AS e FROM (""" + HOURLY + """) GROUP BY 1) b ON b.grp = s.grp""")
def _(v):
    return cull_reason(hourly(v), ["grp"]).select("path", "reason")


@query("i21_keep_split", "SELECT path, aggregate >= max(aggregate) OVER (PARTITION BY grp) - 1.5 OR row_number() OVER (PARTITION BY grp ORDER BY aggregate DESC, path) <= 1 AS keep FROM (" + HOURLY + ")")
def _(v):
    return keep_split(hourly(v), ["grp"], 70, 1).select("path", "keep")


@query("i22_auto_cull")
def _(v):
    scenes = sessions(v.shot, 15 * 60).withColumn("grp", F.col("session").cast("string")).drop("session")
    return auto_cull({"burst": hourly(v), "scene": scenes})


@query("i22_all_kinds")
def _(v):
    named = lambda df, *by: df.withColumn("grp", F.concat_ws(" ", *[F.col(c).cast("string") for c in by]))
    rung = named(brackets(v.shot, 7200, 5, 10, 60).join(v.shot.drop("camera"), "path"), "camera", "run")
    alike = named(v.shot.withColumn("day", F.to_date(TIME)), "camera", "kind", "day")
    scenes = named(sessions(v.shot, 15 * 60), "session")
    kinds = {"bracket": rung, "burst": hourly(v), "similar": alike, "scene": scenes}
    return auto_cull({k: df.select("path", "grp", "aggregate") for k, df in kinds.items()}, whole=v.shot.where("ev % 40 = 7").select("path"))


@query("i23_highlights", "SELECT grp, path FROM (SELECT grp, path, aggregate, row_number() OVER (PARTITION BY grp ORDER BY aggregate DESC, path) AS rn FROM (" + HOURLY + ")) WHERE rn = 1 AND aggregate >= 7")
def _(v):
    w = W.partitionBy("grp").orderBy(F.desc("aggregate"), "path")
    return hourly(v).withColumn("rn", F.row_number().over(w)).where("rn = 1 and aggregate >= 7").select("grp", "path")


@query("i24_reset_leads", "SELECT path, CASE WHEN count(*) OVER (PARTITION BY grp) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY grp ORDER BY aggregate DESC, captured_at, path) = 1 THEN 1 ELSE 0 END::INTEGER AS flag FROM (" + HOURLY + ")")
def _(v):
    rows = lead(hourly(v), ["grp"]).withColumn("n", F.count("*").over(W.partitionBy("grp")))
    return rows.select("path", F.when((F.col("n") > 1) & F.col("is_lead"), 1).otherwise(0).alias("flag"))
