"""Work along an order, in blocks: label smoothing, panorama segments and scene splitting without a group that holds a whole session.

Rows are numbered in their order and cut into blocks of a bounded count of rows. What a block passes on is a small total
(a matrix product, a sum, the first break, a widest gap); totals are joined over blocks, and each block is read again with what comes in
from both sides. A session of any length is so dealt to as many tasks as it has blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.operators.sessions import TIME, micros, sessions
from shelfmark.registry import query
from shelfmark.runtime import forget, stash

BLOCK_ROWS = 20_000
#: Rows of a table of two or three numbers that is broadcast.
FEW_ROWS = 500_000


def few(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if a count shows that it is short."""
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def numbered(df: DataFrame, order: list[Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``pos``, its place in the order from 0, and ``block``, its range of places; written once."""
    blocks = max(1, -(-df.count() // block_rows))
    dealt = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    held = stash(dealt.withColumn("block", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    first = held.groupBy("block").agg(F.count("*").alias("_n")).withColumn("_first", F.sum("_n").over(W.orderBy("block")) - F.col("_n")).drop("_n")  # a row for each block
    return held.join(few(first), "block").withColumn("pos", F.col("_first") + F.col("_at")).drop("_first", "_at")


def near_counts(seeds: DataFrame, rows: DataFrame, seconds: int, key: str = "path", time: str = TIME) -> DataFrame:
    """Rows ``seed, near``: how many rows lie within ``seconds`` of a seed, its own key not counted; seeds without any are left out.

    The count is a difference of two running counts, over rows up to the window's end and over rows before its begin, so no pair is made.
    """
    from shelfmark.operators.order_stats import running_totals

    reach = seconds * 1_000_000
    asked = stash(seeds.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("seed"), micros(time).alias("_at")))
    edges = asked.select("seed", "_at", F.inline(F.array(F.struct((F.col("_at") - reach).alias("_t"), F.lit(False).alias("_end")), F.struct((F.col("_at") + reach).alias("_t"), F.lit(True).alias("_end")))))
    counted = rows.where(F.col(key).isNotNull()).select(micros(time).alias("_t"), F.lit(1).alias("k")).unionByName(edges.select("_t", F.lit(0).alias("k"))).where("_t is not null").groupBy("_t").agg(F.sum("k").alias("k"))
    before = running_totals(counted, [], "_t", ["k"]).select("_t", "k", "k_before")
    spans = edges.join(before, "_t").groupBy("seed", "_at").agg(F.sum(F.when(F.col("_end"), F.col("k_before") + F.col("k")).otherwise(-F.col("k_before"))).alias("_n"))
    own = asked.join(rows.select(F.col(key).alias("seed"), micros(time).alias("_t")), "seed").groupBy("seed").agg(F.count_if(F.abs(F.col("_t") - F.col("_at")) <= reach).alias("_own"))
    return spans.groupBy("seed").agg(F.sum("_n").alias("_n")).join(own, "seed", "left").select("seed", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("near")).where("near > 0")


# label smoothing


#: Of scores that differ by less the first label's wins.
TIE = 1e-9


def transitions(labels: int, stay: float, forward: float, weight: float, floor: float = 0.01) -> np.ndarray:
    """Logarithms of a soft step matrix over an ordered list of labels: staying, the next label, a floor for others; ``weight`` 0 makes all steps alike."""
    steps = np.full((labels, labels), floor) + stay * np.eye(labels) + forward * np.eye(labels, k=1)
    return weight * np.log(steps / steps.sum(axis=1, keepdims=True) + 1e-9)


def _emissions(probs: pd.Series) -> np.ndarray:
    return np.log(np.array(probs.tolist(), float) + 1e-9)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _first_best(x: np.ndarray) -> int:
    return int(np.argmax(x >= x.max() - TIE))


def _product(steps: np.ndarray, join) -> np.ndarray:
    """The product of a row of matrices, by pairs, where ``join`` adds (sum of logarithms, or maximum) over the middle label."""
    while len(steps) > 1:
        even = len(steps) // 2 * 2
        done = [join(steps[at : min(at + 2048, even) : 2, :, :, None] + steps[at + 1 : min(at + 2048, even) : 2, None, :, :], 2) for at in range(0, even, 2048)]
        steps = np.concatenate([*done, steps[even:]])
    return steps[0]


SUMS = "session long, block int, size int, best array<double>, total array<double>"
LINKS = "session long, block int, enters int, before array<double>, after array<double>, leaves int"


def _block_totals(move: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        out = []
        for session in {pdf["session"].iloc[0], pdf["session"].iloc[-1]}:  # others lie within the block
            emit = _emissions(pdf.loc[pdf["session"] == session, "probs"])
            steps = move[None] + emit[:, None, :]
            steps[0] = np.where(np.eye(len(move), dtype=bool), emit[0][None, :], -1e30)
            best, total = _product(steps, lambda x, axis: x.max(axis=axis)), _product(steps, _log_sum)
            out.append((session, pdf["block"].iloc[0], len(emit), best.ravel().tolist(), total.ravel().tolist()))
        return pd.DataFrame(out, columns=["session", "block", "size", "best", "total"])

    return run


def _link(move: np.ndarray):
    """One session's blocks, each a pair of matrices: what enters each from the left and the right."""
    size = len(move)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        best, total = ([np.array(m).reshape(size, size) for m in pdf[c]] for c in ("best", "total"))
        scores, sums = [best[0].max(axis=0)], [_log_sum(total[0], 0)]
        for b, t in zip(best[1:], total[1:], strict=True):
            scores.append((scores[-1][:, None] + (move[:, :, None] + b[None]).max(axis=1)).max(axis=0))
            sums.append(_log_sum(sums[-1][:, None] + _log_sum(move[:, :, None] + t[None], 1), 0))
        leaves, after = [_first_best(scores[-1])], [np.zeros(size)]
        for at in range(len(pdf) - 1, 0, -1):
            through = (move[:, :, None] + best[at][None]).max(axis=1)
            leaves.append(_first_best(scores[at - 1] + through[:, leaves[-1]]))
            after.append(_log_sum(_log_sum(move[:, :, None] + total[at][None], 1) + after[-1][None, :], 1))
        leaves, after = leaves[::-1], after[::-1]
        return pd.DataFrame({"session": pdf["session"], "block": pdf["block"], "enters": [None, *leaves[:-1]], "before": [None, *(s.tolist() for s in sums[:-1])], "after": [a.tolist() for a in after], "leaves": leaves}).astype({"enters": "Int32", "leaves": "Int32"})

    return run


def decode(emit: np.ndarray, move: np.ndarray, enters: int | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None, leaves: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best labels of a stretch and their posteriors, given what lies before and after it."""
    n, size = emit.shape
    back, score = np.zeros((n, size), np.int64), emit[0] + (0 if enters is None else move[enters])
    alpha, beta = np.empty((n, size)), np.empty((n, size))
    alpha[0] = emit[0] + (0 if before is None else _log_sum(before[:, None] + move, 0))
    for t in range(1, n):
        paths = score[:, None] + move
        top = paths.max(axis=0)
        back[t], score = np.argmax(paths >= top - TIE, axis=0), top + emit[t]
        alpha[t] = emit[t] + _log_sum(alpha[t - 1][:, None] + move, 0)
    beta[-1] = 0 if after is None else after
    for t in range(n - 2, -1, -1):
        beta[t] = _log_sum(move + (emit[t + 1] + beta[t + 1])[None, :], 1)
    labels = np.zeros(n, np.int64)
    labels[-1] = _first_best(score) if leaves is None else leaves
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    posterior = alpha + beta
    posterior -= _log_sum(posterior, 1)[:, None]
    return labels, np.exp(posterior[np.arange(n), labels])


def smooth_labels(df: DataFrame, labels: int, stay: float = 0.6, forward: float = 0.3, weight: float = 0.5, gap_seconds: float = 6 * 3600, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``path, state, confidence``: the likeliest sequence of labels of each stretch without a large gap, and each label's posterior in it.

    ``df`` has ``path``, ``captured_at`` and ``probs``, an array of ``labels`` numbers. Both recursions are products of step matrices, by maximum and by sum of
    logarithms: blocks give their products, the products of a stretch are joined, and each block is decoded with what comes in from both ends.
    Rows without a time or numbers have null results; weight 0 gives each row's own best label.
    """
    move = transitions(labels, stay, forward, weight)
    known = F.col(TIME).isNotNull() & F.col("probs").isNotNull() & F.coalesce(F.size("probs") == labels, F.lit(False))
    timed = sessions(df.where(F.col(TIME).isNotNull()), gap_seconds).where(known).select(F.col("session").cast("long").alias("session"), "path", TIME, F.col("probs").cast("array<double>").alias("probs"))
    rows = stash(numbered(timed, [F.col("session"), F.col(TIME), F.col("path")], block_rows))
    links = rows.groupBy("block").applyInPandas(_block_totals(move), SUMS).groupBy("session").applyInPandas(_link(move), LINKS)

    def finish(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf, ends, out = pdf.sort_values("pos", kind="stable"), {r.session: r for r in known.itertuples()}, []
        for session, part in pdf.groupby("session", sort=False):
            end = ends.get(session)
            given = {} if end is None else {"enters": None if pd.isna(end.enters) else int(end.enters), "before": None if end.before is None else np.array(end.before), "after": np.array(end.after), "leaves": int(end.leaves)}
            state, sure = decode(_emissions(part["probs"]), move, **given)
            out.append(pd.DataFrame({"path": part["path"].to_numpy(), "state": state.astype(np.int32), "confidence": sure}))
        return pd.concat(out) if out else pd.DataFrame({"path": [], "state": [], "confidence": []})

    kind = df.schema["path"].dataType.simpleString()
    done = rows.groupBy("block").cogroup(links.groupBy("block")).applyInPandas(finish, f"path {kind}, state int, confidence double")
    return done.unionByName(df.where(~known).select("path", F.lit(None).cast("int").alias("state"), F.lit(None).cast("double").alias("confidence")))


# panorama segments


#: Bounds of a sweep; lengths are shares of a frame.
SWEEP = {"min_frames": 8, "min_inliers": 25, "min_drift": 0.43, "max_step": 0.90, "back_tolerance": 0.02, "max_ortho": 0.15, "ortho_ratio": 0.25, "step_ortho_abs": 0.02, "step_ortho_ratio": 0.5}
#: Steps are summed in whole millionths, so that sums don't depend on how rows are dealt.
UNIT = 1_000_000
WAYS = [("x", 1), ("x", -1), ("y", 1), ("y", -1)]


def _reached(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """The places that are met on the way from ``starts`` (``pos``) along ``jumps`` (``pos, next``); pointers double in length each round."""
    now, count = stash(starts), -1
    while (held := now.count()) != count:
        count = held
        ahead = now.join(jumps, "pos").where("next is not null").select(F.col("next").alias("pos"))
        last, now = now, stash(now.unionByName(ahead).distinct())
        far = jumps.select(F.col("pos").alias("next"), F.col("next").alias("far"))
        old, jumps = jumps, stash(jumps.where("next is not null").join(far, "next").select("pos", F.col("far").alias("next")))
        forget(last)
        forget(old)
    return now


def _walked(rows: DataFrame) -> DataFrame:
    """The places that are met from each run's first one on; ``rows`` has ``block, pos, first, next``, and places that follow lie ahead.

    Each block tells where a walk that stands at a place leaves it. Pointers double over the few places alone where walks enter a block, and each block is walked again from these.
    """

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        place, ahead = pdf["pos"].to_numpy(), pdf["next"].fillna(-1).to_numpy(np.int64)
        inside = np.searchsorted(place, ahead).tolist()
        exits, last = ahead.tolist(), int(place[-1])
        for i in range(len(exits) - 1, -1, -1):
            if 0 <= exits[i] <= last:
                exits[i] = exits[inside[i]]
        return pd.DataFrame({"block": pdf["block"], "pos": place, "next": pd.array(np.where(np.array(exits) < 0, 0, exits), "Int64"), "done": np.array(exits) < 0})

    def walk(pdf: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        place, ahead = pdf["pos"].to_numpy(), pdf["next"].fillna(-1).to_numpy(np.int64)
        inside, met = np.where((ahead >= 0) & (ahead <= place[-1]), np.searchsorted(place, ahead), -1).tolist() if len(pdf) else [], set()
        for at in np.searchsorted(place, entered["pos"].to_numpy()).tolist():
            while at >= 0 and at not in met:
                met.add(at)
                at = inside[at]
        return pd.DataFrame({"pos": place[sorted(met)]})

    exits = rows.groupBy("block").applyInPandas(leave, "block int, pos long, next long, done boolean")
    exits = stash(exits.select("block", "pos", F.when(~F.col("done"), F.col("next")).alias("next")))
    starts = rows.where("pos = first").select("pos")
    doors = exits.where("next is not null").select(F.col("next").alias("pos")).unionByName(starts).distinct()
    doors = stash(exits.join(doors, "pos"))
    entered = _reached(starts, doors.select("pos", "next")).join(doors.select("pos", "block"), "pos")
    return rows.select("block", "pos", "next").groupBy("block").cogroup(entered.groupBy("block")).applyInPandas(walk, "pos long")


def panorama_segments(frames: DataFrame, settings: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``run, path, segment, axis, drift, ortho`` of the frames that belong to a sweep; a sweep is numbered by its first frame's place in the run.

    ``frames`` has ``run, path, captured_at`` and the measured step to the run's next frame, ``dx, dy, inliers`` (null where nothing was matched). From each
    frame a sweep may go on along either axis and way as long as steps fit; the way with the largest drift counts (by length the axis without motion would always
    win). The walk along a run takes accepted sweeps whole and goes on behind them. Where a way breaks next comes from a scan over blocks, sums from differences of running sums, and the walk from doubled pointers.
    """
    s = SWEEP | (settings or {})
    rows = stash(numbered(frames.select("run", "path", TIME, "dx", "dy", "inliers"), [F.col("run"), F.col(TIME), F.col("path")], block_rows))
    ends = rows.groupBy("run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    whole = lambda c: F.round(F.col(c) * UNIT).cast("long")
    seen = rows.join(few(ends), "run").withColumn("ok", F.coalesce((F.col("inliers") >= s["min_inliers"]) & F.col("dx").isNotNull() & F.col("dy").isNotNull() & (F.col("pos") < F.col("last")), F.lit(False)))
    seen = seen.withColumn("x", F.when(F.col("ok"), whole("dx")).otherwise(0)).withColumn("y", F.when(F.col("ok"), whole("dy")).otherwise(0))
    units = lambda v: F.lit(round(v * UNIT))
    broken = {}
    for axis, sign in WAYS:
        along, across = (F.col("x"), F.col("y")) if axis == "x" else (F.col("y"), F.col("x"))
        slant = F.greatest(units(s["step_ortho_abs"]).cast("double"), F.lit(s["step_ortho_ratio"]) * F.abs(along))
        broken[axis, sign] = ~F.col("ok") | (F.abs(along) > units(s["max_step"])) | (along * sign < -units(s["back_tolerance"])) | (F.abs(across) > slant)
    # running sums and the next break of each way: within blocks by windows, over blocks from their totals
    before = W.partitionBy("block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("block").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)  # backwards, as a frame up to the end is summed anew for each row
    summed = seen.withColumn("sx", F.coalesce(F.sum("x").over(before), F.lit(0))).withColumn("sy", F.coalesce(F.sum("y").over(before), F.lit(0)))
    over = W.orderBy("block")  # a row for each block
    totals = stash(summed.groupBy("block").agg(F.sum("x").alias("tx"), F.sum("y").alias("ty")))
    totals = totals.select("block", (F.sum("tx").over(over) - F.col("tx")).alias("bx"), (F.sum("ty").over(over) - F.col("ty")).alias("by"))
    placed = summed.join(few(totals), "block").withColumn("sx", F.col("sx") + F.col("bx")).withColumn("sy", F.col("sy") + F.col("by")).drop("bx", "by")
    breaks = [F.min(F.when(broken[way], F.struct("pos", "sx", "sy"))) for way in WAYS]
    held = stash(placed.select("*", *[b.over(behind).alias(f"b{k}") for k, b in enumerate(breaks)]))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    firsts = held.groupBy("block").agg(*[F.min(f"b{k}").alias(f"f{k}") for k in range(len(WAYS))])
    firsts = firsts.select("block", *[F.min(f"f{k}").over(later).alias(f"f{k}") for k in range(len(WAYS))])
    met = held.join(few(firsts), "block")
    found = []
    for k, (axis, _) in enumerate(WAYS):
        end = F.coalesce(F.col(f"b{k}"), F.col(f"f{k}"))
        mx, my = F.abs(end["sx"] - F.col("sx")), F.abs(end["sy"] - F.col("sy"))
        drift, ortho = (mx, my) if axis == "x" else (my, mx)
        # of equal drifts the longer one counts, then the first way
        way = F.struct(drift.alias("drift"), end["pos"].alias("end"), F.lit(-k).alias("way"), ortho.alias("ortho"), F.lit(axis).alias("axis"))
        found.append(F.when(end["pos"] - F.col("pos") + 1 >= s["min_frames"], way))
    best = F.when(F.col("ok"), F.greatest(*found))
    cap = F.greatest(units(s["max_ortho"]).cast("double"), F.lit(s["ortho_ratio"]) * F.col("best.drift"))
    judged = met.withColumn("best", best).withColumn("taken", F.coalesce((F.col("best.drift") >= units(s["min_drift"])) & (F.col("best.ortho") <= cap), F.lit(False)))
    go = F.when(F.col("taken"), F.col("best.end") + 1).otherwise(F.greatest(F.coalesce(F.col("best.end"), F.lit(0)), F.col("pos") + 1))
    walked = stash(judged.select("run", "path", "block", "pos", "first", "taken", "best", F.when(go <= F.col("last"), go).alias("next")))
    reached = _walked(walked)
    sweeps = walked.where("taken").join(reached, "pos", "left_semi").select("run", (F.col("pos") - F.col("first")).alias("segment"), "best.axis", (F.col("best.drift") / UNIT).alias("drift"), (F.col("best.ortho") / UNIT).alias("ortho"), F.explode(F.sequence("pos", "best.end")).alias("pos"))
    return sweeps.join(walked.select("pos", "path"), "pos").select("run", "path", "segment", "axis", "drift", "ortho")


# scenes


def _with_previous(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the named columns of the row before as ``was_<name>``, null for the first."""
    other = rows.select((F.col("pos") + 1).alias("pos"), *[F.col(c).alias(f"was_{c}") for c in columns])
    return rows.join(other, "pos", "left")


def _starts_of(rows: DataFrame, new: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the place of the last row up to here for which ``new`` holds; within blocks by a window, over blocks from their last ones."""
    marked = stash(rows.withColumn("_new", F.when(new, F.col("pos"))))
    inner = F.max("_new").over(W.partitionBy("block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    last = marked.groupBy("block").agg(F.max("_new").alias("_last")).withColumn("_carry", F.max("_last").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    return marked.withColumn("_inner", inner).join(few(last), "block").withColumn(name, F.coalesce("_inner", "_carry")).drop("_new", "_inner", "_carry")


def split_scenes(scened: DataFrame, least: int = 3, most: int = 40, block_rows: int = BLOCK_ROWS, label: str = "kind") -> DataFrame:
    """Rows ``session, path, part``; a part is numbered by its first row's place in the session.

    A scene is cut where its label changes to one that holds for ``least`` rows, at ``least`` rows from its start (scenes under twice that stay whole). Parts of more than ``most`` rows are then
    cut at their widest gap, of equal ones at that nearest the middle, all of them at once in each round, until none is too large. Rounds read the parts that are still
    too large alone. Null labels begin no part.
    """
    rows = stash(numbered(scened.select("session", "path", TIME, F.col(label).alias("label")), [F.col("session"), F.col(TIME), F.col("path")], block_rows))
    sized = rows.join(few(rows.groupBy("session").agg(F.min("pos").alias("first"), F.count("*").alias("n"))), "session")
    known = _with_previous(sized.withColumn("at", micros(TIME)), ["session", "label", "at"])
    begins = F.col("pos") == F.col("first")
    runs = _starts_of(known, begins | ~F.col("label").eqNullSafe(F.col("was_label")), "run")
    lengths = runs.groupBy("run").agg(F.count("*").alias("length"))
    headed = runs.join(lengths.withColumnRenamed("run", "pos"), "pos", "left")
    change = (F.col("length") >= least) & F.col("label").isNotNull() & (F.col("pos") - F.col("first") >= least) & (F.col("n") >= 2 * least)
    cut = _starts_of(headed, begins | F.coalesce(change, F.lit(False)) if least >= 1 else begins, "part")
    held = stash(cut.select("session", "path", "pos", "part", "first", (F.col("at") - F.col("was_at")).alias("gap")))
    done: list[DataFrame] = []
    while True:
        parts = held.groupBy("part").agg(F.count("*").alias("size"))
        large = few(stash(parts.where(F.col("size") > most)))
        done.append(held.join(large, "part", "left_anti"))
        left = held.join(large, "part")
        inside = left.where(F.col("pos") > F.col("part"))
        place = F.col("pos") - F.col("part")
        widest = F.max(F.struct("gap", (-F.abs(place - F.col("size") / 2)).alias("near"), (-F.col("pos")).alias("early")))
        cuts = few(stash(inside.groupBy("part").agg((-widest["early"]).alias("cut"))))
        if cuts.isEmpty():
            break
        held = stash(left.join(cuts, "part").withColumn("part", F.when(F.col("pos") >= F.col("cut"), F.col("cut")).otherwise(F.col("part"))).drop("size", "cut"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("session", "path", (F.col("part") - F.col("first")).alias("part"))


@query("l5_smoothed_labels")
def _(v):
    probs = F.array(*[(1 + (F.col("ev") + i * 31) % 97).cast("double") for i in range(3)])
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    found = smooth_labels(v.shot.select("path", TIME, F.transform(probs, lambda x: x / total).alias("probs")), 3, gap_seconds=1800)
    return found.select("path", "state", F.round("confidence", 6).alias("confidence"))


@query("i12_panorama_segments")
def _(v):
    # steps that mostly drift along x, some along y, some that fit no sweep
    along, across = (F.col("ev") % 7 - 1).cast("double") / 20, (F.col("path") % 3 - 1).cast("double") / 100
    turned = F.col("ev") % 11 > 7
    steps = v.shot.select((F.col("camera") % 40).alias("run"), "path", TIME, F.when(turned, across).otherwise(along).alias("dx"), F.when(turned, along).otherwise(across).alias("dy"), (F.col("ev") + 10).alias("inliers"))
    return panorama_segments(steps, {"min_frames": 3, "min_drift": 0.1, "min_inliers": 15, "back_tolerance": 0.06})


SCENES = """WITH RECURSIVE g AS (SELECT path, captured_at, kind, coalesce(captured_at - lag(captured_at) OVER (ORDER BY captured_at, path) <= INTERVAL 30 MINUTE, false) AS near FROM shot),
  s AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (ORDER BY captured_at, path ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
  r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session) AS n, epoch_us(captured_at) - lag(epoch_us(captured_at)) OVER w AS gap, kind IS DISTINCT FROM lag(kind) OVER w AS turned FROM s WINDOW w AS (PARTITION BY session ORDER BY captured_at, path)),
  k AS (SELECT *, sum(turned::INT) OVER (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING) AS stretch FROM r),
  l AS (SELECT *, count(*) OVER (PARTITION BY session, stretch) AS length FROM k),
  c AS (SELECT *, max(CASE WHEN i = 0 OR (turned AND kind IS NOT NULL AND length >= 3 AND i >= 3 AND n >= 6) THEN i END) OVER (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM l),
  rounds AS (SELECT 0 AS turn, session, path, i, gap, part, count(*) OVER (PARTITION BY session, part) AS size FROM c UNION ALL
    SELECT turn + 1, session, path, i, gap, part, count(*) OVER (PARTITION BY session, part) FROM (SELECT turn, session, path, i, gap, CASE WHEN i >= cut THEN cut ELSE part END AS part FROM (
      SELECT *, first_value(CASE WHEN i > part THEN i END) OVER (PARTITION BY session, part ORDER BY i > part DESC, gap DESC, abs(i - part - size / 2.0), i) AS cut FROM rounds WHERE size > 40)))
  SELECT session, path, part::BIGINT AS part FROM rounds WHERE size <= 40"""


@query("i3_i4_split_scenes", SCENES)
def _(v):
    return split_scenes(sessions(v.shot, 30 * 60), 3, 40)
