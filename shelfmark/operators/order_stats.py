"""Ranks, quantiles and running totals within groups of any size.

Rows are range-partitioned by group and value, by splitters that Spark samples; each block sorts its own rows, and the blocks' totals, one row for each
block of a group, tell what lies before them. So no window and no aggregate holds a group's values, however many differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.runtime import forget, stash

BLOCK_ROWS = 50_000


def running_totals(rows: DataFrame, by: list[str], order: str, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``<c>_before``, the sum of each column over the rows before in ``order``, and ``<c>_all``, over the whole group; equal values of ``order`` stand in one row."""
    once = stash(rows)  # counted, sampled for splitters and dealt: three readers
    held = stash(once.repartitionByRange(max(1, -(-once.count() // block_rows)), *by, order).withColumn("_block", F.spark_partition_id()))
    forget(once)
    parts = held.groupBy("_block", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    key = [F.col(c) for c in by] or [F.lit(0)]
    earlier, whole = W.partitionBy(*key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*key)
    sums = parts.select("_block", *[F.col(c).alias(f"_g_{c}") for c in by], *[x for c in columns for x in (F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}"), F.sum(f"_t_{c}").over(whole).alias(f"{c}_all"))])
    inner = W.partitionBy("_block", *by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, [F.col("_block") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]])
    found = held.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in columns}).join(sums.withColumnRenamed("_block", "_of"), same)
    return found.withColumns({f"{c}_before": F.col(f"_b_{c}") + F.col(f"_i_{c}") for c in columns}).drop("_block", "_of", *[f"_g_{c}" for c in by], *[f"_{p}_{c}" for c in columns for p in "bi"])


def value_counts(df: DataFrame, by: list[str], x: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``by, x, k, k_before, k_all``: each value with its count, the count of smaller ones and the group's."""
    return running_totals(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("k")), by, x, ["k"], block_rows)


def at_index(counts: DataFrame, by: list[str], x: str, picks: dict[str, Column]) -> DataFrame:
    """For each group the values at some places (from 0) of its sorted rows; ``picks`` are columns of ``k_all``."""
    holds = lambda at: (F.col("k_before") <= at) & (at < F.col("k_before") + F.col("k"))
    near = counts.where(reduce(lambda a, b: a | b, [holds(at) for at in picks.values()]))
    return near.groupBy(*by).agg(F.max("k_all").alias("n"), *[F.max(F.when(holds(at), F.col(x))).alias(name) for name, at in picks.items()])


def quantiles(df: DataFrame, by: list[str], x: str, shares: list[float], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``by, n, q`` with the interpolated quantiles of the values that are not null."""
    counts = value_counts(df, by, x, block_rows)
    place = lambda p: (F.col("k_all") - 1) * F.lit(float(p))
    picks = {f"_{e}{i}": f(place(p)).cast("long") for i, p in enumerate(shares) for e, f in (("lo", F.floor), ("hi", F.ceil))}
    found = at_index(counts, by, x, picks)
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    return found.select(*by, "n", F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(p) for i, p in enumerate(shares)]).alias("q"))


def average_rank(df: DataFrame, by: list[str], x: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ranks from 1, ties averaged; rows whose value is null go."""
    ranks = value_counts(df, by, x, block_rows).select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col(x).alias("_r"), (F.col("k_before") + (F.col("k") + 1) / 2).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(x) == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]])
    return df.join(ranks, same).drop("_r", *[f"_r_{c}" for c in by])


def correlated_ranks(df: DataFrame, by: list[str], x: str, ranks: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``by, n, rho``: the correlation of the ranks of ``x`` with ranks that ``df`` has already, over the rows where ``x`` is known.

    Rows of equal ``x`` are summed before they are ranked, so no rank goes back to a row; sums are taken around the middle rank.
    """
    sums = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("k"), F.sum(ranks).alias("_r"), F.sum(F.col(ranks) * F.col(ranks)).alias("_q"))
    k, middle = F.col("k"), (F.col("k_all") + 1) / 2
    rank, other = F.col("k_before") + (k + 1) / 2 - middle, F.col("_r") - k * middle
    squares = F.col("_q") - 2 * middle * F.col("_r") + k * middle * middle
    out = running_totals(sums, by, x, ["k"], block_rows).groupBy(*by).agg(F.sum("k").alias("n"), F.sum(k * rank * rank).alias("_xx"), F.sum(rank * other).alias("_xy"), F.sum(squares).alias("_yy"), F.sum(other).alias("_y"))
    return out.select(*by, "n", F.try_divide("_xy", F.sqrt("_xx") * F.sqrt(F.greatest(F.lit(0.0), F.col("_yy") - F.col("_y") * F.col("_y") / F.col("n")))).alias("rho"))


def spearman(df: DataFrame, by: list[str], x: str, y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``by, n, rho`` over the rows where both values are known."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return correlated_ranks(average_rank(known, by, y, "_ry", block_rows), by, x, "_ry", block_rows)


def spearman_each(df: DataFrame, columns: tuple[str, ...], y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``name, n, rho`` of each column with ``y`` over the rows where both are known; ``y`` is ranked once for all columns that have no null, and for each other one."""
    known = stash(df.where(F.col(y).isNotNull()).select(F.col(y).alias("_y"), *columns))
    gaps = known.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    long = lambda rows, names, *rest: rows.select(*rest, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in names])))
    full, holed = [c for c in columns if not gaps[c]], [c for c in columns if gaps[c]]
    out = correlated_ranks(long(average_rank(known, [], "_y", "_ry", block_rows), full, "_ry"), ["name"], "x", "_ry", block_rows) if full else None
    if holed:
        part = spearman(long(known, holed, "_y"), ["name"], "x", "_y", block_rows)
        out = part if out is None else out.unionByName(part)
    return out


def auc(df: DataFrame, score: str, label: str, by: list[str] = [], least: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:  # noqa: B006
    """Area under the curve from counts of equal scores and the negatives below each."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    pairs = running_totals(counts, by, score, ["q"], block_rows).withColumn("won", F.col("p") * (F.col("q_before") + F.col("q") / 2))
    out = pairs.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum("won").alias("won"))
    return out.where((F.col("positives") >= least) & (F.col("negatives") >= least)).select(*by, "positives", F.try_divide("won", F.col("positives") * F.col("negatives")).alias("auc"))
