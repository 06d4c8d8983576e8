"""Joins, groups, diverse choice and an index over vectors, dealt to cells around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.functions.scalars import cosine
from shelfmark.operators.alike import SIDE_BYTES, TILE, Cosine, linked_components, units
from shelfmark.runtime import forget, stash

#: Vectors of a block, whatever the table's size.
BLOCK_ROWS = 2048
#: Pivots that are broadcast, and vectors on which a quantiser is fitted; with 512 dimensions 8 MB and 80 MB.
MOST_PIVOTS, FIT_ROWS = 2048, 20_000
#: Slack of an angle, for the rounding of arc cosines near 1.
SLACK = 1e-6


def dominant_dimension(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Only vectors of the most frequent length."""
    usual = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("_d")).count().orderBy(F.desc("count"), "_d").limit(1).select("_d")
    return df.join(F.broadcast(usual), F.size(column) == F.col("_d"), "left_semi")


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Only vectors of the most frequent length whose components are all finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return dominant_dimension(df.where(F.col(column).isNotNull() & finite), column)


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _angles(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(one @ other.T, -1, 1))


def _meet(own: pa.Table, other: pa.Table | None, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs within ``own``, or between both, a batch for each pair of tiles."""
    tiles = lambda rows: [(part.column("k").to_numpy(), units(part.column("v"))) for part in (rows.slice(at, TILE) for at in range(0, rows.num_rows, TILE))]
    left = tiles(own)
    right = left if other is None else tiles(other)
    for n, (ka, x) in enumerate(left):
        for m, (kb, y) in enumerate(right[: n + 1] if other is None else right):
            alike = x @ y.T
            a, b = np.nonzero(alike >= least)
            if other is None and m == n:
                a, b = a[ka[a] < kb[b]], b[ka[a] < kb[b]]
            else:  # rows of one key are no pair
                a, b = a[ka[a] != kb[b]], b[ka[a] != kb[b]]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(ka[a], kb[b]), "b": np.maximum(ka[a], kb[b]), "cosine": alike[a, b]})


def _pivots(held: DataFrame, count: int) -> np.ndarray:
    """So many vectors, first in hash order."""
    return _units(held.orderBy(F.xxhash64("k", F.lit(5)), "k").limit(count).select("v").toPandas()["v"])


def cells(df: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", block_rows: int = BLOCK_ROWS, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows ``cell, home, k, v``: each vector in the cell of its nearest pivot, and as a visitor in every cell that may hold a partner; and the cells, ``cell, own, visitors``.

    On the angle, a metric, a partner within ``r`` of ``x`` lies in the cell of ``q`` only if ``x`` is no farther from ``q`` than the cell's radius plus ``r``, and no more than
    ``2 r`` farther than from its own pivot. Of two cells one visits the other, by the parity of their numbers, so each pair meets once.
    """
    held = usable(df.select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v")), "v")
    count = min(MOST_PIVOTS, pivots or max(1, -(-held.count() // block_rows)))
    points, reach = _pivots(held, count), float(np.arccos(np.clip(least, -1, 1))) + SLACK
    kind = held.schema["k"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            far = _angles(_units(pdf["v"]), points)
            cell = far.argmin(axis=1) if len(pdf) else np.zeros(0, int)
            yield pdf.assign(cell=cell.astype(np.int32), d=far[np.arange(len(pdf)), cell])

    placed = stash(held.mapInPandas(place, f"k {kind}, v array<double>, cell int, d double"))
    wide = np.full(len(points), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("d").alias("d")).collect():
        wide[r["cell"]] = r["d"]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.arange(len(points))
        for pdf in batches:
            far, cell, d = _angles(_units(pdf["v"]), points), pdf["cell"].to_numpy(), pdf["d"].to_numpy()
            goes = (far <= wide[None, :] + reach) & (far <= d[:, None] + 2 * reach)
            higher = number[None, :] > cell[:, None]
            even = (number[None, :] + cell[:, None]) % 2 == 0
            goes &= (number[None, :] != cell[:, None]) & (higher == even)
            goes[np.arange(len(pdf)), cell] = True
            yield pd.DataFrame({"cells": [np.flatnonzero(g).astype(np.int32) for g in goes], "home": cell, "k": pdf["k"], "v": pdf["v"]})

    # a vector is repeated by Spark, row by row: in Python a batch's copies would grow with the pivots
    dealt = placed.mapInPandas(visit, f"cells array<int>, home int, k {kind}, v array<double>").select(F.explode("cells").alias("cell"), "home", "k", "v")
    sizes = stash(dealt.groupBy("cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("own"), F.count_if(F.col("home") != F.col("cell")).alias("visitors")))
    return dealt, sizes


def skipped_share(df: DataFrame, least: float, **options) -> float:
    """Of all pairs of cells the share that never meets."""
    dealt, sizes = cells(df, least, **options)
    count = sizes.where("own > 0").count()
    met = dealt.where("home <> cell").select("home", "cell").distinct().count()
    return 1 - met / max(1, count * (count - 1) / 2)


def cosine_pairs(df: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """Rows ``a, b, cosine`` of all pairs at least so alike, exactly.

    Vectors meet in cells around pivots, and only in cells that may hold a partner; how many pairs of cells that spares is up to the data, ``skipped_share`` tells. A cell of more than
    ``block_rows`` vectors is cut into blocks that meet pairwise, each meeting matrix products over tiles. Blocks grow with the table up to ``SIDE_BYTES``, so that a vector is
    repeated by few of them. Vectors that are null, of another length than most, or hold
    null or infinite components take no part; a zero vector is like none (cosine 0).
    """
    if block_rows is None:
        count, size = df.agg(F.count(column), F.max(F.size(column))).first()
        block_rows = max(BLOCK_ROWS, min(SIDE_BYTES // (8 * max(1, size or 1)), count // 16))
    dealt, sizes = cells(df, least, key, column, block_rows)
    parts = F.broadcast(sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("own") / block_rows)).cast("int").alias("s"), F.ceil(F.col("visitors") / block_rows).cast("int").alias("t")))  # a row for each pivot
    spot = lambda n: F.pmod(F.xxhash64("k", F.lit(9)), F.greatest(F.lit(1), n)).cast("int")
    own = dealt.where("home = cell").join(parts, "cell").withColumn("i", spot(F.col("s")))
    others = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.least("i", j).alias("i"), F.greatest("i", j).alias("j")))
    visits = F.when(F.col("t") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("t") - 1)), lambda j: F.struct(F.col("i").alias("i"), (-1 - j).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    rows = own.withColumn("m", F.explode(F.concat(others, visits))).select("cell", "m.i", "m.j", "k", "v", F.col("i").alias("own"))
    guests = dealt.where("home <> cell").join(parts, "cell").withColumn("j", -1 - spot(F.col("t"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select("cell", "i", "j", "k", "v", F.lit(-1).alias("own"))

    kind = df.schema[key].dataType
    schema = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind)), ("cosine", pa.float64())])

    def meet(place: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        i, j = place[1].as_py(), place[2].as_py()
        left = rows.column("own").to_numpy() == i
        for batch in _meet(rows, None, least) if i == j else _meet(rows.filter(pa.array(left)), rows.filter(pa.array(~left)), least):
            yield batch.cast(schema)

    return rows.unionByName(guests).groupBy("cell", "i", "j").applyInArrow(meet, f"a {kind.simpleString()}, b {kind.simpleString()}, cosine double")


def alike_components(df: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``node, component`` of all vectors with a partner at least so alike, exactly; as the components of ``cosine_pairs``, whose pairs are not listed."""
    held = usable(df.select(F.col(key).alias("k"), F.col(column).alias("v")), "v")
    return linked_components(held, Cosine(least), block_rows)


def similarity_groups(df: DataFrame, least: float, min_size: int = 2, max_size: int = 50, key: str = "vec_id", score: str = "score", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``component, count, best, members``: connected groups of alike vectors of ``min_size`` to ``max_size`` rows, with their best by score (ties: the smallest key, null scores count 0).

    Groups are counted before their members are listed, so a group that is too large is never gathered.
    """
    groups = stash(alike_components(df, least, key, block_rows=block_rows))
    sizes = groups.groupBy("component").agg(F.count("*").alias("count")).where(F.col("count").between(min_size, max_size))
    rows = groups.join(sizes, "component").join(df.select(F.col(key).alias("node"), F.coalesce(F.col(score), F.lit(0)).alias("_score")), "node")
    best = F.min_by("node", F.struct(-F.col("_score"), F.col("node"))).alias("best")
    return rows.groupBy("component", "count").agg(best, F.array_sort(F.collect_list("node")).alias("members"))


def mmr(df: DataFrame, group: str, k: int, trade: float, key: str = "path", column: str = "embedding") -> DataFrame:
    """Rows ``group, path, rank``: in each collection ``k`` rows by relevance against likeness to what is chosen already.

    Every row keeps its largest likeness to the chosen ones; in each of ``k`` rounds all collections choose at once. Ties go to the smallest key, rows without a usable vector take no part.
    """
    rows = usable(df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(column).cast("array<double>").alias("_v"), F.col("score").cast("double").alias("_s")), "_v").where("_s is not null")
    left, chosen = stash(rows.withColumn("_like", F.lit(None).cast("double"))), None
    for rank in range(1, k + 1):
        gain = F.round(trade * F.col("_s") - (1 - trade) * F.coalesce("_like", F.lit(0.0)), 9)
        best = stash(left.groupBy("_g").agg(F.min_by(F.struct("_k", "_v"), F.struct(-gain, F.col("_k"))).alias("b")).select("_g", F.col("b._k").alias("_bk"), F.col("b._v").alias("_bv"), F.lit(rank).alias("rank")))
        chosen = best if chosen is None else chosen.unionByName(best)
        if rank == k or best.isEmpty():
            break
        same = F.col("_g").eqNullSafe(F.col("_bg"))
        ahead = left.join(best.select(F.col("_g").alias("_bg"), "_bk", "_bv"), same).where("_k <> _bk").withColumn("_like", F.greatest("_like", F.coalesce(cosine("_v", "_bv"), F.lit(0.0))))
        last, left = left, stash(ahead.select(*left.columns))
        forget(last)
    return chosen.select(F.col("_g").alias(group), F.col("_bk").alias(key), F.col("rank").cast("int").alias("rank"))


def _orders(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    """For each vector the centres from the nearest on."""
    return np.argsort(-(_units(vectors) @ centres.T), axis=1, kind="stable")


#: Queries and vectors of a list that meet at once, and rows of one product.
SEARCH_ROWS, PRODUCT_ROWS = 8192, 256


def _nearest(asked: pd.DataFrame, held: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """Rows ``q, k, similarity``: for each query of a block the ``k`` most alike vectors of a block, ties to the smaller key, in products of bounded size."""
    out = [pd.DataFrame({"q": asked["q"].iloc[:0], "k": held["k"].iloc[:0], "similarity": np.zeros(0)})]
    if len(asked) and len(held):
        names, keys, rows, columns = asked["q"].to_numpy(), held["k"].to_numpy(), _units(asked["qv"]), _units(held["v"])
        for at in range(0, len(names), PRODUCT_ROWS):
            alike = rows[at : at + PRODUCT_ROWS] @ columns.T
            alike[(names[at : at + PRODUCT_ROWS, None] == keys[None, :]) | ~(alike >= least - SLACK)] = -np.inf
            close = np.round(alike, 9)
            cut = np.partition(close, -k, axis=1)[:, -k] if k < close.shape[1] else np.full(len(close), -np.inf)
            a, b = np.nonzero((close >= cut[:, None]) & (alike > -np.inf))
            order = np.lexsort((keys[b], -close[a, b], a))
            a, b = a[order], b[order]
            first = np.searchsorted(a, np.arange(len(close)))
            top = np.arange(len(a)) - first[a] < k
            part = pd.DataFrame({"q": names[at + a[top]], "k": keys[b[top]], "similarity": np.clip(alike[a[top], b[top]], -1, 1)})
            out.append(part[part["similarity"] >= least])
    return pd.concat([p for p in out if len(p)] or out[:1])


class VectorIndex:
    """Inverted lists around the centres of a coarse quantiser.

    Centres are fitted on at most ``FIT_ROWS`` vectors, first in hash order; every row is in the list of its nearest centre, and a list is a folder of the
    written table, so that a search reads the lists it opens alone. ``probes`` lists are opened for a query: as many as hold ``recall`` of the true
    neighbours of up to 64 rows of the table, which are searched exactly.
    """

    def __init__(self, df: DataFrame, key: str = "vec_id", column: str = "embedding", lists: int | None = None, recall: float = 0.95, k: int = 5):
        held = usable(df.select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v")), "v").where(F.exists("v", lambda x: x != 0))
        self.count, self.kind = held.count(), df.schema[key].dataType.simpleString()
        lists = min(MOST_PIVOTS, lists or max(1, int(4 * self.count**0.5 / 8)))
        fit = _pivots(held, FIT_ROWS)
        centres = fit[:: max(1, len(fit) // max(1, lists))][:lists]
        for _ in range(12):
            nearest = (fit @ centres.T).argmax(axis=1) if len(fit) else np.zeros(0, int)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, fit)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
        self.centres = centres

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(list=(_units(pdf["v"]) @ centres.T).argmax(axis=1).astype(np.int32) if len(pdf) else np.zeros(0, np.int32))

        placed = held.mapInPandas(place, f"k {self.kind}, v array<double>, list int") if self.count else held.withColumn("list", F.lit(0))
        self.table = stash(placed.hint("rebalance", "list"), partition_by="list")
        self.probes = len(centres)
        self.probes = self._calibrated(recall, k)

    def _calibrated(self, recall: float, k: int) -> int:
        asked = self.table.orderBy(F.xxhash64("k", F.lit(7)), "k").limit(64).select("k", "v")
        true = self.search(asked, k, probes=len(self.centres)).join(self.table.select(F.col("k").alias("neighbour"), "list"), "neighbour").select("k", "list").toPandas()
        if true.empty:
            return 1
        rows = asked.toPandas()
        place = {key: {int(c): at for at, c in enumerate(order)} for key, order in zip(rows["k"], _orders(rows["v"], self.centres), strict=True)}
        depth = np.sort([place[key][int(c)] for key, c in zip(true["k"], true["list"], strict=True)])
        return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1

    def search(self, queries: DataFrame, k: int, probes: int | None = None, least: float = -1.0) -> DataFrame:
        """Rows ``k, rank, neighbour, similarity`` for queries ``k, v``; a query's own row is no neighbour. Ties go to the smaller key."""
        centres = self.centres
        probes = min(self.probes if probes is None else probes, len(centres))
        if not probes:
            return queries.limit(0).selectExpr("k", "1 as rank", "k as neighbour", "0.0D as similarity")

        def open_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"q": np.repeat(pdf["k"].to_numpy(), probes), "qv": [v for v in pdf["v"] for _ in range(probes)], "list": _orders(pdf["v"], centres)[:, :probes].ravel().astype(np.int32)})

        asked = stash(queries.select("k", F.col("v").cast("array<double>").alias("v")).where((F.size("v") == centres.shape[1]) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).mapInPandas(open_lists, f"q {self.kind}, qv array<double>, list int"))
        sizes = asked.groupBy("list").agg(F.count("*").alias("asked")).join(self.table.groupBy("list").agg(F.count("*").alias("held")), "list").collect()  # MOST_PIVOTS rows at most
        if not sizes:
            return queries.limit(0).selectExpr("k", "1 as rank", "k as neighbour", "0.0D as similarity")
        cuts = F.broadcast(self.table.sparkSession.createDataFrame([(r["list"], -(-r["asked"] // SEARCH_ROWS), -(-r["held"] // SEARCH_ROWS)) for r in sizes], "list int, rows int, columns int"))
        spot, every = lambda key, n: F.pmod(F.xxhash64(key, F.lit(11)), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(cuts, "list").select("list", "q", "qv", spot("q", "rows").alias("i"), every("columns").alias("j"))
        right = self.table.where(F.col("list").isin([r["list"] for r in sizes])).join(cuts, "list").select("list", "k", "v", spot("k", "columns").alias("j"), every("rows").alias("i"))
        meet = lambda l, r: _nearest(l, r, k, least)  # noqa: E731, E741
        near = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInPandas(lambda l, r: meet(l, r), f"q {self.kind}, k {self.kind}, similarity double")  # noqa: E741
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round("similarity", 9)), F.asc("k")))
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("k"), "rank", F.col("k").alias("neighbour"), "similarity")

    def compared_share(self, queries: DataFrame) -> float:
        """Of all pairs of a query and a row the share that a search compares."""
        sizes = np.zeros(len(self.centres))
        for r in self.table.groupBy("list").count().collect():
            sizes[r["list"]] = r["count"]
        rows = queries.select("k", "v").toPandas()
        return float(sizes[_orders(rows["v"], self.centres)[:, : self.probes]].sum() / max(1, len(rows) * self.count))
