"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every row is indexed. A query walks all trees
through one shared priority queue, which opens next the subtree whose boundary lies
closest, until it has as many leaves as a calibration asks for: exact neighbours of a
bounded sample of queries show how many leaves reach the wanted recall. Candidates of
the leaves are ranked by their exact cosine. A leaf of more rows than a group shall hold is cut by a hash, and its
queries go to each cut, so groups stay bounded where the sample can't carry deeper trees.

Equal vectors are indexed once, with their smallest ids, as many as one result can hold;
so groups of copies cost one row. Rows are dealt by tree and leaf.

Defined results: vectors that are null, zero, of another length than most, or with null
or non-finite components take no part, as queries or candidates; null ids take no part;
repeated rows of one id and vector count once; ties go to the smaller id; a query without
candidates has no rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shelfmark.runtime import stash

NEIGHBOURS = 5
EVERY = 50
TREES = 8
LEAF = 200
SAMPLE = 20_000
CALIBRATION = 64
RECALL = 0.96
BLOCK = 4096


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows ``vec_id, v`` that take part; ``v`` in double precision."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    held = held.where(F.exists("v", lambda x: x != 0))
    most = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return held.where(F.size("v") == (most[0]["n"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


class Forest:
    """Balanced trees of random hyperplanes; node n has children 2n and 2n + 1, the leaves follow the last level."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.depth, dims = depth, sample.shape[1]
        self.normals = np.zeros((trees, 1 << depth, dims))
        self.cuts = np.zeros((trees, 1 << depth))
        for t in range(trees):
            held = {1: np.arange(len(sample))}
            for n in range(1, 1 << depth):
                own = held.pop(n)
                normal = rng.normal(size=dims)
                self.normals[t, n] = normal / np.linalg.norm(normal)
                side = sample[own] @ self.normals[t, n]
                self.cuts[t, n] = np.median(side) if len(own) else 0.0
                held[2 * n], held[2 * n + 1] = own[side <= self.cuts[t, n]], own[side > self.cuts[t, n]]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.ones(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.normals[t][node]) > self.cuts[t][node]
                node = 2 * node + side
            out[:, t] = node - (1 << self.depth)
        return out

    def nearest_leaves(self, vector: np.ndarray, most: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of a priority queue that all trees share; the vector's own leaves come first."""
        margins = self.normals @ vector - self.cuts
        heap, out = [(0.0, t, 1) for t in range(len(self.normals))], []
        while heap and len(out) < most:
            worst, t, node = heapq.heappop(heap)
            while node < 1 << self.depth:
                margin = margins[t, node]
                right = int(margin > 0)
                heapq.heappush(heap, (max(worst, abs(margin)), t, 2 * node + 1 - right))
                node = 2 * node + right
            out.append((t, node - (1 << self.depth)))
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """Each query's ``k`` largest cosines, ties to the smaller id."""
    scores = (queries @ vectors.T) / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :])
    for row, query in zip(scores, query_ids, strict=True):
        near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
        for at in near[np.lexsort((ids[near], -row[near]))][:k]:
            yield int(query), int(ids[at]), float(row[at])


_FOUND = "query long, rep long, score double"


def _rows(found: list[tuple[int, int, float]]) -> dict[str, pa.Array]:
    q, r, s = zip(*found, strict=True) if found else ((), (), ())
    return {"query": pa.array(q, pa.int64()), "rep": pa.array(r, pa.int64()), "score": pa.array(s, pa.float64())}


def exact_sample(index: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries among all rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(_rows(list(_best(queries, query_ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k))))

    top = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))
    return index.select("rep", "v").mapInArrow(run, _FOUND).withColumn("rank", top).where(F.col("rank") <= k)


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, calibration: int = CALIBRATION, recall: float = RECALL) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score`` for all rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    held = stash(valid(vectors, id_col, vec_col).distinct())
    order = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    # at most k + 1 ids of a vector can matter; Spark drops the others before its shuffle
    members = held.withColumn("n", order).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = stash(members.select(F.col("ids")[0].alias("rep"), "v", "ids"))
    asked = held.where(F.col("vec_id") % every == 0).join(index, "v").select("vec_id", "rep")
    asked = stash(asked)
    queries = stash(index.join(asked.select("rep").distinct(), "rep", "left_semi"))
    count = index.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count or not queries.limit(1).count():
        return empty
    shuffled = F.xxhash64("rep", F.lit(11))
    drawn = _matrix(pa.chunked_array(index.orderBy(shuffled, "rep").limit(sample).select("v").toArrow().column(0).chunks).combine_chunks())
    depth = max(0, min(int(np.log2(max(1, count / leaf))), int(np.log2(max(1, len(drawn) / 8)))))
    forest = Forest(_unit(drawn), trees, depth)
    tried = queries.orderBy(shuffled, "rep").limit(calibration).select("rep", "v").toArrow().combine_chunks()
    tried_ids, tried_v = tried.column("rep").to_numpy(), _matrix(tried.column("v").combine_chunks())
    truth = exact_sample(index, tried_v, tried_ids, k + 1).join(index.select("rep", "v"), "rep").select("query", "v").toArrow().combine_chunks()
    most = _leaves_needed(forest, dict(zip(tried_ids.tolist(), _unit(tried_v), strict=True)), truth.column("query").to_numpy(), _unit(_matrix(truth.column("v").combine_chunks())), recall)
    shared = spark.sparkContext.broadcast(forest)
    cuts = max(1, -(-2 * count // (BLOCK << depth)))
    shift = max(0, depth - max(0, int(np.log2(max(1, count / BLOCK)))))

    def cut_of(ids: pa.Array) -> np.ndarray:
        return ((ids.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % cuts

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = shared.value.leaves(_unit(_matrix(batch.column(1))))
                for t in range(places.shape[1]):
                    yield _dealt(batch.column(0), batch.column(1), np.full(len(places), t), places[:, t], False, shift, cut_of(batch.column(0)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = [shared.value.nearest_leaves(v, most) for v in _unit(_matrix(part.column(1)))]
                own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                flat = np.array([p for x in lists for p in x]).reshape(-1, 2)
                for cut in range(cuts):
                    yield _dealt(part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), flat[:, 0], flat[:, 1], True, shift, np.full(len(flat), cut))

    schema = "tree int, block int, cut int, leaf int, asks boolean, rep long, v array<double>"
    dealt = index.select("rep", "v").mapInArrow(indexed, schema).unionByName(queries.select("rep", "v").mapInArrow(routed, schema))

    def rerank(table: pa.Table) -> pa.Table:
        leaf_of, asks = table.column("leaf").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        ids, v = table.column("rep").to_numpy(), _matrix(table.column("v").combine_chunks())
        best: dict[int, list[tuple[float, int]]] = {}
        for one in np.unique(leaf_of[asks]):
            q, d = np.flatnonzero((leaf_of == one) & asks), np.flatnonzero((leaf_of == one) & ~asks)
            for at in range(0, len(q) if len(d) else 0, 512):
                for query, rep, score in _best(v[q[at : at + 512]], ids[q[at : at + 512]], v[d], ids[d], k + 1):
                    best.setdefault(query, []).append((-score, rep))
        return pa.table(_rows([(query, rep, -minus) for query, near in best.items() for minus, rep in sorted(near)[: k + 1]]))

    near = dealt.groupBy("tree", "block", "cut").applyInArrow(rerank, _FOUND)
    once = near.groupBy("query", "rep").agg(F.max("score").alias("score"))
    top = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))
    best = once.withColumn("n", top).where(F.col("n") <= k + 1).join(index.select("rep", "ids"), "rep")
    lists = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    pairs = asked.join(lists, asked["rep"] == lists["query"]).select(F.col("vec_id").alias("query_id"), F.explode("near").alias("n"))
    spread = pairs.select("query_id", F.col("n.score").alias("score"), F.explode("n.ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spread.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(ids: pa.Array, vectors: pa.Array, tree: np.ndarray, leaf: np.ndarray, asks: bool, shift: int, cut: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(tree, pa.int32()), pa.array(leaf >> shift, pa.int32()), pa.array(cut, pa.int32()), pa.array(leaf, pa.int32()), pa.array(np.full(len(leaf), asks)), ids, vectors]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "block", "cut", "leaf", "asks", "rep", "v"])


def _leaves_needed(forest: Forest, queries: dict[int, np.ndarray], owners: np.ndarray, neighbours: np.ndarray, recall: float) -> int:
    """Leaves to open so that the wanted share of the neighbours lies in them."""
    everything = forest.normals.shape[0] << forest.depth
    ranks, places = [], forest.leaves(neighbours)
    for query, vector in queries.items():
        at = {p: i for i, p in enumerate(forest.nearest_leaves(vector, everything))}
        ranks += [min(at[t, int(leaf)] for t, leaf in enumerate(row)) for row in places[owners == query]]
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else everything
