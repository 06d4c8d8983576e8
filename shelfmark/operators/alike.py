"""Groups, counts and best partners of rows that are linked if a test on their vectors holds, without listing the links.

The links of a table grow with the square of its rows; what is asked of them here does not. Rows meet in blocks, each meeting matrix products over tiles, and a meeting passes on
at most a row for each of its rows. Meetings of one block each come first: they are linear, and leave few rows to decide. Only those meet all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.operators.components import connected_components
from shelfmark.runtime import forget, shuffle_width, stash

#: Rows of a tile and of a block that meets itself alone; bytes of the vectors of one side of a meeting, as doubles.
TILE, ALONE, SIDE_BYTES = 2048, 2048, 16 << 20


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors, all of one length, as rows of length 1; zero vectors stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


class Cosine:
    """Links vectors ``v``, all of one length, whose cosine is at least ``least``."""

    def __init__(self, least: float):
        self.least = least

    def ready(self, rows: pa.Table) -> np.ndarray:
        return units(rows.column("v"))

    def cosines(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return one @ other.T

    def test(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return self.cosines(one, other) >= self.least


class CloseOrAlike:
    """Links rows whose hashes ``h`` differ in at most ``strict`` bits, or in at most ``loose`` while the cosine of their ``v`` is at least ``least``.

    Vectors that are null, of different lengths, zero, or hold null or infinite components have no cosine.
    """

    def __init__(self, strict: int, loose: int, least: float):
        self.strict, self.loose, self.least = strict, loose, least

    def ready(self, rows: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        bits = np.unpackbits(rows.column("h").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1)
        own: dict[int, tuple[list, list]] = {}
        for at, v in enumerate(rows.column("v").to_pylist()):
            if v and None not in v and np.isfinite(v).all() and any(v):
                places, held = own.setdefault(len(v), ([], []))
                places.append(at)
                held.append(np.array(v) / np.linalg.norm(v))
        return np.where(bits, 1, -1).astype(np.float32), {size: (np.array(places), np.stack(held)) for size, (places, held) in own.items()}

    def test(self, one, other) -> np.ndarray:
        apart = (64 - one[0] @ other[0].T) / 2  # whole numbers, exact in single precision
        near = apart <= self.strict
        for size in one[1].keys() & other[1].keys():
            (i, x), (j, y) = one[1][size], other[1][size]
            near[np.ix_(i, j)] |= (x @ y.T >= self.least) & (apart[np.ix_(i, j)] <= self.loose)
        return near


def _tiles(rows: pa.Table, link) -> list[tuple[np.ndarray, object]]:
    parts = [rows.slice(at, TILE) for at in range(0, rows.num_rows, TILE)]
    return [(part.column("component" if "component" in rows.column_names else "k").to_numpy(), link.ready(part)) for part in parts]


class _Roots(dict):
    """Numbers by the smallest number joined to them; those that stand alone are missing."""

    def of(self, x):
        root = x
        while root in self:
            root = self[root]
        while x in self:
            self[x], x = root, self[x]
        return root

    def join(self, x, y) -> None:
        x, y = self.of(x), self.of(y)
        if x != y:
            self[max(x, y)] = min(x, y)

    def mapped(self, values: np.ndarray) -> np.ndarray:
        found, place = np.unique(values, return_inverse=True)
        return np.array([self.of(x) for x in found.tolist()], values.dtype)[place]


def _grow(roots: _Roots, one: tuple, other: tuple, link) -> None:
    """Join the components of two tiles that have a link; each component takes a link at a time, so that its number of links doesn't count."""
    ca, cb = roots.mapped(one[0]), roots.mapped(other[0])
    if len(ca) and len(cb) and ca.min() == ca.max() == cb.min() == cb.max():
        return
    linked = link.test(one[1], other[1])
    while True:
        linked &= ca[:, None] != cb[None, :]
        to, back = linked.argmax(axis=1), linked.argmax(axis=0)
        i, j = np.flatnonzero(linked[np.arange(len(ca)), to]), np.flatnonzero(linked[back, np.arange(len(cb))])
        if not len(i):
            return
        for x, y in {*zip(ca[i].tolist(), cb[to[i]].tolist(), strict=True), *zip(ca[back[j]].tolist(), cb[j].tolist(), strict=True)}:
            roots.join(x, y)
        ca, cb = roots.mapped(ca), roots.mapped(cb)


def _stars(link, schema: pa.Schema) -> Callable[[tuple, pa.Table], pa.Table]:
    """Rows ``u, v``: components of a meeting that became part of another; within the rows, or between both sides where there are two."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        roots = _Roots()
        if "side" in rows.column_names:
            side = rows.column("side").to_numpy()
            left, right = (_tiles(rows.filter(pa.array(side == s)), link) for s in (0, 1))
            meetings = ((x, y) for x in left for y in right)
        else:
            left = _tiles(rows, link)
            meetings = ((x, y) for n, x in enumerate(left) for y in left[: n + 1])
        for one, other in meetings:
            _grow(roots, one, other, link)
        return pa.Table.from_pydict({"u": list(roots), "v": [roots.of(x) for x in list(roots)]}, schema)

    return run


def meetings(asked: DataFrame, against: DataFrame, size: int) -> DataFrame:
    """Rows ``r, a, side`` and those of ``asked`` (side 0) or ``against`` (side 1), of the same columns: each pair of them has a meeting ``r, a`` of bounded blocks.

    There are about as many meetings as shuffle partitions, and only more where blocks would pass ``SIDE_BYTES``; so rows are repeated by few blocks.
    """
    most = max(TILE, SIDE_BYTES // (8 * max(1, size)))
    n, m = asked.count(), against.count()
    down = max(1, -(-n // most))
    across = max(1, -(-m // most), min(-(-m // TILE), -(-shuffle_width(asked.sparkSession) // down)))
    dealt = lambda rows, own, count, other, times, side: rows.withColumn(own, F.pmod(F.xxhash64("k", F.lit(11)), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("side", F.lit(side))
    return dealt(asked, "r", down, "a", across, 0).unionByName(dealt(against, "a", across, "r", down, 1))


def longest(held: DataFrame) -> int:
    return held.agg(F.max(F.size("v"))).first()[0] or 0


def _kind(held: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = held.schema["k"].dataType
    return kind.simpleString(), pa.schema([("u", to_arrow_type(kind)), ("v", to_arrow_type(kind))])


def linked_components(rows: DataFrame, link, alone: int = ALONE) -> DataFrame:
    """Rows ``node, component`` of all rows ``k, ...`` that have a link; ``component`` is the smallest key reachable.

    Blocks meet themselves first, dealt anew each round as long as that helps. Of the components then found the largest needs no meeting with itself: all other rows meet all rows.
    """
    held = stash(rows.where("k is not null"))
    kind, schema = _kind(held)
    owner = stash(held.select("k", F.col("k").alias("component")).distinct())
    blocks = max(1, -(-held.count() // alone))
    edges_of = lambda dealt, *by: stash(dealt.groupBy(*by).applyInArrow(_stars(link, schema), f"u {kind}, v {kind}"))

    def merged(owner: DataFrame, edges: DataFrame, settled: bool = False) -> DataFrame:
        """The owners after components are joined; of one meeting, edges are settled."""
        groups = edges.toDF("component", "root") if settled else connected_components(edges, "u", "v").toDF("component", "root")
        new = stash(owner.join(groups, "component", "left").select("k", F.coalesce("root", "component").alias("component")))
        forget(owner), forget(edges)
        return new

    left, turn = None, 0
    while True:
        dealt = held.join(owner, "k").withColumn("block", F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(blocks)))
        owner, turn = merged(owner, edges_of(dealt, "block"), blocks == 1), turn + 1
        if blocks == 1:
            break
        largest = owner.groupBy("component").count().orderBy(F.desc("count"), "component").first()["component"]
        rest, last = owner.where(F.col("component") != largest).count(), left
        left = rest
        if rest == 0 or turn > 1 and (rest <= alone or rest * 2 > last):
            break
    if blocks > 1 and left:
        known = stash(held.join(owner, "k"))
        owner = merged(owner, edges_of(meetings(known.where(F.col("component") != largest), known, longest(held)), "r", "a"))
        forget(known)
    forget(held)
    sizes = owner.groupBy("component").count().where("count > 1").select("component")
    return owner.join(sizes, "component", "left_semi").select(F.col("k").alias("node"), "component")


def with_links(rows: DataFrame, link, least: int, alone: int = ALONE) -> DataFrame:
    """Rows ``k, links``: for each row that has a link the number of other rows it is linked to, exactly below ``least``; from there on it may be less, but not below ``least``."""
    held = stash(rows.where("k is not null"))
    kind, _ = _kind(held)
    blocks = max(1, -(-held.count() // alone))

    def count(key: tuple, part: pa.Table) -> pa.Table:
        keys, sides = part.column("k"), part.column("side").to_numpy()
        ours, theirs = (part.filter(pa.array(sides == s)) for s in (0, 1))
        right = _tiles(theirs, link)
        found = [sum((link.test(x, y) & (own[:, None] != other[None, :])).sum(axis=1) for other, y in right) for own, x in _tiles(ours, link)] if right else []
        n = np.concatenate(found) if found else np.zeros(0, int)
        return pa.table({"k": ours.column("k") if right else keys.slice(0, 0), "links": pa.array(n, pa.int64())})

    summed = lambda dealt, *by: dealt.groupBy(*by).applyInArrow(count, f"k {kind}, links long").groupBy("k").agg(F.sum("links").alias("links"))
    block = held.withColumn("block", F.pmod(F.xxhash64("k", F.lit(0)), F.lit(blocks)))
    both = block.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    first = stash(summed(both, "block"))
    if blocks == 1:
        return first.where("links > 0")
    sure = first.where(F.col("links") >= max(1, least))
    asked = held.join(sure, "k", "left_anti")
    return sure.unionByName(summed(meetings(asked, held, longest(held)), "r", "a")).where("links > 0")


def best_partners(asked: DataFrame, against: DataFrame, link: Cosine) -> DataFrame:
    """Rows ``k, partner, cosine``: for each row of ``asked`` the linked one of ``against`` of the largest cosine, ties to the smallest key."""
    kind, _ = _kind(against)

    def best(key: tuple, part: pa.Table) -> pa.Table:
        sides = part.column("side").to_numpy()
        ours, theirs = (part.filter(pa.array(sides == s)).sort_by("k") for s in (0, 1))
        out = []
        right = _tiles(theirs, link)
        for own, x in _tiles(ours, link):
            for other, y in right:
                cosine = np.where(own[:, None] != other[None, :], link.cosines(x, y), -np.inf)
                at = cosine.argmax(axis=1)
                top = cosine[np.arange(len(own)), at]
                rows = np.flatnonzero(top >= link.least)
                out.append(pa.table({"k": own[rows], "partner": other[at[rows]], "cosine": top[rows]}))
        return pa.concat_tables(out) if out else part.select(["k", "k", "k"]).slice(0, 0).rename_columns(["k", "partner", "cosine"]).set_column(2, "cosine", pa.array([], pa.float64()))

    found = meetings(asked, against, longest(against)).groupBy("r", "a").applyInArrow(best, f"k {kind}, partner {kind}, cosine double")
    return found.groupBy("k").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "partner")).alias("b")).select("k", F.col("b.partner").alias("partner"), (-F.col("b.far")).alias("cosine"))
