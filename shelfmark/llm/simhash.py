"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 majority bits over XXH64 values (seed 42) of word shingles. Equal
fingerprints collapse first. Two fingerprints within ``radius`` bits agree on at least
``bands - radius`` of ``bands`` bit bands, so each is dealt to one group per choice of
agreeing bands; this is exact for every input, and more bands are used for more
fingerprints only to keep groups small. Within a group the fingerprints stand as vertical
bit planes; carry-save counters update the distances of 64 at a time, and a block of 64
is abandoned once all of it exceeds the radius. A group passes on a star per local
component, never its pairs; alternating stars join these to global components.

Defined results: a null text has no words, and its fingerprint is zero; texts without
words link to each other; repeated rows come back as often as they went in; a null id
takes part, but the smallest id of a component ignores it. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import hot_keys, slices, spread_join, utf8
from shelfmark.operators.components import connected_components
from shelfmark.runtime import stash

GROUP = 1024
LARGEST = 4096


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The XXH64 value of each word shingle."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        flat, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        shingles = [flat[a:b] for a, b in zip((ends - lengths).tolist(), ends[width - 1 :].tolist(), strict=False)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number; zero without hashes."""
    rows = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    if not len(rows):
        return 0
    ones = sum(np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(rows), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def fingerprint(text: bytes | None, width: int) -> int:
    """The fingerprint as a signed 64-bit number."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Rows ``doc_id, fp``, one for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([fingerprint(t, width) for t in utf8(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


class Counters:
    """Vertical counters of set bits, in carry-save form: a level holds its sum and a plane that waits for another one."""

    def __init__(self, lanes: int, levels: int):
        self.sums = [np.zeros(lanes, np.uint64) for _ in range(levels)]
        self.waits: list[np.ndarray | None] = [None] * levels
        self.over = np.zeros(lanes, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for level, y in enumerate(self.waits):
            if y is None:
                self.waits[level] = x
                return
            s = self.sums[level]
            half = s ^ x
            self.sums[level], x, self.waits[level] = half ^ y, (s & x) | (half & y), None
        self.over |= x

    def settle(self) -> None:
        """Add what waits."""
        for level in range(len(self.waits)):
            x, self.waits[level] = self.waits[level], None
            for above in range(level, len(self.sums)) if x is not None else ():
                self.sums[above], x = self.sums[above] ^ x, self.sums[above] & x
            if x is not None:
                self.over |= x

    def beyond(self, most: int) -> np.ndarray:
        """Lanes that count more than ``most``."""
        self.settle()
        above, same = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for level in reversed(range(len(self.sums))):
            s = self.sums[level]
            if most >> level & 1:
                same &= s
            else:
                above |= same & s
                same &= ~s
        return self.over | above

    def keep(self, lanes: np.ndarray) -> None:
        self.sums, self.over = [s[lanes] for s in self.sums], self.over[lanes]


def near_rows(values: np.ndarray, radius: int, order: list[int]) -> np.ndarray:
    """A bit matrix, packed into 64-bit words: row i marks what lies within ``radius`` of value i.

    ``values`` has one or more 64-bit words a row; bits are compared in this order. Nothing can be abandoned before
    several times ``radius`` bits are compared, so until then all blocks of a row are updated at once.
    """
    values = values.reshape(len(values), -1)
    m, words = values.shape
    width = -(-m // 64)
    bits = ((values[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool).reshape(m, 64 * words)
    planes = np.zeros((64 * words, width * 64), bool)
    planes[:, :m] = bits.T
    planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    signs = np.where(bits, ~np.uint64(0), np.uint64(0))
    lanes = np.packbits(np.arange(width * 64) < m, bitorder="little").view("<u8")
    near = np.zeros((m, width), np.uint64)
    full, early = ~np.uint64(0), min(len(order), max(16, 5 * radius // 2 // 8 * 8))
    for first in range(0, m, max(1, 16384 // width)):
        rows = np.arange(first, min(m, first + max(1, 16384 // width)))
        count = Counters(len(rows) * width, max(3, radius.bit_length()))
        for bit in order[:early]:
            count.add((planes[bit][None, :] ^ signs[rows, bit][:, None]).reshape(-1))
        row, word = np.repeat(rows, width), np.tile(np.arange(width), len(rows))
        for step in range(early, len(order) + 1, 8):
            if len(live := np.flatnonzero(count.beyond(radius) != full)) < 0.7 * len(row):  # blocks wholly beyond the radius are abandoned
                row, word = row[live], word[live]
                count.keep(live)
            for bit in order[step : step + 8] if len(row) else ():
                count.add(planes[bit][word] ^ signs[row, bit])
        near[row, word] = ~count.beyond(radius) & lanes[word]
    return near


def stars(values: np.ndarray, radius: int, order: list[int]) -> list[tuple[int, int]]:
    """Pairs (value, smallest value of its component in this group), without singletons."""
    near = near_rows(values.view(np.uint64), radius, order)
    m = len(values)
    degree = np.bitwise_count(near).sum(axis=1)
    left = np.zeros(near.shape[1] * 64, bool)
    left[:m] = degree > 1
    left = np.packbits(left, bitorder="little").view("<u8")
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(degree > 1):
        if not (left[i >> 6] >> np.uint64(i & 63)) & np.uint64(1):
            continue
        reached, edge = np.zeros_like(left), near[i] & left
        while edge.any():
            reached |= edge
            left = left & ~edge
            at = np.flatnonzero(np.unpackbits(edge.view(np.uint8), bitorder="little"))
            edge = np.bitwise_or.reduce(near[at], axis=0) & left
        members = values[np.flatnonzero(np.unpackbits(reached.view(np.uint8), bitorder="little"))]
        least = int(members.min())
        out.extend((int(v), least) for v in members if v != least)
    return out


def _masks(bands: int, agree: int, keep: int) -> list[int]:
    """For each choice of agreeing bands, ``keep`` of its bits at most."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    out = []
    for chosen in itertools.combinations(range(bands), agree):
        bits = [b for k in chosen for b in range(cuts[k], cuts[k + 1])]
        out.append(sum(1 << b for b in bits[:keep]))
    return out


def near_components(values: DataFrame, radius: int = 4, group: int = GROUP, largest: int = LARGEST) -> DataFrame:
    """From distinct fingerprints ``fp``, rows ``(node, component)`` for all that link to another."""
    count = values.count()
    bands = radius + (1 if count <= 1 << 22 else 2 if count <= 1 << 30 else 3)
    masks = _masks(bands, bands - radius, max(1, (max(1, count // group)).bit_length()))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "part"))
    crowded = keyed.groupBy("choice", "part").count().where(F.col("count") > largest).select("choice", "part", F.ceil(F.col("count") * 2 / largest).cast("int").alias("cuts"))
    cut = keyed.join(crowded, ["choice", "part"], "left").withColumn("own", F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")))
    # a crowded group is compared cut by cut, each pair of cuts in a group of its own
    spread = cut.withColumn("other", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.expr("sequence(0, cuts - 1)"))))
    dealt = spread.select("fp", "choice", "part", F.coalesce(F.least("own", "other"), F.lit(0)).alias("a"), F.when(F.col("own").isNotNull(), F.greatest("own", "other")).otherwise(F.lit(0)).alias("b"))
    orders = [[b for b in range(64) if not m >> b & 1] + [b for b in range(64) if m >> b & 1] for m in masks]

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = np.unique(rows.column("fp").to_numpy())
        links = stars(found, radius, orders[key[0].as_py()]) if len(found) > 1 else []
        return pa.table({"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())})

    links = stash(dealt.groupBy("choice", "part", "a", "b").applyInArrow(compare, "src long, dst long").distinct())
    return connected_components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 4) -> DataFrame:
    """Rows ``doc_id, fp, component_id``: the smallest id among documents linked within ``radius`` bits."""
    marked = stash(fingerprints(docs, id_col, text_col, width))
    distinct = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = near_components(distinct.select("fp"), radius).select(F.col("node").alias("fp"), "component")
    rooted = stash(distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = spread_join(rooted, smallest, ["component"], hot_keys(rooted, ["component"])).select("fp", "component_id")
    return spread_join(marked, classes, ["fp"], hot_keys(marked, ["fp"])).select("doc_id", "fp", "component_id")
