"""Near-duplicate texts by SimHash: bit-sliced comparison finds candidates, their shingles decide.

Two texts are linked if the Jaccard similarity of their sets of word shingles is at least 4/5.
Such sets' fingerprints of 128 majority bits differ in about 19 bits, and in more than
``RADIUS`` hardly ever, while those of unlike sets differ in 64. So fingerprints that agree
on the bits of one of several random choices meet in a group, where bit planes and carry-save
counters compare them; pairs within the radius are candidates, and only those of truly similar
shingles count as links. Choices have more bits for more texts, so that groups stay small,
and there are as many choices as a miss rate of ``MISS`` asks for. Texts with equal sets collapse first.

Choices are compared in turns, the first of a few and of a crowded group's cuts alone: what is linked by then is not
asked in later ones, so the copies of a large group don't meet in each choice again. A group passes on at most ``few``
candidates for each text in a round, and names the texts that have more. Pairs that are linked by then are not asked again, those found unlike are not either, and
rounds go on, among the texts named, with four times as many until no text is named; hence no
candidate is dropped, and a large group of copies doesn't pass on its pairs.

Defined results: texts without words are linked to each other; of each group the row of smallest
id stays, of equal ids the first in row order; null ids rank last. An empty table gives an empty
result. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import if_small, making_room, slices, utf8
from shelfmark.llm.simhash import majority, near_rows, shingle_hashes
from shelfmark.operators.components import connected_components
from shelfmark.runtime import forget, release, stash, sweep

BITS, RADIUS = 128, 31
#: Share of bits on which sets of similarity 4/5 agree, one standard deviation to the safe side.
AGREE, MISS = 0.82, 5e-4
GROUP, LARGEST = 1024, 4096
FEW = 2
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingle_set(text: bytes | None, width: int) -> tuple[int, np.ndarray]:
    """A number for the set of shingles, and the set as sorted hashes."""
    import xxhash

    held = np.unique(shingle_hashes(text, width))
    return int.from_bytes(xxhash.xxh3_64_digest(held.tobytes()), "big", signed=True), held


def marks(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows ``row, doc_id, node, one, two`` of rows numbered ``_sim_row``: equal nodes are equal sets; ``one`` and ``two`` are the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, limit=2 << 20):
            found = [shingle_set(t, width) for t in utf8(batch.column(2))]
            nodes = pa.array([n for n, _ in found], pa.int64())
            one = pa.array([majority(h) for _, h in found], pa.int64())
            two = pa.array([majority((h ^ (h >> np.uint64(33))) * _MIX) for _, h in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, one, two], names=["row", "doc_id", "node", "one", "two"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select("_sim_row", F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"row long, doc_id {kind}, node long, one long, two long")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """Rows ``node, held`` of the wanted ``node, row``: each one's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, limit=2 << 20):
            held = [shingle_set(t, width)[1].tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["node", "held"])

    own = docs.select(F.col("_sim_row").alias("row"), F.col(text_col).alias("text"))
    return own.join(if_small(wanted), "row").select("node", "text").mapInArrow(run, "node long, held binary")


def choices(count: int, group: int = GROUP) -> list[list[int]]:
    """The bits of each choice for so many fingerprints; one choice of none, if a group can hold all."""
    bits = max(0, ceil(log2(max(1, count / group))))
    rng = np.random.default_rng(42)
    return [sorted(rng.choice(BITS, bits, replace=False).tolist()) for _ in range(ceil(log(1 / MISS) / AGREE**bits) if bits else 1)]


def _dealt(distinct: DataFrame, chosen: list[list[int]], largest: int) -> DataFrame:
    """Rows ``choice, part, a, b, node, one, two``; crowded groups are cut, each pair of cuts a group."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    mask = lambda bits, word: F.lit(signed(sum(1 << (b & 63) for b in bits if b >> 6 == word)))
    parts = [F.xxhash64(F.col("one").bitwiseAND(mask(bits, 0)), F.col("two").bitwiseAND(mask(bits, 1))) for bits in chosen]
    own = [c for c in ("component", "unlike") if c in distinct.columns]
    keyed = distinct.select("node", "one", "two", *own, F.posexplode(F.array(*parts)).alias("choice", "part"))
    crowded = keyed.groupBy("choice", "part").count().where(F.col("count") > largest).select("choice", "part", F.ceil(F.col("count") * 2 / largest).cast("int").alias("cuts"))
    cut = keyed.join(crowded, ["choice", "part"], "left").withColumn("own", F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")))
    spread = cut.withColumn("other", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.expr("sequence(0, cuts - 1)"))))
    return spread.select("choice", "part", F.coalesce(F.least("own", "other"), F.lit(0)).alias("a"), F.when(F.col("own").isNotNull(), F.greatest("own", "other")).otherwise(F.lit(0)).alias("b"), "node", "one", "two", *own)


def open_pairs(nodes: np.ndarray, prints: np.ndarray, order: list[int], components: np.ndarray | None, unlike: list[list[int] | None] | None, few: int) -> tuple[set[tuple[int, int]], list[int]]:
    """For each text up to ``few`` near ones of other components that were not found unlike, next in turn and of two components few in all; and the texts that have more."""
    near = near_rows(prints, RADIUS, order)
    pairs: set[tuple[int, int]] = set()
    more: list[int] = []
    taken: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(np.bitwise_count(near).sum(axis=1) > 1):
        others = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little"))
        others = others[others != i]
        if components is not None:
            others = others[components[others] != components[i]]
            if unlike[i]:
                others = others[~np.isin(nodes[others], unlike[i])]
        if len(others) > few:
            more.append(int(nodes[i]))
            others = np.roll(others, -np.searchsorted(others, i))
            if components is None:
                others = others[:few]
            else:  # one of each component, and of two components few pairs in all
                others = others[np.sort(np.unique(components[others], return_index=True)[1])]
                free = []
                for j in others.tolist():
                    ends = (min(components[i], components[j]), max(components[i], components[j]))
                    if taken.get(ends, 0) < few:
                        taken[ends] = taken.get(ends, 0) + 1
                        free.append(j)
                        if len(free) == few:
                            break
                others = free
        pairs.update((min(int(nodes[i]), int(nodes[j])), max(int(nodes[i]), int(nodes[j]))) for j in others)
    return pairs, more


def _compare(chosen: list[list[int]], few: int):
    """Rows ``u, v`` of a group's pairs; ``v`` is null where ``u`` has more of them."""
    orders = [[b for b in range(BITS) if b not in bits] + bits for bits in map(list, chosen)]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_numpy()
        _, first = np.unique(nodes, return_index=True)
        rows = rows.take(pa.array(first))
        prints = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in ("one", "two")], axis=1)
        known = "component" in rows.column_names
        pairs, more = open_pairs(nodes[first], prints, orders[key[0].as_py()], pc.coalesce(rows.column("component"), rows.column("node")).to_numpy() if known else None, rows.column("unlike").to_pylist() if known else None, few)
        return pa.table({"u": pa.array([*(a for a, _ in pairs), *more], pa.int64()), "v": pa.array([*(b for _, b in pairs), *([None] * len(more))], pa.int64())})

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v`` with ``alike``: whether their shingles' similarity is at least 4/5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            alike = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                alike.append(5 * both >= 4 * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], names=["u", "v", "alike"])

    one, two = sets.select(F.col("node").alias("u"), F.col("held").alias("hu")), sets.select(F.col("node").alias("v"), F.col("held").alias("hv"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "hu", "hv").mapInArrow(run, "u long, v long, alike boolean")


def turns(chosen: list[list[int]]) -> list[tuple[list[list[int]], bool]]:
    """The choices that are compared at a time, and whether crowded groups' cuts meet each other yet; ever more of them, as ever more texts are linked by then."""
    out, at, size = [(chosen[:2], False)], 0, 6
    while at < len(chosen):
        out.append((chosen[at : at + size], True))
        at, size = at + size, size * 2
    return out


def joined(linked: DataFrame | None, links: DataFrame) -> DataFrame:
    """Rows ``node, component`` once ``links`` join what is linked already; earlier links stand for themselves as each node's to its component, so few rounds are needed."""
    if linked is None:
        return stash(connected_components(links, "u", "v"))
    if links.isEmpty():
        return linked
    new = stash(connected_components(linked.toDF("u", "v").unionByName(links), "u", "v"))
    forget(linked)
    return new


def near_components(docs: DataFrame, distinct: DataFrame, text_col: str, width: int, group: int = GROUP, largest: int = LARGEST, few: int = FEW) -> DataFrame:
    """From ``node, row, one, two``, rows ``node, component`` for all that link to another."""
    chosen = choices(distinct.count(), group)
    found = linked = named = None
    spark = distinct.sparkSession

    def known(rows: DataFrame) -> DataFrame:
        """With ``component`` where it is another's node, and the texts found ``unlike``."""
        if found is None:
            return rows
        bad = found.where("not alike")
        both = bad.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(bad.select(F.col("v").alias("node"), F.col("u").alias("other")))
        return rows.join(linked.where("component <> node"), "node", "left").join(both.groupBy("node").agg(F.collect_set("other").alias("unlike")), "node", "left")

    def compare(rows: DataFrame, picked: list[list[int]], across: bool, few: int) -> DataFrame:
        """The texts that have more; pairs are decided, those of a component are not asked."""
        nonlocal found, linked
        dealt = _dealt(known(rows), picked, largest)
        asked = stash((dealt if across else dealt.where("a = b")).groupBy("choice", "part", "a", "b").applyInArrow(_compare(picked, few), "u long, v long").distinct())
        pairs = asked.where("v is not null")
        if found is None or not pairs.isEmpty():
            ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
            sets = stash(_sets(docs, distinct.select("node", "row").join(ends, "node", "left_semi"), text_col, width))
            new = stash(_verified(pairs, sets))
            forget(sets)
            found = new if found is None else found.unionByName(new)
            linked = joined(linked, new.where("alike").select("u", "v"))
        sweep(spark)
        return asked.where("v is null").select(F.col("u").alias("node"))

    for picked, across in turns(chosen):
        more = compare(distinct, picked, across, few)
        if across:  # what cuts alone leave open is asked again anyway
            named = more if named is None else named.unionByName(more)
    named = named.distinct() if named is not None else more
    while not named.isEmpty():
        few *= 4
        named = compare(distinct.join(named, "node", "left_semi"), chosen, True, few)
    return linked


def _rooted(numbered: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The marks, and rows ``node, component, least`` of the distinct sets; ``least`` is the first row of the set."""
    marked = stash(marks(numbered, id_col, text_col, width))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = stash(marked.groupBy("node").agg(F.min(rank).alias("least"), F.first("one").alias("one"), F.first("two").alias("two")))
    linked = near_components(numbered, distinct.select("node", F.col("least.row").alias("row"), "one", "two"), text_col, width)
    return marked, distinct.select("node", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _numbered(docs: DataFrame) -> DataFrame:
    return stash(docs.withColumn("_sim_row", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Rows ``doc_id, node, component_id``: the smallest id among documents linked by similar shingles."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked, rooted = _rooted(_numbered(chosen), "doc_id", "text", width)
    smallest = rooted.groupBy("component").agg(F.min("least").alias("least")).select("component", F.col("least.doc_id").alias("component_id"))
    classes = rooted.select("node", "component").join(smallest, "component").select("node", "component_id")
    return marked.select("doc_id", "node").join(classes, "node").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row of each component."""
    held, own = making_room(docs, "", "_sim")
    numbered = _numbered(held)
    marked, rooted = _rooted(numbered, own[id_col], own[text_col], width)
    kept = stash(rooted.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.row").alias("_sim_row")))
    forget(marked)
    return numbered.join(if_small(kept), "_sim_row", "left_semi").drop("_sim_row").toDF(*docs.columns)
