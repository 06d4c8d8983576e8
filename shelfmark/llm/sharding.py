"""Sharding by balanced label propagation, in DataFrame functions only.

Rows with equal keys (here: equal texts) are linked; a group stands for all its links, so
pairs are never formed. Rows start in shards dealt evenly by a hash. In each round every
group looks at its members' shards and its members propose to move to the shard that
holds most of them. From one shard to another as many rows may go as want the way back, and
as many more as the target has unlinked rows to give away, in the order of groups, the largest first, so that groups
move whole where they fit; unlinked rows then fill what the moves left. Hence the law ``rows`` holds
in each round: counts differ by one at most.

Defined results: a null text counts as an empty one; repeated rows are placed once each;
a group larger than a shard takes several shards. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.llm.common import hot_keys, spread_join
from shelfmark.runtime import forget, shuffle_width, stash

SHARDS = 8
ROUNDS = 6


def ranked(df: DataFrame, by: list[str], order: Column, name: str, salt: Column | None = None) -> DataFrame:
    """``df`` with ``name``: a gapless rank from 0 within each ``by``, in an order of hash buckets.

    Buckets of the order keep windows small: their counts give each bucket its first
    rank, and rows are sorted within their bucket only.
    """
    wide = 4 * shuffle_width(df.sparkSession)
    held = df.withColumn("_bucket", F.shiftrightunsigned(F.xxhash64(salt if salt is not None else order), 40) * wide / F.lit(1 << 24)).withColumn("_bucket", F.floor("_bucket").cast("int"))
    counts = held.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("_first", F.coalesce(before, F.lit(0))).drop("_n")
    inner = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(order)) - 1
    return held.withColumn("_inner", inner).join(offsets, [*by, "_bucket"]).withColumn(name, (F.col("_inner") + F.col("_first")).cast("long")).drop("_inner", "_first", "_bucket")


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``row, doc_id, size, text_crc32, key``: equal keys are equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    crc = F.crc32(F.encode(text, "UTF-8"))
    key = F.struct(F.xxhash64(text).alias("h"), crc.alias("c"), size.alias("s"))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), key.alias("key"))


def propagate(linked: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows ``row, shard`` from ``row, key``; shard counts differ by one at most.

    A round reads and writes one row for each row; only shard totals reach the driver.
    """
    start = ranked(linked.select("row", "key").withColumn("all", F.lit(0)), ["all"], F.struct(F.xxhash64("row"), "row"), "n")
    placed = start.select("row", "key", (F.col("n") % shards).cast("int").alias("shard"))
    hot = hot_keys(linked, ["key"])
    sizes = linked.groupBy("key").agg(F.count("*").alias("links"))
    now = stash(spread_join(placed, sizes, ["key"], hot).select("row", "key", F.xxhash64("key").alias("g"), "links", "shard"))
    wide = 4 * shuffle_width(now.sparkSession)
    for turn_of in range(rounds):
        free = {r["shard"]: r["n"] for r in now.where("links = 1").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        held = now.where("links > 1").groupBy("g", "key", "links", "shard").agg(F.count("*").alias("n"))
        turn = F.pmod(F.col("shard") + F.pmod(F.xxhash64("g", F.lit(turn_of)), F.lit(shards)), F.lit(shards))  # ties go round the shards by group and round
        # every other round looks at shards with unlinked rows to give away alone, else full ones would block their groups
        opened = [s for s in range(shards) if free.get(s, 0) > 0]
        targets = opened if opened and turn_of % 2 == 0 else list(range(shards))
        best = held.where(F.col("shard").isin(targets)).groupBy("g", "key").agg(F.max(F.struct(F.col("n"), turn.alias("turn"), F.col("shard").alias("to"))).alias("best"))
        own = held.join(best.select("g", "key", F.col("best.n").alias("most"), F.col("best.turn").alias("most_turn"), F.col("best.to").alias("to")), ["g", "key"])
        gains = (F.col("shard") != F.col("to")) & ((F.col("n") < F.col("most")) | ((F.col("n") == F.col("most")) & (turn < F.col("most_turn"))))
        asked = stash(own.where(gains).select("g", "key", "links", F.col("shard").alias("from"), "to", "n"))
        wish = {(r["from"], r["to"]): r["n"] for r in asked.groupBy("from", "to").agg(F.sum("n").alias("n")).collect()}
        granted_flow = _quotas(wish, free, shards)
        if not granted_flow:
            if targets == opened and len(opened) < shards:
                continue
            break
        quota = F.element_at(F.array(*[F.lit(granted_flow.get((s, t), 0)) for s in range(shards) for t in range(shards)]), F.col("from") * shards + F.col("to") + 1)
        # larger size classes first, then in hash order, whole groups until a flow's quota is used up
        bucketed = asked.withColumn("b", F.pmod("g", F.lit(wide)) - F.floor(F.log2("links")) * wide)
        firsts = bucketed.groupBy("from", "to", "b").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(W.partitionBy("from", "to").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")
        running = F.coalesce(F.sum("n").over(W.partitionBy("from", "to", "b").orderBy("g", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        granted = bucketed.withColumn("inner", running).join(firsts, ["from", "to", "b"]).withColumn("may", F.least("n", F.greatest(F.lit(0), quota - F.col("before") - F.col("inner"))))
        granted = stash(granted.where("may > 0").select("g", "key", F.col("from").alias("shard"), "to", "n", "may"))
        gain = [0] * shards
        for (source, to), n in granted_flow.items():
            gain[source] -= n
            gain[to] += n
        movers = spread_join(now.where("links > 1"), granted.select("key", "shard", "to", "n", "may"), ["key", "shard"], hot, "left")
        whole = movers.where("may is null or may = n").select("row", "key", "g", "links", F.when(F.col("may").isNotNull(), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        part = ranked(movers.where("may < n"), ["key", "shard"], F.struct(F.xxhash64("row"), "row"), "i")
        part = part.select("row", "key", "g", "links", F.when(F.col("i") < F.col("may"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        # unlinked rows of shards that gained go where rows are missing
        gave = [(s, k) for s in range(shards) for k in [gain[s]] if k > 0]
        lack = [s for s in range(shards) for _ in [0] if gain[s] < 0]
        target = _filling(gave, [(s, -gain[s]) for s in lack], shards)
        loose = ranked(now.where("links = 1"), ["shard"], F.struct(F.xxhash64("row"), "row"), "i")
        loose = loose.select("row", "key", "g", "links", target.alias("shard"))
        last, now = now, stash(whole.unionByName(part).unionByName(loose))
        for done in (last, asked, granted):
            forget(done)
    return now.select("row", "shard")


def _quotas(wish: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> dict[tuple[int, int], int]:
    """How many rows may go from a shard to another: as many as want the way back, and more while the target has unlinked rows to give away."""
    out = {}
    for to in range(shards):
        left = free.get(to, 0)
        for source in range(shards):
            both = min(wish.get((source, to), 0), wish.get((to, source), 0))
            more = min(left, wish.get((source, to), 0) - both)
            left -= more
            if both + more:
                out[source, to] = both + more
    return out


def _filling(gave: list[tuple[int, int]], lack: list[tuple[int, int]], shards: int) -> Column:
    """Where the unlinked row of rank ``i`` in its shard goes: the first ones of a shard that gained fill the others in turn."""
    out, lack = F.col("shard"), [list(x) for x in lack]
    for shard, count in gave:
        at = 0
        while at < count:
            to = lack[0]
            n = min(count - at, to[1])
            out = F.when((F.col("shard") == shard) & (F.col("i") >= at) & (F.col("i") < at + n), F.lit(to[0])).otherwise(out)
            at += n
            to[1] -= n
            if not to[1]:
                lack.pop(0)
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    base = stash(nodes(docs, id_col, text_col))
    placed = base.join(propagate(base, shards, rounds), "row")
    slotted = ranked(placed, ["shard"], F.struct(F.xxhash64("row"), "row"), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
