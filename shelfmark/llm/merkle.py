"""A Merkle manifest of a table: a tree of digests for each group of rows, and a tree of the groups' roots above.

A row's digest is SHA-256 of its columns, each with its length in front. Rows stand in order within their
group; every run of ``arity`` consecutive nodes becomes their parent's digest until one node, the group's
root, is left. The groups' roots, in the order of their groups, make a tree in the same way.

Every level is an equi-join of its nodes with themselves: a node computes the numbers of its siblings (by XOR in
binary trees, else by the offset of its slot) and looks them up, and nodes in slot zero emit the
parents. No run and no group is gathered in one task: keys are a group and a place, so a group of a third of
all rows is dealt like any other. Paths of siblings then come down from the root, a level at a time.

Defined results: a null value counts as ``-``, unlike any text; a null group is a group of its own and comes first; equal rows
take consecutive places, and rows of one order value follow their digests; a group of one row has that
row's digest as its root; an empty table has no rows and no root. Texts of any length are hashed whole. Other columns are ignored; the
names ``g``, ``i``, ``n``, ``digest``, ``left``, ``right`` and those that begin with ``_mk`` are reserved for ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.llm.common import crc_of_id
from shelfmark.runtime import forget, shuffle_width, stash

ARITY = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def record_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns' texts, each after its count of UTF-8 bytes; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda found, step: F.sha2(F.concat(step["left"], found, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf's run to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _numbered(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``rows`` with ``g`` (the group's number), ``i`` (the row's place in it) and ``n`` (its rows), the groups ``g, n``, and the written tables that both read.

    Range partitions hold the order; where a partition's part of a group begins follows from counts, so no window holds a group's rows.
    """
    wide = 4 * shuffle_width(rows.sparkSession)
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(wide, *keys).sortWithinPartitions(*keys)
    held = stash(dealt.withColumn("_mk_part", F.spark_partition_id()).withColumn("_mk_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    parts = stash(held.groupBy("_mk_part", F.col(group).alias("_mk_group")).agg(F.count("*").alias("_mk_n"), F.min("_mk_at").alias("_mk_first")))
    sizes = parts.groupBy("_mk_group").agg(F.sum("_mk_n").alias("n"), F.min("_mk_part").alias("_mk_in"))
    # groups are numbered like rows: within the range partition that they begin in, after those of earlier partitions
    inner = F.row_number().over(W.partitionBy("_mk_in").orderBy(F.col("_mk_group").asc_nulls_first())) - 1
    begun = sizes.groupBy("_mk_in").agg(F.count("*").alias("_mk_c")).withColumn("_mk_base", F.sum("_mk_c").over(W.orderBy("_mk_in")) - F.col("_mk_c")).drop("_mk_c")
    groups = stash(sizes.withColumn("_mk_inner", inner).join(begun, "_mk_in").select(F.col("_mk_group").alias("_mk_g"), (F.col("_mk_base") + F.col("_mk_inner")).cast("long").alias("g"), "n"))
    before = F.coalesce(F.sum("_mk_n").over(W.partitionBy("_mk_group").orderBy("_mk_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("_mk_before", before).join(groups, F.col("_mk_group").eqNullSafe(F.col("_mk_g")))
    placed = placed.select(F.col("_mk_part").alias("_mk_p"), "_mk_g", "g", "n", (F.col("_mk_before") - F.col("_mk_first")).alias("_mk_shift"))
    same = (F.col("_mk_part") == F.col("_mk_p")) & F.col(group).eqNullSafe(F.col("_mk_g"))
    numbered = held.join(placed, same).withColumn("i", F.col("_mk_at") + F.col("_mk_shift")).drop("_mk_part", "_mk_at", "_mk_p", "_mk_g", "_mk_shift")
    return numbered, groups.select("g", "n"), [held, parts, groups]


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``left`` and ``right``: the digests of the run's other nodes before and after, in order."""
    slot, shifts = F.col("i") % arity, range(1, arity)
    for shift in shifts:
        other = F.col("i").bitwiseXOR(1) if arity == 2 else F.col("i") - slot + (slot + shift) % arity
        found = nodes.select(F.col("g").alias("_mk_g"), F.col("i").alias("_mk_i"), F.col("digest").alias(f"_mk_{shift}"))
        own = nodes if shift == 1 else joined
        joined = own.join(found, (F.col("g") == F.col("_mk_g")) & (other == F.col("_mk_i")), "left").drop("_mk_g", "_mk_i")
    # the shift that leads from a slot to another is their difference in the circle of slots
    to = lambda target: F.coalesce(*[F.when((slot + s) % arity == target, F.col(f"_mk_{s}")) for s in shifts], F.lit(""))
    left = F.concat(*[F.when(slot > t, to(t)).otherwise("") for t in range(arity - 1)])
    right = F.concat(*[F.when(slot < t, to(t)).otherwise("") for t in shifts])
    return joined.withColumn("left", left).withColumn("right", right).drop(*[f"_mk_{s}" for s in shifts])


def _climb(nodes: DataFrame, most: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Each level with siblings, and the roots ``g, level, digest``; ``most``: the rows of the largest group. Levels above the first hold groups with several nodes only."""
    level = stash(_with_siblings(nodes, arity))
    levels, roots = [level], level.where("n = 1").select("g", F.lit(0).alias("level"), "digest")
    while most > 1:
        first = level.where((F.col("n") > 1) & (F.col("i") % arity == 0))
        above = first.select("g", F.floor(F.col("i") / arity).cast("long").alias("i"), F.ceil(F.col("n") / arity).cast("long").alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        most = -(-most // arity)
        roots = roots.unionByName(above.where("n = 1").select("g", F.lit(len(levels)).alias("level"), "digest"))
        if most > 1:
            level = stash(_with_siblings(above.where("n > 1"), arity))
            levels.append(level)
    return levels, roots


def _descend(levels: list[DataFrame], roots: DataFrame, arity: int) -> DataFrame:
    """The nodes of the first level with ``path``, the siblings on the way to the root, and the other columns of ``roots`` (``g, level, path``)."""
    passed = [c for c in roots.columns if c not in ("g", "level", "path")]

    def below(level: DataFrame, parents: DataFrame, extend: bool) -> DataFrame:
        known = parents.select(F.col("g").alias("_mk_g"), F.col("i").alias("_mk_i"), F.col("path").alias("_mk_path"), *passed)
        up = F.floor(F.col("i") / arity).cast("long") if extend else F.col("i")
        step = F.array(F.struct("left", "right"))
        path = F.concat(step, F.col("_mk_path")) if extend else F.col("_mk_path")
        return level.join(known, (F.col("g") == F.col("_mk_g")) & (up == F.col("_mk_i"))).withColumn("path", path).drop("_mk_g", "_mk_i", "_mk_path")

    at = lambda k: roots.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), "path", *passed)
    above = at(len(levels))
    for k in range(len(levels) - 1, 0, -1):
        above = below(levels[k], above, True).select("g", "i", "path", *passed).unionByName(at(k))
    return below(levels[0].where("n > 1"), above, True).unionByName(below(levels[0].where("n = 1"), at(0), False))


def manifest(rows: DataFrame, group: str, order: str, digest: str = "leaf", arity: int = ARITY, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``rows`` with ``g`` and ``i`` (the leaf's group and place), ``digest``, ``path``, ``subroot`` and ``root``.

    ``rows`` hold each leaf's digest in the column ``digest``. Work and shuffles follow the rows: a level holds ``1 / arity`` of the nodes below.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    carry = list(carry or [])
    held = stash(rows.select(F.col(group).alias("_mk_source"), F.col(order).alias("_mk_order"), F.col(digest).alias("digest"), *carry))
    numbered, groups, read = _numbered(held, "_mk_source", [F.col("_mk_order").asc_nulls_first(), F.col("digest").asc()])
    count, most = groups.agg(F.count("*"), F.max("n")).first()
    levels, subroots = _climb(numbered.drop("_mk_source", "_mk_order"), most or 0, arity)
    for done in (held, *read):
        forget(done)
    subroots = stash(subroots)
    tops, roots = _climb(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(count).cast("long").alias("n"), "digest", F.col("level").alias("_mk_level")), count, arity)
    bare = F.array().cast("array<struct<left:string,right:string>>")
    down = _descend(tops, roots.withColumn("path", bare).withColumnRenamed("digest", "root"), arity)
    starts = stash(down.select(F.col("i").alias("g"), F.col("_mk_level").alias("level"), "path", F.col("digest").alias("subroot"), "root"))
    return _descend(levels, starts, arity).select(*carry, "g", "i", "digest", "path", "subroot", "root")


def check_documents(docs: DataFrame, tampered: Column, arity: int = ARITY) -> DataFrame:
    """The documents' manifest with ``folded_root``: what a document's leaf leads to after ``tampered``, a text in place of its own, and ``verified``.

    The text is read once: both leaves are hashed in one pass, and no text is shuffled.
    """
    fields = lambda text: [text if c == "text" else F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", "source", record_digest(fields(F.col("text"))).alias("leaf"), record_digest(fields(tampered)).alias("_changed"))
    found = manifest(rows, "source", "doc_id", carry=["doc_id", "leaf", "_changed"], arity=arity)
    folded = found.withColumn("folded_root", fold(F.col("_changed"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def digest(docs: DataFrame) -> DataFrame:
    """The check of ``check_documents`` where every document whose CRC of its id is even has lost its line ends."""
    even = F.coalesce(crc_of_id() % 2 == 0, F.lit(False))
    return check_documents(docs, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def oracle() -> str:
    """SQL for ``digest`` over ``documents``: levels by a recursive grouping, roots folded by a recursive join."""
    record = lambda text: "sha256(concat(" + ", ".join(f"coalesce(concat(octet_length(encode({v})), ':', {v}), '-')" for v in (text if c == "text" else f"{c}::VARCHAR" for c in FIELDS)) + "))"
    byte = "list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda crc, b: {byte}), 4294967295)"

    def tree(name: str, nodes: str) -> str:
        return f"""{name} AS (SELECT 0 AS level, g, i, n, digest FROM {nodes} UNION ALL
            SELECT level + 1, g, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, g, i // {ARITY}, n)"""

    def steps(name: str, nodes: str) -> str:
        return f"""SELECT a.level, a.g, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
            FROM {name} a JOIN {name} b ON a.level = b.level AND a.g = b.g AND a.i // {ARITY} = b.i // {ARITY} WHERE a.n > 1 GROUP BY ALL"""

    return f"""WITH RECURSIVE docs AS (SELECT doc_id, source, {record("text")} AS leaf, {record(f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS changed FROM documents),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM docs),
        leaves AS (SELECT g, i, n, leaf AS digest FROM ranked),
        {tree("low", "leaves")},
        subroots AS (SELECT g AS source_g, digest, level AS height FROM low WHERE n = 1),
        heads AS (SELECT 0 AS g, source_g AS i, (SELECT count(*) FROM subroots) AS n, digest FROM subroots),
        {tree("top", "heads")},
        root AS (SELECT digest AS root FROM top WHERE n = 1),
        low_steps AS ({steps("low", "leaves")}), top_steps AS ({steps("top", "heads")}),
        steps AS (SELECT r.g, r.i, s.level, s.l, s.r FROM ranked r JOIN low_steps s ON s.g = r.g AND s.i = r.i // ({ARITY}**s.level)::BIGINT
            UNION ALL SELECT r.g, r.i, b.height + s.level, s.l, s.r FROM ranked r JOIN subroots b ON b.source_g = r.g JOIN top_steps s ON s.i = r.g // ({ARITY}**s.level)::BIGINT),
        proofs AS (SELECT g, i, string_agg(l || r, '' ORDER BY level) AS proof FROM steps GROUP BY g, i),
        folded AS (SELECT g, i, 0 AS level, changed AS acc FROM ranked UNION ALL
            SELECT f.g, f.i, f.level + 1, sha256(s.l || f.acc || s.r) FROM folded f JOIN steps s ON s.g = f.g AND s.i = f.i AND s.level = f.level)
        SELECT r.doc_id, r.leaf, b.digest AS subroot, t.root, sha256(coalesce(p.proof, '')) AS proof_sha256, arg_max(f.acc, f.level) AS folded_root, arg_max(f.acc, f.level) = t.root AS verified
        FROM ranked r JOIN subroots b ON b.source_g = r.g CROSS JOIN root t JOIN folded f ON f.g = r.g AND f.i = r.i LEFT JOIN proofs p ON p.g = r.g AND p.i = r.i
        GROUP BY r.g, r.i, r.doc_id, r.leaf, b.digest, t.root, p.proof"""
