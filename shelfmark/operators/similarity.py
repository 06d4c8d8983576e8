"""Near-duplicates, similarity, text and vector search (group J), entity clusters (group K), labels over vectors (group L)."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.functions.scalars import cosine, hamming, intersection, unit
from shelfmark.operators.alike import CloseOrAlike, Cosine, best_partners, linked_components, with_links
from shelfmark.operators.components import connected_components
from shelfmark.operators.vectors import BLOCK_ROWS, VectorIndex, alike_components, cosine_pairs, dominant_dimension, mmr, similarity_groups, usable
from shelfmark.registry import query
from shelfmark.runtime import stash


def sign_hash(column: str = "embedding") -> Column:
    """64 sign bits of a vector as a signed number."""
    bits = F.transform(F.slice(column, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def hamming_pairs(df: DataFrame, radius: int, key: str = "vec_id", hash_col: str = "hash") -> DataFrame:
    """Rows ``a, b, bits`` of all pairs within ``radius``, exactly: hashes within it agree on one of radius + 1 bands.

    Bands of few bits (a wide radius) have large groups; those pairs are many by nature.
    """
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(hash_col, a).bitwiseAND((1 << (b - a)) - 1).alias("part")) for k, (a, b) in enumerate(itertools.pairwise(cuts))])
    keyed = df.select(F.col(key).alias("k"), F.col(hash_col).alias("h"), F.inline(bands))
    left, right = keyed.alias("l"), keyed.alias("r")
    far = F.bit_count(F.col("l.h").bitwiseXOR(F.col("r.h")))
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.k") < F.col("r.k"))
    # a pair shows in each band it shares; the first one speaks for it
    diff = F.col("l.h").bitwiseXOR(F.col("r.h"))
    first = F.lit(0)
    for k, (a, b) in reversed(list(enumerate(itertools.pairwise(cuts)))):
        first = F.when(F.shiftrightunsigned(diff, a).bitwiseAND((1 << (b - a)) - 1) == 0, k).otherwise(first)
    return left.join(right, same & (far <= radius) & (first == F.col("l.band"))).select(F.col("l.k").alias("a"), F.col("r.k").alias("b"), far.alias("bits"))


def duplicate_groups(df: DataFrame, strict: int, loose: int, least_cosine: float, key: str = "vec_id", alone: int = BLOCK_ROWS) -> DataFrame:
    """Components of pairs that are close by hash, or less close but alike by vector."""
    held = df.where("hash is not null").select(F.col(key).alias("k"), F.col("hash").alias("h"), F.col("embedding").alias("v"))
    return linked_components(held, CloseOrAlike(strict, loose, least_cosine), alone)


def nearest(df: DataFrame, query_id: int, k: int, least: float = -1.0, key: str = "vec_id") -> DataFrame:
    """The ``k`` rows most alike to one; filters come before the ranking."""
    asked = F.broadcast(df.where(F.col(key) == query_id).select(F.col("embedding").alias("q")))
    scored = df.where(F.col(key) != query_id).join(asked).where(F.size("embedding") == F.size("q")).withColumn("similarity", cosine("embedding", "q")).where(F.col("similarity") >= least)
    return scored.orderBy(F.desc(F.round("similarity", 9)), key).limit(k).drop("q")


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc, w, length``: each text's words in lower case."""
    split = docs.select(F.col(key).alias("doc"), F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "").alias("w"))
    return split.withColumn("length", F.size("w"))


def text_search(docs: DataFrame, terms: list[str], k: int, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over prefix terms that all must occur; scores scaled to 0 to 1 among the hits."""
    split = words(docs, key)
    totals = split.agg(F.count("*").alias("docs"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean"))
    which = F.lit(None).cast("int")
    for i, term in enumerate(terms):
        which = F.when(F.col("term").startswith(term.lower()), i).otherwise(which)
    # only the words asked for leave their text
    asked = F.filter("w", lambda w: reduce(lambda x, y: x | y, [w.startswith(term.lower()) for term in terms], F.lit(False)))
    hits = split.select("doc", "length", F.explode(asked).alias("term")).groupBy("doc", "length", which.alias("q")).agg(F.count("*").alias("tf"))
    df = hits.groupBy("q").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = hits.join(F.broadcast(df), "q").join(F.broadcast(totals)).groupBy("doc").agg(F.count("*").alias("n"), F.sum(weight).alias("bm25")).where(F.col("n") == len(terms))
    top = scored.orderBy(F.desc("bm25"), "doc").limit(k)
    low_high = F.broadcast(top.agg(F.min("bm25").alias("lo"), F.max("bm25").alias("hi")))
    return top.join(low_high).select("doc", "bm25", F.when(F.col("hi") > F.col("lo"), (F.col("bm25") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("score"))


def centroids(df: DataFrame, owner: str = "label", column: str = "embedding") -> DataFrame:
    """Normalised mean of the normalised vectors of each owner."""
    parts = df.select(owner, F.posexplode(unit(column)).alias("i", "x")).groupBy(owner, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p")).select(owner, unit(F.transform("p", lambda s: s["x"])).alias("centroid"))


#: Owners of a broadcast centroid table; with 512 dimensions that is 40 MB.
MOST_IN_MEMORY = 10_000


def nearest_owner(df: DataFrame, owners: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", most: int = MOST_IN_MEMORY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``vec_id, owner, cosine``: the most alike centroid, if alike enough; ties to the larger owner.

    Few centroids are broadcast after a count; else blocks of vectors meet blocks of centroids, each meeting one matrix product.
    """
    owners = usable(owners, "centroid")
    size = owners.agg(F.max(F.size("centroid"))).first()[0] or 0
    side = usable(df.select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v")), "v").where(F.size("v") == size)
    kind = owners.schema["owner"].dataType.simpleString()
    count = owners.count()
    parts = max(2, -(-count // block_rows)) if count > most else 1
    across = max(1, -(-side.count() // block_rows)) if parts > 1 else 1

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("owner", ascending=False)
        a, b = (np.array(x.tolist()).reshape(len(x), -1) for x in (left["v"], right["centroid"]))
        alike = np.round((a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T, 9)
        at = alike.argmax(axis=1)
        return pd.DataFrame({key: left["k"].to_numpy(), "owner": right["owner"].to_numpy()[at], "cosine": alike[np.arange(len(a)), at]})

    schema = f"{key} long, owner {kind}, cosine double"
    if parts == 1:
        held = owners.toPandas()

        def run(batches):
            for pdf in batches:
                if len(pdf) and len(held):
                    yield best(pdf, held)

        found = side.mapInPandas(run, schema)
    else:
        dealt = side.withColumn("i", F.pmod(F.xxhash64("k"), F.lit(across))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        spread = owners.withColumn("j", F.pmod(F.xxhash64("owner"), F.lit(parts)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))))
        met = lambda l, r: best(l, r) if len(l) and len(r) else pd.DataFrame({key: [], "owner": [], "cosine": []})  # noqa: E731, E741
        found = dealt.groupBy("i", "j").cogroup(spread.groupBy("i", "j")).applyInPandas(lambda l, r: met(l, r), schema)  # noqa: E741
    top = found.groupBy(key).agg(F.max(F.struct("cosine", "owner")).alias("b"))
    return top.where(F.col("b.cosine") >= least).select(key, F.col("b.owner").alias("owner"), F.col("b.cosine").alias("cosine"))


def density_clusters(df: DataFrame, least: float, min_points: int, key: str = "vec_id", alone: int = BLOCK_ROWS) -> DataFrame:
    """DBSCAN over cosine: core points have enough neighbours; a border point joins its most alike core; the rest is noise (null)."""
    held = stash(usable(df.select(F.col(key).alias("k"), F.col("embedding").alias("v")), "v"))
    links = stash(with_links(held, Cosine(least), min_points - 1, alone))
    core = stash(held.join(links.where(F.col("links") + 1 >= min_points), "k", "left_semi"))
    found = linked_components(core, Cosine(least), alone)
    groups = stash(core.select(F.col("k").alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    edge = held.join(links.where(F.col("links") + 1 < min_points), "k", "left_semi")
    joined = best_partners(edge, core, Cosine(least)).join(groups, F.col("partner") == F.col("node")).select(F.col("k").alias("node"), "component")
    return df.select(F.col(key).alias("node")).join(groups.unionByName(joined), "node", "left").select(F.col("node").alias(key), F.col("component").alias("cluster"))


def carried_owners(clusters: DataFrame, previous: DataFrame, share: float = 0.5, key: str = "vec_id") -> DataFrame:
    """For each cluster the earlier owner of most of its members, if of enough of them."""
    known = clusters.where("cluster is not null").join(previous, key, "left")
    votes = known.groupBy("cluster", "owner").agg(F.count("*").alias("n"))
    sizes = known.groupBy("cluster").agg(F.count("*").alias("size"))
    best = votes.where("owner is not null").groupBy("cluster").agg(F.min_by(F.struct("owner", "n"), F.struct(-F.col("n"), F.col("owner"))).alias("b"))
    return best.join(sizes, "cluster").where(F.col("b.n") >= share * F.col("size")).select("cluster", F.col("b.owner").alias("owner"))


def resolve_chains(pairs: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 40) -> DataFrame:
    """Where each merged entity ends up, by pointer doubling; entities in a cycle end at its smallest."""
    now = stash(pairs.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d").groupBy("s").agg(F.min("d").alias("d")).withColumn("low", F.least("s", "d")))
    for _ in range(rounds):
        ahead = now.select(F.col("s").alias("d"), F.col("d").alias("far"), F.col("low").alias("far_low"))
        new = stash(now.join(ahead, "d", "left").select("s", F.coalesce("far", "d").alias("d"), F.least("low", F.coalesce("far_low", "low")).alias("low")))
        moved = new.join(now.select("s", F.col("d").alias("was"), F.col("low").alias("was_low")), "s").where("d <> was or low <> was_low").limit(1).count()
        now = new
        if not moved:
            break
    ends = now.select("s").withColumnRenamed("s", "d")
    # after enough doublings only members of a cycle still point at something that points on
    cyclic = now.join(ends, "d", "left_semi").select("s", F.col("low").alias("d"))
    return now.join(cyclic, "s", "left_anti").select("s", "d").unionByName(cyclic)


def pooled(prompts: DataFrame, column: str = "embedding", pool: str = "max") -> Column:
    """A struct for each label with the pooled cosine to its prompts; prompts are a small table."""
    rows = prompts.select("label", "prompt").orderBy("label").collect()
    out = []
    for name, group in itertools.groupby(rows, key=lambda r: r["label"]):
        near = [cosine(column, F.array(*[F.lit(float(x)) for x in r["prompt"]])) for r in group]
        value = (F.greatest(*near) if len(near) > 1 else near[0]) if pool == "max" else sum(near, F.lit(0.0)) / len(near)
        out.append(F.struct(value.alias("score"), F.lit(name).alias("label")))
    return F.array(*out)


def softmax(scores: Column, temperature: float) -> Column:
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    powers = F.transform(scores, lambda s: F.struct(F.exp((s["score"] - top) / temperature).alias("score"), s["label"].alias("label")))
    total = F.aggregate(powers, F.lit(0.0), lambda a, s: a + s["score"])
    return F.transform(powers, lambda s: F.struct((s["score"] / total).alias("score"), s["label"].alias("label")))


def gated_labels(scores: Column, rules: list[dict] = [], least: float = 0.0, margin: float = 0.0, temperature: float = 0.1, weight: float = 1.0, tag_scale: float = 1.0, other: str = "other") -> Column:  # noqa: B006
    """A struct ``label, score, prob`` from scored labels (an array of ``score, label``), in the JVM.

    The gate looks at the scores alone: if the best is below ``least`` or leads by less than ``margin`` the label is ``other`` with the best score. Past it the label is that of the largest probability, a
    softmax of scores to which rules have added: a rule is ``{"when": Column, "boost": {label: amount}, "kind": "tag" or other}``; amounts of tag rules are scaled by ``tag_scale``, all by ``weight``;
    unknown labels in a boost are skipped. Equal values go to the first label in the array. Null scores give null.
    """
    bonus = lambda name: sum((F.coalesce(F.when(r["when"], F.element_at(F.create_map(*[F.lit(x) for k, v in r["boost"].items() for x in (k, float(v) * (tag_scale if r.get("kind") == "tag" else 1.0) * weight)]), name)), F.lit(0.0)) for r in rules), F.lit(0.0))
    nudged = F.transform(scores, lambda s: F.struct((s["score"] + bonus(s["label"])).alias("score"), s["label"].alias("label")))
    place = lambda found, top: F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.get(found, i)["score"] == top)[0]
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    ranked = F.sort_array(F.transform(scores, lambda s: s["score"]), asc=False)
    second = F.coalesce(F.get(ranked, F.lit(1)), F.lit(-1.0))
    probs = softmax(nudged, temperature)
    top = F.array_max(F.transform(probs, lambda s: s["score"]))
    chosen = place(probs, top)
    sure = (best >= least) & (best - second >= margin)
    found = F.struct(F.when(sure, F.get(scores, chosen)["label"]).otherwise(other).alias("label"), F.when(sure, F.get(scores, chosen)["score"]).otherwise(best).alias("score"), top.alias("prob"))
    return F.when(scores.isNotNull() & (F.size(scores) > 0), found)


def cluster_owners(clusters: DataFrame, previous: DataFrame, vectors: DataFrame, centres: DataFrame, least: float, share: float = 0.5, key: str = "vec_id") -> DataFrame:
    """Rows ``cluster, owner, rule``: the earlier owner whose centroid is most like the cluster's, if enough so (``centroid``); else that of most of its members (``members``); else none (``new``).

    ``vectors`` has the members' vectors, ``centres`` the rows ``owner, centroid``. Clusters meet centroids by a size-checked broadcast or by blocks.
    """
    members = clusters.where("cluster is not null")
    own = centroids(members.join(usable(vectors.select(key, "embedding")), key), "cluster")
    near = nearest_owner(own.select(F.col("cluster").alias(key), F.col("centroid").alias("embedding")), centres, least, key).select(F.col(key).alias("cluster"), F.col("owner").alias("_near"))
    most = carried_owners(clusters, previous, share, key).select("cluster", F.col("owner").alias("_most"))
    rule = F.when(F.col("_near").isNotNull(), "centroid").when(F.col("_most").isNotNull(), "members").otherwise("new")
    return members.select("cluster").distinct().join(near, "cluster", "left").join(most, "cluster", "left").select("cluster", F.coalesce("_near", "_most").alias("owner"), rule.alias("rule"))


def keywords(docs: DataFrame, group: str, k: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Terms of highest tf-idf in each group of documents, each group taken as one text."""
    words = docs.select(group, F.explode(F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")).alias("term"))
    tf = words.groupBy(group, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = F.broadcast(docs.select(group).distinct().agg(F.count("*").alias("groups")))
    weighed = tf.join(df, "term").join(total).withColumn("w", F.round(F.col("tf") * F.log(1 + F.col("groups") / F.col("df")), 6))
    w = W.partitionBy(group).orderBy(F.desc("w"), "term")
    return weighed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "rank", "term", "w")


def hashed(v) -> DataFrame:
    return v.vec.withColumn("hash", sign_hash())


H = "SELECT *, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i) END ELSE 0 END))::BIGINT AS hash FROM vec"
COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
#: From edges e (a, b): g (node, component).
REACHED = "u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.c), g AS (SELECT node, min(c) AS component FROM r GROUP BY 1)"
ALIKE = f"SELECT a.vec_id AS a, b.vec_id AS b, {COS.format(a='a.embedding', b='b.embedding')} AS cos FROM vec a JOIN vec b ON a.vec_id < b.vec_id AND {COS.format(a='a.embedding', b='b.embedding')} >= "


@query("j1_hamming_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.hash, b.hash))::INTEGER AS bits FROM ({H}) a JOIN ({H}) b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 17")
def _(v):
    return hamming_pairs(hashed(v), 17)


@query("j1_duplicate_groups", f"""WITH RECURSIVE h AS ({H}), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 20
  AND (bit_count(xor(a.hash, b.hash)) <= 16 OR {COS.format(a='a.embedding', b='b.embedding')} >= 0.35)), {REACHED} SELECT node, component FROM g""")
def _(v):
    return duplicate_groups(hashed(v), 16, 20, 0.35)


@query("j2_components", f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.vec_id < b.vec_id AND {COS.format(a='a.embedding', b='b.embedding')} >= 0.35),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.c) SELECT node, min(c) AS component FROM r GROUP BY 1""")
def _(v):
    return alike_components(v.vec, 0.35)


@query("j3_cosine_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format(a='a.embedding', b='b.embedding')}, 5) AS cos FROM vec a JOIN vec b ON a.vec_id < b.vec_id AND {COS.format(a='a.embedding', b='b.embedding')} >= 0.35")
def _(v):
    return cosine_pairs(v.vec, 0.35).select("a", "b", F.round("cosine", 5).alias("cos"))


@query("j3_similarity_groups", f"""WITH RECURSIVE e AS ({ALIKE} 0.35), {REACHED}, s AS (SELECT component, node, count(*) OVER (PARTITION BY component) AS n, node * 37 % 101 AS score FROM g)
  SELECT component, n::BIGINT AS count, min_by(node, (-score, node)) AS best, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM s WHERE n BETWEEN 2 AND 50 GROUP BY 1, 2""")
def _(v):
    groups = similarity_groups(v.vec.withColumn("score", F.col("vec_id") * 37 % 101), 0.35)
    return groups.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


@query("j4_threshold_sweep", f"""WITH p AS (SELECT a.label = b.label AS same, {COS.format(a='a.embedding', b='b.embedding')} AS c FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 7), t AS (SELECT unnest([0.0, 0.1, 0.2]) AS cut)
  SELECT cut::DOUBLE AS cut, count(*) FILTER (c >= cut AND same)::BIGINT AS tp, count(*) FILTER (c >= cut AND NOT same)::BIGINT AS fp, count(*) FILTER (c < cut AND same)::BIGINT AS fn FROM p, t GROUP BY 1""")
def _(v):
    other = v.vec.select((F.col("vec_id") - 7).alias("vec_id"), F.col("embedding").alias("o"), F.col("label").alias("ol"))
    pairs = v.vec.join(other, "vec_id").select((F.col("label") == F.col("ol")).alias("same"), cosine("embedding", "o").alias("c"))
    rows = pairs.select("same", "c", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2)])).alias("cut"))
    hit = F.col("c") >= F.col("cut")
    return rows.groupBy("cut").agg(F.count_if(hit & F.col("same")).alias("tp"), F.count_if(hit & ~F.col("same")).alias("fp"), F.count_if(~hit & F.col("same")).alias("fn"))


@query("j5_candidate_distribution", f"SELECT bits, count(*)::BIGINT AS n FROM (SELECT bit_count(xor(a.hash, b.hash))::INTEGER AS bits FROM ({H}) a JOIN ({H}) b ON a.vec_id < b.vec_id) WHERE bits <= 20 GROUP BY 1")
def _(v):
    return hamming_pairs(hashed(v), 20).groupBy("bits").agg(F.count("*").alias("n"))


@query("j6_visually_similar", f"SELECT b.vec_id, round(0.7 * (1 - bit_count(xor(a.hash, b.hash)) / 64.0) + 0.3 * {COS.format(a='a.embedding', b='b.embedding')}, 5) AS score FROM ({H}) a, ({H}) b WHERE a.vec_id = 3 AND b.vec_id <> 3 AND bit_count(xor(a.hash, b.hash)) <= 28 ORDER BY score DESC, b.vec_id LIMIT 50")
def _(v):
    rows = hashed(v)
    asked = F.broadcast(rows.where("vec_id = 3").select(F.col("embedding").alias("q"), F.col("hash").alias("qh")))
    near = rows.where("vec_id <> 3").join(asked).where(hamming("hash", "qh") <= 28)
    score = F.round(0.7 * (1 - hamming("hash", "qh") / 64.0) + 0.3 * cosine("embedding", "q"), 5)
    return near.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(50)


@query("j7_nearest", f"SELECT b.vec_id, round({COS.format(a='a.embedding', b='b.embedding')}, 5) AS similarity FROM vec a, vec b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY {COS.format(a='a.embedding', b='b.embedding')} DESC, b.vec_id LIMIT 25")
def _(v):
    return nearest(v.vec, 0, 25).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("j8_colour_similar", "WITH q AS (SELECT * FROM metric WHERE path = (SELECT min(path) FROM metric)) SELECT m.path, round(least(m.aesthetic / (m.aesthetic + m.exposure), q.aesthetic / (q.aesthetic + q.exposure)) + least(m.exposure / (m.aesthetic + m.exposure), q.exposure / (q.aesthetic + q.exposure)), 5) AS shared FROM metric m, q WHERE abs(m.comp_score - q.comp_score) <= 0.5 AND m.path <> q.path")
def _(v):
    first = v.metric.agg(F.min_by(F.struct("aesthetic", "exposure", "comp_score", "path"), "path").alias("q")).select("q.*").toDF("qa", "qe", "qc", "qp")
    rows = v.metric.join(F.broadcast(first)).where((F.abs(F.col("comp_score") - F.col("qc")) <= 0.5) & (F.col("path") != F.col("qp")))
    return rows.select("path", F.round(intersection(F.array("aesthetic", "exposure"), F.array("qa", "qe")), 5).alias("shared"))


@query("j9_same_person", "SELECT vec_id FROM vec WHERE label IN (SELECT label FROM vec WHERE vec_id = 5) AND vec_id <> 5")
def _(v):
    return v.vec.where("vec_id <> 5").join(v.vec.where("vec_id = 5").select("label"), "label", "left_semi").select("vec_id")


@query("j10_semantic_search", f"SELECT b.vec_id, round({COS.format(a='a.embedding', b='b.embedding')}, 5) AS similarity FROM vec a, vec b WHERE a.vec_id = 11 AND b.vec_id <> 11 AND {COS.format(a='a.embedding', b='b.embedding')} >= 0.15 ORDER BY {COS.format(a='a.embedding', b='b.embedding')} DESC, b.vec_id LIMIT 40")
def _(v):
    return nearest(v.vec, 11, 40, 0.15).select("vec_id", F.round("similarity", 5).alias("similarity"))


BM25 = """WITH w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
  t AS (SELECT doc, len(w) AS length, unnest(w) AS term FROM w), m AS (SELECT avg(length)::DOUBLE AS mean FROM (SELECT DISTINCT doc, length FROM t)), n AS (SELECT count(*) AS docs FROM documents),
  h AS (SELECT doc, length, CASE WHEN starts_with(term, 'licens') THEN 0 ELSE 1 END AS q, count(*) AS tf FROM t WHERE starts_with(term, 'licens') OR starts_with(term, 'the') GROUP BY 1, 2, 3), f AS (SELECT q, count(*) AS df FROM h GROUP BY 1),
  s AS (SELECT doc, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS bm25 FROM h JOIN f ON f.q = h.q, m, n GROUP BY 1 HAVING count(*) = 2),
  p AS (SELECT * FROM s ORDER BY bm25 DESC, doc LIMIT 20)"""


@query("j11_text_search", BM25 + " SELECT doc, round((bm25 - (SELECT min(bm25) FROM p)) / ((SELECT max(bm25) FROM p) - (SELECT min(bm25) FROM p)), 4) AS score FROM p")
def _(v):
    return text_search(v.table("documents"), ["licens", "the"], 20).select("doc", F.round("score", 4).alias("score"))


@query("j12_hybrid_merge", BM25 + f", x AS (SELECT doc, (bm25 - (SELECT min(bm25) FROM p)) / ((SELECT max(bm25) FROM p) - (SELECT min(bm25) FROM p)) AS t FROM p), y AS (SELECT b.vec_id AS doc, {COS.format(a='a.embedding', b='b.embedding')} AS e FROM vec a, vec b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY e DESC, doc LIMIT 25) SELECT coalesce(x.doc, y.doc) AS doc, round(0.7 * coalesce(e, 0) + 0.3 * coalesce(t, 0), 4) AS score FROM x FULL JOIN y ON x.doc = y.doc")
def _(v):
    text = text_search(v.table("documents"), ["licens", "the"], 20).select("doc", "score")
    near = nearest(v.vec, 0, 25).select(F.col("vec_id").alias("doc"), "similarity")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return text.join(near, "doc", "full").select("doc", F.round(0.7 * zero("similarity") + 0.3 * zero("score"), 4).alias("score"))


@query("j13_group_paging", f"WITH RECURSIVE e AS ({ALIKE} 0.3), {REACHED} SELECT component, count(*)::BIGINT AS n FROM g WHERE node % 7 <> 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY md5('4:' || component), component LIMIT 20")
def _(v):
    groups = alike_components(v.vec, 0.3).where("node % 7 <> 0").groupBy("component").agg(F.count("*").alias("n")).where("n >= 2")
    return groups.orderBy(F.md5(F.concat(F.lit("4:"), F.col("component").cast("string")).cast("binary")), "component").limit(20)


@query("j14_vector_index", "SELECT vec_id, len(embedding)::BIGINT AS dim FROM vec WHERE len(embedding) = 64")
def _(v):
    return dominant_dimension(v.vec).select("vec_id", F.size("embedding").cast("bigint").alias("dim"))


@query("j14_index_search")
def _(v):
    index = VectorIndex(v.vec)
    asked = v.vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"))
    found = index.search(asked, 5)
    return found.select(F.col("k").alias("query_id"), "rank", F.col("neighbour").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("j15_mmr")
def _(v):
    return mmr(v.vec.select("label", F.col("vec_id").alias("path"), "embedding", ((F.col("vec_id") % 10) / 10).alias("score")), "label", 8, 0.6)


@query("k1_density_clusters", f"""WITH RECURSIVE p AS ({ALIKE} 0.3), pairs AS (SELECT a, b, cos FROM p UNION ALL SELECT b, a, cos FROM p), core AS (SELECT a AS core FROM pairs GROUP BY 1 HAVING count(*) + 1 >= 3),
  e AS (SELECT a, b FROM pairs SEMI JOIN core x ON pairs.a = x.core SEMI JOIN core y ON pairs.b = y.core UNION SELECT core, core FROM core), {REACHED},
  border AS (SELECT a AS node, arg_min(component, (-cos, b)) AS component FROM pairs JOIN g ON g.node = pairs.b WHERE a NOT IN (SELECT core FROM core) GROUP BY 1)
  SELECT vec_id, component AS cluster FROM vec LEFT JOIN (SELECT * FROM g UNION ALL SELECT * FROM border) m ON m.node = vec_id""")
def _(v):
    return density_clusters(v.vec, 0.3, 3)


@query("k2_embedding_spaces", "SELECT CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'new' END AS space, count(*)::BIGINT AS n FROM vec GROUP BY 1")
def _(v):
    return v.vec.groupBy(F.when(F.col("vec_id") % 5 == 0, "old").otherwise("new").alias("space")).agg(F.count("*").alias("n"))


CENTRES = """SELECT label, list(x ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda e: e::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))))) AS x FROM vec) GROUP BY 1, 2) GROUP BY 1"""


@query("k3_carried_owners", "SELECT cluster, owner FROM (SELECT vec_id % 20 AS cluster, label AS owner, count(*) AS n, sum(count(*)) OVER (PARTITION BY vec_id % 20) AS size, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY count(*) DESC, label) AS rn FROM vec GROUP BY 1, 2) WHERE rn = 1 AND n >= 0.15 * size")
def _(v):
    clusters = v.vec.select("vec_id", (F.col("vec_id") % 20).alias("cluster"))
    return carried_owners(clusters, v.vec.select("vec_id", F.col("label").alias("owner")), 0.15)


@query("k3_cluster_owners", f"""WITH c AS ({CENTRES}), m AS (SELECT vec_id % 20 AS cluster, x.* FROM (SELECT vec_id, embedding FROM vec) x),
  o AS (SELECT cluster, list(x ORDER BY i) AS centroid FROM (SELECT cluster, i, avg(x) AS x FROM (SELECT cluster, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda e: e::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))))) AS x FROM m) GROUP BY 1, 2) GROUP BY 1),
  n AS (SELECT cluster, arg_max(label, (round({COS.format(a='o.centroid', b='c.centroid')}, 9), label)) AS near FROM o, c WHERE {COS.format(a='o.centroid', b='c.centroid')} >= 0.3 GROUP BY 1),
  t AS (SELECT cluster, owner FROM (SELECT vec_id % 20 AS cluster, label AS owner, count(*) AS n, sum(count(*)) OVER (PARTITION BY vec_id % 20) AS size, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY count(*) DESC, label) AS rn FROM vec GROUP BY 1, 2) WHERE rn = 1 AND n >= 0.2 * size)
  SELECT d.cluster, coalesce(near, owner) AS owner, CASE WHEN near IS NOT NULL THEN 'centroid' WHEN owner IS NOT NULL THEN 'members' ELSE 'new' END AS rule FROM (SELECT DISTINCT vec_id % 20 AS cluster FROM vec) d LEFT JOIN n ON n.cluster = d.cluster LEFT JOIN t ON t.cluster = d.cluster""")
def _(v):
    clusters = v.vec.select("vec_id", (F.col("vec_id") % 20).alias("cluster"))
    owners = centroids(v.vec).select(F.col("label").alias("owner"), "centroid")
    return cluster_owners(clusters, v.vec.select("vec_id", F.col("label").alias("owner")), v.vec, owners, 0.3, 0.2)


@query("k4_noise_keeps_owner", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label ELSE vec_id % 20 END::BIGINT AS owner FROM vec")
def _(v):
    clusters = v.vec.select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 20).alias("cluster"))
    return clusters.join(v.vec.select("vec_id", "label"), "vec_id", "left").select("vec_id", F.coalesce("cluster", F.col("label").cast("bigint")).alias("owner"))


@query("k5_centroids", f"SELECT v.label, count(*)::BIGINT AS n, round(avg({COS.format(a='v.embedding', b='c.centroid')}), 5) AS mean FROM vec v JOIN ({CENTRES}) c ON c.label = v.label GROUP BY 1")
def _(v):
    return v.vec.join(centroids(v.vec), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cosine("embedding", "centroid")), 5).alias("mean"))


@query("k6_representatives", f"SELECT v.label, min_by(vec_id, (-round({COS.format(a='v.embedding', b='c.centroid')}, 9), vec_id)) AS face FROM vec v JOIN ({CENTRES}) c ON c.label = v.label GROUP BY 1")
def _(v):
    near = v.vec.join(centroids(v.vec), "label").withColumn("c", F.round(cosine("embedding", "centroid"), 9))
    return near.groupBy("label").agg(F.min_by("vec_id", F.struct(-F.col("c"), F.col("vec_id"))).alias("face"))


@query("k7_nearest_person", f"SELECT vec_id, arg_max(c.label, (round({COS.format(a='v.embedding', b='c.centroid')}, 9), c.label)) AS person FROM vec v, ({CENTRES}) c WHERE {COS.format(a='v.embedding', b='c.centroid')} >= 0.2 GROUP BY 1")
def _(v):
    owners = centroids(v.vec).select(F.col("label").alias("owner"), "centroid")
    return nearest_owner(v.vec, owners, 0.2).select("vec_id", F.col("owner").alias("person"))


@query("k8_merge_suggestions", f"WITH c AS ({CENTRES}) SELECT a.label AS a, b.label AS b, round({COS.format(a='a.centroid', b='b.centroid')}, 5) AS cos FROM c a JOIN c b ON a.label < b.label WHERE {COS.format(a='a.centroid', b='b.centroid')} >= 0.0 AND (a.label + b.label) % 5 <> 0")
def _(v):
    alike = cosine_pairs(centroids(v.vec).toDF("vec_id", "embedding"), 0.0)
    rejected = alike.where("(a + b) % 5 = 0").select("a", "b")
    return alike.join(rejected, ["a", "b"], "left_anti").select("a", "b", F.round("cosine", 5).alias("cos"))


@query("k9_merge_groups", f"""WITH RECURSIVE c AS ({CENTRES}), e AS (SELECT a.label AS a, b.label AS b, {COS.format(a='a.centroid', b='b.centroid')} AS cos FROM c a JOIN c b ON a.label < b.label WHERE {COS.format(a='a.centroid', b='b.centroid')} >= 0.05), {REACHED}
  SELECT component, count(*)::BIGINT AS pairs, round(min(cos), 5) AS low, round(max(cos), 5) AS high FROM e JOIN g ON g.node = e.a GROUP BY 1""")
def _(v):
    pairs = stash(cosine_pairs(centroids(v.vec).toDF("vec_id", "embedding"), 0.05))
    groups = connected_components(pairs, "a", "b")
    return pairs.join(groups, F.col("a") == F.col("node")).groupBy("component").agg(F.count("*").alias("pairs"), F.round(F.min("cosine"), 5).alias("low"), F.round(F.max("cosine"), 5).alias("high"))


@query("k10_merge_chains", """WITH RECURSIVE m AS (SELECT vec_id AS s, vec_id - 1 AS d FROM vec WHERE vec_id % 3 <> 0), w AS (SELECT s, d FROM m UNION ALL SELECT w.s, m.d FROM w JOIN m ON m.s = w.d) SELECT s, min(d) AS d FROM w GROUP BY 1""")
def _(v):
    moved = v.vec.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("src"), F.when(F.col("vec_id") % 3 == 1, F.col("vec_id") - 1).otherwise(F.col("vec_id") - 1).alias("dst"))
    return resolve_chains(moved)


@query("k11_needs_naming", "SELECT label, count(*)::BIGINT AS n FROM vec GROUP BY 1 HAVING count(*) >= 5 AND label % 2 = 0 ORDER BY n DESC, label")
def _(v):
    return v.vec.groupBy("label").agg(F.count("*").alias("n")).where("n >= 5 and label % 2 = 0").orderBy(F.desc("n"), "label")


@query("k12_attach_persons", "SELECT l_orderkey AS path, string_agg(DISTINCT CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey::VARCHAR END, ',' ORDER BY CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey::VARCHAR END) AS people, count(*) FILTER (l_suppkey % 4 = 0)::BIGINT AS unassigned FROM lineitem GROUP BY 1")
def _(v):
    person = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey").cast("string"))
    groups = v.table("lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.array_sort(F.collect_set(person)).alias("p"), F.count_if(F.col("l_suppkey") % 4 == 0).alias("unassigned"))
    return groups.select("path", F.when(F.size("p") > 0, F.array_join("p", ",")).alias("people"), "unassigned")


def prompts(v) -> DataFrame:
    return v.vec.where("vec_id < 12").select((F.col("vec_id") % 4).cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("prompt"))


PROMPTED = f"SELECT v.vec_id, (p.vec_id % 4)::VARCHAR AS name, max({COS.format(a='v.embedding', b='p.embedding')}) AS s FROM vec v, vec p WHERE p.vec_id < 12 GROUP BY 1, 2"


@query("l1_pooled_cosine", f"SELECT vec_id, name, round(s, 5) AS s FROM ({PROMPTED})")
def _(v):
    return v.vec.select("vec_id", F.explode(pooled(prompts(v))).alias("p")).select("vec_id", F.col("p.label").alias("name"), F.round("p.score", 5).alias("s"))


@query("l2_multi_tag", f"SELECT vec_id, string_agg(name, ',' ORDER BY round(s, 9) DESC, name) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, name) AS rn FROM ({PROMPTED}) WHERE s >= 0.1) WHERE rn <= 2 GROUP BY 1")
def _(v):
    held = F.filter(pooled(prompts(v)), lambda s: s["score"] >= 0.1)
    best = F.slice(F.array_sort(F.transform(held, lambda s: F.struct((-F.round(s["score"], 9)).alias("m"), s["label"].alias("label")))), 1, 2)
    return v.vec.select("vec_id", F.array_join(F.transform(best, lambda s: s["label"]), ",").alias("tags")).where("tags <> ''")


@query("l3_kind_with_margin", f"SELECT vec_id, CASE WHEN top >= 0.15 AND top - second >= 0.05 THEN name END AS kind FROM (SELECT vec_id, max(s) AS top, list_sort(list(s), 'DESC')[2] AS second, arg_max(name, s) AS name FROM ({PROMPTED}) GROUP BY 1)")
def _(v):
    ranked = v.vec.select("vec_id", F.sort_array(pooled(prompts(v)), asc=False).alias("r"))
    sure = (F.col("r")[0]["score"] >= 0.15) & (F.col("r")[0]["score"] - F.col("r")[1]["score"] >= 0.05)
    return ranked.select("vec_id", F.when(sure, F.col("r")[0]["label"]).alias("kind"))


@query("l4_moment_softmax", f"SELECT vec_id, arg_max(name, s) AS name, round(max(exp(s / 0.1)) / sum(exp(s / 0.1)), 5) AS p FROM ({PROMPTED}) GROUP BY 1")
def _(v):
    best = F.array_max(softmax(pooled(prompts(v)), 0.1))
    return v.vec.select("vec_id", best.alias("b")).select("vec_id", F.col("b.label").alias("name"), F.round("b.score", 5).alias("p"))


@query("l4_gated_moments", f"""WITH s AS (SELECT vec_id, name, s FROM ({PROMPTED})), b AS (SELECT vec_id, max(s) AS top, list_sort(list(s), 'DESC')[2] AS second FROM s GROUP BY 1),
  n AS (SELECT vec_id, name, s, s + CASE WHEN vec_id % 3 = 0 AND name = '1' THEN 0.05 ELSE 0 END + CASE WHEN vec_id % 2 = 0 AND name = '2' THEN 0.01 ELSE 0 END AS t FROM s),
  c AS (SELECT vec_id, arg_max(name, t) AS name, arg_max(s, t) AS s, max(exp(t / 0.1)) / sum(exp(t / 0.1)) AS p FROM n GROUP BY 1)
  SELECT b.vec_id, CASE WHEN top >= 0.1 AND top - second >= 0.02 THEN c.name ELSE 'other' END AS name, round(CASE WHEN top >= 0.1 AND top - second >= 0.02 THEN c.s ELSE top END, 5) AS score, round(p, 5) AS p FROM b JOIN c ON c.vec_id = b.vec_id""")
def _(v):
    rules = [{"when": F.col("vec_id") % 3 == 0, "boost": {"1": 0.05, "unknown": 9.0}}, {"when": F.col("vec_id") % 2 == 0, "boost": {"2": 0.02}, "kind": "tag"}]
    found = v.vec.withColumn("scores", pooled(prompts(v))).select("vec_id", gated_labels(F.col("scores"), rules, 0.1, 0.02, tag_scale=0.5).alias("m"))
    return found.select("vec_id", F.col("m.label").alias("name"), F.round("m.score", 5).alias("score"), F.round("m.prob", 5).alias("p"))


@query("l6_attributes", f"SELECT vec_id, name, round(1 / (1 + exp(-(s - 0.1) / 0.05)), 5) AS c FROM ({PROMPTED}) WHERE s >= 0.1")
def _(v):
    rows = v.vec.select("vec_id", F.explode(pooled(prompts(v))).alias("p")).where("p.score >= 0.1")
    return rows.select("vec_id", F.col("p.label").alias("name"), F.round(1 / (1 + F.exp(-(F.col("p.score") - 0.1) / 0.05)), 5).alias("c"))


@query("l7_only_missing", "SELECT path FROM shot WHERE nullif(ev % 10, 3) IS NULL ORDER BY path LIMIT 100")
def _(v):
    return v.shot.where(F.nullif(F.col("ev") % 10, F.lit(3)).isNull()).orderBy("path").limit(100).select("path")


@query("l8_keywords", """WITH t AS (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY 1, 2),
  d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT lang, c.term, round(tf * ln(1 + (SELECT count(DISTINCT lang) FROM documents) / df::DOUBLE), 6) AS w FROM c JOIN d ON d.term = c.term)
  SELECT lang, rank::INTEGER AS rank, term, w FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY w DESC, term) AS rank FROM w) WHERE rank <= 10""")
def _(v):
    return keywords(v.table("documents"), "lang", 10)
