"""Near-duplicate texts against brute force over all pairs."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import near_texts
from shelfmark.llm.simhash import near_rows


def brute_components(held, width=5):
    sets = {}
    for i, t in held:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def edited(count=12, copies=6, words=200):
    """Texts of random words, and copies of them with one to seven words changed."""
    rng = np.random.default_rng(11)
    out = []
    for k in range(count):
        base = [f"w{x}" for x in rng.integers(0, 4000, words)]
        out.append((len(out), " ".join(base)))
        for c in range(copies):
            copy = list(base)
            for at in rng.choice(words, 1 + c, replace=False):
                copy[at] = f"new{k}x{c}y{at}"
            out.append((len(out), " ".join(copy)))
    return [*out, (len(out), None), (len(out) + 1, ""), (len(out) + 2, out[0][1].upper())]


def test_edited_copies_go_and_clean_texts_stay(spark):
    held = edited()
    want = brute_components(held)
    df = spark.createDataFrame(held, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert 13 < len(set(want.values())) < len(held) / 2
    assert got == set(want.values())


def test_cut_groups_and_rounds_lose_no_link(spark):
    held = edited(count=3, copies=40, words=400)
    want = brute_components(held)
    df = near_texts._numbered(spark.createDataFrame(held, "doc_id long, text string"))
    marked = near_texts.marks(df, "doc_id", "text", 5).groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("one").alias("one"), F.first("two").alias("two"))
    distinct = marked.select("node", F.col("least.row").alias("row"), F.col("least.doc_id").alias("least"), "one", "two").cache()
    least = {r["node"]: r["least"] for r in distinct.collect()}
    for group, largest, few in ((1024, 4096, 2), (1024, 16, 1), (16, 32, 2)):
        found = near_texts.near_components(df, distinct, "text", 5, group=group, largest=largest, few=few).collect()
        groups = {}
        for r in found:
            groups.setdefault(r["component"], set()).add(least[r["node"]])
        expect = {}
        for i in least.values():
            expect.setdefault(want[i], set()).add(i)
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in expect.values() if len(g) > 1}


def test_rows_without_words_or_ids(spark):
    held = [(1, None, "a"), (2, "", "b"), (None, "a b c", "c"), (3, "a b c", "d"), (4, "A b  c", "e"), (5, "other", "f"), (5, "one two", "g"), (5, "one two", "h"), (None, "nobody", "i"), (None, "nobody", "j")]
    df = spark.createDataFrame(held, "doc_id long, text string, node string").coalesce(1)
    kept = near_texts.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["node"] for r in kept.collect()) == ["a", "d", "f", "g", "i"]  # two texts of one id are two documents
    assert near_texts.keep_one(df.limit(0)).count() == 0
    clashing = df.withColumn("_SIM_row", F.lit(1))
    assert near_texts.keep_one(clashing).columns == clashing.columns


def test_counters_match_plain_counts():
    rng = np.random.default_rng(2)
    for words, radius in ((1, 4), (2, 31), (1, 0), (2, 5)):
        centre = rng.integers(0, 1 << 63, (40, words), dtype=np.uint64)
        values = np.concatenate([centre ^ np.uint64((1 << int(k)) - 1) for k in rng.integers(0, 40, 6)])
        got = np.unpackbits(near_rows(values, radius, rng.permutation(64 * words).tolist()).view(np.uint8), axis=1, bitorder="little")[:, : len(values)]
        apart = np.bitwise_count(values[:, None] ^ values[None, :]).sum(axis=2, dtype=int)
        assert (got == (apart <= radius)).all()


def test_pairs_follow_the_rows_of_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 4000, 300)]
    held = []
    for i in range(240):
        copy = list(base)
        for at in rng.choice(300, 1 + i % 5, replace=False):
            copy[at] = f"new{i}y{at}"
        held.append((i, " ".join(copy)))
    df = near_texts._numbered(spark.createDataFrame(held, "doc_id long, text string"))
    distinct = near_texts.marks(df, "doc_id", "text", 5).select("node", "row", "one", "two").cache()
    asked, plain = [], near_texts._verified
    monkeypatch.setattr(near_texts, "_verified", lambda pairs, sets: asked.append(pairs.count()) or plain(pairs, sets))
    found = near_texts.near_components(df, distinct, "text", 5, group=16, largest=64).collect()
    assert len(found) == 240 and len({r["component"] for r in found}) == 1
    assert sum(asked) < 10 * 240, asked
