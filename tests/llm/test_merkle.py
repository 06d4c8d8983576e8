"""The Merkle manifest against plain loops."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g long, leaf string, path string"


def rows():
    out = [(i, f"text {i}\nmore\n" * (i % 4), "en", f"s{i % 3}", i, 1, "x", "y") for i in range(40)]
    out += [(100 + i, "big\n", "de", "hot", None, 1, "x", "y") for i in range(95)]
    out += [(7, "again", None, None, 3, 1, "x", "y"), (7, "again", None, None, 3, 1, "x", "y"), (None, None, None, "s1", None, 1, "x", "y"), (500, "", "", "", 0, 1, "x", "y")]
    out += [(900, "é\n" * 30000, "fr", "ß", 60000, 1, "x", "y"), (8, "tie", "en", "s0", 1, 1, "x", "y"), (9, "tie", "en", "alone", 1, 1, "x", "y")]
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def record(doc, text):
    values = [doc[0], doc[3], doc[2], doc[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, arity):
    """The root, and each leaf's list of (left, right)."""
    level, paths = [(d, [k]) for k, d in enumerate(nodes)], [[] for _ in nodes]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), arity):
            run = level[at : at + arity]
            for k, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            above.append((sha("".join(d for d, _ in run)), [m for _, ms in run for m in ms]))
        level = above
    return (level[0][0] if level else None), paths


def expected(docs, arity):
    groups = collections.defaultdict(list)
    for d in docs:
        groups[d[3]].append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        groups[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, record(d, d[1])))
        subs.append(climb([record(d, d[1]) for d in groups[s]], arity))
    root, tops = climb([r for r, _ in subs], arity)
    out = collections.Counter()
    for s, (subroot, paths), top in zip(order, subs, tops, strict=True):
        for d, path in zip(groups[s], paths, strict=True):
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[1] is not None
            found = record(d, d[1].replace("\n", "") if changed else d[1])
            for left, right in path + top:
                found = sha(left + found + right)
            out[d[0], record(d, d[1]), subroot, root, sha("".join(a + b for a, b in path + top)), found, found == root] += 1
    return out


def test_manifest_equals_plain_loops(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = merkle.digest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, got.collect())) == expected(rows(), 3)


@pytest.mark.parametrize("arity", [2, 5])
def test_other_arities(spark, arity):
    docs = spark.createDataFrame(rows()[:50], SCHEMA)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    got = merkle.check_documents(docs, F.when(even, F.regexp_replace("text", "\n", "")).otherwise(F.col("text")), arity).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert collections.Counter(map(tuple, got.collect())) == expected(rows()[:50], arity)


def test_paths_lead_to_the_root_and_only_from_true_leaves(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    leaves = docs.select("doc_id", "source", merkle.record_digest([F.col("doc_id"), F.col("text")]).alias("leaf"))
    found = merkle.manifest(leaves, "source", "doc_id", carry=["doc_id"])
    good, bad = merkle.fold(F.col("digest"), F.col("path")), merkle.fold(F.sha2(F.col("digest"), 256), F.col("path"))
    assert found.where((good != F.col("root")) | (bad == F.col("root"))).isEmpty() and found.count() == len(rows())


def test_nothing(spark):
    assert merkle.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = merkle.digest(spark.createDataFrame(rows()[1:2], SCHEMA)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")
