"""Groups of linked rows against brute force; what the steps pass on follows the rows, not the links."""

import itertools

import numpy as np
import pytest
from test_vectors import ODD, clustered, frame, unit

from shelfmark.operators import alike, similarity, vectors


def components(n, links):
    owner = list(range(n))
    for i, j in links:
        a, b = sorted((owner[i], owner[j]))
        owner = [a if o == b else o for o in owner]
    linked = {x for pair in links for x in pair}
    return {i: owner[i] for i in linked}


def passed_on(monkeypatch, module):
    """The tables that a module's steps write."""
    seen, plain = [], module.stash
    monkeypatch.setattr(module, "stash", lambda df, **kw: seen.append(plain(df, **kw)) or seen[-1])
    return seen


@pytest.mark.parametrize("least,alone,bytes_", [(0.95, 20, 1 << 20), (0.5, 15, 1 << 20), (0.99, 30, 64), (-0.3, 30, 64), (0.999, 1000, 64)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, least, alone, bytes_):
    monkeypatch.setattr(alike, "SIDE_BYTES", bytes_)
    monkeypatch.setattr(alike, "TILE", 11)
    v = clustered()
    u = unit(v)
    want = components(len(v), [(i, j) for i, j in itertools.combinations(range(len(v)), 2) if u[i] @ u[j] >= least])
    got = vectors.alike_components(frame(spark, v), least, block_rows=alone).where("node < 900").collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_a_group_passes_on_rows_and_no_pairs(spark, monkeypatch):
    seen = passed_on(monkeypatch, alike)
    v = np.ones((300, 6)) + 0.001 * np.random.default_rng(0).normal(size=(300, 6))
    got = vectors.alike_components(frame(spark, v), 0.99, block_rows=20).where("node < 900").collect()
    assert {r["component"] for r in got} == {0} and len(got) == 300
    tables = [t.count() for t in seen if t._stash_path and spark._jvm.java.io.File(t._stash_path.removeprefix("file:")).exists()]
    assert tables and max(tables) <= 310
    assert all(set(t.columns) <= {"u", "v", "k", "component"} for t in seen)


@pytest.mark.parametrize("alone,bytes_", [(2048, 1 << 20), (40, 64)])
def test_duplicates_by_hash_or_vector(spark, monkeypatch, alone, bytes_):
    monkeypatch.setattr(alike, "SIDE_BYTES", bytes_)
    monkeypatch.setattr(alike, "TILE", 13)
    monkeypatch.setattr(alike, "ALONE", alone)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(base)] + [(150, base[0][:40].tolist()), (151, base[1][:40].tolist()), (152, (base[0][:40] * 2).tolist()), (153, [0.0] * 64), (154, [0.0] * 64)]
    rows += [(155, [float(x) for x in base[2][:60]] + [None] * 4), (156, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("hash", similarity.sign_hash())
    hashes = {r["vec_id"]: r["hash"] for r in df.collect() if r["hash"] is not None}
    links = []
    for (i, x), (j, y) in itertools.combinations([r for r in rows if r[0] in hashes], 2):
        bits = bin((hashes[i] ^ hashes[j]) & (1 << 64) - 1).count("1")
        whole = len(x) == len(y) and None not in x and None not in y and any(x) and any(y)
        if bits <= 18 or bits <= 26 and whole and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.3:
            links.append((i, j))
    got = similarity.duplicate_groups(df, 18, 26, 0.3, alone=alone).collect()
    assert {r["node"]: r["component"] for r in got} == components(157, links) and len(links) > 3


@pytest.mark.parametrize("points", [1, 3, 6])
def test_density_clusters_are_those_of_all_pairs(spark, monkeypatch, points):
    monkeypatch.setattr(alike, "SIDE_BYTES", 64)
    monkeypatch.setattr(alike, "TILE", 17)
    v = clustered(160, 0.3, 5)
    u = unit(v)
    alikes = {(i, j): float(u[i] @ u[j]) for i, j in itertools.permutations(range(len(v)), 2) if u[i] @ u[j] >= 0.97}
    degree = {i: sum(a == i for a, _ in alikes) for i in range(len(v))}
    core = {i for i, n in degree.items() if n and n + 1 >= points}
    want = components(len(v), [p for p in alikes if p[0] < p[1] and core >= set(p)])
    want = {i: want.get(i, i) for i in core}
    want |= {i: want[min((-c, b) for (a, b), c in alikes.items() if a == i and b in core)[1]] for i in degree if i not in core and any(a == i and b in core for a, b in alikes)}
    got = {r["vec_id"]: r["cluster"] for r in similarity.density_clusters(frame(spark, v), 0.97, points, alone=25).collect() if r["vec_id"] < 900}
    assert got == {i: want.get(i) for i in range(len(v))} and want


def test_nothing_and_odd_vectors(spark):
    nothing = frame(spark, clustered(10)).limit(0)
    assert vectors.alike_components(nothing, 0.5).collect() == []
    assert similarity.density_clusters(nothing, 0.5, 3).collect() == []
    odd = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, score double, label long")
    assert vectors.alike_components(odd, 0.5).collect() == []


def test_a_vector_is_repeated_by_spark_and_not_in_python(spark, monkeypatch):
    from pyspark.sql import DataFrame

    schemas, plain = [], DataFrame.mapInPandas
    kinds = {type(frame(spark, clustered(10))), DataFrame}
    for kind in kinds:
        monkeypatch.setattr(kind, "mapInPandas", lambda self, run, schema, _own=getattr(kind, "mapInPandas", plain), **kw: schemas.append((self, out := _own(self, run, schema, **kw))) or out)
    v = clustered()
    dealt, _ = vectors.cells(frame(spark, v), 0.2, pivots=40)
    assert dealt.count() > 3 * (len(v) + 1)
    assert all(out.count() <= len(v) + len(ODD) for _, out in schemas) and schemas


def test_blocks_grow_with_the_table(spark, monkeypatch):
    for name, size in (("BLOCK_ROWS", 4), ("TILE", 7)):
        monkeypatch.setattr(vectors, name, size)
    met, plain = [], vectors.cells
    monkeypatch.setattr(vectors, "cells", lambda df, least, key, column, rows: met.append(rows) or plain(df, least, key, column, rows))
    v = clustered()
    u = unit(v)
    got = vectors.cosine_pairs(frame(spark, v), 0.5).where("b < 900").collect()
    assert {(r["a"], r["b"]) for r in got} == {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if u[i] @ u[j] >= 0.5} and len(got) == len(set(got))
    assert met[0] >= len(v) // 16


def test_pairs_that_appear_together_are_dealt_by_their_count(spark, monkeypatch):
    from collections import Counter

    from shelfmark.operators import predicates

    monkeypatch.setattr(predicates, "PAIRS_A_TASK", 100)
    rng = np.random.default_rng(4)
    rows = [(int(g), int(m)) for g, m in zip(rng.integers(0, 150, 900), rng.integers(0, 40, 900), strict=True)] + [(None, 1), (None, 2), (7, None), (8, None)] + [(200, m) for m in range(60)]
    groups = {}
    for g, m in rows:
        if g is not None and m is not None:
            groups.setdefault(g, set()).add(m)
    want = Counter(p for ms in groups.values() for p in itertools.combinations(sorted(ms), 2))
    got = predicates.co_appearing(spark.createDataFrame(rows, "o long, s long"), "o", "s")
    assert {(r["a"], r["b"]): r["together"] for r in got.collect()} == want
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
