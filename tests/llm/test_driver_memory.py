"""What the pipeline holds on the driver."""

import tracemalloc

import numpy as np

from shelfmark import runtime
from shelfmark.llm import mixing, near_texts
from shelfmark.operators.components import connected_components


def test_a_fit_holds_the_words_that_take_part_alone():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 3, 600)
    hashed = [np.unique([*rng.integers(0, mixing.BUCKETS, 60), 7 + c]).astype(np.int32) for c in classes]
    model = mixing.Classifier(3)
    tracemalloc.start()
    model.fit(hashed, rng.random((600, 4)), classes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(np.flatnonzero(model.words.any(axis=1))) == {7, 8, 9} and most < 20e6


def test_links_join_what_is_linked_already(spark):
    edges = lambda *pairs: spark.createDataFrame(pairs, "u long, v long")
    first, second = [(1, 2), (2, 3), (8, 9), (20, 21)], [(9, 30), (3, 30), (40, 41), (41, 5)]
    one = near_texts.joined(None, edges(*first))
    assert near_texts.joined(one, edges(*first).limit(0)) is one
    two = near_texts.joined(one, edges(*second))
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, connected_components(edges(*first, *second), "u", "v").collect()))


def test_a_sweep_trims_the_driver(spark, monkeypatch):
    done, plain = [], runtime._trim
    monkeypatch.setattr(runtime, "_trim", lambda s: done.append(plain(s)))
    runtime.sweep(spark)
    assert len(done) == 1
