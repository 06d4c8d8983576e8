"""Candidates of a weight fit are ranked in ranges of whole arrays, with the same correlations however rows are dealt."""

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.operators import scoring

NAMES = ("p", "q", "r")


def ranks(values):
    values = np.array(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def table(spark, n=400):
    rng = np.random.default_rng(12)
    x = rng.random((n, 3))
    x[: n // 3] = 0.5  # a third of all sums are equal
    y = np.round(x[:, 0] + rng.random(n), 1)
    ranked = scoring.ranked_target(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "p double, q double, r double, y double").repartition(3), "y", NAMES)
    tried = scoring.candidates_near(np.full(3, 1 / 3), 1.0, 8, rng)
    return ranked, tried, [np.corrcoef(ranks(np.floor(x @ w * 1e9 + 0.5)), ranks(y))[0, 1] for w in tried]


def shuffled_records(spark) -> int:
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_ranking_passes_on_arrays_and_not_rows(spark):
    ranked, tried, want = table(spark)
    before = shuffled_records(spark)
    assert scoring.rank_correlations(ranked, NAMES, tried) == pytest.approx(want, abs=1e-12)
    assert shuffled_records(spark) - before < 400


@pytest.mark.parametrize("rows", [1, 7, 130])
def test_ranges_of_any_size_give_the_same_correlations(spark, rows):
    ranked, tried, want = table(spark)
    assert scoring.rank_correlations(ranked, NAMES, tried, ranked_rows=rows) == pytest.approx(want, abs=1e-12)


def test_nothing_and_flat_sums_have_no_correlation(spark):
    ranked, tried, _ = table(spark)
    assert scoring.rank_correlations(ranked.limit(0), NAMES, tried) == [-2.0] * len(tried)
    assert scoring.rank_correlations(ranked, NAMES, np.zeros((1, 3))) == [-2.0]


def test_small_batches_are_counted_together():
    batches = [pa.RecordBatch.from_pydict({"a": [float(i)], "b": [2.0 * i]}) for i in range(50)]
    blocks = list(scoring._blocks(iter(batches), ["a", "b"]))
    assert len(blocks) == 1 and blocks[0][1].tolist() == [2.0 * i for i in range(50)]


@pytest.mark.parametrize("scale", [1e4, 1e8])
def test_sums_far_apart_are_ranked_too(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.random((90, 3)) * scale
    y = np.round(x[:, 0] / scale + rng.random(90), 1)
    ranked = scoring.ranked_target(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "p double, q double, r double, y double"), "y", NAMES)
    tried = scoring.candidates_near(np.full(3, 1 / 3), 1.0, 3, rng)
    want = [np.corrcoef(ranks(x @ w), ranks(y))[0, 1] for w in tried]
    for rows in (1 << 19, 11):
        assert scoring.rank_correlations(ranked, NAMES, tried, ranked_rows=rows) == pytest.approx(want, abs=1e-12)
