"""Pairs of dimensions are counted in few sets of many dimensions, with the rows of each pair alone."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import collection_sets as sets

DIMS = ("year", "season", "weekday", "camera", "lens", "status", "band", "hue")
PAIRS = [(x, y) for i, x in enumerate(DIMS) for y in DIMS[i + 1 :]]


def test_few_sets_hold_all_pairs():
    counts = {"date_taken": 80, "_lens": 25, "_band": 11, "_hue": 8, "_camera": 5, "_category": 5, "_status": 3}
    wanted = {frozenset((x, y)) for x in counts for y in counts}
    found = sets._crossings(counts, wanted)
    assert len(found) == 6 and set().union(*found.values()) == wanted and all(pair <= set(held) for held, own in found.items() for pair in own)
    large = {f"k{i}": 10**6 for i in range(5)}
    assert len(sets._crossings(large, {frozenset((x, y)) for x in large for y in large if x < y})) == 10


@pytest.mark.parametrize("cells", [1, 30, 10**6])
def test_rows_are_those_of_each_pair(spark, monkeypatch, cells):
    monkeypatch.setattr(sets, "BLOCK_CELLS", cells)
    rng = random.Random(4)
    rows = [
        (i, rng.choice([None, dt.datetime(2020, 11, 28) + dt.timedelta(days=rng.randrange(40), hours=i % 24)]), rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.choice(["p", "q"]), rng.choice([None, 4.5, 7.25, 7.5, float("nan"), float("inf"), -0.0]), i % 360)
        for i in range(500)
    ]
    items = spark.createDataFrame(rows, "path long, date_taken timestamp, camera string, lens string, status string, aggregate double, hue long").repartition(3)
    values = items.select("path", "aggregate", *[sets.dimension(n).alias(n) for n in DIMS]).collect()
    held = defaultdict(list)
    for r in values:
        x = r["aggregate"]
        rated = float("inf") if x is None else float("-inf") if x != x else x
        for one, two in PAIRS:
            if r[one] is not None and r[two] is not None:
                held[one, two, r[one], r[two]].append((-rated, r["path"]))
    want = {(*k, len(v), min(v)[1]) for k, v in held.items() if len(v) >= 10}
    got = [tuple(r) for r in sets.crossed_sets(items, PAIRS, 10).collect()]
    assert len(got) == len(want) and set(got) == want


def test_each_dimension_is_computed_once_for_an_item(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return str(x % 3)

    items = spark.range(90).select(F.col("id").alias("path"), counted("id").alias("camera"), F.lit("l").alias("lens"), F.lit("s").alias("status"), F.lit(1.0).alias("aggregate"))
    got = sets.crossed_sets(items, [("camera", "lens"), ("camera", "status"), ("lens", "status")], 1).collect()
    assert seen.value == 90 and len(got) == 7
