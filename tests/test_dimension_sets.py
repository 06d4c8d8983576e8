"""Sets of all dimensions rank an item once for the dimensions that the same columns decide."""

import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from shelfmark.operators import collection_sets as sets


def generated(plan) -> int:
    """Rows that the generators of an executed plan put out."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if "QueryStage" in kind else [plan.children().apply(k) for k in range(plan.children().size())]
    return (plan.metrics().apply("numOutputRows").value() if kind == "GenerateExec" else 0) + sum(map(generated, below))


def test_rows_are_those_of_each_dimension_alone_and_few_are_ranked(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice([None, datetime.datetime(2020, 12, 30) + datetime.timedelta(days=rng.randrange(6), hours=i % 24)]), rng.choice(["a", "b", None]), rng.choice(["x / y", "xz", None]), rng.choice(["p", "q"]), "o", rng.choice([None, 4.5, 7.25, 9.0]), i % 5, i % 360)
        for i in range(600)
    ]
    items = spark.createDataFrame(rows, "path long, date_taken timestamp, camera string, lens string, category string, status string, aggregate double, owner long, hue long")
    found = sets.dimension_members(items, most=3)
    got = sorted(map(tuple, found.collect()))
    assert generated(found._jdf.queryExecution().executedPlan()) < 2 * 12 * len(rows)
    want = []
    for name, least in sets.DIMENSIONS.items():
        held = defaultdict(list)
        for r in items.select("path", "aggregate", sets.dimension(name).alias("value")).where(F.col("value").isNotNull()).collect():
            held[r["value"]].append((r["aggregate"] is None, -(r["aggregate"] or 0), r["path"]))
        want += [(name, value, len(h), path, k + 1) for value, h in held.items() if len(h) >= least for k, (_, _, path) in enumerate(sorted(h)[:3])]
    assert got == sorted(want)
