"""A diagnosis computes its input once."""

from pyspark.sql import functions as F

from shelfmark.operators.diagnostics import diagnose


def test_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x % 7)

    rows = spark.range(200).select(counted("id").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 9).cast("double").alias("aggregate"), F.lit("c").alias("category"))
    found = diagnose(rows, {"a": 0.5, "b": 0.5}, base="a", low_weight=0.1).collect()
    assert seen.value == 200
    assert {(r["issue"], r["metric"]) for r in found} >= {("missing_data", "b"), ("low_correlation_high_weight", "a"), ("low_correlation_high_weight", "b")}
