"""Culling reads each kind once."""

from pyspark.sql import functions as F

from shelfmark.operators import sessions


def test_each_kind_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x % 7)

    rows = spark.range(60).select(F.col("id").alias("path"), F.when(F.col("id") % 6 > 0, (F.col("id") % 6).cast("string")).alias("grp"), counted("id").alias("aggregate"))
    got = sessions.auto_cull({"a": rows, "b": rows.withColumn("grp", F.when(F.col("path") < 2, "one").otherwise(F.col("path").cast("string")))}).collect()
    assert seen.value <= 120 and {(r["path"], r["source"]) for r in got} == {(i, "a") for i in range(60) if i % 6}
