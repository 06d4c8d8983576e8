"""Tables in hash buckets of their key: a batch reads and replaces the buckets that it touches, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfmark.runtime import forget, stash

BUCKETS = 256


class KeyedTable:
    """A Parquet table with a folder for each bucket of ``key``.

    ``insert_new`` adds rows with unseen keys, ``upsert`` replaces the given columns of known keys. Both may run again after a crash, or with a batch that was applied before: keys
    that are there are not added twice, and an upsert of the same values changes nothing. So a stream's batch needs no other record of what it did. Rows with a null key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "path", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _exists(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, whose folders alone are read."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def touched(self, batch: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in self._bucketed(batch.select(self.key)).select("bucket").distinct().collect())

    def _last(self, batch: DataFrame, order: str | None) -> DataFrame:
        """One row a key: the one of the largest ``order``, then of the largest values."""
        rest = [c for c in batch.columns if c != self.key]
        by = F.struct(*([order] if order else []), *rest)
        return batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(self.key, "_r.*").select(*batch.columns)

    def insert_new(self, batch: DataFrame, order: str | None = None) -> int:
        """Adds the rows whose keys are unknown; returns how many."""
        rows = stash(self._last(batch.select(*self.schema.names), order))
        known = self.read(self.touched(rows)).select(self.key)
        fresh = stash(rows.join(known, self.key, "left_anti").select(*self.schema.names))
        count = fresh.count()
        if count:
            self._bucketed(fresh).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        forget(rows)
        forget(fresh)
        return count

    def upsert(self, batch: DataFrame, columns: list[str] | None = None, order: str | None = None) -> list[int]:
        """Takes over ``columns`` where the batch has values and adds unknown keys; returns the buckets that were replaced."""
        columns = [c for c in (columns or self.schema.names) if c != self.key]
        rows = stash(self._last(batch, order))
        buckets = self.touched(rows)
        new = rows.select(F.col(self.key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
        old = self.read(buckets)
        value = lambda c: F.coalesce(self.key, "_key").alias(c) if c == self.key else (F.coalesce(f"_new_{c}", c) if c in columns else F.col(c)).alias(c)
        merged = stash(old.join(new, F.col(self.key) == F.col("_key"), "full").select(*[value(c) for c in self.schema.names]))
        if buckets:
            self._bucketed(merged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        forget(rows)
        forget(merged)
        return buckets
