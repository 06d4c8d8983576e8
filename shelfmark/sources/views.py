"""Catalogue views over the given tables: items with metrics, tags, shots, vectors, places, votes, folders."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

METRICS = ("aesthetic", "tech_sharpness", "comp_score", "exposure")

#: The same views in SQL, for checks.
VIEW_SQL = {
    "item": """SELECT o_orderkey AS path, o_custkey AS owner, o_orderdate AS date_taken, o_orderpriority AS category, c_mktsegment AS camera,
      n_name AS lens, o_orderstatus AS status, round(least(10, o_totalprice / 50000), 6) AS aggregate
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "metric": """SELECT l_orderkey AS path, round(least(10, avg(l_quantity) / 5), 6) AS aesthetic, round(least(10, avg(l_discount) * 100), 6) AS tech_sharpness,
      round(least(10, avg(l_tax) * 125), 6) AS comp_score, round(least(10, avg(l_extendedprice) / 10500), 6) AS exposure, count(*)::BIGINT AS n_parts
      FROM lineitem GROUP BY l_orderkey""",
    "scored": "SELECT * FROM item JOIN metric USING (path)",
    "part_tag": "SELECT p_partkey AS path, unnest(string_split(p_name, ' ')) AS tag FROM part",
    "item_tag": "SELECT DISTINCT l_orderkey AS path, tag FROM lineitem JOIN part_tag ON part_tag.path = l_partkey",
    "shot": """SELECT event_id AS path, ts AS captured_at, user_id AS camera, event_type AS kind, round(value / 50, 6) AS aggregate,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS ev FROM events""",
    "vec": "SELECT vec_id, embedding, label FROM embeddings",
    "geo": """SELECT c_custkey AS path, n_nationkey * 7 - 84 + CAST(c_custkey % 10 AS DOUBLE) / 10 AS lat,
      n_regionkey * 60 - 120 + CAST(c_custkey % 7 AS DOUBLE) / 10 AS lon, c_acctbal AS score, c_mktsegment AS camera FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "pref": """SELECT a.event_id AS a_path, b.event_id AS b_path, CASE WHEN a.value > b.value THEN 'a' WHEN a.value < b.value THEN 'b' ELSE 'tie' END AS winner,
      a.event_type AS category, CASE a.user_id % 3 WHEN 0 THEN 'vote' WHEN 1 THEN 'culling' ELSE 'rating' END AS source, a.ts AS voted_at, a.user_id AS user_id
      FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0""",
    "overlay": """SELECT event_id AS path, user_id, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value / 100) AS INTEGER) END AS star_rating,
      CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_favorite, CASE WHEN value < 2 THEN 1 ELSE 0 END AS is_rejected FROM events WHERE event_id % 3 <> 0""",
    "label": "SELECT l.doc_id, quality, toxic, n_chars, lang, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
    "folder": "SELECT page_id AS path, regexp_replace(url, '^[a-z]+://', '') AS place, CAST(length(html) AS DOUBLE) AS aggregate FROM pages",
    "tagged": "SELECT path, tag, aggregate, category FROM item_tag JOIN item USING (path)",
}


class Views:
    """The catalogue views of one data folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def item(self) -> DataFrame:
        owners = self.table("customer").join(self.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        return self.table("orders").join(owners, F.col("c_custkey") == F.col("o_custkey")).select(
            F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("date_taken"), F.col("o_orderpriority").alias("category"),
            F.col("c_mktsegment").alias("camera"), F.col("n_name").alias("lens"), F.col("o_orderstatus").alias("status"),
            F.round(F.least(F.lit(10.0), F.col("o_totalprice") / 50000), 6).alias("aggregate"),
        )

    @cached_property
    def metric(self) -> DataFrame:
        top = lambda c: F.round(F.least(F.lit(10.0), c), 6)
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(
            top(F.avg("l_quantity") / 5).alias("aesthetic"), top(F.avg("l_discount") * 100).alias("tech_sharpness"), top(F.avg("l_tax") * 125).alias("comp_score"),
            top(F.avg("l_extendedprice") / 10500).alias("exposure"), F.count("*").alias("n_parts"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.item.join(self.metric, "path")

    @cached_property
    def part_tag(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("path"), F.explode(F.split("p_name", " ")).alias("tag"))

    @cached_property
    def item_tag(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        return lines.join(self.part_tag.withColumnRenamed("path", "l_partkey"), "l_partkey").select(F.col("l_orderkey").alias("path"), "tag").distinct()

    @cached_property
    def tagged(self) -> DataFrame:
        return self.item_tag.join(self.item, "path").select("path", "tag", "aggregate", "category")

    @cached_property
    def shot(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("path"), F.col("ts").alias("captured_at"), F.col("user_id").alias("camera"), F.col("event_type").alias("kind"),
            F.round(F.col("value") / 50, 6).alias("aggregate"), F.from_json("props", "k int")["k"].alias("ev"),
        )

    @cached_property
    def vec(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", "label")

    @cached_property
    def geo(self) -> DataFrame:
        return self.table("customer").join(self.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
            F.col("c_custkey").alias("path"),
            (F.col("n_nationkey") * 7 - 84 + (F.col("c_custkey") % 10).cast("double") / 10).alias("lat"),
            (F.col("n_regionkey") * 60 - 120 + (F.col("c_custkey") % 7).cast("double") / 10).alias("lon"),
            F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("camera"),
        )

    @cached_property
    def pref(self) -> DataFrame:
        a, b = self.table("events").where("event_id % 2 = 0").alias("a"), self.table("events").alias("b")
        better = F.when(F.col("a.value") > F.col("b.value"), "a").when(F.col("a.value") < F.col("b.value"), "b").otherwise("tie")
        source = F.when(F.col("a.user_id") % 3 == 0, "vote").when(F.col("a.user_id") % 3 == 1, "culling").otherwise("rating")
        return a.join(b, F.col("b.event_id") == F.col("a.event_id") + 1).select(
            F.col("a.event_id").alias("a_path"), F.col("b.event_id").alias("b_path"), better.alias("winner"), F.col("a.event_type").alias("category"),
            source.alias("source"), F.col("a.ts").alias("voted_at"), F.col("a.user_id").alias("user_id"),
        )

    @cached_property
    def overlay(self) -> DataFrame:
        return self.table("events").where("event_id % 3 <> 0").select(
            F.col("event_id").alias("path"), "user_id", F.when(F.col("event_id") % 4 == 0, F.floor(F.col("value") / 100).cast("int")).alias("star_rating"),
            F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("is_favorite"), F.when(F.col("value") < 2, 1).otherwise(0).alias("is_rejected"),
        )

    @cached_property
    def label(self) -> DataFrame:
        return self.table("labels").join(self.table("documents"), "doc_id").select("doc_id", "quality", "toxic", "n_chars", "lang", "source")

    @cached_property
    def folder(self) -> DataFrame:
        return self.table("pages").select(F.col("page_id").alias("path"), F.regexp_replace("url", "^[a-z]+://", "").alias("place"), F.length("html").cast("double").alias("aggregate"))
