"""Adapters from the given star-schema tables to the recommendation data model.

The model has items, users, ratings, interactions and comments.  Each adapter
is lazy and selects only what its caller asks for, so column pruning and
filters reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LIST_SEPARATOR = "/"


class Tables:
    """Reads one folder of Parquet tables and derives the model from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def items(self, *, summary: bool = False, comment_len: bool = False) -> DataFrame:
        """Catalogue rows; the two wide or derived columns are joined only on request."""
        part, nation = self.raw("part"), self.raw("nation")
        items = (
            part.join(nation, F.col("n_nationkey") == F.col("p_size") % 25, "left")
            .select(
                F.col("p_partkey").alias("item_id"),
                F.col("p_name").alias("title"),
                F.concat_ws("/", F.col("p_type"), F.split("p_name", " ")[1]).alias("types"),
                F.col("p_brand").alias("directors"),
                F.col("n_name").alias("country"),
                F.replace(F.col("p_name"), F.lit(" "), F.lit("/")).alias("casts"),
                F.round((F.col("p_retailprice") - 900) / 10, 2).alias("rate"),
                (F.lit(1950) + F.col("p_size")).alias("release_year"),
                (F.lit(60) + 2 * F.col("p_size")).alias("duration"),
            )
        )
        if summary:
            docs = self.raw("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("summary"))
            items = items.join(docs, "item_id", "left")
        if comment_len:
            counts = (
                self.comments().groupBy("item_id").agg(F.count(F.lit(1)).alias("comment_len"))
            )
            items = items.join(counts, "item_id", "left").withColumn(
                "comment_len", F.coalesce("comment_len", F.lit(0).cast("bigint"))
            )
        return items

    def users(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))

    def rating_log(self) -> DataFrame:
        """Every rating event: ``score10`` is ten times the score, kept as an integer so sums are exact."""
        line = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            (F.col("l_quantity").cast("bigint") * 2).alias("score10"),
            F.col("o_orderdate").alias("ts"),
            F.col("l_orderkey").alias("seq_order"),
            F.col("l_linenumber").alias("seq_line"),
        )

    def ratings(self) -> DataFrame:
        """Latest rating per (user, item)."""
        from marquee.operators.interactions import latest_ratings

        return latest_ratings(self.rating_log())

    def interactions(self) -> DataFrame:
        """Behaviour events before validation; ``behavior_type`` is null for foreign event kinds."""
        events = self.raw("events")
        kind = (
            F.when(F.col("event_type") == "purchase", 1)
            .when(F.col("event_type") == "click", 2)
            .when(F.col("event_type") == "view", 3)
        )
        return events.select(
            F.col("event_id"),
            F.col("user_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
            kind.cast("int").alias("behavior_type"),
            F.when(
                F.col("event_type") == "purchase",
                F.least(F.lit(100).cast("bigint"), F.floor("value").cast("bigint")),
            ).alias("score10"),
            F.col("ts"),
        )

    def comments(self) -> DataFrame:
        conv = self.raw("conversations").filter(F.col("role") == "user")
        return conv.select(
            F.col("conv_id").alias("item_id"),
            F.col("turn"),
            F.when(F.col("conv_id") % 3 != 0, F.col("conv_id") * 17 + F.col("turn")).alias("user_id"),
            F.col("text").alias("content"),
        )
