"""Ranking and merging of scored lists.

The common row is (user_id, item_id, score); ranks start at 1 and ties go to
the lower item id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.operators.tiles import micro


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, n: int,
                  rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  The literal limit lets Spark cut each group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def rank_scores(scores: DataFrame, *, n: int, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    return top_per_group(scores, keys, [micro(F.col("score")).desc(), F.col("item_id")], n=n)


def weighted_merge(parts: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Sum of weight times score over the score tables; a missing score counts as 0."""
    rows = None
    for name, scores in parts.items():
        part = scores.select("user_id", "item_id", (F.col("score") * F.lit(weights[name])).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("user_id", "item_id").agg(F.sum("score").alias("score"))


def minmax_blend(parts: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum of per-user scores scaled to [0, 1]; a constant list contributes 0.

    Scaling works on whole millionths, so that rounding noise in an otherwise
    constant list is not blown up to the full range.
    """
    scaled = {}
    for name, raw in parts.items():
        scores = raw.select("user_id", "item_id", micro(F.col("score")).alias("score"))
        bounds = scores.groupBy("user_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        span = F.col("hi") - F.col("lo")
        scaled[name] = scores.join(bounds, "user_id").select(
            "user_id", "item_id",
            F.when(span > 0, (F.col("score") - F.col("lo")) / span).otherwise(F.lit(0.0)).alias("score"),
        )
    return weighted_merge(scaled, weights)


def priority_merge(lists: Sequence[tuple[str, DataFrame]], *, n: int) -> DataFrame:
    """Ordered lists (user, item, rank) joined head to tail, first occurrence kept, cut at ``n``.

    Each list is already short (a top list), so a user's rows fit one window.
    """
    rows = None
    for priority, (source, ranked) in enumerate(lists):
        part = ranked.select("user_id", "item_id", F.col("rank").cast("int").alias("rank"),
                             F.lit(priority).alias("priority"), F.lit(source).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("user_id", "item_id").agg(F.min(F.struct("priority", "rank", "source")).alias("at"))
    placed = first.select("user_id", "item_id", "at.priority", F.col("at.rank").alias("old"), "at.source")
    return top_per_group(placed, ["user_id"], ["priority", "old", "item_id"], n=n).drop("priority", "old")


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
              *, name: str = "pos") -> DataFrame:
    """Zero-based position of each row within its key, without sorting a whole key in one task.

    ``bucket`` is any expression that grows with ``order``; rows are numbered
    inside (key, bucket) and shifted by the sizes of the earlier buckets, so
    one key (or, with no keys, the whole table) is spread over many tasks.
    """
    marked = rows.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = marked.withColumn("_rn", F.row_number().over(inside))
    return numbered.join(offsets, [*keys, "_bucket"]).withColumn(
        name, (F.col("_before") + F.col("_rn") - 1).cast("bigint")
    ).drop("_bucket", "_before", "_rn")
