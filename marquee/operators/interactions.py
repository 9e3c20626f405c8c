"""Validation, selection and keyed updates of behaviour events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marquee.operators.ranking import positions

RATE, COLLECT, WATCH = 1, 2, 3
LIKE10 = 80


def latest_ratings(log: DataFrame) -> DataFrame:
    """Last rating per (user, item) in event order.

    A ``max`` over an ordered struct combines before the shuffle, so a hot user
    or item sends one row per map task instead of its whole history.
    """
    order = F.struct("ts", "seq_order", "seq_line", "score10")
    return (
        log.groupBy("user_id", "item_id")
        .agg(F.max(order).alias("last"))
        .select("user_id", "item_id", F.col("last.score10").alias("score10"), F.col("last.ts").alias("ts"))
    )


def validate_interactions(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (null means accepted) for each event."""
    known = items.select(F.col("item_id").alias("known_item"))
    joined = raw.join(known, raw.item_id == known.known_item, "left")
    reason = (
        F.when(F.col("behavior_type").isNull() | ~F.col("behavior_type").isin(RATE, COLLECT, WATCH), "behavior_type")
        .when(F.col("item_id").isNull() | (F.col("item_id") < 0), "item_id")
        .when(F.col("known_item").isNull(), "unknown_item")
        .when((F.col("behavior_type") == RATE) & F.col("score10").isNull(), "missing_score")
        .when((F.col("behavior_type") == RATE) & ~F.col("score10").between(0, 100), "score_range")
    )
    return joined.withColumn("reject_reason", reason).drop("known_item")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def interaction_upsert(existing: DataFrame, batch: DataFrame, *, arrival: str | None = None) -> DataFrame:
    """Merge a batch on (user, item, type).

    Ratings take the newest score and time, collect and watch keep the first
    row.  ``is_new`` marks keys the existing snapshot did not have.  Both sides
    carry ``event_id``, ``score10`` and ``ts``; existing rows precede the batch,
    and rows of the batch come in the order of the column ``arrival``, if
    given, and ``event_id``.  The pick is an aggregate of ordered structs, so it
    combines map-side.
    """
    cols = ["user_id", "item_id", "behavior_type", "score10", "ts", "event_id"]
    place = F.lit(0).cast("bigint") if arrival is None else F.col(arrival).cast("bigint")
    both = existing.select(*cols, F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("arrival")).unionByName(
        batch.select(*cols, F.lit(1).alias("side"), place.alias("arrival")))
    row = F.struct("side", "arrival", "event_id", "score10", "ts")
    return (
        both.groupBy("user_id", "item_id", "behavior_type")
        .agg(F.max(row).alias("newest"), F.min(row).alias("oldest"))
        .withColumn("kept", F.when(F.col("behavior_type") == RATE, F.col("newest")).otherwise(F.col("oldest")))
        .select(
            "user_id", "item_id", "behavior_type",
            F.col("kept.score10").alias("score10"), F.col("kept.ts").alias("ts"),
            F.col("kept.event_id").alias("event_id"), (F.col("oldest.side") == 1).alias("is_new"),
        )
    )


def rating_events(interactions: DataFrame) -> DataFrame:
    return interactions.filter((F.col("behavior_type") == RATE) & F.col("score10").isNotNull())


def positive_feedback(interactions: DataFrame) -> DataFrame:
    """Ratings of at least 7 and every collect or watch."""
    return interactions.filter(
        ((F.col("behavior_type") == RATE) & (F.col("score10") >= 70)) | F.col("behavior_type").isin(COLLECT, WATCH)
    )


def positive_sequences(interactions: DataFrame, *, min_events: int = 2) -> DataFrame:
    """Positive events of users with at least ``min_events`` of them, with their position.

    Long form (user, pos, item): a user's history is never packed into one row.
    """
    positives = positive_feedback(interactions)
    enough = positives.groupBy("user_id").count().filter(F.col("count") >= min_events).select("user_id")
    kept = positives.join(enough, "user_id", "left_semi")
    placed = positions(kept, ["user_id"], ["ts", "event_id"], F.to_date("ts"))
    return placed.select("user_id", "pos", "item_id", "behavior_type", "ts", "event_id")


def load_interactions(records: DataFrame, items: DataFrame, known_users: DataFrame,
                      existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Load title-keyed behaviour records: (new users, snapshot after the upsert).

    A title resolves to its highest item id; records with unknown titles are
    skipped, but their users are still added.
    """
    new_users = records.select("user_id").distinct().join(known_users.select("user_id"), "user_id", "left_anti")
    by_title = items.groupBy("title").agg(F.max("item_id").alias("item_id"))
    batch = records.drop("item_id").join(by_title, "title").select(
        "user_id", "item_id", "behavior_type", "score10", "ts", "event_id")
    return new_users, interaction_upsert(existing, batch)


def reward(behavior_type: Column, score10: Column) -> Column:
    """Rate maps 0..10 to -1..1; collect and watch have fixed rewards."""
    return (
        F.when((behavior_type == RATE) & score10.isNotNull(), F.round((score10 / 10 - 5) / 5, 4))
        .when(behavior_type == COLLECT, F.lit(0.35))
        .when(behavior_type == WATCH, F.lit(0.15))
        .otherwise(F.lit(0.0))
    )


def dedupe_last(records: DataFrame, keys: Sequence[str], *, seq: str) -> DataFrame:
    """Last row per key in ``seq`` order; rows whose key fields are all empty are dropped."""
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    some_key = filled[0] != ""
    for k in filled[1:]:
        some_key = some_key | (k != "")
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = records.filter(some_key).select("*", *[c.alias(n) for c, n in zip(filled, names)])
    others = [c for c in records.columns if c != seq]
    return (
        keyed.groupBy(*names)
        .agg(F.max(F.struct(seq, *others)).alias("last"))
        .select(*[F.col(f"last.`{c}`").alias(c) for c in records.columns])
    )


def merge_keyed(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *, seq: str) -> DataFrame:
    """Union of two record sets, the incoming row wins per key."""
    side = "_side"
    both = existing.withColumn(side, F.lit(0)).unionByName(
        incoming.withColumn(side, F.lit(1)), allowMissingColumns=True
    )
    ordered = both.withColumn("_seq", F.struct(side, seq)).drop(side)
    return dedupe_last(ordered, keys, seq="_seq").drop("_seq")


def mark_processed(experiences: DataFrame, ids: DataFrame, *, version: str) -> DataFrame:
    """New snapshot with the listed experiences processed by ``version``."""
    done = ids.select("id").distinct().withColumn("_done", F.lit(True))
    return (
        experiences.join(done, "id", "left")
        .withColumn("status", F.when(F.col("_done"), F.lit("processed")).otherwise(F.col("status")))
        .withColumn("model_version", F.when(F.col("_done"), F.lit(version)).otherwise(F.col("model_version")))
        .drop("_done")
    )


def orphan_filter(rows: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Keep rows whose user and item both exist: two semi joins, no null-aware NOT IN."""
    return rows.join(users.select("user_id"), "user_id", "left_semi").join(
        items.select("item_id"), "item_id", "left_semi"
    )


def liked10_popularity(ratings: DataFrame, *, like10: int = LIKE10) -> DataFrame:
    """Sum of liked scores (in tenths) per item."""
    return ratings.filter(F.col("score10") >= like10).groupBy("item_id").agg(F.sum("score10").alias("likes10"))
