"""Item and user feature vectors (354 slots) in sparse form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.text import FEATURE_STOP_WORDS, KEYWORD_TAGS, feature_tokens, keyword_tags, split_list
from marquee.functions.vectors import entry, fixed_counts, half_life_decay, hashed_shares, let, scaled
from marquee.operators.interactions import COLLECT, RATE, WATCH

# Genre vocabulary of the first feature block.
GENRES = ("action", "comedy", "drama", "sci-fi", "horror", "romance", "adventure", "crime", "animation", "documentary",
          "fantasy", "mystery", "thriller", "family", "history")
TAGS = tuple(KEYWORD_TAGS.values())

# Sizes of the hashed blocks.
DIRECTOR_SLOTS, COUNTRY_SLOTS, SUMMARY_SLOTS = 128, 64, 128
DIRECTOR_AT = len(GENRES)
COUNTRY_AT = DIRECTOR_AT + DIRECTOR_SLOTS
SUMMARY_AT = COUNTRY_AT + COUNTRY_SLOTS
TAG_AT = SUMMARY_AT + SUMMARY_SLOTS
NUMERIC_AT = TAG_AT + len(TAGS)
SLOTS = NUMERIC_AT + 4


def item_features(items: DataFrame, *, genres: Sequence[str] = GENRES, tags: Mapping[str, str] = KEYWORD_TAGS,
                  stop_words: Sequence[str] = FEATURE_STOP_WORDS) -> DataFrame:
    """Feature entries per item: (item_id, features array<struct<slot, value>>), zero values left out.

    Row-wise expressions only, so the catalogue is never shuffled.
    """
    vocabulary = tuple(tags.values())
    blocks = F.concat(
        fixed_counts(split_list(F.col("types")), genres, 0),
        hashed_shares(split_list(F.col("directors")), DIRECTOR_SLOTS, "director", DIRECTOR_AT),
        hashed_shares(split_list(F.col("country")), COUNTRY_SLOTS, "country", COUNTRY_AT),
        hashed_shares(feature_tokens(F.col("summary"), stop_words=stop_words), SUMMARY_SLOTS, "summary", SUMMARY_AT),
        fixed_counts(keyword_tags(F.col("summary"), tags), vocabulary, TAG_AT),
        F.array(
            entry(F.lit(NUMERIC_AT), scaled(F.col("rate"), 0, 10)),
            entry(F.lit(NUMERIC_AT + 1), scaled(F.col("comment_len"), 0, 5000)),
            entry(F.lit(NUMERIC_AT + 2), scaled(F.col("release_year"), 1900, 2026)),
            entry(F.lit(NUMERIC_AT + 3), scaled(F.col("duration"), 20, 300)),
        ),
    )
    return items.select("item_id", F.filter(blocks, lambda e: e["value"] != 0).alias("features"))


def long_form(features: DataFrame, id_col: str = "item_id") -> DataFrame:
    """One row per entry; rows without any are left out.

    By the outer form: from the inner one Spark infers a filter on the array's size, and so computes every
    array three times.
    """
    return features.select(id_col, F.inline_outer("features")).filter(F.col("slot").isNotNull())


def to_dense(features: Column, size: int = SLOTS) -> Column:
    """Sparse entries (distinct slots) as a dense array."""
    return let(F.map_from_entries(features), lambda table: F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(table, i), F.lit(0.0))))


def user_stats(interactions: DataFrame) -> DataFrame:
    """Mean rating and behaviour counts per user, each scaled to [0, 1]."""
    kind = F.col("behavior_type")
    counts = interactions.groupBy("user_id").agg(
        F.count_if(kind == RATE).alias("n_rate"), F.count_if(kind == COLLECT).alias("n_collect"),
        F.count_if(kind == WATCH).alias("n_watch"),
        F.coalesce(F.sum(F.when(kind == RATE, F.col("score10"))), F.lit(0)).alias("s"),
    )
    return counts.select(
        "user_id", "n_rate", "n_collect", "n_watch",
        scaled(F.col("s") / (10 * F.greatest("n_rate", F.lit(1))), 0, 10).alias("avg_score"),
        scaled(F.col("n_rate"), 0, 200).alias("rate_share"), scaled(F.col("n_collect"), 0, 200).alias("collect_share"),
        scaled(F.col("n_watch"), 0, 500).alias("watch_share"),
    )


def preference_base() -> Column:
    """Signed weight of one behaviour before it fades."""
    return (
        F.when(F.col("behavior_type") == RATE,
               F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.coalesce("score10", F.lit(0)) / 10 - 5) / 5)))
        .when(F.col("behavior_type") == COLLECT, F.lit(0.8)).otherwise(F.lit(0.4))
    )


def preference_weight(as_of: Column, decay: str) -> Column:
    """Signed weight of one behaviour; ``decay`` is 'half_life' or 'constant' (0.5)."""
    return preference_base() * (half_life_decay(F.col("ts"), as_of) if decay == "half_life" else F.lit(0.5))


def user_features(interactions: DataFrame, features: DataFrame, *, as_of: str, decay: str = "half_life",
                  separate: bool = False) -> DataFrame:
    """Entries of the user vectors: (user_id, slot, value).

    Preference slots are the weighted mean of the item features (``separate``
    takes the mean of the liked part minus that of the disliked part); the
    last four slots hold the user statistics.  Behaviours are first summed per
    (user, item), so item features are joined once per pair.
    """
    w = F.col("w")
    pairs = (
        interactions.withColumn("w", preference_weight(F.lit(as_of), decay)).groupBy("user_id", "item_id")
        .agg(F.sum(F.when(w > 0, w).otherwise(0.0)).alias("up"), F.sum(F.when(w < 0, -w).otherwise(0.0)).alias("down"))
    )
    # the divisors need the pairs only, not their features
    totals = pairs.join(features.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(
        F.sum("up").alias("up_total"), F.sum("down").alias("down_total"))
    sums = _entries_of(pairs, features, "up", "down").filter(F.col("slot") < NUMERIC_AT).groupBy("user_id", "slot").agg(F.sum(F.col("up") * F.col("value")).alias("plus"),
                               F.sum(F.col("down") * F.col("value")).alias("minus"))
    tiny = F.lit(1e-6)
    if separate:
        value = F.col("plus") / F.greatest("up_total", tiny) - F.col("minus") / F.greatest("down_total", tiny)
    else:
        value = (F.col("plus") - F.col("minus")) / F.greatest(F.col("up_total") + F.col("down_total"), tiny)
    preference = sums.join(totals, "user_id").select("user_id", "slot", value.alias("value"))
    stats = user_stats(interactions).select("user_id", F.inline(F.array(
        entry(F.lit(NUMERIC_AT), F.col("avg_score")), entry(F.lit(NUMERIC_AT + 1), F.col("rate_share")),
        entry(F.lit(NUMERIC_AT + 2), F.col("collect_share")), entry(F.lit(NUMERIC_AT + 3), F.col("watch_share")))))
    return preference.unionByName(stats)


def pack_entries(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, slot, value) to one row of entries per id; at most one entry per slot."""
    return rows.groupBy(id_col).agg(F.collect_list(F.struct("slot", "value")).alias("features"))


def _entries_of(pairs: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """The feature entries of each pair (user_id, item_id, columns): user_id, columns, slot, value.

    Entries travel to their user as two plain arrays a pair and are opened where all rows of the user
    lie, so sums by user and slot need no further shuffle.
    """
    arrays = features.select("item_id", F.col("features.slot").alias("slot"), F.col("features.value").alias("value"))
    together = pairs.join(arrays, "item_id").select("user_id", *columns, "slot", "value").repartition("user_id")
    return together.select("user_id", *columns, F.inline(F.arrays_zip("slot", "value")))


def rating_profiles(ratings: DataFrame, features: DataFrame) -> DataFrame:
    """Mean item features of a user's rated items, weighted by max(score / 10, 0.1): (user_id, slot, value)."""
    weighted = ratings.select("user_id", "item_id", F.greatest(F.col("score10") / 100, F.lit(0.1)).alias("w"))
    totals = weighted.join(features.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(F.sum("w").alias("total"))
    sums = _entries_of(weighted, features, "w").groupBy("user_id", "slot").agg(F.sum(F.col("w") * F.col("value")).alias("s"))
    return sums.join(totals, "user_id").select("user_id", "slot", (F.col("s") / F.col("total")).alias("value"))
