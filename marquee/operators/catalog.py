"""Catalogue projections, search, joins and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.functions.text import split_list, split_multi

ANONYMOUS = "匿名用户"
HOT_REASON = "热门高分电影"
LIST_COLUMNS = ("types", "directors", "country", "casts")


def item_normalize(items: DataFrame) -> DataFrame:
    """The four list columns as arrays, plus the alias columns pages use."""
    lists = [split_list(F.col(c)).alias(f"{c}_list") for c in LIST_COLUMNS]
    aliases = [
        F.col("rate").alias("rating"),
        (F.col("cover_url") if "cover_url" in items.columns else F.lit(None).cast("string")).alias("poster_url"),
        F.col("release_year").alias("release_date"),
        split_list(F.col("types")).alias("genres"),
        (F.col("summary") if "summary" in items.columns else F.lit(None).cast("string")).alias("description"),
    ]
    return items.select("*", *lists, *aliases)


def item_lookup(items: DataFrame, *, item_id: int) -> DataFrame:
    return items.filter(F.col("item_id") == item_id)


def search(items: DataFrame, *, keyword: str) -> DataFrame:
    """Case-folded literal match in title, types, directors or country, best rated first."""
    hit = F.lit(False)
    for column in ("title", "types", "directors", "country"):
        hit = hit | F.contains(F.lower(column), F.lit(keyword.lower()))
    return items.filter(hit).orderBy(F.col("rate").desc(), F.col("comment_len").desc(), "item_id")


def catalog_order() -> list[Column]:
    return [F.col("rate").desc(), F.col("comment_len").desc(), F.col("title"), F.col("item_id")]


def top_items(items: DataFrame, *, n: int = 25) -> DataFrame:
    return items.orderBy(*catalog_order()).limit(n)


def hot_items(items: DataFrame, *, n: int = 10) -> DataFrame:
    """Hot list with its rank: the limit runs before the ranking, so the ranked set is ``n`` rows."""
    top = top_items(items, n=n)
    return top.select(
        "item_id", "title", "rate",
        F.row_number().over(Window.orderBy(*catalog_order())).alias("rank"), F.lit(HOT_REASON).alias("reason"),
    )


def full_catalog(items: DataFrame) -> DataFrame:
    return items.orderBy(F.col("rate").desc(), F.col("comment_len").desc(), "item_id")


def catalog_table(items: DataFrame) -> DataFrame:
    return items.select("item_id", "title", F.col("rate").alias("rating"), "release_year",
                        F.col("types").alias("genres"), "directors", "country", "duration")


def item_comments(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Comments with a display name: the user's name, else its id, else anonymous."""
    named = comments.join(users, "user_id", "left")
    return named.select(
        "item_id", "turn", F.coalesce("name", F.col("user_id").cast("string"), F.lit(ANONYMOUS)).alias("username"),
        "content",
    )


def user_timeline(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Each behaviour with its item title; unknown items keep a null title."""
    return interactions.join(items.select("item_id", "title"), "item_id", "left").select(
        "user_id", "event_id", "item_id", "title", "behavior_type", "score10", "ts"
    )


def user_history(interactions: DataFrame, items: DataFrame) -> DataFrame:
    return interactions.select("user_id", "event_id", "item_id", "behavior_type", "score10", "ts").join(items, "item_id")


def comment_counts(items: DataFrame, comments: DataFrame) -> DataFrame:
    counts = comments.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").join(counts, "item_id", "left").select(
        "item_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("comment_len")
    )


def decorate_scores(scores: DataFrame, items: DataFrame, *, reason: str) -> DataFrame:
    """Attach title and rating to scored items and a reason text with the score; unknown items are dropped."""
    return scores.join(items.select("item_id", "title", "rate"), "item_id").select(
        "user_id", "item_id", "title", "rate", F.round("score", 4).alias("score"),
        F.format_string(f"{reason}（得分 %.3f）", F.col("score")).alias("reason"),
    )


def overview_counts(users: DataFrame, items: DataFrame, interactions: DataFrame, comments: DataFrame,
                    experiences: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of table sizes; each count is its own one-row aggregate."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    parts = [
        count(users, "users"), count(items, "items"), count(interactions, "interactions"),
        count(comments, "comments"), count(experiences.filter(F.col("status") == "pending"), "pending"),
        count(versions, "versions"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    names = ["users", "items", "interactions", "comments", "pending", "versions"]
    return rows.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(f"n_{n}") for n in names])


def behavior_summary(interactions: DataFrame) -> DataFrame:
    return interactions.agg(
        F.count(F.lit(1)).alias("n_behaviors"),
        F.count_if((F.col("behavior_type") == 1) & F.col("score10").isNotNull()).alias("n_ratings"),
    )


def density(users: DataFrame, items: DataFrame, interactions: DataFrame) -> DataFrame:
    sizes = users.agg(F.count(F.lit(1)).alias("n_users")).select("n_users", F.lit(0).alias("one"))
    counts = items.agg(F.count(F.lit(1)).alias("n_items")).select("n_items", F.lit(0).alias("one"))
    ratings = behavior_summary(interactions).select("n_ratings", F.lit(0).alias("one"))
    return sizes.join(counts, "one").join(ratings, "one").select(
        "n_users", "n_items", "n_ratings",
        F.round(F.col("n_ratings") / F.greatest(F.col("n_users") * F.col("n_items"), F.lit(1)), 4).alias("density"),
    )


def exposure(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("exposure"))


def coverage_bonus(items: DataFrame, exposures: DataFrame) -> DataFrame:
    """1 - exposure / largest exposure; 1 when nothing has been exposed."""
    largest = exposures.agg(F.coalesce(F.max("exposure"), F.lit(0)).alias("largest")).select(
        F.greatest("largest", F.lit(1)).alias("largest"), F.lit(0).alias("one"))
    seen = items.select("item_id").join(exposures, "item_id", "left").withColumn("one", F.lit(0))
    return seen.join(F.broadcast(largest), "one").select(
        "item_id", F.coalesce("exposure", F.lit(0)).cast("bigint").alias("exposure"),
        F.round(1 - F.coalesce("exposure", F.lit(0)) / F.col("largest"), 4).alias("coverage_bonus"),
    )


def behavior_snapshot(interactions: DataFrame) -> DataFrame:
    kind = F.col("behavior_type")
    return interactions.groupBy("user_id", "item_id").agg(
        F.bool_or(kind == 1).alias("rated"), F.max(F.when(kind == 1, F.col("score10"))).alias("score10"),
        F.bool_or(kind == 2).alias("collected"), F.bool_or(kind == 3).alias("watched"),
    )


def average_ratings(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean score per item, 0 for items nobody rated.  Sums are integers, so the mean is exact."""
    sums = ratings.groupBy("item_id").agg(F.sum("score10").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = F.col("s") / (10 * F.col("n"))
    return items.select("item_id", "title").join(sums, "item_id", "left").select(
        "item_id", "title", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_ratings"),
        F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("avg_score"),
    )


def top_rated(items: DataFrame, ratings: DataFrame, *, n: int = 10) -> DataFrame:
    return average_ratings(items, ratings).orderBy(F.col("avg_score").desc(), "item_id").limit(n)


def type_distribution(items: DataFrame) -> DataFrame:
    return items.select(F.explode(split_list(F.col("types"))).alias("type")).groupBy("type").agg(
        F.count(F.lit(1)).alias("n_items"))


def period_stats(items: DataFrame) -> DataFrame:
    """Items and mean rating per decade; rates are two-decimal, so they are summed in cents."""
    decade = (F.floor(F.col("release_year") / 10) * 10).cast("int")
    return items.groupBy(decade.alias("decade")).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.round(F.sum(F.round(F.col("rate") * 100).cast("bigint")) / (100 * F.count(F.lit(1))), 4).alias("avg_rate"),
    )


def rating_table(items: DataFrame, ratings: DataFrame, comments: DataFrame) -> DataFrame:
    """Title, mean user rating and number of comments."""
    return average_ratings(items, ratings).join(comment_counts(items, comments), "item_id")


def actor_items(items: DataFrame) -> DataFrame:
    """Cast list entries as rows: actor, item, title."""
    return items.select(F.explode(split_list(F.col("casts"))).alias("actor"), "item_id", "title")
