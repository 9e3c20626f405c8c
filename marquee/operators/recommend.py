"""Recommenders for all users at once.  Output: user_id, item_id, score, rank."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from marquee.operators import similarity as sim, tiles
from marquee.operators.interactions import LIKE10
from marquee.operators.overlap import mean_overlap
from marquee.operators.ranking import positions, priority_merge, rank_scores, top_per_group
from marquee.session import materialize

#: Ratings of a neighbour that travel in one row.
PACKED = 4096


def liked(ratings: DataFrame, *, like10: int = LIKE10) -> DataFrame:
    return ratings.filter(F.col("score10") >= like10)


def cf_scores(similar: DataFrame, ratings: DataFrame, watched: DataFrame, *, like10: int = LIKE10) -> DataFrame:
    """Sum of similarity times score over the neighbours' liked items, without what the user has rated."""
    likes = liked(ratings, like10=like10).select(F.col("user_id").alias("user_b"), "item_id", "score10")
    rated = watched.filter("user_id is not null and item_id is not null").select(
        "user_id", F.lit(None).cast("bigint").alias("user_b"), F.lit(None).cast("double").alias("sim"),
        F.array(F.struct("item_id", F.lit(0).cast("bigint").alias("score10"))).alias("e"))
    sums = _by_user(similar, likes, rated).groupBy("user_id", "item_id").agg(
        F.sum(F.col("sim") * F.col("score10") / 10).alias("score"), F.bool_or(F.col("sim").isNull()).alias("rated"))
    return sums.filter(~F.col("rated")).drop("rated")


def _by_user(similar: DataFrame, ratings: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """The rows (user_b, item_id, score10) of each user's neighbours: user_id, user_b, sim, item_id, score10.

    A neighbour's rows travel packed, ``PACKED`` at most in a row, and are opened where all rows of a user
    lie, so sums by user and item need no further shuffle.  ``rated`` adds packed rows (user_id, user_b, sim, e).
    """
    amount = ratings.groupBy("user_b").agg(F.ceil(F.count(F.lit(1)) / PACKED).alias("parts"))
    packed = ratings.join(amount, "user_b").groupBy("user_b", F.pmod(F.xxhash64("item_id"), F.col("parts")).alias("part")).agg(
        F.collect_list(F.struct("item_id", F.col("score10").cast("bigint").alias("score10"))).alias("e")).drop("part")
    rows = similar.join(packed, "user_b").select(F.col("user_a").alias("user_id"), "user_b", "sim", "e")
    if rated is not None:
        rows = rows.unionByName(rated)
    return rows.repartition("user_id").select("user_id", "user_b", "sim", F.inline("e"))


def user_cf(ratings: DataFrame, items: DataFrame | None = None, *, k_neighbours: int | None = 20, n: int = 10,
            like10: int = LIKE10) -> DataFrame:
    """Pearson collaborative filtering; items outside the catalogue are dropped before the cut."""
    ratings = materialize(ratings.select("user_id", "item_id", "score10"))
    similar = sim.user_similarity_pearson(ratings, k=k_neighbours)
    scores = cf_scores(similar, ratings, ratings, like10=like10)
    if items is not None:
        scores = scores.join(items.select("item_id"), "item_id", "left_semi")
    return rank_scores(scores, n=n)


def content_rec(ratings: DataFrame, items: DataFrame, *, n: int = 10, like10: int = LIKE10) -> DataFrame:
    """Mean tag cosine to the user's liked items, without rated ones.

    The mean over liked items factors into one profile per user, and items with
    equal tags share one score, so users are matched against distinct tag sets.
    A user needs at most ``n`` plus the number of own rated items tag sets;
    these are then opened into items.  Sets of equal score come in the order of
    their smallest item, so each of the first sets holds an item that goes before
    any item of a later one, and ties need no extra sets.
    """
    tagged = materialize(sim.item_tags(items).filter(F.size("tags") > 0))
    members, groups = sim.group_copies(tagged, F.array_join("tags", "\u0001"))
    members, groups = materialize(members), materialize(groups)
    rated = materialize(ratings.select("user_id", "item_id", "score10").join(members, "item_id"))
    likes = rated.filter(F.col("score10") >= like10).groupBy("user_id", "copy_id").agg(F.count(F.lit(1)).alias("c"))
    totals = likes.groupBy("user_id").agg(F.sum("c").alias("n_liked"))
    sets = tagged.select(F.col("item_id").alias("copy_id"), "tags")
    weights = (
        likes.join(sets, "copy_id").select("user_id", (F.col("c") / F.sqrt(F.size("tags"))).alias("w"),
                                           F.explode("tags").alias("tag"))
        .groupBy("user_id", "tag").agg(F.sum("w").alias("w"))
        .join(totals, "user_id").select("user_id", "tag", (F.col("w") / F.col("n_liked")).alias("w"))
    )
    own = rated.groupBy("user_id").agg((F.count(F.lit(1)) + n).cast("int").alias("k"))
    profiles = materialize(tiles.pack(weights, "user_id", "tag", "w").join(
        own.withColumnRenamed("user_id", "id"), "id"))
    vectors = sets.join(groups.select("copy_id"), "copy_id", "left_semi").select(
        F.col("copy_id").alias("id"), F.col("tags").alias("terms"),
        F.transform("tags", lambda x: 1 / F.sqrt(F.size("tags"))).alias("vals"))
    matched = tiles.match(profiles, vectors, kind="dot").select(
        F.col("left_id").alias("user_id"), F.col("right_id").alias("copy_id"), "score")
    return rank_scores(_open_sets(matched, members, groups, rated, n), n=n)


def _open_sets(matched: DataFrame, members: DataFrame, groups: DataFrame, rated: DataFrame, n: int) -> DataFrame:
    """Unrated items of the sets a user may need for the best ``n``: user_id, item_id, score.

    ``matched`` (user_id, copy_id, score) holds ``n`` sets more than a user has rated; ``members`` (item_id, copy_id) and
    ``groups`` (copy_id, n_copies) describe the sets, ``rated`` is (user_id, item_id, copy_id).
    """
    taken = rated.groupBy("user_id", "copy_id").agg(F.count(F.lit(1)).alias("taken"))
    open_sets = matched.join(taken, ["user_id", "copy_id"], "left").join(groups.select("copy_id", "n_copies"), "copy_id").withColumn(
        "taken", F.coalesce("taken", F.lit(0))).withColumn("micro", tiles.micro(F.col("score")))
    better = Window.partitionBy("user_id").orderBy(F.col("micro").desc()).rangeBetween(Window.unboundedPreceding, -1)
    needed = open_sets.withColumn(
        "ahead", F.coalesce(F.sum(F.col("n_copies") - F.col("taken")).over(better), F.lit(0))
    ).filter(F.col("ahead") < n)
    placed = positions(members, ["copy_id"], ["item_id"], F.floor(F.col("item_id") / 65_536))
    deepest = taken.agg(F.coalesce(F.max("taken"), F.lit(0)).alias("deepest")).withColumn("one", F.lit(0))
    reachable = placed.withColumn("one", F.lit(0)).join(F.broadcast(deepest), "one").filter(
        F.col("pos") < F.col("deepest") + n).select("copy_id", "item_id", "pos")
    return (
        needed.join(reachable, "copy_id").filter(F.col("pos") < F.col("taken") + n)
        .select("user_id", "item_id", "score")
        .join(rated.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    )


def content_rec_jaccard(ratings: DataFrame, items: DataFrame, *, n: int = 10, like10: int = LIKE10,
                        weight: float = 1.0, boost: DataFrame | None = None, head: int | None = None) -> DataFrame:
    """Mean token Jaccard to the user's liked items, without rated ones.

    Users are matched against distinct token sets (``overlap``), of which a user
    needs at most ``n`` plus the number of rated items; these are then opened into
    items.  ``boost`` (user_id, item_id, score; positive) is added to ``weight`` times
    the mean before ranking: boosted items are scored one by one, and of the
    others none beyond the best ``n`` can come into the list.  ``head`` is the number
    of summary words that count; None takes them all.
    """
    members, sets = sim.attribute_sets(items, head=head)
    ratings = materialize(ratings.select("user_id", "item_id", "score10"))
    rated = materialize(ratings.join(members, "item_id"))
    likes = rated.filter(F.col("score10") >= like10).groupBy(F.col("user_id").alias("id"), "copy_id").agg(F.count(F.lit(1)).alias("n"))
    # liked items without tokens count in the mean, rated ones in the number of sets a user needs
    users = ratings.groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("score10") >= like10).alias("total"), F.count(F.lit(1)).alias("k"))
    users = users.filter("total > 0").withColumn("k", F.col("k") + n)
    wanted = None
    if boost is not None:
        boost = materialize(boost.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"))
        boosted = materialize(boost.join(members, "item_id", "left").select("user_id", "item_id", "copy_id", F.col("score").alias("boost")))
        wanted = boosted.filter("copy_id is not null").select(F.col("user_id").alias("id"), "copy_id").distinct()
    found, asked = mean_overlap(likes, users, sets, weight=weight, wanted=wanted)
    matched = found.withColumnRenamed("id", "user_id")
    scores = _open_sets(matched, members, sets, rated.select("user_id", "item_id", "copy_id"), n)
    if boost is None:
        return rank_scores(scores, n=n)
    own = boosted.join(asked.withColumnRenamed("id", "user_id"), ["user_id", "copy_id"], "left").select(
        "user_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"), "boost")
    both = rank_scores(scores, n=n).select("user_id", "item_id", "score", F.lit(0.0).alias("boost")).unionByName(own)
    return rank_scores(both.groupBy("user_id", "item_id").agg((F.max("score") + F.max("boost")).alias("score")), n=n)


def jaccard_cf_hybrid(ratings: DataFrame, items: DataFrame, cf: DataFrame, *, n: int, weight_cf: float = 0.55,
                      weight_content: float = 0.45, like10: int = LIKE10, head: int | None = None) -> DataFrame:
    """Best ``n`` by weighted sum of collaborative and Jaccard content scores.

    The content score covers nearly every item, the collaborative one few, so
    the latter is added pair by pair and the dense score table never exists.
    """
    boost = cf.select("user_id", "item_id", (F.col("score") * F.lit(weight_cf)).alias("score"))
    return content_rec_jaccard(ratings, items, n=n, like10=like10, weight=weight_content, boost=boost, head=head)


def item_cf(ratings: DataFrame, *, n: int = 5) -> DataFrame:
    """Best ``n`` items by zero-filled rating cosine."""
    return rank_scores(sim.item_cosine(ratings, k=n).select("item_a", F.col("item_b").alias("item_id"), F.col("sim").alias("score")),
                       n=n, keys=("item_a",)).select("item_a", F.col("item_id").alias("item_b"), F.col("score").alias("sim"), "rank")


def _nearest(similar: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per (user, item) the rating of the most similar neighbour who rated it, times the similarity."""
    theirs = ratings.filter(F.col("score10") > 0).select(F.col("user_id").alias("user_b"), "item_id", "score10")
    rows = _by_user(similar, theirs)
    first = F.min(F.struct((-tiles.micro(F.col("sim"))).alias("far"), "user_b", "sim", "score10"))
    return rows.groupBy("user_id", "item_id").agg(first.alias("f")).select(
        "user_id", "item_id", (F.col("f.sim") * F.col("f.score10") / 10).alias("score"))


def cf_nearest(ratings: DataFrame, *, n: int = 5, neighbours: int = 8) -> DataFrame:
    """Nearest-neighbour-wins filtering by zero-filled cosine; rated items stay in.

    A progressive search: an item none of a user's first k neighbours rated scores at
    most 10 times the similarity of the k-th.  A user whose n-th score is above that
    bound, or who has no further neighbour, is settled; for the others only,
    k doubles, starting from ``neighbours``.
    """
    ratings = materialize(ratings.select("user_id", "item_id", "score10"))
    vectors = sim.unit_ratings(ratings, "user_id", "item_id")
    open_, k, settled = vectors, neighbours, None
    while True:
        near = materialize(tiles.match_long(open_, vectors, kind="dot", k=k).select(
            F.col("left_id").alias("user_a"), F.col("right_id").alias("user_b"), F.col("score").alias("sim")))
        edge = near.groupBy("user_a").agg(F.count(F.lit(1)).alias("have"), F.min("sim").alias("edge")).filter(F.col("have") >= k)
        ranked = materialize(rank_scores(_nearest(near, ratings), n=n))
        nth = ranked.filter(F.col("rank") == n).select("user_id", F.col("score").alias("nth"))
        still = materialize(edge.join(nth, F.col("user_a") == F.col("user_id"), "left").filter(
            F.col("nth").isNull() | (tiles.micro(F.col("nth")) <= tiles.micro(10 * F.col("edge")))).select(F.col("user_a").alias("id")))
        done = ranked.join(still, F.col("user_id") == F.col("id"), "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if still.isEmpty():
            return settled
        open_, k = materialize(vectors.join(still, "id", "left_semi")), 2 * k


def hot_for_users(users: DataFrame, hot: DataFrame) -> DataFrame:
    """The same hot list (a handful of rows) for every user."""
    listed = hot.agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("hot")).withColumn("one", F.lit(0))
    return users.select("user_id", F.lit(0).alias("one")).join(F.broadcast(listed), "one").select(
        "user_id", F.inline("hot")).select("user_id", "item_id", "rank")


def baseline_hybrid(cf: DataFrame, content: DataFrame, hot: DataFrame, *, n: int = 10) -> DataFrame:
    """Collaborative list, then content list, then hot list, first occurrence kept."""
    return priority_merge([("baseline_cf", cf), ("baseline_content", content), ("hot", hot)], n=n)


def content_or_hot(content: DataFrame, hot: DataFrame) -> DataFrame:
    """The content list, or the hot list for users who have none."""
    without = hot.join(content.select("user_id").distinct(), "user_id", "left_anti")
    return content.select("user_id", "item_id", "rank").unionByName(without.select("user_id", "item_id", "rank"))


# The names a caller may ask for.
ALGORITHMS = ("hot", "baseline_content", "baseline_cf", "baseline_hybrid", "word2vec_content", "glove_content", "word2vec_cf",
              "glove_cf", "semantic_hybrid")


def by_algorithm(lists: Mapping[str, DataFrame], *, algorithm: str | None = None) -> DataFrame:
    """All ranked lists as one table, or the one named; an unknown name is an error."""
    if algorithm is not None:
        if algorithm not in ALGORITHMS or algorithm not in lists:
            raise KeyError(f"unsupported algorithm: {algorithm}")
        lists = {algorithm: lists[algorithm]}
    rows = None
    for name, ranked in lists.items():
        part = ranked.select(F.lit(name).alias("algorithm"), "user_id", "item_id", F.col("rank").cast("int").alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
