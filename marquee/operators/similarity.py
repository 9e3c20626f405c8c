"""User-user, item-item and text similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.text import ENGLISH_STOP_WORDS, attribute_tokens, split_multi, words
from marquee.functions.vectors import unit
from marquee.operators import tiles
from marquee.operators.overlap import mean_overlap, token_sets
from marquee.operators.ranking import top_per_group
from marquee.session import materialize


def user_similarity_pearson(ratings: DataFrame, others: DataFrame | None = None, *, min_common: int = 2,
                            k: int | None = None, max_entries: int | None = None) -> DataFrame:
    """Positive Pearson correlations over co-rated items: user_a, user_b, n_common, sim.

    ``others`` (default: the same ratings) supplies the neighbours; ``k`` keeps
    the best per user.  Sums are over integers, so the sign test is exact.
    """
    def long(rows: DataFrame) -> DataFrame:
        return materialize(rows.select(F.col("user_id").alias("id"), F.col("item_id").alias("term"),
                                       F.col("score10").alias("val")))

    left = long(ratings)
    right = left if others is None else long(others)
    return tiles.match_long(left, right, kind="pearson", k=k, min_common=min_common, max_entries=max_entries).select(
        F.col("left_id").alias("user_a"), F.col("right_id").alias("user_b"), "n_common", F.col("score").alias("sim"))


def item_tags(items: DataFrame) -> DataFrame:
    """Distinct namespaced tags of each item: types, directors and country."""
    def named(column: str, space: str) -> Column:
        return F.transform(split_multi(F.col(column)), lambda x: F.concat(F.lit(space), x))

    tags = F.array_distinct(F.concat(named("types", "t:"), named("directors", "d:"), named("country", "c:")))
    return items.select("item_id", F.array_sort(tags).alias("tags"))


def group_copies(rows: DataFrame, content: Column) -> tuple[DataFrame, DataFrame]:
    """Collapse rows with equal content: (item_id, copy_id) and (copy_id, n_copies).

    ``copy_id`` is the lowest item id of the group.  Scoring then costs one
    row per distinct content, however many copies a group holds.
    """
    keyed = rows.select("item_id", content.alias("content"))
    groups = keyed.groupBy("content").agg(F.min("item_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"))
    return keyed.join(groups.select("content", "copy_id"), "content").select("item_id", "copy_id"), groups.select(
        "copy_id", "n_copies")


def expand_copies(matched: DataFrame, members: DataFrame, *, n: int) -> DataFrame:
    """Best ``n`` other items per item, from matches between copy groups (own group included).

    The ``n + 1`` best groups hold the ``n + 1`` best items, and of each group
    only its ``n + 1`` lowest ids can be among them.  The bounded list of a
    group is built once and attached to each of its members row by row.
    """
    lowest = top_per_group(members, ["copy_id"], ["item_id"], n=n + 1, rank="pos").select(
        F.col("copy_id").alias("right_id"), F.col("item_id").alias("other"))
    ranked = top_per_group(
        matched.join(lowest, "right_id").withColumn("micro", tiles.micro(F.col("score"))),
        ["left_id"], [F.col("micro").desc(), F.col("other")], n=n + 1, rank="place")
    lists = ranked.groupBy(F.col("left_id").alias("copy_id")).agg(
        F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("best"))
    own = members.join(lists, "copy_id")
    others = F.slice(F.filter("best", lambda x: x["other"] != F.col("item_id")), 1, n)
    return own.select("item_id", F.posexplode(others).alias("pos", "m")).select(
        F.col("item_id").alias("item_a"), F.col("m.other").alias("item_b"), F.col("m.score").alias("sim"),
        (F.col("pos") + 1).alias("rank"))


def similar_items(items: DataFrame, *, n: int = 6) -> DataFrame:
    """Best ``n`` items by cosine of binary tag vectors; items sharing no tag never match."""
    tagged = materialize(item_tags(items))
    members, groups = group_copies(tagged, F.array_join("tags", "\u0001"))
    vectors = tagged.join(groups, F.col("item_id") == F.col("copy_id"), "left_semi").filter(F.size("tags") > 0).select(
        F.col("item_id").alias("id"), F.col("tags").alias("terms"),
        F.transform("tags", lambda x: 1 / F.sqrt(F.size("tags"))).alias("vals"))
    return expand_copies(tiles.match(vectors, vectors, kind="dot", k=n + 1), members, n=n)


def attribute_sets(items: DataFrame, *, head: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Attribute token sets of items, equal ones once; all summary words, or the first ``head``."""
    return token_sets(items, attribute_tokens(F.col("types"), F.col("directors"), F.col("country"), F.col("summary"), head=head))


def item_jaccard(items: DataFrame, *, n: int = 6) -> DataFrame:
    """Best ``n`` items by shared / united attribute tokens."""
    members, sets = attribute_sets(items)
    own = sets.select(F.col("copy_id").alias("id"), "copy_id", F.lit(1).cast("bigint").alias("n"))
    users = own.select("id", F.lit(1).alias("total"), F.lit(n + 1).alias("k"))
    matched, _ = mean_overlap(own, users, sets)
    return expand_copies(matched.select(F.col("id").alias("left_id"), F.col("copy_id").alias("right_id"), "score"), members, n=n)


def unit_ratings(ratings: DataFrame, id_col: str, term_col: str) -> DataFrame:
    """Zero-filled rating vectors scaled to length 1, as long rows (id, term, val)."""
    norms = ratings.groupBy(id_col).agg(F.sqrt(F.sum(F.col("score10") * F.col("score10")).cast("double")).alias("norm"))
    unit = ratings.join(norms.filter(F.col("norm") > 0), id_col).select(
        F.col(id_col).alias("id"), F.col(term_col).alias("term"), (F.col("score10") / F.col("norm")).alias("val"))
    return materialize(unit)


def user_cosine(ratings: DataFrame, *, k: int | None = 20, max_entries: int | None = None) -> DataFrame:
    vectors = unit_ratings(ratings, "user_id", "item_id")
    return tiles.match_long(vectors, vectors, kind="dot", k=k, max_entries=max_entries).select(
        F.col("left_id").alias("user_a"), F.col("right_id").alias("user_b"), F.col("score").alias("sim"))


def item_cosine(ratings: DataFrame, *, k: int | None = 20, max_entries: int | None = None) -> DataFrame:
    vectors = unit_ratings(ratings, "item_id", "user_id")
    return tiles.match_long(vectors, vectors, kind="dot", k=k, max_entries=max_entries).select(
        F.col("left_id").alias("item_a"), F.col("right_id").alias("item_b"), F.col("score").alias("sim"))


def tfidf_vectors(texts: DataFrame, *, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Length-1 TF-IDF vectors (item_id, text) -> (id, numbered terms, vals) with idf = ln((1+N)/(1+df)) + 1."""
    spark = texts.sparkSession
    stops = spark.createDataFrame([(w,) for w in stop_words], "term string")
    counts = (
        texts.select(F.col("item_id").alias("id"), F.explode(words(F.col("text"))).alias("term"))
        .join(F.broadcast(stops), "term", "left_anti").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    counts = materialize(counts)
    size = texts.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(0))
    # terms are numbered on the way: numbers travel and compare faster than words
    idf = materialize(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("one", F.lit(0)).join(
        F.broadcast(size), "one").select("term", F.monotonically_increasing_id().alias("number"),
                                         (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    weighted = counts.join(idf, "term").select("id", F.col("number").alias("term"), (F.col("tf") * F.col("idf")).alias("w"))
    packed = tiles.pack(weighted, "id", "term", "w")
    return packed.select("id", "terms", unit(F.col("vals")).alias("vals"))


def tfidf_similar(texts: DataFrame, *, n: int = 10, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Best ``n`` other texts by TF-IDF cosine.  ``texts`` is (item_id, text); equal texts are scored once.

    Document counts still include every copy, as each copy is a document.
    """
    members, groups = group_copies(texts, F.sha2("text", 256))
    members = materialize(members)
    vectors = materialize(tfidf_vectors(texts, stop_words=stop_words))
    distinct = vectors.join(members.filter(F.col("item_id") == F.col("copy_id")), F.col("id") == F.col("item_id"), "left_semi")
    return expand_copies(tiles.match(distinct, distinct, kind="dot", k=n + 1), members, n=n)
