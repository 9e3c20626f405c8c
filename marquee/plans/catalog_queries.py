"""Catalogue, behaviour and report queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import text as tx
from marquee.operators import catalog as cat, interactions as ix
from marquee.plans.registry import behaviors, query, sql


def _score10():
    """A missing score is printed as -1, so that the result column stays an integer everywhere."""
    return F.coalesce(F.col("score10"), F.lit(-1)).alias("score10")


def _item_ids(t):
    return t.raw("part").select(F.col("p_partkey").alias("item_id"))


_LISTS = ", ".join(
    f"array_to_string(list_filter(string_split({c}, '/'), lambda x: x <> ''), '|') AS {c}_list"
    for c in ("types", "directors", "country", "casts"))


@query("item_normalize", sql(f"SELECT item_id, rate AS rating, release_year AS release_date, title, {_LISTS}, "
                             "array_to_string(list_filter(string_split(types, '/'), lambda x: x <> ''), '|') AS genres, "
                             "summary AS description, CAST(NULL AS VARCHAR) AS poster_url FROM items", "items"))
def item_normalize(t):
    out = cat.item_normalize(t.items(summary=True))
    lists = [F.array_join(f"{c}_list", "|").alias(f"{c}_list") for c in cat.LIST_COLUMNS]
    return out.select("item_id", "rating", "release_date", "title", *lists, F.array_join("genres", "|").alias("genres"),
                      "description", "poster_url")


@query("split_multi", sql("""SELECT item_id, array_to_string(list_filter(list_transform(string_split(replace(raw, ',', '/'),
    '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts, len(list_filter(list_transform(string_split(replace(raw, ',', '/'), '/'),
    lambda x: trim(x)), lambda x: x <> '')) AS n FROM (SELECT item_id, types || ', ' || country || ' /' || casts AS raw FROM items)""",
    "items"))
def split_multi(t):
    raw = F.concat(F.col("types"), F.lit(", "), F.col("country"), F.lit(" /"), F.col("casts"))
    parts = tx.split_multi(raw)
    return t.items().select("item_id", F.array_join(parts, "|").alias("parts"), F.size(parts).cast("bigint").alias("n"))


@query("item_lookup", sql("SELECT item_id, title, types, directors, country, rate FROM items WHERE item_id = 42", "items"))
def item_lookup(t):
    return cat.item_lookup(t.items(), item_id=42).select("item_id", "title", "types", "directors", "country", "rate")


@query("search", sql("""SELECT item_id, title, rate, comment_len, types FROM items WHERE contains(lower(title), 'ring')
    OR contains(lower(types), 'ring') OR contains(lower(directors), 'ring') OR contains(lower(country), 'ring')""", "items"))
def search(t):
    return cat.search(t.items(comment_len=True), keyword="Ring").select("item_id", "title", "rate", "comment_len", "types")


@query("validate_interactions", sql("""SELECT event_id, user_id, item_id, coalesce(behavior_type, 0) AS behavior_type,
    coalesce(score10, -1) AS score10, CASE WHEN behavior_type IS NULL OR behavior_type NOT IN (1, 2, 3) THEN 'behavior_type'
         WHEN item_id IS NULL OR item_id < 0 THEN 'item_id' WHEN p_partkey IS NULL THEN 'unknown_item'
         WHEN behavior_type = 1 AND score10 IS NULL THEN 'missing_score'
         WHEN behavior_type = 1 AND NOT (score10 BETWEEN 0 AND 100) THEN 'score_range' END AS reject_reason
    FROM interactions LEFT JOIN part ON p_partkey = item_id""", "interactions"))
def validate_interactions(t):
    return ix.validate_interactions(t.interactions(), _item_ids(t)).select(
        "event_id", "user_id", "item_id", F.coalesce("behavior_type", F.lit(0)).alias("behavior_type"), _score10(),
        "reject_reason")


@query("rating_events", sql("SELECT user_id, item_id, score10, ts, event_id FROM behaviors WHERE behavior_type = 1 "
                            "AND score10 IS NOT NULL", "behaviors"))
def rating_events(t):
    return ix.rating_events(behaviors(t)).select("user_id", "item_id", "score10", "ts", "event_id")


@query("interaction_events", sql("SELECT user_id, item_id, behavior_type, coalesce(score10, -1) AS score10, ts, event_id "
                                 "FROM behaviors", "behaviors"))
def interaction_events(t):
    return behaviors(t).select("user_id", "item_id", "behavior_type", _score10(), "ts", "event_id").orderBy(
        "user_id", "ts", "event_id")


@query("positive_sequences", sql("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    item_id, behavior_type, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM behaviors
    WHERE (behavior_type = 1 AND score10 >= 70) OR behavior_type IN (2, 3)) WHERE n >= 2""", "behaviors"))
def positive_sequences(t):
    return ix.positive_sequences(behaviors(t)).select(
        "user_id", "pos", "item_id", "behavior_type", "event_id")


@query("liked_and_watched", sql("""SELECT user_id, count(*) AS n_watched, sum(CASE WHEN score10 >= 80 THEN 1 ELSE 0 END)::BIGINT
    AS n_liked FROM ratings GROUP BY 1""", "ratings"))
def liked_and_watched(t):
    return t.ratings().groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_watched"), F.count_if(F.col("score10") >= ix.LIKE10).alias("n_liked"))


@query("reward", sql("""SELECT event_id, CASE WHEN behavior_type = 1 AND score10 IS NOT NULL
    THEN round((score10 / 10 - 5) / 5, 4) WHEN behavior_type = 2 THEN 0.35 WHEN behavior_type = 3 THEN 0.15 ELSE 0.0 END
    AS reward FROM interactions""", "interactions"))
def reward(t):
    return t.interactions().select("event_id", ix.reward(F.col("behavior_type"), F.col("score10")).alias("reward"))


@query("catalog_table", sql("""SELECT item_id, title, rate AS rating, release_year, types AS genres, directors, country, duration
    FROM items""", "items"))
def catalog_table(t):
    return cat.catalog_table(t.items())


@query("full_catalog", sql("SELECT item_id, title, rate, comment_len FROM items", "items"))
def full_catalog(t):
    return cat.full_catalog(t.items(comment_len=True)).select("item_id", "title", "rate", "comment_len")


@query("user_ratings", sql("SELECT item_id, score10, ts FROM ratings WHERE user_id = 7", "ratings"))
def user_ratings(t):
    return ix.latest_ratings(t.rating_log().filter(F.col("user_id") == 7)).select("item_id", "score10", "ts")


@query("item_ratings", sql("SELECT user_id, score10, ts FROM ratings WHERE item_id = 7", "ratings"))
def item_ratings(t):
    return ix.latest_ratings(t.rating_log().filter(F.col("item_id") == 7)).select("user_id", "score10", "ts")


@query("item_ids", "SELECT p_partkey AS item_id FROM part")
def item_ids(t):
    return _item_ids(t).orderBy("item_id")


@query("feedback_rows", sql("SELECT event_id, user_id, item_id, behavior_type, coalesce(score10, -1) AS score10 "
                            "FROM behaviors", "behaviors"))
def feedback_rows(t):
    return behaviors(t).orderBy("ts", "event_id").select(
        "event_id", "user_id", "item_id", "behavior_type", _score10())


@query("item_comments", sql(f"""SELECT item_id, turn, coalesce(name, CAST(comments.user_id AS VARCHAR), '{cat.ANONYMOUS}')
    AS username, content FROM comments LEFT JOIN users ON users.user_id = comments.user_id""", "comments", "users"))
def item_comments(t):
    return cat.item_comments(t.comments(), t.users()).orderBy("item_id", F.col("turn").desc())


@query("user_timeline", sql("""SELECT b.user_id, b.event_id, b.item_id, p_name AS title, coalesce(behavior_type, 0) AS behavior_type,
    coalesce(score10, -1) AS score10, ts FROM interactions b LEFT JOIN part ON p_partkey = b.item_id""", "interactions"))
def user_timeline(t):
    titles = t.raw("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return cat.user_timeline(t.interactions(), titles).withColumn("score10", _score10()).withColumn(
        "behavior_type", F.coalesce("behavior_type", F.lit(0)))


@query("recent_interactions", sql("""SELECT user_id, event_id, title, place FROM (SELECT b.user_id, event_id, p_name AS title,
    row_number() OVER (PARTITION BY b.user_id ORDER BY ts DESC, event_id DESC) AS place FROM behaviors b
    LEFT JOIN part ON p_partkey = b.item_id) WHERE place <= 5""", "behaviors"))
def recent_interactions(t):
    from marquee.operators.ranking import top_per_group

    newest = top_per_group(behaviors(t), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], n=5, rank="place")
    titles = t.raw("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return newest.join(titles, "item_id", "left").select(
        "user_id", "event_id", "title", F.col("place").cast("bigint").alias("place"))


@query("user_history", sql("""SELECT b.user_id, b.event_id, b.behavior_type, coalesce(b.score10, -1) AS score10, items.item_id, title, types, directors,
    country, rate, comment_len, release_year, duration, summary FROM behaviors b JOIN items ON items.item_id = b.item_id""",
    "behaviors", "items"))
def user_history(t):
    return cat.user_history(behaviors(t), t.items(summary=True, comment_len=True)).drop("ts", "casts").withColumn("score10", _score10())


@query("orphan_filter", sql("""SELECT event_id FROM behaviors WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size <= 40)
    AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)""", "behaviors"))
def orphan_filter(t):
    users = t.users().filter(F.col("user_id") % 10 != 0)
    items = t.raw("part").filter(F.col("p_size") <= 40).select(F.col("p_partkey").alias("item_id"))
    return ix.orphan_filter(behaviors(t), users, items).select("event_id")


@query("comment_counts", sql("SELECT item_id, comment_len FROM items", "items"))
def comment_counts(t):
    return cat.comment_counts(_item_ids(t), t.comments())


@query("overview_counts", sql("""SELECT (SELECT count(*) FROM customer) AS n_users, (SELECT count(*) FROM part) AS n_items,
    (SELECT count(*) FROM behaviors) AS n_interactions, (SELECT count(*) FROM comments) AS n_comments,
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n_pending, (SELECT count(*) FROM supplier) AS n_versions""",
    "behaviors", "comments"))
def overview_counts(t):
    pool = t.raw("orders").select(F.when(F.col("o_orderstatus") == "O", "pending").otherwise("processed").alias("status"))
    return cat.overview_counts(t.users(), _item_ids(t), behaviors(t), t.comments(), pool, t.raw("supplier"))


@query("behavior_summary", sql("""SELECT count(*) AS n_behaviors, count(*) FILTER (behavior_type = 1 AND score10 IS NOT NULL)
    AS n_ratings FROM behaviors""", "behaviors"))
def behavior_summary(t):
    return cat.behavior_summary(behaviors(t))


@query("density", sql("""SELECT *, round(n_ratings / greatest(n_users * n_items, 1), 4) AS density FROM (SELECT
    (SELECT count(*) FROM customer) AS n_users, (SELECT count(*) FROM part) AS n_items, (SELECT count(*) FROM behaviors
    WHERE behavior_type = 1 AND score10 IS NOT NULL) AS n_ratings)""", "behaviors"))
def density(t):
    return cat.density(t.users(), _item_ids(t), behaviors(t))


@query("exposure", sql("SELECT item_id, exposure FROM exposures", "exposures"))
def exposure(t):
    return cat.exposure(behaviors(t))


@query("coverage_bonus", sql("SELECT item_id, exposure, coverage_bonus FROM bonus", "bonus"))
def coverage_bonus(t):
    return cat.coverage_bonus(_item_ids(t), cat.exposure(behaviors(t)))


@query("behavior_snapshot", sql("""SELECT user_id, item_id, bool_or(behavior_type = 1) AS rated,
    coalesce(max(CASE WHEN behavior_type = 1 THEN score10 END), -1) AS score10, bool_or(behavior_type = 2) AS collected,
    bool_or(behavior_type = 3) AS watched FROM behaviors GROUP BY 1, 2""", "behaviors"))
def behavior_snapshot(t):
    return cat.behavior_snapshot(behaviors(t)).withColumn("score10", _score10())


_AVERAGE = """SELECT p_partkey AS item_id, p_name AS title, coalesce(n, 0) AS n_ratings, round(coalesce(s / (10 * n), 0), 4)
    AS avg_score FROM part LEFT JOIN (SELECT item_id, sum(score10)::BIGINT AS s, count(*) AS n FROM ratings GROUP BY 1) r
    ON r.item_id = p_partkey"""


def _titles(t):
    return t.raw("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


@query("average_ratings", sql(_AVERAGE, "ratings"))
def average_ratings(t):
    return cat.average_ratings(_titles(t), t.ratings())


@query("top_rated", sql("SELECT * FROM averages ORDER BY avg_score DESC, item_id LIMIT 10", "ratings", averages=_AVERAGE))
def top_rated(t):
    return cat.top_rated(_titles(t), t.ratings())


@query("type_distribution", sql("""SELECT type, count(*) AS n_items FROM (SELECT unnest(string_split(types, '/')) AS type
    FROM items) WHERE type <> '' GROUP BY 1""", "items"))
def type_distribution(t):
    return cat.type_distribution(t.items())


@query("period_stats", sql("""SELECT CAST(floor(release_year / 10) * 10 AS INT) AS decade, count(*) AS n_items,
    round(sum(CAST(round(rate * 100) AS BIGINT)) / (100 * count(*)), 4) AS avg_rate FROM items GROUP BY 1""", "items"))
def period_stats(t):
    return cat.period_stats(t.items())


@query("rating_table", sql("SELECT averages.*, comment_len FROM averages JOIN items USING (item_id)", "ratings", "items",
                           averages=_AVERAGE).replace("averages.*", "averages.item_id, averages.title, n_ratings, avg_score"))
def rating_table(t):
    return cat.rating_table(_titles(t), t.ratings(), t.comments())


@query("actor_items", sql("""SELECT actor, item_id, title FROM (SELECT item_id, title, unnest(string_split(casts, '/')) AS actor
    FROM items) WHERE actor <> ''""", "items"))
def actor_items(t):
    return cat.actor_items(t.items())


_ORDER = "ORDER BY rate DESC, comment_len DESC, title, item_id"


@query("top_items", sql(f"SELECT item_id, title, rate, comment_len FROM items {_ORDER} LIMIT 25", "items"))
def top_items(t):
    return cat.top_items(t.items(comment_len=True)).select("item_id", "title", "rate", "comment_len")


@query("hot_items", sql(f"""SELECT item_id, title, rate, row_number() OVER ({_ORDER}) AS rank, '{cat.HOT_REASON}' AS reason
    FROM items QUALIFY rank <= 10""", "items"))
def hot_items(t):
    return cat.hot_items(t.items(comment_len=True)).withColumn("rank", F.col("rank").cast("bigint"))
