"""Token, feature and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import text as tx, vectors as vx
from marquee.operators import embeddings as em, features as ft
from marquee.plans.recommend_queries import SPACE, _big, _r, chain, micro
from marquee.plans.registry import behaviors, half_up, half_up_sql, query, sql
from marquee.session import materialize

# Vocabularies that occur in the given tables.
GENRES = ("economy", "standard", "promo", "small", "medium", "large", "ring", "widget", "bolt", "gizmo", "gear", "cog",
          "valve", "plate", "lever")
KEYWORDS = {"the": "drama", "que": "suspense", "der": "plot_twist", "and": "cinematic", "les": "romance",
            "ung": "family_bond", "con": "friendship", "tion": "heartwarming", "ent": "emotional", "für": "thrilling",
            "los": "slow_burn", "will": "fast_paced", "wh": "sci_fi", "ez": "world_building", "ion": "human_nature"}
AS_OF = "2024-02-01 00:00:00"
_INNER = SPACE[1:-2]


def _values(rows) -> str:
    return ", ".join(f"({', '.join(repr(v) if isinstance(v, str) else str(v) for v in r)})" for r in rows)


def _semantic(text: str) -> str:
    return f"""list_filter(list_transform(regexp_split_to_array({text}, '[{_INNER},，。/；;：:()（）|]+'), lambda t:
    regexp_replace(lower(trim(t)), '[^0-9a-zA-Z\\x{{4e00}}-\\x{{9fa5}}_+-]+', '', 'g')), lambda t: t <> '')"""


@query("semantic_tokens", f"""SELECT doc_id, array_to_string({_semantic('text')}, ' ') AS tokens FROM documents""")
def semantic_tokens(t):
    return t.raw("documents").select("doc_id", F.array_join(tx.semantic_tokens(F.col("text")), " ").alias("tokens"))


_ITEM_TOKENS = f"""{_semantic('title')} || list_transform(string_split(types, '/'), lambda x: regexp_replace(lower(trim(x)),
    '[^0-9a-zA-Z\\x{{4e00}}-\\x{{9fa5}}_+-]+', '', 'g')) || [regexp_replace(lower(directors), '[^0-9a-zA-Z_+-]+', '', 'g'),
    regexp_replace(lower(country), '[^0-9a-zA-Z_+-]+', '', 'g')] || {_semantic("coalesce(summary, '')")}"""


@query("item_tokens", sql(f"SELECT item_id, array_to_string({_ITEM_TOKENS}, ' ') AS tokens FROM items", "items"))
def item_tokens(t):
    tokens = tx.item_tokens(F.col("title"), F.col("types"), F.col("directors"), F.col("country"), F.col("summary"))
    return t.items(summary=True).select("item_id", F.array_join(tokens, " ").alias("tokens"))


def _feature_words(text: str) -> str:
    stops = ", ".join(repr(w) for w in tx.FEATURE_STOP_WORDS)
    return f"""list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[{_INNER},，。/；;：:()（）.!?]+'), lambda t:
    length(t) > 1 AND NOT list_contains([{stops}], t))"""


@query("feature_tokens", f"SELECT doc_id, array_to_string({_feature_words('text')}, ' ') AS tokens FROM documents")
def feature_tokens(t):
    return t.raw("documents").select("doc_id", F.array_join(tx.feature_tokens(F.col("text")), " ").alias("tokens"))


def _tags(text: str) -> str:
    cases = ", ".join(f"CASE WHEN contains({text}, '{k}') THEN '{v}' END" for k, v in KEYWORDS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query("keyword_tags", f"SELECT doc_id, array_to_string({_tags('text')}, ',') AS tags FROM documents")
def keyword_tags(t):
    return t.raw("documents").select("doc_id", F.array_join(tx.keyword_tags(F.col("text"), KEYWORDS), ",").alias("tags"))


def _bucket(text: str, size: int) -> str:
    """md5 modulo any size in SQL, part by part."""
    rest = "0"
    for at in range(1, 33, 8):
        rest = f"(({rest}) * 4294967296 + ('0x' || substr(h, {at}, 8))::BIGINT) % {size}"
    return f"(SELECT ({rest})::INT FROM (SELECT md5({text}) AS h))"


@query("hash_buckets", f"""SELECT p_partkey AS item_id, ('0x' || right(md5('director:' || lower(p_brand)), 2))::INT % 128 AS director,
    ('0x' || right(md5('summary:' || p_name), 2))::INT % 64 AS title, {_bucket("'director:' || lower(p_brand)", 100)} AS director_of_100,
    {_bucket("'summary:' || p_name", 1000)} AS title_of_1000 FROM part""")
def hash_buckets(t):
    return t.raw("part").select(
        F.col("p_partkey").alias("item_id"), vx.hash_bucket(F.lower("p_brand"), 128, "director").alias("director"),
        vx.hash_bucket(F.col("p_name"), 64, "summary").alias("title"),
        vx.hash_bucket(F.lower("p_brand"), 100, "director").alias("director_of_100"),
        vx.hash_bucket(F.col("p_name"), 1000, "summary").alias("title_of_1000"))


@query("term_frequency", sql("""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content),
    '[\\p{L}\\p{N}_]{2,}')) AS term FROM comments) WHERE term NOT IN (""" + ", ".join(repr(w) for w in tx.ENGLISH_STOP_WORDS) +
    ") GROUP BY 1 ORDER BY n DESC, term LIMIT 200", "comments"))
def term_frequency(t):
    return tx.term_frequency(t.comments(), "content")


_FEATURES = f"""SELECT item_id, slot, sum(value) AS value FROM (
    SELECT item_id, g.slot, 1.0 AS value FROM (SELECT item_id, unnest(string_split(types, '/')) AS w FROM items) i
        JOIN (VALUES {_values((i, w) for i, w in enumerate(GENRES))}) g(slot, w) ON g.w = lower(trim(i.w))
    UNION ALL SELECT item_id, ('0x' || right(md5('director:' || lower(directors)), 2))::INT % 128 + 15, 1.0 FROM items
    UNION ALL SELECT item_id, ('0x' || right(md5('country:' || lower(country)), 2))::INT % 64 + 143, 1.0 FROM items
    UNION ALL SELECT item_id, ('0x' || right(md5('summary:' || w), 2))::INT % 128 + 207, 1.0 / n FROM (SELECT item_id,
        unnest(l) AS w, len(l) AS n FROM (SELECT item_id, {_feature_words('summary')} AS l FROM items))
    UNION ALL SELECT item_id, g.slot + 335, 1.0 FROM (SELECT item_id, unnest({_tags("coalesce(summary, '')")}) AS w
        FROM items) i JOIN (VALUES {_values((i, w) for i, w in enumerate(KEYWORDS.values()))}) g(slot, w) ON g.w = i.w
    UNION ALL SELECT item_id, 350, least(greatest(rate, 0), 10) / 10 FROM items
    UNION ALL SELECT item_id, 351, least(comment_len, 5000) / 5000 FROM items
    UNION ALL SELECT item_id, 352, (least(greatest(release_year, 1900), 2026) - 1900) / 126 FROM items
    UNION ALL SELECT item_id, 353, (least(greatest(duration, 20), 300) - 20) / 280 FROM items) GROUP BY 1, 2 HAVING sum(value) <> 0"""


def features_of(t):
    return ft.item_features(t.items(summary=True, comment_len=True), genres=GENRES, tags=KEYWORDS)


@query("item_features", sql(f"SELECT item_id, slot, {half_up_sql('value', 6)} AS value FROM ({_FEATURES})", "items"))
def item_features(t):
    return ft.long_form(features_of(t)).select("item_id", "slot", half_up(F.col("value"), 6).alias("value"))


_WEIGHTS = f"""SELECT user_id, item_id, CASE WHEN behavior_type = 1 THEN greatest(-1, least(1, (score10 / 10 - 5) / 5))
    WHEN behavior_type = 2 THEN 0.8 ELSE 0.4 END * least(1, greatest(0.05, pow(0.5, (epoch(TIMESTAMP '{AS_OF}') -
    floor(epoch(ts))) / 3600.0 / 168.0))) AS w FROM behaviors"""
_STATS = """SELECT user_id, count(*) FILTER (behavior_type = 1) AS n_rate, count(*) FILTER (behavior_type = 2) AS n_collect,
    count(*) FILTER (behavior_type = 3) AS n_watch, coalesce(sum(score10) FILTER (behavior_type = 1), 0)::BIGINT AS s
    FROM behaviors GROUP BY 1"""
_UNION_STATS = """SELECT user_id, 350 AS slot, round(least(s / (10 * greatest(n_rate, 1)), 10) / 10, 8) AS value FROM stats
    UNION ALL SELECT user_id, 351, round(least(n_rate, 200) / 200, 8) FROM stats UNION ALL SELECT user_id, 352,
    round(least(n_collect, 200) / 200, 8) FROM stats UNION ALL SELECT user_id, 353, round(least(n_watch, 500) / 500, 8) FROM stats"""


@query("user_features", sql(f"""SELECT user_id, slot, round(sum(w * value) / greatest(any_value(total), 1e-6), 5) AS value
    FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY user_id) AS total FROM weights) x JOIN features USING (item_id) WHERE slot < 350
    GROUP BY 1, 2 UNION ALL {_UNION_STATS}""", "behaviors", "items", features=_FEATURES, weights=_WEIGHTS, stats=_STATS))
def user_features(t):
    return ft.user_features(materialize(behaviors(t)), materialize(features_of(t)), as_of=AS_OF).select(
        "user_id", "slot", F.when(F.col("slot") >= 350, F.round("value", 8)).otherwise(F.round("value", 5)).alias("value"))


@query("user_features_separate", sql(f"""SELECT user_id, slot, round(sum(greatest(w, 0) * value) / greatest(any_value(up), 1e-6) -
    sum(greatest(-w, 0) * value) / greatest(any_value(down), 1e-6), 5) AS value FROM (SELECT *, sum(greatest(w, 0)) OVER
    (PARTITION BY user_id) AS up, sum(greatest(-w, 0)) OVER (PARTITION BY user_id) AS down FROM weights) x JOIN features
    USING (item_id) WHERE slot < 350 GROUP BY 1, 2 UNION ALL {_UNION_STATS}""", "behaviors", "items", features=_FEATURES,
    weights=_WEIGHTS, stats=_STATS))
def user_features_separate(t):
    return ft.user_features(materialize(behaviors(t)), materialize(features_of(t)), as_of=AS_OF, separate=True).select(
        "user_id", "slot", F.when(F.col("slot") >= 350, F.round("value", 8)).otherwise(F.round("value", 5)).alias("value"))


@query("user_stats", sql("""SELECT user_id, n_rate, n_collect, n_watch, round(least(s / (10 * greatest(n_rate, 1)), 10) / 10, 8)
    AS avg_score, least(n_rate, 200) / 200 AS rate_share, least(n_collect, 200) / 200 AS collect_share, least(n_watch, 500) / 500
    AS watch_share FROM stats""", "behaviors", stats=_STATS))
def user_stats(t):
    return ft.user_stats(behaviors(t)).withColumn("avg_score", F.round("avg_score", 8))


@query("state_vectors", sql("""SELECT u.user_id, b.item_id, 708 AS width, round(u.s + i.s, 3) AS total FROM (SELECT DISTINCT user_id,
    item_id FROM behaviors) b JOIN (SELECT user_id, sum(value) AS s FROM profile GROUP BY 1) u USING (user_id)
    JOIN (SELECT item_id, sum(value) AS s FROM features GROUP BY 1) i USING (item_id)""", "behaviors", "items",
    features=_FEATURES, weights=_WEIGHTS, stats=_STATS, profile=f"""SELECT user_id, slot, sum(w * value) /
    greatest(any_value(total), 1e-6) AS value FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY user_id) AS total FROM weights) x
    JOIN features USING (item_id) WHERE slot < 350 GROUP BY 1, 2 UNION ALL {_UNION_STATS.replace('round(', '(').replace(', 8)', ')')}"""))
def state_vectors(t):
    """User vector followed by the item vector, for every (user, item) pair that met."""
    features = materialize(features_of(t))
    valid = behaviors(t)
    users = ft.pack_entries(ft.user_features(valid, features, as_of=AS_OF), "user_id").select(
        "user_id", ft.to_dense(F.col("features")).alias("u"))
    items = features.select("item_id", ft.to_dense(F.col("features")).alias("i"))
    met = valid.select("user_id", "item_id").distinct().join(users, "user_id").join(items, "item_id")
    state = F.concat("u", "i")
    return met.select("user_id", "item_id", F.size(state).alias("width"),
                      F.round(F.aggregate(state, F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


_PAIRS = """SELECT a.item_id AS left_item, b.item_id AS right_item, abs(a.pos - b.pos) AS gap FROM seqs a JOIN seqs b ON
    a.user_id = b.user_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 3"""
_SEQS = """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM (SELECT *,
    count(*) OVER (PARTITION BY user_id) AS n FROM behaviors WHERE (behavior_type = 1 AND score10 >= 70) OR behavior_type
    IN (2, 3)) WHERE n >= 2"""


@query("cooccurrence", sql("""SELECT 'movie_' || left_item AS left_token, 'movie_' || right_item AS right_token,
    round(sum(1 / gap), 4) AS weight, count(*) AS n FROM pairs GROUP BY 1, 2""", "behaviors", seqs=_SEQS, pairs=_PAIRS))
def cooccurrence(t):
    return em.cooccurrence(em.interaction_sequences(behaviors(t)), window=3).select(
        F.col("left").alias("left_token"), F.col("right").alias("right_token"), _r("weight", 4), "n")


def given_vectors(t):
    return t.raw("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))


E_VIEWS = {
    "coords": """SELECT vec_id AS item_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings""",
    "profile": """SELECT user_id, i, sum(greatest(score10 / 100, 0.1) * x) / sum(greatest(score10 / 100, 0.1)) AS x FROM ratings
        JOIN coords USING (item_id) GROUP BY 1, 2""",
    "cosines": """SELECT user_id, item_id, list_cosine_similarity(p.v, e.v) AS score FROM (SELECT user_id, list(x ORDER BY i) AS v
        FROM profile GROUP BY 1) p CROSS JOIN (SELECT item_id, list(x ORDER BY i) AS v FROM coords GROUP BY 1) e
        WHERE NOT EXISTS (FROM ratings r WHERE r.user_id = p.user_id AND r.item_id = e.item_id)""",
}


@query("user_profile", sql("SELECT user_id, i, round(x, 5) AS x FROM profile", "ratings",
                           coords=E_VIEWS["coords"], profile=E_VIEWS["profile"]))
def user_profile(t):
    return em.user_profiles(t.ratings(), given_vectors(t)).select("user_id", F.posexplode("vec").alias("i", "x")).select(
        "user_id", (F.col("i") + 1).cast("bigint").alias("i"), _r("x"))


def _top(score: str) -> str:
    return f"""SELECT user_id, item_id, round({score}, 5) AS score, row_number() OVER (PARTITION BY user_id ORDER BY
        {micro(score)} DESC, item_id) AS rank FROM cosines QUALIFY rank <= 10"""


@query("embedding_scores", sql(_top("score"), "ratings", **E_VIEWS))
def embedding_scores(t):
    return em.embedding_scores(t.ratings(), given_vectors(t)).select("user_id", "item_id", _r("score"), _big("rank"))


@query("embedding_scores_cf", sql(_top("score").replace("FROM cosines", "FROM (SELECT user_id, item_id, score + coalesce(bias, 0) AS "
       "score FROM cosines LEFT JOIN (SELECT item_id, sum(score10)::BIGINT * 0.03 / 100 AS bias FROM ratings WHERE score10 >= 80 "
       "GROUP BY 1) USING (item_id))"), "ratings", **E_VIEWS))
def embedding_scores_cf(t):
    ratings = materialize(t.ratings())
    return em.embedding_scores(ratings, given_vectors(t), popular=em.popularity(ratings)).select(
        "user_id", "item_id", _r("score"), _big("rank"))


@query("mean_vectors", sql("""SELECT source, i, round(avg(x), 5) AS x FROM documents JOIN coords ON item_id = doc_id GROUP BY 1, 2""",
                           coords=E_VIEWS["coords"]))
def mean_vectors(t):
    """Mean embedding of the documents of each source."""
    members = t.raw("documents").select(F.col("source").alias("id"), F.col("doc_id").alias("token"))
    means = em.mean_vectors(members, given_vectors(t).withColumnRenamed("item_id", "token"))
    return means.select(F.col("id").alias("source"), F.posexplode("vec").alias("i", "x")).select(
        "source", (F.col("i") + 1).cast("bigint").alias("i"), _r("x"))


@query("softmax_scores", sql("""SELECT user_id, item_id, round(exp(x - max(x) OVER (PARTITION BY user_id)) / sum(exp(x)) OVER
    (PARTITION BY user_id) * exp(max(x) OVER (PARTITION BY user_id)), 6) AS p FROM (SELECT user_id, item_id, score10 / 10 AS x
    FROM ratings)""", "ratings"))
def softmax_scores(t):
    """Softmax of each user's ratings."""
    rows = t.ratings().select("user_id", "item_id", (F.col("score10") / 10).alias("x"))
    return vx.softmax(rows, ["user_id"], "x", out="p").select("user_id", "item_id", F.round("p", 6).alias("p"))


_BIASED = """(SELECT user_id, item_id, score + {0} * coalesce(bias, 0) AS score FROM cosines LEFT JOIN (SELECT item_id,
    sum(score10)::BIGINT * 0.03 / 100 AS bias FROM ratings WHERE score10 >= 80 GROUP BY 1) USING (item_id))"""
_MODEL = """SELECT '{0}' AS algorithm, user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY """ + micro("score") + \
    """ DESC, item_id) AS rank FROM {1} QUALIFY rank <= 10"""


@query("model_lists", sql(" UNION ALL ".join([
    _MODEL.format("word2vec_content", "cosines"), _MODEL.format("glove_content", "cosines"),
    _MODEL.format("word2vec_cf", _BIASED.format(1)), _MODEL.format("glove_cf", _BIASED.format(1)),
    _MODEL.format("semantic_hybrid", _BIASED.format(0.4))]), "ratings", **E_VIEWS))
def model_lists(t):
    """The four single-model lists and their blend, all over the given vectors."""
    from marquee.operators.recommend import by_algorithm

    vectors = materialize(given_vectors(t))
    lists = em.model_lists(t.ratings(), dict.fromkeys(em.BLEND, vectors))
    return by_algorithm(lists).withColumn("rank", F.col("rank").cast("bigint"))


_NINE = " UNION ALL ".join([
    "SELECT 'hot' AS algorithm, user_id, item_id, rank FROM hot_all", "SELECT 'baseline_cf', user_id, item_id, rank FROM cf",
    "SELECT 'baseline_content', user_id, item_id, rank FROM content",
    "SELECT 'baseline_content', user_id, item_id, rank FROM hot_all WHERE user_id NOT IN (SELECT user_id FROM content)",
    "SELECT 'baseline_hybrid', user_id, item_id, rank FROM hybrid",
    _MODEL.format("word2vec_content", "cosines"), _MODEL.format("glove_content", "cosines"),
    _MODEL.format("word2vec_cf", _BIASED.format(1)), _MODEL.format("glove_cf", _BIASED.format(1)),
    _MODEL.format("semantic_hybrid", _BIASED.format(0.4))])


@query("recs_by_algorithm", sql(_NINE, "ratings", "items", **chain("hybrid"), **E_VIEWS))
def recs_by_algorithm(t):
    """The lists of all nine names; the models' vectors are the given ones."""
    from marquee.operators.recommend import by_algorithm
    from marquee.plans.recommend_queries import baseline_lists

    ratings, vectors = materialize(t.ratings()), materialize(given_vectors(t))
    lists = baseline_lists(t, ratings) | em.model_lists(ratings, dict.fromkeys(em.BLEND, vectors))
    return by_algorithm(lists).withColumn("rank", F.col("rank").cast("bigint"))


@query("vector_cosine", """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c::DOUBLE[]), 5) AS cos FROM embeddings,
    (SELECT embedding AS c FROM embeddings WHERE vec_id = 0)""")
def vector_cosine(t):
    """Cosine of every vector to the first one."""
    first = given_vectors(t).filter(F.col("item_id") == 0).select(F.col("vec").alias("c"), F.lit(0).alias("one"))
    rows = given_vectors(t).withColumn("one", F.lit(0)).join(F.broadcast(first), "one")
    return rows.select(F.col("item_id").alias("vec_id"), F.round(vx.cosine(F.col("vec"), F.col("c")), 5).alias("cos"))


@query("item_vectors_word2vec")
def item_vectors_word2vec(t):
    return em.text_vectors(t.items(summary=True), model="word2vec")


@query("item_vectors_glove")
def item_vectors_glove(t):
    return em.text_vectors(t.items(summary=True), model="glove")


@query("interaction_vectors_word2vec")
def interaction_vectors_word2vec(t):
    return em.interaction_vectors(behaviors(t), model="word2vec")


@query("interaction_vectors_glove")
def interaction_vectors_glove(t):
    return em.interaction_vectors(behaviors(t), model="glove")
