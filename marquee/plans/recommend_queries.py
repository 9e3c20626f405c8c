"""Similarity and recommendation queries for all users and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.text import ENGLISH_STOP_WORDS
from marquee.operators import catalog as cat, ranking as rk, recommend as rec, similarity as sim
from marquee.plans.registry import half_up, half_up_sql, query, sql
from marquee.session import materialize

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def micro(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5)"


# Views shared by the oracle statements.
V = {
    "pairs": """SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS n, sum(a.score10)::BIGINT AS sx,
        sum(b.score10)::BIGINT AS sy, sum(a.score10 * a.score10)::BIGINT AS sxx, sum(b.score10 * b.score10)::BIGINT AS syy,
        sum(a.score10 * b.score10)::BIGINT AS sxy FROM ratings a JOIN ratings b ON a.item_id = b.item_id
        AND a.user_id <> b.user_id GROUP BY 1, 2""",
    "sims": """SELECT user_a, user_b, n AS n_common, (n * sxy - sx * sy) / (sqrt((n * sxx - sx * sx)::DOUBLE) *
        sqrt((n * syy - sy * sy)::DOUBLE)) AS sim FROM pairs WHERE n >= 2 AND n * sxy - sx * sy > 0""",
    "near": f"""SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY user_a ORDER BY {micro('sim')} DESC, user_b) <= 20""",
    "cf_map": """SELECT user_a AS user_id, r.item_id, sum(sim * score10 / 10) AS score FROM near JOIN ratings r ON
        r.user_id = user_b AND score10 >= 80 WHERE NOT EXISTS (FROM ratings w WHERE w.user_id = user_a AND
        w.item_id = r.item_id) GROUP BY 1, 2""",
    "cf": f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {micro('score')} DESC, item_id) AS rank FROM cf_map
        QUALIFY rank <= 10""",
    "tags": """SELECT DISTINCT item_id, tag FROM (SELECT item_id, 't:' || unnest(string_split(types, '/')) AS tag FROM items
        UNION ALL SELECT item_id, 'd:' || directors FROM items UNION ALL SELECT item_id, 'c:' || country FROM items)""",
    "tag_sim": """SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) / (sqrt(any_value(a.n)) * sqrt(any_value(b.n)))
        AS sim FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM tags) a JOIN (SELECT *, count(*) OVER
        (PARTITION BY item_id) AS n FROM tags) b ON a.tag = b.tag GROUP BY 1, 2""",
    "content": f"""SELECT user_id, item_b AS item_id, sum(sim) / any_value(n_liked) AS score, row_number() OVER (PARTITION BY
        user_id ORDER BY {micro('sum(sim) / any_value(n_liked)')} DESC, item_b) AS rank FROM (SELECT user_id, item_id, count(*)
        OVER (PARTITION BY user_id) AS n_liked FROM ratings WHERE score10 >= 80) l JOIN tag_sim ON item_a = l.item_id
        WHERE NOT EXISTS (FROM ratings w WHERE w.user_id = l.user_id AND w.item_id = item_b) GROUP BY 1, 2 QUALIFY rank <= 10""",
    "tokens": f"""SELECT item_id, unnest(list_distinct(list_transform(string_split(types, '/') || [directors, country] ||
        list_filter(regexp_split_to_array(translate(coalesce(summary, ''), '，。', '  '), '{SPACE}'), lambda x: x <> ''),
        lambda x: lower(x)))) AS tok FROM items""",
    "sets": "SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM tokens",
    "jac": """SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS sim
        FROM sets a JOIN sets b ON a.tok = b.tok GROUP BY 1, 2""",
    "jac_map": """SELECT user_id, item_b AS item_id, sum(sim) / any_value(n_liked) AS score FROM (SELECT user_id, item_id,
        count(*) OVER (PARTITION BY user_id) AS n_liked FROM ratings WHERE score10 >= 80) l JOIN jac ON item_a = l.item_id
        WHERE NOT EXISTS (FROM ratings w WHERE w.user_id = l.user_id AND w.item_id = item_b) GROUP BY 1, 2""",
    "hot": "SELECT item_id, row_number() OVER (ORDER BY rate DESC, comment_len DESC, title, item_id) AS rank FROM items "
           "QUALIFY rank <= 10",
    "raters": "SELECT DISTINCT user_id FROM ratings",
    "hot_all": "SELECT user_id, item_id, rank FROM raters CROSS JOIN hot",
    "hybrid": """SELECT user_id, item_id, source, row_number() OVER (PARTITION BY user_id ORDER BY priority, old, item_id) AS rank
        FROM (SELECT user_id, item_id, arg_min(source, priority) AS source, min(priority) AS priority, arg_min(rank, priority)
        AS old FROM (SELECT user_id, item_id, rank, 0 AS priority, 'baseline_cf' AS source FROM cf UNION ALL
        SELECT user_id, item_id, rank, 1, 'baseline_content' FROM content UNION ALL
        SELECT user_id, item_id, rank, 2, 'hot' FROM hot_all) GROUP BY 1, 2) QUALIFY rank <= 10""",
    "ucos": """SELECT user_a, user_b, sxy / (sqrt(na::DOUBLE) * sqrt(nb::DOUBLE)) AS sim FROM pairs JOIN (SELECT user_id AS user_a,
        sum(score10 * score10)::BIGINT AS na FROM ratings GROUP BY 1) USING (user_a) JOIN (SELECT user_id AS user_b,
        sum(score10 * score10)::BIGINT AS nb FROM ratings GROUP BY 1) USING (user_b)""",
    "icos": """SELECT item_a, item_b, sxy / (sqrt(na::DOUBLE) * sqrt(nb::DOUBLE)) AS sim FROM (SELECT a.item_id AS item_a,
        b.item_id AS item_b, sum(a.score10 * b.score10)::BIGINT AS sxy FROM ratings a JOIN ratings b ON a.user_id = b.user_id
        AND a.item_id <> b.item_id GROUP BY 1, 2) JOIN (SELECT item_id AS item_a, sum(score10 * score10)::BIGINT AS na
        FROM ratings GROUP BY 1) USING (item_a) JOIN (SELECT item_id AS item_b, sum(score10 * score10)::BIGINT AS nb
        FROM ratings GROUP BY 1) USING (item_b)""",
    "nearest": f"""SELECT user_a AS user_id, r.item_id, max_by(sim * score10 / 10, {{'m': {micro('sim')}, 'u': -user_b}}) AS score
        FROM ucos JOIN ratings r ON r.user_id = user_b GROUP BY 1, 2""",
    "terms": f"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text),
        '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents) WHERE term NOT IN ({', '.join(f"'{w}'" for w in ENGLISH_STOP_WORDS)})
        GROUP BY 1, 2""",
    "weights": """SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, term,
        tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM terms)""",
    "text_sim": """SELECT a.doc_id AS item_a, b.doc_id AS item_b, sum(a.w * b.w) AS sim FROM weights a JOIN weights b ON
        a.term = b.term AND a.doc_id <> b.doc_id GROUP BY 1, 2""",
}
_NEEDS = {"sims": ["pairs"], "near": ["sims"], "cf_map": ["near"], "cf": ["cf_map"], "tag_sim": ["tags"], "content": ["tag_sim"],
          "sets": ["tokens"], "jac": ["sets"], "jac_map": ["jac"], "hot_all": ["hot", "raters"],
          "hybrid": ["cf", "content", "hot_all"], "ucos": ["pairs"], "nearest": ["ucos"], "weights": ["terms"],
          "text_sim": ["weights"]}


def chain(*names: str) -> dict[str, str]:
    """The named views after everything they need."""
    out: dict[str, str] = {}
    for name in names:
        for need in _NEEDS.get(name, []):
            out.update({k: v for k, v in chain(need).items() if k not in out})
        out[name] = V[name]
    return out


def _big(name: str):
    return F.col(name).cast("bigint").alias(name)


def _r(name: str, digits: int = 5):
    return F.round(name, digits).alias(name)


@query("user_similarity_pearson", sql("SELECT user_a, user_b, n_common, round(sim, 5) AS sim FROM sims", "ratings", **chain("sims")))
def user_similarity_pearson(t):
    return sim.user_similarity_pearson(t.ratings()).select("user_a", "user_b", "n_common", _r("sim"))


@query("user_cf", sql("SELECT user_id, item_id, rank, round(score, 5) AS score FROM cf", "ratings", **chain("cf")))
def user_cf(t):
    return rec.user_cf(t.ratings()).select("user_id", "item_id", _big("rank"), _r("score"))


@query("cf_map_full", sql("""SELECT user_a AS user_id, r.item_id, round(sum(sim * score10 / 10), 4) AS score FROM sims JOIN
    ratings r ON r.user_id = user_b AND score10 >= 80 WHERE NOT EXISTS (FROM ratings w WHERE w.user_id = user_a AND
    w.item_id = r.item_id) GROUP BY 1, 2""", "ratings", **chain("sims")))
def cf_map_full(t):
    """Collaborative scores over all positive neighbours, every user and item."""
    ratings = materialize(t.ratings())
    return rec.cf_scores(sim.user_similarity_pearson(ratings), ratings, ratings).withColumn("score", F.round("score", 4))


@query("similar_items", sql(f"""SELECT item_a, item_b, round(sim, 5) AS sim, row_number() OVER (PARTITION BY item_a ORDER BY
    {micro('sim')} DESC, item_b) AS rank FROM tag_sim WHERE item_a <> item_b QUALIFY rank <= 6""", "items", **chain("tag_sim")))
def similar_items(t):
    return sim.similar_items(t.items()).select("item_a", "item_b", _r("sim"), _big("rank"))


@query("item_jaccard", sql(f"""SELECT item_a, item_b, round(sim, 5) AS sim, row_number() OVER (PARTITION BY item_a ORDER BY
    {micro('sim')} DESC, item_b) AS rank FROM jac WHERE item_a <> item_b QUALIFY rank <= 6""", "items", **chain("jac")))
def item_jaccard(t):
    return sim.item_jaccard(t.items(summary=True)).select("item_a", "item_b", _r("sim"), _big("rank"))


@query("content_rec", sql("SELECT user_id, item_id, rank, round(score, 5) AS score FROM content", "ratings", "items", **chain("content")))
def content_rec(t):
    return rec.content_rec(t.ratings(), t.items()).select("user_id", "item_id", _big("rank"), _r("score"))


@query("content_rec_jaccard", sql(f"""SELECT user_id, item_id, {half_up_sql('score', 5)} AS score, row_number() OVER (PARTITION BY
    user_id ORDER BY {micro('score')} DESC, item_id) AS rank FROM jac_map QUALIFY rank <= 10""", "ratings", "items", **chain("jac_map")))
def content_rec_jaccard(t):
    return rec.content_rec_jaccard(t.ratings(), t.items(summary=True)).select(
        "user_id", "item_id", _big("rank"), half_up(F.col("score"), 5).alias("score"))


@query("weighted_merge", sql(f"""SELECT user_id, item_id, round(score, 3) AS score, row_number() OVER (PARTITION BY user_id ORDER BY
    {micro('score')} DESC, item_id) AS rank FROM (SELECT user_id, item_id, sum(s) AS score FROM (SELECT user_id, item_id,
    0.55 * score AS s FROM cf_map UNION ALL SELECT user_id, item_id, 0.45 * score FROM jac_map) GROUP BY 1, 2) QUALIFY rank <= 10""",
    "ratings", "items", **chain("cf_map", "jac_map")))
def weighted_merge(t):
    ratings = materialize(t.ratings())
    cf = rec.cf_scores(sim.user_similarity_pearson(ratings, k=20), ratings, ratings)
    return rec.jaccard_cf_hybrid(ratings, t.items(summary=True), cf, n=10).select("user_id", "item_id", _big("rank"),
                                                                                    _r("score", 3))


@query("user_cosine", sql(f"""SELECT user_a, user_b, round(sim, 5) AS sim FROM ucos QUALIFY row_number() OVER (PARTITION BY user_a
    ORDER BY {micro('sim')} DESC, user_b) <= 20""", "ratings", **chain("ucos")))
def user_cosine(t):
    return sim.user_cosine(t.ratings(), k=20).select("user_a", "user_b", _r("sim"))


@query("item_cosine", sql(f"""SELECT item_a, item_b, round(sim, 5) AS sim FROM icos QUALIFY row_number() OVER (PARTITION BY item_a
    ORDER BY {micro('sim')} DESC, item_b) <= 20""", "ratings", **chain("icos")))
def item_cosine(t):
    return sim.item_cosine(t.ratings(), k=20).select("item_a", "item_b", _r("sim"))


@query("item_cf", sql(f"""SELECT item_a, item_b, round(sim, 5) AS sim, row_number() OVER (PARTITION BY item_a ORDER BY
    {micro('sim')} DESC, item_b) AS rank FROM icos QUALIFY rank <= 5""", "ratings", **chain("icos")))
def item_cf(t):
    return rec.item_cf(t.ratings()).select("item_a", "item_b", _r("sim"), _big("rank"))


@query("cf_nearest", sql(f"""SELECT user_id, item_id, round(score, 5) AS score, row_number() OVER (PARTITION BY user_id ORDER BY
    {micro('score')} DESC, item_id) AS rank FROM nearest QUALIFY rank <= 5""", "ratings", **chain("nearest")))
def cf_nearest(t):
    return rec.cf_nearest(t.ratings()).select("user_id", "item_id", _r("score"), _big("rank"))


@query("tfidf_similar", sql(f"""SELECT item_a, item_b, round(sim, 5) AS sim, row_number() OVER (PARTITION BY item_a ORDER BY
    {micro('sim')} DESC, item_b) AS rank FROM text_sim QUALIFY rank <= 10""", **chain("text_sim")))
def tfidf_similar(t):
    texts = t.raw("documents").select(F.col("doc_id").alias("item_id"), "text")
    return sim.tfidf_similar(texts).select("item_a", "item_b", _r("sim"), _big("rank"))


_SCALED = """SELECT user_id, item_id, {0} * CASE WHEN hi > lo THEN (m - lo) / (hi - lo) ELSE 0 END AS s FROM (SELECT *,
    min(m) OVER (PARTITION BY user_id) AS lo, max(m) OVER (PARTITION BY user_id) AS hi FROM (SELECT user_id, item_id,
    floor(score * 1e6 + 0.5) AS m FROM {1}))"""


@query("minmax_blend", sql(f"""SELECT user_id, item_id, round(sum(s), 5) AS score FROM ({_SCALED.format(0.6, 'cf')} UNION ALL
    {_SCALED.format(0.4, 'content')}) GROUP BY 1, 2""", "ratings", "items", **chain("cf", "content")))
def minmax_blend(t):
    ratings = materialize(t.ratings())
    parts = {"cf": materialize(rec.user_cf(ratings)), "content": materialize(rec.content_rec(ratings, t.items()))}
    return rk.minmax_blend(parts, {"cf": 0.6, "content": 0.4}).withColumn("score", F.round("score", 5))


def baseline_lists(t, ratings):
    """Ranked lists of the four baselines by name."""
    users = materialize(ratings.select("user_id").distinct())
    hot = rec.hot_for_users(users, cat.hot_items(t.items(comment_len=True)))
    cf = materialize(rec.user_cf(ratings))
    content = materialize(rec.content_rec(ratings, t.items()))
    return {"hot": hot, "baseline_content": rec.content_or_hot(content, hot), "baseline_cf": cf,
            "baseline_hybrid": rec.baseline_hybrid(cf, content, hot)}


@query("baseline_hybrid", sql("SELECT user_id, item_id, source, rank FROM hybrid", "ratings", "items", **chain("hybrid")))
def baseline_hybrid(t):
    return baseline_lists(t, materialize(t.ratings()))["baseline_hybrid"].select("user_id", "item_id", "source", _big("rank"))


@query("priority_merge", sql("""SELECT user_id, item_id, source, row_number() OVER (PARTITION BY user_id ORDER BY priority, old,
    item_id) AS rank FROM (SELECT user_id, item_id, arg_min(source, priority) AS source, min(priority) AS priority,
    arg_min(rank, priority) AS old FROM (SELECT user_id, item_id, rank, 0 AS priority, 'likes' AS source FROM (SELECT *,
    row_number() OVER (PARTITION BY user_id ORDER BY score10 DESC, item_id) AS rank FROM ratings QUALIFY rank <= 3) UNION ALL
    SELECT user_id, item_id, rank, 1, 'hot' FROM hot_all) GROUP BY 1, 2) QUALIFY rank <= 10""", "ratings", "items", **chain("hot_all")))
def priority_merge(t):
    ratings = materialize(t.ratings())
    best = rk.top_per_group(ratings, ["user_id"], [F.col("score10").desc(), F.col("item_id")], n=3)
    hot = rec.hot_for_users(ratings.select("user_id").distinct(), cat.hot_items(t.items(comment_len=True)))
    return rk.priority_merge([("likes", best), ("hot", hot)], n=10).select("user_id", "item_id", "source", _big("rank"))


@query("decorate_scores", sql("""SELECT user_id, cf.item_id, title, rate, round(score, 4) AS score, '相似用户高分喜欢这部电影（得分 ' ||
    printf('%.3f', score) || '）' AS reason FROM cf JOIN items ON items.item_id = cf.item_id""", "ratings", "items", **chain("cf")))
def decorate_scores(t):
    return cat.decorate_scores(rec.user_cf(t.ratings()), t.items(), reason="相似用户高分喜欢这部电影")
