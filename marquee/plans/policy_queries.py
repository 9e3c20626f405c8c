"""Evaluation, policy and end-to-end queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marquee.operators import catalog as cat, evaluation as ev, experience as xp, features as ft, history as hs, \
    interactions as ix, policy as po, ranking as rk, recommend as rec, versions as ver
from marquee.plans import evaluate as evl
from marquee.plans.feature_queries import _FEATURES, features_of
from marquee.plans.ingest_queries import _ACTIVE, _RUNS, _activations, _runs, _versions
from marquee.plans.recommend_queries import V, _big, _r, chain, micro
from marquee.plans.registry import behaviors, half_up, half_up_sql, query, sql
from marquee.session import materialize, written

_SPLIT = """SELECT *, count(*) FILTER (score10 >= 80) OVER (PARTITION BY user_id) AS n_pos, CASE WHEN score10 >= 80 AND
    row_number() OVER (PARTITION BY user_id, score10 >= 80 ORDER BY ts DESC, item_id DESC) = 1 THEN 'target' ELSE 'train' END
    AS split FROM ratings QUALIFY n_pos >= 2"""


@query("eval_split", sql("SELECT user_id, item_id, score10, split FROM parts", "ratings", parts=_SPLIT))
def eval_split(t):
    return ev.eval_split(t.ratings()).select("user_id", "item_id", "score10", "split")


def _lists():
    """Ranked lists of the four baselines for the held-out users as SQL views."""
    train_pairs = V["pairs"].replace("FROM ratings a JOIN ratings b", "FROM train a JOIN ratings b")
    views = {
        "parts": _SPLIT,
        "train": "SELECT * FROM parts WHERE split = 'train'",
        "targets": "SELECT user_id, item_id FROM parts WHERE split = 'target'",
        "pairs": train_pairs, "sims": V["sims"],
        "cf_map": V["cf_map"].replace("FROM near JOIN", "FROM sims JOIN").replace("FROM ratings w", "FROM train w"),
        "tokens": V["tokens"], "sets": V["sets"], "jac": V["jac"],
        "jac_map": V["jac_map"].replace("FROM ratings", "FROM train"),
        "merged": """SELECT user_id, item_id, sum(s) AS score FROM (SELECT user_id, item_id, 0.55 * score AS s FROM cf_map UNION ALL
            SELECT user_id, item_id, 0.45 * score FROM jac_map) GROUP BY 1, 2""",
    }
    top = "SELECT '{0}' AS algorithm, user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY " + micro("score") + \
          " DESC, item_id) AS rank FROM {1} QUALIFY rank <= 5"
    views["hot_ten"] = V["hot"]
    views["ranked"] = " UNION ALL ".join([
        """SELECT 'hot' AS algorithm, user_id, hot_ten.item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank
        FROM targets CROSS JOIN hot_ten WHERE NOT EXISTS (FROM train w WHERE w.user_id = targets.user_id AND w.item_id =
        hot_ten.item_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hot_ten.rank) <= 5""",
        top.format("baseline_content", "jac_map"), top.format("baseline_cf", "cf_map"), top.format("baseline_hybrid", "merged")])
    return views


_LISTS = _lists()
_DIVERSITY = """SELECT algorithm, user_id, round(avg(greatest(0, 1 - cos)), 4) AS diversity FROM (SELECT a.algorithm, a.user_id,
    a.item_id AS x, b.item_id AS y, coalesce(sum(fa.value * fb.value), 0) / (any_value(na.n) * any_value(nb.n)) AS cos
    FROM ranked a JOIN ranked b ON a.algorithm = b.algorithm AND a.user_id = b.user_id AND a.rank < b.rank
    JOIN norms na ON na.item_id = a.item_id JOIN norms nb ON nb.item_id = b.item_id
    JOIN features fa ON fa.item_id = a.item_id LEFT JOIN features fb ON fb.item_id = b.item_id AND fb.slot = fa.slot
    GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""
_NORMS = "SELECT item_id, sqrt(sum(value * value)) AS n FROM features GROUP BY 1"


_EVALUATED = """SELECT algorithm, round(hits / (n_users * 5), 4) AS precision_at_k, round(hits / n_users, 4)
    AS recall_at_k, round(ndcg / n_users, 4) AS ndcg_at_k, round(covered / (SELECT count(*) FROM part), 4) AS coverage,
    round(spread / n_users, 4) AS diversity FROM (SELECT algorithm, count(t.item_id) AS hits, coalesce(sum(CASE WHEN t.item_id
    IS NOT NULL THEN 1 / log2(rank + 1) END), 0) AS ndcg, count(DISTINCT ranked.item_id) AS covered FROM ranked LEFT JOIN targets t ON
    t.user_id = ranked.user_id AND t.item_id = ranked.item_id GROUP BY 1) JOIN (SELECT algorithm, sum(diversity) AS spread
    FROM spreads GROUP BY 1) USING (algorithm) CROSS JOIN (SELECT count(*) AS n_users FROM targets)"""
_EVALUATION = dict(**_LISTS, features=_FEATURES, norms=_NORMS, spreads=_DIVERSITY)


@query("evaluate_baselines", sql(_EVALUATED, "ratings", "items", **_EVALUATION))
def evaluate_baselines(t):
    return evl.evaluate(t.ratings(), t.items(summary=True, comment_len=True), features_of(t), semantic=False)


def _top_rated_lists(t):
    """Each user's five best rated items as a ranked list."""
    return rk.top_per_group(t.ratings(), ["user_id"], [F.col("score10").desc(), F.col("item_id")], n=5).select(
        F.lit("rated").alias("algorithm"), "user_id", "item_id", "rank")


@query("list_diversity", sql("SELECT user_id, round(diversity, 3) AS diversity FROM spreads", "ratings", "items", features=_FEATURES,
    norms=_NORMS, ranked="""SELECT 'rated' AS algorithm, user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY
    score10 DESC, item_id) AS rank FROM ratings QUALIFY rank <= 5""", spreads=_DIVERSITY))
def list_diversity(t):
    return ev.list_diversity(_top_rated_lists(t), features_of(t)).select("user_id", _r("diversity", 3))


@query("eval_metrics", sql("""SELECT user_id, round(1 / log2(rank + 1), 6) AS ndcg FROM (SELECT user_id, item_id, row_number() OVER
    (PARTITION BY user_id ORDER BY score10 DESC, item_id) AS rank FROM ratings QUALIFY rank <= 5) r JOIN (SELECT user_id, item_id
    FROM parts WHERE split = 'target') USING (user_id, item_id)""", "ratings", parts=_SPLIT))
def eval_metrics(t):
    targets = ev.eval_split(t.ratings()).filter(F.col("split") == "target")
    return ev.list_metrics(_top_rated_lists(t), targets.select("user_id", "item_id"), k=5).select("user_id", _r("ndcg", 6))


@query("evaluate")
def evaluate(t):
    return evl.evaluate(t.ratings(), t.items(summary=True, comment_len=True), features_of(t))


def _save(t):
    metrics = evl.evaluate(t.ratings(), t.items(summary=True, comment_len=True), features_of(t), semantic=False)
    return ver.save_run(metrics, run_id=1, k=5, note="", created_at="2024-02-01 00:00:00")


@query("experiment_snapshot", sql(f"SELECT 1::BIGINT AS id, * FROM ({_EVALUATED})", "ratings", "items", **_EVALUATION))
def experiment_snapshot(t):
    return ver.latest_metrics(_save(t))


_SIZES = """SELECT *, round(n_ratings / greatest(n_users * n_items, 1), 4) AS density FROM (SELECT (SELECT count(*) FROM customer)
    AS n_users, (SELECT count(*) FROM part) AS n_items, (SELECT count(*) FROM behaviors WHERE behavior_type = 1 AND score10 IS NOT
    NULL) AS n_ratings)"""


@query("overview_report", sql(f"""SELECT 'counts' AS section, 'n_users' AS name, n_users::DOUBLE AS value FROM sizes
    UNION ALL SELECT 'counts', 'n_items', n_items FROM sizes UNION ALL SELECT 'counts', 'n_ratings', n_ratings FROM sizes
    UNION ALL SELECT 'counts', 'density', density FROM sizes UNION ALL SELECT 'active_model', version_tag, id FROM ({_ACTIVE})
    UNION ALL SELECT 'evaluation', algorithm, u FROM runs WHERE id = (SELECT max(id) FROM runs)
    UNION ALL SELECT 'run', strftime(DATE '2024-01-01' + id::INT, '%Y-%m-%d 00:00:00'), id FROM (SELECT DISTINCT id FROM runs ORDER BY id DESC LIMIT 10)""",
    "behaviors", runs=_RUNS, sizes=_SIZES))
def overview_report(t):
    metrics = ver.latest_metrics(_runs(t))
    return evl.overview_report(t.users(), t.raw("part"), behaviors(t), metrics,
                               ver.active_version(_versions(t), _activations(t)), _runs(t))


_POOL = """SELECT user_id, r.item_id, score10 / 1000 AS policy, coverage_bonus AS cover, score10 / 1000 + 0.12 * coverage_bonus AS base
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score10 DESC, item_id) AS place FROM ratings QUALIFY place <= 30) r
    JOIN bonus ON bonus.item_id = r.item_id"""
_COS = """SELECT a.user_id, a.item_id AS x, b.item_id AS y, coalesce(sum(fa.value * fb.value), 0) / (any_value(na.n) * any_value(nb.n))
    AS cos FROM pool a JOIN pool b ON a.user_id = b.user_id JOIN norms na ON na.item_id = a.item_id JOIN norms nb ON nb.item_id = b.item_id
    JOIN features fa ON fa.item_id = a.item_id LEFT JOIN features fb ON fb.item_id = b.item_id AND fb.slot = fa.slot GROUP BY 1, 2, 3"""
_P9 = "floor(({0}) * 1e9 + 0.5)"
_SHOWN = "CASE WHEN {0} = 0 THEN 1 ELSE floor(greatest(0, 1 - near / greatest({0}, 1)) * 1e4 + 0.5) / 1e4 END"


def _greedy_sql(n: int) -> str:
    """``n`` picks one after the other; ``near`` sums an item's cosines to those already picked."""
    steps = ["rest0 AS MATERIALIZED (SELECT user_id, item_id, base, 0.0::DOUBLE AS near FROM pool)"]
    for k in range(n):
        bonus = _SHOWN.format(k)
        steps.append(f"""pick{k} AS MATERIALIZED (SELECT user_id, item_id, {k + 1}::BIGINT AS rank, {bonus} AS div FROM rest{k} QUALIFY row_number()
            OVER (PARTITION BY user_id ORDER BY {_P9.format(f'base + 0.18 * ({bonus})')} DESC, {_P9.format('base')} DESC, item_id) = 1)""")
        steps.append(f"""rest{k + 1} AS MATERIALIZED (SELECT r.user_id, r.item_id, r.base, r.near + c.cos AS near FROM rest{k} r JOIN pick{k} p ON
            p.user_id = r.user_id AND p.item_id <> r.item_id JOIN cosines c ON c.user_id = r.user_id AND c.x = r.item_id AND c.y = p.item_id)""")
    rows = " UNION ALL ".join(f"SELECT user_id, item_id, rank, round(div, 3) AS div FROM pick{k}" for k in range(n))
    return f"SELECT * FROM (WITH {', '.join(steps)} {rows})"


def _bonus(t):
    return cat.coverage_bonus(t.raw("part").select(F.col("p_partkey").alias("item_id")), cat.exposure(behaviors(t)))


@query("mmr_rerank", sql(_greedy_sql(10), "ratings", "items", "bonus", features=_FEATURES, norms=_NORMS, pool=_POOL, cosines=_COS))
def mmr_rerank(t):
    pool = rk.top_per_group(t.ratings(), ["user_id"], [F.col("score10").desc(), F.col("item_id")], n=30).select(
        "user_id", "item_id", (F.col("score10") / 1000).alias("policy_score")).join(_bonus(t), "item_id")
    return po.mmr_rerank(pool, features_of(t), n=10, epsilon=0.0).select(
        "user_id", "item_id", _big("rank"), (F.floor(F.col("diversity_bonus") * 1000 + 0.5) / 1000).alias("div"))


@query("diversity_bonus", sql("""SELECT user_id, x AS item_id, round(greatest(0, 1 - avg(cos)), 3) AS diversity_bonus FROM cosines
    WHERE x <> y GROUP BY 1, 2""", "ratings", "items", "bonus", features=_FEATURES, norms=_NORMS, pool=_POOL, cosines=_COS))
def diversity_bonus(t):
    """1 - mean cosine of each pool item to the rest of its pool, from the pool's summed unit vectors."""
    pool = materialize(rk.top_per_group(t.ratings(), ["user_id"], [F.col("score10").desc(), F.col("item_id")], n=30).select(
        "user_id", "item_id"))
    return po.pool_diversity(pool, features_of(t)).select("user_id", "item_id", _r("diversity_bonus", 3))


def _states(t, features):
    return ft.pack_entries(ft.rating_profiles(t.ratings(), features), "user_id")


@query("policy_scores")
def policy_scores(t):
    features = materialize(features_of(t))
    pool = t.ratings().select("user_id", "item_id")
    return po.policy_scores(pool, _states(t, features), features, po.Policy.initial())


@query("policy_rank")
def policy_rank(t):
    features = materialize(features_of(t))
    pool = t.ratings().select("user_id", "item_id")
    return po.policy_rank(pool, _states(t, features), features, po.Policy.initial(), n=10)


@query("policy_training")
def policy_training(t):
    """Value error and ratio-weighted reward per epoch of a policy trained on all accepted behaviours."""
    features = materialize(features_of(t))
    valid = materialize(behaviors(t))
    n_items = t.raw("part").count()
    rows = xp.experience_rows(valid, materialize(_bonus(t))).withColumn("old_prob", F.lit(1.0 / n_items))
    states = ft.pack_entries(ft.user_features(valid, features, as_of="2024-02-01 00:00:00"), "user_id")
    _, log = po.train(rows, states, features, po.Policy.initial())
    return t.spark.createDataFrame([(r["epoch"], r["n"], r["value_loss"], r["gain"]) for r in log],
                                   "epoch int, n long, value_loss double, gain double")


_GAIN, _SHIFT = (0.5, -0.25, 1.0, -0.75), (0.1, -0.2, 0.3, 0.0)


def _formula_policy() -> po.Policy:
    """Parameters by a closed formula, so that SQL can compute the same probabilities."""
    slot = np.arange(ft.SLOTS)
    half = np.outer(np.array(_GAIN)[slot % 4], (slot + 1) / ft.SLOTS / 2)
    return po.Policy(np.hstack([half, half]), np.array(_SHIFT)[slot % 4], np.zeros(po.STATE), 0.0)


_BEFORE = "FILTER (i.event_id <> j.event_id)"
_FADE = "least(1, greatest(0.05, pow(0.5, (j.at - i.at) / 3600.0 / 168.0)))"


def _around(what: str) -> str:
    """Sum of a state's values, plain and weighted by slot + 1, from the users' earlier events."""
    share = "coalesce(sum(i.w * {0} * i.{1}) {2}, 0) / greatest(coalesce(sum(abs(i.w) * {0}) {2}, 0), 1e-6)"
    counts = f"""count(*) FILTER (i.behavior_type = 1 {what}) AS n1, count(*) FILTER (i.behavior_type = 2 {what}) AS n2,
        count(*) FILTER (i.behavior_type = 3 {what}) AS n3, coalesce(sum(i.score10) FILTER (i.behavior_type = 1 {what}), 0) AS s"""
    only = _BEFORE if what else ""
    return f"""SELECT event_id, item_id, p + a + b + c + d AS total, q + 351 * a + 352 * b + 353 * c + 354 * d AS dot FROM (SELECT event_id,
        item_id, p, q, least(s / (10 * greatest(n1, 1)), 10) / 10 AS a, least(n1, 200) / 200 AS b, least(n2, 200) / 200 AS c,
        least(n3, 500) / 500 AS d FROM (SELECT j.event_id, any_value(j.item_id) AS item_id, {share.format(_FADE, 'plain', only)} AS p,
        {share.format(_FADE, 'placed', only)} AS q, {counts} FROM base j JOIN base i ON i.user_id = j.user_id AND (i.ts < j.ts OR
        i.ts = j.ts AND i.event_id <= j.event_id) GROUP BY 1))"""


_EXPERIENCE = dict(
    features=_FEATURES,
    sums="SELECT item_id, coalesce(sum(value) FILTER (slot < 350), 0) AS plain, coalesce(sum(value * (slot + 1)) FILTER (slot < 350), 0) "
         "AS placed, " + ", ".join(f"coalesce(sum(value) FILTER (slot % 4 = {g}), 0) AS f{g}" for g in range(4)) + " FROM features GROUP BY 1",
    base="""SELECT b.*, floor(epoch(ts)) AS at, plain, placed, CASE WHEN behavior_type = 1 THEN greatest(-1, least(1, (score10 / 10 - 5) / 5))
        WHEN behavior_type = 2 THEN 0.8 ELSE 0.4 END AS w FROM behaviors b JOIN sums USING (item_id)""",
    before=_around("AND i.event_id <> j.event_id"), after=_around(""),
    logits="SELECT b.event_id, b.item_id AS own, i.item_id, (" + " + ".join(
        f"f{g} * ((exp(2 * ({c} * dot / 354 + {s})) - 1) / (exp(2 * ({c} * dot / 354 + {s})) + 1))"
        for g, (c, s) in enumerate(zip(_GAIN, _SHIFT))) + ") / sqrt(354) AS l FROM before b CROSS JOIN sums i",
    probs="SELECT event_id, sum(CASE WHEN own = item_id THEN exp(l) END) / sum(exp(l)) AS old_prob FROM logits GROUP BY 1")


@query("experience_states", sql(f"""SELECT b.event_id AS id, b.user_id, b.item_id, {half_up_sql('x.total', 5)} AS state_sum,
    {half_up_sql('x.dot', 3)} AS state_dot, {half_up_sql('y.total', 5)} AS next_sum, {half_up_sql('y.dot', 3)} AS next_dot,
    {half_up_sql('old_prob', 9)} AS old_prob FROM base b JOIN before x USING (event_id) JOIN after y USING (event_id)
    JOIN probs USING (event_id)""", "behaviors", "items", **_EXPERIENCE))
def experience_states(t):
    """Experience rows with the state before and after each event, and the policy's probability of its item then.

    States are shown by two linear sums of their entries.
    """
    features, valid = materialize(features_of(t)), materialize(behaviors(t))
    plain = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + e["value"])
    placed = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + e["value"] * (e["slot"] + 1))
    shown = lambda c: F.struct(plain(c).alias("sum"), placed(c).alias("dot"))
    # both sums are taken where a state is formed; the state before stays for the policy, the state after goes no further
    states = written(hs.states_around(valid, features).select(
        "event_id", "item_id", "state", shown("state").alias("shown"), shown("next_state").alias("next_state")))
    old_prob = po.old_probabilities(states.select("event_id", "item_id", "state"), features, _formula_policy())
    sums = states.select("event_id", F.col("shown").alias("state"), "next_state")
    rows = xp.experience_rows(valid, _bonus(t), states=sums, old_prob=old_prob)
    return rows.select(
        "id", "user_id", "item_id", half_up(F.col("state.sum"), 5).alias("state_sum"), half_up(F.col("state.dot"), 3).alias("state_dot"),
        half_up(F.col("next_state.sum"), 5).alias("next_sum"), half_up(F.col("next_state.dot"), 3).alias("next_dot"),
        half_up(F.col("old_prob"), 9).alias("old_prob"))


@query("recommend")
def recommend(t):
    return evl.recommend(t.ratings(), t.items(summary=True, comment_len=True), features_of(t), behaviors(t))


@query("semantic_hybrid")
def semantic_hybrid(t):
    return evl.candidates(materialize(t.ratings()), materialize(t.items(summary=True, comment_len=True)), n=10)
