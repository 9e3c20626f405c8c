"""Offline evaluation of all algorithms in one plan, and the end-to-end recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marquee.operators import catalog as cat, embeddings as em, evaluation as ev, features as ft, policy as po, \
    recommend as rec, similarity as sim
from marquee.session import materialize



def as_interactions(ratings: DataFrame) -> DataFrame:
    """Ratings as behaviour events, numbered by item within their time."""
    return ratings.select("user_id", "item_id", F.lit(1).alias("behavior_type"), "score10", "ts",
                          F.col("item_id").alias("event_id"))


def model_vectors(items: DataFrame, interactions: DataFrame) -> dict[str, DataFrame]:
    """The four vector spaces: two from item text, two from interaction order."""
    items, interactions = materialize(items), materialize(interactions)
    vectors = {}
    for model in ("word2vec", "glove"):
        vectors[f"{model}_content"] = materialize(em.text_vectors(items, model=model))
        vectors[f"{model}_cf"] = materialize(em.interaction_vectors(interactions, model=model))
    return vectors


def baseline_lists(ratings: DataFrame, train: DataFrame, users: DataFrame, items: DataFrame, *, k: int) -> dict[str, DataFrame]:
    """Ranked lists of the four baselines; every score comes from training rows of the judged user.

    The collaborative score table is built once and serves both its own list
    and the hybrid.
    """
    similar = sim.user_similarity_pearson(train, ratings)
    cf = materialize(rec.cf_scores(similar, ratings, train))
    return {
        "hot": ev.hot_lists(cat.hot_items(items, n=2 * k), train, users, k=k),
        "baseline_content": rec.content_rec_jaccard(train, items, n=k),
        "baseline_cf": rec.rank_scores(cf, n=k),
        "baseline_hybrid": rec.jaccard_cf_hybrid(train, items, cf, n=k),
    }


def semantic_lists(train: DataFrame, items: DataFrame, features: DataFrame, policy: po.Policy, *, k: int) -> dict[str, DataFrame]:
    """Ranked lists of the embedding models, their blend, and the blend reranked by the policy.

    Interaction vectors are trained on the training rows only, so the held-out
    item cannot leak.
    """
    lists = em.model_lists(train, model_vectors(items, as_interactions(train)), n=k, pool=3 * k)
    pool = materialize(lists["semantic_hybrid"])
    states = ft.pack_entries(ft.rating_profiles(train, features), "user_id")
    lists["semantic_hybrid"] = pool.filter(F.col("rank") <= k)
    lists["ppo_rerank"] = po.policy_rank(pool, states, features, policy, n=k)
    return lists


def split(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, targets) of the evaluation users."""
    parts = materialize(ev.eval_split(ratings))
    return (parts.filter(F.col("split") == "train").select("user_id", "item_id", "score10", "ts"),
            parts.filter(F.col("split") == "target").select("user_id", "item_id"))


def evaluate(ratings: DataFrame, items: DataFrame, features: DataFrame, *, k: int = 5, semantic: bool = True,
             policy: po.Policy | None = None) -> DataFrame:
    """Metrics per algorithm, best NDCG first."""
    ratings, items, features = materialize(ratings), materialize(items), materialize(features)
    train, targets = split(ratings)
    lists = baseline_lists(ratings, train, targets.select("user_id"), items, k=k)
    if semantic:
        lists |= semantic_lists(train, items, features, policy or po.Policy.initial(), k=k)
    ranked = materialize(ranked_table(lists))
    return ev.eval_metrics(ranked, targets, features, items, k=k, algorithms=list(lists))


def ranked_table(lists: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, ranked in lists.items():
        part = ranked.select(F.lit(name).alias("algorithm"), "user_id", "item_id", F.col("rank").cast("int").alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def recommend(ratings: DataFrame, items: DataFrame, features: DataFrame, interactions: DataFrame, *, n: int = 10,
              policy: po.Policy | None = None, epsilon: float = po.EPSILON) -> DataFrame:
    """Final recommendations of every user who has ratings: semantic blend with baseline fallback, reranked."""
    ratings, items, features = materialize(ratings), materialize(items), materialize(features)
    pool = candidates(ratings, items, n=3 * n)
    states = ft.pack_entries(ft.rating_profiles(ratings, features), "user_id")
    bonus = materialize(cat.coverage_bonus(items, cat.exposure(interactions)))
    return po.recommend(pool, states, features, bonus, policy or po.Policy.initial(), n=n, epsilon=epsilon)


def candidates(ratings: DataFrame, items: DataFrame, *, n: int) -> DataFrame:
    """Semantic blend, filled up from the baseline hybrid list."""
    vectors = model_vectors(items, as_interactions(ratings))
    blend = em.model_lists(ratings, vectors, n=n, single=False)["semantic_hybrid"]
    hot = rec.hot_for_users(ratings.select("user_id").distinct(), cat.hot_items(items, n=n))
    base = rec.baseline_hybrid(rec.user_cf(ratings, items, n=n), rec.content_rec(ratings, items, n=n), hot, n=n)
    return rec.priority_merge([("semantic_hybrid", blend), ("baseline_hybrid", base)], n=n)


def overview_report(users: DataFrame, items: DataFrame, interactions: DataFrame, metrics: DataFrame,
                    active: DataFrame, runs: DataFrame) -> DataFrame:
    """Long report (section, name, value): sizes and density, the active model, metrics, the last ten runs."""
    sizes = cat.density(users, items, interactions).select(F.lit("counts").alias("section"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for c in ("n_users", "n_items", "n_ratings", "density")])))
    model = active.select(F.lit("active_model").alias("section"), F.col("version_tag").alias("name"),
                          F.col("id").cast("double").alias("value"))
    scores = metrics.select(F.lit("evaluation").alias("section"), F.col("algorithm").alias("name"),
                            F.col("ndcg_at_k").alias("value"))
    recent = runs.orderBy(F.col("id").desc()).limit(10).select(
        F.lit("run").alias("section"), F.col("created_at").cast("string").alias("name"), F.col("id").cast("double").alias("value"))
    return sizes.unionByName(model).unionByName(scores).unionByName(recent)
