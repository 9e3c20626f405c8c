"""Hand-worked edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions import text as tx, vectors as vx
from marquee.operators import (catalog as cat, embeddings as em, evaluation as ev, experience as xp, extraction as ex,
                               features as ft, interactions as ix, policy as po, ranking as rk, recommend as rec, versions as ver)
from marquee.sources import files

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id long, user_id long, item_id long, behavior_type int, score10 long, ts timestamp"


def events(spark, rows):
    return spark.createDataFrame([(e, u, i, b, s, T0 + dt.timedelta(hours=e)) for e, u, i, b, s in rows], EVENT)


def test_each_reject_reason(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    raw = events(spark, [(1, 1, 1, 1, 80), (2, 1, 1, 1, None), (3, 1, 1, 1, -10), (4, 1, 1, 1, 105), (5, 1, 1, 9, None),
                         (6, 1, 7, 2, None), (7, 1, -1, 2, None), (8, 1, 2, 3, None)])
    got = {r.event_id: r.reject_reason for r in ix.validate_interactions(raw, items).collect()}
    assert got == {1: None, 2: "missing_score", 3: "score_range", 4: "score_range", 5: "behavior_type",
                   6: "unknown_item", 7: "item_id", 8: None}


def test_upsert_keeps_first_collect_and_last_rating(spark):
    old = events(spark, [(1, 1, 1, 1, 50), (2, 1, 1, 2, None)])
    new = events(spark, [(3, 1, 1, 1, 90), (4, 1, 1, 2, None), (5, 1, 2, 3, None), (6, 1, 2, 3, None)])
    once = ix.interaction_upsert(old, new)
    got = {(r.item_id, r.behavior_type): (r.score10, r.event_id, r.is_new) for r in once.collect()}
    assert got == {(1, 1): (90, 3, False), (1, 2): (None, 2, False), (2, 3): (None, 5, True)}
    again = ix.interaction_upsert(once.drop("is_new"), new).drop("is_new")
    assert sorted(again.collect()) == sorted(once.drop("is_new").collect())


def test_dedupe_drops_rows_without_key_and_keeps_last(spark):
    rows = spark.createDataFrame([("a", "", 1), ("a", "", 2), ("", "", 3), (None, None, 4), ("", "b", 5)], "k string, l string, seq int")
    got = sorted((r.k, r.l, r.seq) for r in ix.dedupe_last(rows, ["k", "l"], seq="seq").collect())
    assert got == [("", "b", 5), ("a", "", 2)]


def test_merge_prefers_incoming(spark):
    old = spark.createDataFrame([("a", 9, "old"), ("b", 1, "old")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("c", 1, "new")], "k string, seq int, v string")
    assert {r.k: r.v for r in ix.merge_keyed(old, new, ["k"], seq="seq").collect()} == {"a": "new", "b": "old", "c": "new"}


def test_search_takes_wildcards_literally(spark):
    items = spark.createDataFrame([(1, "100% pure", "", "", "", 1.0, 0), (2, "100 pure", "", "", "", 2.0, 0), (3, "a_b", "", "", "", 3.0, 0),
                                   (4, "aXb", "", "", "", 4.0, 0)],
                                  "item_id int, title string, types string, directors string, country string, rate double, comment_len int")
    assert [r.item_id for r in cat.search(items, keyword="100%").collect()] == [1]
    assert [r.item_id for r in cat.search(items, keyword="A_B").collect()] == [3]


def test_coverage_bonus_without_exposures_is_one(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    none = spark.createDataFrame([], "item_id long, exposure long")
    assert {r.coverage_bonus for r in cat.coverage_bonus(items, none).collect()} == {1.0}


def test_minmax_constant_list_contributes_nothing(spark):
    a = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.3)], "user_id long, item_id long, score double")
    b = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.0)], "user_id long, item_id long, score double")
    got = {r.item_id: r.score for r in rk.minmax_blend({"a": a, "b": b}, {"a": 0.6, "b": 0.4}).collect()}
    assert got == {1: 0.0, 2: 0.4, 3: 0.0}


def test_weighted_merge_counts_missing_as_zero(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "user_id long, item_id long, score double")
    b = spark.createDataFrame([(1, 2, 10.0)], "user_id long, item_id long, score double")
    got = {r.item_id: r.score for r in rk.weighted_merge({"a": a, "b": b}, {"a": 0.5, "b": 0.1}).collect()}
    assert got == {1: 0.5, 2: 2.0}


def test_priority_merge_and_ties(spark):
    schema = "user_id long, item_id long, rank int"
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], schema)
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2), (2, 9, 1)], schema)
    rows = rk.priority_merge([("a", a), ("b", b)], n=2).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.item_id, r.source) for r in rows] == [(1, 5, "a"), (1, 6, "a"), (2, 9, "b")]
    tied = spark.createDataFrame([(1, 8, 1.0), (1, 3, 1.0)], "user_id long, item_id long, score double")
    assert rk.rank_scores(tied, n=1).first().item_id == 3


def test_positions_match_a_global_sort(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    placed = rk.positions(rows, [], ["id"], F.floor(F.col("id") / 37))
    assert all(r.id == r.pos for r in placed.collect())


def test_unknown_algorithm_is_an_error(spark):
    with pytest.raises(KeyError):
        rec.by_algorithm({"hot": spark.range(1)}, algorithm="none")


def test_user_without_likes_gets_hot(spark):
    content = spark.createDataFrame([(1, 10, 1)], "user_id long, item_id long, rank int")
    hot = spark.createDataFrame([(u, i, r) for u in (1, 2) for r, i in enumerate((7, 8), 1)], "user_id long, item_id long, rank int")
    got = {(r.user_id, r.item_id) for r in rec.content_or_hot(content, hot).collect()}
    assert got == {(1, 10), (2, 7), (2, 8)}


def test_split_targets_last_positive_and_keeps_later_negatives(spark):
    rows = [(1, 1, 90, T0), (1, 2, 85, T0 + dt.timedelta(1)), (1, 3, 20, T0 + dt.timedelta(2)), (2, 1, 90, T0), (2, 2, 10, T0)]
    log = spark.createDataFrame(rows, "user_id long, item_id long, score10 long, ts timestamp")
    got = {(r.user_id, r.item_id): r.split for r in ev.eval_split(log).collect()}
    assert got == {(1, 1): "train", (1, 2): "target", (1, 3): "train"}


def test_hot_list_may_be_shorter_than_k(spark):
    hot = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "item_id long, rank int")
    train = spark.createDataFrame([(9, 1), (9, 3)], "user_id long, item_id long")
    got = ev.hot_lists(hot, train, spark.createDataFrame([(9,)], "user_id long"), k=2).collect()
    assert [(r.item_id, r.rank) for r in got] == [(2, 1)]


def feature_rows(spark, table):
    rows = [(i, [(s, float(v)) for s, v in f.items()]) for i, f in table.items()]
    return spark.createDataFrame(rows, "item_id long, features array<struct<slot:int,value:double>>")


def test_list_diversity(spark):
    features = feature_rows(spark, {1: {0: 1}, 2: {1: 1}, 3: {0: 2}, 4: {}})
    ranked = spark.createDataFrame([("x", 1, 1), ("x", 1, 2), ("x", 1, 3), ("x", 2, 1), ("x", 3, 1), ("x", 3, 4)],
                                   "algorithm string, user_id long, item_id long")
    got = {r.user_id: r.diversity for r in ev.list_diversity(ranked, features).collect()}
    assert got == {1: 0.6667, 2: 0.0, 3: 1.0}


def test_metrics_count_users_without_lists(spark):
    features = feature_rows(spark, {1: {0: 1}, 2: {1: 1}})
    ranked = spark.createDataFrame([("x", 1, 2, 1), ("x", 1, 1, 2)], "algorithm string, user_id long, item_id long, rank int")
    targets = spark.createDataFrame([(1, 1), (2, 2)], "user_id long, item_id long")
    r = ev.eval_metrics(ranked, targets, features, spark.createDataFrame([(i,) for i in range(4)], "item_id long"), k=2).first()
    assert (r.precision_at_k, r.recall_at_k, r.ndcg_at_k, r.coverage, r.diversity) == (0.25, 0.5, 0.3155, 0.5, 0.5)


def test_rerank_is_a_permutation_and_epsilon_is_seeded(spark):
    features = feature_rows(spark, {i: {i % 5: 1, 7: i} for i in range(12)})
    pool = spark.createDataFrame([(u, i, 0.01 * i, 0.5) for u in (1, 2) for i in range(12)],
                                 "user_id long, item_id long, policy_score double, coverage_bonus double")
    for epsilon in (0.0, 0.7):
        one = po.mmr_rerank(pool, features, n=12, epsilon=epsilon).collect()
        two = po.mmr_rerank(pool, features, n=12, epsilon=epsilon).collect()
        assert sorted(map(str, one)) == sorted(map(str, two))
        assert sorted(r.item_id for r in one if r.user_id == 1) == list(range(12))
        assert any(r.exploration_used for r in one) == (epsilon > 0)
    assert all(r.diversity_bonus == 1.0 for r in one if r.rank == 1)


def policy_data(spark, n_items=30):
    rng = np.random.default_rng(0)
    table = {i: {int(s): float(rng.random()) for s in rng.choice(po.SLOTS, 6, replace=False)} for i in range(n_items)}
    features = feature_rows(spark, table)
    states = feature_rows(spark, {u: table[u] for u in range(5)}).withColumnRenamed("item_id", "user_id")
    return features, states


def test_policy_probabilities_sum_to_one(spark):
    features, states = policy_data(spark)
    pairs = states.select("user_id").crossJoin(features.select("item_id"))
    sums = po.policy_scores(pairs, states, features, po.Policy.initial()).groupBy("user_id").agg(F.sum("policy_score").alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in sums.collect())
    ranked = po.policy_rank(pairs, states, features, po.Policy.initial(), n=30)
    assert all(abs(r.s - 1) < 1e-9 for r in ranked.groupBy("user_id").agg(F.sum("score").alias("s")).collect())


def test_training_lowers_the_loss_and_parameters_round_trip(spark, folder):
    features, states = policy_data(spark)
    rows = spark.createDataFrame([(u, i, 1.0 if i < 5 else -0.5, 0.0, 1 / 30) for u in range(5) for i in range(10)],
                                 "user_id long, item_id long, reward double, aux_reward double, old_prob double")
    policy, log = po.train(rows, states, features, po.Policy.initial(), epochs=4, lr=0.003)
    assert [r["n"] for r in log] == [50] * 4
    assert log[-1]["value_loss"] < log[0]["value_loss"] and log[-1]["gain"] > log[0]["gain"]
    files.save_parameters(policy.to_table(spark), f"{folder}/params", version_tag="v1")
    again = po.Policy.from_table(files.load_parameters(spark, f"{folder}/params", version_tag="v1"))
    assert np.allclose(again.rows(), policy.rows())


def test_gradient_equals_finite_difference(spark):
    """The summed actor and critic gradients against numeric slopes of the unclipped objective."""
    features, states = policy_data(spark, n_items=8)
    policy, reward_, old = po.Policy.initial(), 0.7, 1 / 8
    table = {r.item_id: {e.slot: e.value for e in r.features} for r in features.collect()}
    items = np.zeros((8, po.SLOTS))
    for i, f in table.items():
        items[i, list(f)] = list(f.values())
    pref = items[1]
    state = np.append(np.concatenate([pref, pref]), 1.0)

    def parts(rows):
        e = np.tanh(rows[:-1] @ state)
        logits = items @ e / np.sqrt(po.SLOTS)
        return np.exp(logits[2]) / np.exp(logits).sum(), rows[-1] @ state, e, logits

    value = parts(policy.rows())[1]
    prob, _, e, logits = parts(policy.rows())
    p = np.exp(logits) / np.exp(logits).sum()
    batch = __import__("pandas").DataFrame({
        "rewards": [np.array([reward_])], "olds": [np.array([old])], "e": [e], "mean": [p @ items], "value": [value],
        "i_slots": [np.array(list(table[2]))], "i_vals": [np.array(list(table[2].values()))],
        "slots": [np.array(list(table[1]))], "vals": [np.array(list(table[1].values()))],
        "top": [logits.max()], "total": [np.exp(logits - logits.max()).sum()]})
    grad = np.vstack(list(po._gradients(iter([batch]), 1e9))[0]["values"].to_numpy())
    h, base = 1e-6, policy.rows()
    slot = next(iter(table[1]))
    for row, col in ((next(iter(table[2])), slot), (next(iter(table[3])), po.STATE), (po.SLOTS, slot)):
        up, down = base.copy(), base.copy()
        up[row, col] += h
        down[row, col] -= h

        def objective(rows):
            q, v, _, _ = parts(rows)
            return -(reward_ - value) * q / old + (v - reward_) ** 2

        assert grad[row, col] == pytest.approx((objective(up) - objective(down)) / (2 * h), rel=1e-4, abs=1e-8)


def test_rollback_to_unknown_tag_changes_nothing(spark):
    versions = spark.createDataFrame([(1, "m", "a"), (2, "m", "b")], "id long, model_name string, version_tag string")
    log = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, version_tag string")
    same = ver.rollback(versions, log, version_tag="zzz", seq=3)
    back = ver.rollback(versions, log, version_tag="a", seq=3)
    assert ver.active_version(versions, same).first().version_tag == "b"
    assert ver.active_version(versions, back).first().version_tag == "a"


@pytest.mark.parametrize("n,expected", [(99, 0), (100, 100), (101, 100), (250, 200)])
def test_batches_of_single_arrivals(spark, n, expected):
    pool = spark.range(n).select("id", F.lit("pending").alias("status"))
    assert xp.experience_batches(pool).count() == expected


def test_payload_round_trip_and_missing_state(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.5)], "id long, old_prob double")
    state = F.when(F.col("id") == 1, F.array(F.lit(0.25), F.lit(0.5)))
    coded = rows.withColumn("payload_json", xp.encode_payload(state, F.lit(None).cast("array<double>"), F.lit(8.0), F.lit(0.1)))
    got = xp.experience_decode(coded, n_items=4).collect()
    assert [(r.id, r.state, r.aux_reward, r.old_prob) for r in got] == [(1, [0.25, 0.5], 0.1, 0.25)]


def test_stars_and_keyword_tags(spark):
    df = spark.createDataFrame([("allstar50 rating", "悬疑与反转，科幻"), ("x", None)], "c string, s string")
    got = df.select(ex.star_rating(F.col("c")).alias("stars"), tx.keyword_tags(F.col("s")).alias("tags")).collect()
    assert [(r.stars, r.tags) for r in got] == [(5.0, ["suspense", "plot_twist", "sci_fi"]), (0.0, [])]


def test_tokens(spark):
    df = spark.createDataFrame([("The Dream，sci-fi (悬疑)", "THE fox; a fox. 的 x")], "a string, b string")
    r = df.select(tx.semantic_tokens(F.col("a")).alias("a"), tx.with_synonyms(tx.semantic_tokens(F.col("a"))).alias("s"),
                  tx.feature_tokens(F.col("b")).alias("b")).first()
    assert r.a == ["the", "dream", "sci-fi", "悬疑"]
    assert r.s == ["the", "dream", "mind_bending", "sci_fi", "sci-fi", "future", "space", "悬疑", "惊悚", "推理"]
    assert r.b == ["fox", "fox"]


def test_decay_scaling_and_cosine(spark):
    df = spark.createDataFrame([(T0, [3.0, 4.0], [0.0, 0.0]), (None, [1.0, 0.0], [1.0, 1.0])], "ts timestamp, a array<double>, b array<double>")
    r = df.select(vx.half_life_decay(F.col("ts"), F.lit(T0 + dt.timedelta(hours=168))).alias("d"),
                  vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.scaled(F.lit(None), 0, 10).alias("m"),
                  vx.sigmoid(F.lit(100.0)).alias("s")).collect()
    assert [round(x.d, 6) for x in r] == [0.5, 0.5] and r[0].c == 0 and round(r[1].c, 6) == 0.707107 and r[0].m == 0.5
    assert round(r[0].s, 6) == 0.999665


def test_feature_slots():
    assert ft.SLOTS == 354 and po.STATE == 708


def test_csv_with_mark_and_line_break(spark, folder):
    with open(f"{folder}/in.csv", "w", encoding="utf-8-sig") as f:
        f.write('user_email,movie_title,movie_subject_id,behavior_type,score,create_time\n'
                'a@x,"Two\nLines, ""quoted""",,1,8.7,2026-01-02 12:00:00\na@x,Solo,,2,,2026-01-03 12:00:00\na@x,Solo,,1,bad,nope\n')
    raw = files.read_csv(spark, f"{folder}/in.csv", files.BEHAVIOR_FIELDS)
    rows = files.behaviors_from_csv(raw).collect()
    assert [(r.title, r.behavior_type, r.score10, r.ts is None) for r in rows] == [
        ('Two\nLines, "quoted"', 1, 87, False), ("Solo", 2, None, False), ("Solo", 1, None, True)]
    files.write_csv(raw.select("user_email", "movie_title"), f"{folder}/out", files.BEHAVIOR_FIELDS)
    back = files.read_csv(spark, f"{folder}/out", files.BEHAVIOR_FIELDS)
    assert back.count() == 3 and back.filter(F.col("movie_title").contains("quoted")).count() == 1


def test_title_stands_in_for_an_empty_subject_id(spark):
    rows = spark.createDataFrame([("u", "A", "", 1, 1), ("u", "B", "", 1, 2), ("u", "B", "", 1, 3)],
                                 "user_id string, title string, subject_id string, behavior_type int, seq int")
    assert files.dedupe_behaviors(rows, seq="seq").count() == 2


def test_catalog_defaults(spark):
    rows = spark.createDataFrame([("A", "9.1", "drama,crime", "1999", "x"), ("B", "", None, None, None)],
                                 "title string, rating string, genre string, release_year string, duration string")
    meta = spark.createDataFrame([("A", "dir", "c1/c2", "p/q")], "title string, directors string, country string, casts string")
    got = {r.title: r for r in files.catalog_from_csv(rows.withColumn("summary", F.lit(None).cast("string")), meta).collect()}
    assert (got["A"].rate, got["A"].types, got["A"].release_year, got["A"].duration, got["A"].directors) == (9.1, "drama/crime", 1999, 0, "dir")
    assert (got["B"].rate, got["B"].types, got["B"].directors, got["B"].country) == (0.0, "未知", "未知导演", "未知")


def test_merge_writes_a_new_folder(spark, folder):
    one = spark.createDataFrame([("a", 1, "x")], "k string, seq int, v string")
    two = spark.createDataFrame([("a", 2, "y"), ("b", 3, "z")], "k string, seq int, v string")
    files.merge_parquet(spark, None, one, f"{folder}/s1", ["k"], seq="seq")
    got = files.merge_parquet(spark, f"{folder}/s1", two, f"{folder}/s2", ["k"], seq="seq")
    assert {r.k: r.v for r in got.collect()} == {"a": "y", "b": "z"}


@pytest.mark.parametrize("model", ["word2vec", "glove"])
def test_embeddings_recover_planted_topics(spark, model):
    import random

    rng, rows = random.Random(3), []
    for seq in range(120):
        topic = "ab"[seq % 2]
        for pos in range(12):
            rows.append((seq, pos, f"{topic}{rng.randrange(6)}"))
    for pos in range(12):
        rows.append((500, pos, rng.choice("ab") + str(rng.randrange(6))))
    corpus = spark.createDataFrame(rows, "seq long, pos int, token string")
    vec = {r.token: np.array(r.vec) for r in em.train(corpus, model=model, dimensions=8).collect()}

    def cos(a, b):
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1)

    same = np.mean([cos(vec[f"a{i}"], vec[f"a{j}"]) for i in range(6) for j in range(i)])
    other = np.mean([cos(vec[f"a{i}"], vec[f"b{j}"]) for i in range(6) for j in range(6)])
    assert same > other + 0.2


def test_feature_arrays_are_computed_once_for_their_long_form(spark):
    items = spark.createDataFrame([(1, "drama", "ann", "x", "one two two one two", 5.0, 3, 2000, 90), (2, "", "", "", None, None, 0, None, None)],
                                  "item_id long, types string, directors string, country string, summary string, rate double, "
                                  "comment_len long, release_year int, duration int")
    out = ft.long_form(ft.item_features(items))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("director:") == 1
    shares = sorted(r.value for r in out.collect() if r.item_id == 1 and ft.SUMMARY_AT <= r.slot < ft.TAG_AT)
    assert shares == [0.4, 0.6]
