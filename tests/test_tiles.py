"""Tile matching against brute force, with chunks forced small."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.operators import blocks, overlap, recommend as rec, similarity as sim, tiles


@pytest.fixture(params=["plain", "small", "routed"])
def small_chunks(request, monkeypatch):
    """Everything in few chunks, in many, and in many that rows reach by their terms and bounds only."""
    if request.param != "plain":
        monkeypatch.setattr(tiles, "ENTRIES_PER_CHUNK", 60)
        monkeypatch.setattr(tiles, "ROWS_PER_CHUNK", 7)
        monkeypatch.setattr(overlap, "USERS", 7)
        monkeypatch.setattr(overlap, "SETS", 7)
        monkeypatch.setattr(overlap, "USER_SETS", 3)
        monkeypatch.setattr(overlap, "BLOCK", 4)
    if request.param == "routed":
        monkeypatch.setattr(tiles, "ROUTED_FROM", 0)
        monkeypatch.setattr(tiles, "BOUNDED_ROWS", 3)
        monkeypatch.setattr(blocks, "rows_saved", lambda *_: True)
        monkeypatch.setattr(blocks, "CELLS", 50)
    return request.param


def ratings_of(n_users=30, n_items=25, seed=1, hot=True):
    rng, out = random.Random(seed), {}
    for u in range(n_users):
        for i in rng.sample(range(n_items), rng.randint(2, 12)):
            out[u, i] = rng.randint(2, 100)
        if hot:
            out[u, 0] = rng.randint(2, 100)
            if u == 3:
                out.update({(u, i): rng.randint(2, 100) for i in range(n_items)})
    return out


def frame(spark, ratings):
    return spark.createDataFrame([(u, i, s) for (u, i), s in ratings.items()], "user_id long, item_id long, score10 long")


def pearson(a, b):
    common = set(a) & set(b)
    n = len(common)
    if n < 2:
        return None
    sx, sy = sum(a[i] for i in common), sum(b[i] for i in common)
    cov = n * sum(a[i] * b[i] for i in common) - sx * sy
    if cov <= 0:
        return None
    va = n * sum(a[i] ** 2 for i in common) - sx * sx
    vb = n * sum(b[i] ** 2 for i in common) - sy * sy
    return n, cov / (math.sqrt(va) * math.sqrt(vb))


def by_user(ratings):
    users = {}
    for (u, i), s in ratings.items():
        users.setdefault(u, {})[i] = s
    return users


@pytest.mark.parametrize("max_entries", [None, 10])
def test_pearson_all_pairs(spark, small_chunks, max_entries):
    ratings = ratings_of()
    users = by_user(ratings)
    expected = {(a, b): pearson(users[a], users[b]) for a in users for b in users if a != b}
    expected = {k: v for k, v in expected.items() if v}
    got = {(r.user_a, r.user_b): (r.n_common, r.sim) for r in sim.user_similarity_pearson(
        frame(spark, ratings), max_entries=max_entries).collect()}
    assert got.keys() == expected.keys()
    for key, (n, s) in expected.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("max_entries", [None, 10])
def test_pearson_top_k_is_the_head_of_all_pairs(spark, small_chunks, max_entries):
    ratings = frame(spark, ratings_of(seed=5))
    full = sim.user_similarity_pearson(ratings).collect()
    top = sim.user_similarity_pearson(ratings, k=3, max_entries=max_entries).collect()
    for user in {r.user_a for r in full}:
        order = sorted((r for r in full if r.user_a == user), key=lambda r: (-math.floor(r.sim * 1e6 + 0.5), r.user_b))[:3]
        assert sorted(r.user_b for r in top if r.user_a == user) == sorted(r.user_b for r in order)


@pytest.mark.parametrize("kind", ["dot", "pearson"])
def test_a_sparse_product_takes_chunks_by_entries_and_only_cells_that_a_term_reaches(spark, monkeypatch, kind):
    """Eighty rows of three terms in chunks of seven rows were 144 tiles of all cells."""
    monkeypatch.setattr(tiles, "ROWS_PER_CHUNK", 7)
    shipped, run_tiles = [], tiles.run_tiles
    monkeypatch.setattr(tiles, "run_tiles", lambda *a: shipped.append(a[-1]) or run_tiles(*a))
    monkeypatch.setattr(tiles, "cells_worth_ranking", None)  # ranks whole rows of cells
    monkeypatch.setattr(tiles, "_pearson", None)
    held = {i: {i % 40: 1.0 + i % 3, (i + 1) % 40: 2.0, (i * 3 + 2) % 40 + 40: 4.0 + i % 2} for i in range(80)}
    rows = spark.createDataFrame([(i, t, v) for i, own in held.items() for t, v in own.items()], "id bigint, term bigint, val double")
    got = {(r.left_id, r.right_id): r.score for r in tiles.match_long(rows, rows, kind=kind, k=3).collect()}
    assert shipped == [1]

    def score(a, b):
        both = sorted(held[a].keys() & held[b].keys())
        if kind == "dot":
            return sum(held[a][t] * held[b][t] for t in both)
        return (pearson({t: held[a][t] for t in both}, {t: held[b][t] for t in both}) or (0, 0.0))[1]

    expected = {}
    for a in held:
        found = [(-math.floor(s * 1e6 + 0.5), b, s) for b in held if a != b and (s := score(a, b)) > 0]
        expected |= {(a, b): s for _, b, s in sorted(found)[:3]}
    assert got == pytest.approx(expected)


def test_tiles_are_dealt_by_one_shuffle_a_side(spark):
    rows = spark.range(20).selectExpr("id", "id % 3 AS tile")
    plan = tiles.run_tiles(rows, rows, None, lambda a, b: a[["id"]], "id bigint", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


def test_neighbours_rows_are_summed_where_they_lie(spark, monkeypatch):
    """Collaborative scores: one shuffle by user behind the join, rows of a neighbour in several parts, null keys as before."""
    monkeypatch.setattr(rec, "PACKED", 2)
    likes = spark.createDataFrame([(b, i, 80 + (b + i) % 20) for b in range(4) for i in range(5)] + [(9, None, 90)],
                                  "user_id bigint, item_id bigint, score10 bigint")
    similar = spark.createDataFrame([(7, 0, 0.5), (7, 1, 0.25), (8, 2, 1.0), (8, 9, 0.5)], "user_a bigint, user_b bigint, sim double")
    watched = spark.createDataFrame([(7, 1), (8, None), (None, 2)], "user_id bigint, item_id bigint")
    scores = rec.cf_scores(similar, likes, watched)
    expected = {(7, i): 0.5 * (80 + i) / 10 + 0.25 * (81 + i) / 10 for i in range(5) if i != 1}
    expected |= {(8, i): (82 + i) / 10 for i in range(5)} | {(8, None): 4.5}
    assert {(r.user_id, r.item_id): r.score for r in scores.collect()} == pytest.approx(expected)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(user_id#\d+L?, item_id", plan)


def test_one_common_item_or_equal_scores_give_no_similarity(spark):
    rows = {(1, 1): 50, (2, 1): 60, (3, 1): 70, (3, 2): 70, (4, 1): 10, (4, 2): 90}
    assert sim.user_similarity_pearson(frame(spark, rows)).count() == 0


def test_cosine_wide_rows_equal_packed_rows(spark, small_chunks):
    ratings = frame(spark, ratings_of(seed=9))
    packed = {(r.user_a, r.user_b): round(r.sim, 9) for r in sim.user_cosine(ratings, k=None).collect()}
    joined = {(r.user_a, r.user_b): round(r.sim, 9) for r in sim.user_cosine(ratings, k=None, max_entries=8).collect()}
    assert packed == joined and len(packed) > 100
    assert all(-1e-9 <= s <= 1 + 1e-9 for s in packed.values())


def items_frame(spark, n=40, seed=2):
    rng = random.Random(seed)
    rows = [(i, f"t{i}", rng.choice(["A", "A/B", "B/C", "C"]), rng.choice(["d1", "d2"]), rng.choice(["x", "y"]),
             " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randint(0, 6)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "item_id long, title string, types string, directors string, country string, summary string")


def tokens_of(row):
    return {x.lower() for x in row[2].split("/")} | {row[3], row[4]} | set(row[5].split())


def tags_of(row):
    return {"t:" + x for x in row[2].split("/")} | {"d:" + row[3], "c:" + row[4]}


def test_similar_items_with_many_copies(spark, small_chunks):
    rows, items = items_frame(spark)
    got = {}
    for r in sim.similar_items(items, n=4).orderBy("item_a", "rank").collect():
        got.setdefault(r.item_a, []).append(r.item_b)
    for a in rows:
        scored = []
        for b in rows:
            shared = len(tags_of(a) & tags_of(b))
            if b[0] != a[0] and shared:
                scored.append((-math.floor(shared / math.sqrt(len(tags_of(a)) * len(tags_of(b))) * 1e6 + 0.5), b[0]))
        assert got[a[0]] == [i for _, i in sorted(scored)[:4]]


def brute_content(rows, ratings, n, jaccard):
    tokens = tokens_of
    out = {}
    for u, mine in by_user(ratings).items():
        likes = [rows[i] for i, s in mine.items() if s >= 80]
        scored = []
        for b in rows:
            if b[0] in mine or not likes:
                continue
            if jaccard:
                s = sum(len(tokens(a) & tokens(b)) / len(tokens(a) | tokens(b)) for a in likes) / len(likes)
            else:
                s = sum(len(tags_of(a) & tags_of(b)) / math.sqrt(len(tags_of(a)) * len(tags_of(b))) for a in likes) / len(likes)
            if s > 0:
                scored.append((-math.floor(s * 1e6 + 0.5), b[0]))
        if scored:
            out[u] = [i for _, i in sorted(scored)[:n]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("user_id", "rank").collect():
        out.setdefault(r.user_id, []).append(r.item_id)
    return out


def test_content_rec_opens_tag_sets_exactly(spark, small_chunks):
    rows, items = items_frame(spark)
    ratings = ratings_of(n_items=38, seed=4)
    assert lists(rec.content_rec(frame(spark, ratings), items, n=5)) == brute_content(rows, ratings, 5, False)


def test_content_rec_jaccard(spark, small_chunks):
    rows, items = items_frame(spark)
    ratings = ratings_of(n_items=38, seed=6)
    assert lists(rec.content_rec_jaccard(frame(spark, ratings), items, n=5)) == brute_content(rows, ratings, 5, True)


def test_mean_overlap_ships_users_once_for_many_slices_of_sets(spark, monkeypatch):
    """Forty sets in slices of three are one tile, not fourteen, and the best over all slices match brute force."""
    monkeypatch.setattr(overlap, "SETS", 3)
    for name, value in {"HELD": 20, "RANKED": 4}.items():
        monkeypatch.setattr(overlap, name, value, raising=False)
    shipped, run_tiles = [], tiles.run_tiles
    monkeypatch.setattr(tiles, "run_tiles", lambda *a: shipped.append(a[-1]) or run_tiles(*a))
    sets = {i: sorted({i % 5, 10 + i % 7, 20 + i % 3, 30 + i}) for i in range(40)}
    likes = {u: [(u * 7 + j * 5) % 40 for j in range(1 + u % 4)] for u in range(12)}
    found, asked = overlap.mean_overlap(
        spark.createDataFrame([(u, c, 1) for u, own in likes.items() for c in own], "id bigint, copy_id bigint, n bigint"),
        spark.createDataFrame([(u, len(own), 4) for u, own in likes.items()], "id bigint, total bigint, k int"),
        spark.createDataFrame(list(sets.items()), "copy_id bigint, tokens array<bigint>"),
        wanted=spark.createDataFrame([(u, 39) for u in likes], "id bigint, copy_id bigint"))
    assert shipped == [1]
    mean = {(u, c): sum(len(set(sets[c]) & set(sets[x])) / len(set(sets[c]) | set(sets[x])) for x in own) / len(own)
            for u, own in likes.items() for c in sets}
    best = {(u, c) for u in likes for c in sorted((c for c in sets if mean[u, c] > 0), key=lambda c: (-math.floor(mean[u, c] * 1e6 + 0.5), c))[:4]}
    assert {(r.id, r.copy_id) for r in found.collect()} == best
    assert {(r.id, r.copy_id): r.score for r in asked.collect()} == pytest.approx({(u, 39): mean[u, 39] for u in likes})


def test_item_jaccard(spark, small_chunks):
    rows, items = items_frame(spark)
    got = {}
    for r in sim.item_jaccard(items, n=4).orderBy("item_a", "rank").collect():
        got.setdefault(r.item_a, []).append(r.item_b)
    for a in rows:
        scored = [(-math.floor(len(tokens_of(a) & tokens_of(b)) / len(tokens_of(a) | tokens_of(b)) * 1e6 + 0.5), b[0])
                  for b in rows if b[0] != a[0] and tokens_of(a) & tokens_of(b)]
        assert got[a[0]] == [i for _, i in sorted(scored)[:4]]


def test_hybrid_scores_boosted_items_one_by_one(spark, small_chunks):
    rows, items = items_frame(spark)
    rows.append((99, "bare", None, None, None, None))
    items = items.unionByName(spark.createDataFrame([rows[-1]], items.schema))
    ratings = ratings_of(n_items=38, seed=7)
    rng = random.Random(1)
    boost = {(u, i): rng.random() * 9 for u in range(30) for i in rng.sample(range(40), 6)} | {(0, 99): 3.0, (77, 5): 1.0}
    cf = spark.createDataFrame([(u, i, s) for (u, i), s in boost.items()], "user_id long, item_id long, score double")
    got = lists(rec.jaccard_cf_hybrid(frame(spark, ratings), items, cf, n=4))
    users = by_user(ratings)
    for u in {*users, 77}:
        likes = [tokens_of(rows[i]) for i, s in users.get(u, {}).items() if s >= 80]
        scored = []
        for b in rows:
            own = set() if b[0] == 99 else tokens_of(b)
            mean = sum(len(a & own) / len(a | own) for a in likes) / len(likes) if likes else 0
            total = 0.45 * mean + 0.55 * boost.get((u, b[0]), 0)
            if total > 0 and b[0] not in users.get(u, {}):
                scored.append((-math.floor(total * 1e6 + 0.5), b[0]))
        assert got.get(u, []) == [i for _, i in sorted(scored)[:4]]


def chunked(spark, rows, chunk):
    return spark.createDataFrame([(i, t, [1.0] * len(t), chunk(i)) for i, t in rows], "id long, terms array<long>, vals array<double>, chunk int")


def test_block_diagonal_rows_travel_to_their_own_block_only(spark):
    rng = random.Random(3)
    # nine blocks of rows that share no term with each other, dealt to chunks by pivots
    rows = [(100 * b + r, [1000 * b + t for t in rng.sample(range(20), 8)]) for b in range(9) for r in range(40)]
    table = spark.createDataFrame([(i, t, [1.0] * len(t)) for i, t in rows], "id long, terms array<long>, vals array<double>")
    gathered, n = blocks.gather(table, blocks.pivots_of(table, 64, False), dense=False, by_value=False, rows_per_chunk=40, entries_per_chunk=10**6)
    held = {}
    for r in gathered.collect():
        held.setdefault(r.chunk, set()).add(r.id // 100)
    routed = blocks.route(gathered, blocks.summary(gathered), n, min_common=1, parts=2).collect()
    assert len(routed) == len(rows) and len(held) == n
    for r in routed:
        # to every chunk with a row of its block, and to no other
        assert set(r.others) == {c for c, of in held.items() if r.id // 100 in of}
    assert sum(len(r.others) for r in routed) < len(rows) * n / 4


def test_routes_ask_for_enough_common_terms_and_bounds_hold(spark):
    rng = random.Random(5)
    left = [(i, rng.sample(range(60), rng.randint(0, 9))) for i in range(80)]
    rows = chunked(spark, left, lambda i: i % 7).withColumn("vals", F.transform("terms", lambda t: (t % 5 - 2).cast("double")))
    for need in (1, 2):
        for r in blocks.route(rows, blocks.summary(rows), 7, min_common=need, parts=3).collect():
            want = {}
            for i, t in left:
                want.setdefault(i % 7, []).append(t)
            reach = {c for c, lists_ in want.items() if len(set(r.terms) & {x for t in lists_ for x in t}) >= need}
            assert set(r.others) == reach
            for c, bound in zip(r.others, r.bounds):
                most = max(sum((t % 5 - 2) ** 2 for t in set(r.terms) & set(o)) for o in want[c])
                assert bound >= most


@pytest.mark.parametrize("n", [1, 3])
def test_dense_bounds_skip_chunks_and_lose_nothing(spark, monkeypatch, n):
    monkeypatch.setattr(tiles, "BOUNDED_ROWS", 10)
    rng = random.Random(n)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    vectors = [[x + rng.gauss(0, .05) for x in centres[i % 6]] for i in range(120)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, vals array<double>")
    right = table.withColumn("bias", F.col("id") % 3 / 100)
    scored = {}

    def spy(lefts, rights, *rest):
        scored["tiles"] = scored.get("tiles", 0) + lefts.select("tile").distinct().count()
        return run(lefts, rights, *rest)

    run = tiles.run_tiles
    monkeypatch.setattr(tiles, "run_tiles", spy)
    got = {}
    for r in tiles.match(table, right, kind="dense", k=n, exclude_self=True).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append(r.right_id)
    for i, a in enumerate(vectors):
        scores = [(-math.floor((sum(x * y for x, y in zip(a, b)) + j % 3 / 100) * 1e6 + .5), j) for j, b in enumerate(vectors) if j != i]
        assert got[i] == [j for _, j in sorted(scores)[:n]]
    assert scored["tiles"] < 12 / 2 + 12  # chunks that bounds leave open, over both rounds


@pytest.mark.parametrize("neighbours", [1, 3, 1000])
def test_cf_nearest_is_exact_for_any_first_round(spark, neighbours):
    ratings = ratings_of(n_users=40, n_items=60, seed=8)
    users = by_user(ratings)
    norm = {u: math.sqrt(sum(s * s for s in r.values())) for u, r in users.items()}
    expected = {}
    for u in users:
        best = {}
        for v in users:
            dot = sum(users[u][i] * users[v][i] for i in users[u].keys() & users[v].keys())
            if v == u or not dot:
                continue
            cos = dot / norm[u] / norm[v]
            for i, s in users[v].items():
                key = (-math.floor(cos * 1e6 + 0.5), v)
                if i not in best or key < best[i][0]:
                    best[i] = key, cos * s / 10
        expected[u] = [i for _, i in sorted((-math.floor(s * 1e6 + 0.5), i) for i, (_, s) in best.items())[:5]]
    assert lists(rec.cf_nearest(frame(spark, ratings), n=5, neighbours=neighbours)) == expected


def test_tfidf_copies_and_whole_texts(spark, small_chunks):
    texts = {0: "red fox runs", 1: "red fox runs", 2: "red fox runs", 3: "blue fox sleeps", 4: "green tree", 5: "the of and",
             6: "filler " * 500 + "zebra", 7: "zebra crossing"}
    df = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = {}
    for r in sim.tfidf_similar(df, n=3).orderBy("item_a", "rank").collect():
        got.setdefault(r.item_a, []).append((r.item_b, round(r.sim, 6)))
    assert got[0][:2] == [(1, 1.0), (2, 1.0)] and got[1][:2] == [(0, 1.0), (2, 1.0)]
    assert got[0][2][0] == 3 and 5 not in got and 4 not in got
    assert [b for b, _ in got[7]] == [6]
