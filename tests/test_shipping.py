"""What travels between tasks: rows once a side, entries as arrays, sums instead of members."""

import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from marquee.operators import embeddings as em, features as ft, overlap, policy as po, tiles


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_plain_grid_writes_each_side_once(spark, monkeypatch):
    """Rows were copied for each chunk of the other side before."""
    monkeypatch.setattr(tiles, "ROWS_PER_CHUNK", 7)
    rows = spark.range(40).select("id", F.array("id").alias("terms"), F.array(F.lit(1.0)).alias("vals"))
    skip = spark.createDataFrame([(1, 2), (1, 39), (5, 5), (99, 1)], "id bigint, right_id bigint")

    def run(left, right):
        noted = left[left["x_right"].notna()]
        own = left[left["x_right"].isna()]
        met = sum(len(set(x) & set(right["id"])) for x in noted["x_right"])
        return pd.DataFrame({"pairs": [len(own) * len(right)], "met": [met]})

    out = tiles.over_tiles(rows, rows, run, T.StructType().add("pairs", "long").add("met", "long"), skip=skip)
    assert out.agg(F.sum("pairs"), F.sum("met")).first() == (1600, 3)
    assert out.count() >= 36
    plan = plan_of(out)
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Generate" not in plan


def test_feature_entries_are_opened_where_a_users_rows_lie(spark):
    """Every entry of every pair was a row of the shuffle before."""
    features = spark.createDataFrame([(1, [(0, 1.0), (3, 2.0)]), (2, [(3, 4.0)]), (3, [])],
                                     "item_id bigint, features array<struct<slot: int, value: double>>")
    ratings = spark.createDataFrame([(7, 1, 100), (7, 2, 50), (8, 2, 0), (8, 3, 20), (9, 9, 10)], "user_id bigint, item_id bigint, score10 bigint")
    out = ft.rating_profiles(ratings, features)
    assert {(r.user_id, r.slot): r.value for r in out.collect()} == pytest.approx({(7, 0): 1 / 1.5, (7, 3): 4 / 1.5, (8, 3): 0.4 / 0.3})
    assert not re.search(r"hashpartitioning\([^)]*slot", plan_of(out))


def test_logits_ship_entries_as_plain_arrays(spark):
    """An array of structs takes nearly three times the room of two plain arrays."""
    features = spark.createDataFrame([(1, [(0, 1.0), (3, 2.0)]), (2, None)], "item_id bigint, features array<struct<slot: int, value: double>>")
    users = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 3.0])], "id bigint, vals array<double>")
    out = po._candidate_logits(spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1)], "user_id bigint, item_id bigint"), users, features)
    assert {(r.user_id, r.item_id): r.logit for r in out.collect()} == {
        (7, 1): pytest.approx(7 / po._ROOT), (7, 2): None, (7, 3): None, (8, 1): 0.0}
    assert "features" not in plan_of(out).split("Join")[0]


def test_members_add_up_before_the_shuffle(spark):
    """Every part of the input left a row of sums for an id before."""
    ratings = spark.range(200).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("item_id"), F.lit(50).alias("score10"))
    vectors = spark.range(200).select(F.col("id").alias("item_id"), F.array(F.col("id").cast("double")).alias("vec"))
    out = em.user_profiles(ratings, vectors)
    assert {r.user_id: r.vec[0] for r in out.collect()} == pytest.approx({0: 99.0, 1: 100.0})
    assert re.search(r"hashpartitioning\([^\n]*xxhash64", plan_of(out))


def test_routed_rows_are_written_once_a_round(spark, monkeypatch):
    """A row was copied for each chunk it goes to before; it meets the same chunks where they lie."""
    for name, value in {"ROUTED_FROM": 0, "ROWS_PER_CHUNK": 7, "BOUNDED_ROWS": 3}.items():
        monkeypatch.setattr(tiles, name, value)
    monkeypatch.setattr(tiles, "is_sparse", lambda *_: False)
    monkeypatch.setattr(tiles, "run_tiles", None)  # copies rows
    packed, chunks = [], tiles._chunks
    monkeypatch.setattr(tiles, "_chunks", lambda rows, n: packed.append(rows.count()) or chunks(rows, n))
    held = {i: {i % 5: 1.0, 5 + i % 7: 2.0, 12 + i: 1.0, 60 + i // 3: 3.0} for i in range(40)}
    rows = spark.createDataFrame([(i, list(h), list(h.values())) for i, h in held.items()], "id bigint, terms array<bigint>, vals array<double>")
    skip = spark.createDataFrame([(1, 2), (0, 1), (99, 1)], "id bigint, right_id bigint")
    got = {}
    for r in tiles.match(rows, rows, kind="dot", k=3, exclude_self=True, skip=skip).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append((r.right_id, r.score))
    for a in held:
        scores = [(b, sum(v * held[b].get(t, 0.0) for t, v in held[a].items())) for b in held if b != a and (a, b) not in {(1, 2), (0, 1)}]
        assert got[a] == sorted((x for x in scores if x[1] > 0), key=lambda x: (-x[1], x[0]))[:3]
    # the right rows once, the left rows once a round; each round adds its two known marks
    assert len(packed) == 3 and max(packed) <= 42


def test_mean_overlap_writes_each_side_once(spark, monkeypatch):
    """Sets in five chunks: users and their liked sets are written once, not once for each chunk, and the best match brute force."""
    monkeypatch.setattr(overlap, "TILE_SETS", 8)
    monkeypatch.setattr(overlap, "AT_ONCE", 2)
    packed, chunks = [], tiles._chunks
    monkeypatch.setattr(tiles, "_chunks", lambda rows, n: packed.append(rows.count()) or chunks(rows, n))
    sets = {i: sorted({i % 5, 10 + i % 7, 20 + i % 3, 30 + i}) for i in range(40)}
    likes = {u: [(u * 7 + j * 5) % 40 for j in range(1 + u % 4)] for u in range(12)}
    found, asked = overlap.mean_overlap(
        spark.createDataFrame([(u, c, 1 + (u + c) % 2) for u, own in likes.items() for c in own], "id bigint, copy_id bigint, n bigint"),
        spark.createDataFrame([(u, len(own), 4) for u, own in likes.items()], "id bigint, total bigint, k int"),
        spark.createDataFrame(list(sets.items()), "copy_id bigint, tokens array<bigint>"),
        wanted=spark.createDataFrame([(u, c) for u in likes for c in (3, 39)], "id bigint, copy_id bigint"))
    mean = {(u, c): sum((1 + (u + x) % 2) * len(set(sets[c]) & set(sets[x])) / len(set(sets[c]) | set(sets[x])) for x in own) / len(own)
            for u, own in likes.items() for c in sets}
    best = {(u, c) for u in likes for c in sorted((c for c in sets if mean[u, c] > 0), key=lambda c: (-math.floor(mean[u, c] * 1e6 + 0.5), c))[:4]}
    assert {(r.id, r.copy_id) for r in found.collect()} == best
    assert {(r.id, r.copy_id): r.score for r in asked.collect()} == pytest.approx({(u, c): mean[u, c] for u in likes for c in (3, 39)})
    n_liked, n_notes = len({c for own in likes.values() for c in own}), len(likes) * len(set(_homes(spark, [3, 39], 5)))
    assert packed == [len(likes) + n_liked + n_notes, len(sets)]


def _homes(spark, ids, n):
    return [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select(F.pmod(F.xxhash64("i"), F.lit(n).cast("bigint"))).collect()]


def test_routed_dense_rows_are_written_once_a_round(spark, monkeypatch):
    """A vector was copied for each chunk it goes to before."""
    for name, value in {"ROUTED_FROM": 0, "ROWS_PER_CHUNK": 17, "BOUNDED_ROWS": 6}.items():
        monkeypatch.setattr(tiles, name, value)
    monkeypatch.setattr(tiles, "run_tiles", None)  # copies rows
    packed, chunks = [], tiles._chunks
    monkeypatch.setattr(tiles, "_chunks", lambda rows, n: packed.append(rows.count()) or chunks(rows, n))
    vectors = [[math.sin(i * j + 1) for j in range(1, 5)] for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id bigint, vals array<double>")
    skip = spark.createDataFrame([(1, 2), (0, 1), (99, 1)], "id bigint, right_id bigint")
    got = {}
    for r in tiles.match(rows, rows.withColumn("bias", F.col("id") % 3 / 10), kind="dense", k=3, exclude_self=True, skip=skip).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append(r.right_id)
    for a, x in enumerate(vectors):
        scores = [(-math.floor((sum(p * q for p, q in zip(x, y)) + b % 3 / 10) * 1e6 + 0.5), b) for b, y in enumerate(vectors)
                  if b != a and (a, b) not in {(1, 2), (0, 1)}]
        assert got[a] == [b for _, b in sorted(scores)[:3]]
    assert len(packed) == 3 and max(packed) <= 42
