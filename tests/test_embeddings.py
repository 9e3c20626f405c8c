"""The weighted log-count fit: its normal equations, its loss and what its vectors tell apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import embeddings as em


@pytest.fixture(scope="module")
def pairs(spark):
    """Two topics of twelve words; words of a topic meet often, others now and then, one word meets all."""
    r, rows = random.Random(4), []
    words = [f"{t}{k}" for t in "ab" for k in range(12)] + ["all"]
    for x in words:
        for y in words:
            if x != y and (x[0] == y[0] or "all" in (x, y) or r.random() < 0.4):
                rows.append((x, y, float(r.randint(20, 60) if x[0] == y[0] and "all" not in (x, y) else r.choice([0.5, 1.0, 2.0, 8.0]))))
    return spark.createDataFrame(rows, "left string, right string, weight double")


def test_shares_follow_the_weight(pairs):
    for r in em.log_weights(pairs).collect():
        assert 0 < r.f <= 1 and (r.f == 1) == (np.exp(r.value) >= 10 - 1e-9)
        assert r.f == pytest.approx(min(1, (np.exp(r.value) / 10) ** 0.75))


@pytest.mark.parametrize("tile", [10**6, 40])  # one tile, and a grid whose sums are added
def test_rows_solve_their_weighted_normal_equations(pairs, tile, monkeypatch):
    monkeypatch.setattr(em, "PAIRS_PER_TILE", tile)
    matrix = em.log_weights(pairs)
    fitted, ids = em._fit(matrix, 3, 2, 0.1)
    name = {r.id: r.token for r in ids.collect()}
    row, col = ({name[r.id]: np.array(r.vec) for r in fitted[s].collect()} for s in ("row", "col"))
    # columns were solved last: each is the least squares answer to the rows as they stand
    for token, got in col.items():
        own = [r for r in matrix.filter(F.col("right") == token).collect()]
        known = np.array([[*row[r.left][:-1], 1.0] for r in own])
        target, f = np.array([r.value - row[r.left][-1] for r in own]), np.array([r.f for r in own])
        want = np.linalg.solve(known.T @ (f[:, None] * known) + 0.1 * np.eye(4), known.T @ (f * target))
        assert np.allclose(got, want, atol=1e-8)


def test_the_weighted_fit_has_the_lower_weighted_loss(pairs):
    matrix = em.log_weights(pairs)
    weighted, ids = em._fit(matrix, 2, 6, 0.1)
    plain, plain_ids = em._fit(matrix.withColumn("f", F.lit(1.0)), 2, 6, 0.1)
    loss = em.weighted_loss(matrix, weighted, ids, dimensions=2)
    assert loss < em.weighted_loss(matrix, plain, plain_ids, dimensions=2)
    early, early_ids = em._fit(matrix, 2, 1, 0.1)
    assert loss <= em.weighted_loss(matrix, early, early_ids, dimensions=2) + 1e-9


def test_topics_come_apart(pairs):
    vectors = {r.token: np.array(r.vec) for r in em.factorise_weighted(em.log_weights(pairs), dimensions=4).collect()}
    assert len(vectors) == 25 and all(len(v) == 4 for v in vectors.values())

    def mean(one, two):
        found = [vectors[x] @ vectors[y] / np.linalg.norm(vectors[x]) / np.linalg.norm(vectors[y])
                 for x in vectors for y in vectors if x != y and x[0] == one and y[0] == two and "all" not in (x, y)]
        return sum(found) / len(found)

    assert min(mean("a", "a"), mean("b", "b")) > mean("a", "b") + 0.2


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "left string, right string, weight double")
    assert em.factorise_weighted(em.log_weights(empty), dimensions=2, rounds=1).count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_mean_vectors_shuffle_one_row_an_id(spark, monkeypatch, sent):
    """Sums of all places lie in one row; a row for each place was shuffled before."""
    monkeypatch.setattr(em, "SENT", sent, raising=False)
    members = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, "b", 3.0), (2, "c", 2.0), (3, "x", 1.0), (None, "a", 1.0)],
                                    "id bigint, token string, weight double")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -2.0]), ("c", [0.5, None]), ("d", [])], "token string, vec array<double>")
    means = em.mean_vectors(members, vectors, weight=F.col("weight"))
    assert {r.id: r.vec for r in means.collect()} == {1: pytest.approx([19 / 7, -10 / 7]), 2: [0.5, None], None: [1.0, 2.0]}
    assert "posexplode" not in means._jdf.queryExecution().executedPlan().toString()
    uneven = vectors.union(spark.createDataFrame([("x", [7.0])], vectors.schema))
    assert {r.id: r.vec for r in em.mean_vectors(members, uneven).collect()} == {
        1: pytest.approx([7 / 3, -2 / 3]), 2: [0.5, None], 3: [7.0], None: [1.0, 2.0]}


@pytest.mark.parametrize("vectors", [80_000, 6])  # solved in the tile, and from sums of several column blocks
def test_tiles_hold_few_rows_and_vectors(pairs, vectors, monkeypatch):
    """A tile held the equations of a whole side's rows before."""
    matrix = em.log_weights(pairs)
    whole, ids = em._fit(matrix, 3, 2, 0.1)
    monkeypatch.setattr(em, "VECTORS_PER_TILE", vectors)
    monkeypatch.setattr(em, "ROWS_PER_TILE", 4)
    monkeypatch.setattr(em, "ROWS_AT_ONCE", 3)
    cut, _ = em._fit(matrix, 3, 2, 0.1)
    for side in ("row", "col"):
        want, got = ({r.id: r.vec for r in f[side].collect()} for f in (whole, cut))
        assert want.keys() == got.keys() and all(np.allclose(got[i], want[i], atol=1e-8) for i in want)
    monkeypatch.undo()
    rows, cols = em.grid(30_000_000, 500_000, 12)
    assert 500_000 / rows <= em.ROWS_PER_TILE and 500_000 / cols <= em.VECTORS_PER_TILE


def test_a_block_is_sent_the_vectors_its_pairs_name(spark, monkeypatch):
    """Every fixed vector went to every block before: here a block of pairs names few of 400 tokens."""
    monkeypatch.setattr(em, "PAIRS_PER_TILE", 20)
    rows = [(f"w{i}", f"w{i + d}", 2.0) for i in range(399) for d in (-1, 1) if 0 <= i + d < 400]
    matrix = em.log_weights(spark.createDataFrame(rows, "left string, right string, weight double"))
    sent, plain = [], type(matrix).repartition

    def counted(self, *a):
        if "vec" in self.columns and "chunk" in self.columns:
            sent.append(self.count())
        return plain(self, *a)

    monkeypatch.setattr(type(matrix), "repartition", counted)
    em._fit(matrix, 2, 1, 0.1)
    assert len(sent) == 2 and max(sent) <= len(rows)
