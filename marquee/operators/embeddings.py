"""Co-occurrence, embedding training by matrix factorisation, and embedding scores.

Sequential per-pair gradient loops do not distribute.  Skip-gram with negative
sampling factorises the shifted positive PMI matrix of the pairs (Levy and
Goldberg, 2014), which the distributed ALS of Spark ML does; the weighted-log model
fits log counts with biases, each pair by its weight, by alternating normal equations of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.text import item_tokens
from marquee.functions.vectors import dot, unit
from marquee.operators import tiles
from marquee.operators.interactions import liked10_popularity, positive_sequences
from marquee.operators.ranking import positions
from marquee.session import ensure_checkpoint_dir, materialize

DIMENSIONS = 24
# A pair's weight in the loss is min(1, (x / X_MAX)^ALPHA).
X_MAX, ALPHA = 10.0, 0.75
#: Rounds of the alternating fit; the loss hardly falls any more (a gradient method needs several times as many).
ROUNDS = 6
#: Pairs and rows of a tile.
PAIRS_PER_TILE, ROWS_PER_TILE = 1_000_000, 8_192
#: Pairs of a row that are taken together: 16 MB of fixed vectors.
VECTORS_PER_TILE = 80_000
#: Rows solved at once.
ROWS_AT_ONCE = 512
POPULARITY = 0.03
#: Numbers of a table of vectors that may be sent to every task (32 MB), and places that are summed up as columns.
SENT, MOST_COLUMNS = 4_000_000, 256
#: Places among which an id's members are dealt, so that an id with many is no single task's.
SPREAD = 4


def cooccurrence(sequences: DataFrame, *, window: int, weighted: bool = True) -> DataFrame:
    """Pairs of tokens at most ``window`` places apart, both directions: left, right, weight, n.

    ``sequences`` is long: (seq, pos, token).  A pair weighs 1 / distance.  The
    join key is (seq, place), so a very long sequence spreads over all tasks.
    """
    ahead = sequences.select(
        "seq", F.col("token").alias("left"), F.explode(F.sequence(F.lit(1), F.lit(window))).alias("gap"), "pos"
    ).select("seq", "left", "gap", (F.col("pos") + F.col("gap")).alias("pos"))
    pairs = ahead.join(sequences.select("seq", "pos", F.col("token").alias("right")), ["seq", "pos"])
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("left").alias("left"), F.col("right").alias("right"), "gap"),
        F.struct(F.col("right").alias("left"), F.col("left").alias("right"), "gap"))))
    weight = F.sum(1 / F.col("gap")) if weighted else F.sum(F.lit(1.0))
    return both.groupBy("left", "right").agg(weight.alias("weight"), F.count(F.lit(1)).alias("n"))


def item_token_sequences(items: DataFrame) -> DataFrame:
    tokens = item_tokens(F.col("title"), F.col("types"), F.col("directors"), F.col("country"), F.col("summary"))
    return items.select(F.col("item_id").alias("seq"), F.posexplode(tokens).alias("pos", "token"))


def interaction_sequences(interactions: DataFrame) -> DataFrame:
    return positive_sequences(interactions).select(
        F.col("user_id").alias("seq"), "pos", F.concat(F.lit("movie_"), F.col("item_id")).alias("token"))


def positive_pmi(pairs: DataFrame, *, negatives: int = 1, smoothing: float = 0.75) -> DataFrame:
    """max(PMI - ln(negatives), 0) with smoothed context frequencies: left, right, value.

    Observed pairs keep a 0, so every token gets a vector.  More negatives
    shift all pairs alike and, in a small vocabulary, would clip them all.
    """
    one = F.lit(0).alias("one")
    lefts = pairs.groupBy("left").agg(F.sum("n").alias("n_left"))
    rights = pairs.groupBy("right").agg(F.pow(F.sum("n"), F.lit(smoothing)).alias("n_right"))
    all_right = rights.agg(F.sum("n_right").alias("right_total")).select("right_total", one)
    value = F.ln(F.col("n") / F.col("n_left") * F.col("right_total") / F.col("n_right")) - math.log(negatives)
    joined = pairs.join(lefts, "left").join(rights, "right").withColumn("one", F.lit(0)).join(F.broadcast(all_right), "one")
    return joined.select("left", "right", F.greatest(value, F.lit(0.0)).alias("value"))


def log_weights(pairs: DataFrame, *, x_max: float = X_MAX, alpha: float = ALPHA) -> DataFrame:
    """left, right, value = ln(weight) and the pair's share f = min(1, (weight / x_max)^alpha) in the loss."""
    share = F.least(F.lit(1.0), F.pow(F.col("weight") / x_max, F.lit(alpha)))
    return pairs.select("left", "right", F.ln("weight").alias("value"), share.alias("f"))


def _numbered(matrix: DataFrame) -> DataFrame:
    """token, id of all tokens, in hash order: numbered in 4096 ranges of the hash, so that no task sorts the whole vocabulary."""
    names = matrix.select(F.explode(F.array("left", "right")).alias("token")).distinct().withColumn("_hash", F.xxhash64("token"))
    return materialize(positions(names, [], ["_hash", "token"], F.shiftright("_hash", 52), name="id").select("token", "id"))


def factorise_weighted(matrix: DataFrame, *, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, reg: float = 0.1) -> DataFrame:
    """Token vectors from the weighted fit value ~ u . v + b + c of (left, right, value, f): token, vec, the mean of u and v.

    Alternating least squares: with the columns fixed, a row's vector and bias solve the normal equations
    of its own pairs, each with its f.  Pairs are written once for each side, in blocks of rows; a block is sent the
    fixed vectors that its pairs name, and solves its rows.  A row with more pairs than a tile takes vectors is cut
    by column block, and the sums of its parts are added before they are solved, so a token that occurs with every
    other one is as many small sums, not one long row.
    """
    fitted, ids = _fit(matrix, dimensions, rounds, reg)
    both = fitted["row"].select("id", F.col("vec").alias("a")).join(fitted["col"].select("id", F.col("vec").alias("b")), "id", "full")
    zeros = F.array_repeat(F.lit(0.0), dimensions + 1)
    mean = F.zip_with(F.coalesce("a", zeros), F.coalesce("b", zeros), lambda x, y: (x + y) / 2)
    return both.join(ids, "id").select("token", F.slice(mean, 1, dimensions).alias("vec"))


_EQUATIONS = "id bigint, vec array<double>"
_SOLVED = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float64())), ("whole", pa.bool_())])


def grid(pairs: int, tokens: int, parallelism: int) -> tuple[int, int]:
    """Blocks of rows, and column blocks by which a long row is cut: the pairs and the fixed vectors of a tile stay within a task's memory."""
    n_col = max(1, math.ceil(tokens / VECTORS_PER_TILE))
    least = min(2 * parallelism, math.ceil(tokens / 64))
    return max(1, least, math.ceil(tokens / ROWS_PER_TILE) if n_col > 1 else 1, math.ceil(pairs / (n_col * PAIRS_PER_TILE))), n_col


def _fit(matrix: DataFrame, dimensions: int, rounds: int, reg: float) -> tuple[dict[str, DataFrame], DataFrame]:
    """Vectors with the bias behind them, by side: id, vec."""
    ids = _numbered(matrix)
    coded = matrix.join(ids.select(F.col("token").alias("left"), F.col("id").alias("row")), "left").join(
        ids.select(F.col("token").alias("right"), F.col("id").alias("col")), "right").select("row", "col", "value", "f")
    coded = materialize(coded)
    n_pairs = coded.count()
    n_row, n_col = grid(n_pairs, ids.count(), _blocks(matrix))
    n_blocks = max(n_row, math.ceil(n_pairs / PAIRS_PER_TILE))
    width = dimensions + 1
    upper = np.triu_indices(width)

    def side(own: str, other: str) -> tuple[DataFrame, DataFrame]:
        """The pairs by blocks of ``own``, a block as one packed row, and for each of ``other`` the blocks that name it."""
        pairs = coded.select(F.col(own).alias("id"), F.col(other).alias("other"), "value", "f")
        long = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > VECTORS_PER_TILE).select("id", F.lit(False).alias("whole"))
        placed = pairs.join(long, "id", "left").withColumn("whole", F.coalesce("whole", F.lit(True))).withColumn("_chunk", F.pmod(
            F.xxhash64("id", F.when(F.col("whole"), F.lit(0)).otherwise(F.pmod("other", F.lit(n_col)))), F.lit(n_blocks).cast("bigint")))
        placed = materialize(placed)
        named = placed.select("other", "_chunk").distinct().groupBy("other").agg(F.collect_list("_chunk").alias("blocks"))
        return tiles._chunks(placed, n_blocks), materialize(named)

    def solved(sums: np.ndarray) -> np.ndarray:
        left = np.zeros((len(sums), width, width))
        left[:, upper[0], upper[1]] = left[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
        return np.linalg.solve(left + reg * np.eye(width), sums[:, len(upper[0]):, None])[:, :, 0]

    def tile(packed: pa.Table, fixed: pa.Table) -> pa.Table:
        if not packed.num_rows or not fixed.num_rows:
            return _SOLVED.empty_table()
        pairs = pa.ipc.open_stream(packed["rows"][0].as_buffer()).read_all()
        factors = fixed["vec"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        at = pd.Index(fixed["id"].to_numpy()).get_indexer(pairs["other"].to_numpy())
        order = np.argsort(pairs["id"].to_numpy(), kind="stable")
        own, at = pairs["id"].to_numpy()[order], at[order]
        weight, value = pairs["f"].to_numpy()[order], pairs["value"].to_numpy()[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        whole, ends = pairs["whole"].to_numpy()[order][first], np.append(first, len(own))
        out: list[np.ndarray] = [np.empty(0)] * len(first)
        for r0 in range(0, len(first), ROWS_AT_ONCE):
            r1 = min(r0 + ROWS_AT_ONCE, len(first))
            sums = np.empty((r1 - r0, len(upper[0]) + width))
            for r in range(r0, r1):
                lo, hi = ends[r], ends[r + 1]
                known = factors[at[lo:hi]]
                target = value[lo:hi] - known[:, -1]
                known[:, -1] = 1.0
                scaled = known * weight[lo:hi, None]
                sums[r - r0, :-width], sums[r - r0, -width:] = (scaled.T @ known)[upper], scaled.T @ target
            some = whole[r0:r1]
            for r, vec in zip(r0 + np.flatnonzero(some), solved(sums[some])):
                out[r] = vec
            for r in np.flatnonzero(~some):
                out[r0 + r] = sums[r]
        return pa.table({"id": own[first], "vec": pa.array(out, pa.list_(pa.float64())), "whole": whole}, schema=_SOLVED)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.iloc[lo:lo + ROWS_AT_ONCE]
                yield pd.DataFrame({"id": some["id"], "vec": list(solved(np.vstack(some["vec"].to_numpy())))})

    def start(column: str, seed: int) -> DataFrame:
        # small numbers that follow from the token alone
        drawn = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.when(i == width, 0.0).otherwise(
            (F.pmod(F.xxhash64(F.lit(seed), "token", i), F.lit(10_007)) / 10_007.0 - 0.5) / dimensions))
        return ids.join(coded.select(F.col(column).alias("id")).distinct(), "id", "left_semi").select("id", drawn.alias("vec"))

    fitted = {"row": start("row", 1), "col": materialize(start("col", 2))}
    # a token has at most one row of sums for each column block
    added = F.aggregate(F.collect_list("vec"), F.array_repeat(F.lit(0.0), len(upper[0]) + width), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    # as many parts as twice the tiles, so that few tiles share a task
    parts = min(2 * n_blocks, tiles.MAX_PARTITIONS)
    sides = {"row": side("row", "col"), "col": side("col", "row")}
    for _ in range(rounds):
        for own, other in (("row", "col"), ("col", "row")):
            packed, named = sides[own]
            fixed = fitted[other].join(named, F.col("id") == F.col("other")).select("id", "vec", F.explode("blocks").alias("chunk"))
            done = materialize(packed.repartition(parts, "chunk").groupBy("chunk").cogroup(
                fixed.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(tile, f"{_EQUATIONS}, whole boolean"))
            rows = done.filter("whole").drop("whole")
            if n_col > 1:
                cut = done.filter("not whole").groupBy("id").agg(added.alias("vec")).mapInPandas(solve, _EQUATIONS)
                rows = materialize(rows.unionByName(cut))
            fitted[own] = rows
    return fitted, ids


def weighted_loss(matrix: DataFrame, fitted: dict[str, DataFrame], ids: DataFrame, *, dimensions: int = DIMENSIONS) -> float:
    """Mean of f times the squared error of the fit over the pairs of ``matrix``."""
    def side(name: str, token: str) -> DataFrame:
        return fitted[name].join(ids, "id").select(F.col("token").alias(token), F.col("vec").alias(f"{token}_vec"))

    both = matrix.join(side("row", "left"), "left").join(side("col", "right"), "right")
    product = dot(F.slice("left_vec", 1, dimensions), F.slice("right_vec", 1, dimensions))
    error = product + F.element_at("left_vec", dimensions + 1) + F.element_at("right_vec", dimensions + 1) - F.col("value")
    return both.agg((F.sum(F.col("f") * error * error) / F.sum("f")).alias("loss")).first()["loss"]


def factorise(matrix: DataFrame, *, dimensions: int = DIMENSIONS, iterations: int = 6, reg: float = 0.05,
              seed: int = 42) -> DataFrame:
    """Token vectors, the mean of a token's row and column factors: token, vec."""
    ensure_checkpoint_dir(matrix.sparkSession)
    ids = _numbered(matrix).withColumn("id", F.col("id").cast("int"))
    coded = matrix.join(ids.select(F.col("token").alias("left"), F.col("id").alias("row")), "left").join(
        ids.select(F.col("token").alias("right"), F.col("id").alias("col")), "right").select(
        "row", "col", F.col("value").cast("float").alias("value"))
    model = ALS(rank=dimensions, maxIter=iterations, regParam=reg, userCol="row", itemCol="col", ratingCol="value",
                seed=seed, numUserBlocks=_blocks(matrix), numItemBlocks=_blocks(matrix)).fit(coded)
    both = model.userFactors.select("id", F.col("features").alias("a")).join(
        model.itemFactors.select("id", F.col("features").alias("b")), "id", "full")
    zeros = F.array_repeat(F.lit(0.0), dimensions).cast("array<double>")
    vec = F.zip_with(F.coalesce(F.col("a").cast("array<double>"), zeros), F.coalesce(F.col("b").cast("array<double>"), zeros),
                     lambda x, y: (x + y) / 2)
    return both.join(ids, "id").select("token", vec.alias("vec"))


def _blocks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, 1)


def train(sequences: DataFrame, *, model: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Token vectors of a corpus by ``word2vec`` (window 2) or ``glove`` (window 3)."""
    if model == "word2vec":
        matrix = positive_pmi(materialize(cooccurrence(sequences, window=2, weighted=False)))
    elif model == "glove":
        return factorise_weighted(materialize(log_weights(cooccurrence(sequences, window=3))), dimensions=dimensions)
    else:
        raise KeyError(f"unknown embedding model: {model}")
    return factorise(materialize(matrix), dimensions=dimensions)


def mean_vectors(members: DataFrame, vectors: DataFrame, *, weight: Column | None = None) -> DataFrame:
    """(Weighted) mean vector per id from (id, token) rows: id, vec.

    Vectors are added place by place and map-side, so an id with any number of members is never
    gathered.  Where all vectors are equally long, each place is a column, and an id is one row of sums;
    else a row for each place.  Vectors of ``SENT`` numbers at most go to the members, which then stay where
    they are and add up before the shuffle.
    """
    vectors = vectors.filter(F.size("vec") > 0)
    n, least, width = vectors.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if n and n * width <= SENT:
        vectors = F.broadcast(vectors)
        # what lies together adds up before the shuffle: an id leaves at most SPREAD rows of sums
        members = members.repartition("id", F.pmod(F.xxhash64("token"), F.lit(SPREAD)))
    rows = members.join(vectors, "token").withColumn("w", F.lit(1.0) if weight is None else weight)
    if not n or least != width or width > MOST_COLUMNS:
        means = rows.select("id", "w", F.posexplode("vec").alias("i", "x")).groupBy("id", "i").agg(
            (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
        return means.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e")).select(
            "id", F.col("e.x").alias("vec"))
    sums = rows.groupBy("id").agg(F.sum("w").alias("w"), *[
        F.sum(F.col("w") * F.col("vec")[i]).alias(f"x{i}") for i in range(width)])
    return sums.select("id", F.array(*[F.col(f"x{i}") / F.col("w") for i in range(width)]).alias("vec"))


def text_vectors(items: DataFrame, *, model: str) -> DataFrame:
    """Item vectors from their text: item_id, vec."""
    sequences = materialize(item_token_sequences(items))
    tokens = materialize(train(sequences, model=model))
    return mean_vectors(sequences.select(F.col("seq").alias("id"), "token"), tokens).select(
        F.col("id").alias("item_id"), "vec")


def interaction_vectors(interactions: DataFrame, *, model: str) -> DataFrame:
    """Item vectors from the order in which users met the items: item_id, vec."""
    tokens = train(materialize(interaction_sequences(interactions)), model=model)
    return tokens.filter(F.col("token").startswith("movie_")).select(
        F.substring("token", 7, 40).cast("bigint").alias("item_id"), "vec")


def user_profiles(ratings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of a user's rated items weighted by max(score / 10, 0.1): user_id, vec."""
    members = ratings.select(F.col("user_id").alias("id"), F.col("item_id").alias("token"),
                             F.greatest(F.col("score10") / 100, F.lit(0.1)).alias("weight"))
    named = vectors.select(F.col("item_id").alias("token"), "vec")
    return mean_vectors(members, named, weight=F.col("weight")).select(F.col("id").alias("user_id"), "vec")


def _times(vec: Column, factor: float) -> Column:
    return F.transform(vec, lambda x: x * F.lit(factor))


def popularity(ratings: DataFrame, *, weight: float = POPULARITY) -> DataFrame:
    """Weighted sum of likes per item, in score units: item_id, bias."""
    return liked10_popularity(ratings).select("item_id", (F.col("likes10") * F.lit(weight) / 100).alias("bias"))


Space = tuple[DataFrame, DataFrame]


def embedding_space(ratings: DataFrame, vectors: DataFrame) -> Space:
    """Unit vectors of users (their profiles) and items in one vector space: (id, vec) each, written once."""
    vectors = materialize(vectors)
    users = user_profiles(ratings, vectors).select(F.col("user_id").alias("id"), unit(F.col("vec")).alias("vec"))
    items = vectors.select(F.col("item_id").alias("id"), unit(F.col("vec").cast("array<double>")).alias("vec"))
    return materialize(users), materialize(items)


def embedding_scores(ratings: DataFrame, vectors: DataFrame, *, popular: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Best ``n`` unrated items per user by cosine to the user's profile, plus the item's popularity bias.

    A user's own likes would have to be left out of the popularity of an item,
    but rated items are never candidates, so the sum needs no correction.
    """
    ratings = materialize(ratings.select("user_id", "item_id", "score10"))
    return score_spaces(ratings, [(embedding_space(ratings, vectors), 1.0)], popular=popular, n=n)


def score_spaces(ratings: DataFrame, spaces: list[tuple[Space, float]], *, popular: DataFrame | None = None,
                 n: int = 10) -> DataFrame:
    """Best ``n`` unrated items per user by the weighted sum of cosines in several vector spaces.

    Profiles and items become one concatenated vector each (weights folded
    into the profile side), so the blend is a single dot product.  An item or
    user missing from a space contributes 0 there.
    """
    lefts = [users.select("id", _times(F.col("vec"), weight).alias("vec")) for (users, _), weight in spaces]
    left, right = _concatenate(lefts), _concatenate([items for (_, items), _ in spaces])
    if popular is not None:
        right = right.join(popular, F.col("id") == F.col("item_id"), "left").select(
            "id", "vals", F.coalesce("bias", F.lit(0.0)).alias("bias"))
    own = ratings.select(F.col("user_id").alias("id"), F.col("item_id").alias("right_id"))
    return tiles.match(left, right, kind="dense", k=n, skip=own).select(
        F.col("left_id").alias("user_id"), F.col("right_id").alias("item_id"), "score", "rank")


def _concatenate(parts: list[DataFrame]) -> DataFrame:
    """One row per id with the vectors of all parts end to end, zeros where a part lacks the id."""
    if len(parts) == 1:
        return parts[0].select("id", F.col("vec").alias("vals"))
    rows = None
    for i, part in enumerate(parts):
        tagged = part.select("id", F.lit(i).alias("space"), "vec")
        rows = tagged if rows is None else rows.unionByName(tagged)
    by_space = rows.groupBy("id").agg(
        *[F.max(F.when(F.col("space") == i, F.col("vec"))).alias(f"v{i}") for i in range(len(parts))],
        F.max(F.size("vec")).alias("width"))
    zeros = F.transform(F.sequence(F.lit(1), F.col("width")), lambda _: F.lit(0.0))
    return by_space.select("id", F.concat(*[F.coalesce(f"v{i}", zeros) for i in range(len(parts))]).alias("vals"))


# Weights of the four vector spaces in the blend.
BLEND = {"word2vec_content": 0.3, "glove_content": 0.3, "word2vec_cf": 0.2, "glove_cf": 0.2}


def model_lists(ratings: DataFrame, vectors: dict[str, DataFrame], *, n: int = 10, pool: int | None = None,
                single: bool = True) -> dict[str, DataFrame]:
    """Ranked lists of the four single-model recommenders (``single``) and of their blend, ``semantic_hybrid``.

    ``vectors`` maps the names of ``BLEND`` to (item_id, vec).  The two cf models
    add the popularity bias, and with them the blend.  ``pool`` lengthens the
    blend's list.  Each vector space is prepared once for all lists.
    """
    ratings = materialize(ratings.select("user_id", "item_id", "score10"))
    popular = materialize(popularity(ratings))
    spaces = {name: embedding_space(ratings, vec) for name, vec in vectors.items()}
    lists = {}
    if single:
        lists = {name: score_spaces(ratings, [(space, 1.0)], popular=popular if name.endswith("_cf") else None, n=n)
                 for name, space in spaces.items()}
    cf_weight = sum(w for name, w in BLEND.items() if name.endswith("_cf"))
    lists["semantic_hybrid"] = score_spaces(
        ratings, [(spaces[name], w) for name, w in BLEND.items()],
        popular=popular.select("item_id", (F.col("bias") * F.lit(cf_weight)).alias("bias")), n=pool or n)
    return lists
