"""Hashing, scaling and vector arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    An expression used inside a lambda is otherwise evaluated again for every
    array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_bucket(token: Column, size: int, namespace: str) -> Column:
    """md5("namespace:token") as one 128-bit number, modulo ``size`` (below 2^31)."""
    if not 0 < size < 1 << 31:
        raise ValueError("size must be positive and below 2^31")
    digest = F.md5(F.concat(F.lit(f"{namespace}:"), token).cast("binary"))
    if 256 % size == 0:  # the last byte decides
        return F.conv(F.substring(digest, 31, 2), 16, 10).cast("int") % size
    # Horner's rule over four parts of 32 bits: a remainder and a part stay below 2^63
    rest = F.lit(0).cast("long")
    for at in range(1, 33, 8):
        rest = (rest * (1 << 32) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) % size
    return rest.cast("int")


def entry(slot: Column, value: Column) -> Column:
    return F.struct(slot.cast("int").alias("slot"), value.cast("double").alias("value"))


def fixed_counts(tokens: Column, vocabulary: Sequence[str], offset: int) -> Column:
    """Sparse counts of the vocabulary words among the tokens."""
    def times(cleaned: Column, word: str) -> Column:
        return F.size(F.filter(cleaned, lambda t: t == word))

    return let(F.transform(tokens, lambda t: F.lower(F.btrim(t))), lambda cleaned: F.array(
        *[entry(F.lit(offset + i), times(cleaned, word)) for i, word in enumerate(vocabulary)]))


def hashed_shares(tokens: Column, size: int, namespace: str, offset: int) -> Column:
    """Sparse share of tokens per hash bucket, in order of buckets; shares sum to 1."""
    cleaned = F.filter(F.transform(tokens, lambda t: F.lower(F.btrim(t))), lambda t: t != "")
    return let(F.sort_array(F.transform(cleaned, lambda t: hash_bucket(t, size, namespace))), lambda buckets: let(
        F.filter(F.transform(buckets, lambda b, i: F.when((i == 0) | (b != F.get(buckets, i - 1)), i)), lambda i: i.isNotNull()),
        lambda starts: F.transform(starts, lambda at, k: entry(
            F.get(buckets, at) + offset, (F.coalesce(F.get(starts, k + 1), F.size(buckets)) - at) / F.size(buckets)))))


def scaled(value: Column, low: float, high: float) -> Column:
    """Clipped to [low, high] and scaled to [0, 1]; null counts as the midpoint."""
    v = F.coalesce(value.cast("double"), F.lit((low + high) / 2))
    return (F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)) - low) / (high - low)


def half_life_decay(ts: Column, as_of: Column, *, hours: float = 168.0) -> Column:
    """0.5 ** (age / half-life), clipped to [0.05, 1]; 0.5 without a time."""
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 3600.0
    decay = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.pow(F.lit(0.5), age / hours)))
    return F.when(ts.isNull(), F.lit(0.5)).otherwise(decay)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """Length, with 1 in place of 0."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v * v).cast("double")))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sigmoid(x: Column, *, clip: float = 8.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))


def softmax(rows: DataFrame, keys: list[str], column: str, *, out: str) -> DataFrame:
    """``rows`` with the softmax of ``column`` within ``keys``; the largest value is subtracted first, nulls stay null."""
    every = Window.partitionBy(*keys)
    weight = F.exp(F.col(column) - F.max(column).over(every))
    return rows.withColumn("_weight", weight).withColumn(out, F.col("_weight") / F.sum("_weight").over(every)).drop("_weight")


def unit(vec: Column) -> Column:
    return let(norm(vec), lambda n: F.transform(vec, lambda x: x / n))
