"""Which rows of two tables can match at all, chunk by chunk.

Alike rows are gathered into chunks around sampled pivots.  A chunk's summary says which
terms it holds and between which values.  An inverted index over the summaries (term ->
chunks) then tells for every row which chunks of the other side can hold a partner: those it
shares enough terms with, and, where only the best matches are wanted, how much a match
there can score at most.  Rows travel to these chunks only; nothing that could match is
left out, however the rows were gathered.

Summaries are no longer than their rows; the index reaches a chunk of rows only for terms
it holds.  Pivots are a fixed number of rows of a fixed length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from marquee.session import materialize

#: Rows around which others gather, and terms of each that count.
PIVOTS, PIVOT_TERMS = 64, 256
#: Numbers a dense summary may hold to be sent to every task: 32 MB.
DENSE_SUMMARY = 4_000_000
CELLS = 4_000_000


def flat(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.asarray(v) for v in column]) if len(column) else np.empty(0)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)`` for each pair."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift


def slices(cost: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose summed cost stays within ``limit`` (a single row may exceed it)."""
    start, used = 0, 0.0
    for i, c in enumerate(cost):
        if i > start and used + c > limit:
            yield start, i
            start, used = i, 0.0
        used += c
    if start < len(cost):
        yield start, len(cost)


def pivots_of(rows: DataFrame, n: int, dense: bool) -> list:
    """``n`` rows by the hash of their id, each cut to a fixed length."""
    columns = [F.slice("vals", 1, PIVOT_TERMS).alias("vals")] if not dense else ["vals"]
    if not dense:
        columns.insert(0, F.slice("terms", 1, PIVOT_TERMS).alias("terms"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(min(n, PIVOTS)).select(*columns).collect()


def gather(rows: DataFrame, pivots: list, *, dense: bool, by_value: bool, rows_per_chunk: int, entries_per_chunk: int) -> tuple[DataFrame, int]:
    """``rows`` with a ``chunk`` number, written once, and how many there are.

    A row goes to the pivot it is most alike; what gathers there is dealt to as many chunks as its
    measured size asks for.  Rows like no pivot are dealt by id.
    """
    if dense:
        matrix = np.array([p.vals for p in pivots], float)
    else:
        index = pd.Index(pd.unique(pd.Series([t for p in pivots for t in p.terms], dtype=object)))
        matrix = np.zeros((len(index) + 1, len(pivots)), np.float32)  # the last row is for unknown terms
        for k, p in enumerate(pivots):
            matrix[index.get_indexer(pd.Index(p.terms, dtype=object)), k] = np.abs(p.vals) if by_value else 1.0

    @F.pandas_udf("int")
    def nearest(terms: pd.Series, vals: pd.Series) -> pd.Series:
        if dense:
            return pd.Series((np.vstack(vals.to_numpy()) @ matrix.T).argmax(1).astype("int32"))
        lengths = vals.map(len).to_numpy()
        out = np.full(len(vals), -1, "int32")
        for lo, hi in slices(lengths * len(pivots), CELLS):
            codes = index.get_indexer(pd.Index(flat(terms[lo:hi]), dtype=object))
            values = np.abs(flat(vals[lo:hi]).astype(np.float32)) if by_value else np.ones(len(codes), np.float32)
            row = np.repeat(np.arange(hi - lo), lengths[lo:hi])
            on = codes >= 0
            if on.any():
                first = np.flatnonzero(np.append(True, np.diff(row[on]) > 0))
                like = np.add.reduceat(matrix[codes[on]] * values[on, None], first, axis=0)
                out[lo + row[on][first]] = np.where(like.max(1) > 0, like.argmax(1), -1)
        return pd.Series(out)

    placed = materialize(rows.withColumn("pivot", nearest("vals" if dense else "terms", "vals")))
    sizes = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vals")).alias("entries")).orderBy("pivot").collect()
    place, at = [], 0
    for r in sizes:
        parts = max(1, math.ceil(r.n / rows_per_chunk), math.ceil(r.entries / entries_per_chunk))
        place += [F.lit(r.pivot), F.struct(F.lit(at).alias("first"), F.lit(parts).alias("parts"))]
        at += parts
    if not at:
        return placed.withColumn("chunk", F.lit(0)).drop("pivot"), 1
    spot = F.create_map(*place)[F.col("pivot")]
    return placed.withColumn("chunk", (spot["first"] + F.pmod(F.xxhash64("id"), spot["parts"])).cast("int")).drop("pivot"), at


def summary(rows: DataFrame) -> DataFrame:
    """chunk, term, high and low (value of the term in the chunk, 0 where a row lacks it) and n (rows that hold it)."""
    entries = rows.select("chunk", F.explode(F.arrays_zip("terms", "vals")).alias("e"))
    return entries.groupBy("chunk", F.col("e.terms").alias("term")).agg(
        F.greatest(F.max("e.vals"), F.lit(0.0)).alias("high"), F.least(F.min("e.vals"), F.lit(0.0)).alias("low"), F.count(F.lit(1)).alias("n"))


def rows_saved(own: DataFrame, other: DataFrame, n_rows: int, n_other: int) -> bool:
    """Whether routing by terms can ship fewer rows than sending each to all chunks: at most one for each chunk of each entry."""
    shipped = own.groupBy("term").agg(F.sum("n").alias("n")).join(other.groupBy("term").agg(F.count(F.lit(1)).alias("chunks")), "term").agg(
        F.coalesce(F.sum(F.col("n") * F.col("chunks")), F.lit(0)).alias("s")).first()["s"]
    return shipped < n_rows * n_other


def route(rows: DataFrame, other: DataFrame, n_other: int, *, min_common: int, parts: int = 1) -> DataFrame:
    """``rows`` with ``others``, the chunks of the other side they share ``min_common`` terms with, and ``bounds``, the
    most that their product with a row there can be.  ``other`` is the other side's summary; each chunk of rows is
    walked in ``parts`` tasks.
    """
    names = rows.columns
    rows = rows.withColumn("part", F.col("chunk").cast("long") * parts + F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)))
    own = rows.select("part", F.explode("terms").alias("term")).distinct()
    index = own.join(other.select("term", F.col("chunk").alias("other"), "high", "low"), "term").withColumnRenamed("part", "at")

    def walk(mine: pd.DataFrame, needed: pd.DataFrame) -> pd.DataFrame:
        codes, terms = pd.factorize(needed["term"].to_numpy())
        order = np.argsort(codes, kind="stable")
        others, high, low = (needed[c].to_numpy()[order] for c in ("other", "high", "low"))
        sizes = np.bincount(codes, minlength=len(terms))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(terms) else np.zeros(0, int)
        lookup = pd.Index(terms)
        lengths = mine["vals"].map(len).to_numpy()
        found_others, found_bounds = [], []
        for lo, hi in slices(np.maximum(lengths, 1) * n_other, CELLS):
            part = mine.iloc[lo:hi]
            code = lookup.get_indexer(pd.Index(flat(part["terms"]))) if len(terms) else np.full(lengths[lo:hi].sum(), -1)
            value, row = flat(part["vals"]).astype(float), np.repeat(np.arange(hi - lo), lengths[lo:hi])
            on = code >= 0
            code, value, row = code[on], value[on], row[on]
            many = sizes[code] if len(code) else np.zeros(0, int)
            at = ranges(starts[code], many) if len(code) else np.zeros(0, int)
            cell, x = np.repeat(row, many) * n_other + others[at], np.repeat(value, many)
            common = np.bincount(cell, minlength=(hi - lo) * n_other).reshape(hi - lo, n_other)
            bound = np.bincount(cell, np.where(x > 0, x * high[at], x * low[at]), (hi - lo) * n_other).reshape(hi - lo, n_other)
            for k in range(hi - lo):
                to = np.flatnonzero(common[k] >= min_common)
                found_others.append(to.astype("int32"))
                found_bounds.append(bound[k, to])
        return mine[names].assign(others=found_others, bounds=found_bounds)

    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("others", T.ArrayType(T.IntegerType())),
                           T.StructField("bounds", T.ArrayType(T.DoubleType()))])
    return materialize(rows.groupBy("part").cogroup(index.groupBy("at")).applyInPandas(walk, schema))


BALL = "chunk int, centre array<double>, radius double, high array<double>, low array<double>, bias double"


def route_dense(rows: DataFrame, others: DataFrame, n_other: int) -> DataFrame:
    """``rows`` with all chunks of ``others`` and the most a row there can score.

    A chunk's vectors lie in a ball around their mean and in a box; a product is at most the lesser of what either allows.
    """
    width = len((rows.select("vals").first() or [[]])[0])

    def surround(part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.vstack(part["vals"].to_numpy())
        centre = matrix.mean(0)
        bias = float(part["bias"].max()) if "bias" in part else 0.0
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "centre": [centre], "radius": [np.sqrt(((matrix - centre) ** 2).sum(1)).max()],
                             "high": [matrix.max(0)], "low": [matrix.min(0)], "bias": [bias]})

    if 3 * n_other * width > DENSE_SUMMARY:
        everywhere = F.sequence(F.lit(0), F.lit(n_other - 1))
        return rows.withColumn("others", everywhere).withColumn("bounds", F.transform(everywhere, lambda _: F.lit(float("inf")).cast("double")))
    balls = others.groupBy("chunk").applyInPandas(surround, BALL).toPandas().sort_values("chunk")
    if balls.empty:
        return rows.withColumn("others", F.array().cast("array<int>")).withColumn("bounds", F.array().cast("array<double>"))
    numbers = balls["chunk"].to_numpy("int32")
    centre, high, low = (np.vstack(balls[c].to_numpy()) for c in ("centre", "high", "low"))
    radius, bias = balls["radius"].to_numpy(), balls["bias"].to_numpy()

    @F.pandas_udf("others array<int>, bounds array<double>")
    def reach(vals: pd.Series) -> pd.DataFrame:
        matrix = np.vstack(vals.to_numpy())
        ball = matrix @ centre.T + np.sqrt((matrix ** 2).sum(1))[:, None] * radius
        box = np.maximum(matrix, 0) @ high.T + np.minimum(matrix, 0) @ low.T
        bound = np.minimum(ball, box) + bias
        return pd.DataFrame({"others": [numbers] * len(vals), "bounds": list(bound)})

    return materialize(rows.withColumn("reach", reach("vals")).select(*rows.columns, "reach.others", "reach.bounds"))
