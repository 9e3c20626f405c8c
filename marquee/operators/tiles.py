"""Exact matching of two sets of sparse or dense vectors, best k or all.

A join on the shared term would emit every pair of rows inside each term group, which is
quadratic for a term that a third of the rows carry.  Here both sides are cut into chunks,
a tile is a left chunk with a right chunk, and each tile is scored by array arithmetic; only
matches leave it, of the best k per row only those.  Nothing is sampled or capped: the union
of the tile winners contains the global winners, and ties break by id.

Which rows go to which tiles follows from the data (``blocks``): alike rows share chunks, and a
row travels only to chunks that hold enough of its terms.  Where the best k are wanted, a
row first meets the chunk with the highest upper bound; its k-th score there is a floor, and
it goes on only to chunks whose bound reaches the floor.  Small tables, and tables in
which every row can match in every chunk, skip the index: each side is written once, chunk by chunk,
and a tile reads its two chunks.

Where rows share few terms, most pairs of rows share none.  Then the cost is that of the pairs of
entries with a common term: chunks hold as many entries as a task's memory takes, whatever their rows,
and a tile sums up only the cells that some term reaches (``_sparse_cells``).

Chunk counts follow the measured number of entries, so a tile stays within a task's memory
however large the tables are.  Ids with more than ``MAX_ROW_ENTRIES`` entries are not packed
into a row; ``match_long`` takes them through a join on the term, which is linear in what
their partners hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marquee.operators import blocks
from marquee.operators.blocks import flat as _flat, ranges as _ranges, slices as _cuts
from marquee.session import materialize

ENTRIES_PER_CHUNK = 4_000_000
ROWS_PER_CHUNK = 50_000
MAX_ROW_ENTRIES = 1_000_000
MAX_PARTITIONS = 20_000
#: Share of the cells (pairs of rows) that pairs of entries may reach for the product to count as sparse, and rows of a chunk then.
SPARSE, SPARSE_ROWS = 0.25, 500_000
#: Share of a chunk's entries that a sparse product takes, and pairs of entries formed at once: its tiles run beside each other in an executor's memory.
SPARSE_ENTRIES, SPARSE_PAIRS = 0.75, 1_000_000
_CELLS = blocks.CELLS
#: Right rows of a chunk where bounds can skip chunks, and chunks from which on that pays.
BOUNDED_ROWS, BOUNDED_CHUNKS, BOUNDED_FROM = 512, 32, 4
#: Rows sent to the tiles of a plain grid from which on rows are routed by their terms: below, the index costs more than it saves.
#: From as many on, routed dense rows are written once a round instead of copied for each chunk they go to.
ROUTED_FROM = 2_000_000

OUTPUT = T.StructType([
    T.StructField("left_id", T.LongType()),
    T.StructField("right_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("n_common", T.LongType()),
])


def micro(score: Column) -> Column:
    """Score in whole millionths, the unit in which scores are compared; ties then go by id."""
    return F.floor(score * 1e6 + 0.5)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and entries."""
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vals")), F.lit(0))).first())


def by_size(rows: int, entries: int) -> int:
    """Chunks that a side needs for its size."""
    return max(math.ceil(entries / ENTRIES_PER_CHUNK), math.ceil(rows / ROWS_PER_CHUNK), 1)


def grid_side(rows: int, entries: int, parallelism: int, sparse: bool = False) -> int:
    """Number of hash chunks for one side, from its measured size."""
    needed = max(math.ceil(entries / (SPARSE_ENTRIES * ENTRIES_PER_CHUNK)), math.ceil(rows / SPARSE_ROWS)) if sparse else by_size(rows, entries)
    return max(needed, min(math.ceil(math.sqrt(2 * parallelism)), max(rows // 64, 1)))


def is_sparse(left: DataFrame, right: DataFrame) -> bool:
    """Whether few pairs of rows share a term: pairs of entries with a common term against pairs of rows."""
    def held(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias(name))

    pairs = held(left, "a").join(held(right, "b"), "term").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0))).first()[0]
    return pairs < SPARSE * left.count() * right.count()


class _Postings:
    """Right side of a tile as term -> (row, value) lists."""

    def __init__(self, right: pd.DataFrame):
        lengths = right["terms"].map(len).to_numpy()
        codes, self.terms = pd.factorize(_flat(right["terms"]))
        order = np.argsort(codes, kind="stable")
        self.rows = np.repeat(np.arange(len(right)), lengths)[order]
        self.values = _flat(right["vals"])[order].astype(float)
        self.sizes = np.bincount(codes, minlength=len(self.terms))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.index = pd.Index(self.terms)
        self.row_sizes = lengths

    def expand(self, rows: np.ndarray, codes: np.ndarray, values: np.ndarray):
        """One element per (left entry, right entry) sharing a term: flat cell and both values.

        A left row meets each right entry at most once, so a row expands to no
        more than the entries of one right chunk.
        """
        lengths = self.sizes[codes]
        at = _ranges(self.starts[codes], lengths)
        cell = np.repeat(rows, lengths) * len(self.row_sizes) + self.rows[at]
        return cell, np.repeat(values, lengths), self.values[at]


def _pearson(cell, x, y, cells, min_common):
    """Cells with a positive correlation: their flat index, correlation and common count."""
    n_all = np.bincount(cell, minlength=cells)
    found = np.nonzero(n_all >= min_common)[0]
    slot = np.full(cells, -1)
    slot[found] = np.arange(len(found))
    at = slot[cell]
    use = at >= 0
    at, x, y = at[use], x[use], y[use]
    n = n_all[found]
    sx, sy, sxx, syy, sxy = (np.bincount(at, weights=w, minlength=len(found)) for w in (x, y, x * x, y * y, x * y))
    cov = n * sxy - sx * sy
    up = cov > 0
    norm = np.sqrt(n * sxx - sx * sx)[up] * np.sqrt(n * syy - sy * sy)[up]
    return found[up], cov[up] / norm, n[up]


def _sparse_cells(cell, x, y, kind, min_common):
    """Cells that a term reaches, ascending: their number, score and common count; for Pearson only positive ones of enough terms."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, int)
    n = np.diff(np.append(first, len(cell)))
    if kind == "dot":
        return cell[first], np.bincount(np.repeat(np.arange(len(first)), n), weights=(x * y)[order], minlength=len(first)), np.zeros(len(first))
    enough = n >= min_common
    use = order[np.repeat(enough, n)]
    found, n = cell[first][enough], n[enough]
    at, x, y = np.repeat(np.arange(len(found)), n), x[use], y[use]
    sx, sy, sxx, syy, sxy = (np.bincount(at, weights=w, minlength=len(found)) for w in (x, y, x * x, y * y, x * y))
    cov = n * sxy - sx * sy
    up = cov > 0
    norm = np.sqrt(n * sxx - sx * sx)[up] * np.sqrt(n * syy - sy * sy)[up]
    return found[up], cov[up] / norm, n[up]


def best_cells(rows, cols, score, n, ids, right_ids, k, with_ties):
    """Best ``k[row]`` of the listed cells per row, as output columns."""
    key = np.floor(score * 1e6 + 0.5)
    order = np.lexsort((right_ids[cols], -key, rows))
    rows, cols, score, key, n = rows[order], cols[order], score[order], key[order], n[order]
    if k is not None and len(rows):
        first = np.searchsorted(rows, rows)
        if with_ties:
            last = np.minimum(first + k[rows] - 1, np.searchsorted(rows, rows, side="right") - 1)
            keep = key >= key[last]
        else:
            keep = np.arange(len(rows)) - first < k[rows]
        rows, cols, score, n = rows[keep], cols[keep], score[keep], n[keep]
    return pd.DataFrame({"left_id": ids[rows], "right_id": right_ids[cols], "score": score,
                         "n_common": n.astype("int64")})


def cells_worth_ranking(score, valid, k):
    """Valid cells that can still be among the row's best ``k``: those at or above its k-th score."""
    if k is not None and score.shape[1] > int(k.max()):
        kth = int(k.max())
        key = np.where(valid, np.floor(score * 1e6 + 0.5), -np.inf)
        floor = -np.partition(-key, kth - 1, axis=1)[:, kth - 1]
        valid = valid & (key >= floor[:, None])
    return np.nonzero(valid)


def _score_tile(left: pd.DataFrame, right: pd.DataFrame, kind: str, exclude_self: bool, with_ties: bool,
                min_common: int, weight: float) -> pd.DataFrame:
    empty = pd.DataFrame({"left_id": np.empty(0, "int64"), "right_id": np.empty(0, "int64"),
                          "score": np.empty(0), "n_common": np.empty(0, "int64")})
    if left.empty or right.empty:
        return empty
    right_ids = right["id"].to_numpy()
    right_index = pd.Index(right_ids)
    width = len(right)
    notes = None
    if "x_right" in left:
        noted = left["x_right"].notna()
        notes, left = left.loc[noted, ["id", "x_right", "x_boost"]], left[~noted]
        if left.empty:
            return empty
    left = left.sort_values("id", kind="stable").reset_index(drop=True)
    ids, group = np.unique(left["id"].to_numpy(), return_inverse=True)
    firsts = np.append(np.searchsorted(group, np.arange(len(ids))), len(left))
    k_all = left["k"].to_numpy()[firsts[:-1]] if "k" in left else None
    skip = boost = None
    if notes is not None:
        many = notes["x_right"].map(len).to_numpy("int64")  # no notes in the tile: an empty column of objects
        rows = np.repeat(pd.Index(ids).get_indexer(notes["id"].to_numpy()), many)
        cols = right_index.get_indexer(_flat(notes["x_right"]).astype("int64"))
        order = np.argsort(rows, kind="stable")
        order = order[(rows[order] >= 0) & (cols[order] >= 0)]
        rows, cols, added = rows[order], cols[order], _flat(notes["x_boost"]).astype(float)[order]
        gone = np.isnan(added)
        skip, boost = (rows[gone], cols[gone]), (rows[~gone], cols[~gone], added[~gone])
    counted = np.diff(firsts)
    cost = np.full(len(left), width)
    if kind == "dense":
        left_matrix = np.vstack(left["vals"].to_numpy())
        right_matrix = np.vstack(right["vals"].to_numpy())
        bias = right["bias"].to_numpy() if "bias" in right else 0.0
    else:
        postings = _Postings(right)
        lengths = left["terms"].map(len).to_numpy()
        codes = postings.index.get_indexer(_flat(left["terms"])) if len(postings.terms) else np.empty(0, int)
        codes = codes[:lengths.sum()]
        values = _flat(left["vals"]).astype(float)
        entry_row = np.repeat(np.arange(len(left)), lengths)
        seen = codes >= 0
        codes, values, entry_row = codes[seen], values[seen], entry_row[seen]
        entry_at = np.searchsorted(entry_row, np.arange(len(left) + 1))
        cost = cost + np.bincount(entry_row, weights=postings.sizes[codes], minlength=len(left))

    def excluded(g0: int, g1: int):
        """(row, column) cells of the groups g0..g1 that may not match."""
        rows, cols = [np.empty(0, int)], [np.empty(0, int)]
        if exclude_self:
            rows.append(np.arange(g1 - g0))
            cols.append(right_index.get_indexer(ids[g0:g1]))
        if skip is not None:
            lo, hi = np.searchsorted(skip[0], (g0, g1))
            rows.append(skip[0][lo:hi] - g0)
            cols.append(skip[1][lo:hi])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        return rows[cols >= 0], cols[cols >= 0]

    # an addition can lift a cell that no term reaches
    sparse = kind != "dense" and boost is None and cost.sum() - len(left) * width < SPARSE * len(ids) * width
    if sparse:
        group_cost = np.bincount(group, weights=cost - width + 1)
    else:
        group_cost = np.maximum(np.bincount(group, weights=cost) if kind == "pearson" else 0.0, np.full(len(ids), width))
    parts = []
    for g0, g1 in _cuts(group_cost, SPARSE_PAIRS if sparse else _CELLS):
        lo, hi = firsts[g0], firsts[g1]
        k = None if k_all is None else k_all[g0:g1]
        out_rows, out_cols = excluded(g0, g1)
        if sparse or kind == "pearson":
            e = slice(entry_at[lo], entry_at[hi])
            cell, x, y = postings.expand(group[entry_row[e]] - g0, codes[e], values[e])
            found, score, n = (_sparse_cells(cell, x, y, kind, min_common) if sparse
                               else _pearson(cell, x, y, (g1 - g0) * width, min_common))
            if kind == "dot":
                score = score * weight
            keep = ~np.isin(found, out_rows * width + out_cols)
            if kind == "dot":
                keep &= score > 0
            found, score, n = found[keep], score[keep], n[keep]
            parts.append(best_cells(found // width, found % width, score, n, ids[g0:g1], right_ids, k, with_ties))
            continue
        if kind == "dense":
            score = left_matrix[lo:hi] @ right_matrix.T * weight + bias
            valid = np.ones_like(score, dtype=bool)
        else:
            score = np.zeros((g1 - g0) * width)
            for r0, r1 in _cuts(cost[lo:hi], _CELLS):
                e = slice(entry_at[lo + r0], entry_at[lo + r1])
                cell, x, y = postings.expand(group[entry_row[e]] - g0, codes[e], values[e])
                score += np.bincount(cell, weights=x * y, minlength=len(score))
            score = score.reshape(g1 - g0, width)
            score *= weight
            if boost is not None:
                a, b = np.searchsorted(boost[0], (g0, g1))
                np.add.at(score, (boost[0][a:b] - g0, boost[1][a:b]), boost[2][a:b])
            valid = score > 0
        valid[out_rows, out_cols] = False
        rows, cols = cells_worth_ranking(score, valid, k)
        parts.append(best_cells(rows, cols, score[rows, cols], np.zeros(len(rows)), ids[g0:g1], right_ids, k, with_ties))
    return pd.concat(parts, ignore_index=True) if parts else empty


def run_tiles(lefts: DataFrame, rights: DataFrame, notes: DataFrame | None, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
           schema: T.StructType, tiles: int) -> DataFrame:
    """Run ``run`` on the left and right rows of each ``tile``; ``notes`` are (id, tile, n: (r, b)) on single pairs."""
    if notes is not None:
        # One row per (tile, id), no longer than a right chunk: far fewer rows to hand over one by one.
        packed = notes.groupBy("tile", "id").agg(F.collect_list("n").alias("n")).select(
            "tile", "id", F.col("n.r").alias("x_right"), F.col("n.b").alias("x_boost"))
        lefts = lefts.unionByName(packed, allowMissingColumns=True)
    # The right columns are renamed so that matching a table with itself stays unambiguous.
    rights = rights.select(*[F.col(c).alias(c if c == "tile" else f"r_{c}") for c in rights.columns])

    def tile(left_rows: pd.DataFrame, right_rows: pd.DataFrame) -> pd.DataFrame:
        return run(left_rows, right_rows.rename(columns=lambda c: c.removeprefix("r_")))

    # Both sides are dealt by tile once, and the groups are formed where they lie; twice as many parts
    # as tiles keep tiles apart, and where a part holds several, they are still scored one at a time.
    parts = min(2 * tiles, MAX_PARTITIONS)
    return lefts.repartition(parts, "tile").groupBy("tile").cogroup(
        rights.repartition(parts, "tile").groupBy("tile")).applyInPandas(tile, schema)


def _marks(skip: DataFrame | None, boost: DataFrame | None) -> DataFrame | None:
    """(id, right_id, n) of the pairs that may not match (NaN) or get an addition."""
    notes = None
    for pairs, value in ((skip, F.lit(float("nan"))), (boost, F.col("boost"))):
        if pairs is not None:
            rows = pairs.select("id", "right_id", F.struct(F.col("right_id").alias("r"), value.alias("b")).alias("n"))
            notes = rows if notes is None else notes.unionByName(rows)
    return notes


def over_tiles(left: DataFrame, right: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
               schema: T.StructType, *, skip: DataFrame | None = None, boost: DataFrame | None = None,
               sparse: bool = False) -> DataFrame:
    """Run ``run(left rows, right rows)`` on every tile of the grid of hash chunks of ``id``.

    Each side is shuffled once and written once, a chunk as one packed row; a tile reads its two
    chunks from there, so what is shuffled and written grows with the rows, not with the tiles.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    n_left, n_right = grid_side(*measured(left), cores, sparse), grid_side(*measured(right), cores, sparse)

    def chunk(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n).cast("bigint"))

    notes = _marks(skip, boost)
    if n_left * n_right == 1:
        only = F.lit(0).cast("bigint").alias("tile")
        return run_tiles(left.select("*", only), right.select("*", only), None if notes is None else notes.select("id", only, "n"), run, schema, 1)
    lefts, rights = left.withColumn("_chunk", chunk("id", n_left)), right.withColumn("_chunk", chunk("id", n_right))
    if notes is not None:
        # a row for each right chunk, so that none is longer than that
        packed = notes.withColumn("_to", chunk("right_id", n_right)).groupBy("id", "_to").agg(F.collect_list("n").alias("n"))
        known = packed.join(left.select("id").distinct(), "id", "left_semi").select(
            "id", "_to", F.col("n.r").alias("x_right"), F.col("n.b").alias("x_boost"), chunk("id", n_left).alias("_chunk"))
        lefts = lefts.unionByName(known, allowMissingColumns=True)
    return _written_tiles(_chunks(lefts, n_left), _chunks(rights, n_right), run, schema)


def _written_tiles(lefts: DataFrame, rights: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                   schema: T.StructType) -> DataFrame:
    """Run ``run`` on each written chunk (``_chunks``) of one side with each of the other.

    A left row with ``_to`` meets that right chunk only; rows with ``_others`` meet the chunks listed there.
    """
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, mine, theirs in zip(batch["l_chunk"], batch["r_chunk"], batch["l_rows"], batch["r_rows"]):
                left_rows = _meeting(mine, to.as_py())
                if not left_rows.num_rows:
                    continue
                found = run(left_rows.to_pandas(), _meeting(theirs, at.as_py()).to_pandas())
                for lo in range(0, len(found), ROWS_PER_CHUNK):
                    yield pa.RecordBatch.from_pandas(found.iloc[lo:lo + ROWS_PER_CHUNK], schema=arrow, preserve_index=False)

    # every chunk with every other where they lie: neither side may be sent whole
    pairs = lefts.toDF("l_chunk", "l_rows").hint("shuffle_replicate_nl").crossJoin(rights.toDF("r_chunk", "r_rows"))
    return pairs.mapInArrow(score, schema)


def _meeting(packed: pa.Scalar, chunk: int) -> pa.Table:
    """The rows of a packed chunk that meet the chunk ``chunk`` of the other side."""
    rows = pa.ipc.open_stream(packed.as_buffer()).read_all()
    keep = np.ones(rows.num_rows, bool)
    if "_others" in rows.column_names:
        others = rows["_others"].combine_chunks()
        lengths = others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        line = np.repeat(np.arange(len(lengths)), lengths)
        keep = np.bincount(line[others.flatten().to_numpy(zero_copy_only=False) == chunk], minlength=len(lengths)) > 0
    if "_to" in rows.column_names:
        to = rows["_to"].combine_chunks()
        keep = np.where(to.is_valid().to_numpy(zero_copy_only=False), to.fill_null(-1).to_numpy(zero_copy_only=False) == chunk, keep)
    rows = rows.drop_columns([c for c in ("_others", "_to") if c in rows.column_names])
    return rows if keep.all() else rows.filter(pa.array(keep))


def _chunks(rows: DataFrame, n: int) -> DataFrame:
    """Each ``_chunk`` (0 to n - 1) of ``rows`` as one packed row in a partition of its own, written once: chunk, rows."""
    spark = rows.sparkSession
    # for each partition a number that is dealt there
    dealt = spark.range(40 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part")).groupBy("part").agg(F.min("id").alias("id")).orderBy("part")
    keys = F.array(*[F.lit(r["id"]).cast("bigint") for r in dealt.collect()])

    def pack_rows(table: pa.Table) -> pa.Table:
        sink, at = pa.BufferOutputStream(), table["_chunk"][0].as_py()
        table = table.drop_columns(["_chunk", "_key"]).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.table({"chunk": pa.array([at], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    keyed = rows.withColumn("_key", F.element_at(keys, (F.col("_chunk") + 1).cast("int"))).repartition(n, "_key")
    return materialize(keyed.groupBy("_key").applyInArrow(pack_rows, "chunk bigint, rows binary"))


def _routed(left: DataFrame, right: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], *, kind: str,
            min_common: int, best: bool, weight: float, skip: DataFrame | None, boost: DataFrame | None) -> DataFrame | None:
    """Matches by tiles that can hold any; None where a plain grid is as good."""
    cores, dense = left.sparkSession.sparkContext.defaultParallelism, kind == "dense"
    size_left, size_right = measured(left), measured(right)
    if not size_left[0] or not size_right[0]:
        return None
    n_left, n_right = by_size(*size_left), by_size(*size_right)
    if not dense and size_left[0] * grid_side(*size_right, cores) + size_right[0] * grid_side(*size_left, cores) < ROUTED_FROM:
        return None
    if best:
        n_right = max(n_right, min(size_right[0] // BOUNDED_ROWS, BOUNDED_CHUNKS))
        if n_right < BOUNDED_FROM:
            return None
    elif dense:
        return None
    pivots = blocks.pivots_of(right, n_right, dense)
    how = {"dense": dense, "by_value": kind == "dot", "entries_per_chunk": ENTRIES_PER_CHUNK}
    rights, n_right = blocks.gather(right, pivots, rows_per_chunk=2 * math.ceil(size_right[0] / n_right), **how)
    if n_left > 1:
        lefts, n_left = blocks.gather(left, pivots[:n_left], rows_per_chunk=ROWS_PER_CHUNK, **how)
    else:
        lefts = materialize(left.withColumn("chunk", F.lit(0)))
    if dense:
        routed = blocks.route_dense(lefts, rights, n_right)
    else:
        index, own = materialize(blocks.summary(rights)), materialize(blocks.summary(lefts))
        if not best and not blocks.rows_saved(own, index, size_left[0], n_right):
            return None
        routed = blocks.route(lefts, index, n_right, min_common=min_common, parts=math.ceil(2 * cores / n_left))
        if n_left > 1:  # right rows, too, only go where they can match
            back = blocks.route(rights, own, n_left, min_common=min_common, parts=math.ceil(2 * cores / n_right))
            rights = back.drop("bounds")
    columns = left.columns
    notes = _marks(skip, boost)
    if notes is not None:
        at = notes.join(lefts.select("id", "chunk").distinct(), "id").join(
            rights.select(F.col("id").alias("right_id"), F.col("chunk").alias("other")), "right_id")
        notes = materialize(at.select("id", "chunk", "other", "n"))

    copied = dense and size_left[0] * n_right < ROUTED_FROM
    if not copied:  # written once a round, however many chunks a row goes to
        written = _chunks(rights.withColumnRenamed("others", "_others").withColumnRenamed("chunk", "_chunk"), n_right)

    def ship(rows: DataFrame) -> DataFrame:
        """Tiles of left rows with the chunks (``to``) that each of them goes to."""
        if not copied:
            mine = rows.filter(F.size("to") > 0).select(*columns, F.col("chunk").alias("_chunk"), F.col("to").alias("_others"))
            if notes is not None:
                packed = notes.groupBy("id", "chunk", "other").agg(F.collect_list("n").alias("n")).select(
                    "id", F.col("n.r").alias("x_right"), F.col("n.b").alias("x_boost"), F.col("chunk").alias("_chunk"),
                    F.col("other").cast("bigint").alias("_to"))
                mine = mine.unionByName(packed, allowMissingColumns=True)
            return _written_tiles(_chunks(mine, n_left), written, run, OUTPUT)
        rows = materialize(rows.select(*columns, "chunk", F.explode("to").alias("other")))
        live = materialize(rows.select("chunk", "other").distinct())
        tile = (F.col("chunk").cast("long") * n_right + F.col("other")).alias("tile")
        mine = live.select(F.col("chunk").alias("_at"), F.col("other").alias("_chunk"))
        theirs = rights.join(mine, F.col("chunk") == F.col("_chunk")).withColumn("tile", F.col("_at").cast("long") * n_right + F.col("chunk"))
        own_notes = None if notes is None else notes.join(live, ["chunk", "other"], "left_semi").select("id", tile, "n")
        return run_tiles(rows.select(*columns, tile), theirs.select(*right.columns, "tile"), own_notes, run, OUTPUT, max(1, min(2 * live.count(), n_left * n_right)))

    if not best:
        return ship(routed.withColumn("to", F.col("others")))
    # the chunk that promises most first, then those that can still reach the k-th score found there
    reach = F.transform(F.arrays_zip("bounds", "others"), lambda x: F.struct((x["bounds"] * weight).alias("bound"), x["others"].alias("other")))
    reach = reach if dense else F.filter(reach, lambda x: x["bound"] > 0)
    routed = routed.select(*columns, "chunk", reach.alias("reach")).withColumn("most", F.array_max("reach"))
    first = materialize(ship(routed.filter("most is not null").withColumn("to", F.array("most.other"))))
    floors = first.groupBy(F.col("left_id").alias("id")).agg(F.count(F.lit(1)).alias("have"), F.min(micro(F.col("score"))).alias("floor"))
    further = routed.join(floors, "id", "left").withColumn("floor", F.when(F.col("have") >= F.col("k"), F.col("floor")))
    open_ = F.filter("reach", lambda x: (x["other"] != F.col("most.other")) & (F.col("floor").isNull() | (micro(x["bound"]) + 1 >= F.col("floor"))))
    second = ship(further.withColumn("to", F.transform(open_, lambda x: x["other"])))
    return first.unionByName(second)


def match(left: DataFrame, right: DataFrame, *, kind: str, k: int | None = None, exclude_self: bool = False,
          with_ties: bool = False, min_common: int = 2, weight: float = 1.0, skip: DataFrame | None = None,
          boost: DataFrame | None = None) -> DataFrame:
    """Best matches of each left row among the right rows.

    Rows are ``(id bigint, terms array, vals array<double>)``; ``dense`` uses
    ``vals`` as coordinates and needs no ``terms``.  Kinds:

    * ``dot``      sum of products over shared terms
    * ``pearson``  correlation over the shared terms (at least ``min_common``, positive only)
    * ``dense``    dot product plus the right side's optional ``bias``

    A left ``k`` column overrides the constant ``k`` per row (no limit when both
    are absent).  ``skip`` (id, right_id) lists pairs that may not match and
    ``boost`` (id, right_id, boost) adds to the ``weight``-ed score of single
    pairs; each such row travels to the one tile it concerns.  ``with_ties``
    keeps every match that ties with the last kept one.
    """
    if k is not None and "k" not in left.columns:
        left = left.withColumn("k", F.lit(k))

    def run(left_rows: pd.DataFrame, right_rows: pd.DataFrame) -> pd.DataFrame:
        return _score_tile(left_rows, right_rows, kind, exclude_self, with_ties, min_common, weight)

    scored = None
    sparse = kind != "dense" and boost is None and is_sparse(left, right)
    if boost is None and not sparse:  # an addition can lift a pair that shares nothing
        scored = _routed(left, right, run, kind=kind, min_common=min_common if kind == "pearson" else 1,
                         best="k" in left.columns and kind != "pearson", weight=weight, skip=skip, boost=boost)
    if scored is None:
        scored = over_tiles(left, right, run, OUTPUT, skip=skip, boost=boost, sparse=sparse)
    if k is None and "k" not in left.columns:
        return scored
    keyed = scored.withColumn("micro", micro(F.col("score")))
    order = [F.col("micro").desc()] if with_ties else [F.col("micro").desc(), F.col("right_id")]
    place = (F.rank() if with_ties else F.row_number()).over(Window.partitionBy("left_id").orderBy(*order))
    ranked = keyed.withColumn("rank", place).drop("micro")
    if k is not None:
        return ranked.filter(F.col("rank") <= k)
    limits = left.groupBy(F.col("id").alias("left_id")).agg(F.max("k").alias("_k"))
    return ranked.join(limits, "left_id").filter(F.col("rank") <= F.col("_k")).drop("_k")


def match_long(left: DataFrame, right: DataFrame, *, kind: str, k: int | None = None, min_common: int = 2,
               max_entries: int | None = None) -> DataFrame:
    """``match`` of a table of long rows (id, term, val) with another or itself, self pairs left out.

    Ids with more than ``max_entries`` rows are never packed into one row: all
    their pairs come from a plain join on the term, which is linear in the rows
    their partners hold, and its sums combine before the shuffle.
    """
    limit = max_entries or MAX_ROW_ENTRIES
    same = left is right
    wide_left = _wide(left, limit)
    wide_right = wide_left if same else _wide(right, limit)
    has_wide = not wide_left.isEmpty() or not (same or wide_right.isEmpty())
    slim_left, slim_right = left, right
    if has_wide:
        slim_left, slim_right = left.join(wide_left, "id", "left_anti"), right.join(wide_right, "id", "left_anti")
    packed = materialize(pack(slim_left, "id", "term", "val"))
    found = match(packed, packed if same else materialize(pack(slim_right, "id", "term", "val")), kind=kind, k=k,
                  exclude_self=True, min_common=min_common).select(OUTPUT.names)
    if not has_wide:
        return found
    joined = _join_pairs(left.join(wide_left, "id", "left_semi"), right, kind, min_common).unionByName(
        _join_pairs(slim_left, right.join(wide_right, "id", "left_semi"), kind, min_common))
    everything = found.unionByName(joined)
    if k is None:
        return everything
    best = Window.partitionBy("left_id").orderBy(micro(F.col("score")).desc(), "right_id")
    return everything.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= k).drop("_place")


def _wide(rows: DataFrame, limit: int) -> DataFrame:
    return rows.groupBy("id").count().filter(F.col("count") > limit).select("id")


def _join_pairs(left: DataFrame, right: DataFrame, kind: str, min_common: int) -> DataFrame:
    a = left.select(F.col("id").alias("left_id"), "term", F.col("val").alias("x"))
    b = right.select(F.col("id").alias("right_id"), "term", F.col("val").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = a.join(b, "term").filter(F.col("left_id") != F.col("right_id")).groupBy("left_id", "right_id").agg(
        F.count(F.lit(1)).alias("n_common"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    if kind == "dot":
        return sums.filter(F.col("sxy") > 0).select(
            "left_id", "right_id", F.col("sxy").alias("score"), F.lit(0).cast("bigint").alias("n_common"))
    n = F.col("n_common")
    norm = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")) * F.sqrt(
        (n * F.col("syy") - F.col("sy") * F.col("sy")).cast("double"))
    return sums.filter(n >= min_common).withColumn("cov", n * F.col("sxy") - F.col("sx") * F.col("sy")).filter(
        F.col("cov") > 0).select("left_id", "right_id", (F.col("cov") / norm).alias("score"), "n_common")


def pack(rows: DataFrame, id_col: str, term_col: str, val_col: str) -> DataFrame:
    """Long (id, term, value) rows to one row per id."""
    return (
        rows.groupBy(F.col(id_col).alias("id"))
        .agg(F.collect_list(F.struct(F.col(term_col).alias("t"), F.col(val_col).cast("double").alias("v"))).alias("e"))
        .select("id", F.col("e.t").alias("terms"), F.col("e.v").alias("vals"))
    )
