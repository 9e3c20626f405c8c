"""Exact top-k inner products on a bit-sliced index.

Index.  Quantised vectors are dealt to blocks; a block holds its rows in id order and,
for every dimension, one bitmap per binary place of (component - the block's smallest
component): the attribute's slices.

Score.  For a query component q > 0 the slices of its dimension are added once for every
one-bit of q, shifted to its place; for q < 0 the complements are added for -q, which
differs from q times the slice value by a constant.  Sums are carry-save bitmaps, turned to
plain binary slices once per query and block.

Selection.  From the most significant slice down, rows that surely belong to the best k are
told from rows that still tie; when the slices end the tied rows are taken in id order, so
the boundary is exact.  The best k of each block are merged by score and id.

Every query block meets every index block once: queries and blocks are both cut to a fixed
size.  Components travel in the narrowest integers that hold them, and an index block once for
``SECTION`` query blocks, so a tile is a few megabytes and nothing is broadcast.

Defined results: vectors that are null or hold a null or non-finite component take no part;
only vectors of equal length are compared; a query is not compared with rows of its own id;
rows that repeat an id are candidates each, and queries each; scores are 64-bit integers, so
quantised components should stay below 2^28; other columns are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.llm.staging import staged

BLOCK_ROWS = 32_768
BLOCK_QUERIES = 256
#: Query blocks that meet an index block in one tile.
SECTION = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def pack_rows(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as bitmaps of 64-bit words."""
    words = -(-bits.shape[-1] // 64)
    wide = np.zeros((*bits.shape[:-1], words * 64), np.uint8)
    wide[..., : bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


class Block:
    """Slices of one block of vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows = len(ids)
        self.low = values.min(0) if values.shape[1] else np.zeros(0, np.int64)
        above = values - self.low
        self.places = [max(1, int(a).bit_length()) for a in above.max(0)] if values.shape[1] else []
        self.slices = [pack_rows(((above[:, d][None, :] >> np.arange(n)[:, None]) & 1).astype(np.uint8))
                       for d, n in enumerate(self.places)]
        self.valid = pack_rows(np.ones((1, self.rows), np.uint8))[0]

    def sums(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Binary slices of the scores' variable part, and the constant to add."""
        constant = int(sum(int(q) * int(l) for q, l in zip(query, self.low)))
        most = 0
        for q, n in zip(query.tolist(), self.places):
            most += abs(q) * ((1 << n) - 1)
            if q < 0:
                constant += q * ((1 << n) - 1)
        width, words = max(1, most.bit_length()), len(self.valid)
        total, spare = np.zeros((width, words), np.uint64), np.empty((width, words), np.uint64)
        # row r + 1 of a carry array belongs to place r + 1, written while place r is added
        carry, next_carry = np.zeros((width + 1, words), np.uint64), np.zeros((width + 1, words), np.uint64)
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            own = self.slices[d] if q > 0 else ~self.slices[d]
            for place in range(abs(q).bit_length()):
                if abs(q) >> place & 1:
                    at = slice(place, place + len(own))
                    np.bitwise_xor(total, carry[:-1], out=spare)
                    np.bitwise_and(total, carry[:-1], out=next_carry[1:])
                    next_carry[1:][at] |= spare[at] & own
                    spare[at] ^= own
                    total, spare, carry, next_carry = spare, total, next_carry, carry
        out = np.zeros(words, np.uint64)
        for place in range(width):
            half = total[place] ^ carry[place]
            both = total[place] & carry[place]
            total[place] = half ^ out
            out = both | (half & out)
        return total, constant

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the block's best k rows for a query, rows of the query's own id aside."""
        total, constant = self.sums(query)
        tied = self.valid.copy()
        for own in range(*np.searchsorted(self.ids, [query_id, query_id + 1])):
            tied[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        sure, count = np.zeros_like(tied), 0
        if int(np.bitwise_count(tied).sum()) > k:
            for place in range(len(total) - 1, -1, -1):
                ones = tied & total[place]
                n = int(np.bitwise_count(ones).sum())
                if count + n > k:
                    tied = ones
                elif n:
                    sure, count, tied = sure | ones, count + n, tied & ~total[place]
                    if count == k:
                        break
        edge = self._positions(tied)[: k - count]
        at = np.concatenate([self._positions(sure), edge])
        bits = (total[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        scores = (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(0) + constant
        return self.ids[at], scores

    @staticmethod
    def _positions(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64)
        row, bit = np.nonzero(bits)
        return words[row] * 64 + bit


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def narrow(values: np.ndarray) -> tuple[bytes, int]:
    """Integers as the narrowest kind that holds all of them, and its width in bytes."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return values.astype(kind).tobytes(), np.dtype(kind).itemsize


def widened(data: bytes, width: int, dims: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"i{width}").astype(np.int64).reshape(rows, dims)


def sectioned(index: DataFrame, queries: DataFrame, blocks: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tiles they go to: each index block once for every ``SECTION`` query blocks."""
    sections = -(-parts // SECTION)
    return (index.withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(sections - 1)))),
            queries.withColumn("section", F.floor(F.col("part") / SECTION).cast("int")).withColumn(
                "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))


def top_k(vectors: DataFrame, *, k: int = 20, query: Column, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = 64, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` rows for every row for which ``query`` holds."""
    rows = staged(vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("asks"),
        quantised(F.col(vector), scale).alias("values")).withColumn("dims", F.size("values")), "quantised")
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    blocks, parts = max(1, -(-sizes["rows"] // block_rows)), max(1, -(-sizes["queries"] // block_queries))
    spread = F.xxhash64("vec_id", F.lit(1))
    # the index: one row per block, its vectors as one packed array
    packed = rows.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    asked = rows.filter("asks").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(parts)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        table = table.sort_by([("vec_id", "ascending")])
        key = table.column_names[-1]
        data, width = narrow(matrix(table["values"], dims))
        return pa.table({"dims": pa.array([dims], pa.int32()), key: pa.array([table[key][0].as_py()], pa.int32()),
                         "ids": [table["vec_id"].to_numpy().astype(np.int64).tobytes()],
                         "data": [data], "width": pa.array([width], pa.int32())})

    index = packed.select("vec_id", "values", "dims", "block").groupBy("dims", "block").applyInArrow(
        pack, "dims int, block int, ids binary, data binary, width int")
    queries = asked.select("vec_id", "values", "dims", "part").groupBy("dims", "part").applyInArrow(
        pack, "dims int, part int, ids binary, data binary, width int")
    index, queries = sectioned(index, queries, blocks, parts)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            dims = left["dims"][0].as_py()
            ids = np.frombuffer(left["ids"][0].as_py(), np.int64)
            block = Block(ids, widened(left["data"][0].as_py(), left["width"][0].as_py(), dims, len(ids)))
            for row in range(right.num_rows):
                asking, part = np.frombuffer(right["ids"][row].as_py(), np.int64), right["part"][row].as_py()
                values = widened(right["data"][row].as_py(), right["width"][row].as_py(), dims, len(asking))
                for n, (i, query) in enumerate(zip(asking.tolist(), values)):
                    best, scores = block.best(i, query, k)
                    found.append((np.full(len(best), i), np.full(len(best), part << 32 | n), best, scores))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "asker", "vec_id", "score"), columns)})

    keys = ("dims", "block", "section")
    tiles = index.select(*keys, "ids", "data", "width").groupBy(*keys).cogroup(
        queries.select(*keys, "part", "ids", "data", "width").groupBy(*keys)).applyInArrow(
        tile, "query_id long, asker long, vec_id long, score long")
    order = Window.partitionBy("query_id", "asker").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
