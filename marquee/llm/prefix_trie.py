"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node stands for a distinct sequence of first turns (role, text).  Nodes are
not found by walking: each turn has a 128-bit hash of its place, role and text,
and the prefix sums of these hashes name the sequences, so all depths are found
by one grouped count.  Prefix sums run over blocks of turns, so that one
very long conversation is spread over many tasks.  Equal sequences are counted
before they are shuffled: a turn with which a third of all conversations begin
costs a row per task.  Parents are found by the name without the last turn.

Totals over subtrees come from ``contraction``.  The digest of the conversations
that end in a node needs their ids in one order, so the last step of it is one
stream per node; ids go there as ready text of up to ``BLOCK`` ids a row, and
the stream holds one row at a time.

Defined results: turns are ordered by turn (null first), then role, then text;
rows that are equal in all of them are turns of their own; a null role or text
is empty; rows with a null conv_id belong to no conversation; other columns are
not looked at; an empty table gives no rows, not even a root.  Chance collisions
of two 64-bit sums are not looked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.llm.contraction import subtree_sums
from marquee.llm.staging import staged

#: Turns, and ids of ending conversations, that are ordered together.
BLOCK = 4096
FAMILY, MOST_SHARED = 5, 9
KEY = ("depth", "x", "y")
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, at (place from 0), a, b (hashes of role and text), n_bytes of every turn."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null")
    block = F.floor(F.col("turn") / BLOCK)
    rows = rows.withColumn("block", block)
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    hashed = rows.withColumn("at", F.row_number().over(inside).cast("long") - 1).select(
        "conv_id", "block", "at", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.octet_length("text").cast("long").alias("n_bytes"))
    hashed = staged(hashed, "turns")
    sizes = hashed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("conv_id").alias("of"), F.col("block").alias("of_block"), F.sum("size").over(earlier).alias("shift")).filter("shift > 0")
    same = (F.col("conv_id") == F.col("of")) & F.col("block").eqNullSafe(F.col("of_block"))
    return hashed.join(shifts, same, "left").select(
        "conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), "a", "b", "n_bytes")


def shared_turns(conv_id: Column, most: int = MOST_SHARED) -> Column:
    """crc32 of the id in decimal, modulo ``most``: the number of turns taken over from the family's first."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(most)).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after taking over the first ones of the family's first conversation, and (conv_id, n_turns) of each."""
    sizes = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plans = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("shared", shared_turns(F.col("conv_id")))
    plans = staged(plans.join(base, "base", "left").select(
        "conv_id", "base", "shared", F.least("shared", F.coalesce("n_base", F.lit(0))).alias("taken"), "n").withColumn(
        "n_turns", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("shared"))), "plans")
    taken = turns.filter(F.col("at") < MOST_SHARED).withColumnRenamed("conv_id", "base").join(
        plans.select("conv_id", "base", "shared", "n_turns"), "base").filter("at < shared")
    own = turns.join(plans.select("conv_id", "shared", "taken", "n_turns"), "conv_id").filter("at >= shared").withColumn(
        "at", F.col("at") - F.col("shared") + F.col("taken"))
    columns = ("conv_id", "at", "a", "b", "n_bytes", "n_turns")
    return taken.select(*columns).unionByName(own.select(*columns)), plans.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, x, y (name of the first ``depth`` turns), up_x, up_y (name without the last), n_bytes, n_turns."""
    wide = "decimal(38,0)"
    own = [F.xxhash64(F.lit(3 + k), "at", "a", "b").cast(wide).alias(c) for k, c in enumerate("xy")]
    rows = staged(turns.select("conv_id", "at", F.floor(F.col("at") / BLOCK).alias("block"), *own, "n_bytes", "n_turns"), "rebuilt")
    sums = rows.groupBy("conv_id", "block").agg(*[F.sum(c).cast(wide).alias(f"all_{c}") for c in "xy"])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "block", *[F.sum(f"all_{c}").over(earlier).cast(wide).alias(f"before_{c}") for c in "xy"]).filter("before_x is not null")
    upto = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("conv_id", "block", (F.col("at") + 1).alias("depth"), "n_bytes", "n_turns", *[F.col(c).alias(f"own_{c}") for c in "xy"],
                         *[F.sum(c).over(upto).cast(wide).alias(c) for c in "xy"])
    whole = inside.join(before, ["conv_id", "block"], "left").select(
        "conv_id", "depth", "n_bytes", "n_turns", "own_x", "own_y",
        *[(F.col(c) + F.coalesce(f"before_{c}", F.lit(0))).cast(wide).alias(c) for c in "xy"])
    return whole.select("conv_id", "depth", "x", "y", *[(F.col(c) - F.col(f"own_{c}")).cast(wide).alias(f"up_{c}") for c in "xy"], "n_bytes", "n_turns")


def end_digests(ends: DataFrame) -> DataFrame:
    """ends_sha256 of the conversations (conv_id) that end in each node (depth, x, y)."""
    parts = ends.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    # names as text: they are only compared here
    named = parts.select("depth", F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "block", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for *own, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield from _batch(done)
        if key is not None:
            yield from _batch([(*key, state.hexdigest())])

    def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            depth, x, y, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(x), pa.array(y), pa.array(sha)],
                                             names=["depth", "x", "y", "ends_sha256"])

    ordered = named.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    found = ordered.mapInArrow(digest, "depth long, x string, y string, ends_sha256 string")
    return found.select("depth", *[F.col(c).cast("decimal(38,0)").alias(c) for c in "xy"], "ends_sha256")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, at, a, b, n_bytes, n_turns); ``conversations`` (conv_id, n_turns) has them all."""
    paths = staged(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("decimal(38,0)")
    nodes = paths.groupBy(*KEY, "up_x", "up_y").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("up_x"), zero.alias("up_y"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    nodes = staged(nodes.unionByName(root), "nodes")
    # a node's place in the result names it from here on: at each depth a conversation belongs to one node
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"),
                           F.col("conv_id").alias("parent_conv_id"))
    linked = staged(nodes.join(parents, ["depth", "up_x", "up_y"], "left").select(
        *KEY, "conv_id", "parent_conv_id", "n_convs", "n_bytes", F.struct("depth", "conv_id").alias("node"),
        F.when(F.col("parent_conv_id").isNotNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))).alias("parent")),
        "linked")
    children = linked.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = staged(linked.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).select(
        "node", "parent", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")), "tree")
    totals = subtree_sums(tree, ["n_leaves", "saved_tokens"])
    none = conversations.filter("n_turns = 0").select(F.lit(0).cast("long").alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id")
    ends = end_digests(paths.filter("depth = n_turns").select(*KEY, "conv_id").unionByName(none))
    return linked.join(ends, list(KEY), "left").join(tree.select("node", "n_children"), "node").join(totals, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"))


def rebuilt_trie(rows: DataFrame) -> DataFrame:
    """The trie of all conversations of ``rows`` (conv_id, turn, role, text) after taking over their family's first turns."""
    return trie(*rebuilt(numbered_turns(rows)))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations of ``rows`` (conv_id, turn, role, text) as they stand."""
    turns = numbered_turns(rows)
    sizes = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")), "conversations")
    return trie(turns.join(sizes, "conv_id"), sizes)
