"""Subtree totals of a forest by parallel tree contraction: rounds of rake and compress, then re-expansion.

Every live node carries what its removed children have brought it, and an
amount on the edge to its parent.  A round first rakes: nodes without children
leave, and their amounts are summed for their parents.  Then it compresses: of
the nodes with one child left, some leave that are not neighbours (by a coin
that a hash tosses anew each round), and their amounts move to the edge of the
child, which hangs itself on its grandparent.  Both take a constant share of
leaves and of chains, so the number of rounds grows with the logarithm of the
number of nodes, whatever the depth: a chain of a million nodes is no loop of a
million joins.  Nodes that left a chain get their totals afterwards, in the
reverse order of rounds, from the child they had then.

Every join is on a node that is unique on one side at least, and siblings are
summed before the shuffle, so neither a node with very many children nor a very
long chain meets in one task.  Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marquee.llm.staging import staged


def subtree_sums(tree: DataFrame, values: Sequence[str], *, most_rounds: int = 400) -> DataFrame:
    """node, and for each of ``values`` its sum over the subtree, the node itself included.

    ``tree`` has one row per ``node`` (any type that joins), ``parent`` (null for roots) and ``n_children``; the
    values are numbers.  An empty tree gives no rows; rows that hang on no root are an error.
    """
    def total(name: str, which: str = "acc"):
        return F.col(f"{which}.{name}").alias(name)

    def summed(*parts):
        return F.struct(*[sum((F.col(f"{p}.{v}") for p in parts[1:]), F.col(f"{parts[0]}.{v}")).alias(v) for v in values])

    alive = tree.select("node", "parent", F.struct(*values).alias("acc"),
                        F.struct(*[(F.col(v) * 0).alias(v) for v in values]).alias("edge"), F.col("n_children").alias("n_open"))
    alive = staged(alive, "forest")
    raked, spliced, gone = [], [], None
    for turn in range(most_rounds):
        # rake: leaves leave, their parents get what they bring; nodes that left a chain are dropped on the way
        raked.append(alive.filter("n_open = 0").select("node", *[total(v) for v in values]))
        news = alive.filter("n_open = 0 and parent is not null").select(
            F.col("parent").alias("node"), F.lit(1).alias("n_gone"), F.lit(0).alias("out"), summed("acc", "edge").alias("all"))
        if gone is not None:
            news = news.unionByName(gone.select(F.col("up.node").alias("node"), F.lit(0).alias("n_gone"), F.lit(1).alias("out"), F.col("up.acc").alias("all")))
        news = news.groupBy("node").agg(F.sum("n_gone").alias("n_gone"), F.max("out").alias("out"), *[F.sum(f"all.{v}").alias(f"gone_{v}") for v in values])
        rest = alive.filter("n_open > 0").join(news, "node", "left").filter("out is null or out = 0").select(
            "node", "parent", F.struct(*[(F.col(f"acc.{v}") + F.coalesce(f"gone_{v}", F.col(f"acc.{v}") * 0)).alias(v) for v in values]).alias("acc"),
            "edge", (F.col("n_open") - F.coalesce("n_gone", F.lit(0))).alias("n_open"))
        # compress: nodes with one child whose coin shows heads, unless their child may go as well
        rest = staged(rest.withColumn("may_go", F.expr("n_open = 1 and parent is not null") & (F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == 1)),
                      f"raked-{turn}")
        if not rest.count():
            break
        above = rest.filter("may_go").select(F.col("node").alias("parent"), F.struct("node", "parent", "acc", "edge").alias("up"))
        moved = rest.join(above, "parent", "left").withColumn("up", F.when(~F.col("may_go"), F.col("up"))).withColumn("stays", F.col("up").isNull())
        moved = staged(moved, f"compressed-{turn}")
        gone = moved.filter(~F.col("stays"))
        spliced.append(gone.select(F.col("up.node").alias("node"), F.col("node").alias("child"), summed("up.acc", "edge").alias("add")))
        alive = moved.select("node", F.when(F.col("stays"), F.col("parent")).otherwise(F.col("up.parent")).alias("parent"), "acc",
                             F.when(F.col("stays"), F.col("edge")).otherwise(summed("edge", "up.acc", "up.edge")).alias("edge"), "n_open")
    else:
        raise RuntimeError("the tree did not contract: a node hangs on no root")
    known = raked.pop()
    while raked:
        # who left the chain in this round asks the child it had then, which left later
        opened = spliced.pop()
        later = known.select(F.col("node").alias("child"), F.struct(*values).alias("below"))
        opened = opened.join(later, "child").withColumn("all", summed("add", "below")).select("node", *[total(v, "all") for v in values])
        known = known.unionByName(staged(opened, f"expanded-{len(raked)}")).unionByName(raked.pop())
    return known
