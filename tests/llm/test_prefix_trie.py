"""The conversation trie and tree contraction against walks over small trees."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.llm import contraction, prefix_trie, queries
from tests.oracle import compare, connect

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string, at int, node string"


def random_forest(seed):
    """Parents of nodes: a long chain, a star, a chain that ends in a star, a single root and a random tree."""
    r = random.Random(seed)
    parent = {0: None}
    for n in range(1, 60):
        parent[n] = n - 1
    parent |= {100: None} | {n: 100 for n in range(101, 180)}
    parent |= {200: None} | {n: n - 1 for n in range(201, 215)} | {n: 214 for n in range(215, 240)}
    parent[300] = None
    parent[400] = None
    for n in range(401, 600):
        parent[n] = max(400, n - r.choice([1, 1, 1, 2, 3, 50]))
    return parent


@pytest.mark.parametrize("seed", [1])
def test_subtree_sums(spark, seed):
    parent = random_forest(seed)
    children = defaultdict(list)
    for n, p in parent.items():
        if p is not None:
            children[p].append(n)
    r = random.Random(seed)
    value = {n: (r.randrange(-5, 100), r.randrange(3)) for n in parent}
    tree = spark.createDataFrame([(n, p, len(children[n]), *value[n]) for n, p in parent.items()],
                                 "node long, parent long, n_children long, one long, two long")
    want = {}
    for n in sorted(parent, reverse=True):  # children have larger numbers
        want[n] = tuple(value[n][k] + sum(want[c][k] for c in children[n]) for k in range(2))
    got = contraction.subtree_sums(tree, ["one", "two"]).collect()
    assert len(got) == len(parent) and {r.node: (r.one, r.two) for r in got} == want


def test_subtree_sums_of_nothing_and_of_a_loop(spark):
    schema = "node long, parent long, n_children long, one long"
    assert contraction.subtree_sums(spark.createDataFrame([], schema), ["one"]).count() == 0
    loop = spark.createDataFrame([(1, 2, 2, 1), (2, 1, 2, 1)], schema)
    with pytest.raises(RuntimeError):
        contraction.subtree_sums(loop, ["one"], most_rounds=3)


def walked(rows, rebuild):
    """The trie by a walk: (depth, conv_id) -> the other columns."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:] if rebuild else own
    members = defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[:len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        leaves = sum(not any(len(o) == len(k) + 1 and o[:len(k)] == k for o in below) for k in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(key))))
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows_of(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.select(*COLUMNS).collect())


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def hard_rows():
    """Many equal conversations, shared beginnings, nulls, ties, repeated rows, absent families and one long conversation."""
    r = random.Random(3)
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 60) for t in range(3)]
    rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "é", "", None])) for c in range(60, 120) for t in range(r.randrange(1, 12))]
    rows += [(131, t, "user", "alone") for t in range(2)] + [(142, None, None, None), (142, 0, None, "x"), (142, 0, "b", "x"), (142, 0, "b", "x")]
    rows += [(None, 1, "user", "nobody"), (150, 10_000, "user", "late"), (150, -3, "user", "early"), (1000, 5, "", "▁")]
    return rows + [(155, t, "user", str(t % 7)) for t in range(0, 9000, 300)]


@pytest.mark.parametrize("block", [4096, 7])
def test_trie_against_a_walk(spark, hard_rows, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)  # 7: conversations and ends of many blocks
    frame = frame_of(spark, hard_rows)
    assert rows_of(prefix_trie.rebuilt_trie(frame)) == walked(hard_rows, True)
    if block == 4096:
        assert rows_of(prefix_trie.prefix_trie(frame)) == walked(hard_rows, False)


def test_empty_table_and_turnless_conversations(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # absent families: these conversations lose their first turns and get none
    rows = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    assert rows_of(prefix_trie.rebuilt_trie(frame_of(spark, rows))) == walked(rows, True)


def test_query_matches_sql(spark):
    name = "op12_prefix_trie"
    assert compare(queries.QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).sql(queries.ORACLE[name]).df()) is None
