"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after every run of ASCII white space
is replaced by one space.  Rows are first grouped by length, then by length and
the hash of a short prefix; only rows of groups that still have two members are
hashed in full.  Each level is a map-side combined count and a semi-join, and
the joins carry no sorting or grouping on top, so adaptive execution splits a
hot length or prefix.

The hash of level three is SHA-256 of the normalised text in UTF-8.

Defined results: a null text counts as empty; a null id sorts behind all others
and is kept only if a group has no other; of rows that repeat id and text one is
kept; further columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.staging import free_name, staged

#: Characters that the second level hashes.
PREFIX = 64
#: Surviving groups (16 bytes each) up to which they are sent to every executor: 32 MB.
BROADCAST_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def full_hash(text: Column) -> Column:
    """Lowercase hex SHA-256 of a normalised text."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", all_digests: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256, of single rows only with ``all_digests``.

    The digest of a single row is taken where its text is read, so rows never have to be found again by their id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("_text")).select(
        "doc_id", "_text", F.length("_text").alias("_length"), F.xxhash64(F.substring("_text", 1, PREFIX)).alias("_prefix"))
    # levels one and two look at the narrow columns only
    heads = rows.groupBy("_length", "_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    lengths = heads.groupBy("_length").agg(F.sum("_rows").alias("_same_length")).filter("_same_length > 1")
    heads = staged(heads.filter("_rows > 1").join(lengths.hint("shuffle_hash"), "_length", "left_semi")
                   .select("_length", "_prefix", F.lit(True).alias("_open")), "heads")
    # level three: whole texts of what survived; no text is moved while the surviving groups fit in memory everywhere
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads.hint("shuffle_hash")
    hashed = staged(rows.join(heads, ["_length", "_prefix"], "left").select(
        "doc_id", F.coalesce("_open", F.lit(False)).alias("open"),
        (full_hash(F.col("_text")) if all_digests else F.when(F.col("_open"), full_hash(F.col("_text")))).alias("text_sha256")), "hashed")
    single = hashed.filter("not open").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    # rows that repeat id and text are one row with a count until the end
    # both sides of the join below are written first, so that it reads two plain shuffles and a hot text can be split
    members = staged(hashed.filter("open").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("_times")), "members")
    groups = staged(members.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("_times").alias("group_size")), "groups")
    opened = members.join(groups.hint("shuffle_hash"), "text_sha256").select(
        "doc_id", "keep_id", "group_size", "text_sha256", F.posexplode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_copy", "_"))
    grouped = opened.select("doc_id", "keep_id", "group_size",
                            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 0)).alias("kept"), "text_sha256")
    return single.unionByName(grouped)


def drop_exact_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the copies: of equal texts the row with the smallest id stays, and one of rows that repeat it."""
    found = staged(exact_groups(docs, doc_id=doc_id, text=text), "exact-groups")
    many, out, digest, own = (free_name(docs, n) for n in ("many", "gone", "gone_text", "own_text"))
    key = F.col(f"`{doc_id}`")
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").select(F.col("doc_id").alias(many))
    going = found.filter("not kept").select(F.col("doc_id").alias(out), F.col("text_sha256").alias(digest))
    plain = docs.join(repeated, key.eqNullSafe(F.col(many)), "left_anti").join(going.select(out), key.eqNullSafe(F.col(out)), "left_anti")
    # ids that several rows share tell no rows apart: these rows, if any, are told apart by id and text
    stay = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    lost = going.join(stay, F.col(out).eqNullSafe(F.col("_id")) & (F.col(digest) == F.col("_sha")), "left_anti")
    shared = docs.join(repeated, key.eqNullSafe(F.col(many)), "left_semi").withColumn(own, full_hash(normalised(F.col(f"`{text}`"))))
    shared = shared.dropDuplicates([doc_id, own]).join(lost, key.eqNullSafe(F.col(out)) & (F.col(own) == F.col(digest)), "left_anti").drop(own)
    return plain.unionByName(shared)
