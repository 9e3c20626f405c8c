"""Repeated passages by suffix arrays over buckets of possible repeats.

Every ``length``-byte string of a text has an anchor, its smallest hashed gram (the first of equals),
which depends on nothing but the string.  Strings of one text with one anchor follow each other; cut by
their distance to the anchor into blocks of ``BLOCK`` they share a core, the bytes common to all of a block.  Equal
strings have equal anchors, distances and cores, so only blocks whose core occurs again can hold repeats.

1. One scan lists each text's cores; Spark counts them and tells each text which of its cores occur again.
2. A second scan of those texts describes their blocks.  Blocks with identical bytes are repeats as a whole
   and one of them stands for all from here on: copies, however many, never meet in one task.
3. What remains are the edges of repeated passages.  Blocks with one core form a bucket; a task sorts
   the bucket's suffixes (as far as ``length`` bytes, which decide) into a suffix array, and the previous and next smaller
   positions in suffix order give the longest previous factor of each.  A factor of ``length`` or more is a repeat.
4. Buckets of more than ``MOST`` blocks (a passage inside a third of all texts) are resolved string by
   string: equal 128-bit hashes of the whole strings, counted by Spark.  That way is exact too and has no hot task.

``keep_first=True`` removes later copies and keeps the first in order of id and position; ``False`` removes every copy.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` lose nothing; rows that repeat id
and text are copies of each other, of which with ``keep_first`` any one counts as the first; a null id sorts first; rows
are told apart by id and a 64-bit hash of their text; other columns, whatever their names, pass through untouched;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marquee.llm import words as W
from marquee.llm.staging import staged

LENGTH = 400
GRAM = 32
BLOCK = 128
#: Blocks of a bucket up to which one suffix array takes it (about 5 MB).
MOST = 256
#: Bytes of text handled together; a longer text is handled in overlapping parts.
PART = 300_000
#: Names (16 bytes) up to which a list is sent to every executor: 32 MB.
BROADCAST_ROWS = 2_000_000
POSITION = np.uint64((1 << 24) - 1)


def blocks_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """doc, first and last string position (in the text), core hash and, for whole blocks, two hashes of all their bytes."""
    nothing = {k: np.zeros(0, np.int64) for k in ("doc", "low", "high", "core", "one", "two", "whole")}
    n = len(data)
    if n < length:
        return nothing
    gram = min(GRAM, length)
    width = length - gram + 1
    sums = W.prefix_sums(data)
    starts = np.arange(n - gram + 1)
    # upper bits of the hash, then the position: the least is the first of the smallest
    wide = int(n).bit_length() > 24
    position = np.uint64((1 << 32) - 1) if wide else POSITION
    least = (W.stretch_hashes(sums, starts, starts + gram) & ~position) | starts.astype(np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step:])
    at = np.arange(n - length + 1)
    doc = np.searchsorted(offsets, at, "right") - 1
    valid = at + length <= offsets[doc + 1]
    at, doc, anchor = at[valid], doc[valid], (least[valid] & position).astype(np.int64)
    if not len(at):
        return nothing
    part = (anchor - at) // BLOCK
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    doc, anchor, part, low, high = doc[first], anchor[first], part[first], at[first], at[last]
    near, far = part * BLOCK, np.minimum(part * BLOCK + BLOCK - 1, length - gram)
    core = W.stretch_hashes(sums, anchor - near, anchor - far + length)
    with np.errstate(over="ignore"):
        core = W.mix(core + (part + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    other = W.prefix_sums(data, 1)
    start = offsets[doc]
    return {"doc": doc, "low": low - start, "high": high - start, "core": core.view(np.int64),
            "one": W.stretch_hashes(sums, low, high + length).view(np.int64),
            "two": W.stretch_hashes(other, low, high + length).view(np.int64),
            "whole": high - low == far - near}


def parts(texts: list[str | None], length: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the first text, position in it, bytes, offsets); a block cut by the end of a part counts as two unwhole ones."""
    for first, data, offsets in W.chunks(texts, most):
        if len(data) < 2 * most:
            yield first, 0, data, offsets
            continue
        for low in range(0, len(data) - length + 1, most):
            part = data[low: low + most + length - 1]
            yield first, low, part, np.array([0, len(part)])


def repeats_in_bucket(strings: list[bytes], order: list, length: int = LENGTH, keep_first: bool = False) -> list[tuple[int, int]]:
    """(number of the string, position in it) of each suffix with a factor of ``length`` in the bucket, by LPF over suffix order.

    ``order`` gives each string's place in the corpus; earlier positions have smaller ones.
    """
    places, suffixes = [], []
    for k in sorted(range(len(strings)), key=order.__getitem__):
        for p in range(len(strings[k]) - length + 1):
            places.append((k, p))
            suffixes.append(strings[k][p: p + length])
    # suffixes are listed in order of position, and sorting keeps that order among equals
    array = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    # common prefixes of neighbours, as far as they matter: length or less
    same = [0] + [length if suffixes[a] == suffixes[b] else 0 for a, b in zip(array, array[1:])]
    factor = [0] * len(suffixes)  # longest previous factor, cut at length
    following = [0] * len(suffixes)  # the same towards later positions
    stack: list[tuple[int, int]] = []  # (suffix, common prefix with the one below it)
    for n, i in enumerate(array):
        reach = same[n]
        while stack and stack[-1][0] > i:
            top, below = stack.pop()
            # i is the next smaller position of top, what lies below it the previous smaller
            factor[top] = max(factor[top], reach)
            following[i] = max(following[i], reach)
            reach = min(reach, below)
        if stack:
            factor[i] = max(factor[i], reach)
            following[stack[-1][0]] = max(following[stack[-1][0]], reach)
        stack.append((i, reach))
    return [places[i] for i in range(len(suffixes)) if factor[i] >= length or not keep_first and following[i] >= length]


def spans(ranges: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that begin at the positions of ``ranges``."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + length)
        else:
            out.append([low, high + length])
    return [(a, min(b, size)) for a, b in out]


REF = "doc_id long, text_hash long"


def _named(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(text).alias("text"))


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on id and text hash, null ids being equal; the names are sent along while they are few."""
    names = right.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *[c for c in right.columns if c not in ("doc_id", "text_hash")])
    return left.join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), how).drop("_id", "_hash")


def _few(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.count() <= BROADCAST_ROWS else names


def repeated_ranges(docs: DataFrame, *, length: int = LENGTH, keep_first: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, low, high: positions at which repeated strings begin, as ranges."""
    rows = _named(docs, text, doc_id).filter(F.octet_length("text") >= length)

    @W.tidy
    def list_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in parts(batch.column(2).to_pylist(), length, PART):
                found = blocks_of(data, offsets, length)
                owner = found["doc"].astype(np.uint64)
                key = found["core"].view(np.uint64) ^ W.mix(owner + np.uint64(1))
                _, at, times = np.unique(key, return_index=True, return_counts=True)
                take = pa.array(found["doc"][at] + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found["core"][at]),
                                                  pa.array(times.astype(np.int32))], names=["doc_id", "text_hash", "core", "times"])

    cores = rows.mapInArrow(list_cores, f"{REF}, core long, times int")
    cores = staged(cores, "cores")
    again = staged(cores.groupBy("core").agg(F.sum("times").alias("times")).filter("times > 1").select("core"), "cores-again")
    live = staged(cores.join(again, "core", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_list("core").alias("cores")), "live-texts")

    @W.tidy
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for first, begin, data, offsets in parts(batch.column(2).to_pylist(), length, PART):
                found = blocks_of(data, offsets, length)
                own = wanted[first: first + len(offsets) - 1]
                owner = np.repeat(np.arange(len(own), dtype=np.uint64), [len(c) for c in own])
                marks = np.array([c for cs in own for c in cs], np.int64).view(np.uint64) ^ W.mix(owner + np.uint64(1))
                key = found["core"].view(np.uint64) ^ W.mix(found["doc"].astype(np.uint64) + np.uint64(1))
                on = np.flatnonzero(np.isin(key, marks))
                take = pa.array(found["doc"][on] + first)
                part = ~found["whole"][on].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(found["low"][on] + begin), pa.array(found["high"][on] + begin),
                     pa.array(found["core"][on]), pa.array(found["one"][on], mask=part), pa.array(found["two"][on], mask=part)],
                    names=["doc_id", "text_hash", "low", "high", "core", "one", "two"])

    described = _same(_same(rows, _few(live.select("doc_id", "text_hash")), "left_semi"), live, "inner").mapInArrow(
        describe, f"{REF}, low long, high long, core long, one long, two long")
    blocks = staged(described, "blocks")

    # identical blocks: repeats as a whole, and one stands for all of them
    place = F.struct("doc_id", "low", "text_hash", "high")
    alike = staged(blocks.filter("one is not null").groupBy("core", "one", "two").agg(
        F.count(F.lit(1)).alias("times"), F.min(place).alias("first")), "alike")
    groups = staged(alike.filter("times > 1"), "alike-groups")
    whole = blocks.filter("one is not null").join(groups, ["core", "one", "two"])
    if keep_first:
        whole = whole.filter(~F.struct("doc_id", "low", "text_hash", "high").eqNullSafe(F.col("first")))
    whole = whole.select("doc_id", "text_hash", "low", "high")
    standing = alike.select("core", "first.*").unionByName(blocks.filter("one is null").select("core", "doc_id", "low", "text_hash", "high"))
    buckets = staged(standing.groupBy("core").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1"), "buckets")
    edges = staged(standing.join(buckets, "core").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("core", "low", "high", "blocks")).alias("edges")), "edges")

    @W.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            names, codes, texts, own = batch.columns
            ends = own.offsets.to_pylist()
            for n in range(len(batch)):
                name, code, raw = names[n].as_py(), codes[n].as_py(), texts[n].as_buffer().to_pybytes()
                for e in own.values.slice(ends[n], ends[n + 1] - ends[n]).to_pylist():
                    piece = raw[e["low"]: e["high"] + length]
                    out.append((name, code, e["core"], e["low"], e["blocks"], piece))
                    size += len(piece)
                if size > 8_000_000:
                    yield record(out)
                    out, size = [], 0
            if out:
                yield record(out)

    def record(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                          names=["doc_id", "text_hash", "core", "low", "blocks", "piece"])

    pieces = staged(_same(_same(rows, _few(edges.select("doc_id", "text_hash")), "left_semi"), edges, "inner").mapInArrow(
        cut, f"{REF}, core long, low long, blocks long, piece binary"), "pieces")

    @W.tidy
    def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def resolve() -> pa.RecordBatch:
            order = [(h[1] is not None, h[1] or 0, h[3], h[2]) for h in held]
            hits = repeats_in_bucket([h[4] for h in held], order, length, keep_first)
            found = sorted({(k, p) for k, p in hits})
            out = []
            for k, p in found:  # neighbours become one range
                at = held[k][3] + p
                if out and out[-1][0] == k and out[-1][2] == at - 1:
                    out[-1][2] = at
                else:
                    out.append([k, at, at])
            return pa.RecordBatch.from_arrays(
                [pa.array([held[k][1] for k, _, _ in out], pa.int64()), pa.array([held[k][2] for k, _, _ in out], pa.int64()),
                 pa.array([low for _, low, _ in out], pa.int64()), pa.array([high for _, _, high in out], pa.int64())],
                names=["doc_id", "text_hash", "low", "high"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][0] != row[0]:
                    yield resolve()
                    held.clear()
                held.append(row)
        if held:
            yield resolve()

    ranged = f"{REF}, low long, high long"
    small = pieces.filter(F.col("blocks") <= MOST).select("core", "doc_id", "text_hash", "low", "piece")
    sorted_ = small.repartition("core").sortWithinPartitions("core").mapInArrow(sort_suffixes, ranged)

    @W.tidy
    def each_string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for lo in range(0, len(texts), 2000):
                part = texts[lo: lo + 2000]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
                data = np.frombuffer(b"".join(part), np.uint8)
                at = np.arange(len(data))
                doc = np.searchsorted(offsets, at, "right") - 1
                on = at + length <= offsets[doc + 1]
                at, doc = at[on], doc[on]
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take),
                     pa.array(batch.column(2).to_numpy()[doc + lo] + at - offsets[doc]),
                     pa.array(W.stretch_hashes(W.prefix_sums(data), at, at + length).view(np.int64)),
                     pa.array(W.stretch_hashes(W.prefix_sums(data, 1), at, at + length).view(np.int64))],
                    names=["doc_id", "text_hash", "low", "one", "two"])

    strings = pieces.filter(F.col("blocks") > MOST).select("doc_id", "text_hash", "low", "piece").mapInArrow(
        each_string, f"{REF}, low long, one long, two long")
    strings = staged(strings, "strings")
    counted = staged(strings.groupBy("one", "two").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "low", "text_hash")).alias("first")).filter("times > 1"), "strings-again")
    hot = strings.join(counted, ["one", "two"])
    if keep_first:
        hot = hot.filter(~F.struct("doc_id", "low", "text_hash").eqNullSafe(F.col("first")))
    hot = hot.select("doc_id", "text_hash", "low", F.col("low").alias("high"))
    return whole.unionByName(sorted_).unionByName(hot)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, keep_first: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and ``kept_text``, the text without its repeated passages.

    Cuts are made between bytes; bytes of a letter that was cut in two are left out of ``kept_text`` only.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in NEW])
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), kept.alias("row"),
                       F.col(f"`{text}`").alias("text"))
    again = None
    if keep_first:
        # rows that repeat id and text: one of them takes part, the others are copies from end to end
        times = rows.filter(F.octet_length("text") >= length).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
        names = staged(times.filter("times > 1").select("doc_id", "text_hash"), "repeated-rows")
        if not names.isEmpty():
            copies = _same(rows, names, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(1))))
            copies = staged(copies, "copies")
            again = copies.filter("copy > 1").drop("copy")
            rows = _same(rows, names, "left_anti").unionByName(copies.filter("copy = 1").drop("copy"))
    ranges = repeated_ranges(rows.select("doc_id", "text"), length=length, keep_first=keep_first)
    ranges = staged(ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "ranges")

    names = _few(ranges.select("doc_id", "text_hash"))
    touched = _same(_same(rows, names, "left_semi"), ranges, "inner")
    none = F.lit(None).cast(ranges.schema["ranges"].dataType)
    both = touched.select("row", "text", "ranges").unionByName(_same(rows, names, "left_anti").select("row", "text", none.alias("ranges")))
    if again is not None:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.octet_length("text") - length).cast("long").alias("high")))
        both = both.unionByName(again.select("row", "text", whole.alias("ranges")))

    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    def removed(texts: pa.Array, own: pa.Array) -> pa.Array:
        ends = own.offsets.to_pylist()
        sizes, left, runs, digests, kept_texts = [], [], [], [], []
        for n, text_ in enumerate(texts):
            raw = text_.as_buffer().to_pybytes() if text_.is_valid else b""
            mine = own.values.slice(ends[n], ends[n + 1] - ends[n])
            cuts = spans(list(zip(mine.field("low").to_pylist(), mine.field("high").to_pylist())), length, len(raw))
            kept, at = [], 0
            for a, b in cuts:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]]) if cuts else raw
            sizes.append(len(raw))
            left.append(len(rest))
            runs.append(len(cuts))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept_texts.append(rest.decode("utf-8", "ignore").encode("utf-8") if cuts else rest)
        sizes, left = np.array(sizes, np.int64), np.array(left, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(sizes), pa.array(sizes - left), pa.array(runs, pa.int64()), pa.array(digests, pa.string()),
             pa.array(kept_texts, pa.binary()).cast(pa.string())], names=list(NEW))

    return both.select("row", removed(F.col("text"), F.col("ranges")).alias("cut")).select("row.*", *[f"cut.{c}" for c in NEW])


NEW = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
