"""Alignment of two tokenizers' tokens on the bytes of a text.

Both token sequences of a text cut the same bytes.  The cumulative ends of each
go to a dictionary from end to index (a table in which an end is its own hash);
the ends both share, the intersection of the two sets of keys in order, slice
both id lists into groups that cover the same bytes.  Within a slice a link joins two tokens whose byte ranges overlap:
every stretch between neighbouring ends of either side lies in exactly one token
of each, so a slice has as many links as it has different ends.

How often an id pair is linked in the whole corpus is counted in three steps:
texts are aligned in one scan that is written with each text's own pair counts;
tasks sum these before they are shuffled; and the pairs' counts go back to the
texts.  The most frequent pairs (all whose count reaches a power of two that at
most ``FREQUENT`` pairs reach) are sent to every worker and looked up there,
which takes nearly all links; links of rarer pairs are joined by the pair.  A
pair that every text has is thus never a join key, and nothing is cut.

Defined results: a text that is null, empty, or whose bytes one side doesn't give
back has no tokens, and zeros everywhere; a null id stays null; rows that repeat
an id or a text are texts of their own and count each; other columns are not
looked at; an empty table gives no rows.  Ties for the highest count of a B id
all count as best.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import cache, partial

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from marquee.llm.bpe import PATTERN, byte_letters
from marquee.llm.staging import staged

#: Pairs whose counts are sent to every worker at most: 9 MB.
FREQUENT = 1 << 19
#: Characters tokenised together, and pairs a task sums before it hands them on.
CHUNK, PAIRS = 500_000, 2_000_000
ID_BITS = 32
NONE = np.zeros(0, np.int64)


class Side:
    """One tokenizer: token ids of texts and the bytes of each id."""

    raw: list[bytes]
    #: whether the tokens of any text give back its bytes
    lossless = False

    def __init__(self):
        self.size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        #: decimal ids followed by each separator
        self.text = {mark: np.array([f"{i}{mark}" for i in range(len(self.raw))], object) for mark in ",|;"}

    def encode(self, texts: list[str]) -> Sequence[Sequence[int]]:
        raise NotImplementedError


class ByteLevel(Side):
    """A byte-level BPE vocabulary file, on a space and the text; special tokens' strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        token = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added}
        self.raw = [token.get(i, b"") for i in range(max([*vocab.values(), *added.values()]) + 1)]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        # merges in the order of their ids are ranks by id, which the faster library takes
        if merged == sorted(merged) and len(merged) + 256 == len(token) and not spec.get("normalizer"):
            ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: i for i, b in token.items()}, special_tokens={})
            self.one = partial(ranks.encode_to_numpy, disallowed_special=())
            self.lossless = True  # every byte is a token, and nothing is normalised
        else:
            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            own.no_truncation()
            own.no_padding()
            self.one = lambda text: own.encode(text, add_special_tokens=False).ids
        super().__init__()

    def encode(self, texts: list[str]) -> Sequence[Sequence[int]]:
        return [self.one(" " + t) for t in texts]


class Pieces(Side):
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.own.get_piece_size()
        self.raw = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode()
                    for i, p in enumerate(self.own.id_to_piece(list(range(n))))]
        super().__init__()

    def encode(self, texts: list[str]) -> Sequence[Sequence[int]]:
        return self.own.encode(texts, num_threads=1)


@cache
def side(path: str) -> Side:
    """One tokenizer per worker and file, by the kind of file."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def end_table(ends: np.ndarray, size: int) -> np.ndarray:
    """Dictionary from end to index of the token, as a table with the end itself as its place; -1 where none ends."""
    table = np.full(size + 1, -1, np.int32)
    table[ends] = np.arange(len(ends), dtype=np.int32)
    return table


def groups_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, one: Side, two: Side) -> list[str]:
    """``a1,a2|`` and ``b1;`` pieces of all groups, those of A before those of B in each."""
    words_a, words_b = one.text[","][a], two.text[","][b]
    words_a[last_a], words_b[last_b] = one.text["|"][a[last_a]], two.text[";"][b[last_b]]
    many_a, many_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.repeat(last_b + 1 - many_b, many_a)] = words_a  # behind the tokens of B in earlier groups
    out[np.arange(len(b)) + np.repeat(last_a + 1, many_b)] = words_b
    return out.tolist()


def align(texts: list[str], one: Side, two: Side) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, digest, distinct pairs, times) of each text; zeros unless both sides give it back.

    Texts are laid end to end: both sides cover the same bytes, so every text's end is a common one and texts don't mix.
    """
    found = []
    for text, a, b in zip(texts, one.encode(texts), two.encode(texts)):
        raw = (" " + text).encode("utf-8", "surrogatepass")
        whole = text and (one.lossless or b"".join(map(one.raw.__getitem__, a)) == raw) and b"".join(map(two.raw.__getitem__, b)) == raw
        found.append((len(raw), np.asarray(a, np.int64), np.asarray(b, np.int64)) if whole else (0, NONE, NONE))
    a, b = (np.concatenate([NONE, *[f[k] for f in found]]) for k in (1, 2))
    size = sum(f[0] for f in found)
    at_a, at_b = end_table(np.cumsum(one.size[a]), size), end_table(np.cumsum(two.size[b]), size)
    ends_a, ends_b = at_a >= 0, at_b >= 0
    shared = np.flatnonzero(ends_a & ends_b)  # the intersection of both sets of ends, in order
    last_a, last_b = at_a[shared], at_b[shared]
    words = groups_text(a, b, last_a, last_b, one, two)
    ends = np.flatnonzero(ends_a | ends_b)  # a link for each end of either side: tokens that end there or reach beyond
    pairs = a[(np.cumsum(ends_a) - ends_a)[ends]] << ID_BITS | b[(np.cumsum(ends_b) - ends_b)[ends]]
    stop = np.cumsum([f[0] for f in found])
    groups, links = (np.concatenate([[0], np.searchsorted(x, stop, "right")]) for x in (shared, ends))
    at = 0
    for k, (length, own_a, own_b) in enumerate(found):
        if not length:
            yield 0, 0, 0, 0, "", NONE, NONE
            continue
        n = len(own_a) + len(own_b)
        digest = hashlib.sha256("".join(words[at: at + n])[:-1].encode()).hexdigest()
        at += n
        pair, times = np.unique(pairs[links[k]: links[k + 1]], return_counts=True)
        yield len(own_a), len(own_b), int(groups[k + 1] - groups[k]), int(links[k + 1] - links[k]), digest, pair, times


def _parts(texts: Sequence[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        text = text or ""
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<int>")


def aligned(docs: DataFrame, *, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per text: counts, digest of its groups, and its distinct linked id pairs with their number; ``row`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(path_a), side(path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in _parts(batch.column(1).to_pylist()):
                *columns, pairs, times = zip(*align(part, one, two))
                n_a, n_b, n_groups, n_links, digest = columns
                numbers = pa.array(np.arange(row, row + len(part)))
                yield pa.RecordBatch.from_arrays(
                    [numbers, ids.slice(at, len(part)), *[pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)], pa.array(digest, pa.string()),
                     _lists(pairs, pa.int64()), _lists(times, pa.int32())],
                    names=[c.split(" ")[0] for c in ALIGNED.split(", ")])
                row, at = row + len(part), at + len(part)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, ALIGNED)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (links in all texts), best (no pair of its B id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                keys.append(part.column(0).flatten().to_numpy(zero_copy_only=False))
                counts.append(part.column(1).flatten().to_numpy(zero_copy_only=False))
                size += len(keys[-1])
                if size > PAIRS:
                    key, n = _summed(keys, counts)
                    keys, counts, size = [key], [n], len(key)
                    if size > PAIRS // 2:  # mostly different pairs: hand them on
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                        keys, counts, size = [], [], 0
        if keys:
            key, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    counts = staged(found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    # one row per id of B's vocabulary
    highest = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("n").alias("highest")))
    return staged(counts.withColumn("b", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")


def frequent_pairs(counts: DataFrame, most: int) -> tuple[int, DataFrame]:
    """(least count, pairs that reach it): the least power of two that at most ``most`` pairs reach."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("power")).collect()  # one row a power
    least, held = 1 << 62, 0
    for row in sizes:
        held += row["pairs"]
        if held > most:
            break
        least = 1 << row["power"]
    return least, counts.filter(F.col("n") >= least)


def alignments(docs: DataFrame, *, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text."""
    found = staged(aligned(docs, path_a=path_a, path_b=path_b, text=text, doc_id=doc_id), "aligned")
    counts = pair_counts(found)
    least, often = frequent_pairs(counts, frequent)
    table = often.toPandas().sort_values("pair")  # at most ``frequent`` rows
    sent = docs.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                lists = part.column(1)
                pair, times = lists.flatten().to_numpy(zero_copy_only=False), part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                sums, bests = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                np.add.at(sums, of[hit], times[hit] * n[at[hit]])
                np.add.at(bests, of[hit], times[hit] * best[at[hit]])
                rest = np.searchsorted(of[~hit], np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(pa.array(rest), pa.array(pair[~hit])),
                     pa.ListArray.from_arrays(pa.array(rest), pa.array(times[~hit]))], names=["row", "n_best", "count_sum", "pairs", "times"])

    known = staged(found.select("row", "pairs", "times").mapInArrow(
        look_up, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "looked-up")
    rare = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    rare = rare.join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = known.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
