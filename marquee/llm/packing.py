"""Best-fit decreasing packing of token sequences into windows.

A document is tokenised, closed with the end token and cut into full windows
while it is longer than one; the rest is packed whole.  Pieces go, longest
first, into the open window with the least room that still takes them.  A
segment tree over remaining capacities finds it: leaf ``c`` says whether a
window with ``c`` free places is open, inner nodes whether any below is, so the
tightest fit is the leftmost open leaf at or right of the piece's length.

Packing runs in groups of about ``GROUP_TOKENS`` tokens: pieces are dealt to
groups by a hash of document, start and row, so no source, document or length can
make a group large, and a group's memory is bounded by its tokens.  Each group
leaves about one window partly empty, so padding doesn't grow with the input.
Only piece lengths are shuffled, never tokens.

Defined results: a null text counts as empty and is the end token alone; rows
with the same id are separate documents whose pieces carry the same id; a null id stays null;
other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marquee.llm.bpe import PUNCTUATION, Merges, fill, parts
from marquee.llm.staging import staged
from marquee.llm.words import tidy

WINDOW = 4096
#: Expected tokens of a group: 128 windows.
GROUP_TOKENS = 1 << 19
SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\s+")


class WordTokenizer:
    """Token ids of a lower-casing vocabulary with word ends, a run of characters without white space at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.cut = regex.compile(splits[0])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: run -> ids as little-endian 32-bit bytes
        self.known: dict[str, bytes] = {}
        self.of_word: dict[str, bytes] = {}

    @staticmethod
    def plain(text: str) -> str:
        """Composed and in lower case, letter by letter (a final sigma is no exception)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:
                return "".join([c.lower() for c in text])
        return text.lower()

    def runs(self, text: str) -> list[str]:
        """Runs without white space, in lower case; special tokens behind a space, which no run has."""
        if any(s in text for s in self.special):
            return [r for k, piece in enumerate(self.special_cut.split(text))
                    for r in ([" " + piece] if k % 2 else self._split(self.plain(piece)))]
        return self._split(self.plain(text))

    def _split(self, text: str) -> list[str]:
        # str.split also cuts at four control characters that are no white space
        return text.split() if SEPARATORS.search(text) is None else [r for r in WHITE.split(text) if r]

    def words(self, run: str) -> tuple[str, ...] | list[str]:
        """Words of a run.  Letters with punctuation behind them, the usual run, need no pattern."""
        head = run.rstrip(PUNCTUATION)
        if head.isalpha():
            return (head, run[len(head):]) if len(head) < len(run) else (head,)
        return self.cut.findall(run)

    def learn(self, new: list[str]) -> None:
        words = [self.words(r) for r in new]
        fresh = [w for w in {w for own in words for w in own} if w not in self.of_word]
        self.of_word.update((w, array("I", ids).tobytes())
                            for w, ids in zip(fresh, self.merges.encode_words([w.encode() for w in fresh])))
        of_word, known = self.of_word, self.known
        for r, own in zip(new, words):
            known[r] = of_word[own[0]] if len(own) == 1 else b"".join([of_word[w] for w in own])
        for token, i in self.special.items():
            known[" " + token] = array("I", [i]).tobytes()

    def forget(self) -> None:
        """Drop the runs and words remembered; they cost time only."""
        self.known, self.of_word = {}, {}

    def encode_bytes(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        for part in parts(texts):
            rows = fill(part, self)
            yield from map(b"".join, rows)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class OpenWindows:
    """Segment tree over remaining capacities 0 to ``window``; each leaf keeps the windows with that much room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its room) with the least room of at least ``need``; it leaves the tree."""
        node = need + self.leaves
        if not self.any[node]:
            while node > 1 and not (node % 2 == 0 and self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.at[room].pop()
        if not self.at[room]:
            self.any[node] = 0
            node >>= 1
            while node:
                self.any[node] = self.any[2 * node] | self.any[2 * node + 1]
                if self.any[node]:
                    break
                node >>= 1
        return window, room


def best_fit_decreasing(lengths: Iterable[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; no piece may be longer than the window."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(window), 0
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        found = tree.take(need)
        if found is None:
            found, opened = (opened, window), opened + 1
        number[i], offset[i] = found[0], window - found[1]
        if found[1] > need:
            tree.put(found[1] - need, found[0])
    return number, offset


PIECE = StructType([StructField(n, LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
PACKED = StructType([*PIECE.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])


def pieces(docs: DataFrame, *, path: str, end: int, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: full windows of long documents and the rest of each document."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, closing = tokenizer(path), array("I", [end]).tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for i, raw in zip(ids, own.encode_bytes(["" if t is None else t for t in texts])):
                raw += closing
                tokens = len(raw) // 4
                for start in range(0, tokens, window):
                    part = raw[4 * start: 4 * (start + window)]
                    rows.append((i, start, len(part) // 4, zlib.crc32(part), tokens))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE.names)
        own.forget()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE)


def pack_pieces(found: DataFrame, *, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Places every piece: sequence_id and offset.  ``found`` is read twice, so it should be a written table."""
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()["tokens"]
    groups = max(1, -(-total // group_tokens))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        number, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        # a group's windows are numbered from its own 2^32 on
        number += rows["_group"][0].as_py() << 32
        return rows.select(PIECE.names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    # a row number besides: pieces that repeat id, place and content don't gather in one group
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id() % 1024), F.lit(groups)).cast("long")
    return found.withColumn("_group", group).groupBy("_group").applyInArrow(place, PACKED)


def pack_documents(docs: DataFrame, *, path: str, end: int = 2, window: int = WINDOW, text: str = "text",
                   doc_id: str = "doc_id", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return pack_pieces(staged(pieces(docs, path=path, end=end, window=window, text=text, doc_id=doc_id), "pieces"),
                       window=window, group_tokens=group_tokens)
