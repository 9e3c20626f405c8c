"""Byte-pair encoding on contiguous rank arrays, many short words at once, and the way back.

A word is an array of part boundaries with the merge rank of every adjacent
pair beside them.  One step scans each word's ranks for the smallest (the
leftmost of equals), deletes the boundary between the two parts and refreshes
the ranks left and right of the joined part; a word is done when no rank is
left.  Words of one length are the rows of one array, so each step is a handful
of array operations for all of them.  Words longer than ``WIDE`` bytes take the
same steps on a heap of ranks, so that a megabyte without a space is no trouble.

Texts are cut into words with the vocabulary's pattern; special tokens that
occur in a text are taken first, as the vocabulary file marks them.

Defined results: a null text counts as empty and has no tokens; equal texts have
equal tokens; nothing in a row but its text is looked at, so null ids, repeated
rows and further columns pass through.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Cuts a text into words: the published pattern of this vocabulary family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which words are merged side by side.
WIDE = 64
#: Runs a worker remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 500_000
NO_RANK = np.int64(1) << 60


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Merges:
    """Merge table of a vocabulary: adjacent ids -> (rank, joined id)."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        self.rank, self.joined = order[first].astype(np.int64), joined[order[first]]
        # open addressing table: a lookup is one or two gathers instead of a binary search
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_value = np.zeros(1 << self.bits, np.int64)
        self._fill(keys)
        self.of_pair = {(int(k) >> 20, int(k) & 0xFFFFF): (int(r), int(j)) for k, r, j in zip(keys, self.rank, self.joined)}
        letters = byte_letters()
        self.byte_id = np.zeros(256, np.int64)
        self.last_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab.get(letter, -1)
            self.last_id[b] = vocab.get(letter + suffix, -1)
        self.suffix = suffix

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        mask, todo = (1 << self.bits) - 1, np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.table_key[slot[todo]] < 0
            at, first = np.unique(np.where(free, slot[todo], -1 - todo), return_index=True)
            put = todo[first[at >= 0]]
            self.table_key[slot[put]], self.table_value[slot[put]] = keys[put], self.rank[put] << 20 | self.joined[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank << 20 | joined id`` of each pair, ``NO_RANK`` where the pair has no rank."""
        keys = left << 20 | right
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        there = self.table_key[slot]
        out = np.where(there == keys, self.table_value[slot], NO_RANK)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot = (slot[open_] + 1) & mask if len(slot) != len(open_) else (slot + 1) & mask
            there, want = self.table_key[slot], keys[open_]
            hit = there == want
            out[open_[hit]] = self.table_value[slot[hit]]
            on = ~hit & (there >= 0)
            open_, slot = open_[on], slot[on]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            n, at = int(n), np.flatnonzero(lengths == n)
            if n == 0:
                for i in at:
                    out[i] = []
            elif n > WIDE:
                for i in at:
                    out[i] = self._one(words[i])
            else:
                for part in np.array_split(at, -(-len(at) * n // 1_000_000)):
                    raw = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(-1, n)
                    for i, ids in zip(part, self._many(raw)):
                        out[i] = ids
        return out

    def _many(self, raw: np.ndarray) -> list[list[int]]:
        rows, n = raw.shape
        ids = self.byte_id[raw]
        ids[:, -1] = self.last_id[raw[:, -1]]
        rank = np.full((rows, n), NO_RANK)
        if n > 1:
            rank[:, :-1] = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, n - 1)
        done: list = [None] * rows
        live = np.arange(rows)
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            over = best >= NO_RANK
            if over.any():
                for k, found in zip(live[over].tolist(), ids[over].tolist()):
                    done[k] = found
                keep = ~over
                live, ids, rank, at, best = live[keep], ids[keep], rank[keep], at[keep], best[keep]
            if not len(live):
                return done
            # join two parts: delete the boundary between them and the rank that stood there
            row = np.arange(len(live))
            ids[row, at] = best & 0xFFFFF
            stay = np.ones(ids.shape, bool)
            stay[row, at + 1] = False
            ids = ids[stay].reshape(len(live), -1)
            stay[row, at + 1], stay[row, at] = True, False
            rank = rank[stay].reshape(len(live), -1)
            # refresh the ranks beside the joined part
            on = np.flatnonzero(at > 0)
            rank[on, at[on] - 1] = self.find(ids[on, at[on] - 1], ids[on, at[on]])
            on = np.flatnonzero(at < ids.shape[1] - 1)
            rank[on, at[on]] = self.find(ids[on, at[on]], ids[on, at[on] + 1])

    def _one(self, word: bytes) -> list[int]:
        """The same merges for a long word: a heap holds the ranks, links hold the boundaries."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last_id[word[-1]])
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := self.of_pair.get((ids[i], ids[i + 1])))]
        heap = [(r, i, j, a, b) for r, j, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            k = after[i]
            if not alive[i] or k >= n or ids[i] != a or ids[k] != b:
                continue
            ids[i], alive[k], after[i] = j, False, after[k]
            if after[k] < n:
                before[after[k]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (found := self.of_pair.get((ids[x], ids[after[x]]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[after[x]]))
        return [x for x, on in zip(ids, alive) if on]


PUNCTUATION = string.punctuation
#: A space inside a text begins a word if neither neighbour is white space; elsewhere the pattern decides.
ODD_SPACE = regex.compile(r"\s |^ | \s| $")


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.cut = regex.compile(PATTERN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        #: run of words -> (number of tokens, decimal ids joined by commas, decoded bytes)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.of_word: dict[str, tuple[int, str, bytes]] = {}

    def runs(self, text: str) -> list[str]:
        """The text cut before spaces that begin a word; special tokens are runs of their own."""
        out: list[str] = []
        for k, piece in enumerate(self.special_cut.split(text) if any(s in text for s in self.special) else [text]):
            if k % 2:
                out.append(piece)
            elif piece and ODD_SPACE.search(piece) is None:
                first, *others = piece.split(" ")
                out += [first, *[" " + x for x in others]]
            elif piece:
                out += self.cut.findall(piece)
        return out

    def words(self, run: str) -> tuple[str, ...] | list[str]:
        """Words of a run.  Letters with punctuation behind them, the usual run, need no pattern."""
        head = run.rstrip(PUNCTUATION)
        if head.isalpha() or head[:1] == " " and head[1:].isalpha():
            return (head, run[len(head):]) if len(head) < len(run) else (head,)
        return self.cut.findall(run)

    def learn(self, new: list[str]) -> None:
        """Encode runs not yet known; their words that are new are merged all together."""
        words = [self.words(r) for r in new]
        fresh = [w for w in {w for own in words for w in own} if w not in self.of_word]
        for w, ids in zip(fresh, self.merges.encode_words([w.encode() for w in fresh])):
            self.of_word[w] = (len(ids), ",".join(map(str, ids)), self.decode_bytes(ids))
        of_word, known = self.of_word, self.known
        for r, own in zip(new, words):
            if len(own) == 1:
                known[r] = of_word[own[0]]
            else:
                found = [of_word[w] for w in own]
                known[r] = (sum([f[0] for f in found]), ",".join([f[1] for f in found]), b"".join([f[2] for f in found]))
        for token, i in self.special.items():
            known[token] = (1, str(i), self.decode_bytes([i]))

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in fill([text], self)[0] for i in ids.split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def parts(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` characters."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def fill(texts: list[str], own) -> list[list]:
    """For each text what ``own.known`` holds of its runs; runs it lacks are learned all together."""
    if len(own.known) > REMEMBERED:
        own.known, own.of_word = {}, {}
    get, rows, lacking = own.known.get, [], {}
    for text in texts:
        runs = own.runs(text)
        found = list(map(get, runs))
        if None in found:
            holes = [k for k, f in enumerate(found) if f is None]
            lacking.update((runs[k], None) for k in holes)
            rows.append((found, [(k, runs[k]) for k in holes]))
        else:
            rows.append((found, ()))
    collecting = gc.isenabled()
    gc.disable()  # many small objects and no cycles
    try:
        own.learn(list(lacking))
    finally:
        if collecting:
            gc.enable()
    known = own.known
    for found, holes in rows:
        for k, run in holes:
            found[k] = known[run]
    return [found for found, _ in rows]


def encode_column(texts: pd.Series, path: str) -> pd.DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text."""
    own, rows = codec(path), []
    for part in parts(["" if t is None else t for t in texts]):
        for found in fill(part, own):
            counts, ids, raw = zip(*found) if found else ((), (), ())
            decoded = b"".join(raw).decode("utf-8", "replace")
            rows.append((sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                         hashlib.sha256(decoded.encode()).hexdigest()))
    return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def encode_texts(docs: DataFrame, *, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array column."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.encode("" if t is None else t) for t in texts])

    return docs.withColumn(out, ids_of(F.col(text)))


def decode_ids(docs: DataFrame, *, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with the text of an array of token ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def text_of(values: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series(["" if v is None else own.decode(list(v)) for v in values])

    return docs.withColumn(out, text_of(F.col(ids)))


def digests(docs: DataFrame, *, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of the round trip of ``text``, in one scan without a shuffle."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def round_trip(texts: pd.Series) -> pd.DataFrame:
        return encode_column(texts, path)

    done = docs.withColumn("_round_trip", round_trip(F.col(text)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return done.select(*kept, "_round_trip.*")
