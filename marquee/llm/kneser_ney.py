"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting.  Tasks hash the words of their texts, count bigrams batch by batch and
send each batch's counts as packed arrays to shards.  A bigram's shard follows
from its first word and a few bits of the second, so a word that begins a third
of all bigrams is still spread over many shards.  A shard adds its batches up,
writes its bigrams as arrays sorted by hash, and sends what it knows about single
words (occurrences, distinct words before, discounts after) to word shards, which
write the vocabulary the same way.  The driver sees a few sums per shard.

Model.  All bigrams are stored, those seen once too.  The lower order is the
Kneser-Ney continuation distribution, interpolated with the uniform one over the
vocabulary and one unknown word:

    p(w | v) = (c(vw) - D(c(vw))) / c(v) + g(v) p(w),   g(v) = (D(1) n1(v) + D(2) n2(v) + D(3) n3(v)) / c(v)
    p(w)     = (t(w) - E(t(w))) / T + e / (V + 1),      t(w): distinct words before w, T their sum

with n1, n2 and n3 the numbers of bigrams vw seen once, twice and more often, and the three modified discounts of each order from the counts of counts.

Scoring.  Workers map the arrays and look all tokens of a batch up by sorted search.
The mapped files must be reachable as files: the shared folder has to be a ``file:``
folder (a mount every machine sees), otherwise ``train`` says so.

Tokens are the words of a text, A-Z in lower case, and one end.  Words are told apart
by 64-bit hashes.  Defined results: a null or empty text is the end token alone; without
training rows all counts are zero and every probability is one over (V + 1) = 1; repeated
rows count each; columns other than text pass through untouched.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm import words as W
from marquee.llm.staging import free_name, new_folder

#: Characters of training text for each shard.
SHARD_CHARS = 16_000_000
#: Tokens counted together before they are sent.
BATCH_TOKENS = 2_000_000
START = np.uint64(0x0123456789ABCDEF)
END = np.uint64(0xFEDCBA9876543210)


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, number of the text) of each token, the end token included."""
    word, doc = W.word_hashes(data, offsets)
    texts = len(offsets) - 1
    at = np.cumsum(np.bincount(doc, minlength=texts))  # where each text's end token goes
    current = np.insert(word, at, END)
    owner = np.insert(doc, at, np.arange(texts))
    before = np.empty_like(current)
    before[1:] = current[:-1]
    before[np.concatenate([[0], at[:-1] + np.arange(1, texts)]).astype(np.int64)] = START
    return before, current, owner


def bigram_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(W.mix(before) * np.uint64(0x9E3779B97F4A7C15) + word)


def spread(x: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash by its upper half."""
    return ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def bigram_shard(before: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    ways = np.uint64(max(4, shards // 8))
    with np.errstate(over="ignore"):
        return spread(W.mix(before + (W.mix(word) % ways) * np.uint64(0xD6E8FEB86659FD93)), shards)


def grouped(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in columns])


PACKED_BIGRAMS = "shard int, before binary, run binary, word binary, count binary"
PACKED_WORDS = "shard int, word binary, count binary, types binary, once binary, twice binary, more binary"


def local_path(folder: str) -> str:
    parsed = urlparse(folder)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped, so its folder must be a mounted one, not {folder}")
    return unquote(parsed.path)


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Whole or not at all, and the same whichever attempt writes it."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        np.save(file, values)
    os.replace(part, f"{folder}/{name}.npy")


def unpack(column: pa.ChunkedArray, kind) -> np.ndarray:
    parts = [np.frombuffer(b, kind) for b in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified discounts for counts 1, 2 and 3 or more from n1 to n4; plain halves where a count is missing."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(d, 0.05), k)) for k, d in ((1 - 1e-6, 1 - 2 * y * n2 / n1), (2 - 1e-6, 2 - 3 * y * n3 / n2), (3 - 1e-6, 3 - 4 * y * n4 / n3)))


@dataclass
class Model:
    """What the driver knows of a model: the folder and a few sums."""

    folder: str
    shards: int
    tokens: int
    vocabulary: int
    types: int
    texts: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    unknown_mass: float
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maps": {}}

    def map(self, name: str, shard: int) -> np.ndarray | None:
        key = (name, shard)
        if key not in self._maps:
            path = f"{self.folder}/{name}-{shard}.npy"
            self._maps[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self._maps[key]

    def find(self, kind: str, columns: tuple[str, ...], keys: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
        """Values of each key, zero where it is not stored; keys are taken shard by shard in sorted order."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        order = np.lexsort((keys, shard))
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            at, stored = order[bounds[s]: bounds[s + 1]], self.map(f"{kind}-key", int(s))
            if stored is None or not len(stored):
                continue
            place = np.minimum(np.searchsorted(stored, keys[at]), len(stored) - 1)
            hit = stored[place] == keys[at]
            for values, name in zip(out, columns):
                values[at[hit]] = self.map(f"{kind}-{name}", int(s))[place[hit]]
        return out

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text."""
        frames = []
        for _, data, offsets in W.chunks(texts):
            before, word, doc = sequence(data, offsets)
            n = len(offsets) - 1
            vocabulary, where = np.unique(np.concatenate([word, before]), return_inverse=True)
            count, types, once, twice, more = self.find("word", ("count", "types", "once", "twice", "more"), vocabulary,
                                                         spread(vocabulary, self.shards))
            count[vocabulary == START] = self.texts
            w, v = where[: len(word)], where[len(word):]
            base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
            base[(count == 0) | (vocabulary == START)] = np.log10(0.1 / (self.tokens + 0.1 * (self.vocabulary + 1)))
            e1, e2, e3 = self.word_discounts
            less = np.select([types == 0, types == 1, types == 2], [0.0, e1, e2], e3)
            lower = (types - less) / max(self.types, 1) + self.unknown_mass / (self.vocabulary + 1)
            d1, d2, d3 = self.bigram_discounts
            gives = np.where(once + twice + more > 0, (d1 * once + d2 * twice + d3 * more) / np.maximum(count, 1), 1.0)
            keys, key_of = np.unique(bigram_hash(before, word), return_inverse=True)
            first = np.zeros(len(keys), np.int64)
            first[key_of] = np.arange(len(key_of))
            (pair,) = self.find("bigram", ("count",), keys, bigram_shard(before[first], word[first], self.shards))
            pair = pair[key_of]
            seen = (pair - np.select([pair == 0, pair == 1, pair == 2], [0.0, d1, d2], d3)) / np.maximum(count[v], 1)
            score = np.log10(seen + gives[v] * lower[w])
            frames.append(pd.DataFrame({
                "n_tokens": np.bincount(doc, minlength=n), "n_known": np.bincount(doc, count[w] > 0, n).astype(np.int64),
                "base_score": np.bincount(doc, base[w], n), "score": np.bincount(doc, score, n)}))
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(
            {"n_tokens": [], "n_known": [], "base_score": [], "score": []})


def train(docs: DataFrame, *, text: str = "text") -> Model:
    """Counts all texts of ``docs`` and writes the model to the shared folder."""
    spark = docs.sparkSession
    folder = local_path(new_folder(spark, "kneser-ney"))
    total = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.count(F.lit(1)).alias("texts")).first()
    shards = max(8, -(-total["chars"] // SHARD_CHARS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            before, word = map(np.concatenate, zip(*held))
            order = np.lexsort((word, before))
            before, word = before[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1])]))
            times = np.diff(np.append(first, len(before)))
            before, word = before[first], word[first]
            shard = bigram_shard(before, word, shards)
            order = np.argsort(shard, kind="stable")  # within a shard still sorted by the first word
            before, word, times, shard = before[order], word[order], times[order], shard[order]
            bounds = np.searchsorted(shard, np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(bounds)):
                at = slice(bounds[s], bounds[s + 1])
                b = before[at]
                runs = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                rows.append((int(s), b[runs].tobytes(), np.diff(np.append(runs, len(b))).astype(np.uint32).tobytes(),
                             word[at].tobytes(), times[at].astype(np.uint32).tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))],
                                              names=["shard", "before", "run", "word", "count"])

        for batch in batches:
            for _, data, offsets in W.chunks(batch.column(0).to_pylist()):
                before, word, _ = sequence(data, offsets)
                held.append((before, word))
                size += len(word)
                if size >= BATCH_TOKENS:
                    yield send()
                    size = 0
        if size:
            yield send()

    def add_bigrams(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        before = np.repeat(unpack(table["before"], np.uint64), unpack(table["run"], np.uint32))
        word, times = unpack(table["word"], np.uint64), unpack(table["count"], np.uint32).astype(np.int64)
        keys = bigram_hash(before, word)
        order = np.argsort(keys, kind="stable")
        keys, before, word, times = keys[order], before[order], word[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, before, word, times = keys[first], before[first], word[first], np.add.reduceat(times, first)
        write_array(folder, f"bigram-key-{shard}", keys)
        write_array(folder, f"bigram-count-{shard}", times.astype(np.uint32))
        ones = np.ones(len(word), np.int64)
        parts = grouped(np.concatenate([word, before]), np.concatenate([times, 0 * ones]), np.concatenate([ones, 0 * ones]),
                        *[np.concatenate([0 * ones, seen.astype(np.int64)]) for seen in (times == 1, times == 2, times > 2)])
        to = spread(parts[0], shards)
        bounds = np.searchsorted(to, np.arange(shards + 1))  # sorted by hash, so by shard too
        rows = [(int(s), *[c[bounds[s]: bounds[s + 1]].astype(k).tobytes() for c, k in zip(parts, KINDS)], None)
                for s in np.flatnonzero(np.diff(bounds))]
        # the last row carries the counts of counts
        rows.append((-1, *[b""] * 6, [int((times == k).sum()) for k in range(1, 5)]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())))],
                                    names=["shard", *NAMES, "sums"])

    def add_words(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        columns = [unpack(table[n], k).astype(np.uint64 if n == "word" else np.int64) for n, k in zip(NAMES, KINDS)]
        word, times, types, *seen = grouped(*columns)
        for name, values in zip(("key", *NAMES[1:]), (word, times, types, *seen)):
            write_array(folder, f"word-{name}-{shard}", values)
        real = types > 0  # the start of a text comes before words but is none
        return pa.table({"tokens": [int(times.sum())], "words": [int(real.sum())], "types": [int(types.sum())],
                         "n": pa.array([[int((types == k).sum()) for k in range(1, 5)]], pa.list_(pa.int64()))})

    from marquee.llm.staging import staged

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, PACKED_BIGRAMS)
    sent = staged(counted.groupBy("shard").applyInArrow(add_bigrams, PACKED_WORDS + ", sums array<long>"), "word-parts")
    sums = sent.filter("shard < 0").selectExpr(*[f"sum(sums[{k}]) as n{k + 1}" for k in range(4)]).first()
    done = sent.filter("shard >= 0").groupBy("shard").applyInArrow(add_words, "tokens long, words long, types long, n array<long>")
    got = done.selectExpr("sum(tokens) as tokens", "sum(words) as words", "sum(types) as types",
                          *[f"sum(n[{k}]) as n{k + 1}" for k in range(4)]).first()
    of_words = [int(got[f"n{k}"] or 0) for k in range(1, 5)]
    e = discounts(of_words)
    types, vocabulary = int(got["types"] or 0), int(got["words"] or 0)
    more = vocabulary - of_words[0] - of_words[1]
    unknown = (e[0] * of_words[0] + e[1] * of_words[1] + e[2] * more) / types if types else 1.0
    return Model(folder, shards, int(got["tokens"] or 0), vocabulary, types, total["texts"],
                 discounts([int(sums[f"n{k}"] or 0) for k in range(1, 5)]), e, unknown)


NAMES = ("word", "count", "types", "once", "twice", "more")
KINDS = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score (log10 probability)."""

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def score_of(texts: pd.Series) -> pd.DataFrame:
        return opened(model).score(list(texts))

    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    scored = free_name(docs, "scored")
    return docs.withColumn(scored, score_of(F.col(f"`{text}`"))).select(
        *kept, f"{scored}.n_tokens", f"{scored}.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        f"{scored}.base_score", f"{scored}.score")


_models: dict[str, Model] = {}


def opened(model: Model) -> Model:
    """One set of maps per worker and model; a new model closes the maps of others."""
    if model.folder not in _models:
        _models.clear()
        _models[model.folder] = model
    return _models[model.folder]


def training_rows(docs: DataFrame, usable: Column, *, text: str = "text") -> DataFrame:
    return docs.filter(usable).select(text)
