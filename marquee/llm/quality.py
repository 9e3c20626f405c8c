"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

A text is a sequence of tokens: runs of letters and digits, and runs of ASCII
punctuation.  Features are hashed n-grams of two sequences: the words themselves
(one and two) and the words' shapes (one to three), where a shape is lower case,
capitalised, upper case, a repeat of the word before, or the punctuation itself.  Each
family's features carry relative frequencies, so long and short texts compare;
one more feature tells the order of magnitude of the number of tokens.

Weights are learned from a bounded sample: of all labelled rows that may be used
the ``MOST_ROWS`` with the smallest hash of their id.  Their features are made
where the texts are; one task takes them and updates weights row by row (follow
the regularised leader with per-coordinate rates and L1).  Scoring is one scan:
sparse dot products of all tokens of a batch, summed by text.

Defined results: a null or empty text has no n-grams and is scored by bias and
size feature alone; label rows that are null or have no document are not
used; without any usable label every score is 0.5; repeated rows are scored
each; columns other than text pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm import words as W

#: Labelled rows that training reads at most.
MOST_ROWS = 8192
BITS = 18
EPOCHS = 3
#: FTRL-proximal: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
BIAS = 0  # index of the constant feature

LETTER, PUNCTUATION = 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = PUNCTUATION
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
ASCII_LETTER = np.zeros(256, np.int64)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = 1
SHAPES = W.mix(np.arange(1, 6, dtype=np.uint64))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, shape hash, number of the text) of each token."""
    kind = CLASS[data]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    edges = offsets[1:-1]
    change[edges[edges < len(data)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(data))
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    doc = np.searchsorted(offsets, start, "right") - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), doc
    word = W.stretch_hashes(W.prefix_sums(W.LOWER[data]), start, end)
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    caps, all_ = upper[end] - upper[start], letters[end] - letters[start]
    shape = np.zeros(len(start), np.int64)
    shape[caps > 0] = 1
    shape[(caps > 1) & (caps == all_)] = 2
    same = np.zeros(len(start), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape[same] = 3
    shapes = SHAPES[shape]
    marks = kind[start] == PUNCTUATION
    shapes[marks] = word[marks]
    return word, shapes, doc


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index, value, number of the text) of each feature occurrence, family by family; an index may occur again."""
    word, shape, doc = tokens(data, offsets)
    texts = len(offsets) - 1
    for family, (sequence, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        grams, of = W.ngram_hashes(sequence, doc, n)
        with np.errstate(over="ignore"):
            index = W.mix(grams + np.uint64(family + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        count = np.bincount(of, minlength=texts)
        yield np.maximum(index.astype(np.int64), 1 + BIAS), 1.0 / np.maximum(count, 1)[of], of
    size = np.bincount(doc, minlength=texts)
    magnitude = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))) + 1, 0).astype(np.uint64)
    yield (W.mix(magnitude + np.uint64(977)) >> np.uint64(64 - bits)).astype(np.int64) | 1, np.ones(texts), np.arange(texts)
    yield np.full(texts, BIAS), np.ones(texts), np.arange(texts)


def score_texts(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Score of each text: the sigmoid of its sparse dot product with the weights."""
    out, bits = np.zeros(len(texts)), int(len(weights)).bit_length() - 1
    for first, data, offsets in W.chunks(texts):
        n = len(offsets) - 1
        total = np.zeros(n)
        for index, value, doc in features(data, offsets, bits):
            total += np.bincount(doc, weights[index] * value, n)
        out[first: first + n] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over (indices, values, label) rows, one update a row."""
    z, n, out = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)

    def leader(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x, label = rows[k]
            w = leader(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    touched = np.flatnonzero(n)
    out[touched] = leader(touched)
    return out


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray

    def score(self, docs: DataFrame, *, text: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1; one scan, no shuffle.  The weights sent along have a fixed size."""
        sent = docs.sparkSession.sparkContext.broadcast(self.weights)

        @F.pandas_udf("double")
        def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(score_texts(list(texts), sent.value))
            W.release()

        return docs.withColumn(out, score_of(F.col(text)))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", usable: Column | None = None, text: str = "text",
        doc_id: str = "doc_id", most_rows: int = MOST_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> Classifier:
    """Learns from at most ``most_rows`` rows of ``labels`` (doc_id, label) for which ``usable`` holds."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label is not null")
    if usable is not None:
        known = known.join(labels.filter(usable).select(F.col(doc_id).alias("_id")).distinct(), "_id", "left_semi")
    # smallest hashes of the ids: a fixed sample of all labelled rows, of proven size
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(most_rows)
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").select("_label", "_text")

    @W.tidy
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in W.chunks(batch.column(1).to_pylist()):
                n = len(offsets) - 1
                index, value, doc = map(np.concatenate, zip(*features(data, offsets, bits)))
                keys, where = np.unique(doc * (1 << bits) + index, return_inverse=True)
                sums = np.bincount(where, value, len(keys))
                cuts = np.searchsorted(keys, np.arange(n + 1) << bits)
                ends = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[first: first + n], pa.int32()),
                     pa.ListArray.from_arrays(ends, pa.array((keys & ((1 << bits) - 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(sums.astype(np.float32)))], names=["label", "index", "value"])

    def learn(table: pa.Table) -> pa.Table:
        rows = [(np.asarray(i.values, np.int64), np.asarray(v.values, np.float64), int(y))
                for y, i, v in zip(table["label"].to_pylist(), table["index"], table["value"])]
        rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))  # whatever order the rows came in
        weights = train(rows, bits, epochs)
        on = np.flatnonzero(weights)
        del rows
        W.release()
        return pa.table({"index": pa.array(on, pa.int64()), "weight": pa.array(weights[on])})

    extracted = chosen.mapInArrow(extract, "label int, index array<int>, value array<float>")
    learned = extracted.groupBy(F.lit("all").alias("_group")).applyInArrow(learn, "index long, weight double").toPandas()
    weights = np.zeros(1 << bits)
    weights[learned["index"].to_numpy(np.int64)] = learned["weight"].to_numpy(np.float64)
    return Classifier(weights)
