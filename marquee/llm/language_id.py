"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; every run of characters that are no letters becomes one
space, and one stands before and behind the text.  Its features are the runs of
``ORDERS`` characters, hashed to buckets.  Training counts buckets by language
over all rows that may be used: tasks sum their own rows into dense arrays,
Spark adds the arrays' cells up.  The logarithms of the smoothed shares form one
matrix (buckets x languages) that is sent to every worker; scoring is one scan
in which each batch is a sparse matrix of counts, multiplied with it.

The matrix has at most ``MOST_CELLS`` cells: the more languages, the fewer
buckets, down to ``LEAST_BITS``.  More languages than that leave room for are
an error, not a silent cut.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text when there is nothing to learn from.  The score is the
posterior probability of the predicted language; of equal ones the first name
in order of code points is taken.  Rows with a null language or text teach
nothing; repeated rows count each; other columns pass through untouched, also
those named like internal ones; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm import words as W
from marquee.llm.staging import free_name

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS, LEAST_BITS = 16, 8
#: Cells of the matrix of logarithms: 16 MB as 32-bit floats, and as many counts pass the driver once.
MOST_CELLS = 1 << 22
#: Added to every count.
SMOOTHING = 0.1
#: Characters handled together, and languages one task counts side by side.
CHUNK, OPEN_LANGUAGES = 500_000, 64
SPACE = np.uint32(32)


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def chunks(texts: Sequence[str | None], most: int = CHUNK) -> Iterator[list[str]]:
    """Consecutive lower-case texts of about ``most`` characters; null is empty."""
    part, size = [], 0
    for text in texts:
        text = "" if text is None else text.lower()
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def characters(part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code point, number of the text) of the letters and single spaces of all texts, and which texts have a letter."""
    point = np.frombuffer(" ".join(["", *part, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    # a text begins with the space before it; the space behind the last one begins nothing
    sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
    doc = np.append(np.repeat(np.arange(len(part)), sizes), len(part))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    letter = letters()[point]
    has = np.bincount(doc[letter], minlength=len(part)) > 0
    # of a run of other characters the first space stays, unless the run ends the text
    at = np.flatnonzero(letter)
    keep = letter.copy()
    keep[begin] = True
    first = at[np.flatnonzero(np.diff(at) > 1)] + 1
    behind = at[np.searchsorted(at, first)]
    keep[first[doc[first - 1] == doc[behind]]] = True
    return np.where(letter, point, SPACE)[keep], doc[keep], has


def sparse_counts(part: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, bucket, count) sorted by text, and which texts have a letter."""
    point, doc, has = characters(part)
    rows = []
    for n in ORDERS:
        if len(point) < n:
            continue
        with np.errstate(over="ignore"):
            grams = np.full(len(point) - n + 1, np.uint64(n))
            for k in range(n):
                grams = grams * np.uint64(0x100000001B3) + point[k: len(point) - n + 1 + k]
            bucket = (W.mix(grams) >> np.uint64(64 - bits)).astype(np.int64)
        # the space that begins the next text ends this one as well
        own = doc[: len(bucket)]
        on = doc[n - 2: n - 2 + len(bucket)] == own if n > 1 else point != SPACE
        on &= has[np.minimum(own, len(part) - 1)]
        rows.append(own[on] << bits | bucket[on])
    key, count = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count, has


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    #: logarithms of the languages' shares of all texts, and (buckets x languages) of the buckets' shares
    prior: np.ndarray
    matrix: np.ndarray

    def score_texts(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        bits = len(self.matrix).bit_length() - 1
        names, scores = [], []
        for part in chunks(texts):
            doc, bucket, count, has = sparse_counts(part, bits)
            total = np.tile(self.prior, (len(part), 1))
            step = max(1, (1 << 22) // max(1, len(self.names)))  # cells of a block of rows
            for at in range(0, len(doc), step):
                d, rows = doc[at: at + step], self.matrix[bucket[at: at + step]] * count[at: at + step, None]
                first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                total[d[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)
            best = total.argmax(1) if self.names else np.zeros(len(part), np.int64)
            for k in range(len(part)):
                if has[k] and self.names:
                    names.append(self.names[best[k]])
                    scores.append(1 / np.exp(np.maximum(total[k] - total[k, best[k]], -700)).sum())
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
        return names, np.asarray(scores, float)

    def predict(self, docs: DataFrame, *, text: str = "text") -> DataFrame:
        """``docs`` with lang_pred and score; one scan, no shuffle."""
        sent = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("lang_pred string, score double")
        def guess(texts: pd.Series) -> pd.DataFrame:
            names, scores = sent.value.score_texts(list(texts))
            return pd.DataFrame({"lang_pred": names, "score": scores})

        kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
        found = free_name(docs, "guess")
        return docs.withColumn(found, guess(F.col(f"`{text}`"))).select(*kept, f"{found}.lang_pred", f"{found}.score")


def train(docs: DataFrame, *, usable: Column | None = None, text: str = "text", lang: str = "lang",
          smoothing: float = SMOOTHING) -> LanguageModel:
    """Counts over all rows of ``docs`` for which ``usable`` holds and whose language is not null."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"),
                       (F.lit(True) if usable is None else usable).alias("usable"))
    rows = rows.filter("usable and lang is not null and text is not null").select("lang", "text")
    most = MOST_CELLS >> LEAST_BITS
    names = tuple(sorted(r.lang for r in rows.select("lang").distinct().limit(most + 1).collect()))
    if len(names) > most:
        raise ValueError(f"more than {most} languages")
    if not names:
        return LanguageModel((), np.zeros(0), np.zeros((1 << LEAST_BITS, 0), np.float32))
    bits = min(BITS, (MOST_CELLS // len(names)).bit_length() - 1)
    number = docs.sparkSession.sparkContext.broadcast({name: k for k, name in enumerate(names)})

    def emit(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, counts in held.items():
            on = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), k, np.int32)), pa.array(on.astype(np.int32)),
                                              pa.array(counts[on])], names=["lang", "bucket", "n"])
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = number.value, {}  # the cell behind the last bucket counts texts
        for batch in batches:
            of, at = np.array([known[x] for x in batch.column(0).to_pylist()], np.int64), 0
            for part in chunks(batch.column(1).to_pylist()):
                doc, bucket, times, _ = sparse_counts(part, bits)
                own, at = of[at: at + len(part)], at + len(part)
                for k in np.unique(own).tolist():
                    if k not in held:
                        if len(held) >= OPEN_LANGUAGES:
                            yield from emit(held)
                        held[k] = np.zeros((1 << bits) + 1, np.int64)
                    on = own[doc] == k
                    held[k][: 1 << bits] += np.bincount(bucket[on], times[on], 1 << bits).astype(np.int64)
                    held[k][1 << bits] += int((own == k).sum())
        yield from emit(held)

    cells = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(((1 << bits) + 1, len(names)))
    counts[cells["bucket"].to_numpy(np.int64), cells["lang"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    texts, counts = counts[-1], counts[:-1] + smoothing
    return LanguageModel(names, np.log(texts / texts.sum()), np.log(counts / counts.sum(0)).astype(np.float32))
