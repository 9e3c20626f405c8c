"""Words and byte windows of many texts as 64-bit hashes, by whole-array arithmetic.

Texts are joined to one byte array.  With a random value for each byte and an
odd base R, the prefix sums P[i] of value[byte] * R^i (modulo 2^64) give the
hash of any stretch as (P[end] - P[start]) * R^-start, so the hashes of all words
or of all windows cost a few array operations and no loop over words.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text handled together: each takes some 60 bytes in arrays while it is hashed, in every worker at once.
CHUNK = 250_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: its powers repeat as late as they can
_VALUES = np.random.default_rng(20_240_601).integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_powers: list[np.ndarray] = []


def release() -> None:
    """Give back what a finished task held: workers live on, and what they keep adds up with every stage they serve."""
    if _powers and len(_powers[0]) > CHUNK + 1:
        _powers[:] = []
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: its own matter
        pass


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over a partition's batches, with everything it held given back at its end."""
    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        release()

    return run


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(size, U(base & (2**64 - 1)))
            table[0] = U(1)
            with np.errstate(over="ignore"):
                _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(texts: Sequence[str | None], most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of consecutive texts of about ``most`` bytes; a longer text is alone."""
    first, part, size = 0, [], 0
    for n, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > most:
            yield first, np.frombuffer(b"".join(part), np.uint8), _offsets(part)
            first, part, size = n, [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield first, np.frombuffer(b"".join(part), np.uint8), _offsets(part)


def _offsets(part: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))]).astype(np.int64)


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """P[0..n]; ``which`` picks one of two independent sets of byte values."""
    power, _ = _power_table(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[which][data] * power[: len(data)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of ends; equal bytes have equal hashes wherever they stand."""
    _, inverse = _power_table(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * U(0x632BE59BD9B4E019))


def split_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of the text) of each maximal run of bytes that are no white space; never across texts."""
    inside = ~space[data]
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of each word, A-Z in lower case."""
    start, end, doc = split_words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), doc
    return stretch_hashes(prefix_sums(LOWER[data]), start, end), doc


def ngram_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of each run of n words within a text."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * U(0x9E3779B97F4A7C15)) + words[k: len(words) - n + 1 + k]
        out = mix(out)
    whole = doc[: len(words) - n + 1] == doc[n - 1:]
    return out[whole], doc[: len(words) - n + 1][whole]
