"""Words of many texts at once, as 64-bit hashes, inside Arrow tasks.

Texts of an Arrow batch lie in one byte buffer. A word's hash is a polynomial over its
bytes, taken as a difference of running sums over that buffer, so that no Python code
runs per word. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK_BYTES = 1 << 21
#: Bytes whose running sums are made at once, if no word is longer.
_WINDOW_BYTES = 1 << 17
_U64 = np.uint64


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = values.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def seeds(count: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=_U64) * _U64(_BASE) + _U64(salt))


_BYTE_VALUES = seeds(256, 11)


def _letters() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[0x80:] = True
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(first) : ord(last) + 1] = True
    return table


def _not_space() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


#: What a word is made of: ASCII letters, digits and all other characters beyond ASCII;
#: or everything but ASCII white space.
LETTERS, NOT_SPACE = _letters(), _not_space()

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, length: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < length:
        size = max(length, _WINDOW_BYTES + 1)
        steps = np.full(size, base, dtype=_U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size == _WINDOW_BYTES + 1:
            _powers[base] = have
    return have[:length]


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """By windows of whole words, so that running sums, eight bytes for each of the text's,
    take little memory."""
    hashes = np.empty(len(start), dtype=_U64)
    low = 0
    while low < len(start):
        at = int(start[low])
        high = max(low + 1, int(np.searchsorted(end, at + _WINDOW_BYTES, "right")))
        size = int(end[high - 1]) - at
        values = _BYTE_VALUES[data[at : at + size]]
        values *= _power_table(_BASE, size)
        sums = np.zeros(size + 1, dtype=_U64)
        np.cumsum(values, out=sums[1:])
        first = start[low:high] - at
        hashes[low:high] = sums[end[low:high] - at] - sums[first]
        hashes[low:high] *= _power_table(_INVERSE, size)[first]
        low = high
    return mix(hashes + (end - start).astype(_U64))


@dataclass
class Words:
    """``doc``: row of each word; ``hash``; ``start`` and ``end`` in ``bytes``;
    ``first``: index of each row's first word, with one more entry at the end."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bytes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, index: int) -> str:
        return self.bytes[self.start[index] : self.end[index]].tobytes().decode("utf-8", "replace")


def ascii_lower(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one more entry at the end).
    A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(filled) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def find_words(texts: pa.Array, letters: np.ndarray, *, lower: str = "unicode") -> Words:
    """``lower``: "unicode", "ascii" or "none"."""
    if lower == "unicode":
        texts = pc.utf8_lower(texts)
    data, at = text_bytes(texts)
    if lower == "ascii":
        data = ascii_lower(data)
    inside = letters[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = _word_hashes(data, start, end)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(doc, hashes, start, end, data, first)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``width`` words; a row with fewer words, but at least
    one, has one shingle of all its words."""
    n = len(words.hash)
    power = _power_table(_BASE, width)
    total = np.zeros(max(0, n - width + 1), dtype=_U64)
    for k in range(width):
        total += words.hash[k : n - width + 1 + k] * power[k]
    whole = words.doc[: len(total)] == words.doc[width - 1 :] if n >= width else np.zeros(0, bool)
    doc, hashes = words.doc[: len(total)][whole], total[whole]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), dtype=_U64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += words.hash[words.first[short[has]] + k] * power[k]
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, extra + counts[short].astype(_U64)])
    return doc, mix(hashes)


def distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) pairs once each, sorted."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[keep], hashes[keep]


def chunks(
    batches: Iterator[pa.RecordBatch], column: str, size: int = _CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, so that memory follows
    neither the batch size of the session nor the number of rows."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False
        )
        part = np.cumsum(lengths.astype(np.int64) + 16) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(_U64).view(np.int64)
