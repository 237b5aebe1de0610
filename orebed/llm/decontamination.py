"""Benchmark passages in training texts, found by spaced seeds.

A spaced seed is a mask over word positions; positions outside the mask are not hashed, so a
hit survives a substituted word there. Windows of the items under every mask are hashed into
an index, training windows are looked up in it, and every hit names an item and a shift of
the text against it. Along that shift the words of both are compared, and the longest
stretch that keeps ``MATCH`` of its words is verified.

The masks miss nothing: wherever the substituted words of an overlap stand, as many as
``MATCH`` allows, one mask fits between them. A long overlap can be cut into parts of 13 to
25 words, one of which keeps ``MATCH`` of its words, so that masks which fit into all such
parts fit into all overlaps; tests go through all of them.

The index of a block of items is bounded by ``BLOCK_WORDS`` words, so it can go to every
task. A larger benchmark takes several passes over the texts, one per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebed.llm.words import LETTERS, chunks, find_words, mix

#: An overlap is as long as this, or as the item if that is shorter.
LEAST_WORDS = 13
MATCH = Fraction(4, 5)
#: Found by a greedy search for few masks of many words that fit into all overlaps.
MASKS = ("1111011", "11010001011", "1100011011", "1111101")
#: For items of so many words, one or two of which may be substituted.
SHORT_MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("11111", "111101", "111011", "110111", "101111"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"),
    11: ("1110111", "111001011", "1011111", "111111"),
    12: ("11101011", "101100111", "111111"),
}
BLOCK_WORDS = 2_000_000
#: Hits that are held at once.
_AT_ONCE = 1 << 20

OVERLAPS = (
    "array<struct<item_id: bigint, item_start: int, start: int, words: int, matched: int>>"
)


def _windows(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the window that begins at each word, over the positions of ``mask``."""
    count = len(hashes) - len(mask) + 1
    total = np.full(max(0, count), salt, dtype=np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1" and count > 0:
            total = (total ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            total ^= total >> np.uint64(29)
    return mix(total)


def _masks(words: int) -> tuple[str, ...]:
    """Seeds for items of so many words; under five words all of them have to agree."""
    return ("1" * words,) if words < 5 else SHORT_MASKS.get(words, MASKS)


@dataclass
class Index:
    """Windows of items by hash, sorted: item and first word of each. Consecutive windows of
    an item with one hash stand once, with the first word of the last. ``masks`` in use."""

    masks: list[str]
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    last: np.ndarray
    first: np.ndarray  # of each item's words in ``words``, one more at the end
    words: np.ndarray
    ids: list[int | None]


def build_index(ids: list[int | None], texts: list[str]) -> Index:
    found = find_words(pa.array(texts, pa.string()), LETTERS)
    masks = sorted({m for n in found.counts() if n for m in _masks(int(n))})
    hashes, item, at = [], [], []
    for i, count in enumerate(found.counts()):
        words = found.hash[found.first[i] : found.first[i + 1]]
        for mask in _masks(int(count)) if count else ():
            window = _windows(words, mask, masks.index(mask) + 1)
            hashes.append(window)
            item.append(np.full(len(window), i, np.int32))
            at.append(np.arange(len(window), dtype=np.int32))
    if not hashes:
        empty = np.zeros(0, np.int64)
        return Index(
            [], empty.astype(np.uint64), empty, empty, empty, found.first, found.hash, []
        )
    joined, items, starts = map(np.concatenate, (hashes, item, at))
    order = np.argsort(joined, kind="stable")
    joined, items, starts = joined[order], items[order], starts[order]
    parted = (
        (joined[1:] != joined[:-1]) | (items[1:] != items[:-1]) | (starts[1:] != starts[:-1] + 1)
    )
    head, end = np.append(True, parted), np.append(parted, True)
    return Index(
        masks, joined[head], items[head], starts[head], starts[end], found.first, found.hash, ids
    )


def _stretch(same: np.ndarray) -> tuple[int, int, int]:
    """The longest stretch of ``same`` that keeps ``MATCH`` of its words, of several the one
    with the most matches: first, end, matches. It begins and ends with a match."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # From match i to match j there are j - i + 1 matches in at[j] - at[i] + 1 words.
    equal, of = MATCH.numerator, MATCH.denominator
    excess = of * np.arange(len(at)) - equal * at
    lowest = np.minimum.accumulate(excess)
    begin = np.searchsorted(-lowest, -(excess + of - equal))
    words = at - at[begin] + 1
    matches = np.arange(len(at)) - begin + 1
    best = int((words * (len(same) + 1) + matches).argmax())
    return int(at[begin[best]]), int(at[best]) + 1, int(matches[best])


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1`` and so on, ``count`` of each."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _pieces(count: np.ndarray) -> Iterator[slice]:
    """Slices of ``count`` that add up to ``_AT_ONCE`` at most, or have one element."""
    total, begin = np.cumsum(count), 0
    while begin < len(count):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + _AT_ONCE, side="right")))
        yield slice(begin, end)
        begin = end


def _shifts(index: Index, words: np.ndarray) -> list[tuple[int, int]]:
    """Items and shifts that a window under some mask names.

    A run of equal windows here meets a run of equal windows of an item under consecutive
    shifts, so hits are taken by runs, and a bounded number of them at a time.
    """
    # Shifts from -(longest item) to the number of words, beside the item in one number.
    longest = int(np.diff(index.first).max(initial=0))
    wide = longest + len(words) + 1
    known = np.zeros(0, np.int64)
    for number, mask in enumerate(index.masks):
        windows = _windows(words, mask, number + 1)
        if not len(windows):
            continue
        parted = windows[1:] != windows[:-1]
        head, end = np.flatnonzero(np.append(True, parted)), np.flatnonzero(np.append(parted, True))
        low = np.searchsorted(index.hashes, windows[head], side="left")
        many = np.searchsorted(index.hashes, windows[head], side="right") - low
        hit = np.flatnonzero(many)
        for part in _pieces(many[hit]):
            here = hit[part]
            there = _expanded(low[here], many[here])
            here = np.repeat(here, many[here])
            least = head[here] - index.last[there]
            count = end[here] - index.at[there] - least + 1
            for run in _pieces(count):
                shift = _expanded(least[run], count[run])
                item = np.repeat(index.item[there[run]].astype(np.int64), count[run])
                known = np.union1d(known, item * wide + shift + longest)
    return [(k // wide, k % wide - longest) for k in known.tolist()]


def overlaps_of(index: Index, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(item, first word there, first word here, words, matches) of verified overlaps, the
    longest for each item and shift."""
    found = []
    for item, shift in _shifts(index, words):
        theirs = index.words[index.first[item] : index.first[item + 1]]
        low, high = max(0, -shift), min(len(theirs), len(words) - shift)
        needed = min(LEAST_WORDS, len(theirs))
        if high - low < needed:
            continue
        same = theirs[low:high] == words[low + shift : high + shift]
        if len(theirs) < LEAST_WORDS:  # all of it, whichever words differ
            first, end, matches = 0, len(theirs), int(same.sum())
        else:
            first, end, matches = _stretch(same)
        if end - first >= needed and matches >= MATCH * (end - first):
            found.append((item, low + first, low + first + shift, end - first, matches))
    return found


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of all items, a bounded number of words in each. Items are dealt to blocks by
    hash, so that one block at a time comes to the driver."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(
        "text IS NOT NULL"
    )
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-size // (2 * BLOCK_WORDS)))  # a word has two characters with its gap
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for number in range(count):
        rows = items.where(block == number).orderBy("item_id", "text").collect()
        if rows:
            yield build_index([r["item_id"] for r in rows], [r["text"] for r in rows])


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``overlaps``: item_id, its first word, the first word here, words and
    matching words, for every item and shift with a verified overlap.

    Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased. An
    overlap has 13 words, or as many as the item, and 4 in 5 of them match; one inside a
    longer item begins and ends with a match. A text without words, NULL among them, has none; neither has an item without words or an empty
    benchmark. Items that are repeated are reported each. A column ``overlaps`` of the input
    is replaced; no other column is touched, and no row moves.
    """
    docs = docs.drop("overlaps")
    result = docs.withColumn("overlaps", F.array().cast(OVERLAPS))
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"overlaps {OVERLAPS}").fields])
    context = docs.sparkSession.sparkContext
    for index in _blocks(benchmark):
        shared = context.broadcast(index)

        def search(
            batches: Iterator[pa.RecordBatch], shared=shared
        ) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in chunks(batches, "text"):
                found = find_words(batch.column("text"), LETTERS)
                before = batch.column("overlaps").to_pylist()
                for row in _rows_with_hits(index, found):
                    words = found.hash[found.first[row] : found.first[row + 1]]
                    before[row] = (before[row] or []) + [
                        {
                            "item_id": index.ids[i], "item_start": a, "start": b,
                            "words": n, "matched": m,
                        }
                        for i, a, b, n, m in overlaps_of(index, words)
                    ]
                kind = batch.schema.field("overlaps").type
                at = batch.schema.get_field_index("overlaps")
                yield batch.set_column(at, "overlaps", pa.array(before, kind))

        result = result.mapInArrow(search, schema)
    return result


def _rows_with_hits(index: Index, found) -> list[int]:
    """Rows some window of which is in the index; windows across rows do no harm here."""
    rows = []
    for number, mask in enumerate(index.masks):
        windows = _windows(found.hash, mask, number + 1)
        at = np.searchsorted(index.hashes, windows)
        hit = index.hashes[np.minimum(at, len(index.hashes) - 1)] == windows
        rows.append(found.doc[: len(windows)][hit])
    return np.unique(np.concatenate(rows)).tolist() if rows else []


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; all columns as they were."""
    clean = find_overlaps(docs, benchmark).where(F.size("overlaps") == 0)
    return clean.select(*(F.col(f"`{name}`") for name in docs.columns))
