"""Scores of texts under a class-based bigram model.

Every word belongs to a class. A text's probability is the product, over its tokens, of the
class's probability after the class before it and of the word's within its class.

Classes are found by exchange, in two steps. The most frequent words, and groups of the
others by ending, move one after another to the class that raises the likelihood most, given
how often each class stands before and after them; sweeps go on until the likelihood stops
rising. Then every other word of ``LEAST_COUNT`` or more tokens chooses its class by the
classes that stand around it: its contexts are gathered by a shuffle on parts of the words,
packed, and the choice is made in tasks, against the small table of class pairs. So the words that are
classed, and what is gathered for them, grow with the corpus. Words met more rarely, or
never, have the class of their ending.

Counts of words cover all words of the training texts. The most frequent ones, a bounded
number, go to every task with their counts and classes. The other words of a block of texts meet
theirs in a join and come back to the block, so every word predicts what follows it by its
own class, and scores are the same whichever words the tasks know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.llm.words import NOT_SPACE, Words, chunks, find_words, mix, seeds, signed
from orebed.session import materialize

CLASSES = 48
#: Words classed one after another, and groups of other words by their last three bytes.
OWN_UNITS, ENDINGS = 2048, 2048
#: Other words with so many tokens choose a class of their own.
LEAST_COUNT = 2
#: At most so many sweeps over the frequent words, and over all others.
SWEEPS, WORD_SWEEPS = 8, 2
#: A sweep that raises the log likelihood of a token by less is the last.
LEAST_GAIN = 1e-3
#: At most so many words have their counts in every task.
IN_TASKS = 1 << 18
SMOOTHING = 0.1
BASE_SMOOTHING = 0.1
#: At most so many words that tasks know have their contexts added up together, with about so
#: many tokens; and so many tokens of other words, which are held at once.
PART_WORDS, PART_TOKENS, FAR_TOKENS = 1 << 12, 1 << 22, 1 << 18
_COUNT_BYTES = 1 << 22
#: Numbers of tokens are stored in three bytes, and read so many bytes of their first two at once.
_MOST_IN_TASKS, _LOW_BYTES = 1 << 23, 1 << 20
#: Tokens in a row of what is shuffled, so that a batch of rows is small.
_ROW_TOKENS = 256
#: Counts of units and classes are added up in so many groups.
_SUM_PARTS = 64
_END_SALT = seeds(3, 71)
#: Added to a class that is that of a word's ending, until the word has met its own.
_FAR = 64


def _tokens(batch: pa.RecordBatch) -> Words:
    """Words between ASCII white space, A-Z lower-cased."""
    return find_words(batch.column("text"), NOT_SPACE, lower="ascii")


def _endings(words: Words, which: np.ndarray) -> np.ndarray:
    """Group of each word by its last three bytes."""
    total = np.zeros(len(which), dtype=np.uint64)
    for k in range(3):
        at = words.end[which] - 1 - k
        there = at >= words.start[which]
        values = np.where(there, words.bytes[np.maximum(at, 0)].astype(np.uint64) + 1, 0)
        total += mix(values.astype(np.uint64) + _END_SALT[k])
    return (mix(total) % np.uint64(ENDINGS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Words that every task knows, most frequent first: hash, training count, unit (of their
    own, or of their ending). A known word's number is its place here; another's is that of its
    ending, counted on from there."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    ordered: np.ndarray  # the hashes, sorted, and the numbers of their words
    numbers: np.ndarray
    least: int  # words with this count or more are all here
    tokens: int  # training tokens, ends included
    types: int  # distinct ones
    ends: int

    @property
    def far(self) -> int:
        """Training tokens of words that are not here."""
        return int(self.tokens - self.ends - self.counts.sum())

    @property
    def end(self) -> int:
        """Number of the end of a text."""
        return len(self.hashes) + ENDINGS

    def units_of_numbers(self) -> np.ndarray:
        """The end is a unit, too, after all others."""
        return np.concatenate([self.units, OWN_UNITS + np.arange(ENDINGS + 1)])

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 if one is not here."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.ordered, hashes), len(self.ordered) - 1)
        return np.where(self.ordered[at] == hashes, self.numbers[at], -1)

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Count of each token, -1 if its word is not here, and its number."""
        if not len(self.hashes):
            return np.full(len(words.hash), -1), _endings(words, np.arange(len(words.hash)))
        numbers = self.places(words.hash)
        counts = np.where(numbers >= 0, self.counts[numbers], -1)
        rest = np.flatnonzero(numbers < 0)
        numbers[rest] = len(self.hashes) + _endings(words, rest)
        return counts, numbers

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the unigram probability of tokens with these counts."""
        whole = self.tokens + BASE_SMOOTHING * (self.types + 1)
        return np.log10((counts + BASE_SMOOTHING) / whole)


@dataclass
class ClassModel:
    vocabulary: Vocabulary
    kinds: np.ndarray  # class by a token's number; the last is the end
    transition: np.ndarray  # log10, from class to class; the last is the end of a text
    class_tokens: np.ndarray
    class_types: np.ndarray
    exchanged: int  # training tokens whose word has a class by exchange
    whole: bool  # words that no task knows predict by their own class, not their ending's

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's probability in its class, by its count."""
        whole = self.class_tokens[classes] + SMOOTHING * (self.class_types[classes] + 1)
        return np.log10((counts + SMOOTHING) / whole)


def word_counts(training: DataFrame) -> DataFrame:
    """word (hash), ending and n for every word of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _COUNT_BYTES):
            words = _tokens(batch)
            hashes, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(hashes)), pa.array(_endings(words, first).astype(np.int32)),
                    pa.array(n.astype(np.int64)),
                ],
                ["word", "ending", "n"],
            )

    rows = training.select("text").mapInArrow(count, "word bigint, ending int, n bigint")
    return rows.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame, ends: int, in_tasks: int) -> Vocabulary:
    if in_tasks > _MOST_IN_TASKS:
        raise ValueError(f"at most {_MOST_IN_TASKS} words can be in tasks, not {in_tasks}")
    tokens, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # Eight steps to each doubling: a few hundred rows however large the corpus.
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(
        (r["step"], r["words"], r["low"]) for r in counts.groupBy(step.alias("step")).agg(
            F.count(F.lit(1)).alias("words"), F.min("n").alias("low")
        ).collect()
    )
    least, total = 2**62, 0
    for _, words, low in reversed(steps):
        total += words
        if total > in_tasks:
            break
        least = low
    rows = counts.select("word", "ending", "n")
    # Units are the same words whatever the bound, so these are here in any case.
    top = rows.orderBy(F.desc("n"), F.col("word") < 0, "word").limit(OWN_UNITS).toArrow()
    found = pa.concat_tables([top, rows.where(F.col("n") >= least).toArrow()])
    hashes, first = np.unique(found["word"].to_numpy().view(np.uint64), return_index=True)
    endings = found["ending"].to_numpy()[first].astype(np.int64)
    units = np.where(first < len(top), first, OWN_UNITS + endings)
    n = found["n"].to_numpy()[first]
    order = np.argsort(-n, kind="stable")
    numbers = np.empty_like(order)
    numbers[order] = np.arange(len(order))
    return Vocabulary(
        hashes[order], n[order], units[order], hashes, numbers, least, (tokens or 0) + ends,
        types + bool(ends), ends,
    )


def _sequence(words: Words, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, ends included, and where the words are among them."""
    texts = len(words.first) - 1
    sequence = np.full(len(words.hash) + texts, end)
    at = np.arange(len(words.hash)) + words.doc
    sequence[at] = classes
    return sequence, at


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """``values`` as bytes, cut into rows of these lengths."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data]
    )


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """All values of all rows."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None or ends[0] == ends[-1]:
        return np.zeros(0, kind)
    return np.frombuffer(data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes(), kind)


def number_tokens(training: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """For each text the numbers of its tokens, ends included, the hashes of the words that no
    task knows, and the block of texts whose words are looked up together. Sweeps read these,
    so that texts are taken apart once. To be stored, as blocks go by tasks."""
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, block = shared.value, TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", _COUNT_BYTES):
            words = _tokens(batch)
            counts, numbers = vocabulary.look_up(words)
            sequence, _ = _sequence(words, numbers, vocabulary.end)
            far = counts < 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(batch.num_rows, block)),
                    _packed((sequence & 0xFFFF).astype(np.uint16), words.counts() + 1),
                    _packed((sequence >> 16).astype(np.uint8), words.counts() + 1),
                    _packed(words.hash[far], np.bincount(words.doc[far], minlength=batch.num_rows)),
                ],
                ["block", "low", "high", "far"],
            )
            block += 1

    schema = "block bigint, low binary, high binary, far binary"
    return training.select("text").mapInArrow(number, schema)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """Of all tokens of these texts. Frequent words have small ones, so that the high byte,
    kept apart, takes little space."""
    high = _unpacked(batch.column("high"), np.uint8).astype(np.int64)
    return high << 16 | _unpacked(batch.column("low"), np.uint16)


def _counted(
    words: np.ndarray, cells: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of a word and a cell, and how often each occurs."""
    order = np.lexsort((cells, words))
    words, cells = words[order], cells[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (words[1:] != words[:-1]) | (cells[1:] != cells[:-1])
    begin = np.flatnonzero(first)
    return words[begin], cells[begin], np.diff(np.append(begin, len(order)))


def far_words(sequences: DataFrame) -> DataFrame:
    """word and block of the words that no task knows."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "far", _COUNT_BYTES):
            each = pc.binary_length(batch.column("far")).to_numpy() // 8
            blocks = np.repeat(batch.column("block").to_numpy(), each)
            words, blocks, _ = _counted(_unpacked(batch.column("far"), np.uint64), blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(words)), pa.array(blocks)], ["word", "block"]
            )

    return sequences.select("block", "far").mapInArrow(take, "word bigint, block bigint")


def _met(words: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``words`` the column word of ``table`` has, and the rows these have there."""
    there = table["word"].to_numpy().view(np.uint64)
    order = np.argsort(there)
    at = np.searchsorted(there[order], words)
    found = at < len(there)
    found[found] = there[order[at[found]]] == words[found]
    return found, order[at[found]]


def _as_batch(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def _met_far(assigned: DataFrame) -> DataFrame:
    """block, word and class of the words that no task knows, for each block that has them."""
    far = assigned.where("number < 0")
    return far.select(F.explode("blocks").alias("block"), "word", "class")


def _with_classes(
    sequences: DataFrame, vocabulary: Vocabulary, kinds: np.ndarray, assigned: DataFrame
) -> DataFrame:
    """``sequences`` with the classes of the words that no task knows: those ``assigned``, or
    their ending's."""
    known, end = len(vocabulary.hashes), vocabulary.end
    by_ending = kinds[known:end].astype(np.int8)

    def classify(texts: pa.Table, met: pa.Table) -> pa.Table:
        batch = _as_batch(texts)
        numbers = _numbers(batch)
        classes = by_ending[numbers[(numbers >= known) & (numbers < end)] - known]
        found, at = _met(_unpacked(batch.column("far"), np.uint64), met)
        classes[found] = met["class"].to_numpy()[at]
        each = pc.binary_length(batch.column("far")).to_numpy() // 8
        return texts.append_column("classes", _packed(classes, each))

    texts = sequences.select("block", "low", "high", "far")
    schema = "block bigint, low binary, high binary, far binary, classes binary"
    met = _met_far(assigned)
    return texts.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(classify, schema)


def _pairs_with(
    sequences: DataFrame, vocabulary: Vocabulary, kinds: np.ndarray, assigned: DataFrame
) -> np.ndarray:
    """Counts of pairs of classes as in ``_with_classes``, for which a token's class will do."""
    width = CLASSES + 1
    shared = sequences.sparkSession.sparkContext.broadcast((vocabulary, kinds))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kinds = shared.value
        for batch in chunks(batches, "low", _LOW_BYTES):
            numbers = _numbers(batch)
            far = (numbers >= len(vocabulary.hashes)) & (numbers < vocabulary.end)
            classes = (kinds[numbers] + _FAR * far).astype(np.int8)
            each = pc.binary_length(batch.column("high")).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), _packed(classes, each), batch.column("far")],
                ["block", "classes", "far"],
            )

    def count(texts: pa.Table, met: pa.Table) -> pa.Table:
        batch = _as_batch(texts)
        classes = _unpacked(batch.column("classes"), np.int8).astype(np.int64)
        far = np.flatnonzero(classes >= _FAR)
        classes[far] -= _FAR
        found, at = _met(_unpacked(batch.column("far"), np.uint64), met)
        classes[far[found]] = met["class"].to_numpy()[at]
        cell = _beside(classes)[0] * width + classes
        total = np.bincount(cell, minlength=width * width).reshape(width, width)
        return pa.Table.from_batches(_count_rows(total))

    texts = sequences.mapInArrow(take, "block bigint, classes binary, far binary")
    met = _met_far(assigned)
    rows = texts.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(count, _COUNTS)
    return _summed(rows, width, width)


def _classed(
    batch: pa.RecordBatch, vocabulary: Vocabulary, kinds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the tokens, which of them no task knows, and the class of each."""
    numbers = _numbers(batch)
    far = (numbers >= len(vocabulary.hashes)) & (numbers < vocabulary.end)
    classes = kinds[numbers]
    if "classes" in batch.schema.names:
        classes[far] = _unpacked(batch.column("classes"), np.int8)
    return numbers, far, classes


def _beside(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and after each of a sequence that ends with an end."""
    return np.concatenate([[CLASSES], sequence[:-1]]), np.concatenate([sequence[1:], [CLASSES]])


_COUNTS = "part int, item int, counts binary"


def _count_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each item, a line of ``counts``, that was met."""
    item = np.flatnonzero(counts.any(axis=1))
    packed = _packed(counts[item], np.full(len(item), counts.shape[1]))
    item = item.astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(item % _SUM_PARTS), pa.array(item), packed], ["part", "item", "counts"]
    )


def _summed(rows: DataFrame, items: int, width: int) -> np.ndarray:
    """The lines of all tasks, added up in tasks."""

    def add(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        total = np.zeros((items // _SUM_PARTS + 1, width), dtype=np.int64)
        for batch in batches:
            lines = _unpacked(batch.column("counts"), np.int64).reshape(-1, width)
            np.add.at(total, batch.column("item").to_numpy() // _SUM_PARTS, lines)
        item = np.flatnonzero(total.any(axis=1))
        packed = _packed(total[item], np.full(len(item), width))
        item = (item * _SUM_PARTS + key[0].as_py()).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(item), packed], ["item", "counts"])

    parts = rows.repartition(_SUM_PARTS // 4, "part").groupBy("part")
    found = parts.applyInArrow(add, "item int, counts binary").toArrow()
    counts = np.zeros((items, width))
    for batch in found.to_batches():
        lines = _unpacked(batch.column("counts"), np.int64).reshape(-1, width)
        counts[batch.column("item").to_numpy()] = lines
    return counts


def _contexts(
    sequences: DataFrame, vocabulary: Vocabulary, classes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """How often each class stands before (0) and after (1) each unit, and how often each
    unit stands after itself."""
    units, kinds = OWN_UNITS + ENDINGS, CLASSES + 1
    context = sequences.sparkSession.sparkContext
    shared = context.broadcast((vocabulary.units_of_numbers(), np.append(classes, CLASSES)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_of, classes = shared.value
        total = np.zeros((2, units * kinds), dtype=np.int64)
        twice = np.zeros(units, dtype=np.int64)
        for batch in chunks(batches, "low", _LOW_BYTES):
            unit = unit_of[_numbers(batch)]
            inner = unit < units
            for side, other in enumerate(_beside(classes[unit])):
                total[side] += np.bincount(
                    unit[inner] * kinds + other[inner], minlength=units * kinds
                )
            same = (unit[1:] == unit[:-1]) & inner[1:]
            twice += np.bincount(unit[1:][same], minlength=units)
        before, after = total.reshape(2, units, kinds)
        yield from _count_rows(np.hstack([before, after, twice[:, None]]))

    rows = sequences.select("low", "high").mapInArrow(count, _COUNTS)
    found = _summed(rows, units, 2 * kinds + 1)
    return np.stack([found[:, :kinds], found[:, kinds : 2 * kinds]]), found[:, 2 * kinds]


def _class_pairs(contexts: np.ndarray, classes: np.ndarray, texts: int) -> np.ndarray:
    """Counts of pairs of classes."""
    kinds = CLASSES + 1
    pairs = np.zeros((kinds, kinds))
    np.add.at(pairs.T, classes, contexts[0])
    after_end = contexts[1].sum(axis=0)[CLASSES]
    for kind in range(CLASSES):
        pairs[kind, CLASSES] = contexts[1][classes == kind, CLASSES].sum()
    pairs[CLASSES, CLASSES] = max(0, texts - after_end)
    return pairs


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the training texts by counts of pairs of classes, but for a part that
    no choice of classes changes."""
    whole = pairs.sum(axis=0)[:CLASSES]
    return float(_entropy(pairs).sum() - _entropy(pairs.sum(axis=1)).sum() - _entropy(whole).sum())


def exchange(
    contexts: np.ndarray, classes: np.ndarray, texts: int, twice: np.ndarray | None = None
) -> np.ndarray:
    """One sweep: units, most frequent first, move to the class of the highest likelihood.
    ``twice`` is how often a unit follows itself; such a pair counts once and moves whole."""
    classes = classes.copy()
    pairs = _class_pairs(contexts, classes, texts)
    sizes = contexts[0].sum(axis=1)
    total = np.bincount(classes, sizes, CLASSES)
    twice = np.zeros(len(classes)) if twice is None else twice
    start, diagonal = classes.copy(), np.arange(CLASSES)
    for unit in np.argsort(-sizes, kind="stable"):
        if sizes[unit] == 0:
            break
        old, own = classes[unit], twice[unit]
        before, after = contexts[0][unit].copy(), contexts[1][unit].copy()
        # The unit's own class stood beside it when contexts were counted.
        before[start[unit]] -= own
        after[start[unit]] -= own
        pairs[:, old] -= before
        pairs[old, :] -= after
        pairs[old, old] -= own
        # Other units have moved since contexts were counted.
        np.maximum(pairs, 0, out=pairs)
        total[old] -= sizes[unit]
        columns, rows = pairs[:, :CLASSES], pairs[:CLASSES, :]
        inside = pairs[diagonal, diagonal]
        gain = (
            (_entropy(columns + before[:, None]) - _entropy(columns)).sum(axis=0)
            + (_entropy(rows + after) - _entropy(rows)).sum(axis=1)
            + _entropy(inside + before[:CLASSES] + after[:CLASSES] + own) + _entropy(inside)
            - _entropy(inside + before[:CLASSES]) - _entropy(inside + after[:CLASSES])
            - 2 * (_entropy(total + sizes[unit]) - _entropy(total))
        )
        new = int(gain.argmax())
        if gain[new] <= gain[old] + 1e-9:
            new = old
        classes[unit] = new
        pairs[:, new] += before
        pairs[new, :] += after
        pairs[new, new] += own
        total[new] += sizes[unit]
    return classes


def _exchange_units(
    sequences: DataFrame, vocabulary: Vocabulary, texts: int, sweeps: int
) -> np.ndarray:
    """Classes of units, by sweeps until the likelihood stops rising."""
    # Neighbours in frequency begin in different classes.
    classes = np.arange(OWN_UNITS + ENDINGS) % CLASSES
    best, best_classes = -np.inf, classes
    for sweep in range(sweeps + 1):
        contexts, twice = _contexts(sequences, vocabulary, classes)
        value = likelihood(_class_pairs(contexts, classes, texts))
        if value <= best + LEAST_GAIN * vocabulary.tokens:
            return classes if value > best else best_classes
        best, best_classes = value, classes
        if sweep < sweeps:
            classes = exchange(contexts, classes, texts, twice)
    return best_classes


def _row_starts(keys: np.ndarray) -> np.ndarray:
    """Where rows begin, if each has equal ones of the sorted keys, and not too many."""
    begin = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    place = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
    return np.flatnonzero(place % _ROW_TOKENS == 0)


def _word_contexts(
    sequences: DataFrame, vocabulary: Vocabulary, kinds: np.ndarray, least: int, near_parts: int,
    far_parts: int,
) -> DataFrame:
    """Words without a unit of their own and the cells (class before and after) of their
    tokens, by part. Parts below zero have places of words that tasks know, the others hashes
    of words, from one block of texts a row."""
    shared = sequences.sparkSession.sparkContext.broadcast((vocabulary, kinds))
    width = CLASSES + 1

    def rows(part, block, begin, words, cells):
        lengths = np.diff(np.append(begin, len(words)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[begin].astype(np.int32)), pa.array(block[begin]),
                _packed(words, lengths), _packed(cells.astype(np.uint16), lengths),
            ],
            ["part", "block", "words", "cells"],
        )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kinds = shared.value
        wanted = (vocabulary.units >= OWN_UNITS) & (vocabulary.counts >= least)
        wanted = np.append(wanted, np.zeros(ENDINGS + 1, dtype=bool))
        for batch in chunks(batches, "low", _LOW_BYTES):
            numbers, far, classes = _classed(batch, vocabulary, kinds)
            before, after = _beside(classes)
            cells = before * width + after
            near = np.flatnonzero(wanted[numbers])
            # Each part has frequent and rare words.
            place, part = np.divmod(numbers[near], near_parts)
            order = np.argsort(part * PART_WORDS + place, kind="stable")
            near, part, place = near[order], part[order], place[order]
            yield rows(
                -1 - part, np.zeros(len(part), np.int64), _row_starts(part),
                place.astype(np.uint16), cells[near],
            )
            words = _unpacked(batch.column("far"), np.uint64)
            each = pc.binary_length(batch.column("far")).to_numpy() // 8
            block = np.repeat(batch.column("block").to_numpy(), each)
            part = (words % np.uint64(far_parts)).astype(np.int64)
            order = np.lexsort((block, part))
            part, block = part[order], block[order]
            new = np.append(True, (part[1:] != part[:-1]) | (block[1:] != block[:-1]))
            begin = _row_starts(np.cumsum(new[: len(part)]))
            yield rows(part, block, begin, words[order], cells[far][order])

    return sequences.mapInArrow(take, "part int, block bigint, words binary, cells binary")


def choose_classes(
    near: bool, before: np.ndarray, after: np.ndarray, pairs: np.ndarray
) -> np.ndarray:
    """The class of the highest likelihood for each word, by how often each class stands before
    and after it. ``near`` says whether what follows a word is predicted from its class."""
    smoothed = np.log(pairs + SMOOTHING)
    total = np.log(pairs.sum(axis=0)[:CLASSES] + SMOOTHING)
    score = before @ smoothed[:, :CLASSES] - before.sum(axis=1)[:, None] * total
    if near:
        score += after @ smoothed[:CLASSES].T - after.sum(axis=1)[:, None] * total
    return score.argmax(axis=1)


def _sides(row: np.ndarray, cells: np.ndarray, rows: int) -> np.ndarray:
    """How often each class stands before (0) and after (1) the word of each row."""
    width = CLASSES + 1
    return np.stack(
        [
            np.bincount(row * width + part, minlength=rows * width).reshape(rows, width)
            for part in np.divmod(cells.astype(np.int64), width)
        ]
    )


def _exchange_words(
    sequences: DataFrame, vocabulary: Vocabulary, kinds: np.ndarray, pairs: np.ndarray, least: int,
    whole: bool = False,
) -> DataFrame:
    """word, number and class of all words of ``least`` tokens without a unit of their own, and
    the blocks that have them, if no task knows them. With ``whole`` every word predicts what
    follows it, else those do that tasks know."""
    shared = sequences.sparkSession.sparkContext.broadcast(vocabulary)
    near = int(vocabulary.counts[vocabulary.units >= OWN_UNITS].sum())
    near_parts = len(vocabulary.hashes) // PART_WORDS + near // PART_TOKENS + 1
    far_parts = vocabulary.far // FAR_TOKENS + 1

    def found(words, number, kind, blocks=None, ends=None):
        ends = np.zeros(len(words)) if ends is None else ends
        blocks = np.zeros(0, np.int64) if blocks is None else blocks
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, ends).astype(np.int32)), pa.array(blocks)
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(signed(words)), pa.array(number.astype(np.int32)),
                pa.array(kind.astype(np.int32)), lists,
            ],
            ["word", "number", "class", "blocks"],
        )

    def choose_near(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = np.zeros((2, PART_WORDS, CLASSES + 1), dtype=np.int64)
        for batch in batches:
            place = _unpacked(batch.column("words"), np.uint16).astype(np.int64)
            sides += _sides(place, _unpacked(batch.column("cells"), np.uint16), PART_WORDS)
        met = np.flatnonzero(sides[0].any(axis=1))
        number = met * near_parts + part
        kind = choose_classes(True, *sides[:, met].astype(float), pairs)
        yield found(shared.value.hashes[number], number, kind)

    def choose_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            (
                _unpacked(b.column("words"), np.uint64), _unpacked(b.column("cells"), np.uint16),
                np.repeat(
                    b.column("block").to_numpy(), pc.binary_length(b.column("cells")).to_numpy() // 2
                ),
            )
            for b in batches
        ]
        words, cells, blocks = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((blocks, words))
        words, cells, blocks = words[order], cells[order], blocks[order]
        new = np.append(True, words[1:] != words[:-1])
        times = np.diff(np.append(np.flatnonzero(new), len(words)))
        often = np.repeat(times >= least, times)
        words, cells, blocks, new = words[often], cells[often], blocks[often], new[often]
        begin = np.append(np.flatnonzero(new), len(words))
        for low in range(0, len(begin) - 1, PART_WORDS):
            ends = begin[low : low + PART_WORDS + 1]
            here = slice(ends[0], ends[-1])
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            sides = _sides(row, cells[here], len(ends) - 1)
            kind = choose_classes(whole, *sides.astype(float), pairs)
            first = new[here].copy()
            first[1:] |= blocks[here][1:] != blocks[here][:-1]
            different = np.bincount(row[first], minlength=len(ends) - 1)
            yield found(
                words[ends[:-1]], np.full(len(kind), -1), kind, blocks[here][first],
                np.cumsum(different),
            )

    def choose(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        return choose_near(-1 - part, batches) if part < 0 else choose_far(batches)

    contexts = _word_contexts(sequences, vocabulary, kinds, least, near_parts, far_parts)
    contexts = contexts.repartition((near_parts + far_parts) // 4 + 1, "part")
    schema = "word bigint, number int, class int, blocks array<bigint>"
    return contexts.groupBy("part").applyInArrow(choose, schema)


def _pairs(
    sequences: DataFrame, vocabulary: Vocabulary, kinds: np.ndarray, assigned: DataFrame | None
) -> np.ndarray:
    """How often each class stands after each. Words that no task knows have the classes that
    ``sequences`` give, or those ``assigned`` to what follows another, or their ending's."""
    width, apart = CLASSES + 1, assigned is not None
    shared = sequences.sparkSession.sparkContext.broadcast((vocabulary, kinds))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        vocabulary, kinds = shared.value
        for batch in chunks(batches, "low", _LOW_BYTES):
            _, far, classes = _classed(batch, vocabulary, kinds)
            yield batch, far, _beside(classes)[0] * width + classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, dtype=np.int64)
        for _, far, cell in cells(batches):
            total += np.bincount(cell[~far] if apart else cell, minlength=width * width)
        yield from _count_rows(total.reshape(width, width))

    def count_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, far, cell in cells(batches):
            words, cell, n = _counted(_unpacked(batch.column("far"), np.uint64), cell[far])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(words)), pa.array(cell.astype(np.int32)),
                    pa.array(n.astype(np.int64)),
                ],
                ["word", "cell", "n"],
            )

    pairs = _summed(sequences.mapInArrow(count, _COUNTS), width, width)
    if apart:
        own = assigned.where("number < 0").select(F.col("word").alias("_word"), "class")
        far = sequences.mapInArrow(count_far, "word bigint, cell int, n bigint")
        far = far.groupBy("word", "cell").agg(F.sum("n").alias("n"))
        far = far.join(own, far["word"] == own["_word"], "left").select(
            F.expr(f"coalesce(cell - cell % {width} + class, cell)").alias("cell"), "n"
        )
        found = far.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        pairs.reshape(-1)[found["cell"].to_numpy()] += found["n"].to_numpy()
    return pairs


def train(
    training: DataFrame, *, sweeps: int = SWEEPS, word_sweeps: int = WORD_SWEEPS,
    in_tasks: int | None = None, least_count: int = LEAST_COUNT,
) -> tuple[ClassModel, DataFrame]:
    """The model of the texts of ``training``, and their words (hash) with n and class.

    Every word predicts what follows it by its class. ``in_tasks``, if given, makes a smaller
    model instead: only so many words, the most frequent, do that, others by their ending.
    """
    session = training.sparkSession
    counts = materialize(word_counts(training), "word-counts")
    texts = training.count()
    whole = in_tasks is None
    vocabulary = _vocabulary(counts, texts, IN_TASKS if whole else in_tasks)
    sequences = materialize(number_tokens(training, vocabulary), "token-numbers")
    classes = _exchange_units(sequences, vocabulary, texts, sweeps)
    kinds = np.append(classes, CLASSES)[vocabulary.units_of_numbers()]
    assigned, best = None, None
    pairs = _pairs(sequences, vocabulary, kinds, assigned)
    for sweep in range(word_sweeps):
        best = likelihood(pairs)
        found = materialize(
            _exchange_words(sequences, vocabulary, kinds, pairs, least_count, whole), "word-classes"
        )
        near = found.where("number >= 0").select("number", "class").toArrow()
        new = kinds.copy()
        new[near["number"].to_numpy()] = near["class"].to_numpy()
        moved = sequences
        if not whole:
            new_pairs = _pairs(sequences, vocabulary, new, found)
        elif sweep + 1 < word_sweeps:  # the next one reads it again
            moved = materialize(
                _with_classes(sequences, vocabulary, new, found), "token-classes"
            )
            new_pairs = _pairs(moved, vocabulary, new, None)
        else:
            new_pairs = _pairs_with(sequences, vocabulary, new, found)
        value = likelihood(new_pairs)
        if value > best:
            assigned, kinds, pairs, sequences = found, new, new_pairs, moved
        if value <= best + LEAST_GAIN * vocabulary.tokens:
            break
    transition = pairs + SMOOTHING
    transition = np.log10(transition / transition.sum(axis=1, keepdims=True))
    own = [
        (int(h), int(classes[u]))
        for h, u in zip(signed(vocabulary.hashes), vocabulary.units) if u < OWN_UNITS
    ]
    own = session.createDataFrame(own or [(0, -1)], "word bigint, _own int")
    by_ending = session.createDataFrame(
        [(e, int(c)) for e, c in enumerate(classes[OWN_UNITS:])], "ending int, _ending int"
    )
    words = counts.join(F.broadcast(own), "word", "left").join(F.broadcast(by_ending), "ending")
    if assigned is None:
        words = words.withColumn("_chosen", F.lit(None).cast("int"))
    else:
        words = words.join(assigned.select("word", F.col("class").alias("_chosen")), "word", "left")
    by_exchange = F.coalesce("_own", "_chosen")
    words = materialize(
        words.select(
            "word", "n", F.coalesce(by_exchange, "_ending").alias("class"),
            by_exchange.isNotNull().alias("exchanged"),
        ),
        "classed-words",
    )
    sizes = words.groupBy("class").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"),
        F.sum(F.when(F.col("exchanged"), F.col("n")).otherwise(0)).alias("exchanged"),
    ).collect()
    tokens, types, exchanged = np.zeros(CLASSES), np.zeros(CLASSES), 0
    for row in sizes:
        tokens[row["class"]], types[row["class"]] = row["n"], row["types"]
        exchanged += row["exchanged"]
    return ClassModel(vocabulary, kinds, transition, tokens, types, exchanged, whole), words


_PARTS = (
    "doc_id bigint, block bigint, n_tokens bigint, n_known bigint, base double, score double, "
    "classes binary, far binary"
)
SCORED = (
    "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def _score_parts(model: ClassModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the sums over words that the task knows, the classes of its tokens, and the
    hashes of the other words."""
    vocabulary, block = model.vocabulary, TaskContext.get().partitionId() << 32
    for batch in chunks(batches, "text"):
        texts = batch.num_rows
        words = _tokens(batch)
        counts, numbers = vocabulary.look_up(words)
        kinds = model.kinds[numbers]
        here = counts >= 0
        doc = words.doc[here]
        score = np.bincount(doc, model.emission(counts[here], kinds[here]), texts)
        base = np.bincount(doc, vocabulary.base(counts[here]), texts)
        base = base + vocabulary.base(np.array([vocabulary.ends]))[0]
        known = np.bincount(doc, minlength=texts) + bool(vocabulary.ends)
        classes, _ = _sequence(words, kinds + _FAR * ~here, CLASSES)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(np.full(texts, block)),
                pa.array((words.counts() + 1).astype(np.int64)), pa.array(known.astype(np.int64)),
                pa.array(base), pa.array(score.astype(np.float64)),
                _packed(classes.astype(np.int8), words.counts() + 1),
                _packed(words.hash[~here], np.bincount(words.doc[~here], minlength=texts)),
            ],
            ["doc_id", "block", "n_tokens", "n_known", "base", "score", "classes", "far"],
        )
        block += 1


def _score_block(model: ClassModel, texts: pa.Table, met: pa.Table) -> pa.Table:
    """Scores of texts from these parts, and word, n and class of those words in them that
    have been met in training and that no task knows."""
    vocabulary, batch = model.vocabulary, _as_batch(texts)
    classes = _unpacked(batch.column("classes"), np.int8).astype(np.int64)
    far = np.flatnonzero(classes >= _FAR)
    classes[far] -= _FAR
    context = classes if model.whole else classes.copy()
    counts = np.zeros(len(far), dtype=np.int64)
    found, at = _met(_unpacked(batch.column("far"), np.uint64), met)
    counts[found] = met["n"].to_numpy()[at]
    classes[far[found]] = met["class"].to_numpy()[at]
    owner = np.repeat(np.arange(batch.num_rows), batch.column("n_tokens").to_numpy())
    steps = model.transition[_beside(context)[0], classes]
    steps[far] += model.emission(counts, classes[far])

    def total(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, batch.num_rows)

    return pa.table(
        {
            "doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"),
            "n_known": batch.column("n_known").to_numpy()
            + total(owner[far], counts > 0).astype(np.int64),
            "train_tokens": np.full(batch.num_rows, vocabulary.tokens, dtype=np.int64),
            "base_score": batch.column("base").to_numpy()
            + total(owner[far], vocabulary.base(counts)),
            "score": batch.column("score").to_numpy() + total(owner, steps),
        }
    )


def score_texts(docs: DataFrame, model: ClassModel, words: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between ASCII white space with A-Z lower-cased, and one end. A NULL text
    is empty and has its end only. Both scores are log10 probabilities of the whole text;
    base_score is that under smoothed counts of words. doc_id may be NULL or repeated.
    ``words`` are those that ``train`` returned with the model.
    """
    vocabulary = model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score_parts(shared.value, batches)

    # Stored, as blocks go by tasks.
    parts = materialize(texts.mapInArrow(take_apart, _PARTS), "text-parts")
    # Words that no task knows have a count below ``least``, or none.
    rare = words.where(F.col("n") < vocabulary.least).select("word", "n", "class")
    met = far_words(parts).join(rare, "word").select("block", "word", "n", "class")

    def score(texts: pa.Table, met: pa.Table) -> pa.Table:
        return _score_block(shared.value, texts, met)

    return parts.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(score, SCORED)
