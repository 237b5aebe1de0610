"""Quality by a generalised additive model with pairwise interactions.

A text has a few measures of its form. Each measure, cut into bins, has a table of values that
are added up; so has each of a few pairs of measures. The tables come from cyclic boosting:
round after round, every measure in turn gets the values of one shallow tree over its own bins,
fitted to what all others leave unexplained; pairs follow in the same way, chosen by what one
cut along each of both measures would gain. Scoring looks bins up and adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orebed.llm.words import NOT_SPACE, Words, chunks, distinct, find_words, text_bytes

#: Most labelled rows that a model is fitted on, drawn by a hash of id and text.
SAMPLE = 20_000
#: Share of the sample that is not fitted on but says when to stop.
ASIDE = 0.2
BINS = 32
PAIRS = 10
ROUNDS, PATIENCE, RATE, PENALTY = 300, 20, 0.15, 1.0
CHUNK_BYTES = 1 << 20

NAMES = (
    "words", "word_length", "longest_word", "symbols", "punctuation", "digits", "capitals",
    "beyond_ascii", "line_length", "repeated_lines", "open_lines", "distinct_words",
    "commonest_word", "doubled_words", "distinct_pairs", "marked_words", "single_letters",
    "sentence_length",
)


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return table


_IN_LINES = ~_table("\n\r")
_SYMBOLS = _table("#$%&*+/<=>@\\^_`|~{}[]")
_PUNCTUATION = _table(".,;:!?'\"()-")
_STOPS = _table(".!?")
_DIGITS = _table("0123456789")
_CAPITALS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_BEYOND = np.arange(256) >= 0xC0


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[at[1:]] - sums[at[:-1]]).astype(float)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _sum(words: Words, values: np.ndarray) -> np.ndarray:
    return np.bincount(words.doc, values, len(words.first) - 1)


def _most(words: Words, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words.first) - 1)
    np.maximum.at(out, doc, values)
    return out


def measures(texts: pa.Array) -> np.ndarray:
    """One row per text, one column for each of ``NAMES``. A null counts as an empty text, for
    which all are zero."""
    data, at = text_bytes(texts)
    size = np.diff(at).astype(float)
    words = find_words(texts, NOT_SPACE, lower="none")
    lines = find_words(texts, _IN_LINES, lower="none")
    n = words.counts().astype(float)
    n_lines = lines.counts().astype(float)
    length = (words.end - words.start).astype(float)
    line_length = (lines.end - lines.start).astype(float)
    doc, _ = distinct(lines.doc, lines.hash)
    own_lines = np.bincount(doc, minlength=len(size))
    open_lines = ~_STOPS[lines.bytes[lines.end - 1]] if len(lines.end) else np.zeros(0, bool)

    order = np.lexsort((words.hash, words.doc))
    doc, hashes = words.doc[order], words.hash[order]
    edge = np.ones(len(doc) + 1, dtype=bool)
    edge[1:-1] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(edge)
    kinds, counts = doc[starts[:-1]], np.diff(starts).astype(float)
    own_words = np.bincount(kinds, minlength=len(size)).astype(float)
    commonest = _most(words, kinds, counts)

    together = words.doc[1:] == words.doc[:-1]
    doubled = np.bincount(
        words.doc[1:][together & (words.hash[1:] == words.hash[:-1])], minlength=len(size)
    )
    mixed = words.hash[1:][together] * np.uint64(3) + words.hash[:-1][together]
    doc, _ = distinct(words.doc[1:][together], mixed)
    own_pairs = np.bincount(doc, minlength=len(size)).astype(float)

    marked = _SYMBOLS[words.bytes[words.end - 1]] if len(words.end) else np.zeros(0, bool)
    stops = _per_text(_STOPS[data], at)
    columns = (
        np.log1p(n), _share(_sum(words, length), n), np.log1p(_most(words, words.doc, length)),
        _share(_per_text(_SYMBOLS[data], at), size),
        _share(_per_text(_PUNCTUATION[data], at), size),
        _share(_per_text(_DIGITS[data], at), size),
        _share(_per_text(_CAPITALS[data], at), size),
        _share(_per_text(_BEYOND[data], at), size),
        np.log1p(_share(_sum(lines, line_length), n_lines)),
        _share(n_lines - own_lines, n_lines), _share(_sum(lines, open_lines.astype(float)), n_lines),
        _share(own_words, n), _share(commonest, n), _share(doubled, n),
        _share(own_pairs, np.maximum(n - 1, 0)), _share(_sum(words, marked.astype(float)), n),
        _share(_sum(words, (length == 1).astype(float)), n), np.log1p(_share(n, stops)),
    )
    return np.stack(columns, axis=1)


@dataclass
class QualityModel:
    """``edges`` of the bins of each measure; a table of each; pairs of measures with theirs."""

    edges: list[np.ndarray]
    start: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]
        return np.stack(columns, axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.start)
        for i, table in enumerate(self.tables):
            total += table[bins[:, i]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[bins[:, i], bins[:, j]]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _chance(self.margin(self.bins(x)))


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    if not len(y):
        return 0.0
    return float((np.logaddexp(0, margin) - y * margin).mean())


def _cut(g: np.ndarray, w: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_w = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
    all_g, all_w = g.sum(), w.sum()
    gain = (
        left_g**2 / (left_w + PENALTY) + (all_g - left_g) ** 2 / (all_w - left_w + PENALTY)
        - all_g**2 / (all_w + PENALTY)
    )
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The step of every bin: a tree of depth two over bins in order."""
    step = np.zeros(len(g))
    gain, at = _cut(g, w)
    parts = [(0, at), (at, len(g))] if gain > 0 else [(0, len(g))]
    for low, high in parts:
        gain, at = _cut(g[low:high], w[low:high])
        ends = [low, low + at, high] if gain > 0 else [low, high]
        for a, b in zip(ends, ends[1:]):
            step[a:b] = g[a:b].sum() / (w[a:b].sum() + PENALTY)
    return step


def _quadrants(g: np.ndarray, w: np.ndarray) -> tuple[float, int, int, np.ndarray]:
    """(gain, cut, cut, values) of the best pair of cuts, one along each axis."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cw = np.pad(w.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def parts(c: np.ndarray) -> np.ndarray:
        inner, right, below, whole = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return np.stack([inner, right - inner, below - inner, whole - right - below + inner])

    if g.shape[0] < 2 or g.shape[1] < 2:
        return 0.0, 0, 0, np.zeros(4)
    pg, pw = parts(cg), parts(cw)
    gain = (pg**2 / (pw + PENALTY)).sum(axis=0) - cg[-1, -1] ** 2 / (cw[-1, -1] + PENALTY)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[i, j]), int(i) + 1, int(j) + 1, pg[:, i, j] / (pw[:, i, j] + PENALTY)


def _edges(x: np.ndarray) -> list[np.ndarray]:
    if not len(x):
        return [np.zeros(0) for _ in NAMES]
    levels = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(x[:, i], levels)) for i in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> QualityModel:
    """Fit on rows that are not ``aside``; those say how many rounds. Without rows the model
    says one half, with one class only nearly that class."""
    model = QualityModel(_edges(x[~aside]))
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model.start = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or share in (1e-3, 1 - 1e-3):
        return model
    bins = model.bins(x)
    learn, held, y_learn = bins[~aside], bins[aside], y[~aside]
    margin = model.margin(learn)
    held_margin = model.margin(held)

    def rounds(tables: list[np.ndarray], step) -> None:
        """Cyclic rounds over ``tables``, back to the best round of those aside."""
        best, best_tables, since = _loss(held_margin, y[aside]), [t.copy() for t in tables], 0
        for _ in range(ROUNDS):
            for k in range(len(tables)):
                step(k)
            loss = _loss(held_margin, y[aside])
            if loss < best - 1e-5 or not aside.any():
                best, best_tables, since = loss, [t.copy() for t in tables], 0
            elif (since := since + 1) >= PATIENCE:
                break
        for k, table in enumerate(best_tables):
            tables[k][...] = table

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        chance = _chance(margin)
        return y_learn - chance, chance * (1 - chance)

    def one(k: int) -> None:
        g, w = gradients()
        size = len(model.tables[k])
        step = RATE * shallow_tree(
            np.bincount(learn[:, k], g, size), np.bincount(learn[:, k], w, size)
        )
        model.tables[k] += step
        margin[...] += step[learn[:, k]]
        held_margin[...] += step[held[:, k]]

    rounds(model.tables, one)
    margin[...], held_margin[...] = model.margin(learn), model.margin(held)

    g, w = gradients()

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        rows, columns = len(model.tables[i]), len(model.tables[j])
        at = learn[:, i] * columns + learn[:, j]
        return np.bincount(at, values, rows * columns).reshape(rows, columns)

    gains = [
        (_quadrants(grid(i, j, g), grid(i, j, w))[0], i, j)
        for i, j in combinations(range(len(model.tables)), 2)
    ]
    model.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [
        np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs
    ]

    def two(k: int) -> None:
        i, j = model.pairs[k]
        g, w = gradients()
        gain, a, b, values = _quadrants(grid(i, j, g), grid(i, j, w))
        if gain <= 0:
            return
        step = np.zeros_like(model.pair_tables[k])
        step[:a, :b], step[:a, b:], step[a:, :b], step[a:, b:] = RATE * values
        model.pair_tables[k] += step
        margin[...] += step[learn[:, i], learn[:, j]]
        held_margin[...] += step[held[:, i], held[:, j]]

    rounds(model.pair_tables, two)
    # Values of a measure are those beside its own average; the averages go to the start.
    for k, table in enumerate(model.tables):
        mean = float(table[learn[:, k]].mean())
        table -= mean
        model.start += mean
    return model


def _one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, label) where all labels of an id agree."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    least, most = F.min("label").alias("label"), F.max("label").alias("most")
    agreed = known.groupBy("doc_id").agg(least, most).where("label = most")
    return agreed.select(F.col("doc_id").alias("l_id"), "label")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` labelled texts. ``docs`` has doc_id and text, ``labels`` has
    doc_id and label (0 or 1; others are not used, nor ids whose labels differ)."""
    drawn = _one_label(labels).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    # At most ``sample`` ids and labels.
    known = docs.select("doc_id", "text").join(
        F.broadcast(drawn), F.col("doc_id") == F.col("l_id")
    )
    # An id may have many rows, so the bound is held again, on measures instead of texts;
    # equal texts of an id count once.
    place = F.xxhash64("doc_id", "text").alias("place")
    rows = known.dropDuplicates(["doc_id", "text"]).select(
        place, F.col("label").cast("int").alias("label"), "text"
    )
    names = ["place", "label", *NAMES]
    schema = "place bigint, label int, " + ", ".join(f"{n} double" for n in NAMES)
    measured = rows.mapInArrow(_measured(names), schema)
    found = measured.orderBy("place").limit(sample).toArrow()
    x = np.stack([found.column(n).to_numpy() for n in NAMES], axis=1)
    order = np.argsort(found.column("place").to_numpy(), kind="stable")
    y = found.column("label").to_numpy().astype(float)[order]
    aside = np.arange(len(y)) % round(1 / ASIDE) == 0
    return fit(x[order], y, aside if len(y) >= 50 else np.zeros(len(y), bool))


def _measured(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            found = dict(zip(NAMES, map(pa.array, measures(batch.column("text")).T)))
            columns = [found[n] if n in found else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score``: how likely the text has label 1, from 0 to 1.

    Whole texts are measured; a NULL text counts as an empty one, equal texts score alike, and a
    column ``score`` that is there already is replaced."""
    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            scores = model.probability(measures(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(scores)],
                names=[*names, "score"],
            )

    return kept.mapInArrow(run, schema)


def at_least(threshold: float) -> Column:
    return F.when(F.col("score") >= threshold, 1).otherwise(0)
