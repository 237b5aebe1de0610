"""Language identification by unigram piece models that sum over all segmentations.

Every language has a probability for each piece of one fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the product of
their probabilities; a forward pass computes it. That of a text is the product over its
words. Probabilities come from expectation maximisation with the same sums, on a bounded
sample of labelled texts.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebed.llm.tokens import vocabulary_path
from orebed.llm.words import LETTERS, chunks, find_words
from orebed.session import materialize

VOCABULARY = "piece_bpe_32k.model"
#: About so many labelled texts of each language are learned from.
SAMPLE = 2_000
EM_ROUNDS = 3
SMOOTHING = 0.1
#: Probability of a character that no piece has, in any language.
UNKNOWN = 1e-6
UNDETERMINED = "und"
#: Words of so many characters are trained on with logarithms, which cannot vanish.
LONG_WORD = 64
_RESCALE = 16
#: A worker's memory is about 100 MB with these, whatever the batches.
_KNOWN_WORDS = 400_000
_CHUNK = 1 << 20


@functools.cache
def piece_numbers(path: str) -> tuple[dict[str, int], int]:
    """Pieces of the vocabulary, lower-case ones only, by text; length of the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    texts = sorted({t for t in texts if t == t.lower()})
    return {text: i for i, text in enumerate(texts)}, max(map(len, texts))


def _steps(words: list[str], end: int, path: str) -> list[tuple[int, np.ndarray]]:
    """(start, piece numbers of all words) of pieces up to ``end``; the words have one length.
    A single character without a piece has the number after the last."""
    numbers, longest = piece_numbers(path)
    get, none = numbers.get, len(numbers) + 1
    steps = []
    for start in range(max(0, end - longest), end):
        missing = none - 1 if end - start == 1 else none
        ids = np.array([get(w[start:end], missing) for w in words])
        if end - start == 1 or (ids < none - 1).any():
            steps.append((start, ids))
    return steps


def _lattice(words: list[str], path: str) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
    """The steps to each end position."""
    for end in range(1, len(words[0]) + 1):
        yield end, _steps(words, end, path)


def _with_fallback(probabilities: np.ndarray) -> np.ndarray:
    """Rows for an unknown character and for no piece, after those of the pieces."""
    extra = np.zeros((2, probabilities.shape[1]))
    extra[0] = UNKNOWN
    return np.concatenate([probabilities, extra])


def log_probabilities(words: list[str], probabilities: np.ndarray, path: str) -> np.ndarray:
    """Natural logarithm of each word's probability in each language (column)."""
    table = _with_fallback(probabilities)
    result = np.zeros((len(words), table.shape[1]))
    by_length = defaultdict(list)
    for i, word in enumerate(words):
        by_length[len(word) + 1].append(i)
    for length, rows in by_length.items():
        marked = ["▁" + words[i] for i in rows]
        forward = {0: np.ones((len(rows), table.shape[1]))}
        scale = np.zeros((len(rows), table.shape[1]))
        _, longest = piece_numbers(path)
        for end, steps in _lattice(marked, path):
            forward[end] = sum(forward[start] * table[ids] for start, ids in steps)
            forward.pop(end - longest, None)
            if end % _RESCALE == 0:
                top = np.maximum.reduce(list(forward.values()))
                forward = {at: value / top for at, value in forward.items()}
                scale += np.log(top)
        result[rows] = np.log(forward[length]) + scale
    return result


def _expected_in_long(
    marked: list[str], counts: np.ndarray, table: np.ndarray, path: str
) -> np.ndarray:
    """As ``expected_pieces``, for words of one length; steps are made twice, not kept."""
    with np.errstate(divide="ignore"):
        logs = np.log(table)
    length, total = len(marked[0]), np.zeros(len(table))
    forward = np.full((length + 1, len(marked)), -np.inf)
    backward = forward.copy()
    forward[0] = backward[length] = 0
    for end, steps in _lattice(marked, path):
        for start, ids in steps:
            forward[end] = np.logaddexp(forward[end], forward[start] + logs[ids])
    for end in range(length, 0, -1):
        for start, ids in _steps(marked, end, path):
            onward = logs[ids] + backward[end]
            backward[start] = np.logaddexp(backward[start], onward)
            share = np.exp(forward[start] + onward - forward[length])
            np.add.at(total, ids, counts * share)
    return total


def expected_pieces(
    words: list[str], counts: np.ndarray, probabilities: np.ndarray, path: str
) -> np.ndarray:
    """How often each piece occurs in the words, in expectation over segmentations."""
    table = _with_fallback(probabilities[:, None])[:, 0]
    total = np.zeros(len(table))
    by_length = defaultdict(list)
    for i, word in enumerate(words):
        by_length[len(word) + 1].append(i)
    for length, rows in by_length.items():
        marked = ["▁" + words[i] for i in rows]
        if length > LONG_WORD:
            total += _expected_in_long(marked, counts[rows], table, path)
            continue
        lattice = list(_lattice(marked, path))
        forward = np.zeros((length + 1, len(rows)))
        backward = np.zeros((length + 1, len(rows)))
        forward[0] = backward[length] = 1
        for end, steps in lattice:
            for start, ids in steps:
                forward[end] += forward[start] * table[ids]
        for end, steps in reversed(lattice):
            for start, ids in steps:
                backward[start] += backward[end] * table[ids]
        share = counts[rows] / forward[length]
        for end, steps in lattice:
            for start, ids in steps:
                total += np.bincount(
                    ids, forward[start] * table[ids] * backward[end] * share, len(table)
                )
    return total[:-2]


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # share of each language
    pieces: np.ndarray  # probability by piece and language
    path: str


def _words_in(found) -> np.ndarray:
    """Which words are not digits only."""
    digit = (found.bytes >= 48) & (found.bytes <= 57)
    digits = np.concatenate([[0], np.cumsum(digit)])
    return digits[found.end] - digits[found.start] < found.end - found.start


def _drawn(rows: DataFrame, texts: dict[str, int], sample: int) -> DataFrame:
    """About ``sample`` of each language's different texts, of which it has as many as
    ``texts`` says, each once."""
    share = F.coalesce(
        *(
            F.when(F.col("lang") == lang, F.lit(min(1.0, sample / count)))
            for lang, count in texts.items()
        )
    )
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2**30)) / 2**30
    return rows.where(draw < share).distinct()


def train(
    labelled: DataFrame, *, sample: int = SAMPLE, rounds: int = EM_ROUNDS,
    vocabulary: str = VOCABULARY,
) -> LanguageModel:
    """A model of the languages in ``lang``, from ``text``. Rows that lack either are left
    out. Of each language about ``sample`` different texts are learned from, chosen by a hash
    of the text, each once however many copies there are; the words of those, long ones too,
    are counted in Spark and only expected counts of pieces, languages times vocabulary, come
    to the driver. Languages are weighted by their rows, copies among them. No rows give a model without languages."""
    path = vocabulary_path(vocabulary)
    rows = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    different = F.approx_count_distinct(F.xxhash64("text"), 0.01)
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), different.alias("texts")).collect()
    sizes = {r["lang"]: r["n"] for r in found}
    languages = sorted(sizes)
    numbers, _ = piece_numbers(path)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((len(numbers), 0)), path)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = find_words(batch.column("text"), LETTERS)
            kept = np.flatnonzero(_words_in(found))
            langs = batch.column("lang").to_pylist()
            counts = Counter(
                (langs[row], found.text(i)) for row, i in zip(found.doc[kept], kept)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in counts], pa.string()),
                    pa.array([k[1] for k in counts], pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["lang", "word", "n"],
            )

    counts = (
        _drawn(rows, {r["lang"]: r["texts"] for r in found}, sample)
        .mapInArrow(count, "lang string, word string, n bigint")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    counts = materialize(counts, "language-words")
    pieces = np.full((len(numbers), len(languages)), 1 / len(numbers))
    for _ in range(rounds):
        current = pieces

        def expect(
            batches: Iterator[pa.RecordBatch], current=current
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang, n = batch.column("lang"), batch.column("n").to_numpy()
                words = batch.column("word").to_pylist()
                for k, name in enumerate(languages):
                    own = np.flatnonzero(pc.equal(lang, name).to_numpy(zero_copy_only=False))
                    expected = expected_pieces(
                        [words[i] for i in own], n[own], current[:, k], path
                    )
                    some = np.flatnonzero(expected > 1e-9)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), k), pa.int32()),
                            pa.array(some, pa.int32()), pa.array(expected[some]),
                        ],
                        ["language", "piece", "n"],
                    )

        found = (
            counts.mapInArrow(expect, "language int, piece int, n double")
            .groupBy("language", "piece").agg(F.sum("n").alias("n")).toArrow()
        )
        totals = np.full((len(numbers), len(languages)), SMOOTHING)
        totals[found["piece"].to_numpy(), found["language"].to_numpy()] += found["n"].to_numpy()
        pieces = totals / totals.sum(axis=0)
    known = np.array([sizes[lang] for lang in languages], dtype=float)
    return LanguageModel(languages, known / known.sum(), pieces, path)


class _Known:
    """Scores of words met by this worker, by hash; begun anew when there are too many."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, len(self.model.languages)))

    def score(self, found, kept: np.ndarray) -> np.ndarray:
        """Log-probability of each word of ``kept``, by language."""
        hashes, first, inverse = np.unique(
            found.hash[kept], return_index=True, return_inverse=True
        )
        at = np.searchsorted(self.hashes, hashes)
        old = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        old[inside] = self.hashes[at[inside]] == hashes[inside]
        scores = np.empty((len(hashes), len(self.model.languages)))
        scores[old] = self.scores[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            words = [found.text(i) for i in kept[first[new]]]
            scores[new] = log_probabilities(words, self.model.pieces, self.model.path)
            if len(self.hashes) + len(new) > _KNOWN_WORDS:
                self.clear()
            joined = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(joined)
            self.hashes = joined[order]
            self.scores = np.concatenate([self.scores, scores[new]])[order]
        return scores[inverse]


_workers: dict[int, _Known] = {}


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score.

    The score is the posterior of the predicted language, evidence taken as if the square
    root of the number of words were independent. A text that is NULL or has no letter is
    ``und`` with score 0, and so is every text under a model without languages. Columns
    lang_pred and score of the input are replaced; no other column but text is read.
    """
    docs = docs.drop("lang_pred", "score")
    added = StructType.fromDDL("lang_pred string, score double")
    schema = StructType([*docs.schema.fields, *added.fields])
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        if id(model) not in _workers:
            _workers.clear()
            _workers[id(model)] = _Known(model)
        known = _workers[id(model)]
        for batch in chunks(batches, "text", _CHUNK):
            texts, count = batch.column("text"), batch.num_rows
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
            letter = letter.to_numpy(zero_copy_only=False)
            best = np.full(count, len(model.languages))
            score = np.zeros(count)
            if model.languages:
                found = find_words(texts, LETTERS)
                kept = np.flatnonzero(_words_in(found))
                doc = found.doc[kept]
                each = known.score(found, kept)
                total = np.stack([np.bincount(doc, w, count) for w in each.T], axis=1)
                words = np.maximum(np.bincount(doc, minlength=count), 1)
                total = total / np.sqrt(words)[:, None] + np.log(model.prior)
                total = np.exp(total - total.max(axis=1, keepdims=True))
                total /= total.sum(axis=1, keepdims=True)
                best = np.where(letter, total.argmax(axis=1), best)
                score = np.where(letter, total.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(score)],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(judge, schema)
