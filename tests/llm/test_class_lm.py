import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty, odd, texts

from orebed.llm import class_lm
from orebed.llm.class_lm import CLASSES, exchange, score_texts, train
from orebed.llm.queries import op3_lm_scoring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = None


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def counted(training):
    counts = Counter()
    for text in training:
        counts.update(tokens(text))
    return counts


def base(text, counts):
    whole = sum(counts.values()) + 0.1 * (len(counts) + 1)
    return sum(math.log10((counts[t] + 0.1) / whole) for t in tokens(text))


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 10 == 0


def test_documents_against_plain_counts(spark, small):
    _, by_id = documents(spark, small)
    counts = counted(t for d, t in by_id.items() if not held_out(d))
    rows = op3_lm_scoring(spark, small).collect()
    assert len(rows) == len(by_id)
    model, plain = 0.0, 0.0
    for r in rows:
        words = tokens(by_id[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(counts[w] > 0 for w in words))
        assert r["train_tokens"] == sum(counts.values())
        assert r["held_out"] == held_out(r["doc_id"])
        assert r["base_score"] == pytest.approx(base(by_id[r["doc_id"]], counts))
        if r["held_out"]:
            model, plain = model + r["score"], plain + r["base_score"]
    assert model > plain  # classes predict unseen texts better than counts


def by_hash(found):
    """Class of every training word."""
    return {r["word"]: r["class"] for r in found.collect()}


def reference_score(text, model, counts, classes):
    """Token by token, from the model's tables."""
    import pyarrow as pa

    from orebed.llm.words import NOT_SPACE, find_words, signed

    words = find_words(pa.array([text or ""]), NOT_SPACE, lower="ascii")
    _, numbers = model.vocabulary.look_up(words)
    before, total = CLASSES, 0.0
    for i, (word, number) in enumerate(zip(signed(words.hash), numbers)):
        kind = classes.get(int(word), model.kinds[number])
        total += model.transition[before, kind]
        count = np.array([counts[words.text(i)]])
        total += model.emission(count, np.array([kind]))[0]
        before = model.kinds[number]
    return total + model.transition[before, CLASSES]


def grammar(spark, count):
    """Texts of nouns and verbs in turn."""
    rng = random.Random(4)
    rows = []
    for k in range(count):
        length = rng.randrange(1, 12)
        rows.append((k, " ".join(f"{'noun' if i % 2 else 'verb'}{rng.randrange(300)}{'xyz'[i % 3]}" for i in range(length))))
    return texts(spark, rows), rows


@pytest.mark.parametrize("in_tasks", [0, 40, 1 << 18])
def test_scores_do_not_depend_on_what_tasks_know(spark, in_tasks):
    docs, rows = grammar(spark, 400)
    model, found = train(docs.where("doc_id % 2 = 0"), sweeps=2, in_tasks=in_tasks)
    plain, classes = counted(t for d, t in rows if d % 2 == 0), by_hash(found)
    for r in score_texts(docs, model, found).collect():
        text = rows[r["doc_id"]][1]
        assert r["score"] == pytest.approx(reference_score(text, model, plain, classes))
        assert r["base_score"] == pytest.approx(base(text, plain))
        assert r["n_known"] == sum(plain[w] > 0 for w in tokens(text))


@pytest.mark.parametrize("in_tasks", [40, 1 << 18])
def test_probabilities_sum_to_one(spark, in_tasks):
    docs, rows = grammar(spark, 200)
    model, found = train(docs, sweeps=1, in_tasks=in_tasks)
    assert (10**model.transition).sum(axis=1) == pytest.approx(np.ones(CLASSES + 1))
    counts = counted(t for _, t in rows)
    by_class = Counter()
    import pyarrow as pa

    from orebed.llm.words import NOT_SPACE, find_words, signed

    known = [w for w in counts if w is not END]
    words = find_words(pa.array([" ".join(known)]), NOT_SPACE, lower="ascii")
    classes = by_hash(found)
    for word, number in zip(known, signed(words.hash)):
        kind = classes[int(number)]
        by_class[kind] += 10 ** model.emission(np.array([counts[word]]), np.array([kind]))[0]
    for kind, total in by_class.items():
        unseen = 10 ** model.emission(np.array([0]), np.array([kind]))[0]
        assert total + unseen == pytest.approx(1)


def test_exchange_raises_the_likelihood(spark, monkeypatch):
    """Two kinds of words that follow each other are told apart."""
    monkeypatch.setattr(class_lm, "CLASSES", 2)
    rng = np.random.default_rng(1)
    kinds, units = np.arange(40) % 2, 40
    start = rng.integers(0, 2, units)
    classes = start
    pairs = np.zeros((units, units))
    for _ in range(4000):
        a = rng.integers(0, units)
        b = rng.choice(np.flatnonzero(kinds != kinds[a]))
        pairs[a, b] += 1
    for _ in range(6):
        contexts = np.zeros((2, units, 3))
        for c in (0, 1):
            contexts[0][:, c] = pairs[classes == c].sum(axis=0)
            contexts[1][:, c] = pairs[:, classes == c].sum(axis=1)
        classes = exchange(contexts, classes, 0)
    agree = (classes == kinds).mean()
    assert max(agree, 1 - agree) > 0.9


def plain_pairs(rows, classes, kinds_of):
    """Counts of pairs of classes, token by token."""
    pairs = np.zeros((CLASSES + 1, CLASSES + 1))
    for text in rows:
        before = CLASSES
        for word in kinds_of(text):
            number, own = word
            pairs[before, own] += 1
            before = number
        pairs[before, CLASSES] += 1
    return pairs


@pytest.mark.parametrize("in_tasks", [40, 1 << 18])
def test_words_choose_classes_as_by_plain_counts(spark, monkeypatch, in_tasks):
    """Contexts, choices and pairs of words without a unit of their own, against Python."""
    import pyarrow as pa

    from orebed.llm.words import NOT_SPACE, find_words, signed

    monkeypatch.setattr(class_lm, "OWN_UNITS", 20)
    docs, rows = grammar(spark, 300)
    trained = [t for _, t in rows]
    model, found = train(docs, sweeps=2, word_sweeps=0, in_tasks=in_tasks)
    vocabulary, kinds = model.vocabulary, model.kinds

    def taken_apart(text):
        words = find_words(pa.array([text]), NOT_SPACE, lower="ascii")
        return [int(w) for w in signed(words.hash)], vocabulary.look_up(words)[1]

    def classed(text, classes, kinds):
        words, numbers = taken_apart(text)
        return [(kinds[n], classes.get(w, kinds[n])) for w, n in zip(words, numbers)]

    start = by_hash(found)
    pairs = plain_pairs(trained, start, lambda t: classed(t, {}, kinds))
    near_units = vocabulary.units_of_numbers()
    beside, number_of, count = {}, {}, Counter()
    for text in trained:
        words, numbers = taken_apart(text)
        around = [CLASSES, *(kinds[n] for n in numbers), CLASSES]
        for i, (word, number) in enumerate(zip(words, numbers)):
            if number >= len(vocabulary.hashes) or near_units[number] >= 20:
                beside.setdefault(word, []).append((around[i], around[i + 2]))
                number_of[word] = number if number < len(vocabulary.hashes) else -1
                count[word] += 1
    smoothed = np.log(pairs + 0.1)
    total = np.log(pairs.sum(axis=0)[:CLASSES] + 0.1)
    sequences = class_lm.number_tokens(docs, vocabulary)
    assert class_lm._pairs(sequences, vocabulary, kinds, None) == pytest.approx(pairs)
    assigned = class_lm._exchange_words(sequences, vocabulary, kinds, pairs, 2)
    assigned = spark.createDataFrame(assigned.collect(), assigned.schema)
    chosen = {r["word"]: r for r in assigned.collect()}
    assert set(chosen) == {w for w, n in count.items() if n >= 2} and len(chosen) > 100
    new = kinds.copy()
    for word, r in chosen.items():
        assert r["number"] == number_of[word]
        score = np.zeros(CLASSES)
        for before, after in beside[word]:
            score += smoothed[before, :CLASSES] - total
            if r["number"] >= 0:
                score += smoothed[:CLASSES, after] - total
        assert score[r["class"]] == pytest.approx(score.max())
        if r["number"] >= 0:
            new[r["number"]] = r["class"]
    after = class_lm._pairs(sequences, vocabulary, new, assigned)
    far = {w: r["class"] for w, r in chosen.items() if r["number"] < 0}
    expected = plain_pairs(trained, far, lambda t: classed(t, far, new))
    assert after == pytest.approx(expected)


def test_rare_words_are_classed_by_their_neighbours(spark, monkeypatch):
    """Words of two kinds in turn, whose endings say nothing: unseen orders are predicted
    better once words have chosen their classes, which nearly all tokens have by exchange."""
    monkeypatch.setattr(class_lm, "OWN_UNITS", 60)
    rng = random.Random(9)
    rows = [
        (k, " ".join(f"{'ab'[i % 2]}{int(400 * rng.random() ** 3):03d}" for i in range(20)))
        for k in range(400)
    ]
    docs = texts(spark, rows)
    held, score = docs.where("doc_id % 4 = 0"), {}
    for word_sweeps in (0, 2):
        model, found = train(docs.where("doc_id % 4 <> 0"), word_sweeps=word_sweeps)
        score[word_sweeps] = sum(r["score"] for r in score_texts(held, model, found).collect())
        share = model.exchanged / (model.vocabulary.tokens - model.vocabulary.ends)
        assert share > 0.9 if word_sweeps else share < 0.5
    assert score[2] > score[0] + 0.02 * 2100  # 2,100 tokens, log10


def test_a_unit_that_follows_itself_counts_once(monkeypatch):
    """One sweep moves a unit where the likelihood of all pairs is highest, brute force."""
    monkeypatch.setattr(class_lm, "CLASSES", 3)
    rng = np.random.default_rng(5)
    for _ in range(20):
        units = 7
        bigrams = rng.integers(0, 6, (units, units)) * (rng.random((units, units)) < 0.5)
        bigrams[0] += np.where(np.arange(units) == 0, 40, 0)  # most frequent, so it moves first
        start = rng.integers(0, 3, units)
        contexts, twice = np.zeros((2, units, 4)), np.diag(bigrams).astype(float)
        for c in range(3):
            contexts[0][:, c] = bigrams[start == c].sum(axis=0)
            contexts[1][:, c] = bigrams[:, start == c].sum(axis=1)

        def value(classes):
            # Sums by the tokens that follow something, as the sweep has them.
            pairs = np.zeros((4, 4))
            np.add.at(pairs, (classes[:, None], classes[None, :]), bigrams)
            sizes = np.bincount(classes, contexts[0].sum(axis=1), 3)
            e = class_lm._entropy
            return e(pairs).sum() - 2 * e(sizes).sum()

        first = int(np.argsort(-contexts[0].sum(axis=1), kind="stable")[0])
        tried = [value(np.where(np.arange(units) == first, c, start)) for c in range(3)]
        moved = class_lm.exchange(contexts, start, 0, twice)
        assert tried[moved[first]] == pytest.approx(max(tried))


def test_odd_rows(spark):
    docs = odd(spark)
    model, counts = train(docs)
    rows = score_texts(docs, model, counts).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[d]["n_tokens"] for d in (3, 4, 5, 6)] == [1, 1, 1, 3]
    first, second = (r for r in rows if r["doc_id"] == 1)
    assert first["score"] == pytest.approx(second["score"]) and first["n_tokens"] == 81
    assert sum(r["doc_id"] is None for r in rows) == 2


def test_empty_tables(spark):
    model, counts = train(empty(spark))
    assert score_texts(empty(spark), model, counts).collect() == []
    (row,) = score_texts(texts(spark, [(1, "a b")]), model, counts).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["base_score"] == pytest.approx(0.0) and math.isfinite(row["score"])


def test_the_bound_of_words_in_tasks_changes_no_score(spark, monkeypatch):
    """Words beyond the bound predict what follows them by their own class, too."""
    monkeypatch.setattr(class_lm, "OWN_UNITS", 60)
    rng = random.Random(9)
    rows = [
        (k, " ".join(f"{'ab'[i % 2]}{int(400 * rng.random() ** 3):03d}" for i in range(20)))
        for k in range(400)
    ]
    docs = texts(spark, rows).repartition(3)
    held, scores = docs.where("doc_id % 4 = 0"), {}
    for bound in (0, 200, 1 << 18):
        monkeypatch.setattr(class_lm, "IN_TASKS", bound)
        model, found = train(docs.where("doc_id % 4 <> 0"))
        assert (len(model.vocabulary.hashes) < 250) == (bound < 1000)
        scores[bound] = {r["doc_id"]: tuple(r) for r in score_texts(held, model, found).collect()}
    assert len(scores[0]) == 100
    for bound in (0, 200):
        for doc, row in scores[1 << 18].items():
            assert scores[bound][doc] == pytest.approx(row)


def test_parts_of_words_change_no_score_and_rows_are_few(spark, monkeypatch):
    """Contexts of words meet in parts, packed: many tokens a row, not a row for each."""
    monkeypatch.setattr(class_lm, "OWN_UNITS", 20)
    monkeypatch.setattr(class_lm, "IN_TASKS", 200)
    docs, _ = grammar(spark, 600)
    docs, scores = docs.repartition(2), {}
    for sizes in ((1 << 12, 1 << 22, 1 << 18), (16, 300, 64)):
        for name, size in zip(("PART_WORDS", "PART_TOKENS", "FAR_TOKENS"), sizes):
            monkeypatch.setattr(class_lm, name, size)
        model, found = train(docs, sweeps=1)
        assert model.vocabulary.far > 300
        rows = score_texts(docs, model, found).collect()
        scores[sizes] = {r["doc_id"]: pytest.approx(tuple(r)) for r in rows}
    first, second = scores.values()
    assert len(first) == 600 and all(first[doc] == second[doc].expected for doc in first)
    sequences = class_lm.number_tokens(docs, model.vocabulary)
    contexts = class_lm._word_contexts(sequences, model.vocabulary, model.kinds, 2, 1, 1)
    tokens = model.vocabulary.tokens - model.vocabulary.ends
    assert 0 < contexts.count() < tokens / 50
