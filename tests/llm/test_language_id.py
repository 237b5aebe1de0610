import math

import numpy as np
import pytest
from cases import documents, empty, odd, prose

from orebed.llm.language_id import (
    UNKNOWN,
    LanguageModel,
    expected_pieces,
    log_probabilities,
    piece_numbers,
    predict,
    train,
)
from orebed.llm.queries import language_model, op5_language_id
from orebed.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")


def probability(word, table):
    """By recursion over the first piece."""
    numbers, _ = piece_numbers(PATH)
    if not word:
        return 1.0
    total = 0.0
    for end in range(1, len(word) + 1):
        piece = word[:end]
        if piece in numbers:
            total += table[numbers[piece]] * probability(word[end:], table)
        elif end == 1:
            total += UNKNOWN * probability(word[end:], table)
    return total


@pytest.fixture(scope="module")
def tables():
    numbers, _ = piece_numbers(PATH)
    table = np.random.default_rng(1).random((len(numbers), 2))
    return table / table.sum(axis=0)


def test_words_against_all_segmentations(tables):
    words = ["the", "house", "éa", "日x", "aaaa", "q"]
    found = log_probabilities(words, tables, PATH)
    for i, word in enumerate(words):
        for k in range(2):
            assert found[i, k] == pytest.approx(math.log(probability("▁" + word, tables[:, k])))


def test_very_long_words_do_not_vanish(tables):
    found = log_probabilities(["ab" * 4000, "ab" * 2000], tables, PATH)
    assert np.isfinite(found).all()
    assert found[0, 0] == pytest.approx(2 * found[1, 0], rel=0.01)


def test_expected_pieces_cover_the_characters(tables):
    numbers, _ = piece_numbers(PATH)
    words, counts = ["house", "there", "on"], np.array([3, 1, 2])
    expected = expected_pieces(words, counts, tables[:, 0], PATH)
    length = np.zeros(len(numbers))
    for piece, number in numbers.items():
        length[number] = len(piece)
    assert (expected * length).sum() == pytest.approx(sum((len(w) + 1) * n for w, n in zip(words, counts)))


@pytest.mark.parametrize("size", [31, 32, 100, 3000])
def test_long_words_are_learned_from(tables, size):
    numbers, _ = piece_numbers(PATH)
    words, counts = ["ab" * size, "ba" * size, "on"], np.array([3, 1, 2])
    expected = expected_pieces(words, counts, tables[:, 0], PATH)
    length = np.zeros(len(numbers))
    for piece, number in numbers.items():
        length[number] = len(piece)
    assert (expected * length).sum() == pytest.approx(sum((len(w) + 1) * n for w, n in zip(words, counts)))


def test_long_and_short_words_have_the_same_sums(tables, monkeypatch):
    words, counts = ["house", "there", "日本", "aaaa"], np.array([3, 1, 2, 5])
    plain = expected_pieces(words, counts, tables[:, 0], PATH)
    monkeypatch.setattr("orebed.llm.language_id.LONG_WORD", 0)
    assert expected_pieces(words, counts, tables[:, 0], PATH) == pytest.approx(plain)


def labelled(spark, rows):
    return spark.createDataFrame([("en", text) for text in rows], "lang string, text string")


def test_copies_of_a_text_count_once(spark):
    rows = ["the house stands there", "a river runs", "on and on"]
    once, often = train(labelled(spark, rows)), train(labelled(spark, rows + rows[:1] * 40))
    assert often.pieces == pytest.approx(once.pieces)


@pytest.mark.parametrize("copied", range(8))
def test_copies_leave_the_size_of_the_sample(spark, monkeypatch, copied):
    """A third of the rows are one text, whether it is drawn or not."""
    from orebed.llm import language_id

    read = []
    own = language_id._drawn

    def drawn(rows, texts, sample):
        read.append(own(rows, texts, sample).count())
        return own(rows, texts, sample)

    monkeypatch.setattr(language_id, "_drawn", drawn)
    rows = [prose(k, 5) for k in range(1200)]
    train(labelled(spark, rows + [f"copy {copied}"] * 600), sample=300, rounds=0)
    assert 240 <= read[0] <= 360


def test_held_out_documents(spark, small):
    docs, _ = documents(spark, small)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = op5_language_id(spark, small).collect()
    assert len(rows) == len(truth)
    held_out = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held_out)
    assert right >= 0.97 * len(held_out) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_documents_are_not_used(spark, small):
    docs, _ = documents(spark, small)
    changed = docs.selectExpr(
        "doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang) AS lang"
    )
    assert "xx" not in language_model(changed).languages


def test_odd_rows(spark):
    docs = odd(spark)
    rows = predict(docs, train(docs)).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for doc in (3, 4, 5, 11):
        assert (by_id[doc]["lang_pred"], by_id[doc]["score"]) == ("und", 0.0)
    assert by_id[1]["lang_pred"] in ("en", "fr", "de")
    assert by_id[10]["n_chars"] == len(by_id[10]["text"])


def test_without_labels_or_rows(spark):
    docs = odd(spark)
    unlabelled = docs.withColumn("lang", docs["lang"].substr(100, 1)).where("lang = 'zz'")
    model = train(unlabelled)
    assert isinstance(model, LanguageModel) and model.languages == []
    assert {r["lang_pred"] for r in predict(docs, model).collect()} == {"und"}
    assert predict(empty(spark), model).collect() == []
