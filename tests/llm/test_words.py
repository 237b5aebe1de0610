import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from orebed.llm import words as words_module
from orebed.llm.words import LETTERS, NOT_SPACE, chunks, distinct, find_words, shingles

TEXTS = ["Hello wörld foo", "", None, "foo, hello!", "a b c d e f g a b c d e", "\t ", "x" * 3000]


def test_words_of_a_batch_are_those_of_each_text():
    words = find_words(pa.array(TEXTS), LETTERS)
    per_row = [
        [words.text(i) for i in range(words.first[r], words.first[r + 1])] for r in range(len(TEXTS))
    ]
    assert per_row == [
        ["hello", "wörld", "foo"], [], [], ["foo", "hello"], list("abcdefgabcde"), [], ["x" * 3000]
    ]
    assert [r for r, n in enumerate(words.counts()) for _ in range(n)] == words.doc.tolist()


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "ba", "é", "abab", "a"]) for _ in range(50)) for _ in range(9)]
    words = find_words(pa.array(texts), NOT_SPACE, lower="ascii")
    by_hash = {}
    for i in range(len(words.hash)):
        assert by_hash.setdefault(int(words.hash[i]), words.text(i)) == words.text(i)
    assert len(by_hash) == 5


def test_only_ascii_letters_are_lowered_on_demand():
    words = find_words(pa.array(["ÉA Éa"]), NOT_SPACE, lower="ascii")
    assert [words.text(0), words.text(1)] == ["Éa", "Éa"]


def test_words_end_where_a_text_ends():
    words = find_words(pa.array(["ab", "cd"]), LETTERS)
    assert [words.text(0), words.text(1)] == ["ab", "cd"]


@pytest.mark.parametrize("width", [2, 5])
def test_shingles_against_tuples(width):
    rng = random.Random(width)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, width - 1, width, 30, 31)]
    doc, hashes = distinct(*shingles(find_words(pa.array(texts), LETTERS), width))
    for row, text in enumerate(texts):
        w = text.split()
        expected = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        assert (doc == row).sum() == len(expected)
    other = {}
    for row, text in enumerate(texts[3:], 3):
        other[row] = set(hashes[doc == row].tolist())
    w4, w5 = texts[4].split(), texts[5].split()
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (w4, w5)]
    assert len(other[4] & other[5]) == len(sets[0] & sets[1])


def test_chunks_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 40, None, "b" * 200, "", "c"])], ["text"])
    parts = list(chunks(iter([batch, batch.slice(0, 0)]), "text", 50))
    assert len(parts) > 1
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_a_slice_of_a_batch_is_read_from_its_own_start():
    whole = pa.array(["aa bb", "cc dd", "ee"])
    words = find_words(whole.slice(1, 2), LETTERS)
    assert [words.text(i) for i in range(3)] == ["cc", "dd", "ee"]
    assert np.array_equal(words.doc, [0, 0, 1])


def test_hashes_do_not_depend_on_windows(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("ab" * rng.randrange(1, 30) for _ in range(rng.randrange(40))) for _ in range(20)]
    whole = find_words(pa.array([*texts, None, "c" * 500]), NOT_SPACE)
    for size in (1, 7, 64):
        monkeypatch.setattr(words_module, "_WINDOW_BYTES", size)
        parts = find_words(pa.array([*texts, None, "c" * 500]), NOT_SPACE)
        assert (parts.hash == whole.hash).all() and (parts.first == whole.first).all()


def test_a_large_chunk_of_text_takes_little_memory():
    """Three tasks of an executor take texts apart at the same time."""
    text = pa.array([" ".join(f"word{i % 9999}" for i in range(450_000))])
    size = len(text[0].as_py())
    find_words(text.slice(0, 0), NOT_SPACE, lower="ascii")
    tracemalloc.start()
    try:
        find_words(text, NOT_SPACE, lower="ascii")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size > 3_500_000 and peak < 20 * size
