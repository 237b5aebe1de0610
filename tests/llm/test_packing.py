import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents, empty, odd, texts

from orebed.llm.packing import _best_fit, pack, plan_sequences
from orebed.llm.queries import packed
from orebed.llm.tokens import REFERENCE, VOCABULARY, ids_of, pieces, vocabulary_path


def sequences(rows):
    """Each sequence's pieces by offset, checked to be gapless and within the capacity."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return by_sequence


def reference_pieces(text):
    """By the tokenizers library itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    global _reference
    if "_reference" not in globals():
        _reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [*_reference.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % 2048 or 2048
    cuts = [0, *range(first, len(ids) + 1, 2048)]
    return [(low, ids[low:high]) for low, high in zip(cuts, cuts[1:])]


def expected_rows(by_id):
    rows = set()
    for doc, text in by_id:
        for number, (start, ids) in enumerate(reference_pieces(text)):
            crc = zlib.crc32(np.array(ids, "<u4").tobytes())
            rows.add((doc, number, start, len(ids), crc))
    return rows


def test_documents_against_the_tokenizers_library(spark, small):
    docs, by_id = documents(spark, small)
    rows = packed(docs).collect()
    found = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows}
    assert found == expected_rows(by_id.items()) and len(found) == len(rows)
    used = len(sequences(rows))
    assert used <= -(-sum(r["length"] for r in rows) // 2048) * 1.01 + 1


def test_odd_rows(spark):
    docs = odd(spark)
    rows = packed(docs).collect()
    sequences(rows)
    found = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        for number, (_, ids) in enumerate(reference_pieces(r["text"])):
            expected[r["doc_id"], number, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert found == expected


@pytest.mark.parametrize(
    "text",
    ["<|endoftext|> in text <|endoftext|>", "  \n\n \t x  ", "'ll 'LL don't", "日本語🙂é́", "\x00\x01",
     "1234567 ⅷ²", "a" * 9000, " " * 3000 + "b", " " * 1_000_000 + "b", "\r\n\r\nx y z"],
)
def test_ids_of_both_libraries(text):
    ids = ids_of(text, vocabulary_path(VOCABULARY), vocabulary_path(REFERENCE))
    assert [*ids, 0] == [i for _, part in reference_pieces(text) for i in part]


def test_cut_counts_from_the_end(spark):
    rows = pieces(texts(spark, [(1, "word " * 3000)]), 1000).orderBy("piece").collect()
    assert [r["length"] for r in rows][1:] == [1000] * (len(rows) - 1)
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1].tolist()]
    assert rows[-1]["ids"][-4:] == bytes(4)


def test_empty_table(spark):
    assert packed(empty(spark)).collect() == []


def test_a_length_that_holds_most_rows_is_ranked_in_buckets(spark):
    docs = spark.range(900).selectExpr("id", "CAST(if(id % 3 = 0, 700, 648) AS BIGINT) AS length")
    rows = pack(docs, 2048, bucket_rows=50).collect()
    assert len(rows) == 900
    assert len(sequences(rows)) == 300


def test_a_piece_beyond_the_capacity_is_an_error(spark):
    with pytest.raises(ValueError):
        pack(spark.range(3).selectExpr("id", "CAST(4000 AS BIGINT) AS length"), 2048)


def covered(plan):
    total = Counter()
    for items, copies in plan:
        for length, each in items.items():
            total[length] += each * copies
    return total


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_the_histogram(seed):
    rng = random.Random(seed)
    histogram = {l: rng.randrange(1, 400) for l in rng.sample(range(1, 129), 60)}
    plan = plan_sequences(histogram, 128)
    assert covered(plan) == histogram
    assert all(sum(l * n for l, n in items.items()) <= 128 for items, _ in plan)
    counts = np.zeros(129, dtype=np.int64)
    counts[list(histogram)] = list(histogram.values())
    plain = _best_fit([], counts, 128)
    assert sum(copies for _, copies in plan) <= sum(copies for _, copies in plain)


def test_a_plan_of_one_length_and_of_none():
    assert sum(c for _, c in plan_sequences({50: 7}, 128)) == 4
    assert plan_sequences({}, 128) == []
