import hashlib
import re
import time

import pytest
from cases import documents, empty, odd, prose, texts

from orebed.llm.fingerprints import (
    LONGEST,
    with_difference,
    with_fingerprint,
    with_next,
)
from orebed.llm.queries import op7_fingerprints, versions

PARAGRAPH = re.compile(rf"[^\n]{{1,{LONGEST}}}(?:[^\n.!?]*[.!?]+)?")


def paragraphs(text):
    return set(PARAGRAPH.findall(text or ""))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, other):
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def test_documents_against_sets(spark, small):
    _, by_id = documents(spark, small)
    order = sorted(by_id, reverse=True)
    rows = {r["doc_id"]: r for r in op7_fingerprints(spark, small).collect()}
    assert set(rows) == set(by_id)
    for doc, after in zip(order, [*order[1:], order[0]]):
        text, other = by_id[doc] or "", by_id[after] or ""
        new = edited(text, other)
        row = rows[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        own = paragraphs(text)
        assert row["n_edited"] == len(own ^ paragraphs(new))
        assert row["near_edited"] == pytest.approx(likeness(own, paragraphs(new)))
        assert row["near_next"] == pytest.approx(likeness(own, paragraphs(other)))


@pytest.mark.parametrize("lines,changed", [(30, 0), (30, 30), (400, 150), (3000, 2500)])
def test_differences_of_any_size_are_recovered(spark, lines, changed):
    old = [f"line {k}" for k in range(lines)]
    new = [f"new {k}" if k < changed else line for k, line in enumerate(old)]
    rows = spark.createDataFrame([("\n".join(old), "\n".join(new))], "a string, b string")
    for name in ("a", "b"):
        rows = with_fingerprint(rows, name, f"{name}_")
    row = with_difference(rows, "a_", "b_", "diff").first()
    assert sorted(d["sign"] for d in row["diff"]) == [-1] * changed + [1] * changed
    signs = {d["digest"]: d["sign"] for d in row["diff"]}
    assert {d for d, s in signs.items() if s == 1} == set(row["a_digests"]) - set(row["b_digests"])
    assert {d for d, s in signs.items() if s == -1} == set(row["b_digests"]) - set(row["a_digests"])
    assert (row["a_fingerprint"] == row["b_fingerprint"]) == (changed == 0)


@pytest.mark.parametrize("bucket_rows", [2, 3, 1000])
def test_the_next_row_wherever_ranges_end(spark, bucket_rows):
    ids = [5, 1, 40, 41, 42, 43, 1000, 1001, 10**12, 7]
    rows = texts(spark, [(i, f"t{i}") for i in ids]).repartition(4)
    found = {r["doc_id"]: r["next_text"] for r in with_next(rows, ["text"], bucket_rows=bucket_rows).collect()}
    order = sorted(ids, reverse=True)
    assert found == {a: f"t{b}" for a, b in zip(order, [*order[1:], order[0]])}


def test_odd_rows(spark):
    docs = odd(spark)
    rows = versions(docs).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["from_next_near"] <= 1 and 0 <= r["from_edited_near"] <= 1
        assert r["edited"] == edited(r["text"], r["next_text"])
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[4]["text"] == "" and by_id[3]["fingerprint"] == by_id[4]["fingerprint"]
    assert by_id[12]["next_text"] == by_id[11]["text"]
    assert by_id[7]["from_next_near"] == 0


def test_one_row_is_its_own_next_and_no_rows_give_none(spark):
    (row,) = versions(texts(spark, [(3, prose(1, 50))])).collect()
    assert row["next_text"] == row["text"] and row["from_next_near"] == 1
    assert versions(empty(spark)).collect() == []


def test_ids_far_apart_and_ids_that_are_no_numbers(spark):
    ids = [-(2**62), 0, 2**62, 2**63 - 1, -(2**63)]
    rows = with_next(texts(spark, [(i, f"t{i}") for i in ids]), ["text"]).collect()
    order = sorted(ids, reverse=True)
    assert {r["doc_id"]: r["next_text"] for r in rows} == {
        a: f"t{b}" for a, b in zip(order, [*order[1:], order[0]])
    }
    with pytest.raises(TypeError, match="whole number, not string"):
        with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"), ["text"])


def test_a_long_line_without_full_stops_takes_time_in_proportion(spark):
    line = "の" * 1_000_100
    rows = with_fingerprint(spark.createDataFrame([(line,)], "a string"), "a", "a_")
    start = time.monotonic()
    assert len(rows.first()["a_digests"]) == 2  # equal pieces, and the last
    assert time.monotonic() - start < 10
