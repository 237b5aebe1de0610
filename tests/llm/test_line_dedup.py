import random
from collections import Counter

import pytest
from cases import documents, empty, odd, prose, texts

from orebed.llm import line_dedup
from orebed.llm.line_dedup import CHUNK_WORDS, LONG_LINE, parts_of, remove_shared_passages


def cleaned(df):
    return {r["doc_id"]: r for r in remove_shared_passages(df).collect()}


def test_documents_against_a_search_for_long_lines(spark, small):
    docs, by_id = documents(spark, small)
    found, first, holders = cleaned(docs), {}, Counter()
    for doc in sorted(by_id):
        for line in by_id[doc].split("\n"):
            first.setdefault(line, doc)
        holders.update(set(by_id[doc].split("\n")))
    for doc, text in by_id.items():
        lines, gone = text.split("\n"), set(found[doc]["removed"])
        for i, line in enumerate(lines):
            if len(line.split()) >= LONG_LINE:
                assert (i in gone) == (first[line] < doc)
            elif i in gone:
                assert first[line] < doc
        kept = [line for i, line in enumerate(lines) if i not in gone]
        assert found[doc]["text"] == "\n".join(kept)
        if all(holders[line] == 1 for line in lines):
            assert found[doc]["text"] == text


@pytest.mark.parametrize("lines,words", [(9, 14), (2, 27), (3, 20), (6, 9)])
def test_a_passage_of_short_lines_is_found_wherever_it_stands(spark, lines, words):
    passage = [prose(500 + k, words, "p") for k in range(lines)]
    rows = []
    for k in range(6):
        before = [prose(1000 * k + j, 12, "before") for j in range(k)]
        after = [prose(1000 * k + 50 + j, 12, "after") for j in range(3)]
        rows.append((k, "\n".join([*before, *passage, *after])))
    found = cleaned(texts(spark, rows))
    assert found[0]["removed"] == []
    for k in range(1, 6):
        assert found[k]["removed"] == list(range(k, k + lines))


@pytest.mark.parametrize("lines,words", [(2, 40), (3, 20), (4, 15), (60, 1)])
def test_a_passage_whose_lines_have_different_first_documents(spark, lines, words):
    """An earlier document quotes half of each passage, so its lines differ in their first one."""
    rows, where = [], {}
    for k in range(30):
        passage = [prose(70_000 + 100 * k + j, words, f"p{k}x{j}x") for j in range(lines)]
        around = [prose(90_000 + 10 * k + j, 12, "around") for j in range(6)]
        quote = [around[0], *passage[: (lines + 1) // 2], around[1]]
        rows.append((k, "\n".join(quote)))
        rows.append((100 + k, "\n".join([around[2], *passage, around[3]])))
        rows.append((200 + k, "\n".join([around[4], *passage, around[5]])))
        where[200 + k] = list(range(1, lines + 1))
    found = cleaned(texts(spark, rows))
    assert {doc: found[doc]["removed"] for doc in where} == where


def test_windows_against_all_runs_of_lines(spark):
    """Every line of a run of 50 words that stands in an earlier document goes."""
    rng = random.Random(3)
    pool = [prose(k, rng.choice([4, 9, 14, 26, 60]), f"l{k}x") for k in range(25)] + ["", " "]
    docs = []
    for _ in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 8))]
        if docs and rng.random() < 0.7:
            other = rng.choice(docs)
            low = rng.randrange(len(other))
            lines += other[low : low + rng.randrange(1, 9)] + [rng.choice(pool)]
        docs.append(lines)
    found = cleaned(texts(spark, [(k, "\n".join(lines)) for k, lines in enumerate(docs)]))
    runs, checked = set(), 0
    for k, lines in enumerate(docs):
        mine = [
            (a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)
            if sum(len(x.split()) for x in lines[a:b]) >= LONG_LINE
        ]
        for a, b in mine:
            if tuple(lines[a:b]) in runs:
                spoken = {i for i in range(a, b) if lines[i].split()}
                assert spoken <= set(found[k]["removed"])
                checked += b - a > 1
        runs.update(tuple(lines[a:b]) for a, b in mine)
    assert checked > 50


def test_short_repeated_lines_alone_stay(spark):
    line = "please read the terms of use"
    rows = [(k, f"{prose(k, 20)}\n{line}\n{prose(k + 100, 20)}") for k in range(5)]
    assert all(r["removed"] == [] for r in cleaned(texts(spark, rows)).values())


def test_boundaries_do_not_depend_on_what_comes_before():
    lines = [prose(k, 15).encode() for k in range(40)]
    def multi(p):
        return {h for _, n, _, h in p if n > 1}

    whole, shifted = multi(parts_of(lines)), multi(parts_of([b"x y z", b"q", *lines]))
    assert len(whole & shifted) >= 0.8 * len(whole)
    assert all(w >= CHUNK_WORDS for _, n, w, _ in parts_of(lines) if n > 1)


def test_odd_rows(spark):
    docs = odd(spark)
    rows = remove_shared_passages(docs).collect()
    assert len(rows) == docs.count()
    first = {r["doc_id"]: r for r in rows}
    before = {r["doc_id"]: r for r in docs.collect()}
    assert first[2]["text"] == "" and first[2]["removed"] == [0]
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [before[1]["text"]] * 2
    assert first[3]["text"] is None and first[3]["n_lines"] == 0
    assert first[4]["text"] == "" and first[5]["text"] == before[5]["text"]
    assert first[8]["removed"] == [] and first[9]["removed"] == [1]
    assert first[12]["text"] == "ends with newline\n"
    assert first[9]["score"] == "clash" and first[9]["node"] == 9


def test_rows_without_an_id_are_one_document_after_the_others(spark):
    line = prose(1, 60)
    rows = remove_shared_passages(texts(spark, [(None, line), (None, line + "\nx"), (7, line)])).collect()
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"]} == {7: line}
    assert sorted(r["text"] for r in rows if r["doc_id"] is None) == ["", "x"]


def test_empty_table(spark):
    assert remove_shared_passages(empty(spark)).collect() == []


def test_what_shares_a_hash_only_is_put_back(spark, monkeypatch):
    """With a hash of one value for all long lines, bytes alone tell them apart. The tasks run
    ``parts_of`` with the weak hash in place of the library's."""
    same, weak = prose(1, 60), b"\x01" * 16
    rows = [(1, same), (2, prose(2, 60)), (3, same), (4, prose(4, 60))]

    def find(batches):
        for batch in batches:
            import pyarrow as pa

            parts = [[(i, 1, len(x.split()), weak) for i, x in enumerate(t.encode().split(b"\n"))]
                     for t in batch.column("text").to_pylist()]
            at = pa.array([r for r, p in enumerate(parts) for _ in p], pa.int64())
            flat = [x for p in parts for x in p]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc").take(at), batch.column("_text").take(at),
                 *(pa.array([x[k] for x in flat], pa.int32()) for k in range(3)),
                 pa.array([x[3] for x in flat], pa.binary())],
                ["_doc", "_text", "start", "lines", "words", "hash"],
            )

    monkeypatch.setattr(line_dedup, "_find_parts", find)
    found = cleaned(texts(spark, rows))
    assert {d: r["text"] for d, r in found.items()} == {**dict(rows), 3: ""}


@pytest.mark.parametrize("count", [0, 1, 2])
def test_parts_of_few_lines(count):
    lines = [prose(k, LONG_LINE).encode() for k in range(count)] or [b""]
    assert [(s, n) for s, n, _, _ in parts_of(lines)] == [(k, 1) for k in range(count)]
