import re
from collections import Counter, defaultdict

import pytest
from cases import documents, empty, odd, prose, texts

from orebed.llm.components import components
from orebed.llm.near_duplicates import keep_one_of_each, near_duplicates, runs_for

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(by_id):
    """(class, links) by all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in by_id.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    parent, links = {d: d for d in sets}, Counter()

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        for e, shared in Counter(e for g in s for e in holders[g] if e > d).items():
            if 5 * shared >= 4 * (len(s) + len(sets[e]) - shared):
                links[d] += 1
                links[e] += 1
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (root(d), links[d]) for d in sets}


def result(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def near_group(first, count, words=120, stem="g"):
    """Texts that differ from a common one in a word each."""
    base = prose(first, words, stem).split()
    rows = []
    for k in range(count):
        own = list(base)
        own[5 + k % (words - 10)] = f"edit{k}"
        rows.append((first + k, " ".join(own)))
    return rows


def test_documents_against_all_pairs(spark, small):
    docs, by_id = documents(spark, small)
    assert result(near_duplicates(docs)) == brute_force(by_id)


@pytest.mark.parametrize("bucket,depth", [(2, 1), (3, 2), (128, 3)])
def test_large_buckets_are_split_or_compared_in_blocks(spark, bucket, depth):
    """One large group of near copies, one common passage, and unrelated texts."""
    passage = prose(7, 60, "common")
    rows = near_group(1000, 40) + near_group(2000, 3, stem="h")
    rows += [(3000 + k, f"{passage} {prose(3000 + k, 70, 'own')}") for k in range(40)]
    rows += [(4000 + k, prose(4000 + k, 50, "alone")) for k in range(20)]
    found = result(near_duplicates(texts(spark, rows), bucket=bucket, depth=depth, block=16))
    assert found == brute_force(dict(rows))


def test_odd_rows(spark):
    rows = near_duplicates(odd(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 1, *range(2, 13), None, None])
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [(by_id[d]["class_id"], by_id[d]["n_links"]) for d in (1, 2)] == [(1, 2), (1, 2)]
    for alone in (3, 4, 5, 6, 7, 11, 12):
        assert (by_id[alone]["class_id"], by_id[alone]["n_links"]) == (alone, 0)
    assert [(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is None] == [(None, 0)] * 2


def test_one_of_each_class_stays(spark):
    docs = odd(spark)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, *range(3, 13), None, None])


def test_classes_without_ids(spark):
    docs = texts(spark, [(None, prose(1, 30)), (None, prose(1, 30)), (None, prose(2, 30))])
    assert sorted(
        (r["class_id"], r["n_links"]) for r in near_duplicates(docs).collect()
    ) == [(None, 0), (None, 1), (None, 1)]
    assert keep_one_of_each(docs).count() == 2


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).collect() == []
    assert keep_one_of_each(empty(spark)).collect() == []


def test_runs_follow_the_recall():
    assert runs_for(0.999, 3) == 15
    assert runs_for(0.9, 1) < runs_for(0.99, 1) < runs_for(0.99, 3)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    edges += [(200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components(df).collect()}
    expected = {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 160)}
    assert found == expected | {200: 200, 201: 200}
    assert components(df.limit(0)).collect() == []
