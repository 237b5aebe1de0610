from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import empty, odd, odd_rows

from orebed.llm.quality_gam import NAMES, fit, measures, score, shallow_tree, train
from orebed.llm.queries import op12_quality

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS, MARKS, STOPS = "#$%&*+/<=>@\\^_`|~{}[]", ".,;:!?'\"()-", ".!?"


def words_of(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(text):
    text = text or ""
    data, words = text.encode(), words_of(text)
    lines = [x for part in text.split("\n") for x in part.split("\r") if x]
    share = lambda part, whole: part / max(whole, 1)
    size, n = len(data), len(words)
    among = lambda kinds: share(sum(text.count(c) for c in kinds), size)
    lengths = [len(w.encode()) for w in words]
    return [
        np.log1p(n), share(sum(lengths), n), np.log1p(max(lengths, default=0)),
        among(SYMBOLS), among(MARKS), among("0123456789"), among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        share(sum(b >= 0xC0 for b in data), size),
        np.log1p(share(sum(len(x.encode()) for x in lines), len(lines))),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(x[-1] not in STOPS for x in lines), len(lines)),
        share(len(set(words)), n), share(max(Counter(words).values(), default=0), n),
        share(sum(a == b for a, b in zip(words, words[1:])), n),
        share(len(set(zip(words, words[1:]))), max(n - 1, 0)),
        share(sum(w[-1] in SYMBOLS for w in words), n), share(sum(x == 1 for x in lengths), n),
        np.log1p(share(n, sum(text.count(c) for c in STOPS))),
    ]


def test_measures_against_plain_python():
    texts = [r[1] for r in odd_rows()] + ["a a a b\nA|# b&\r\nA|# b&", "\n\n", " ", "Ü ß? 12"]
    found = measures(pa.array(texts, pa.string()))
    assert found.shape == (len(texts), len(NAMES))
    for text, row in zip(texts, found):
        assert row == pytest.approx(plain(text), abs=1e-12), text
    assert measures(pa.array([], pa.string())).shape == (0, len(NAMES))


def test_tree_has_the_best_two_cuts():
    g = np.array([1.0, 1, -1, -1, 5, 5, 0, 0])
    step = shallow_tree(g, np.ones(8))
    assert len(set(step)) == 4 and step[4] == step[5] == 10 / 3


def test_pairs_learn_what_single_measures_cannot():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(NAMES)))
    y = ((x[:, 2] > 0) ^ (x[:, 5] > 0)).astype(float)
    model = fit(x[:3000], y[:3000], np.arange(3000) % 5 == 0)
    right = ((model.probability(x[3000:]) >= 0.5) == y[3000:]).mean()
    assert (2, 5) in model.pairs and right > 0.95
    alone = type(model)(model.edges, model.start, model.tables)
    assert ((alone.probability(x[3000:]) >= 0.5) == y[3000:]).mean() < 0.65
    # The score is a sum of table values by bin, nothing else.
    bins = model.bins(x[:5])
    for row, margin in zip(bins, model.margin(bins)):
        parts = [t[row[k]] for k, t in enumerate(model.tables)]
        parts += [t[row[i], row[j]] for (i, j), t in zip(model.pairs, model.pair_tables)]
        assert margin == pytest.approx(model.start + sum(parts))


def test_odd_documents_and_labels(spark):
    docs = odd(spark)
    labels = [(1, 1), (1, 1), (2, 0), (3, 1), (3, 0), (4, None), (None, 1), (5, 7), (6, 1), (7, 0)]
    frame = spark.createDataFrame(labels, "doc_id bigint, label int")
    rows = score(docs, train(docs, frame)).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r["score"] for r in score(docs, train(docs, none)).collect()} == {0.5}
    assert score(empty(spark), train(empty(spark), frame)).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}.") for i in range(500)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id bigint, label int")
    model = train(docs, labels, sample=5)
    assert sum(len(e) + 1 for e in model.edges) <= 5 * len(NAMES)


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op12_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for q, s, _ in held if q], [s for q, s, _ in held if not q]
    ranks = np.argsort(np.argsort(good + bad))[: len(good)]
    area = (ranks.sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))
    right = np.mean([q == p for q, _, p in held])
    print("area", area, "right", right, "of", len(held), "bad", len(bad))
    assert area > 0.9 and right > 0.9
