import hashlib
import random
import re
import time

import numpy as np
import pytest
from cases import documents, empty, odd, prose, texts

from orebed.llm.boosting import fit, fit_table
from orebed.llm.pii import (
    KINDS, PiiModel, _calibrated, _Covered, base_spans, candidates, find_pii, labelled_candidates, luhn,
    proposed_spans, redact, train,
)
from orebed.llm.queries import op8_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def digits(m):
        return re.sub(r"[^0-9]", "", m[0])

    found = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_against_plain_searches(seed):
    rng = random.Random(seed)
    parts = ["@", ".", "a", "b.c", "-", "+", "1", "25", "255", "256", "4111111111111111", " ", "(", ")", "é",
             "@x.y", "+1 (243) 555-7962", "1.2.3.4", "000", "\n", "_", "%"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_no_quadratic_time():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" + "." * 200_000, "1." * 100_000):
        base_spans(text)


def test_documents_against_plain_searches(spark, small):
    _, by_id = documents(spark, small)
    rows = op8_pii(spark, small).collect()
    assert len(rows) == len(by_id)
    for r in rows:
        spans = plain(by_id[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        for number, kind in enumerate(KINDS):
            assert r[f"n_{kind}"] == sum(k == number for *_, k in spans)
        assert set(filter(None, joined(spans).split(","))) <= set(r["spans"].split(","))


def letters(seed, words):
    """Prose without digits, which would run into numbers beside it."""
    return prose(seed, words).translate(str.maketrans("0123456789", "aeioustnrl"))


def personal(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    card = next(digits + d for d in "0123456789" if luhn(digits + d))
    return [
        f"user{rng.randrange(999)}@mail{rng.randrange(9)}.example.com",
        ".".join(str(rng.randrange(256)) for _ in range(4)),
        card, f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
    ]


def test_other_spellings_are_found_and_plain_texts_are_not(spark):
    rng = random.Random(5)
    rows = [(k, f"{letters(k, 20)} {rng.choice(personal(rng))} {letters(k + 9000, 20)}") for k in range(900)]
    model = train(texts(spark, rows))
    assert model.trees is not None
    card = next(c for c in personal(rng) if re.fullmatch(r"[0-9]{16}", c))
    hidden = [
        (1, f"{letters(1, 9)} jane.roe (at) mail.example.com {letters(2, 9)}"),
        (2, f"{letters(3, 9)} +1 (243) 555-7962 {card} {letters(4, 9)}"),
    ]
    clean = [(10 + k, f"{letters(k, 30)} on 12-05-2021 at noon. Version 3 of 400 pages") for k in range(30)]
    found = {r["doc_id"]: r["spans"] for r in find_pii(texts(spark, hidden + clean), model).collect()}
    assert [s["kind"] for s in found[1]] == ["email"]
    assert "card" in [s["kind"] for s in found[2]]
    assert all(found[10 + k] == [] for k in range(30))


def test_redaction(spark):
    docs = texts(spark, [(1, "é a.b@c.de, 1.2.3.4!"), (2, None), (3, "none"), (4, "a@b.cc")])
    rows = redact(docs, PiiModel(None, [2.0] * 4)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "é [email], [ip]!", 2: None, 3: "none", 4: "[email]"}


def test_odd_rows_and_empty_table(spark):
    docs = odd(spark)
    model = train(docs)
    rows = find_pii(docs, model).collect()
    assert len(rows) == docs.count()
    assert [s.asDict() for s in next(r for r in rows if r["doc_id"] == 10)["base_spans"]] == [
        {"kind": "email", "start": 26, "end": 34}
    ]
    assert train(empty(spark)).trees is None
    assert find_pii(empty(spark), model).collect() == []


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 10, (4000, 4))
    y = ((x[:, 0] > 4) & (x[:, 2] < 3)).astype(int)
    model = fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.99


@pytest.mark.parametrize("seed", range(4))
def test_covered_stretches_against_comparison_with_each_span(seed):
    rng = random.Random(seed)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 9), 0) for a in rng.choices(range(60), k=rng.randrange(8))]
        covered = _Covered(spans)
        alone, taken = [], _Covered([])
        for _ in range(20):
            a = rng.randrange(60)
            span = (a, a + rng.randrange(1, 9), 1)
            assert covered.meets(span) == any(span[0] < e and f < span[1] for f, e, _ in spans)
            assert taken.meets(span) == any(span[0] < e and f < span[1] for f, e, _ in alone)
            if not taken.meets(span):
                alone.append(span)
                taken.add(span)


def test_a_text_of_thousands_of_finds_takes_time_in_proportion():
    rng = random.Random(1)
    log = "\n".join(f"{k % 12:02d} {', '.join(personal(rng))}, 12-05-2021 jo at mail.example" for k in range(10_000))

    class Sure:
        def probability(self, x):
            return np.linspace(0, 1, len(x))

    start = time.monotonic()
    rows = labelled_candidates(log)
    base = base_spans(log)
    added = PiiModel(Sure(), [0.0] * 4).accepted(log, base)
    assert time.monotonic() - start < 60
    assert len(base) >= 40_000 and len(rows) > 10_000 and added
    merged = sorted([(a, b) for a, b, _ in added])
    assert all(one[1] <= two[0] for one, two in zip(merged, merged[1:]))


def test_a_long_name_is_found_from_its_beginning():
    name = "jane." * 40 + "roe"
    assert (3, 3 + len(name) + len(" (at) mail.example.com"), 0) in proposed_spans(
        f"to {name} (at) mail.example.com"
    )


def test_kinds_with_few_candidates_go_by_those_of_all():
    chances = np.linspace(0.999, 0.001, 1000)
    labels = (chances > 0.5).astype(int)
    few = np.zeros(1000, dtype=bool)
    few[[10, 300, 700]] = True
    threshold = _calibrated(chances, labels, few, 0.99)
    assert 0.4 < threshold < 0.52
    # Its own candidates count for more than as many of all.
    wrong = labels.copy()
    wrong[few] = 0
    assert _calibrated(chances, wrong, few, 0.99) > 0.98
    assert _calibrated(chances, np.zeros(1000, dtype=int), few, 0.99) == 2.0


def test_every_labelled_candidate_is_learned_from(spark):
    """Beyond 20,000 candidates, too, in any order; a copy of a text counts once."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"{x} and" for _ in range(12) for x in personal(rng))) for k in range(250)]
    docs = texts(spark, rows)
    total = sum(len(labelled_candidates(text)) for _, text in rows)
    assert total > 20_000
    counted = candidates(docs.union(docs.limit(50))).agg({"n": "sum"}).first()[0]
    assert counted == total


def test_trees_of_a_table_are_those_of_its_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 10, (600, 3))
    y = (x[:, 0] + x[:, 1] > 9).astype(int)
    rows = [(bytes(v), int(label), 1) for v, label in zip(x.tolist(), y)]
    table = spark.createDataFrame(rows, "values binary, label int, n bigint")
    table = table.groupBy("values", "label").sum("n").withColumnRenamed("sum(n)", "n").cache()
    one, two = fit_table(table, 3, float(y.mean())), fit(x, y)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(one.trees, two.trees))
    assert len(one.trees) == len(two.trees) == 60
