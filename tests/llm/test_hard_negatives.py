import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from orebed.llm.hard_negatives import (
    _packed_zones,
    _whole,
    blocks_of,
    bounds,
    hilbert_places,
    mine,
    products,
    search,
)
from orebed.llm.queries import ORACLE, op11_hard_negatives

SCHEMA = "vec_id bigint, label int, vector array<double>, anchor boolean, block int, uid string"


def plain(rows, positives=5, negatives=5):
    used = []
    for vec_id, label, vector, anchor, *_ in rows:
        if label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(256 * x) for x in vector):
            continue
        used.append((vec_id, label, [math.floor(256 * x) for x in vector], bool(anchor)))
    held = lambda n: max(-(2**63), min(2**63 - 1, n))
    out = []
    for i, (anchor_id, label, a, anchor) in enumerate(used):
        if not anchor:
            continue
        found = [
            (-held(sum(x * y for x, y in zip(a, b))), v is None, v or 0, v, other)
            for j, (v, other, b, _) in enumerate(used) if j != i
        ]
        near = sorted(f[:4] for f in found if f[4] == label)[:positives]
        for down, _, _, positive in near:
            p = -down
            fits = [f for f in found if f[4] != label and 80 * p <= -100 * f[0] <= 100 * p]
            for rank, f in enumerate(sorted(f[:4] for f in fits)[:negatives], 1):
                out.append((anchor_id, positive, rank, f[3], p, -f[0]))
    return sorted(out, key=repr)


def mined(spark, rows, **how):
    found = mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()
    return sorted(map(tuple, found), key=repr)


def clustered(n, width, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        vector = centres[rng.integers(12)] + 0.3 * rng.normal(size=width)
        rows.append((i, int(rng.integers(4)), vector.tolist(), i % 10 == 0, 1, "x"))
    return rows


def test_clusters_against_plain_python(spark):
    rows = clustered(600, 5)
    assert mined(spark, rows) == plain(rows) != []


def test_odd_rows(spark):
    x = [0.5, 0.25]
    rows = [
        (0, 1, x, True), (1, 1, x, False), (2, 2, x, False), (3, 2, x, False), (3, 2, x, False),
        (None, 2, x, False), (None, 1, x, True), (4, None, x, True), (5, 1, None, True),
        (6, 1, [0.5, None], True), (7, 2, [float("nan"), 1.0], False), (8, 2, [float("inf"), 1.0], True),
        (9, 1, [], True), (10, 2, [0.5], False), (11, 1, [0.5, 0.25, 3.0], True),
        (12, 2, [-0.5, -0.25], True), (0, 1, x, True), (13, 3, [1e300, 1e300], True),
        (14, 4, [1e300, -1e300], False), (15, 3, [9e299, 1.0], False), (16, 2, x, None),
        (17, 1, [1e307, 0.0], False), (-100, 1, [0.375, 0.125], True),
    ]
    rows = [(*r, 7, "clash") for r in rows]
    assert mined(spark, rows) == plain(rows) != []


def test_one_vector_holds_a_third(spark):
    rows = clustered(400, 4, seed=2)
    rows += [(1000 + i, 1, [1.0, 0.5, 0.0, 0.0], i % 50 == 0, 1, "x") for i in range(200)]
    random.Random(3).shuffle(rows)
    assert mined(spark, rows) == plain(rows)


def test_empty_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0], False, 1, "x")]) == []
    assert mined(spark, [(1, 1, [1.0], True, 1, "x")]) == []


def test_far_blocks_are_not_read(spark, monkeypatch):
    """With clusters apart, an anchor's windows read a part of the blocks, and the rows found
    are the right ones (the plain comparison above)."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(4000):
        centre = np.eye(8)[i % 8] * 8
        rows.append((i, i % 3, (centre + 0.05 * rng.normal(size=8)).tolist(), i % 400 == 0, 1, "x"))
    monkeypatch.setattr("orebed.llm.hard_negatives.BLOCK_BYTES", 8 * 8 * 32)
    frame = spark.createDataFrame(rows, SCHEMA)
    blocks = blocks_of(_whole(frame, 256))
    anchors = blocks.select(F.explode("anchors").alias("a")).select("a.*")
    wide = anchors.select(
        "uid", "label", "vector", F.array(F.lit(-(2**63))).alias("lows"),
        F.array(F.lit(2**63 - 1)).alias("highs"),
    )
    _, read = search(wide, blocks, _packed_zones(blocks), same=True, k=5)
    count = blocks.count()
    pairs = read.select(F.explode("members")).count()
    assert count >= 100 and 0 < pairs < 0.25 * count * 10


def test_curve_neighbours_and_bounds():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    places = hilbert_places(side, 3)
    order = np.lexsort(places.T[::-1])
    walk = side[order]
    assert len({tuple(p) for p in places.tolist()}) == len(side)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 9, (6, 4)).astype(float), rng.integers(-9, 9, (50, 4)).astype(float)
    least, most = bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    scores = products(a, b)
    assert (least <= scores.min(axis=1, keepdims=True)).all()
    assert (most >= scores.max(axis=1, keepdims=True)).all()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_against_sql(spark, folder):
    found = op11_hard_negatives(spark, folder)
    assert differences(found, connect(folder), ORACLE["op11_hard_negatives"]) == []
