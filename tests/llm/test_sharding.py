import zlib
from collections import Counter, defaultdict

import pytest
from cases import empty, odd, odd_rows

from orebed.llm.queries import op9_sharding
from orebed.llm.sharding import interleave


def shards(rows):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    return {shard: len(slots) for shard, slots in by_shard.items()}


def test_documents_by_size_and_mixture(spark, small):
    rows = op9_sharding(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    sizes = shards(rows)
    assert len(rows) == len(docs) and set(sizes) == set(range(40))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    by_id = {r["doc_id"]: r for r in rows}
    for doc in docs:
        data = (doc["text"] or "").encode()
        row = by_id[doc["doc_id"]]
        assert (row["size"], row["text_crc32"]) == (len(data) + 16, zlib.crc32(data))


@pytest.mark.parametrize("bucket_rows", [7, 5000])
def test_every_shard_has_the_mixture(spark, bucket_rows):
    rows = spark.range(1000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('s', id % 7) END AS s"
    )
    placed = interleave(rows, ["s"], 8, bucket_rows=bucket_rows).collect()
    assert sorted(r["id"] for r in placed) == list(range(1000))
    assert set(shards(placed).values()) == {125}
    share = Counter(r["s"] for r in placed)
    for (_, s), n in Counter((r["shard"], r["s"]) for r in placed).items():
        assert abs(n - share[s] / 8) <= 2


def test_the_place_does_not_follow_partitions_but_the_seed(spark):
    rows = spark.range(300).selectExpr("id", "id % 4 AS s")

    def places(df, **options):
        return {r["id"]: (r["shard"], r["slot"]) for r in interleave(df, ["s"], 5, **options).collect()}

    first = places(rows)
    assert places(rows.repartition(7)) == first
    assert places(rows, seed=1) != first


def test_odd_rows(spark):
    rows = interleave(odd(spark), ["source"], 4).collect()
    assert len(rows) == len(odd_rows())
    assert set(shards(rows).values()) == {3, 4}
    assert {type(r["shard"]) for r in rows} == {int}


def test_empty_and_fewer_rows_than_shards(spark):
    assert interleave(empty(spark), ["source"], 4).collect() == []
    few = interleave(spark.range(2).selectExpr("id", "1 AS s"), ["s"], 5).collect()
    assert len(few) == 2 and set(shards(few).values()) == {1}
    with pytest.raises(ValueError):
        interleave(empty(spark), ["source"], 0)
