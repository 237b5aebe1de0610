import random

import pytest
from pyspark.sql import functions as F

from orebed.llm.queries import op6_url_filter
from orebed.llm.url_filter import RULES, host_and_path, judge_urls, labelled_urls, train

URLS = [
    None, "", "no scheme.example.net/en/", "http://", "http:///path", "HTTP://A.Example.NET/en/1?q#f",
    "https://example.com/de/?a://b/c", "https://example.com?x=/de/", "https://example.com#/de/",
    "https://notexample.com/de/", "https://sub.example.com/de/1", "ftp://x.org/fr/", "x://org/fr",
    "https://a.net/", "https://a.net", "https://ÄÖ.net/é", "a://b\nc.net/d\ne", "://net/x", "https://net./",
]


def rule_of(host, path):
    best = None
    for rule, _ in RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best):
                best = rule
    return best


@pytest.fixture(scope="module")
def model():
    return train()


def test_urls_against_plain_python(spark, model):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    for r in judge_urls(rows, model).collect():
        assert (r["host"], r["path"]) == host_and_path(URLS[r["page_id"]])
        assert r["rule"] == rule_of(r["host"], r["path"])
        p = model.probability(r["host"], r["path"])
        guess = "block" if p >= 0.5 else "allow"
        assert r["verdict"] == (dict(RULES)[r["rule"]] if r["rule"] else guess)


def test_pages(spark, small):
    rows = op6_url_filter(spark, small).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["host"], r["path"]) == host_and_path(pages[r["page_id"]])
        assert r["rule"] == rule_of(r["host"], r["path"])


def test_unseen_urls_are_told_apart():
    """Half of the words are learned from, the other parts of URLs are new."""
    rows = labelled_urls()
    random.Random(1).shuffle(rows)
    half = train(rows[: len(rows) // 2])
    rest = rows[len(rows) // 2 :]
    right = sum((half.probability(*host_and_path(u)) >= 0.5) == bool(y) for u, y in rest)
    assert right >= 0.85 * len(rest)


def test_odd_columns_and_empty_table(spark, model):
    rows = spark.createDataFrame(
        [(1, "https://a.net/x", 1.5, "v"), (None, None, None, None), (1, "https://a.net/x", 1.5, "v")],
        "page_id bigint, url string, host double, verdict string",
    )
    found = judge_urls(rows, model)
    assert sorted((r["page_id"] or 0, r["host"], r["verdict"]) for r in found.collect())[1:] == [
        (1, "a.net", "block")
    ] * 2
    assert judge_urls(rows.limit(0), model).collect() == []
    assert found.where(F.col("page_id").isNull()).first()["verdict"] == "allow"
