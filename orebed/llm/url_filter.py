"""URLs judged by rules and, where none fits, by a logistic regression on character n-grams.

Host and path are cut into n-grams, hashed into a fixed number of weights. The weights come
from a small table of labelled URLs, on the driver; scoring is one pass over the URLs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALLOW, BLOCK = "allow", "block"
#: (host and path prefix, verdict). A rule fits its host and all subdomains of it.
RULES = (
    ("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW),
)
DIMENSIONS = 1 << 14
GRAMS = (3, 4, 5)

#: Words that stand in hosts or paths of unwanted and of ordinary pages.
UNWANTED = (
    "spam-farm", "free-bets", "adult-x", "casino", "poker", "cheap-pills", "xxx-cams",
    "win-prizes", "clickbait", "malware", "warez", "payday-loans", "betting", "porn", "escort",
    "torrent", "phishing", "viagra", "jackpot", "hot-singles", "ads-server", "ad-tracker",
    "casino-bonus", "win-money", "track-pixel",
)
ORDINARY = (
    "news", "blog", "docs", "wiki", "library", "museum", "school", "weather", "recipes",
    "travel", "science", "health", "history", "music", "forum", "shop", "garden", "sports",
    "city", "archive",
)
#: Names of ordinary hosts that are no known word: any two of these.
SYLLABLES = ("tha", "ren", "ing", "ter", "ion", "ell", "and", "ous", "est", "ver", "ati", "men")
_PREFIXES = ("", "www.", "m.", "blog.")
_ZONES = ("com", "org", "net")
_TAILS = ("/", "/en/12", "/fr/345.html", "/de/6789/", "/es/77")


def labelled_urls() -> list[tuple[str, int]]:
    """URLs, 1 if unwanted: every word once with each prefix, other parts in turn."""
    rows = []
    names = [a + b for a, b in product(SYLLABLES, SYLLABLES)]
    every = [(0, name, _PREFIXES[i % len(_PREFIXES)]) for i, name in enumerate(names)]
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        every += [(label, word, prefix) for word, prefix in product(words, _PREFIXES)]
    for label in (0, 1):
        for i, (word, prefix) in enumerate(row[1:] for row in every if row[0] == label):
            # No part but the word may tell the classes apart.
            zone, tail = _ZONES[i % len(_ZONES)], _TAILS[i % len(_TAILS)]
            rows.append((f"https://{prefix}{word}.example.{zone}{tail}", label))
    return rows


def host_and_path(url: str | None) -> tuple[str, str]:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased, and
    what follows that up to "?", "#" or the end. Both empty for NULL or without "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cuts = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    end = min(cuts, default=len(rest))
    path = rest[end:].split("?", 1)[0].split("#", 1)[0]
    host = rest[:end].encode().lower().decode()
    return host, path


def _columns(url: Column) -> tuple[Column, Column]:
    """The same as columns."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _features(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, each with its own marks, repeated ones once."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = text.encode()
        for size in GRAMS:
            for i in range(len(data) - size + 1):
                gram = data[i : i + size]
                found.add(zlib.crc32(mark.encode() + gram) % DIMENSIONS)
    return np.fromiter(found, np.int64, len(found))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    share: float  # of unwanted URLs in the table, for a URL without any n-gram

    def probability(self, host: str, path: str) -> float:
        """That the page is unwanted."""
        indices = _features(host, path)
        if not len(indices):
            return self.share
        value = self.weights[indices].sum() / np.sqrt(len(indices)) + self.bias
        return 1 / (1 + float(np.exp(-value)))


def train(
    rows: Sequence[tuple[str, int]] | None = None, *, rounds: int = 400, rate: float = 0.5,
    penalty: float = 1e-3,
) -> UrlModel:
    """Logistic regression by gradient descent over a small table of (url, 1 if unwanted)."""
    rows = labelled_urls() if rows is None else rows
    matrix = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for row, (url, _) in enumerate(rows):
        indices = _features(*host_and_path(url))
        matrix[row, indices] = 1 / np.sqrt(max(1, len(indices)))
    labels = np.array([label for _, label in rows], dtype=np.float32)
    weights, bias = np.zeros(DIMENSIONS, dtype=np.float32), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(matrix @ weights + bias))) - labels
        weights -= rate * (matrix.T @ error / len(rows) * 10 + penalty * weights)
        bias -= rate * float(error.mean())
    return UrlModel(weights.astype(np.float64), bias, float(labels.mean()))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = rule.partition("/")
        fits = F.concat(F.lit("."), host).endswith(f".{own}") & path.startswith(f"/{rest}")
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge_urls(
    pages: DataFrame, model: UrlModel, *, rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule (NULL if none fits), p_unwanted and verdict.

    The verdict is that of the longest rule that fits, else "block" if the model gives
    ``threshold`` or more. A NULL url, or one without "://", has an empty host and path and is
    judged by the model like others. Those five columns of the input are replaced; no other
    column but url is read, and no row moves.
    """
    pages = pages.drop("host", "path", "rule", "p_unwanted", "verdict")
    host, path = _columns(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("p_unwanted double").fields])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: UrlModel = shared.value
        for batch in batches:
            values = [
                model.probability(h, p)
                for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64())],
                [*batch.schema.names, "p_unwanted"],
            )

    scored = rows.mapInArrow(score, schema)
    name, verdict = _rule(F.col("host"), F.col("path"), rules)
    guess = F.when(F.col("p_unwanted") >= threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.withColumns({"rule": name, "verdict": F.coalesce(verdict, guess)})
