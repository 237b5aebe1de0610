"""Personal data in texts: fixed patterns, and boosted trees over further candidates.

The patterns of ``base_spans`` always count. Beside them generators propose spans that look
like an address, number or the like in some other spelling. Boosted trees judge these by
format and context, and a threshold per kind, calibrated on texts that the trees have not
seen, selects. The trees learn from spans that the patterns find, as they are and respelled in
their place, against proposals that have no such origin and against broken numbers and plain words.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebed.llm.boosting import Boosted, fit_table, unpacked
from orebed.llm.words import chunks
from orebed.session import materialize

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # first character, end, number of the kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can match only where the start of the run does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Candidates beyond the patterns, by kind.
_AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20", re.IGNORECASE)
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)"
_DOMAIN_AFTER = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
_PROPOSED = (
    (1, re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[.,_-]\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])")),
    # A number that the pattern took for a part of a longer one.
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?(?:[\x20./()-]{1,2}[0-9]{2,5}){2,5}(?![0-9A-Za-z])")),
    (3, re.compile(r"\+[0-9]{1,3}\x20?\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{3,4}){2}(?![0-9A-Za-z])")),
)
_CUES = (
    re.compile(r"mail|contact|write|courriel|correo|schreib", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|address|adresse", re.IGNORECASE),
    re.compile(r"card|visa|master|carte|karte|tarjeta|credit", re.IGNORECASE),
    re.compile(r"phone|tel|call|mobile|fax|anruf|llam", re.IGNORECASE),
)
CONTEXT = 32
PRECISION = 0.99
#: Thresholds lie on a grid of so many steps to each unit of log odds, within these limits.
GRID, LIMIT = 256, 20
#: A kind's precision is that of its own candidates and of as many as this of all kinds.
POOLED = 20
#: Text on either side of a span that labelling looks at.
_NEAR = 200


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _name_start(text: str, low: int, end: int) -> int:
    """Where the characters of a name that ends at ``end`` begin, not before ``low``."""
    first = end
    while first > low and text[first - 1] in _LOCAL:
        first -= 1
    return first


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of name, "@" and domain, found from each "@", as a search from every
    letter would be quadratic in a long run of them."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = _name_start(text, done, at)
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            done = domain.end()
            yield first, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start and then kind."""
    found = [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(part[-4:]) <= 255 and not part[:-4].strip("0") for part in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def proposed_spans(text: str) -> list[Span]:
    """Candidates; those of different kinds may overlap."""
    found = []
    for m in _AT.finditer(text):
        # A name has no character of the match before it, so none is gone through twice.
        first = _name_start(text, 0, m.start())
        domain = _DOMAIN_AFTER.match(text, m.end()) if first < m.start() else None
        if domain:
            found.append((first, domain.end(), 0))
    if _DIGIT.search(text):
        for kind, pattern in _PROPOSED:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return list(dict.fromkeys(found))


def _beside(text: str, index: int) -> int:
    if not 0 <= index < len(text) or text[index] == "\n":
        return 0
    return 1 if text[index] == " " else 2 if text[index].isalnum() else 3


def features(text: str, span: Span) -> list[int]:
    """Format and context of a candidate, as integers from 0 to 63."""
    first, end, kind = span
    inside = text[first:end]
    before, after = text[max(0, first - CONTEXT) : first], text[end : end + CONTEXT]
    digits = _digits(inside)
    groups = re.findall(r"[0-9]+", inside)
    around = before + after
    separators = {c for c in inside if not c.isalnum()}
    cues = [bool(cue.search(around)) for cue in _CUES]
    lower = inside.lower()
    return [
        kind, min(len(digits), 63), min(len(inside), 63), int(bool(digits) and luhn(digits)),
        min(len(separators), 63), min(len(groups), 63), min(max(map(len, groups), default=0), 63),
        min(min(map(len, groups), default=0), 63), _beside(text, first - 1), _beside(text, end),
        int(cues[kind]), int(any(cues)), int("(" in inside), int(" " in inside),
        1 + int(any(f"{c}at{d}" in lower for c, d in ("()", "[]", "{}"))) if kind == 0 else 0,
        1 + int("dot" in lower) if kind == 0 else 0,
        int(bool(groups) and all(int(g) <= 255 for g in groups)),
        min(sum(c.isdigit() for c in around), 63), min(sum(c.isalpha() for c in inside), 63),
        int(lower.rsplit(".", 1)[-1].isalpha()), int("\n" in inside),
    ]


def _respelled(text: str, span: Span, rng: random.Random) -> tuple[str, Span]:
    """The same personal data in a spelling that the patterns miss, in its place."""
    first, end, kind = span
    inside = text[first:end]
    if kind == 0:
        at, dot = rng.choice(((" (at) ", "."), ("[at]", " [dot] "), (" at ", " dot "), ("(at)", ".")))
        name, _, domain = inside.partition("@")
        new = name + at + domain.replace(".", dot)
    elif kind == 1:
        new = inside.replace(".", rng.choice(("-", " . ", "_")))
    elif kind == 2:
        digits, mark = _digits(inside), rng.choice((".", "/", "  ", "_"))
        new = mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    else:
        digits, mark = _digits(inside), rng.choice((" ", "-", "."))
        body = [digits[-10:-7], digits[-7:-4], digits[-4:]]
        new = mark.join(([digits[:-10]] if len(digits) > 11 else []) + body)
    return text[:first] + new + text[end:], (first, first + len(new), kind)


def _broken(text: str, span: Span, rng: random.Random) -> tuple[str, Span]:
    """Something of a similar look, in the same place, that is nobody's data."""
    first, end, kind = span
    if kind == 0:
        words = re.findall(r"[A-Za-z]{2,}", text[:first][-200:] + text[end : end + 200])
        one, two, three = (rng.choice(words or ["then"]) for _ in range(3))
        new = f"{one} at {two}.{three}"
    elif kind == 1:
        parts = [rng.randint(256, 999), *(rng.randint(1, 999) for _ in range(3))]
        new = rng.choice(("-", " . ", "_")).join(map(str, parts))
    elif kind == 2:
        digits = _digits(text[first:end])
        digits = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        new = rng.choice((".", "/", "  ", "_", "")).join(
            digits[i : i + 4] for i in range(0, len(digits), 4)
        )
    else:
        date = (rng.randint(10, 31), rng.randint(10, 12), rng.randint(1900, 2100))
        new = rng.choice(("-", ".", "/")).join(map(str, date))
        new += rng.choice(("", f" {rng.randint(10, 23)}", f" {rng.randint(100, 999)}"))
    return text[:first] + new + text[end:], (first, first + len(new), kind)


class _Covered:
    """Stretches of a text, disjoint and in order, so that one search finds an overlap."""

    def __init__(self, spans: list[Span]):
        self.first: list[int] = []
        self.end: list[int] = []
        for a, b, _ in sorted(spans):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.first.append(a)
                self.end.append(b)

    def meets(self, span: Span) -> bool:
        before = bisect_left(self.first, span[1])
        return before > 0 and self.end[before - 1] > span[0]

    def add(self, span: Span) -> None:
        """``span``, which meets none so far."""
        at = bisect_left(self.first, span[0])
        self.first.insert(at, span[0])
        self.end.insert(at, span[1])


def labelled_candidates(text: str) -> list[tuple[int, list[int]]]:
    """(1 if personal, features): respelled patterns; broken ones, and other proposals."""
    base = base_spans(text)
    rng = random.Random(zlib.crc32(text.encode()))
    rows = []
    for first, end, kind in base:
        start = max(0, first - _NEAR)
        near, span = text[start : end + _NEAR], (first - start, end - start, kind)
        for label, (changed, place) in (
            (1, (near, span)), (1, _respelled(near, span, rng)), (0, _broken(near, span, rng)),
        ):
            low = max(0, place[0] - 100)
            window = changed[low : place[1] + 100]
            moved = (place[0] - low, place[1] - low, place[2])
            if moved in proposed_spans(window):
                rows.append((label, features(window, moved)))
    covered = _Covered(base)
    rows += [(0, features(text, s)) for s in proposed_spans(text) if not covered.meets(s)]
    return rows


@dataclass
class PiiModel:
    trees: Boosted | None
    thresholds: list[float]  # by kind; above 1 where no threshold is precise enough

    def accepted(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates that count, none of which overlaps a span of ``base`` or another."""
        covered = _Covered(base)
        spans = [s for s in proposed_spans(text) if not covered.meets(s)]
        if not spans or self.trees is None:
            return []
        chances = self.trees.probability(np.array([features(text, s) for s in spans]))
        chosen, taken = [], _Covered([])
        for chance, span in sorted(zip(chances, spans), key=lambda row: (-row[0], row[1])):
            if chance >= self.thresholds[span[2]] and not taken.meets(span):
                chosen.append(span)
                taken.add(span)
        return chosen


def _calibrated(
    chances: np.ndarray, labels: np.ndarray, own: np.ndarray, precision: float,
    times: np.ndarray | None = None,
) -> float:
    """The lowest threshold from which on candidates of a kind, marked by ``own``, are right
    often enough; each occurs as many ``times``, or once. To these are added ``POOLED`` that are right as often as those of all kinds
    are from there on, which settles a kind with few candidates and hardly moves others."""
    order = np.argsort(-chances, kind="stable")
    n = np.ones(len(order), dtype=np.int64) if times is None else times
    right, count = np.cumsum((labels * n)[order]), np.cumsum(n[order])
    its_right, its = np.cumsum((labels * own * n)[order]), np.cumsum((own * n)[order])
    share = (its_right + POOLED * right / count) / (its + POOLED)
    # Only where the next candidate has a lower chance can a threshold be put.
    edge = np.append(chances[order][1:] < chances[order][:-1], True)
    good = np.flatnonzero(edge & (share >= precision))
    return float(chances[order][good[-1]]) if len(good) else 2.0


def candidates(docs: DataFrame) -> DataFrame:
    """part (0 or 1, by text), label, values (features, a byte each) and n: how many labelled
    candidates of different texts are alike in these."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            keys, numbers, parts, labels, values = [], [], [], [], []
            texts = zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())
            for key, text in texts:
                rows = labelled_candidates(text or "")
                part = zlib.crc32((text or "").encode()) % 2
                keys += [key] * len(rows)
                numbers += range(len(rows))
                parts += [part] * len(rows)
                labels += [is_pii for is_pii, _ in rows]
                values += [bytes(row) for _, row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()),
                    pa.array(parts, pa.int32()), pa.array(labels, pa.int32()),
                    pa.array(values, pa.binary()),
                ],
                ["key", "number", "part", "label", "values"],
            )

    rows = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(
        label, "key bigint, number bigint, part int, label int, values binary"
    )
    # A text that has copies counts once.
    return rows.distinct().groupBy("part", "label", "values").agg(F.count(F.lit(1)).alias("n"))


def _levels(rows: DataFrame, trees: Boosted) -> pa.Table:
    """kind, label, level (log odds on the grid) and n: the candidates of each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch)
                level = np.floor(np.clip(trees.margin(x), -LIMIT, LIMIT) * GRID)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x[:, 0].astype(np.int32)), batch.column("label"),
                        pa.array(level.astype(np.int32)), batch.column("n"),
                    ],
                    ["kind", "label", "level", "n"],
                )

    placed = rows.mapInArrow(place, "kind int, label int, level int, n bigint")
    return placed.groupBy("kind", "label", "level").agg(F.sum("n").alias("n")).toArrow()


def train(docs: DataFrame, *, precision: float = PRECISION) -> PiiModel:
    """Trees from all labelled candidates of half the texts of ``docs``; those of the other half
    settle the thresholds. Without both labels in both no candidate counts."""
    rows = materialize(candidates(docs), "pii-candidates")
    counts = {
        (r["part"], r["label"]): r["n"]
        for r in rows.groupBy("part", "label").agg(F.sum("n").alias("n")).collect()
    }
    if len(counts) < 4:
        return PiiModel(None, [2.0] * len(KINDS))
    features = len(rows.first()["values"])
    share = counts[0, 1] / (counts[0, 0] + counts[0, 1])
    trees = fit_table(rows.where("part = 0"), features, share)
    found = _levels(rows.where("part = 1").select("label", "values", "n"), trees)
    kinds, labels, levels, times = (
        found[name].to_numpy() for name in ("kind", "label", "level", "n")
    )
    chances = 1 / (1 + np.exp(-levels / GRID))
    return PiiModel(
        trees,
        [_calibrated(chances, labels, kinds == k, precision, times) for k in range(len(KINDS))],
    )


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: kind, start and end (exclusive) in code
    points, by start and then kind. ``spans`` has the former and what the model adds, which
    overlaps none of them. A NULL text is empty. Both columns of the input are replaced; no
    other column but text is read, and no row moves."""
    docs = docs.drop("base_spans", "spans")
    added = StructType.fromDDL(f"base_spans {SPANS}, spans {SPANS}")
    schema = StructType([*docs.schema.fields, *added.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def as_rows(spans: list[Span]) -> list[dict]:
        ordered = sorted(spans, key=lambda s: (s[0], s[2], s[1]))
        return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in ordered]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: PiiModel = shared.value
        for batch in chunks(batches, "text"):
            base, every = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append(as_rows(spans))
                every.append(as_rows(spans + model.accepted(text, spans)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base, kind), pa.array(every, kind)],
                [*batch.schema.names, "base_spans", "spans"],
            )

    return docs.mapInArrow(search, schema)


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with every span of ``find_pii`` replaced by its kind in brackets; where spans
    overlap, what they cover together is replaced by the first one's kind."""
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda state, s: F.when(s["start"] < state["at"], F.struct(
            state["out"].alias("out"), F.greatest(state["at"], s["end"]).alias("at")
        )).otherwise(F.struct(
            F.concat(
                state["out"],
                F.expr("text").substr(state["at"] + 1, s["start"] - state["at"]),
                F.lit("["), s["kind"], F.lit("]"),
            ).alias("out"),
            s["end"].alias("at"),
        )),
        lambda state: F.concat(
            state["out"], F.expr("text").substr(state["at"] + 1, F.lit(2**31 - 1))
        ),
    )
    found = find_pii(docs, model)
    return found.withColumn("text", F.when(F.size("spans") > 0, pieces).otherwise(F.col("text")))
