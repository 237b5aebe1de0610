"""Removal of passages that documents share, by content-defined chunks of lines.

A line of ``LONG_LINE`` words or more is a chunk. The lines between such lines are cut
after every line whose rolling hash is lower than those of both its neighbours, so that a
chunk has two lines at least; several hashes give several ways to cut. That depends on
content only, so a passage is cut alike wherever it stands. Chunks are counted over all documents by a
128-bit hash. One that occurs in several documents stays in the first, by doc_id, and goes
from the others, together with lines next to it that also occur earlier; so do lines in a
row that have one first document in common and ``LONG_LINE`` words.

Cuts depend on the lines beside them, so chunks alone miss passages. From every line, the
fewest lines that make up ``LONG_LINE`` words are a window, counted like a chunk. Any
passage of so many words begins with a window, whatever stands around it and whichever
documents have its single lines, so none is missed.

At the end all occurrences are compared byte by byte; what merely shared a hash is put back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebed.llm.words import chunks
from orebed.session import materialize

LONG_LINE = 50
#: A chunk of shorter lines has two of them and this many words at least.
CHUNK_WORDS = 20
#: Lines in the rolling window of each hash.
WINDOWS = (1, 1, 2)
NO_ID = 2**63 - 1

_ROLL = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1

Part = tuple[int, int, int, bytes]  # first line, lines, words, hash


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _rolled(hashes: Sequence[int], window: int, salt: int) -> list[int]:
    """The rolling hash that ends at each line; lines before the first do not count."""
    rolled = []
    for i in range(len(hashes)):
        value = salt
        for line in hashes[max(0, i + 1 - window) : i + 1]:
            value = ((value ^ line) * _ROLL) & _MASK
            value ^= value >> 29
        rolled.append(value * _ROLL & _MASK)
    return rolled


def _spans(words: Sequence[int]) -> list[tuple[int, int]]:
    """First and last line of windows: the fewest lines of ``LONG_LINE`` words from each line,
    and those up to each line if a blank one is among them. Left out is what ``_removed`` takes
    by itself, lines next to a long one with no blank one between."""
    used = [i for i, n in enumerate(words) if n]
    ahead, back = [], []
    total, low = 0, 0
    for high, last in enumerate(used):
        total += words[last]
        # Every line from which this one is the first to make the sum up.
        while total >= LONG_LINE:
            ahead.append((used[low], last))
            total -= words[used[low]]
            low += 1
        if ahead and low:
            # The line before ``low`` is the last from which the sum up to here is enough.
            back.append((used[low - 1], last))
    found = [
        (first, last) for first, last in ahead
        if first < last and (words[last] < LONG_LINE or 0 in words[first:last])
    ]
    return list(dict.fromkeys(found + [(a, b) for a, b in back if 0 in words[a:b]]))


def parts_of(lines: Sequence[bytes]) -> list[Part]:
    """All lines with a word in them, all chunks of several lines, and all windows."""
    words = [len(line.split()) for line in lines]
    keys = [digest(line) for line in lines]
    found = [(i, 1, words[i], keys[i]) for i in range(len(lines)) if words[i]]
    hashes = [int.from_bytes(key[:8], "little") for key in keys]
    low = 0
    for high in range(len(lines) + 1):
        if high < len(lines) and words[high] < LONG_LINE:
            continue
        for salt, window in enumerate(WINDOWS):
            rolled, start = _rolled(hashes[low:high], window, salt), 0
            for i in range(high - low):
                last = i + 1 == high - low
                if not last and not (i > 0 and rolled[i - 1] > rolled[i] < rolled[i + 1]):
                    continue
                total = sum(words[low + start : low + i + 1])
                if i > start and total >= CHUNK_WORDS:
                    key = digest(b"\n".join(lines[low + start : low + i + 1]))
                    found.append((low + start, i + 1 - start, total, key))
                start = i + 1
        low = high + 1
    for first, last in _spans(words):
        key = digest(b"\n".join(lines[first : last + 1]))
        found.append((first, last + 1 - first, sum(words[first : last + 1]), key))
    return list(dict.fromkeys(found))


def _removed(count: int, parts: Sequence[Part], first: Sequence[int], doc: int) -> list[bool]:
    """Which of ``count`` lines go: chunks and windows that stand in an earlier document; lines
    in a row that all have the same first document, if they make up a passage; and then single
    lines that stand earlier and touch what goes. ``first`` is the first document of each part."""
    gone, origin, words_in = [False] * count, [doc] * count, [0] * count
    for (start, lines, words, _), where in zip(parts, first):
        if where == doc:
            continue
        if lines == 1:
            origin[start], words_in[start] = where, words
        if lines > 1 or words >= LONG_LINE:
            gone[start : start + lines] = [True] * lines
    start = 0
    for i in range(1, count + 1):
        if i == count or origin[i] != origin[start]:
            if origin[start] != doc and sum(words_in[start:i]) >= LONG_LINE:
                gone[start:i] = [True] * (i - start)
            start = i
    for order in (range(1, count), range(count - 2, -1, -1)):
        step = 1 if order.step == 1 else -1
        for i in order:
            if origin[i] != doc and gone[i - step]:
                gone[i] = True
    return gone


def _key_columns(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)),
        "_text": F.xxhash64("text"),
    })


_PARTS = "_doc bigint, _text bigint, start int, lines int, words int, hash binary"


def _find_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        rows, columns = [], ([], [], [], [])
        for row, text in enumerate(batch.column("text")):
            for part in parts_of((text.as_py() or "").encode().split(b"\n")):
                rows.append(row)
                for values, value in zip(columns, part):
                    values.append(value)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_doc").take(at), batch.column("_text").take(at),
                *(pa.array(v, pa.int32()) for v in columns[:3]), pa.array(columns[3], pa.binary()),
            ],
            ["_doc", "_text", "start", "lines", "words", "hash"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cleaned text and, for the comparison, the bytes of all shared parts."""
    for batch in chunks(batches, "text"):
        texts, removed, gone_words, shared, n_lines = [], [], [], [], []
        for text, doc, parts in zip(
            batch.column("text"), batch.column("_doc"), batch.column("_parts")
        ):
            value, found = text.as_py(), parts.as_py() or []
            lines = (value or "").encode().split(b"\n")
            n_lines.append(len(lines) if value is not None else 0)
            gone = _removed(
                len(lines), [(p["start"], p["lines"], p["words"], p["hash"]) for p in found],
                [p["first"] for p in found], doc.as_py(),
            )
            kept = b"\n".join(line for line, out in zip(lines, gone) if not out)
            texts.append(value if not any(gone) else kept.decode())
            removed.append([i for i, out in enumerate(gone) if out])
            gone_words.append(sum(len(l.split()) for l, out in zip(lines, gone) if out))
            shared.append([
                {"hash": p["hash"], "bytes": b"\n".join(lines[p["start"] : p["start"] + p["lines"]])}
                for p in found
            ])
        kind = pa.list_(pa.struct([("hash", pa.binary()), ("bytes", pa.binary())]))
        names = [n for n in batch.schema.names if n not in ("text", "_parts")]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(name) for name in names),
                pa.array(texts, pa.string()), pa.array(n_lines, pa.int32()),
                pa.array(removed, pa.list_(pa.int32())), pa.array(gone_words, pa.int64()),
                pa.array(shared, kind),
            ],
            [*names, "text", "n_lines", "removed", "removed_words", "_shared"],
        )


def _apply(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """``docs`` without the parts that a document before them has; ``parts`` has the first
    document of each."""
    per_doc = parts.groupBy("_doc", "_text").agg(
        F.collect_set(F.struct("start", "lines", "words", "hash", "first")).alias("_parts")
    )
    joined = _key_columns(docs).join(per_doc, ["_doc", "_text"], "left")
    fields = {f.name: f for f in joined.schema.fields}
    names = [n for n in joined.columns if n not in ("text", "_parts")]
    schema = StructType([fields[n] for n in names])
    added = StructType.fromDDL(
        "text string, n_lines int, removed array<int>, removed_words bigint, "
        "_shared array<struct<hash: binary, bytes: binary>>"
    )
    schema = StructType([*schema.fields, *added.fields])
    return joined.select(*names, "text", "_parts").mapInArrow(_cut, schema)


def remove_shared_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cleaned, n_lines (before), removed (numbers of removed lines)
    and removed_words.

    Lines end at "\\n". The document with the lowest doc_id keeps a passage; rows with the
    same doc_id are one document, and rows without one are one document after all others.
    A NULL text stays NULL, an empty one empty; a text of which nothing is left is empty.
    Repeated rows are kept and treated alike. Columns n_lines, removed and removed_words of
    the input are replaced; names that start with an underscore are used inside.
    """
    order = [c for c in docs.columns if c not in ("n_lines", "removed", "removed_words")]
    docs = docs.select(*order)
    rows = _key_columns(docs).select("_doc", "_text", "text")
    parts = materialize(rows.mapInArrow(_find_parts, _PARTS), "line-parts")
    shared = (
        parts.groupBy("hash")
        .agg(F.min("_doc").alias("first"), F.max("_doc").alias("_last"))
        .where("first < _last")
        .drop("_last")
    )
    repeated = materialize(parts.join(shared, "hash"), "line-repeats")
    cleaned = materialize(_apply(docs, repeated), "line-cleaned")
    result = [*order, "n_lines", "removed", "removed_words"]
    seen = cleaned.select(F.explode("_shared").alias("p")).select("p.hash", "p.bytes").distinct()
    clashes = seen.groupBy("hash").count().where("count > 1").drop("count")
    if clashes.isEmpty():
        return cleaned.select(*result)
    return _apply(docs, _by_bytes(docs, repeated, clashes)).select(*result)


def _by_bytes(docs: DataFrame, repeated: DataFrame, clashes: DataFrame) -> DataFrame:
    """``repeated`` with parts of clashing hashes told apart by their bytes."""
    per_part = (
        _key_columns(docs).select("_doc", "_text", F.split("text", "\n").alias("_lines"))
        .join(repeated.join(clashes, "hash").drop("first"), ["_doc", "_text"])
        .withColumn("_bytes", F.array_join(F.slice("_lines", F.col("start") + 1, F.col("lines")), "\n"))
        .select("_doc", "_text", "start", "lines", "words", "hash", "_bytes")
        .distinct()
    )
    firsts = (
        per_part.groupBy("hash", "_bytes")
        .agg(F.min("_doc").alias("first"), F.max("_doc").alias("_last"))
        .where("first < _last").drop("_last")
    )
    told = per_part.join(firsts, ["hash", "_bytes"]).drop("_bytes")
    return repeated.join(clashes, "hash", "left_anti").unionByName(told)
