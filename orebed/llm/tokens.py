"""Texts as pieces of token ids, over a fixed public vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from orebed.llm.words import chunks

VOCABULARY = "byte_bpe_50k.tiktoken"
REFERENCE = "byte_bpe_50k.json"
END_OF_TEXT = "<|endoftext|>"

PIECE_FIELDS = "piece int, start bigint, length bigint, ids binary"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


@functools.cache
def encoder(path: str):
    """The ids are those of the same vocabulary in ``byte_bpe_50k.json``, at four times the
    speed; a test holds them against each other."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={END_OF_TEXT: len(ranks)},
    )


@functools.cache
def reference_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, ranks: str, reference: str) -> list[int]:
    """Ids of a text. A run of white space so long that it exhausts the fast library's stack
    goes to the slow one."""
    try:
        return encoder(ranks).encode(text, allowed_special="all")
    except ValueError:
        return reference_encoder(reference).encode(text, add_special_tokens=False).ids


def pieces(
    docs: DataFrame, capacity: int, *, vocabulary: str = VOCABULARY,
    reference: str = REFERENCE, end: int = 0,
) -> DataFrame:
    """One row per piece of a document: doc_id, piece (from 0), start (ids of the document
    before it), length, ids (unsigned 32-bit, little-endian).

    A document is its ids followed by ``end``. One longer than ``capacity`` is cut into
    pieces of just that length, counted from its end, so that the first may be shorter. A
    NULL text is empty, its piece holds ``end`` alone. Rows with a NULL or repeated doc_id
    are documents like others. Columns beside doc_id and text are not read.
    """
    paths = vocabulary_path(vocabulary), vocabulary_path(reference)
    key = docs.schema["doc_id"]
    schema = StructType([StructField("doc_id", key.dataType)])
    for field in StructType.fromDDL(PIECE_FIELDS):
        schema.add(field)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows, piece, start, length, ids = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                tokens = ids_of(text.as_py() or "", *paths)
                tokens.append(end)
                raw = np.array(tokens, dtype="<u4").tobytes()
                first = len(tokens) % capacity or capacity
                cuts = [0, *range(first, len(tokens) + 1, capacity)]
                for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    piece.append(number)
                    start.append(low)
                    length.append(high - low)
                    ids.append(raw[4 * low : 4 * high])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, schema)
