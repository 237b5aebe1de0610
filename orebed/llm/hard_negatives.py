"""Hard negatives from blocks along a Hilbert curve, chosen by interval bounds.

Vectors become whole numbers. All rows are sorted by label and place on a Hilbert curve and
cut into blocks, each one row of a Parquet table, with the least and greatest value of every
dimension (and label) as its zone map. From a zone map alone, interval arithmetic bounds all
inner products of an anchor with a block from below and above. A window of an anchor (any
score for positives, a share of a positive's score for negatives) needs only blocks whose
bounds meet it. The most promising block is read first; what it holds raises the lower end of
the window, and only blocks that can still hold something better are read after it.

Anchors are handled in chunks, blocks in tiles of a few; a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.session import materialize

#: Bytes of the vectors of a block; rows follow from their width.
BLOCK_BYTES = 1 << 18
#: Most rows of a block: a row's number is its block's times this plus its place.
BLOCK_ROWS = 1 << 12
TILE_BLOCKS = 8
CHUNK_ANCHORS = 512
ZONE_BLOCKS = 1024
#: Bits of each dimension in the place on the curve.
BITS = 2
#: Stands for a NULL id, so that it sorts after all others.
NO_ID = np.iinfo(np.int64).max
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Sums of products up to here are exact as doubles.
_EXACT = 2.0**53

_ROWS = "vec_id bigint, label bigint, anchor boolean, vector binary, place binary"
_ANCHORS = "array<struct<uid: bigint, vec_id: bigint, label: bigint, vector: binary>>"
_BLOCKS = (
    "block bigint, n int, width int, ids binary, labels binary, vectors binary, "
    f"low binary, high binary, least_label bigint, most_label bigint, anchors {_ANCHORS}"
)
_CHUNKS = (
    "n int, width int, windows int, uids binary, labels binary, vectors binary, "
    "lows binary, highs binary"
)
_FOUND = "uid bigint, at int, score bigint, found_id bigint, found_uid bigint"


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of ``cells`` (whole numbers of ``bits`` bits),
    as bytes that sort like it: Skilling's transform, for all rows at once."""
    x = cells.astype(np.int64).copy()
    if x.shape[1] == 0:
        return np.zeros((len(x), 1), np.uint8)
    for bit in range(bits - 1, 0, -1):
        mask = np.int64((1 << bit) - 1)
        for axis in range(x.shape[1]):
            high = (x[:, axis] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[:, 0] ^ x[:, axis]) & mask)
            x[:, 0] ^= swap
            x[:, axis] ^= swap
            x[:, 0] ^= np.where(high, mask, 0)
    x = np.bitwise_xor.accumulate(x, axis=1)
    turned = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where((x[:, -1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turned[:, None]
    planes = [(x >> bit) & 1 for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def _padded(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows of doubles; components that a shorter vector lacks are zero."""
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for row, vector in enumerate(vectors):
        values = np.frombuffer(vector, np.float64)
        out[row, : len(values)] = values
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, whole numbers, exact; those beyond 64 bits are held
    at the ends of that range."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    most = width * np.abs(left).max(initial=0.0) * np.abs(right).max(initial=0.0)
    if most < _EXACT:
        return (left @ right.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    sums = whole(left).dot(whole(right).T) if width else np.zeros((len(left), len(right)))
    return np.clip(sums, _LEAST, _MOST).astype(np.int64)


def bounds(
    anchors: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each anchor with anything between ``low`` and
    ``high``, a little wider than exact so that rounding cannot lose a block."""
    width = min(anchors.shape[1], low.shape[1])
    anchors, low, high = anchors[:, :width], low[:, :width], high[:, :width]
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    with np.errstate(invalid="ignore", over="ignore"):
        least = up @ low.T + down @ high.T
        most = up @ high.T + down @ low.T
        slack = 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
        least, most = least - slack, most + slack
    return np.nan_to_num(least, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(
        most, nan=np.inf, posinf=np.inf, neginf=-np.inf
    )


def _vectors(column: pa.Array, scale: int) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    with np.errstate(over="ignore"):
        values = np.floor(column.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _whole(rows: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, their vectors as whole numbers, with their place on the curve."""
    vector = F.col("vector").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf")))
    used = rows.select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"),
        F.coalesce("anchor", F.lit(False)).alias("anchor"), vector.alias("vector"),
    ).where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    low, high, width = used.agg(
        F.percentile_approx(F.array_min("vector"), 0.01),
        F.percentile_approx(F.array_max("vector"), 0.99), F.max(F.size("vector")),
    ).first()
    low, high, width = scale * (low or 0.0), scale * (high or 0.0), width or 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column("vector"), scale)
            matrix = _padded([v.tobytes() for v in vectors], width)
            step = (high - low) / (1 << BITS) or 1.0
            cells = np.clip((np.clip(matrix, low, high) - low) / step, 0, (1 << BITS) - 1)
            places = hilbert_places(cells.astype(np.int64), BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"), batch.column("anchor"),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    pa.array([p.tobytes() for p in places], pa.binary()),
                ],
                names=["vec_id", "label", "anchor", "vector", "place"],
            )

    return materialize(used.mapInArrow(place, _ROWS), "whole-vectors")


def _block(number: int, rows: list[dict]) -> dict:
    width = max(len(r["vector"]) for r in rows) // 8
    matrix = _padded([r["vector"] for r in rows], width)
    labels = np.array([r["label"] for r in rows], np.int64)
    ids = np.array([NO_ID if r["vec_id"] is None else r["vec_id"] for r in rows], np.int64)
    anchors = [
        {
            "uid": number * BLOCK_ROWS + i, "vec_id": r["vec_id"], "label": r["label"],
            "vector": r["vector"],
        }
        for i, r in enumerate(rows)
        if r["anchor"]
    ]
    return {
        "block": number, "n": len(rows), "width": width, "ids": ids.tobytes(),
        "labels": labels.tobytes(), "vectors": matrix.tobytes(),
        "low": matrix.min(axis=0).tobytes(), "high": matrix.max(axis=0).tobytes(),
        "least_label": int(labels.min()), "most_label": int(labels.max()), "anchors": anchors,
    }


def _arrow(spark_schema: str, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_arrow_schema(spark_schema))


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    anchor = pa.struct(
        [("uid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())]
    )
    fields = []
    for part in ddl.replace(_ANCHORS, "anchors").split(","):
        name, kind = part.split()
        fields.append((name, pa.list_(anchor) if kind == "anchors" else kinds[kind]))
    return pa.schema(fields)


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of neighbouring rows with their zone maps, one row each, written down."""
    width = max(1, (rows.agg(F.max(F.octet_length("vector"))).first()[0] or 0) // 8)
    size = max(16, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    slices = max(1, -(-rows.count() // (16 * size)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 31
        waiting: list[dict] = []
        for batch in batches:
            # In small steps: a batch of wide vectors is not turned into Python rows at once.
            for start in range(0, batch.num_rows, size):
                waiting += batch.slice(start, size).to_pylist()
                while len(waiting) >= size:
                    yield _arrow(_BLOCKS, [_block(number, waiting[:size])])
                    waiting, number = waiting[size:], number + 1
        if waiting:
            yield _arrow(_BLOCKS, [_block(number, waiting)])

    order = ["label", "place", "vec_id", "_copy"]
    # Copies of a row differ by where they are stored, so that many can be divided.
    numbered = rows.withColumn("_copy", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    columns = [c for c in rows.columns if c != "place"]
    return materialize(ranged.select(*columns).mapInArrow(cut, _BLOCKS), "vector-blocks")


def _packed_zones(blocks: DataFrame) -> DataFrame:
    """Zone maps, many to a row, numbered by ``pack``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 31
        for batch in batches:
            for start in range(0, batch.num_rows, ZONE_BLOCKS):
                part = batch.slice(start, ZONE_BLOCKS)
                width = max(part.column("width").to_pylist())
                ends = [
                    _padded(part.column(c).to_pylist(), width).tobytes() for c in ("low", "high")
                ]
                plain = [
                    part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                    for c in ("block", "least_label", "most_label")
                ]
                row = {"pack": number, "n": part.num_rows, "width": width}
                row |= dict(zip(("low", "high", "blocks", "least", "most"), ends + plain))
                yield _arrow(schema, [row])
                number += 1

    schema = (
        "pack bigint, n int, width int, low binary, high binary, blocks binary, "
        "least binary, most binary"
    )
    narrow = blocks.select("block", "width", "low", "high", "least_label", "most_label")
    return materialize(narrow.mapInArrow(pack, schema), "zone-maps")


def _chunked(anchors: DataFrame) -> DataFrame:
    """Anchors (uid, label, vector, lows, highs), many to a row, numbered by ``chunk``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 31
        waiting: list[dict] = []
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ANCHORS):
                waiting += batch.slice(start, CHUNK_ANCHORS).to_pylist()
                while len(waiting) >= CHUNK_ANCHORS:
                    yield _arrow(schema, [row(number, waiting[:CHUNK_ANCHORS])])
                    waiting, number = waiting[CHUNK_ANCHORS:], number + 1
        if waiting:
            yield _arrow(schema, [row(number, waiting)])

    def row(number: int, rows: list[dict]) -> dict:
        width = max(len(r["vector"]) for r in rows) // 8
        windows = max(len(r["lows"]) for r in rows)
        # A window whose ends are crossed holds nothing.
        lows = np.full((len(rows), windows), 1, np.int64)
        highs = np.zeros((len(rows), windows), np.int64)
        for i, r in enumerate(rows):
            lows[i, : len(r["lows"])], highs[i, : len(r["highs"])] = r["lows"], r["highs"]
        return {
            "chunk": number, "n": len(rows), "width": width, "windows": windows,
            "uids": np.array([r["uid"] for r in rows], np.int64).tobytes(),
            "labels": np.array([r["label"] for r in rows], np.int64).tobytes(),
            "vectors": _padded([r["vector"] for r in rows], width).tobytes(),
            "lows": lows.tobytes(), "highs": highs.tobytes(),
        }

    schema = f"chunk bigint, {_CHUNKS}"
    slices = max(1, -(-anchors.count() // (4 * CHUNK_ANCHORS)))
    ranged = anchors.repartitionByRange(slices, "uid").sortWithinPartitions("uid")
    return materialize(ranged.mapInArrow(pack, schema), "anchor-chunks")


def _matrix(data: bytes, n: int, kind: type = np.float64) -> np.ndarray:
    values = np.frombuffer(data, kind)
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def _meets(chunk: dict, pack: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors of a chunk need which blocks of a pack, and the upper bounds."""
    anchors = _matrix(chunk["vectors"], chunk["n"])
    low, high = _matrix(pack["low"], pack["n"]), _matrix(pack["high"], pack["n"])
    least, most = bounds(anchors, low, high)
    labels = np.frombuffer(chunk["labels"], np.int64)[:, None]
    first, last = (np.frombuffer(pack[c], np.int64)[None] for c in ("least", "most"))
    if same:
        needed = (first <= labels) & (labels <= last)
    else:
        needed = (first != labels) | (last != labels)
    lows, highs = (_matrix(chunk[c], chunk["n"], np.int64) for c in ("lows", "highs"))
    meets = np.zeros_like(needed)
    for w in range(lows.shape[1]):
        a, b = lows[:, w : w + 1], highs[:, w : w + 1]
        meets |= (a <= b) & (most >= a) & (least <= b)
    return needed & meets, most


def _pairs(chunks: DataFrame, zones: DataFrame):
    """Every chunk of anchors with every pack of zone maps, one row each, by keys."""
    # One number for every 512 anchors.
    numbers = chunks.agg(F.collect_list("chunk")).scalar()
    spread = zones.withColumn("chunks", numbers).withColumn("chunk", F.explode("chunks"))
    own = chunks.select(*(F.col(c).alias(f"a_{c}") for c in chunks.columns))
    both = spread.drop("chunks").join(own, F.col("chunk") == F.col("a_chunk"))
    return both.groupBy("chunk", "pack")


def _sides(row: dict) -> tuple[dict, dict]:
    """The chunk and the pack of a row of both."""
    chunk = {c.removeprefix("a_"): v for c, v in row.items() if c.startswith("a_")}
    return chunk, {c: v for c, v in row.items() if not c.startswith("a_")}


def _promising(chunks: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """(chunk, block, members): for every anchor the block with the highest upper bound."""

    def best(pairs: pa.Table) -> pa.Table:
        found = []
        for chunk, pack in map(_sides, pairs.to_pylist()):
            needed, most = _meets(chunk, pack, same)
            blocks = np.frombuffer(pack["blocks"], np.int64)
            at = np.where(needed, most, -np.inf).argmax(axis=1)
            rows = np.flatnonzero(needed.any(axis=1))
            found.append(
                pa.table(
                    {
                        "chunk": np.full(len(rows), chunk["chunk"]),
                        "member": rows.astype(np.int32), "block": blocks[at[rows]],
                        "most": most[rows, at[rows]],
                    }
                )
            )
        return pa.concat_tables(found)

    pairs = _pairs(chunks, zones).applyInArrow(
        best, "chunk bigint, member int, block bigint, most double"
    )
    one = pairs.groupBy("chunk", "member").agg(
        F.max_by("block", F.struct("most", "block")).alias("block")
    )
    return one.groupBy("chunk", "block").agg(F.collect_set("member").alias("members"))


def _needed(chunks: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """(chunk, block, members): the anchors of a chunk that must read a block."""

    def choose(pairs: pa.Table) -> pa.Table:
        rows = []
        for chunk, pack in map(_sides, pairs.to_pylist()):
            needed, _ = _meets(chunk, pack, same)
            blocks = np.frombuffer(pack["blocks"], np.int64)
            for b in np.flatnonzero(needed.any(axis=0)):
                members = np.flatnonzero(needed[:, b]).tolist()
                rows.append((chunk["chunk"], int(blocks[b]), members))
        names = ["chunk", "block", "members"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return _pairs(chunks, zones).applyInArrow(
        choose, "chunk bigint, block bigint, members array<int>"
    )


def _read(
    chosen: DataFrame, chunks: DataFrame, blocks: DataFrame, same: bool, k: int
) -> DataFrame:
    """The best ``k`` rows in each window of each anchor, from each tile of chosen blocks."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        read = right.to_pylist()
        for chunk in left.to_pylist() if read else []:
            anchors = _matrix(chunk["vectors"], chunk["n"])
            uids = np.frombuffer(chunk["uids"], np.int64)
            labels = np.frombuffer(chunk["labels"], np.int64)
            scores, allowed, ids, found = [], [], [], []
            for block in read:
                vectors = _matrix(block["vectors"], block["n"])
                scores.append(products(anchors, vectors))
                own = np.frombuffer(block["labels"], np.int64)
                numbers = block["block"] * BLOCK_ROWS + np.arange(block["n"])
                may = (labels[:, None] == own[None]) if same else (labels[:, None] != own[None])
                may &= uids[:, None] != numbers[None]
                reads = np.zeros(chunk["n"], bool)
                reads[block["members"]] = True
                allowed.append(may & reads[:, None])
                ids.append(np.frombuffer(block["ids"], np.int64))
                found.append(numbers)
            lows, highs = (_matrix(chunk[c], chunk["n"], np.int64) for c in ("lows", "highs"))
            parts += _best(
                np.concatenate(scores, axis=1), np.concatenate(allowed, axis=1),
                np.concatenate(ids), np.concatenate(found), uids, lows, highs, k,
            )
        return pa.concat_tables(parts) if parts else _arrow_schema(_FOUND).empty_table()

    payload = blocks.select("block", "n", "ids", "labels", "vectors")
    tile = F.col("block").bitwiseAND(F.lit(-TILE_BLOCKS))
    reads = chosen.join(payload, "block").withColumn("tile", tile)
    tiles = chosen.select(F.col("chunk").alias("to_chunk"), tile.alias("to_tile")).distinct()
    copies = tiles.join(chunks, F.col("to_chunk") == F.col("chunk")).drop("chunk")
    left = copies.groupBy("to_chunk", "to_tile")
    return left.cogroup(reads.groupBy("chunk", "tile")).applyInArrow(score, _FOUND)


def _best(
    scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, found: np.ndarray,
    uids: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int,
) -> list[pa.Table]:
    parts = []
    for w in range(lows.shape[1]):
        a, b = lows[:, w : w + 1], highs[:, w : w + 1]
        inside = allowed & (scores >= a) & (scores <= b)
        held = np.where(inside, scores, _LEAST)
        if held.shape[1] > k:
            kth = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
            inside &= held >= kth[:, None]
        row, at = np.nonzero(inside)
        # Ties at the k-th score are settled by id.
        order = np.lexsort((found[at], ids[at], -scores[row, at].astype(np.float64), row))
        order = _refined(order, row, scores[row, at], ids[at], found[at])
        row, at = row[order], at[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, at = row[rank < k], at[rank < k]
        parts.append(
            pa.table(
                {
                    "uid": uids[row], "at": np.full(len(row), w, np.int32),
                    "score": scores[row, at], "found_id": ids[at], "found_uid": found[at],
                }
            )
        )
    return parts


def _refined(
    order: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, found: np.ndarray
) -> np.ndarray:
    """The order by exact scores, where doubles cannot tell them apart."""
    if not len(score) or np.abs(score.astype(np.float64)).max() < _EXACT:
        return order
    keys = zip(row.tolist(), (-s for s in score.tolist()), ids.tolist(), found.tolist())
    return np.array([i for _, i in sorted(zip(keys, range(len(row))))], np.int64)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per anchor and window over all tiles, in order, as an array ``best``."""
    item = F.struct(
        (-F.col("score").cast("decimal(20,0)")).alias("down"), "found_id", "found_uid", "score"
    )
    return found.groupBy("uid", "at").agg(
        F.slice(F.sort_array(F.collect_list(item)), 1, k).alias("best")
    )


def search(
    anchors: DataFrame, blocks: DataFrame, zones: DataFrame, *, same: bool, k: int
) -> tuple[DataFrame, DataFrame]:
    """(uid, at, best): in each window of each anchor, by number, the best ``k`` rows with the
    anchor's label (``same``) or with any other; and the (chunk, block, members) read for it.
    ``anchors`` has uid, label, vector, lows and highs."""
    chunks = _chunked(anchors)
    first = materialize(_promising(chunks, zones, same), "promising-blocks")
    seen = materialize(_top(_read(first, chunks, blocks, same, k), k), "promising-rows")
    # A window that is full already takes nothing below its last.
    full = seen.where(F.size("best") == k).select(
        "uid", "at", F.element_at("best", -1)["score"].alias("low")
    )
    raised = full.groupBy("uid").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "low"))).alias("raised")
    )
    narrowed = anchors.join(raised, "uid", "left").withColumn(
        "lows",
        F.transform(
            "lows", lambda low, i: F.greatest(low, F.coalesce(F.col("raised")[i], low))
        ),
    )
    chunks = _chunked(narrowed.drop("raised"))
    chosen = materialize(_needed(chunks, zones, same), "needed-blocks")
    return materialize(_top(_read(chosen, chunks, blocks, same, k), k), "found-rows"), chosen


def mine(
    rows: DataFrame, *, positives: int = 5, negatives: int = 5, scale: int = 256,
    least: int = 80, most: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label, vector (an array of numbers) and anchor (boolean). An anchor's
    positives are the ``positives`` other rows of its label with the highest inner product; the
    negatives of a positive, the ``negatives`` highest rows of other labels with
    ``least * positive_score <= 100 * score <= most * positive_score``. Components become
    floor(scale * x) first; ties go to the smaller id.

    Rows with a NULL label, a NULL vector, or a component that is NULL or has no finite value
    after scaling take no part. A NULL id sorts after all others. A shorter vector counts as
    filled up with zeros. Copies of a row are rows of their own: an anchor can be its copy's
    positive, and two anchors of one id give their rows twice. Scores beyond a long are held at
    the ends of its range. An anchor without positives, or a positive without negatives, gives
    no row; an empty table gives none. Columns beyond the four are not looked at.
    """
    blocks = blocks_of(_whole(rows, scale))
    zones = _packed_zones(blocks)
    anchors = blocks.select(F.explode("anchors").alias("a")).select("a.*")
    anchors = materialize(anchors, "anchors")
    whole = F.array(F.lit(int(_LEAST))), F.array(F.lit(int(_MOST)))
    wide = anchors.select("uid", "label", "vector", whole[0].alias("lows"), whole[1].alias("highs"))
    near, _ = search(wide, blocks, zones, same=True, k=positives)
    held = anchors.join(near.select("uid", "best"), "uid")
    windowed = materialize(
        held.select(
            "uid", "vec_id", "label", "vector", "best",
            F.transform("best", lambda p: _ceiling(p["score"], least)).alias("lows"),
            F.transform("best", lambda p: _floor(p["score"], most)).alias("highs"),
        ),
        "windows",
    )
    far, _ = search(
        windowed.select("uid", "label", "vector", "lows", "highs"), blocks, zones,
        same=False, k=negatives,
    )
    return _result(windowed, far)


def _exact(value: Column) -> Column:
    return value.cast("decimal(30,0)")


def _ceiling(score: Column, percent: int) -> Column:
    """The least whole number that is not under a share of ``score``."""
    share = _exact(score) * F.lit(percent)
    return _long(F.ceil(share / F.lit(100)))


def _floor(score: Column, percent: int) -> Column:
    return _long(F.floor(_exact(score) * F.lit(percent) / F.lit(100)))


def _long(value: Column) -> Column:
    least, most = (F.lit(int(end)).cast("decimal(20,0)") for end in (_LEAST, _MOST))
    return F.greatest(F.least(value, most), least).cast("bigint")


def _result(windowed: DataFrame, far: DataFrame) -> DataFrame:
    def known(found: Column) -> Column:
        return F.when(found != F.lit(int(NO_ID)), found)

    hits = windowed.select("uid", F.col("vec_id").alias("anchor_id"), F.posexplode("best")).select(
        "uid", "anchor_id", F.col("pos").alias("at"),
        known(F.col("col")["found_id"]).alias("positive_id"),
        F.col("col")["score"].alias("positive_score"),
    )
    found = far.select("uid", "at", F.posexplode("best"))
    joined = hits.join(found, ["uid", "at"])
    return joined.select(
        "anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"),
        known(F.col("col")["found_id"]).alias("negative_id"), "positive_score",
        F.col("col")["score"].alias("negative_score"),
    )
