"""Packing pieces into sequences of a fixed capacity, as few as possible.

Only the histogram of lengths matters, and it has no more entries than the capacity. On it
a configuration linear program is solved: a configuration is a multiset of lengths that
fits one sequence, and the fractional number of sequences of each is sought. Prices of the
lengths follow multiplicative weights, which rise for what lags behind in coverage; the
configuration of the highest price comes from a knapsack dynamic program. The fractions are
rounded, and what remains is placed by best fit into free space and new sequences.

The plan says which ranks of a length go where. The rows are ranked within their length and
look their place up; no task holds more rows of one length than ``BUCKET_ROWS``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from orebed.session import materialize

BUCKET_ROWS = 20_000
ROUNDS = 1_500
STEP = 0.34
#: (how fast prices follow coverage, power of the length that they begin with). The second
#: suits lengths few of which fit together. All are tried, as are the ways to round.
PRICES = ((0.5, 1.05), (0.1, 1.3))
#: A fraction of 1 less this is rounded up; the plan with the fewest sequences is taken.
ROUND_UP = (1e-9, 0.25, 0.5)


def _best_configuration(price: np.ndarray) -> dict[int, int]:
    """Lengths, with repetition, of the highest total price within the capacity.
    ``price[l]`` is that of length l, negative if there is none."""
    capacity = len(price) - 1
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    backwards = np.zeros(capacity + 1)  # best, from the end, so that slices are contiguous
    for room in range(1, capacity + 1):
        worth = backwards[capacity - room + 1 :] + price[1 : room + 1]
        take = int(worth.argmax())
        if worth[take] > best[room - 1]:
            best[room], choice[room] = worth[take], take + 1
        else:
            best[room] = best[room - 1]
        backwards[capacity - room] = best[room]
    found: dict[int, int] = {}
    room = capacity
    while room > 0:
        length = int(choice[room])
        if length == 0:
            room -= 1
            continue
        found[length] = found.get(length, 0) + 1
        room -= length
    return found


def _fractional(
    counts: np.ndarray, rounds: int, step: float, eta: float, exponent: float
) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations and how many sequences of each; no length is covered beyond its count."""
    # Longer pieces are worth more than their length: short ones fit anywhere later.
    size = np.arange(len(counts), dtype=float) ** exponent
    demand = np.maximum(counts, 1).astype(float)
    left = counts.astype(float)
    found: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        open_ = left > 1e-9
        if not open_.any():
            break
        behind = left / demand
        weight = np.exp(eta * (behind - behind[open_].mean()))
        wanted = _best_configuration(np.where(open_, size * weight, -1.0))
        fitting = {l: min(n, int(np.ceil(left[l] - 1e-9))) for l, n in wanted.items()}
        amount = min(
            min(step * counts[l], left[l]) / n for l, n in fitting.items()
        )
        key = tuple(sorted(fitting.items(), reverse=True))
        found[key] = found.get(key, 0.0) + amount
        for l, n in fitting.items():
            left[l] = max(0.0, left[l] - amount * n)
    return found


def _best_fit(
    groups: list[tuple[dict[int, int], int]], left: np.ndarray, capacity: int
) -> list[tuple[dict[int, int], int]]:
    """Place the lengths still ``left``, longest first, where least space remains."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = 0  # bit r is set if some sequence has r tokens left
    for items, copies in groups:
        room = capacity - sum(l * n for l, n in items.items())
        by_room.setdefault(room, []).append((items, copies))
        rooms |= 1 << room
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            ahead = rooms >> length
            if not ahead:
                each = min(capacity // length, todo)
                copies = todo // each
                room, items = capacity - each * length, {length: each}
                todo -= each * copies
            else:
                room = length + (ahead & -ahead).bit_length() - 1
                items, have = by_room[room].pop()
                each = min(room // length, todo)
                copies = min(have, todo // each)
                if have > copies:
                    by_room[room].append((items, have - copies))
                if not by_room[room]:
                    rooms ^= 1 << room
                items = {**items, length: items.get(length, 0) + each}
                room -= each * length
                todo -= each * copies
            by_room.setdefault(room, []).append((items, copies))
            rooms |= 1 << room
    return [group for same in by_room.values() for group in same]


def _rounded(
    groups: list[tuple[dict[int, int], int]], fractions: list, left: np.ndarray, capacity: int,
    up: float,
) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of sequences, and the rest by best fit; a fraction of ``1 - up`` and
    over is rounded up as long as there are pieces for it."""
    groups, left = list(groups), left.copy()
    for key, amount in fractions:
        copies = min([int(amount + up), *(int(left[l]) // n for l, n in key)])
        if copies:
            groups.append((dict(key), copies))
            for l, n in key:
                left[l] -= copies * n
    return _best_fit(groups, left, capacity)


def plan_sequences(
    histogram: Mapping[int, int], capacity: int, *, rounds: int = ROUNDS, step: float = STEP
) -> list[tuple[dict[int, int], int]]:
    """Groups of equal sequences: how many pieces of each length, and how many sequences."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        counts[length] = count
    groups: list[tuple[dict[int, int], int]] = []
    if counts[capacity]:
        groups.append(({capacity: 1}, int(counts[capacity])))
    left = counts.copy()
    left[capacity] = 0
    plans = []
    for eta, exponent in PRICES:
        fractions = sorted(
            _fractional(left, rounds, step, eta, exponent).items(),
            key=lambda item: (-item[1], item[0]),
        )
        plans += [_rounded(groups, fractions, left, capacity, up) for up in ROUND_UP]
    return min(plans, key=lambda plan: sum(copies for _, copies in plan))


def _places(groups: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for items, copies in groups:
        offset = 0
        for length, each in sorted(items.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + each * copies
            offset += each * length
        sequence += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(
    pieces: DataFrame, capacity: int, *, bucket_rows: int = BUCKET_ROWS, rounds: int = ROUNDS
) -> DataFrame:
    """``pieces`` with sequence_id (from 0) and offset, gapless within a sequence.

    ``pieces`` has a column ``length`` from 1 to ``capacity`` (anything else is an error) and
    orderable columns besides; all of them are written to the shared folder once. Repeated
    rows each get a place; an empty table stays empty. Columns sequence_id and offset of the
    input are replaced, and names that start with an underscore are used inside.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset"), "pieces")
    columns = pieces.columns
    histogram = {
        row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()
    }
    places = _places(plan_sequences(histogram, capacity, rounds=rounds))
    spread = F.greatest(F.lit(1), F.ceil(F.col("count") / F.lit(bucket_rows)))
    buckets = pieces.sparkSession.createDataFrame(
        list(histogram.items()) or [(0, 0)], "length bigint, count bigint"
    ).select(F.col("length").cast(pieces.schema["length"].dataType), spread.alias("_spread"))
    salted = pieces.join(F.broadcast(buckets), "length").withColumn(
        "_bucket", F.pmod(F.xxhash64(*columns), F.col("_spread"))
    )
    keys = ["length", "_bucket"]
    earlier = (
        Window.partitionBy("length").orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).select(
        *keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    order = [name for name in columns if name != "length"] or ["length"]
    ranked = (
        salted.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .join(before, keys)
        .select(*columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    )
    schema = StructType([*pieces.schema.fields]).add("sequence_id", LongType())
    schema = schema.add("offset", LongType())
    # Length and rank in one number, in the order of the plan's rows.
    most = max(histogram.values(), default=0) + 1
    starts = places[:, 0] * most + places[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy()
            place = places[np.searchsorted(starts, length * most + rank, side="right") - 1]
            number, slot = np.divmod(rank - place[:, 1], place[:, 3])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in columns),
                    pa.array(place[:, 2] + number), pa.array(place[:, 4] + slot * length),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(look_up, schema)
