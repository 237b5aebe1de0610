"""Conversations repaired at least cost, by Knuth's lightest derivations.

A conversation is legal if the initials of its roles are empty or an optional s followed by
one or more times ua. Each row may be kept, given another role or deleted, and empty rows may be
inserted; of the cheapest ways the one whose audit (initials of the edits) is least counts.

An item (row, state) stands for the best way to edit everything from that row on, if what
came before leads to that state. Deductions add one edit in front of an item that is derived.
Their weights are (cost, rows behind, audit): an edit never makes a weight smaller, and keeps the
order of two weights, so the lightest item on the agenda is final when it is popped.

A long conversation is cut into segments of bounded length. Those are solved side by side, for
every pair of states at their ends; the whole is a derivation over segments, each deduction
joining a segment with what follows it. Within one pair no audit begins with another, so ties
between different next states are settled inside one segment, and audits need not be compared
over segments.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.session import materialize

SEGMENT_ROWS = 1024
#: Rows that a task sorts, about.
SLICE_ROWS = 100_000
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"

KEEP, REROLE, DELETE, INSERT = "KRDI"
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
#: States: nothing yet, after the system's row, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where an inserted row, or one that is given another role, leads.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Where a kept row leads: its initial and the state before it.
KEPT = {
    ("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER,
    ("a", USER): ASSISTANT,
}
#: Insertions that a conversation needs at its end.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL_PAIRS = ("su", "ua", "au")
ROLE = {USER: "user", ASSISTANT: "assistant"}

Weight = tuple


def lightest(
    axioms: Iterable[tuple[Hashable, Weight]],
    conclusions: Callable[[Hashable, Weight], Iterable[tuple[Hashable, Weight]]],
    goals: frozenset = frozenset(),
) -> dict[Hashable, Weight]:
    """The lightest weight of every item that can be derived, or of ``goals`` at least.

    ``conclusions`` names what an item that is final derives together with others; their
    weights must be superior: not lighter than the item's, and in the order of its weights.
    """
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict[Hashable, Weight] = {}
    missing = set(goals)
    while agenda and (missing or not goals):
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        missing.discard(item)
        for other, heavier in conclusions(item, weight):
            if other not in final:
                heapq.heappush(agenda, (heavier, other))
    return final


#: A row as the derivation sees it: initial (s, u, a or ?), whether it must go, whether it is
#: truncated, and how many rows it stands for; all but the first of those must go.
Row = tuple[str, bool, bool, int]


@lru_cache(maxsize=1 << 14)
def solve_segment(rows: tuple[Row, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state behind): cost and audit of the best way to edit the rows, where
    nothing is inserted behind the last."""
    last = len(rows)

    def conclusions(item: tuple, weight: Weight) -> Iterator[tuple[tuple, Weight]]:
        at, state, end = item
        cost, behind, audit = weight
        if at < last:
            for before in STATES:
                if TURN[before] == state:
                    yield (at, before, end), (cost + INSERT_COST, behind, INSERT + audit)
        if at == 0:
            return
        initial, must_go, truncated, copies = rows[at - 1]
        more, audit = cost + DELETE_COST * (copies - 1), DELETE * (copies - 1) + audit
        behind += 1
        yield (at - 1, state, end), (more + DELETE_COST, behind, DELETE + audit)
        if must_go:
            return
        more += TRUNCATED_COST * truncated
        for before in STATES:
            if KEPT.get((initial, before)) == state:
                yield (at - 1, before, end), (more, behind, KEEP + audit)
            if TURN[before] == state:
                yield (at - 1, before, end), (more + REROLE_COST, behind, REROLE + audit)

    axioms = [((last, state, state), (0, 0, "")) for state in STATES]
    # All goals that can be derived; (0, before, end) need not all be.
    final = lightest(axioms, conclusions)
    return {
        (before, end): (weight[0], weight[2])
        for (at, before, end), weight in final.items()
        if at == 0
    }


def solve_segments(tables: list[dict[tuple[int, int], tuple[int, int]]]) -> tuple[int, list]:
    """Cost, and the pair of states of every segment, of the best way through all. Tables hold
    cost and rank of audit, by pair of states."""
    last = len(tables)

    def conclusions(item: tuple, weight: Weight) -> Iterator[tuple[tuple, Weight]]:
        at, state = item
        if at == 0:
            return
        for (before, end), (cost, rank) in tables[at - 1].items():
            if end == state:
                yield (at - 1, before), (weight[0] + cost, last - at + 1, rank, state)

    axioms = [((last, s), (INSERT_COST * len(TAIL[s]), 0, 0, s)) for s in STATES]
    final = lightest(axioms, conclusions, frozenset([(0, START)]))
    pairs, state = [], START
    for at in range(last):
        after = final[at, state][3]
        pairs.append((state, after))
        state = after
    return final[0, START][0], pairs


def faults(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text), equal ones as one with their number ``n``; with
    ``blank`` and ``seen``, whether an earlier row has the role and text."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    trimmed = F.rtrim("text", F.lit(SPACE))
    same = materialize(
        same.select(
            "*", (trimmed == "").alias("blank"),
            (~F.substring(trimmed, -1, 1).isin(*STOPS)).alias("open"),
            F.unhex(F.sha2(F.concat(F.hex("role"), F.lit(":"), "text"), 256)).alias("digest"),
        ),
        "conversation-rows",
    )
    first = same.groupBy("conv_id", "digest").agg(
        F.max(F.col("turn").isNull()).alias("f_null"), F.min("turn").alias("f_turn")
    )
    first = first.select(
        F.col("conv_id").alias("f_conv"), F.col("digest").alias("f_digest"), "f_null", "f_turn"
    )
    joined = same.join(
        first,
        F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("digest") == F.col("f_digest")),
    )
    is_first = F.when(F.col("f_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("f_turn"))
    return joined.select(
        "conv_id", "turn", "role", "text", "n", "blank", "open", (~is_first).alias("seen")
    )


def _segments(rows: DataFrame) -> DataFrame:
    """The rows with ``slice``, ``segment`` and ``place`` of each, written down. Long
    conversations are cut along their order."""
    order = ["conv_id", "turn", "role", "text"]
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    ranged = rows.repartitionByRange(slices, *order)
    cut = materialize(ranged.withColumn("slice", F.spark_partition_id()), "conversation-slices")
    keys, along = ", ".join(["slice", "conv_id"]), ", ".join(order[1:])
    place = F.expr(f"row_number() OVER (PARTITION BY {keys} ORDER BY {along})")
    return cut.withColumn("place", place).withColumn(
        "segment", F.floor((F.col("place") - 1) / SEGMENT_ROWS).cast("int")
    )


def _initial() -> Column:
    initial = F.substring("role", 1, 1)
    return F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("?"))


def _solved(rows: DataFrame) -> DataFrame:
    """One row per segment: cost and audit for each pair of states, and its own illegal pairs."""
    seen = F.struct(
        "place", _initial().alias("initial"), (F.col("blank") | F.col("seen")).alias("must_go"),
        F.col("open").alias("truncated"), "n",
    )
    segments = rows.groupBy("conv_id", "slice", "segment").agg(
        F.sort_array(F.collect_list(seen)).alias("rows")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few at a time: a table holds up to 16 audits of its length.
            for start in range(0, batch.num_rows, 64):
                yield solved(batch.slice(start, 64))

    def solved(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables, illegal, ends = [], [], []
        for row in batch.column("rows").to_pylist():
            own = tuple((r["initial"], r["must_go"], r["truncated"], r["n"]) for r in row)
            ranked = {}
            found = solve_segment(own)
            for rank, (pair, (cost, audit)) in enumerate(
                sorted(found.items(), key=lambda x: (x[1][1], x[0]))
            ):
                ranked[pair] = (cost, rank, audit)
            tables.append(
                [
                    {"before": b, "after": a, "cost": c, "rank": k, "audit": t}
                    for (b, a), (c, k, t) in ranked.items()
                ]
            )
            initials = [r[0] for r in own]
            between = sum(x + y not in LEGAL_PAIRS for x, y in zip(initials, initials[1:]))
            illegal.append(between + sum(r[3] - 1 for r in own))
            ends.append(initials[0] + initials[-1])
        pair = pa.struct(
            [("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()),
             ("rank", pa.int32()), ("audit", pa.string())]
        )
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("conv_id", "slice", "segment")),
                pa.array(tables, pa.list_(pair)), pa.array(illegal, pa.int64()), pa.array(ends),
            ],
            names=["conv_id", "slice", "segment", "pairs", "illegal", "ends"],
        )

    schema = (
        f"conv_id {kind}, slice int, segment int, "
        "pairs array<struct<before: int, after: int, cost: bigint, rank: int, audit: string>>, "
        "illegal bigint, ends string"
    )
    return materialize(segments.mapInArrow(solve, schema), "conversation-segments")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one conversation at a time, from rows in order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["conv_id"] != row["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _chosen(solved: DataFrame) -> DataFrame:
    """(conv_id, slice, segment, audit, total, illegal): the audit of every segment in the best
    way through its conversation, and that conversation's cost and illegal pairs."""
    narrow = solved.select(
        "conv_id", "slice", "segment", "illegal", "ends",
        F.transform("pairs", lambda p: F.struct(p["before"], p["after"], p["cost"], p["rank"]))
        .alias("pairs"),
    )
    kind = solved.schema["conv_id"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for run in _runs(batches):
            tables = [
                {(p["before"], p["after"]): (p["cost"], p["rank"]) for p in r["pairs"]} for r in run
            ]
            total, pairs = solve_segments(tables)
            borders = sum(
                a["ends"][1] + b["ends"][0] not in LEGAL_PAIRS for a, b in zip(run, run[1:])
            )
            illegal = borders + sum(r["illegal"] for r in run)
            out += [
                (r["conv_id"], r["slice"], r["segment"], *pair, total, illegal)
                for r, pair in zip(run, pairs)
            ]
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["c_conv", "c_slice", "c_segment", "before", "after", "total", "c_illegal"]
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))

    schema = (
        f"c_conv {kind}, c_slice bigint, c_segment bigint, before bigint, after bigint, "
        "total bigint, c_illegal bigint"
    )
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "segment")
    ways = ordered.mapInArrow(choose, schema)
    here = (
        F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("slice") == F.col("c_slice"))
        & (F.col("segment") == F.col("c_segment"))
    )
    way = F.filter(
        "pairs", lambda p: (p["before"] == F.col("before")) & (p["after"] == F.col("after"))
    )
    return solved.join(ways, here).select(
        "conv_id", "slice", "segment", way[0]["audit"].alias("audit"), "total",
        F.col("c_illegal").alias("illegal"),
    )


def _applied(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, cost, illegal, audit, repaired_sha256), one row per conversation.

    A digest of a whole conversation has to see its rows in order, so one task streams them;
    it holds one row, the running digest and the audit."""
    nothing = F.lit(None)
    marks = chosen.select(
        "conv_id", "slice", "segment", F.lit(0).alias("place"), "audit", "total", "illegal",
        nothing.cast("string").alias("role"), nothing.cast("string").alias("text"),
        nothing.cast("bigint").alias("n"),
    )
    lines = rows.select(
        "conv_id", "slice", "segment", "place", nothing.cast("string").alias("audit"),
        nothing.cast("bigint").alias("total"), nothing.cast("bigint").alias("illegal"),
        "role", "text", "n",
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        done: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if now is None or now.conv_id != row["conv_id"]:
                        if now is not None:
                            done.append(now.result())
                        now = _Repair(row["conv_id"])
                    now.take(row)
                if len(done) >= 1024:
                    yield table(done)
                    done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield table(done)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "cost", "illegal", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))

    both = marks.unionByName(lines).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", "slice", "segment", "place")
    return ordered.mapInArrow(
        apply, f"conv_id {kind}, cost bigint, illegal bigint, audit string, repaired_sha256 string"
    )


class _Repair:
    """One conversation while its rows pass by: first a segment's audit, then its rows."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id = conv_id
        self.state, self.empty = START, True
        self.digest = hashlib.sha256()
        self.audits: list[str] = []
        self.at = self.total = self.illegal = 0

    def take(self, row: dict) -> None:
        if row["audit"] is not None:
            self.audits.append(row["audit"])
            self.at, self.total, self.illegal = 0, row["total"], row["illegal"]
            return
        audit = self.audits[-1]
        while audit[self.at] == INSERT:
            self.insert()
            self.at += 1
        edit = audit[self.at]
        if edit == KEEP:
            self.state = KEPT[row["role"][:1], self.state]
            self.emit(row["role"], row["text"])
        elif edit == REROLE:
            self.state = TURN[self.state]
            self.emit(ROLE[self.state], row["text"])
        self.at += row["n"]

    def insert(self) -> None:
        self.state = TURN[self.state]
        self.emit(ROLE[self.state], "")

    def emit(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def result(self) -> tuple:
        tail = TAIL[self.state]
        for _ in tail:
            self.insert()
        self.audits.append(tail)
        audit = "".join(self.audits)
        return self.conv_id, self.total, self.illegal, audit, self.digest.hexdigest()


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per
    conversation of ``rows`` (conv_id, turn, role, text), and of ``ids`` (conv_id) if given.

    Rows of a conversation stand by turn, a NULL turn first, and within a turn by role and text.
    A NULL role or text is one space; a NULL conv_id is a conversation like others, and an id may
    be of any orderable type. A row's first fault counts: blank, duplicate (role and text seen
    earlier, so also a repeated row), truncated (its last character that is no white space is
    none of .!?). Blank and duplicate rows are deleted. A role is known by its first character;
    one that is not s, u or a can only be deleted or given another role. ``gaps`` counts turns
    missing between the first and the last. An id without rows has zeros, an empty audit and
    the digest of an empty text, and an empty table gives no rows. Other columns are not looked at.
    """
    space = F.lit(" ")
    rows = rows.select(
        "conv_id", F.col("turn").cast("bigint"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    judged = _segments(faults(rows))
    n, blank, seen = F.col("n"), F.col("blank"), F.col("seen")
    zero = F.lit(0)
    # All but the first of equal rows are duplicates too.
    again = F.when(blank, zero).when(seen, n).otherwise(n - 1)
    cut = F.when(~blank & ~seen & F.col("open"), 1).otherwise(zero)
    wide = F.col("turn").cast("decimal(20,0)")
    counts = judged.groupBy("conv_id").agg(
        (F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(blank, n).otherwise(zero)).alias("blank"),
        F.sum(again).alias("duplicate"), F.sum(cut).alias("truncated"),
    )
    solved = _applied(judged, _chosen(_solved(judged)))
    ids = rows.select("conv_id") if ids is None else ids.select("conv_id")
    out = ids.distinct()
    for part, prefix in ((counts, "n_"), (solved, "r_")):
        part = part.select(*(F.col(c).alias(prefix + c) for c in part.columns))
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(prefix + "conv_id")), "left")

    def number(column: str) -> Column:
        return F.coalesce(F.col(column), zero).cast("bigint")

    most = F.lit(2**63 - 1).cast("decimal(20,0)")
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", F.least(F.coalesce("n_gaps", zero), most).cast("bigint").alias("gaps"),
        *(number(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated")),
        number("r_illegal").alias("illegal"), number("r_cost").alias("cost"),
        F.coalesce("r_audit", F.lit("")).alias("audit"),
        F.coalesce("r_repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults by CRC-32 of "conv_id:turn" modulo 20:
    0 drops a row, 1 empties its text, 2 takes its .!? away, 3 repeats it, 4 makes it the
    user's. A NULL is one space."""
    space = F.lit(" ")
    key = F.concat_ws(
        ":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    )
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    damaged = rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, STOPS, ""))
        .otherwise(text).alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return damaged.select("conv_id", "turn", "role", "text", F.explode(times)).drop("col")
