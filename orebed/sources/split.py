"""Long payloads cut at the borders of their array's elements, by many tasks at once.

A payload may be one line of any length, which a line reader gives to a single task. Here
files are read in pieces, cut wherever a comma stands, and what each piece does to the reader's
state is found without knowing that state: whether it flips being inside a text, which brackets
it closes that others opened and which it leaves open. Put together in order, one entry per
piece, this says in what state every piece begins; then all pieces name the elements that lie
within them, and those that span pieces are joined from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebed.session import materialize

#: Brackets open within each other, at most; JSON readers take no more either.
DEEPEST = 1000
#: How far back a bracket's name is looked for.
LOOK_BACK = 4096
LINE, HEAD, THROUGH, TAIL = "line", "head", "through", "tail"

_QUOTE, _BACKSLASH, _COMMA, _OPEN_LIST = 34, 92, 44, 91


class SplitError(ValueError):
    """A file is no sequence of complete JSON payloads."""


def _unescaped_quotes(data: np.ndarray) -> np.ndarray:
    quotes = data == _QUOTE
    slashes = data == _BACKSLASH
    if slashes.any():
        at = np.arange(len(data))
        last_other = np.maximum.accumulate(np.where(slashes, -1, at))
        run = np.zeros(len(data), np.int64)
        run[1:] = at[:-1] - last_other[:-1]
        quotes &= run % 2 == 0
    return quotes


def _steps(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(+1 or -1 at brackets outside texts, where texts are not, whether the end is inside)."""
    parity = np.cumsum(_unescaped_quotes(data)) + inside
    outside = parity % 2 == 0
    steps = np.zeros(len(data), np.int64)
    steps[(data == 91) | (data == 123)] = 1
    steps[(data == 93) | (data == 125)] = -1
    steps[~outside] = 0
    return steps, outside, bool(parity[-1] % 2) if len(data) else inside


def _name_before(text: bytes, at: int) -> str | None:
    """The name of the value that begins at ``at``."""
    before = text[max(0, at - LOOK_BACK) : at].rstrip()
    if not before.endswith(b":"):
        return None
    before = before[:-1].rstrip()
    first = before.rfind(b'"', 0, len(before) - 1)
    return before[first + 1 : -1].decode("utf-8", "replace") if first >= 0 else None


@dataclass
class State:
    """Where a reader is: inside a text or not, the brackets that are open with the names of
    their values, and how many it has closed that were open before it began."""

    inside: bool = False
    closed: int = 0
    open: list[tuple[int, str | None]] = field(default_factory=list)
    possible: bool = True
    before: bytes = b""

    def read(self, chunk: bytes) -> None:
        if not self.possible or not chunk:
            return
        data = np.frombuffer(chunk, np.uint8)
        steps, _, self.inside = _steps(data, self.inside)
        at = np.flatnonzero(steps)
        depth = np.cumsum(steps[at])
        text = self.before + chunk
        if len(at):
            pops = max(0, -int(depth.min()))
            self.closed += max(0, pops - len(self.open))
            del self.open[max(0, len(self.open) - pops) :]
            stays = (steps[at] > 0) & (np.minimum.accumulate(depth[::-1])[::-1] == depth)
            if len(self.open) + int(stays.sum()) > DEEPEST:
                self.possible = False
                return
            for i in at[stays].tolist():
                self.open.append((int(data[i]), _name_before(text, i + len(self.before))))
        self.before = text[-LOOK_BACK:]

    def then(self, closed: int, opened: list[tuple[int, str | None]], inside: bool) -> State:
        """The state after a piece that does this."""
        if closed > len(self.open):
            raise SplitError("a bracket is closed that was never opened")
        kept = self.open[: len(self.open) - closed]
        return State(inside, 0, [*kept, *opened])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, bytes]]:
    """(file, start, whether a piece begins, its bytes), chunk by chunk in order."""
    last = None
    for batch in batches:
        files, starts = (batch.column(c).to_numpy() for c in ("file", "start"))
        edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
        cuts = [0, *edges.tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            values = batch.column("value").slice(low, high - low).cast(pa.string())
            listed = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            chunk = pc.binary_join(listed, ",")[0].as_buffer().to_pybytes()
            # Line ends stand between values only, where a space does as well.
            chunk = chunk.replace(b"\n", b" ").replace(b"\r", b" ")
            key = (int(files[low]), int(starts[low]))
            # Every text but a file's first follows a comma.
            first = key != last
            yield *key, first, chunk if first and key[1] == 0 else b"," + chunk
            last = key


def _texts(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.option("lineSep", ",").text(path)
    return texts.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _summaries(texts: DataFrame) -> DataFrame:
    """What every piece does, begun outside a text and begun inside one."""
    way = "struct<possible: boolean, inside: boolean, closed: bigint, brackets: array<int>, names: array<string>>"
    schema = f"file bigint, start bigint, ways array<{way}>"
    kind = pa.struct(
        [("possible", pa.bool_()), ("inside", pa.bool_()), ("closed", pa.int64()),
         ("brackets", pa.list_(pa.int32())), ("names", pa.list_(pa.string()))]
    )

    def row(key: tuple[int, int], states: list[State]) -> pa.RecordBatch:
        ways = [
            {
                "possible": s.possible, "inside": s.inside, "closed": s.closed,
                "brackets": [b for b, _ in s.open], "names": [n for _, n in s.open],
            }
            for s in states
        ]
        arrays = [pa.array([key[0]]), pa.array([key[1]]), pa.array([ways], pa.list_(kind))]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "start", "ways"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, []
        for file, start, first, chunk in _pieces(batches):
            if first:
                if key is not None:
                    yield row(key, states)
                key, states = (file, start), [State(False), State(True)]
            for state in states:
                state.read(chunk)
        if key is not None:
            yield row(key, states)

    return texts.mapInArrow(summarise, schema)


def _beginnings(summaries: DataFrame) -> dict[tuple[int, int], State]:
    """The state in which every piece begins. One small entry per piece is held on the driver,
    which keeps its list of pieces to read anyway."""
    out: dict[tuple[int, int], State] = {}
    now, last = State(), None
    # Sorted here: a sort in Spark would read all files once more for its ranges.
    for r in sorted(summaries.collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != last:
            _complete(now)
            now, last = State(), r["file"]
        out[r["file"], r["start"]] = now
        way = r["ways"][int(now.inside)]
        if not way["possible"]:
            raise SplitError("brackets are open too deep within each other")
        now = now.then(way["closed"], list(zip(way["brackets"], way["names"])), way["inside"])
    _complete(now)
    return out


def _complete(state: State) -> None:
    if state.inside or state.open:
        raise SplitError("a file ends within a payload")


def _is_target(bracket: int, name: str | None, root: int, array: str) -> bool:
    return bracket == _OPEN_LIST and name == array and root == 123


class _Cutter:
    """Elements of one piece, chunk by chunk."""

    def __init__(self, begin: State, array: str) -> None:
        self.array, self.inside, self.open = array, begin.inside, list(begin.open[:2])
        self.depth = len(begin.open)
        self.before = b""
        self.in_target = self.depth >= 2 and _is_target(
            self.open[1][0], self.open[1][1], self.open[0][0], array
        )
        self.head_open = self.in_target
        self.part: list[bytes] = []
        self.elements: list[bytes] = []
        self.head: bytes | None = None

    def read(self, chunk: bytes) -> None:
        data = np.frombuffer(chunk, np.uint8)
        steps, outside, self.inside = _steps(data, self.inside)
        depth = self.depth + np.cumsum(steps)
        text = self.before + chunk
        offset = len(self.before)
        comma = (data == _COMMA) & outside & (depth == 2)
        opens = (steps > 0) & (depth <= 2)
        closes = (steps < 0) & (depth == 1)
        last = 0
        for i in np.flatnonzero(comma | opens | closes).tolist():
            if opens[i]:
                level = int(depth[i])
                del self.open[level - 1 :]
                name = _name_before(text, i + offset) if level == 2 else None
                self.open.append((int(data[i]), name))
                if level == 2:
                    self.in_target = _is_target(int(data[i]), name, self.open[0][0], self.array)
                    last = i + 1
            elif self.in_target:
                self.part.append(chunk[last:i])
                self._border()
                last = i + 1
                if closes[i]:
                    self.in_target = False
            elif closes[i]:
                self.in_target = False
        if self.in_target:
            self.part.append(chunk[last:])
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.before = text[-LOOK_BACK:]

    def _border(self) -> None:
        done, self.part = b"".join(self.part), []
        if self.head_open:
            self.head, self.head_open = done, False
        elif done.strip():
            self.elements.append(done)

    def take(self, at_least: int) -> Iterator[list[bytes]]:
        """Elements that are complete, in groups of ``at_least``; the rest by 0."""
        while self.elements and (len(self.elements) >= at_least or at_least == 0):
            size = at_least or len(self.elements)
            yield self.elements[:size]
            self.elements = self.elements[size:]

    def parts(self) -> list[tuple[str, bytes]]:
        """What begins or ends in another piece."""
        rest = b"".join(self.part)
        if self.head_open:
            return [(THROUGH, rest)]
        head = [(HEAD, self.head)] if self.head is not None else []
        return head + ([(TAIL, rest)] if self.in_target else [])


def _cut(
    texts: DataFrame, begins: dict[tuple[int, int], State], array: str, per_line: int
) -> DataFrame:
    """Lines of complete elements, and the parts of elements that span pieces."""
    known = {key: (s.inside, s.open) for key, s in begins.items()}
    opening, closing = f'{{"{array}":['.encode(), b"]}"

    def rows(key: tuple[int, int], found: list[tuple[str, bytes]]) -> pa.RecordBatch:
        kinds, values = zip(*found)
        arrays = [
            pa.array([key[0]] * len(found)), pa.array([key[1]] * len(found)),
            pa.array(kinds), pa.array(values, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "start", "kind", "value"])

    def lines(cutter: _Cutter, at_least: int) -> list[tuple[str, bytes]]:
        return [(LINE, opening + b",".join(g) + closing) for g in cutter.take(at_least)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter = None, None
        for file, start, first, chunk in _pieces(batches):
            if first:
                if cutter is not None and (found := lines(cutter, 0) + cutter.parts()):
                    yield rows(key, found)
                key = (file, start)
                inside, opened = known[key]
                cutter = _Cutter(State(inside, 0, opened), array)
            cutter.read(chunk)
            if found := lines(cutter, per_line):
                yield rows(key, found)
        if cutter is not None and (found := lines(cutter, 0) + cutter.parts()):
            yield rows(key, found)

    return texts.mapInArrow(cut, "file bigint, start bigint, kind string, value string")


def _joined(parts: DataFrame, array: str) -> DataFrame:
    """Elements that span pieces, one line each. There are at most two parts per piece."""
    rank = F.when(F.col("kind") == HEAD, 0).when(F.col("kind") == THROUGH, 1).otherwise(2)
    along = Window.partitionBy("file").orderBy("start", "rank")
    begun = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(along)
    numbered = parts.withColumn("rank", rank).withColumn("element", begun)
    pieces = F.sort_array(F.collect_list(F.struct("start", "rank", "value")))
    whole = numbered.groupBy("file", "element").agg(pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["value"]), "").alias("text")
    filled = whole.select(text).where(F.trim("text") != "")
    return filled.select(F.concat(F.lit(f'{{"{array}":['), "text", F.lit("]}")).alias("value"))


def split_payloads(
    spark: SparkSession, path: str, out: str, array: str, per_line: int = 500
) -> None:
    """Write the elements of ``array``, a list directly in each payload, as a bronze folder of
    lines with at most ``per_line`` elements; nothing else of the payloads is kept.

    ``path`` holds complete JSON payloads, objects on lines of any length or over several
    lines. A payload without the list, or with something else by that name, gives nothing; one
    that has it twice gives both. Files that are no such payloads, as far as brackets and
    quotes show, fail as a whole before anything is written.
    """
    texts = _texts(spark, path)
    begins = _beginnings(_summaries(texts))
    found = materialize(_cut(texts, begins, array, per_line), "split")
    found.where(F.col("kind") == LINE).select("value").write.mode("overwrite").text(out)
    _joined(found.where(F.col("kind") != LINE), array).write.mode("append").text(out)
