"""Join of a table with itself on the Jaccard similarity of word n-grams, by chosen paths.

Every set of shingles chooses on average ``1 / threshold`` of its members, by a hash that is
the same for all sets; sets that chose the same shingle share a bucket. A bucket that is too
large is split in the same way by a further shingle of its sets, up to ``DEPTH`` times. Two
sets above the threshold meet in one run with a probability that has a known lower bound,
and runs are repeated until the recall aimed at is reached (``runs_for``). What the first
runs have connected needs no further comparison in the others.

Within buckets sets are compared by a sketch of ``BINS`` bytes, and what may be similar is
connected. The components of that graph are small supersets of the true groups. Inside them
all pairs are compared exactly, block by block; only counts and a spanning forest of the
links leave a block, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.llm.components import components
from orebed.llm.words import (
    LETTERS,
    chunks,
    distinct,
    find_words,
    mix,
    seeds,
    shingles,
    signed,
)
from orebed.session import materialize

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 2
BUCKET = 128
BLOCK = 128
REST_BLOCK = 512
#: Runs after which what is connected already is left out of the others.
FIRST_RUNS = 3
BINS = 128
#: Sketches are compared at four standard deviations below the threshold.
SKETCH_SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / BINS)
NO_ID = -(2**63)
_GROUP_ROWS = 512
_COLUMNS = 4096


def runs_for(recall: float, depth: int) -> int:
    """Runs that find a pair at the threshold with probability ``recall`` even if it meets
    at the deepest level only. The number of shingles that both sets choose is on average
    one at least, nearly Poisson; so a level keeps a pair together with 1 - 1/e, and
    ``depth`` levels with the survival probability of that branching process."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _set_hash(doc: np.ndarray, shingle: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit hash of each row's set."""
    size = np.bincount(doc, minlength=rows)
    total = np.zeros(rows + 1, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle), dtype=np.uint64)])
    ends = np.concatenate([[0], np.cumsum(size)])
    total = sums[ends[1:]] - sums[ends[:-1]]
    return size, mix(total + size.astype(np.uint64))


def _sketches(doc: np.ndarray, shingle: np.ndarray, rows: int) -> np.ndarray:
    """For each of ``BINS`` parts of the hash space a byte of the lowest hash in it, 0 if
    the part is empty."""
    hashes = mix(shingle ^ np.uint64(0x5BD1E995))
    part = doc * BINS + (hashes % np.uint64(BINS)).astype(np.int64)
    lowest = np.full(rows * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(lowest, part, hashes)
    filled = np.zeros(rows * BINS, dtype=bool)
    filled[part] = True
    values = (mix(lowest) % np.uint64(255)).astype(np.uint8) + 1
    return np.where(filled, values, 0).astype(np.uint8).reshape(rows, BINS)


def _paths(
    doc: np.ndarray, shingle: np.ndarray, size: np.ndarray, runs: int, depth: int
) -> list[tuple[np.ndarray, ...]]:
    """For each level (row, run, parent, path) of all paths that the sets choose."""
    limit = np.minimum(2.0**64 - 2048, 2.0**64 / (THRESHOLD * np.maximum(size, 1)))
    limit = limit.astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(size)])
    level = []
    for run, seed in enumerate(seeds(runs, 23)):
        path = mix(shingle ^ seed)
        chosen = path <= limit[doc]
        count = int(chosen.sum())
        level.append((doc[chosen], np.full(count, run), np.zeros(count, np.uint64), path[chosen]))
    found = [tuple(map(np.concatenate, zip(*level)))]
    while len(found) < depth:
        rows, run, _, paths = found[-1]
        level = [tuple(column[:0] for column in found[-1])]
        for low in range(0, len(rows), 4096):
            part_rows, part_paths = rows[low : low + 4096], paths[low : low + 4096]
            many = size[part_rows]
            owner = np.repeat(np.arange(len(part_rows)), many)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            members = shingle[first[part_rows][owner] + within]
            path = mix(mix(members) ^ part_paths[owner])
            owner, path = (x[path <= limit[part_rows][owner]] for x in (owner, path))
            level.append((part_rows[owner], run[low + owner], part_paths[owner], path))
        found.append(tuple(map(np.concatenate, zip(*level))))
    return found


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(find_words(batch.column("text"), LETTERS), WIDTH))


def _fixed(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1]
    kind = pa.binary(width)
    return pa.FixedSizeBinaryArray.from_buffers(
        kind, len(matrix), [None, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())]
    ).cast(pa.binary())


def _lists(rows: np.ndarray, count: int, values: pa.Array) -> pa.Array:
    """Lists of ``values`` by row; ``rows`` ascends."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


_STEPS = "array<struct<run: int, parent: bigint, path: bigint>>"


def _signatures(docs: DataFrame, runs: int, depth: int) -> DataFrame:
    """Per row its set's size, hash (``node``), sketch and, by level, paths."""
    levels = [f"paths_{level}" for level in range(1, depth + 1)]
    schema = "doc_id bigint, text_hash bigint, size int, node bigint, sketch binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            n = batch.num_rows
            doc, shingle = _sets(batch)
            size, node = _set_hash(doc, shingle, n)
            columns = []
            for row, run, parent, path in _paths(doc, shingle, size, runs, depth):
                order = np.argsort(row, kind="stable")
                steps = pa.StructArray.from_arrays(
                    [
                        pa.array(run[order], pa.int32()), pa.array(signed(parent[order])),
                        pa.array(signed(path[order])),
                    ],
                    ["run", "parent", "path"],
                )
                columns.append(_lists(row[order], n, steps))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int32()),
                    pa.array(signed(node)), _fixed(_sketches(doc, shingle, n)), *columns,
                ],
                ["doc_id", "text_hash", "size", "node", "sketch", *levels],
            )

    return docs.mapInArrow(sign, ", ".join([schema, *(f"{name} {_STEPS}" for name in levels)]))


def _bytes(column: pa.Array) -> list[bytes]:
    return column.to_pylist()


def _alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sketches may belong to sets above the threshold; broadcasts."""
    equal = ((left == right) & (left > 0)).sum(axis=-1)
    either = ((left | right) > 0).sum(axis=-1)
    return equal >= (THRESHOLD - SKETCH_SLACK) * either


def _stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, as (lowest, other)."""
    todo = linked.any(axis=1)
    edges = []
    while todo.any():
        seed = int(todo.argmax())
        reached = np.zeros(len(linked), dtype=bool)
        reached[seed] = True
        frontier = reached
        while frontier.any():
            frontier = linked[frontier].any(axis=0) & ~reached
            reached |= frontier
        edges += [(seed, int(i)) for i in np.flatnonzero(reached) if i != seed]
        todo &= ~reached
    return edges


_EDGES = "a bigint, b bigint"


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), BINS)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within buckets that come whole, as a list of nodes and one of sketches."""
    for batch in batches:
        edges = []
        for members in batch.column("members"):
            found = members.as_py()
            nodes = [m["node"] for m in found]
            sketch = _matrix([m["sketch"] for m in found])
            if len(nodes) == 2:
                if _alike(sketch[0], sketch[1]):
                    edges.append((nodes[0], nodes[1]))
                continue
            linked = _alike(sketch[:, None, :], sketch[None, :, :])
            np.fill_diagonal(linked, False)
            edges += [(nodes[i], nodes[j]) for i, j in _stars(linked)]
        yield _edge_batch(edges)


def _leader_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a node is like the leader of its bucket, or connected to it by now."""
    for batch in batches:
        if batch.num_rows:
            like = _alike(
                _matrix(_bytes(batch.column("sketch"))), _matrix(_bytes(batch.column("_lead")))
            )
            same = pc.equal(batch.column("root"), batch.column("_common"))
            attached = pc.or_(pa.array(like), same)
            names = ["path", "node", "count", "leader", "sketch"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), attached], [*names, "attached"]
            )


def _rest_edges(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges between a block of the rest and a block of all nodes."""
    table = pa.Table.from_batches(list(batches))
    rest = np.array(table["rest"].to_pylist(), dtype=bool)
    nodes = table["node"].to_numpy()
    sketch = _matrix(table["sketch"].to_pylist())
    others = np.flatnonzero(~rest)
    linked = np.zeros((len(nodes), len(nodes)), dtype=bool)
    for i in np.flatnonzero(rest):
        linked[i, others] = linked[others, i] = _alike(sketch[i], sketch[others])
    yield _edge_batch([(int(nodes[i]), int(nodes[j])) for i, j in _stars(linked)])


def _block_of(column: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks)


def _numbers(below: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(below) - 1))


def _oversize_edges(rows: DataFrame, sketches: DataFrame, block: int) -> DataFrame:
    """Edges of buckets (path, node, root, count) that no further path may split.

    The leader of a bucket is one of the nodes with the commonest root. Nodes like it are
    connected to it, and those that share its root are already. Only the rest is compared
    with all, block by block; of near copies that is little once a run has connected them.
    """
    roots = rows.groupBy("path", "root").agg(
        F.count(F.lit(1)).alias("_nodes"), F.min("node").alias("leader")
    )
    common = roots.groupBy("path").agg(
        F.max_by(F.struct("root", "leader"), F.struct("_nodes", "root")).alias("_most")
    ).select("path", F.col("_most.root").alias("_common"), "_most.leader")
    lead = sketches.select(F.col("node").alias("leader"), F.col("sketch").alias("_lead"))
    told = materialize(
        rows.select("path", "node", "root", "count").join(sketches, "node")
        .join(common.join(lead, "leader"), "path")
        .mapInArrow(
            _leader_edges,
            "path bigint, node bigint, count bigint, leader bigint, sketch binary, attached boolean",
        ),
        "leaders",
    )
    blocks = told.where("not attached").groupBy("path").agg(F.count(F.lit(1)).alias("_rest"))
    sized = told.join(blocks, "path").withColumns({
        "_rest_blocks": F.ceil(F.col("_rest") / block), "_all_blocks": F.ceil(F.col("count") / block),
    })
    every = sized.select(
        "path", "node", "sketch", _numbers("_rest_blocks").alias("_i"),
        _block_of("node", F.col("_all_blocks")).alias("_j"), F.lit(False).alias("rest"),
    )
    alone = sized.where("not attached").select(
        "path", "node", "sketch", _block_of("node", F.col("_rest_blocks")).alias("_i"),
        _numbers("_all_blocks").alias("_j"), F.lit(True).alias("rest"),
    )
    pairs = every.unionByName(alone)
    direct = told.where("attached and node <> leader").select(
        F.col("leader").alias("a"), F.col("node").alias("b")
    )
    return direct.union(pairs.groupBy("path", "_i", "_j").applyInArrow(_rest_edges, _EDGES))


def _buckets(
    sets: DataFrame, roots: DataFrame | None, runs: range, depth: int, bucket: int
) -> tuple[DataFrame, DataFrame]:
    """Rows (path, node, root, count) of the buckets of some runs: those of bounded
    size, and those that are still larger at the last level. Buckets all of whose nodes have
    one root by now are left out, as no new link between components can come of them."""
    small: list[DataFrame] = []
    large = None
    for level in range(1, depth + 1):
        steps = F.filter(
            f"paths_{level}", lambda s: (s["run"] >= runs.start) & (s["run"] < runs.stop)
        )
        rows = sets.select("node", F.explode(steps).alias("s")).select("node", "s.parent", "s.path")
        if large is not None:
            hot = large.select(F.col("path").alias("_hot")).distinct()
            rows = rows.join(hot, rows["parent"] == hot["_hot"], "left_semi")
        rows = rows.select("path", "node").distinct()
        if roots is None:
            rows = rows.withColumn("root", F.col("node"))
        else:
            rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = materialize(rows.select("path", "node", "root"), f"paths-{level}")
        sizes = rows.groupBy("path").agg(
            F.count(F.lit(1)).alias("count"),
            F.min("root").alias("_low"), F.max("root").alias("_high"),
        ).where("_low < _high").drop("_low", "_high")
        sized = materialize(rows.join(sizes, "path"), f"buckets-{level}")
        small.append(sized.where(F.col("count") <= bucket))
        large = sized.where(F.col("count") > bucket)
    return reduce(DataFrame.union, small), large


def _candidates(signatures: DataFrame, runs: int, depth: int, bucket: int) -> DataFrame:
    """Edges whose components contain all links, with the recall of the paths."""
    sets = signatures.where("size > 0")
    edges, roots = None, None
    for part in (range(min(FIRST_RUNS, runs)), range(min(FIRST_RUNS, runs), runs)):
        if not len(part):
            continue
        small, large = _buckets(sets, roots, part, depth, bucket)
        needed = small.select("node").union(large.select("node")).distinct()
        sketches = sets.select("node", "sketch").join(needed, "node", "left_semi").distinct()
        sketches = materialize(sketches, "sketches")
        whole = (
            small.join(sketches, "node")
            .groupBy("path").agg(F.collect_list(F.struct("node", "sketch")).alias("members"))
            .select("members").mapInArrow(_bucket_edges, _EDGES)
        )
        new = whole.union(_oversize_edges(large, sketches, REST_BLOCK))
        edges = new if edges is None else edges.union(new)
        edges = materialize(edges.distinct(), "candidates")
        roots = materialize(components(edges), "coarse")
    return roots


def _exact(
    nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (masks) are linked, as a matrix over all."""
    n = len(nodes)
    size = np.array([len(s) for s in sets])
    shared = np.zeros((n, n), dtype=np.int64)
    if n == 2:
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), size)
        _, index, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.flatnonzero(counts > 1)
        number = np.full(len(counts), -1)
        number[common] = np.arange(len(common))
        column = number[index]
        keep = column >= 0
        owner, column = owner[keep], column[keep]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        cuts = np.searchsorted(column, np.arange(0, len(common) + _COLUMNS, _COLUMNS))
        for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
            has = np.zeros((n, _COLUMNS), dtype=np.float32)
            has[owner[low:high], column[low:high] - number * _COLUMNS] = 1
            shared += np.rint(has @ has.T).astype(np.int64)
    union = size[:, None] + size[None, :] - shared
    linked = shared >= THRESHOLD * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))


_LINKS = "a bigint, b bigint, links bigint"


def _block_links(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a component: for every node the copies of its partners
    (``links``, ``b`` is NULL), and a spanning forest (``a``, ``b``)."""
    table = pa.Table.from_batches(list(batches)).sort_by(
        [("root", "ascending"), ("_i", "ascending"), ("_j", "ascending"), ("node", "ascending")]
    )
    keys = np.stack([table[name].to_numpy() for name in ("root", "_i", "_j")], axis=1)
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    nodes, copies = table["node"].to_numpy(), table["copies"].to_numpy()
    mine, members = table["_block"].to_numpy(), table["members"].to_pylist()
    a, b, links = [], [], []
    for low, high in zip(starts, [*starts[1:], len(nodes)]):
        if high - low < 2:
            continue
        left, right = mine[low:high] == keys[low, 1], mine[low:high] == keys[low, 2]
        sets = [np.frombuffer(m, np.int64) for m in members[low:high]]
        linked = _exact(nodes[low:high], sets, left, right)
        total = linked @ copies[low:high]
        for i in np.flatnonzero(total):
            a.append(int(nodes[low + i]))
            b.append(None)
            links.append(int(total[i]))
        for i, j in _stars(linked):
            a.append(int(nodes[low + i]))
            b.append(int(nodes[low + j]))
            links.append(0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())],
        ["a", "b", "links"],
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        doc, shingle = _sets(batch)
        size, node = _set_hash(doc, shingle, batch.num_rows)
        ends = np.concatenate([[0], np.cumsum(size)])
        values = signed(shingle)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(node)),
                pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
            ],
            ["node", "members"],
        )


def _links(docs: DataFrame, signatures: DataFrame, coarse: DataFrame, block: int) -> DataFrame:
    """Exact links inside the components ``coarse`` (node, root)."""
    key = F.coalesce("doc_id", F.lit(NO_ID))
    # One document for each set: any of those that have it will do.
    chosen = signatures.join(coarse, "node").groupBy("node", "root").agg(
        F.min("text_hash").alias("text_hash"), F.min_by(key, "text_hash").alias("_key"),
        F.count(F.lit(1)).alias("copies"),
    )
    chosen = materialize(chosen, "members")
    # Texts are met by a sort-merge join, whatever the sizes, so that growth holds no surprise.
    texts = docs.withColumn("_key", key).join(
        chosen.select("text_hash", "_key").hint("merge"), ["text_hash", "_key"], "left_semi"
    )
    sets = texts.select("text").mapInArrow(_members, "node bigint, members binary").distinct()
    sizes = chosen.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    placed = chosen.select("node", "root", "copies").join(sizes, "root").withColumn(
        "_block", _block_of("node", F.col("_blocks"))
    )
    whole = materialize(placed.join(sets, "node"), "sets")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    spread = whole.withColumn("_other", other).withColumns({
        "_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other"),
    })
    groups = max(1, spread.count() // _GROUP_ROWS)
    return materialize(
        spread.withColumn("_group", F.pmod(F.xxhash64("root", "_i", "_j"), F.lit(groups)))
        .select("_group", "root", "_i", "_j", "node", "_block", "copies", "members")
        .groupBy("_group").applyInArrow(_block_links, _LINKS),
        "links",
    )


def _classify(
    docs: DataFrame, recall: float, depth: int, bucket: int, block: int
) -> DataFrame:
    """One row per row of ``docs``, with ``root``, the same for all of a class and NULL for
    rows without links."""
    docs = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    runs = runs_for(recall, depth)
    signatures = materialize(_signatures(docs, runs, depth), "signatures")
    links = _links(docs, signatures, _candidates(signatures, runs, depth, bucket), block)
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(
        F.sum("links").alias("_links")
    )
    nodes = signatures.where("size > 0").groupBy("node").agg(
        F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_copies")
    )
    nodes = materialize(
        nodes.join(counts, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .where("_copies > 1 OR _links > 0"),
        "nodes",
    )
    classes = nodes.groupBy("root").agg(F.min("_first").alias("_class"))
    known = nodes.join(classes, "root").select(
        "node", F.col("root").alias("_root"), "_class",
        (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_n"),
    )
    linked = (F.col("size") > 0) & F.col("_n").isNotNull()
    rows = signatures.select("doc_id", "text_hash", "size", "node").join(known, "node", "left")
    return rows.select(
        "doc_id", "text_hash", F.when(linked, F.col("_root")).alias("root"),
        F.when(linked, F.col("_class")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("_n")).otherwise(0).cast("bigint").alias("n_links"),
    )


def near_duplicates(
    docs: DataFrame, *, recall: float = RECALL, depth: int = DEPTH, bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles
    is 0.8 or more. Words are runs of ASCII letters, digits and characters beyond ASCII,
    lower-cased; a text of one to four words has one shingle. n_links is the number of other
    rows a row is linked to, and class_id the lowest doc_id that links lead to, its own if
    there are none. A text without words, NULL among them, is linked to nothing. Rows with
    equal sets, repeated rows too, are links of each other. doc_id may be NULL or repeated;
    a class in which all are NULL has a NULL id. Columns other than doc_id and text are not
    read.
    """
    rows = _classify(docs, recall, depth, bucket, block)
    return rows.select("doc_id", "class_id", "n_links")


def keep_one_of_each(docs: DataFrame, *, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of every class of near duplicates, the one with the lowest
    doc_id, and all rows without links. Columns stay; names that start with an underscore
    are used inside."""
    key = F.coalesce("doc_id", F.lit(2**63 - 1))
    rows = _classify(docs, recall, DEPTH, BUCKET, BLOCK).where("root IS NOT NULL").select(
        "root", key.alias("_key"), F.col("text_hash").alias("_text")
    )
    rows = materialize(rows, "classes")
    first = rows.groupBy("root").agg(
        F.min("_key").alias("_key"), F.min_by("_text", "_key").alias("_text")
    )
    same = ["_key", "_text"]
    marked = docs.withColumns({"_key": key, "_text": F.xxhash64("text")})
    gone = rows.select(*same).distinct().join(first, same, "left_anti")
    kept = marked.join(gone, same, "left_anti")
    repeated = materialize(rows.groupBy(*same).count().where("count > 1").drop("count"), "again")
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").dropDuplicates(same)
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.drop(*same)
