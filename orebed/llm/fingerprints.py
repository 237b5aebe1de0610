"""Fingerprints of documents whose difference names the paragraphs that differ.

A fingerprint is an invertible Bloom lookup table of paragraph digests: every digest is
added to three cells, which hold a count and the exclusive or of digests and of check sums.
Cells of two versions are subtracted; what both have cancels out. A cell with one digest
left gives it away, which is then removed from its other cells, and so on until nothing is
left. If some cells stay, the table was too small and a larger one is made.

Digests are dealt to blocks of twelve cells by their low bits, so the work of peeling grows
with the difference and not with its square. A larger table has four blocks in the place of
each, so only blocks that failed are made again. All of it is SQL over columns of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A paragraph is a line; one longer than this goes on to the next end of a sentence, and
#: what follows is a paragraph of its own. Without an end within ``SENTENCE`` characters it
#: stops at once, so that a long line without full stops is gone through in proportion.
LONGEST, SENTENCE = 500, 4000
PARAGRAPH = rf"[^\n]{{1,{LONGEST}}}+(?:[^\n.!?]{{0,{SENTENCE}}}+[.!?]++)?"
#: Blocks of the fingerprint itself, and of the larger tables that are tried in turn.
BLOCKS = 8
LARGER = (32, 128, 512, 2048, 8192)
HASHES, CELLS = 3, 4  # cells per hash
BUCKET_ROWS = 2048

_CELL = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
_FOUND = "array<struct<digest: bigint, sign: int>>"
_NOTHING = f"named_struct('found', cast(array() as {_FOUND}), 'ok', true)"


def paragraph_digests(text: str) -> str:
    """SQL for the distinct digests of the paragraphs of a column; none for NULL."""
    pattern = PARAGRAPH.replace("\\", "\\\\")
    return (
        f"array_distinct(transform(regexp_extract_all(coalesce({text}, ''), '{pattern}', 0), "
        "p -> xxhash64(p)))"
    )


def _cells(items: str, digest: str, sign: str) -> str:
    """SQL for a block's cells over an array of items."""
    cells = []
    for number in range(HASHES * CELLS):
        which, place = divmod(number, CELLS)
        here = f"(shiftrightunsigned({digest}, {40 + 2 * which}) & {CELLS - 1}) = {place}"
        added = (
            f"named_struct('n', s.n + {sign}, 'k', s.k ^ {digest}, 'c', s.c ^ xxhash64({digest}))"
        )
        cells.append(f"aggregate({items}, {_CELL}, (s, d) -> if({here}, {added}, s))")
    return f"array({', '.join(cells)})"


def _sketch(digests: str, blocks: int) -> str:
    """SQL for the table of a column of digests: blocks of cells."""
    zero = f"array_repeat({_CELL}, {HASHES * CELLS})"
    block = f"filter({digests}, d -> (d & {blocks - 1}) = b)"
    return (
        f"transform(sequence(0, {blocks - 1}), b -> transform(array({block}), "
        f"ds -> if(size(ds) = 0, {zero}, {_cells('ds', 'd', '1')}))[0])"
    )


def _peeled() -> str:
    """SQL for the digests in a block of subtracted ``cells``: ``found``, and ``ok`` if
    nothing is left."""
    zero = "c.n = 0 and c.k = 0 and c.c = 0"
    pure = "get(filter(s.cells, c -> abs(c.n) = 1 and xxhash64(c.k) = c.c), 0)"
    hit = " or ".join(
        f"(i div {CELLS} = {j} and i % {CELLS} = (shiftrightunsigned(p.k, {40 + 2 * j}) & {CELLS - 1}))"
        for j in range(HASHES)
    )
    rest = (
        f"transform(s.cells, (c, i) -> if({hit}, "
        "named_struct('n', c.n - p.n, 'k', c.k ^ p.k, 'c', c.c ^ xxhash64(p.k)), c))"
    )
    none = "cast(array() as array<struct<n: int, k: bigint, c: bigint>>)"
    # Without a pure cell the block is done; it then has no cells and no step does anything.
    step = (
        f"if(size(s.cells) = 0, s, transform(array({pure}), p -> if(p is null, "
        f"named_struct('cells', {none}, 'found', s.found, 'ok', forall(s.cells, c -> {zero})), "
        f"named_struct('cells', {rest}, "
        "'found', concat(s.found, array(named_struct('digest', p.k, 'sign', p.n))), 'ok', false)"
        "))[0])"
    )
    start = f"named_struct('cells', cells, 'found', cast(array() as {_FOUND}), 'ok', false)"
    return (
        f"transform(array(size(filter(cells, c -> not ({zero})))), z -> if(z = 0, {_NOTHING}, "
        f"aggregate(sequence(0, z), {start}, (s, i) -> {step}, "
        "s -> named_struct('found', s.found, 'ok', s.ok))))[0]"
    )


def _state(before: str, blocks: str, results: str) -> str:
    """SQL for what is known after ``results``, one for each of ``blocks``: digests found
    altogether, and blocks that failed. What a failed block gave away is found again."""
    none = f"cast(array() as {_FOUND})"
    return (
        f"transform(array({results}), rs -> named_struct("
        f"'found', concat({before}, flatten(transform(rs, r -> if(r.ok, r.found, {none})))), "
        f"'failed', filter(zip_with(rs, {blocks}, (r, b) -> if(r.ok, null, b)), b -> b is not null)"
        "))[0]"
    )


def _first_state(left: str, right: str) -> str:
    """SQL for the state after the fingerprints' own tables are subtracted."""
    less = "named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c)"
    results = (
        f"zip_with({left}, {right}, (a, b) -> if(a = b, {_NOTHING}, "
        f"transform(array(zip_with(a, b, (x, y) -> {less})), cells -> {_peeled()})[0]))"
    )
    return _state(f"cast(array() as {_FOUND})", f"sequence(0L, {BLOCKS - 1}L)", results)


def _next_state(before: str, left: str, right: str, fewer: int, blocks: int) -> str:
    """SQL for the state after the failed blocks of a table of ``fewer`` blocks are made
    again within one of ``blocks``. The difference is added up directly: the digests of the
    right side count negative."""
    inside = ", ".join(f"f + {k * fewer}L" for k in range(blocks // fewer))
    again = f"flatten(transform({before}.failed, f -> array({inside})))"
    of = "transform(filter({}, d -> (d & {}) = b), d -> named_struct('d', d, 's', {}))"
    items = f"concat({of.format(left, blocks - 1, 1)}, {of.format(right, blocks - 1, -1)})"
    cells = _cells("ds", "d.d", "d.s")
    results = (
        f"transform(bs, b -> transform(array({items}), ds -> "
        f"transform(array({cells}), cells -> {_peeled()})[0])[0])"
    )
    state = _state(f"{before}.found", "bs", results)
    return f"if(size({before}.failed) = 0, {before}, transform(array({again}), bs -> {state})[0])"


def _text_of(sketch: str) -> str:
    """SQL for a table as text: cells in hexadecimal, nothing for an empty one."""
    cell = "if(c.n = 0, '', concat_ws('.', hex(c.n), hex(c.k), hex(c.c)))"
    return f"array_join(transform(flatten({sketch}), c -> {cell}), ',')"


def with_fingerprint(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """``rows`` with ``<prefix>digests``, ``<prefix>sketch`` and ``<prefix>fingerprint`` of
    the column ``text``. Equal texts have equal ones; a text without paragraphs has none."""
    return (
        rows.withColumn(f"{prefix}digests", F.expr(paragraph_digests(text)))
        .withColumn(f"{prefix}sketch", F.expr(_sketch(f"{prefix}digests", BLOCKS)))
        .withColumn(f"{prefix}fingerprint", F.expr(_text_of(f"{prefix}sketch")))
    )


def with_difference(rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """``rows`` with ``<out>``: the paragraph digests that ``<left>digests`` and
    ``<right>digests`` differ in, sign 1 where only the left has one, and ``<out>_near``, the
    share of common paragraphs in all, 1 if there are none.

    Differences come from the sketches, then from larger and larger tables. Past the largest,
    which a difference of some tens of thousands fills, digests are compared as sets.
    """
    sizes = (BLOCKS, *LARGER)
    columns = [f"_{out}_{blocks}" for blocks in sizes]
    rows = rows.withColumn(columns[0], F.expr(_first_state(f"{left}sketch", f"{right}sketch")))
    for before, column, fewer, blocks in zip(columns, columns[1:], sizes, LARGER):
        state = _next_state(before, f"{left}digests", f"{right}digests", fewer, blocks)
        rows = rows.withColumn(column, F.expr(state))
    one_side = "transform(array_except({}digests, {}digests), d -> named_struct('digest', d, 'sign', {}))"
    exact = f"concat({one_side.format(left, right, 1)}, {one_side.format(right, left, -1)})"
    found = f"if(size({columns[-1]}.failed) = 0, {columns[-1]}.found, {exact})"
    near = (
        f"if(size({left}digests) + size({right}digests) = 0, 1D, "
        f"(size({left}digests) + size({right}digests) - size({out})) / "
        f"(size({left}digests) + size({right}digests) + size({out})))"
    )
    return (
        rows.withColumn(out, F.expr(found)).withColumn(f"{out}_near", F.expr(near)).drop(*columns)
    )


def _bucket_width(docs: DataFrame, bucket_rows: int) -> int:
    """Width of ranges of doc_id none of which has many more rows than ``bucket_rows``."""
    low, high, count = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if not count:
        return 1
    width = min(max(1, (high - low + 1) * bucket_rows // count), 2**62)
    while width > 1:
        largest = docs.groupBy(F.floor(F.col("doc_id") / width)).count().agg(F.max("count")).first()
        if largest[0] <= 4 * bucket_rows:
            break
        width = max(1, width // 8)
    return width


def with_next(docs: DataFrame, columns: list[str], *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``, the value in the next row by
    descending doc_id (NULLs last, then by text); the last row's next is the first. Ids have
    to be whole numbers; others are refused with a TypeError.

    Rows are windowed by ranges of doc_id. Into each range comes, as a guest, the first row
    of the range after it, so that texts move once.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id has to be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    width = _bucket_width(docs.select("doc_id"), bucket_rows)
    bucket = F.coalesce(F.floor(F.col("doc_id") / width), F.lit(-(2**63)))
    rows = docs.withColumns({"_bucket": bucket, "_hash": F.xxhash64("text")})
    ids = rows.select("_bucket", "doc_id", "_hash")
    order = [F.desc_nulls_last("doc_id"), F.asc("_hash")]
    heads = (
        ids.groupBy("_bucket").agg(F.max("doc_id").alias("doc_id"))
        .withColumnRenamed("_bucket", "_head")
    )
    heads = (
        ids.join(heads, (ids["_bucket"] == heads["_head"]) & ids["doc_id"].eqNullSafe(heads["doc_id"]))
        .groupBy("_bucket").agg(F.min("_hash").alias("_hash"), F.max(heads["doc_id"]).alias("_id"))
    )
    # A range's next is the one below it, that of the lowest the highest.
    above = Window.orderBy("_bucket").rowsBetween(Window.currentRow + 1, Window.currentRow + 1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hosts = heads.select(
        F.col("_bucket").alias("_from"), F.col("_hash").alias("_h"), "_id",
        F.coalesce(F.max("_bucket").over(above), F.min("_bucket").over(whole)).alias("_host"),
    )
    guests = (
        rows.join(
            hosts,
            (rows["_bucket"] == hosts["_from"]) & (rows["_hash"] == hosts["_h"])
            & rows["doc_id"].eqNullSafe(hosts["_id"]),
        )
        .withColumn("_bucket", F.col("_host"))
        .drop("_from", "_h", "_id", "_host")
    )
    both = rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    window = Window.partitionBy("_bucket").orderBy(F.asc("_guest"), *order)
    named = {f"next_{c}": F.lead(c).over(window) for c in columns}
    return both.withColumns(named).where("not _guest").drop("_bucket", "_hash", "_guest")


def edited_text(text: str, other: str) -> Column:
    """``text`` with its last third of code points replaced by as many, or all, of ``other``."""
    third = f"(char_length({text}) div 3)"
    return F.expr(
        f"concat(left({text}, cast(char_length({text}) - {third} as int)), "
        f"left({other}, cast({third} as int)))"
    )


def versions(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the text, its edited text, the next text,
    their fingerprints, and the differences ``from_edited`` and ``from_next`` with their
    likeness ``from_edited_near`` and ``from_next_near``.

    A NULL text is empty. Without any other row the next document is the row itself.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text"]).withColumn("edited", edited_text("text", "next_text"))
    for text, prefix in (("text", ""), ("edited", "edited_"), ("next_text", "next_")):
        rows = with_fingerprint(rows, text, prefix)
    rows = with_difference(rows, "", "edited_", "from_edited")
    return with_difference(rows, "", "next_", "from_next")
