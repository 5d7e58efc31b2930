"""All pairs of the rows of two tables without a broadcast, and bounds on what one task holds whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the first block of a pair, and the pairs that count, as flat positions; None: all.
Tile = tuple[slice, np.ndarray | None]

#: Blocks of each side of a table of pairs: a side is sent that many times, and blocks squared tasks share the work.
BLOCKS = 8


def pairs_below(a: DataFrame, b: DataFrame, i: str, j: str, blocks: int = BLOCKS, within: list[str] | None = None) -> DataFrame:
    """The rows of ``a`` and ``b`` side by side wherever a.i < b.j, for the keys i and j of the two tables, and the columns ``within`` are equal.

    Both sides are dealt out to blocks by a hash of the key, and each pair of blocks meets in one place of an equi-join, so neither
    side has to fit into a task, whatever its size.
    """
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = a.withColumns({"__p": F.pmod(F.xxhash64(i), F.lit(blocks)).cast("int"), "__q": F.explode(every)})
    right = b.withColumns({"__q": F.pmod(F.xxhash64(j), F.lit(blocks)).cast("int"), "__p": F.explode(every)})
    return left.join(right.hint("shuffle_merge"), [*(within or []), "__p", "__q"]).where(F.col(i) < F.col(j)).drop("__p", "__q")


def held_whole(rows: DataFrame, most: int, what: str) -> DataFrame:
    """``rows``, after a count, if they are few enough to be sent to each task; else an error that says so."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{what} has more than {most} rows, which a task cannot hold whole")
    return rows


#: Rows of a block whose pairs a kernel makes, at least; more blocks than this many make each row travel too often.
BLOCK_ROWS, MOST_BLOCKS = 1024, 50
#: Pairs of a batch of a kernel.
TILE = 1 << 17


def block_pairs(rows: DataFrame, key: str, kernel: Callable[[pa.Table, pa.Table, Iterator[Tile]], Iterator[list]], schema: str, size: int = BLOCK_ROWS) -> DataFrame:
    """What ``kernel`` makes of all pairs of rows with a.key < b.key: ``kernel(a, b, tiles)`` yields the columns of ``schema``, batch by batch.

    The rows are cut into blocks by ranges of the key, so a pair of blocks p <= q meets in one place and each pair of rows in one of them.
    The cuts come from a sample of the keys and settle only how even the blocks are. ``rows`` is evaluated four times.
    """
    n = max(1, rows.count())
    blocks = min(MOST_BLOCKS, -(-n // size))
    cuts = []
    if blocks > 1:
        some = sorted(x[0] for x in rows.select(key).sample(min(1.0, 400 * blocks / n), 1).where(F.col(key).isNotNull()).collect())
        cuts = sorted({some[len(some) * k // blocks] for k in range(1, blocks)}) if some else []
    blocks = len(cuts) + 1
    own = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    held = rows.where(F.col(key).isNotNull()).withColumn("__own", own)
    left = held.withColumns({"__p": F.col("__own"), "__q": F.explode(F.sequence("__own", F.lit(blocks - 1)))}).drop("__own")
    right = held.withColumns({"__q": F.col("__own"), "__p": F.explode(F.sequence(F.lit(0), "__own"))}).drop("__own")
    right = right.toDF(*[f"__r_{c}" for c in right.columns])  # the kernel's columns come by attribute, which the sides must not share
    tasks = min(1000, blocks * (blocks + 1))
    left, right = (x.repartition(tasks, *place).groupBy(*place) for x, place in ((left, ("__p", "__q")), (right, ("__r___p", "__r___q"))))

    def run(place, a, b):
        out = _arrow_schema(schema)
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        b = b.rename_columns([c.removeprefix("__r_") for c in b.column_names])
        batches = [pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], schema=out) for made in kernel(a, b, tiles(a[key], b[key], place[0] == place[1]))]
        return pa.Table.from_batches(batches, out)

    return left.cogroup(right).applyInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{name}>": pa.list_(kind) for name, kind in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.rsplit(" ", 1) for x in schema.split(", "))])


def tiles(a: pa.ChunkedArray, b: pa.ChunkedArray, same: bool) -> Iterator[Tile]:
    """Slices of the rows of a block, against all of the other one, and which of these pairs count, as flat positions (None: all)."""
    x, y = (numbers(v) for v in (a, b)) if pa.types.is_integer(a.type) else (np.array(v.to_pylist(), object) for v in (a, b))
    step = max(1, TILE // max(1, len(y)))
    for at in range(0, len(x), step):
        rows = slice(at, min(at + step, len(x)))
        yield rows, (np.flatnonzero((x[rows, None] < y[None, :]).astype(bool)) if same else None)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def ends(a: pa.ChunkedArray, b: pa.ChunkedArray, tile: Tile) -> list[pa.Array]:
    """The keys of both sides of the pairs of a tile."""
    rows, kept = tile
    m, n = rows.stop - rows.start, len(b)
    if pa.types.is_integer(a.type):
        i, j = np.repeat(numbers(a)[rows], n), np.tile(numbers(b), m)
        return [pa.array(x if kept is None else x[kept]) for x in (i, j)]
    i, j = np.repeat(np.arange(rows.start, rows.stop), n), np.tile(np.arange(n), m)
    return [c.combine_chunks().take(pa.array(x if kept is None else x[kept])) for c, x in ((a, i), (b, j))]


def ends_of(a: pa.ChunkedArray, b: pa.ChunkedArray) -> Callable[[Tile], list[pa.Array]]:
    """``ends`` for tile after tile of two blocks: whole tiles of as many rows share the column of the second key."""
    if not pa.types.is_integer(a.type):
        return lambda tile: ends(a, b, tile)
    x, y, repeated = numbers(a), numbers(b), {}

    def made(tile: Tile) -> list[pa.Array]:
        rows, kept = tile
        if kept is not None:
            return [pa.array(x[rows][kept // len(y)]), pa.array(y[kept % len(y)])]
        m = rows.stop - rows.start
        if m not in repeated:
            repeated[m] = pa.array(np.tile(y, m))
        return [pa.array(np.repeat(x[rows], len(y))), repeated[m]]

    return made


def flat(values: np.ndarray, tile: Tile) -> np.ndarray:
    """The values of a tile's pairs, in the order of ``ends``."""
    return values.ravel() if tile[1] is None else values.ravel()[tile[1]]
