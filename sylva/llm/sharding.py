"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Row counts of the input partitions and the exact sizes of the targets fix the margins of a matrix whose
entry (p, t) is the number of rows that partition p sends to target t. In a uniformly random permutation
of all rows that matrix follows a multivariate hypergeometric law. It is drawn by halving the range of
partitions: each node of the tree splits its column sums with a generator seeded by the node, so every
task draws the one row it needs and all tasks agree, without a matrix on the driver. Then each
partition deals its rows out by a random arrangement of its counts, the rows are exchanged, and each
target permutes what it has got. The result is a uniform permutation of the rows over shards and slots.

A shard consists of blocks, which are the targets, so no task holds a shard. A block has ``BLOCK_ROWS`` rows at most, and more only
where there would be more than ``MAX_TARGETS`` blocks; a target sorts what it gets and may spill.

Shard sizes follow the law ``rows``: they differ by one at most, and the first shards are the larger ones.
Defined results: a null text counts as an empty one; texts of any length travel as they are, or not at all if they are not kept. Null ids and repeated rows are dealt out like any
other rows. An empty table gives an empty result. Groups of equal texts are not held together, as a
group may be larger than a shard. Other columns travel along if they are named in ``keep``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import cut, map_arrow, pick

BLOCK_ROWS = 4096
MAX_TARGETS = 8192
_NUMPY_LIMIT = 10**9


def _lgamma_ratio(a: float, b: float) -> float:
    """log(gamma(a) / gamma(b)), without loss of digits where both are large."""
    if min(a, b) < 1e5:
        return math.lgamma(a) - math.lgamma(b)
    return (b - 0.5) * math.log1p((a - b) / b) + (a - b) * (math.log(a) - 1) + (1 / a - 1 / b) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One draw; beyond numpy's range by rejection from a ratio of uniforms around the mode (Stadlober)."""
    total = good + bad
    if total < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    lo, hi = max(0, sample - bad), min(good, sample)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (total + 2)))
    mean = sample * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - sample) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if lo <= x <= hi:
            log_ratio = _lgamma_ratio(mode + 1, x + 1) + _lgamma_ratio(good - mode + 1, good - x + 1) + _lgamma_ratio(sample - mode + 1, sample - x + 1) + _lgamma_ratio(bad - sample + mode + 1, bad - sample + x + 1)
            if 2 * math.log(u) <= log_ratio:
                return x


def split(rng: np.random.Generator, columns: np.ndarray, sample: int) -> np.ndarray:
    """How many of a sample of rows, drawn without replacement, come to each column: the columns are halved again and again."""
    total = int(columns.sum())
    if total < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(columns, sample, method="marginals") if len(columns) > 1 else np.array([sample])
    if len(columns) == 1:
        return np.array([sample])
    mid = len(columns) // 2
    good = int(columns[:mid].sum())
    left = hypergeometric(rng, good, total - good, sample)
    return np.concatenate([split(rng, columns[:mid], left), split(rng, columns[mid:], sample - left)])


def dealt(matrix: Matrix, part: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The target of each row of a partition, and the key that the target sorts it by."""
    counts = matrix.row(part)
    rng = np.random.default_rng([seed, part, 1])
    return rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts)), rng.integers(0, 2**63 - 1, int(counts.sum()))


class Matrix:
    """Rows of the communication matrix for given partition sizes and target sizes."""

    def __init__(self, partitions: list[int], targets: list[int], seed: int) -> None:
        self.before = np.concatenate([[0], np.cumsum(partitions, dtype=np.int64)])
        self.targets, self.seed = np.array(targets, np.int64), seed
        self._node = lru_cache(maxsize=64)(self._columns)

    def _columns(self, lo: int, hi: int, path: tuple[tuple[int, int], ...]) -> np.ndarray:
        """Column sums of the partitions lo to hi - 1; path: the nodes above, from the root."""
        if not path:
            return self.targets
        a, b = path[-1]
        above = self._node(a, b, path[:-1])
        mid = (a + b) // 2
        left = split(np.random.default_rng([self.seed, a, b]), above, int(self.before[mid] - self.before[a]))
        return left if hi == mid else above - left

    def row(self, p: int) -> np.ndarray:
        lo, hi, path = 0, len(self.before) - 1, ()
        while hi - lo > 1:
            mid = (lo + hi) // 2
            path = (*path, (lo, hi))
            lo, hi = (lo, mid) if p < mid else (mid, hi)
        return self._node(lo, hi, path)


def target_sizes(n: int, shards: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of each target."""
    out = []
    block_rows = max(block_rows, -(-n // MAX_TARGETS))
    for s in range(shards):
        rows = n // shards + (s < n % shards)
        blocks = max(1, -(-rows // block_rows))
        at = 0
        for b in range(blocks):
            size = rows // blocks + (b < rows % blocks)
            out.append((s, at, size))
            at += size
    return out


def shard(rows: DataFrame, keep: tuple[str, ...], *, shards: int = 8, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The kept columns with ``shard`` and ``slot`` (gapless from 0 in each shard).

    The rows are written to the shared folder once, with partition and position, so that a task that is
    run again deals them out as before.
    """
    spark = rows.sparkSession
    named = [f"k{i}" for i in range(len(keep))]
    own = pick(rows, *keep).toDF(*named)
    held = cut(own.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r[0]: r[1] for r in held.groupBy("part").count().collect()}  # one number a partition
    sizes = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    targets = target_sizes(sum(sizes), shards, block_rows)
    shared = spark.sparkContext.broadcast((sizes, [t[2] for t in targets]))

    def deal(batches):
        matrix = Matrix(*shared.value, seed) if shared.value[0] else None
        order: dict[int, np.ndarray] = {}
        for batch in batches:
            part, pos = (batch.column(i).to_numpy() for i in (0, 1))
            target, key = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            for p in np.unique(part):
                if p not in order:
                    order.clear()
                    order[p] = dealt(matrix, int(p), seed)
                at = part == p
                target[at], key[at] = order[p][0][pos[at]], order[p][1][pos[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), batch.column(1), pa.array(target), pa.array(key)], [*named, "part", "pos", "target", "key"])

    fixed = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.schema.fields)
    sent = map_arrow(held.select("part", "pos", *named), deal, f"{fixed}part int, pos long, target int, key long")
    where = spark.createDataFrame([(i, s, at) for i, (s, at, _) in enumerate(targets)], "target int, shard int, first long")
    inner = F.row_number().over(Window.partitionBy("target").orderBy("key", "part", "pos")) - 1
    placed = sent.repartition(len(targets), "target").withColumn("inner", inner)
    out = placed.join(F.broadcast(where) if len(targets) <= 100_000 else where, "target")
    return out.select(*[F.col(a).alias(b) for a, b in zip(named, keep)], "shard", (F.col("first") + F.col("inner")).cast("long").alias("slot"))
