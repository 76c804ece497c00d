"""Uniform random sharding with exact shard sizes.

Law `rows`: shard sizes differ by one row at most. The rows are counted by partition; from the counts a communication
matrix is drawn that says how many rows of each partition go to each block, as a uniform random permutation
would send them (multivariate hypergeometric draws). Each partition deals a random permutation of its block labels
to its rows, the rows are exchanged, and each block is permuted again. A block is a contiguous piece of a shard's slots
of known size, so slots follow without another count, and large shards are permuted by many tasks.

The matrix is never held: a binary tree over the partitions splits the blocks' capacities, each node drawing from
its own seeded generator, so a task finds its partition's row in log2(partitions) draws. The driver holds and sends one
8-byte count for each partition.

All draws are exact: numpy's hypergeometric generator below its bound of 10^9 items, beyond it rejection from a ratio of uniforms
(Stadlober) against the exact ratio of probabilities, in a form that keeps its precision at any size. Blocks halve like partitions: a
node's draws over all blocks are one numpy call a level. Rows of a block, and blocks, both grow as the square root of the rows.

A lost task runs again with the same result: its draws depend on the seed, its partition and its rows' positions alone.
This needs an input whose partitions are the same when read again, such as files; other inputs (stable=False) are first
written to the shared folder. A partition whose rows don't match the count stops the job.

Defined results: null texts or nulls in any column are rows like others; equal rows are dealt apart like any others; very long texts
are moved as they are, in bounded batches; an empty table gives an empty one; fewer rows than shards leaves shards empty; columns of the
input named shard or slot are replaced, all others kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches, free_name, materialize

#: Rows of a block at least: what one task permutes.
BLOCK_ROWS = 20_000
#: Blocks of a task, about.
BLOCKS_A_TASK = 4
#: Items of a population below which numpy draws exactly.
NUMPY_LIMIT = 1_000_000_000


def rows_of_block(total: int) -> int:
    """Rows of a block: as many as there are blocks, once these are more than BLOCK_ROWS."""
    return max(BLOCK_ROWS, math.isqrt(total))


def block_sizes(total: int, shards: int, block_rows: int) -> np.ndarray:
    """Rows of each block; equally many blocks in a row make up a shard."""
    size = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    per = max(1, -(-int(size.max(initial=0)) // block_rows))
    return np.diff(np.arange(per + 1) * size[:, None] // per, axis=1).ravel()


def draw(rng: np.random.Generator, capacity: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows drawn without replacement fall to each block: the blocks are halved again and again, all halves of a level at once."""
    if not len(capacity):
        return np.zeros(0, np.int64)
    width = 1 << max(0, len(capacity) - 1).bit_length()
    levels = [np.concatenate([np.asarray(capacity, np.int64), np.zeros(width - len(capacity), np.int64)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    got = np.array([n], np.int64)
    for below in reversed(levels[:-1]):
        left, right = below[0::2], below[1::2]
        first = splits(rng, left, right, got)
        got = np.stack([first, got - first], axis=1).ravel()
    return got[: len(capacity)]


def splits(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Independent hypergeometric draws."""
    small = good + bad < NUMPY_LIMIT
    out = np.zeros(len(good), np.int64)
    out[small] = rng.hypergeometric(good[small], bad[small], n[small])
    for k in np.flatnonzero(~small).tolist():
        out[k] = split(rng, int(good[k]), int(bad[k]), int(n[k]))
    return out


def _rise(x: int, d: int) -> float:
    """log((x + d)! / x!) - d * log(x), without the cancellation that two log-gammas would have."""
    if min(x, x + d) < 50:
        return math.lgamma(x + d + 1) - math.lgamma(x + 1) - (d * math.log(x) if x else 0.0)
    tail = lambda y: 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (x + d + 0.5) * math.log1p(d / x) - d + tail(x + d) - tail(x)


def log_ratio(good: int, bad: int, n: int, mode: int, k: int) -> float:
    """log of the probability of k over that of mode, for n draws."""
    d = k - mode
    cells = (mode, d), (good - mode, -d), (n - mode, -d), (bad - n + mode, d)
    if min(x for x, _ in cells) < 50 or min(x + e for x, e in cells) < 50:
        return sum(math.lgamma(x + 1) - math.lgamma(x + e + 1) for x, e in cells)
    up, down = mode * (bad - n + mode), (good - mode) * (n - mode)
    return -sum(_rise(x, e) for x, e in cells) - d * math.log1p((up - down) / down)


def split(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact hypergeometric draw of any size: how many of n items drawn from good + bad are good."""
    total = good + bad
    if n == 0 or good == 0:
        return 0
    if bad == 0 or n == total:
        return min(n, good)
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    # The smaller of each pair of roles; the rest follows from it.
    if n > total - n:
        return good - split(rng, good, bad, total - n)
    if good > bad:
        return n - split(rng, bad, good, n)
    if min(good, n) < 50:  # few draws, one after the other; the roles of good and drawn items are alike
        few, many, hits = min(good, n), max(good, n), 0
        for k in range(few):
            hits += int(rng.integers(total - k)) < many - hits
        return hits
    mode = (n + 1) * (good + 1) // (total + 2)
    p = good / total
    spread = math.sqrt((total - n) / (total - 1) * n * p * (1 - p) + 0.5)
    # Stadlober's table for discrete distributions: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
    reach, centre = 1.7155277699214135 * spread + 0.8989161620588988, n * p + 0.5
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(centre + reach * (v - 0.5) / u)
        if max(0, n - bad) <= k <= min(n, good) and 2 * math.log(u) <= log_ratio(good, bad, n, mode, k):
            return k


def matrix_row(counts: np.ndarray, capacity: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix."""
    before = np.concatenate([[0], np.cumsum(counts)])
    low, high = 0, len(counts)
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(np.random.default_rng([seed, low, high]), capacity, int(before[mid] - before[low]))
        low, high, capacity = (low, mid, left) if part < mid else (mid, high, capacity - left)
    return capacity


def shuffle_shards(docs: DataFrame, n_shards: int, seed: int = 7, stable: bool = False, block_rows: int | None = None) -> DataFrame:
    """docs, each row with shard (0 to n_shards - 1) and slot (gapless from 0 in its shard), uniformly at random."""
    docs = docs.drop("shard", "slot")
    bound_batches(docs.sparkSession)
    if not stable:
        docs = materialize(docs, "shards")
    part, block, at = (free_name(docs, n) for n in ("part", "block", "at"))
    found = {r[0]: r[1] for r in docs.groupBy(F.spark_partition_id().alias(part)).count().collect()}  # one row for each partition
    counts = np.zeros(max(found, default=0) + 1, np.int64)
    counts[list(found)] = list(found.values())
    schema = T.StructType([*docs.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(block, T.IntegerType()), T.StructField(at, T.LongType())])
    share = docs.sparkSession.sparkContext.broadcast(counts)  # 8 bytes a partition
    total = int(counts.sum())
    block_rows = block_rows or rows_of_block(total)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, done, own = np.empty(0, np.int64), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = batch.column(batch.num_columns - 1)
            if own is None:
                own = here[0].as_py()
                row = matrix_row(share.value, block_sizes(total, n_shards, block_rows), own, seed)
                labels = np.random.default_rng([seed, 1, own]).permutation(np.repeat(np.arange(len(row)), row))
            mine = labels[done : done + batch.num_rows]
            if len(mine) < batch.num_rows:
                raise RuntimeError("a partition has other rows than were counted: pass stable=False")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine, pa.int32()), pa.array(np.arange(done, done + len(mine)), pa.int64())], schema=None, names=[*batch.schema.names, block, at])
            done += batch.num_rows
        if done < len(labels):
            raise RuntimeError("a partition has other rows than were counted: pass stable=False")

    dealt = docs.withColumn(part, F.spark_partition_id()).mapInArrow(deal, schema)
    # Blocks per * s to per * s + per - 1 cut the slots of shard s evenly, so both follow from a block's number.
    per = max(1, len(block_sizes(total, n_shards, block_rows)) // n_shards)
    shard = f"(`{block}` DIV {per})"
    rows = f"({total // n_shards}L + CASE WHEN {shard} < {total % n_shards} THEN 1 ELSE 0 END)"
    # A task has a few blocks at most, however many there are in all.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-per * n_shards // BLOCKS_A_TASK))
    dealt = dealt.repartition(tasks, block)
    order = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), part, at), part, at)
    slot = F.expr(f"(`{block}` % {per}) * {rows} DIV {per}") + F.row_number().over(order) - 1
    return dealt.withColumn("shard", F.expr(f"CAST({shard} AS INT)")).withColumn("slot", slot.cast("long")).drop(part, block, at)
