"""Each row with the one that follows it in a global order, in one exchange of the rows.

A window over the whole table would sort all rows in one task. Here values sampled from the order cut the rows into buckets of
about equal size; as the cuts are values that rows have, the first row of each bucket is known before the exchange
and goes to the bucket before it as well, where it closes the order as a ghost. Rows of one order value are told apart by their first tie-breaker
where this is a long; only rows that are equal in both share a bucket.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import free_name

LOWEST = -(2**63)
#: Rows of a bucket at least, and sampled values for each: the driver sorts these.
BUCKET_ROWS, SAMPLE = 1_000, 20


def rows_of_bucket(total: int, least: int = BUCKET_ROWS) -> int:
    """Rows of a bucket: as many as there are buckets, once these are more than `least`. Tasks and the driver's list of bounds both grow as the square root of the rows."""
    return max(least, math.isqrt(total))


def position(bounds: Column, size: int, value: Column) -> Column:
    """Index (from 1) of the first bound that is not below value, by binary search."""
    steps = max(1, size.bit_length())
    start = F.struct(F.lit(1).alias("low"), F.lit(size).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        above = F.element_at(bounds, mid) < value
        return F.when(acc["low"] >= acc["high"], acc).otherwise(F.struct(F.when(above, mid + 1).otherwise(acc["low"]).alias("low"), F.when(above, acc["high"]).otherwise(mid).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["low"])


def sampled_cuts(keys: DataFrame, key: str, total: int, bucket_rows: int, sample: int = SAMPLE) -> list:
    """Values of key that cut its rows into buckets of about bucket_rows: the quantiles of a sample of distinct values by hash, as plain Python values."""
    n = max(1, total // bucket_rows)
    every = max(1, total // (sample * n))
    found = keys.select(key).filter(F.pmod(F.xxhash64(key), F.lit(every)) == 0).distinct().toArrow().column(0).to_pylist()  # about `sample` values a bucket
    found.sort(key=lambda v: tuple(v.values()) if isinstance(v, dict) else v)
    cuts = [found[(i + 1) * len(found) // n - 1] for i in range(n) if (i + 1) * len(found) // n]
    return [c for k, c in enumerate(cuts) if not k or c != cuts[k - 1]]


def with_next(rows: DataFrame, order: str, ties: list[Column], carry: list[str], bucket_rows: int | None = None, keep: bool = False) -> DataFrame:
    """rows with next, a struct of the carry columns of the row that follows in descending `order` (a long, nulls last), after the last the first. ties: order of rows of equal value; the first should be a long.

    keep: also bucket, place (from 1 within the bucket) and ghost, with the ghost rows still there, for further windows in the same order and partitioning."""
    key, bucket, ghost = (free_name(rows, n) for n in ("key", "bucket", "ghost"))
    first = ties[0] if ties and isinstance(rows.select(ties[0]).schema[0].dataType, T.LongType) else F.lit(0).cast("long")
    # In descending order of the struct, order falls and the tie-breaker rises.
    keyed = rows.withColumn(key, F.struct(F.coalesce(F.col(order), F.lit(LOWEST)).cast("long").alias("k"), F.bitwise_not(first).alias("t")))
    counted = keyed.agg(F.count("*").alias("n"), F.max(key).alias("m")).first()
    cuts = sampled_cuts(keyed, key, counted["n"], bucket_rows or rows_of_bucket(counted["n"])) if counted["n"] else [{"k": 0, "t": 0}]
    top = counted["m"].asDict() if counted["m"] is not None else cuts[-1]
    if cuts[-1:] != [top]:
        cuts.append(top)
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<struct<k:bigint,t:bigint>>")
    at = position(bounds, len(cuts), F.col(key))
    following = F.when(F.element_at(bounds, F.col(bucket)) == F.col(key), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = (
        keyed.withColumn(bucket, at)
        .withColumn(ghost, F.explode(following))
        .withColumn(bucket, F.when(F.col(ghost) == 0, F.col(bucket)).otherwise(F.col(bucket) % len(cuts) + 1))
    )
    window = Window.partitionBy(bucket).orderBy(ghost, F.col(key).desc(), *ties)
    following_row = F.struct(*[F.lead(c).over(window).alias(c) for c in carry]).alias("next")  # plain columns: a struct would go through the exchange beside them
    if keep:
        return dealt.select(*rows.columns, F.col(bucket).alias("bucket"), F.col(ghost).alias("ghost"), following_row, F.row_number().over(window).alias("place"))
    return dealt.select("*", following_row).filter(F.col(ghost) == 0).drop(key, bucket, ghost)
