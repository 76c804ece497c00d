"""The position of each row within its group, without a window that would hold a hot group in one task.

Rows are dealt by ranges of (group, order), so a large group spreads over many tasks; a row's place within its partition and the sizes of
the group's earlier partitions, a table of one row for each group and partition, give its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, materialize, tasks_for


def with_positions(rows: DataFrame, group: str, order: list[Column], label: str) -> DataFrame:
    """rows, written to the shared folder, with position (long, from 0 in the order within the group) and group_rows. The group must not be null; rows that are equal in the order take any order."""
    place, part, first, tie = (free_name(rows, n) for n in ("place", "part", "first", "tie"))
    # The tie-breaker lets rows that are equal in all else go to several partitions.
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(tasks_for(rows), F.col(group), *order, F.col(tie))
    sorted_ = dealt.sortWithinPartitions(F.col(group), *order, F.col(tie)).drop(tie)
    placed = materialize(sorted_.withColumn(place, F.monotonically_increasing_id()), label).withColumn(part, F.shiftright(place, 33))
    runs = placed.groupBy(group, part).agg(F.min(place).alias(first), F.count("*").alias("n"))
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(by.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, part, (before - F.col(first)).alias(first), F.sum("n").over(by).alias("group_rows"))
    return placed.join(runs, [group, part]).select(*rows.columns, (F.col(place) + F.col(first)).alias("position"), "group_rows")
