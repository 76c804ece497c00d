"""A resumable queue of batches, for work whose results are paid for: annotation of symbols by a model outside.

Items are cut into numbered batches once, and the batches kept; each round claims the next open ones, has them annotated and writes their results under their numbers. A round that was killed has written no whole result, so it is done again; one that was written is never done twice.
Killed and restarted, a queue thus gives the same annotations as if it had run through. It stops when what the results cost reaches the budget.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.state import materialize
from lodestone.sources.bundle import Folder


def split_cached(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): items (key, ...) whose key the cache (key, ...) has, with its columns, and the rest."""
    return items.join(cache, "key"), items.join(cache.select("key"), "key", "left_anti")


def numbered_batches(items: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """items with batch, numbers that follow the order: a batch holds items of at most `most` together, as far as each alone doesn't exceed it.

    Sizes are added up within ranges of the order, and ranges by their sums, so no task holds all items; a batch ends with its range."""
    dealt = items.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(dealt, "queue-items").withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # An item belongs to the stretch in which its end falls, so a stretch's items never sum up to more than `most` and the item before it.
    own = placed.withColumn("_own", F.floor((before + F.greatest(F.col(size), F.lit(1)) - 1) / most))
    starts = own.groupBy("_part").agg((F.max("_own") + 1).alias("_n"))
    shifted = starts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each range
    return own.join(shifted, F.col("_part") == F.col("_p")).select(*items.columns, (F.col("_own") + F.col("_base")).alias("batch"))


class WorkQueue:
    """A queue in a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.root = self.folder.root

    def fill(self, items: DataFrame, order: str = "key", size: str = "size", most: int = 10_000) -> None:
        """Cut the items into batches, unless the queue was filled before."""
        if not self.folder.has("batches/_SUCCESS"):
            numbered_batches(items, order, size, most).write.mode("overwrite").partitionBy("batch").parquet(f"{self.root}/batches")

    def batches(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/batches").parquet(f"{self.root}/batches")

    def done(self) -> list[str]:
        """Folders of whole results, named by the first and last batch of each."""
        return [n for n in Folder(self.spark, f"{self.root}/results").names() if self.folder.has(f"results/{n}/_SUCCESS")]

    def results(self) -> DataFrame | None:
        found = self.done()
        return self.spark.read.parquet(*[f"{self.root}/results/{n}" for n in found]) if found else None

    def open_batches(self, most: int) -> list[int]:
        """The numbers of the next batches without results, at most so many."""
        spans = [tuple(map(int, n.split("-"))) for n in self.done()]
        numbers = self.batches().select("batch").distinct()
        for low, high in spans:
            numbers = numbers.filter(~F.col("batch").between(low, high))
        return [r["batch"] for r in numbers.orderBy("batch").limit(most).collect()]

    def claims(self) -> DataFrame:
        """(first, last, run) of all rounds that were begun, done or not."""
        return self.spark.read.schema("first long, last long, run string").json(f"{self.root}/claims")

    def run(self, annotate: Callable[[DataFrame], DataFrame], budget: float | None = None, batches_a_round: int = 8, cost: str = "cost") -> str:
        """Rounds until nothing is open ("done") or the results' cost reaches the budget ("budget"). annotate(rows of some batches) gives the rows of their results, with their cost."""
        while True:
            known = self.results()
            if budget is not None and known is not None and (known.agg(F.sum(cost)).first()[0] or 0) >= budget:
                return "budget"
            numbers = self.open_batches(batches_a_round)
            if not numbers:
                return "done"
            # A round is one run of numbers, so its folder's name tells which it holds.
            claimed = [n for k, n in enumerate(numbers) if n == numbers[0] + k]
            span = self.spark.range(1).select(F.lit(claimed[0]).cast("long").alias("first"), F.lit(claimed[-1]).cast("long").alias("last"), F.lit(uuid.uuid4().hex).alias("run"))
            span.write.mode("append").json(f"{self.root}/claims")
            rows = self.batches().filter(F.col("batch").between(claimed[0], claimed[-1]))
            annotate(rows).write.mode("overwrite").parquet(f"{self.root}/results/{claimed[0]}-{claimed[-1]}")
