"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is two aggregations and joins on the links; labels meet in a number of rounds that grows with the logarithm of
the longest chain. Links are written to the shared folder after each round, so lost executors cost one round at most, and nothing but two
numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize


#: Parts that a node's links are dealt to, so a hub's links are no single task's.
SALTS = 64


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b). Each node's neighbours above it (large) or below it (small) are tied to the least of the node and its neighbours.

    The least is found by part and then by node, and joined back by part: a hub has SALTS parts, other nodes as many as they have links."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    salted = both.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = part.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("parts")).select("a", F.least("a", "m").alias("m"), "parts")
    tied = salted.join(least.select("a", "m", F.explode("parts").alias("s")), ["a", "s"])
    if large:
        out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b; any order, loops and repeats allowed): root is the least node reachable. Nodes without links don't come."""
    at = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        at = materialize(_star(_star(at, True), False), "links")
        # Stable once every link ties a node to a root: the links' number and sum no longer change.
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
