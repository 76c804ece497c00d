"""Annotation of an index: what to ask about each file, which answers are known, and the queue that asks for the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import annotation_key, token_estimate
from lodestone.operators import evaluation as E
from lodestone.operators import extract as X
from lodestone.operators import graph as G
from lodestone.operators import matching as M
from lodestone.operators import reports as P
from lodestone.plans.state import materialize
from lodestone.streaming.work_queue import WorkQueue, split_cached

#: Rank of the tiers: what matters most is asked first, so a budget that runs out leaves the rest.
_TIERS = ("critical", "standard", "peripheral")


def annotation_prompts(index: dict[str, DataFrame], version: str, signals: DataFrame | None = None) -> DataFrame:
    """(key, path, tier, text, size, turn): a row for each file with undocumented exports. key: the cache key of its answers; size: tokens; turn: its place in the order of tier and path. signals: (file, commits, minor_authors) of the history, if known."""
    files = index["files"].select("path", "content")
    churn = signals.select(F.col("file").alias("path"), "commits", "minor_authors") if signals is not None else files.select("path", F.lit(0).alias("commits"), F.lit(0).alias("minor_authors"))
    measured = files.select("path").join(index["ranks"].select(F.col("id").alias("path"), "rank"), "path", "left").join(churn, "path", "left")
    measured = measured.join(index["complexity"].select("path", "fan_out", F.col("score").alias("complexity")), "path", "left").join(index["tests"].select(F.col("source").alias("path"), F.lit(True).alias("has_tests")), "path", "left")
    tiers = materialize(G.tiers(G.importance(measured), "importance", ["path"]).select("path", "tier"), "tiers")
    chains = G.call_chain(index["edges"], index["ranks"], files.select(F.col("path").alias("id")))
    asked = P.prompt_rows(index["symbols"], M.code_windows(index["symbols"]), X.lines(index["files"]), chains, M.caller_context(index["files"], index["symbol_refs"]), index["assertions"], tiers)
    exported = index["symbols"].filter("exported").groupBy("path").agg(F.collect_set("name").alias("names"))
    keyed = asked.join(files, "path").join(exported, "path").withColumn("key", annotation_key(F.col("content"), F.col("names"), version))
    rank = F.array_position(F.array(*[F.lit(t) for t in _TIERS]), F.col("tier"))
    return keyed.select("key", "path", "tier", "text", token_estimate(F.col("text")).cast("long").alias("size"), F.concat(rank.cast("string"), F.lit(" "), "path").alias("turn"))


def annotate_index(index: dict[str, DataFrame], root: str, ask: Callable[[DataFrame], DataFrame], version: str, cache: DataFrame | None = None, signals: DataFrame | None = None, budget: float | None = None, most_tokens: int = 20_000) -> tuple[DataFrame, DataFrame, str]:
    """(annotations (path, name, description, danger), cache to keep (key, raw), how the queue ended). ask(rows of prompts) gives (key, raw, cost): the replies as they came, for all rows of some batches. cache: (key, raw) of earlier runs.

    root is the queue's folder: called again after a kill with the same index, it goes on where it was."""
    prompts = materialize(annotation_prompts(index, version, signals), "prompts")
    none = prompts.limit(0).select("key", F.lit("").alias("raw"))
    hits, misses = split_cached(prompts, cache.select("key", "raw")) if cache is not None else (none, prompts)
    queue = WorkQueue(prompts.sparkSession, root)
    queue.fill(misses.drop("raw"), "turn", "size", most_tokens)
    ended = queue.run(lambda rows: ask(rows).select("key", "raw", "cost"), budget)
    fresh = queue.results()
    known = hits.select("key", "raw") if fresh is None else hits.select("key", "raw").unionByName(fresh.select("key", "raw"))
    return E.annotations_of(known.select("raw")), known.distinct(), ended
