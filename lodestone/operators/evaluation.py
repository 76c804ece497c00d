"""Analytics of evaluation runs: transcripts, paired comparisons, reports, cost caps, resumption, diffs and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.scalars import percent_delta

BLOCK = "struct<type:string,name:string,input:struct<file_path:string>>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
EVENT = f"struct<type:string,subtype:string,message:struct<usage:{USAGE},content:array<{BLOCK}>>,usage:{USAGE},result:string,duration_ms:double,num_turns:int,total_cost_usd:double,is_error:boolean,session_id:string>"


def transcript_metrics(events: DataFrame, key: str = "task") -> DataFrame:
    """A row for each key: token sums over the messages (from the result event if they have none), tool calls by class and server, files read, duration, turns, cost and success. events: key, line and the fields of EVENT."""
    usage = lambda f: F.coalesce(F.col(f"message.usage.{f}"), F.lit(0))
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    is_result = (F.col("type") == "result") | (F.coalesce("duration_ms", F.lit(0.0)) > 0)
    last = F.max_by(F.struct("usage", "result", "duration_ms", "num_turns", "total_cost_usd", "is_error", "subtype", "session_id"), F.struct(is_result.alias("r"), F.col("line")))
    sums = events.groupBy(key).agg(*[F.sum(usage(n)).alias(n) for n in names], last.alias("end"))
    none = (F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)
    sums = sums.select(key, "end", *[F.when(none, F.coalesce(F.col(f"end.usage.{n}"), F.lit(0))).otherwise(F.col(n)).alias(n) for n in names])
    tools = events.select(key, F.explode("message.content").alias("b")).filter("b.type = 'tool_use'").select(key, F.coalesce("b.name", F.lit("")).alias("name"), F.col("b.input.file_path").alias("file"))
    mcp = F.col("name").startswith("mcp__")
    called = tools.groupBy(key).agg(
        F.count("*").alias("tool_calls"), F.count_if(F.col("name") == "Read").alias("file_reads"), F.count_if(F.col("name").isin("Edit", "Write", "MultiEdit")).alias("file_edits"),
        F.count_if(F.col("name").isin("Grep", "Glob")).alias("searches"), F.count_if(mcp).alias("mcp_calls"), F.count_distinct(F.when(F.col("name") == "Read", F.col("file"))).alias("files_read"),
    )
    server = F.coalesce(F.nullif(F.get(F.split("name", "__"), F.lit(1)), F.lit("")), F.lit("unknown"))
    servers = tools.filter(mcp).groupBy(key, server.alias("s")).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("mcp_by_server"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = sums.join(called, key, "left").join(servers, key, "left")
    return joined.select(
        key, (F.col("input_tokens") + F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens")).alias("input_tokens"), "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
        *[zero(c) for c in ("tool_calls", "file_reads", "file_edits", "searches", "mcp_calls", "files_read")], "mcp_by_server",
        F.col("end.duration_ms").alias("duration_ms"), F.col("end.num_turns").alias("num_turns"), F.col("end.total_cost_usd").alias("cost"), F.length("end.result").alias("result_length"),
        (F.coalesce(F.col("end.subtype") == "success", F.lit(False)) & ~F.coalesce("end.is_error", F.lit(False))).alias("success"),
    )


def paired_deltas(runs: DataFrame, task: str, arm: str, base: str, other: str, metrics: list[str]) -> DataFrame:
    """(task, metric, before, after, delta): changes in percent for tasks that both arms have."""
    long_ = runs.select(task, arm, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "value"))
    a, b = (long_.filter(F.col(arm) == x).select(task, "metric", F.col("value").alias(n)) for x, n in ((base, "before"), (other, "after")))
    return a.join(b, [task, "metric"]).withColumn("delta", percent_delta(F.col("before"), F.col("after")))


def summary(runs: DataFrame, arm: str, metrics: list[str]) -> DataFrame:
    """(arm, n, mean and sum of each metric); nulls don't count."""
    return runs.groupBy(arm).agg(F.count("*").alias("n"), *[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("sum", F.sum))])


def short_number(n: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.2M; halves of the last digit are rounded up."""
    n = n.cast("double")
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fK", n / 1_000)).otherwise(n.cast("long").cast("string"))


def _padded(text: Column, width: int, left: bool = True) -> Column:
    """A text filled up with spaces; longer ones stay whole."""
    wide = F.greatest(F.length(text), F.lit(width))
    return F.lpad(text, wide, F.lit(" ")) if left else F.rpad(text, wide, F.lit(" "))


def quality_lines(cells: DataFrame) -> DataFrame:
    """(task, arm, text): a line for each cell of the quality matrix. cells: (task, arm, duration_ms, input_tokens, cost, overall, coverage, accuracy, error); a cell without a duration failed, one without scores is unscored."""
    score = lambda c, width, none: _padded(F.when(F.col("overall").isNull(), none).otherwise(F.concat(F.col(c).cast("string"), F.lit("/5"))), width)
    text = F.concat(
        F.lit("    "), _padded(F.col("arm"), 5, left=False), F.lit(" "), _padded(F.format_string("%.1f", F.col("duration_ms") / 1000), 7), F.lit("s "), _padded(short_number(F.col("input_tokens")), 10),
        F.lit(" $"), _padded(F.format_string("%.4f", F.col("cost")), 6), F.lit(" "), score("overall", 8, "unscored"), F.lit(" "), score("coverage", 9, "-"), F.lit(" "), score("accuracy", 9, "-"),
    )
    failed = F.concat(F.lit("    "), _padded(F.col("arm"), 5, left=False), F.lit(" "), F.left(F.coalesce(F.nullif("error", F.lit("")), F.lit("error")), F.lit(60)))
    return cells.select("task", "arm", F.when(F.col("duration_ms").isNull(), failed).otherwise(text).alias("text"))


def quality_summary(cells: DataFrame) -> DataFrame:
    """(arm, cells, seconds, tokens, cost, overall): means over the cells of each arm that didn't fail; overall over the scored ones, null if none is."""
    whole = cells.filter("duration_ms IS NOT NULL").groupBy("arm").agg(F.count("*").alias("cells"), (F.avg("duration_ms") / 1000).alias("seconds"), F.avg("input_tokens").alias("tokens"), F.avg("cost").alias("cost"), F.avg("overall").alias("overall"))
    return whole.select("arm", "cells", F.round("seconds", 1).alias("seconds"), short_number(F.floor(F.col("tokens") + 0.5)).alias("tokens"), F.round("cost", 4).alias("cost"), F.round("overall", 2).alias("overall"))


def _of_both(runs: DataFrame, task: str, arm: str, base: str, other: str) -> DataFrame:
    """Runs of the two arms for tasks that have both."""
    two = runs.filter(F.col(arm).isin(base, other))
    return two.join(two.groupBy(task).agg(F.count_distinct(arm).alias("_n")).filter("_n = 2").select(task), task, "left_semi")


def server_calls(runs: DataFrame, task: str, arm: str, base: str, other: str, calls: str = "mcp_by_server") -> DataFrame:
    """(server, before, after): calls by server, summed over the tasks that both arms have; servers that only one arm called count 0 in the other. calls: a map by server."""
    each = _of_both(runs, task, arm, base, other).select(arm, F.explode(calls).alias("server", "n"))
    part = lambda a: F.coalesce(F.sum(F.when(F.col(arm) == a, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("server").agg(part(base).alias("before"), part(other).alias("after"))


def comparison_summary(runs: DataFrame, task: str, arm: str, base: str, other: str, metrics: list[str]) -> DataFrame:
    """(metric, tasks, before, after, delta): means over the tasks that both arms have, and the change of the sums in percent."""
    both = _of_both(runs, task, arm, base, other)
    long_ = both.select(task, arm, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "value"))
    of = lambda a: F.sum(F.when(F.col(arm) == a, F.col("value")))
    sums = long_.groupBy("metric").agg(F.count_distinct(task).alias("tasks"), of(base).alias("a"), of(other).alias("b"))
    return sums.select("metric", "tasks", (F.col("a") / F.col("tasks")).alias("before"), (F.col("b") / F.col("tasks")).alias("after"), percent_delta(F.col("a"), F.col("b")).alias("delta"))


def pivot_report(cells: DataFrame, task: str, arm: str, value: str, arms: list[str]) -> DataFrame:
    """A row for each task and a column for each arm."""
    return cells.groupBy(task).pivot(arm, arms).agg(F.first(value))


def pass_fail(results: DataFrame, key: str) -> DataFrame:
    """(key, passed, failed) from resolved flags."""
    return results.groupBy(key).agg(F.count_if("resolved").alias("passed"), F.count_if(~F.col("resolved")).alias("failed"))


def within_cost(cells: DataFrame, group: list[str], order: list[Column], cost: str, cap: float) -> DataFrame:
    """cells with running cost (positive costs only) by group, and whether the cap still held before it."""
    paid = F.when(F.col(cost) > 0, F.col(cost)).otherwise(0.0)
    total = F.sum(paid).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("running_cost", total).withColumn("within_cap", total - paid < cap)


def grid(arms: DataFrame, tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of arms x tasks that are not done yet. Arms are a handful of labels."""
    return F.broadcast(arms).crossJoin(tasks).join(done.select(*keys).distinct(), keys, "left_anti")


def select_arms(known: list[str], wanted: list[str] | None) -> list[str]:
    return [a for a in known if wanted is None or a in wanted]


def rerun_cells(spec: str) -> list[dict[str, str]]:
    """arm=X,task=Y pairs of a rerun specification."""
    import re

    return [{"arm": a, "task": t} for a, t in re.findall(r"arm=([^,\s]+),task=([^,\s;]+)", spec)]


def is_artifact(path: Column, files: tuple = rules.ARTIFACT_FILES, prefixes: tuple = rules.ARTIFACT_PREFIXES) -> Column:
    out = path.isin(*files)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def filter_diff(diff: DataFrame, key: str) -> DataFrame:
    """(key, path, block): the file blocks of unified diffs (key, line, text) that are no tool artifacts; lines before the first block are dropped."""
    by = Window.partitionBy(key).orderBy("line")
    start = F.col("text").startswith("diff --git ")
    place = F.get(F.split("text", " "), F.lit(3))
    named = diff.withColumn("island", F.sum(start.cast("int")).over(by)).filter("island > 0").withColumn("path", F.when(start, F.when(place.startswith("b/"), F.substr(place, F.lit(3))).otherwise(place)))
    blocks = named.groupBy(key, "island").agg(F.max("path").alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("block"))
    return blocks.filter(F.col("path").isNull() | ~is_artifact(F.col("path")))


def judge_scores(replies: DataFrame, fields: list[str], raw: str = "raw") -> DataFrame:
    """replies with score: the whole numbers from 1 to 5 that a judge's JSON holds, null if any is missing or another value."""
    text = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?", ""), r"(\{[\s\S]*\})", 1)
    number = lambda f: F.try_to_number(F.get_json_object(text, f"$.{f}"), F.lit("999999.999999"))
    fine = F.lit(True)
    for f in fields:
        n = number(f)
        fine = fine & F.coalesce((n >= 1) & (n <= 5) & (n == F.floor(n)), F.lit(False))
    return replies.withColumn("score", F.when(fine, F.struct(*[number(f).cast("int").alias(f) for f in fields], F.get_json_object(text, "$.notes").alias("notes"))))


def annotations_of(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """(path, name, description, danger) from replies that map file::symbol to a text or to {description, danger}; fences and prose around the JSON don't matter."""
    text = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?", ""), r"(\{[\s\S]*\})", 1)
    pairs = replies.select(F.explode(F.from_json(text, "map<string,string>")).alias("k", "v")).filter(F.contains("k", F.lit("::")))
    is_object = F.startswith(F.trim("v"), F.lit("{"))
    return pairs.select(F.substring_index("k", "::", 1).alias("path"), F.element_at(F.split("k", "::"), -1).alias("name"), F.when(is_object, F.get_json_object("v", "$.description")).otherwise(F.col("v")).alias("description"), F.when(is_object, F.get_json_object("v", "$.danger")).alias("danger"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows in a random order that the seed fixes."""
    return rows.withColumn("_order", F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns])).orderBy("_order").drop("_order")


def judge_prompts(tasks: DataFrame) -> DataFrame:
    """(name, prompt) for a judge that doesn't know the arm: tasks have name, question, answer, must_contain and must_not."""
    points = lambda head, c: F.concat(F.lit(head), F.array_join(F.transform(c, lambda x: F.concat(F.lit("\n- "), x)), ""))
    return tasks.select("name", F.concat_ws("\n\n", F.concat(F.lit("Question:\n"), "question"), F.concat(F.lit("Answer:\n"), "answer"), points("It should say:", F.col("must_contain")), points("It must not say:", F.col("must_not")), F.lit("Score each field from 1 to 5 and reply as JSON.")).alias("prompt"))


def token_sums(events: DataFrame, cell: list[str]) -> DataFrame:
    """(cell..., input_tokens, output_tokens, cost, turns): sums over assistant events, cost and turns of the result event; turns are null where unknown."""
    usage = lambda f: F.coalesce(F.col(f"message.usage.{f}"), F.lit(0))
    said, ended = F.col("type") == "assistant", F.col("type") == "result"
    read = usage("input_tokens") + usage("cache_read_input_tokens") + usage("cache_creation_input_tokens")
    return events.groupBy(*cell).agg(F.sum(F.when(said, read).otherwise(0)).alias("input_tokens"), F.sum(F.when(said, usage("output_tokens")).otherwise(0)).alias("output_tokens"), F.max(F.when(ended, F.col("total_cost_usd"))).alias("cost"), F.max(F.when(ended, F.col("num_turns"))).alias("turns"))
