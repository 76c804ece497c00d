"""Reports and text renderings: plan, token statistics, checks, danger notes, and the answers of the nine tools as text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.scalars import base_name, dir_name, human_tokens, split_identifier, stem, token_estimate
from lodestone.operators.retrieval import affix_match, idf


def plan_report(files: DataFrame, most: int = 8) -> DataFrame:
    """(ext, n, files, tokens): the most frequent extensions, and for the whole tree its files and the tokens of a map of it: 800 and 15 a file, within 800 and 4000."""
    n = files.agg(F.count("*").alias("files"))
    tokens = F.least(F.lit(4000), F.greatest(F.lit(800), 800 + 15 * F.col("files")))
    return files.groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(most).crossJoin(n).withColumn("tokens", tokens)


def token_statistics(outputs: DataFrame) -> DataFrame:
    """(layer, files, tokens, shown) of generated texts (layer, text)."""
    sums = outputs.groupBy("layer").agg(F.count("*").alias("files"), F.sum(token_estimate(F.col("text"))).alias("tokens"))
    return sums.withColumn("shown", human_tokens(F.col("tokens")))


def check_report(facts: DataFrame) -> DataFrame:
    """(check, status) of one row of facts: has_index, skeleton_chars, commits_behind, modules, has_hooks."""
    c = F.col
    checks = [
        ("index", F.when(c("has_index"), "pass").otherwise("fail")),
        ("skeleton size", F.when(c("skeleton_chars").isNull(), "fail").when(c("skeleton_chars") > 40_000, "warn").otherwise("pass")),
        ("freshness", F.when(c("commits_behind") > 10, "warn").otherwise("pass")),
        ("modules", F.when(c("modules") > 0, "pass").otherwise("warn")),
        ("hooks", F.when(c("has_hooks"), "pass").otherwise("warn")),
    ]
    return facts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status")) for n, s in checks])).alias("x")).select("x.*")


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def danger_keywords(notes: DataFrame) -> DataFrame:
    """(file, symbol, keyword) of danger notes (file, symbol, danger): the symbol and its words, the file's stem, directories of four letters or more, and the first 15 distinct words of five letters or more."""
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower("danger"), "[^a-z]+"), lambda w: F.length(w) >= 5)), 1, 15)
    dirs = F.filter(F.split(F.lower(dir_name(F.col("file"))), "/"), lambda d: F.length(d) >= 4)
    own = F.concat(F.array(F.lower("symbol"), F.lower(stem(F.col("file")))), F.transform(split_identifier(F.col("symbol")), F.lower), dirs, words)
    return notes.select("file", "symbol", F.explode(F.array_distinct(own)).alias("keyword")).filter("keyword != ''")


def danger_hits(notes: DataFrame, terms: DataFrame, least: float = 2.0, most: int = 5) -> DataFrame:
    """(file, symbol, danger, score): the notes that match a request's terms (term, times) best, above the confidence threshold."""
    k1, b = rules.BM25_K1, rules.BM25_B
    keys = danger_keywords(notes).withColumn("item", F.concat_ws("::", "file", "symbol"))
    # A request has a handful of terms: they choose among the distinct keywords before these meet any note. All else may be as long as the notes, so it is merged, never sent around whole.
    match = idf(keys, "item").join(F.broadcast(terms), affix_match(F.col("keyword"), F.col("term"))).select("keyword", "idf", "term", "times")
    size = keys.groupBy("item").agg(F.count("*").alias("dl"))
    mean = size.agg(F.avg("dl").alias("avgdl"))
    hit = keys.select("item", "keyword").join(match.hint("merge"), "keyword").groupBy("item", "term", "times").agg(F.count("*").alias("tf"), F.max("idf").alias("best"))
    part = F.col("times") * F.col("best") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    total = hit.join(size.hint("merge"), "item").crossJoin(F.broadcast(mean)).groupBy("item").agg(F.sum(part).alias("score")).filter(F.col("score") > least)
    return notes.withColumn("item", F.concat_ws("::", "file", "symbol")).join(total.hint("merge"), "item").orderBy(F.desc("score"), "item").limit(most).select("file", "symbol", "danger", "score")


def danger_rules(notes: DataFrame, most_dirs: int = 30) -> DataFrame:
    """(dir, n, text): danger notes by directory, the directories with most notes first."""
    line = F.concat(F.lit("- "), "symbol", F.lit(": "), "danger")
    grouped = notes.withColumn("dir", dir_name(F.col("file"))).groupBy("dir").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return grouped.orderBy(F.desc("n"), "dir").limit(most_dirs)


def overview_groups(symbols: DataFrame, depth: int = 2, files: int = 6, each: int = 4) -> DataFrame:
    """(group, path, name): the first symbols of the first files of each group of leading path segments."""
    group = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    ranked = symbols.withColumn("group", group).withColumn("f", F.dense_rank().over(Window.partitionBy("group").orderBy("path"))).withColumn("k", F.row_number().over(Window.partitionBy("group", "path").orderBy("line")))
    return ranked.filter((F.col("f") <= files) & (F.col("k") <= each)).select("group", "path", "name")


def required_variables(variables: DataFrame, few: int = 10, shown: int = 5) -> DataFrame:
    """(category, text) of variables without a default; beyond `few` in all, categories of more than `shown` list three and count the rest."""
    need = variables.filter("required AND NOT has_default")
    total = need.agg(F.count("*").alias("total"))
    names = need.groupBy("category").agg(F.array_sort(F.collect_list("name")).alias("names")).crossJoin(total)
    short = F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.lit(" +"), (F.size("names") - 3).cast("string"), F.lit(" more"))
    return names.select("category", F.when((F.col("total") > few) & (F.size("names") > shown), short).otherwise(F.array_join("names", ", ")).alias("text"))


def package_lines(packages: DataFrame, most: int = 12) -> DataFrame:
    """(name, text) of the first packages: private ones, then by imports."""
    text = F.concat(F.lit("  - "), "name", F.when(F.col("version").isNull(), "").otherwise(F.concat(F.lit("@"), "version")), F.lit(" — "), F.col("import_count").cast("string"), F.lit(" imports"), F.when(F.col("is_private"), " [private]").otherwise(""))
    return packages.orderBy(F.desc("is_private"), F.desc("import_count"), "name").limit(most).select("name", text.alias("text"))


def route_lines(grouped: DataFrame) -> DataFrame:
    """(path, text) of grouped routes: methods, path and tags."""
    tags = F.concat(F.filter(F.array("auth", F.when(F.col("body_schema").isNotNull(), F.concat(F.lit("body:"), "body_schema"))), lambda x: x.isNotNull()), F.col("middleware"))
    return grouped.select("path", F.concat(F.lit("  "), F.array_join("methods", ","), F.lit(" "), "path", F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, ", "), F.lit("]"))).otherwise("")).alias("text"))


def script_lines(scripts: DataFrame) -> DataFrame:
    return scripts.select("slot", F.concat(F.lit("  "), "slot", F.lit(": "), "command").alias("text"))


def convention_lines(conventions: DataFrame) -> DataFrame:
    return conventions.groupBy("category").agg(F.array_join(F.collect_list("text"), "; ").alias("text"))


def staleness_line(report: DataFrame, age: Column) -> DataFrame:
    text = F.when(F.col("stale"), F.concat(F.lit("index is stale: "), F.col("changed").cast("string"), F.lit(" files changed, built "), age, F.lit(" ago"))).otherwise(F.concat(F.lit("index is fresh, built "), age, F.lit(" ago")))
    return report.select(text.alias("text"))


def prompt_rows(symbols: DataFrame, windows: DataFrame, lines: DataFrame, chains: DataFrame, contexts: DataFrame, assertions: DataFrame, tiers: DataFrame) -> DataFrame:
    """(path, tier, text): what an annotator is asked about a file: its undocumented exports, code around them, call chains, callers and up to five assertions. Nothing is sent anywhere."""
    open_ = symbols.filter("exported AND coalesce(description, '') = ''").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]), ", ").alias("open"))
    shown = windows.join(lines.select("path", "line", "text"), ["path", "line"]).withColumn("t", F.concat(F.when(F.col("gap"), "...\n").otherwise(""), "text"))
    code = shown.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("code"))
    chain = chains.select(F.col("id").alias("path"), F.array_join(F.reverse("chain"), " → ").alias("chain"))
    calls = contexts.groupBy(F.col("def_path").alias("path")).agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.concat(base_name(F.col("importer")), F.lit(":"), F.col("line").cast("string"), F.lit(": "), "call"))), 1, 3), "\n").alias("callers"))
    tests = assertions.groupBy("path").agg(F.array_join(F.slice(F.collect_list("text"), 1, 5), "\n").alias("tests"))
    wide = open_.join(tiers.select("path", "tier"), "path", "left").join(code, "path", "left").join(chain, "path", "left").join(calls, "path", "left").join(tests, "path", "left")
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head + "\n"), c))
    return wide.select("path", "tier", F.concat_ws("\n\n", part("Describe:", F.col("open")), part("Code:", F.col("code")), part("Reached by:", F.col("chain")), part("Callers:", F.col("callers")), part("Tests:", F.col("tests"))).alias("text"))


def auth_context(routes: DataFrame, symbols: DataFrame, models: DataFrame, files: int = 20, each: int = 5) -> dict[str, DataFrame]:
    """What has to do with access: files (path, functions), models (name, fields) and guarded routes."""
    word = r"(?i)(auth|login|session|jwt|oauth|password|signup|token|user)"
    hit = symbols.filter(F.col("path").rlike(word)).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("line"))).filter(F.col("k") <= each)
    found = hit.groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("functions")).orderBy("path").limit(files)
    tables = models.filter(F.col("name").rlike(word)).select("name", F.slice(F.transform("fields", lambda f: f["name"]), 1, each).alias("fields"))
    return {"files": found, "models": tables, "routes": routes.filter("auth IS NOT NULL")}


def related_modules(ranked: DataFrame, contracts: DataFrame) -> DataFrame:
    """(module, relation, k) to load after each ranked module (module, k): its dependencies and dependents, each module once, where it comes first; those ranked themselves are left out."""
    wide = ranked.join(contracts, "module")
    both = wide.select("k", F.explode("dependencies").alias("m"), F.lit("dependency").alias("relation")).unionByName(wide.select("k", F.explode("dependents").alias("m"), F.lit("dependent").alias("relation")))
    first = both.groupBy("m").agg(F.min_by(F.struct("k", "relation"), F.struct("k", F.col("relation"))).alias("x"))
    return first.select(F.col("m").alias("module"), "x.relation", "x.k").join(ranked.select("module"), "module", "left_anti")


def write_artifacts(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a bundle as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
