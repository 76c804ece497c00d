"""Keyword retrieval: module keywords, BM25, hit counts, candidates and budgeted packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.scalars import dir_name, query_terms, round_half_up, split_identifier, stem, token_estimate
from lodestone.plans.state import materialize


def module_keywords(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(dir, keyword), distinct: words of the directory and its identifiers, file stems (tests left out), exported names and words of descriptions, minus generic ones."""
    dirs = files.select(dir_name(F.col("path")).alias("dir")).distinct()
    part = dirs.select("dir", F.explode(F.split("dir", "/")).alias("p")).filter(F.length("p") > 2)
    of_dir = part.select("dir", F.lower("p").alias("keyword")).unionByName(part.select("dir", F.explode(split_identifier(F.col("p"))).alias("w")).filter(F.length("w") > 2).select("dir", F.lower("w").alias("keyword")))
    of_file = files.select(dir_name(F.col("path")).alias("dir"), stem(F.col("path")).alias("s")).filter(~F.col("s").rlike(r"\.(test|spec|stories)$")).select("dir", F.lower("s").alias("keyword"))
    public = symbols.filter("exported").withColumn("dir", dir_name(F.col("path")))
    name = F.element_at(F.split("name", r"\."), -1)
    of_name = public.filter(F.length(name) > 3).select("dir", F.lower(name).alias("keyword"))
    of_text = public.select("dir", F.explode(F.split(F.lower(F.coalesce("description", F.lit(""))), "[^a-z]+")).alias("keyword")).filter((F.length("keyword") >= 5) & ~F.col("keyword").isin(*rules.DESCRIPTION_STOP_WORDS))
    return of_dir.unionByName(of_file).unionByName(of_name).unionByName(of_text).filter(~F.col("keyword").isin(*rules.GENERIC_KEYWORDS)).distinct()


def idf(keywords: DataFrame, key: str = "dir") -> DataFrame:
    """(keyword, df, idf) over the distinct keywords of modules."""
    n = keywords.select(F.count_distinct(key).alias("n_modules"))
    counted = keywords.groupBy("keyword").agg(F.count_distinct(key).alias("df"))
    return counted.crossJoin(F.broadcast(n)).select("keyword", "df", F.log((F.col("n_modules") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def average_keywords(keywords: DataFrame, key: str = "dir") -> DataFrame:
    """One row: avgdl, the mean number of keywords of a module."""
    return keywords.agg((F.count("*") / F.count_distinct(key)).alias("avgdl"))


def affix_match(keyword: Column, term: Column) -> Column:
    """Equal, or one begins or ends with the other, which has four characters or more."""
    return (keyword == term) | ((F.length(term) >= 4) & (keyword.startswith(term) | keyword.endswith(term))) | ((F.length(keyword) >= 4) & (term.startswith(keyword) | term.endswith(keyword)))


def bm25(keywords: DataFrame, terms: DataFrame, key: str = "dir") -> DataFrame:
    """(key, score) for the terms (term, and times: how often the query has it) of one query: the number of a module's keywords that match is the term frequency, the rarest match's idf its weight.

    A match by affix has an equal beginning or end of four characters, so terms meet keywords by these: an equi-join and no product."""
    k1, b = rules.BM25_K1, rules.BM25_B
    ends = lambda c: F.array_distinct(F.array(F.concat(F.lit("^"), F.left(c, F.lit(4))), F.concat(F.right(c, F.lit(4)), F.lit("$"))))
    scored = idf(keywords, key)
    vocabulary = scored.select("keyword", "idf", F.explode(ends(F.col("keyword"))).alias("end"))
    asked = terms.select("term", "times", F.explode(ends(F.col("term"))).alias("end"))
    match = vocabulary.join(asked, "end").filter(affix_match(F.col("keyword"), F.col("term"))).select("keyword", "idf", "term", "times").distinct()
    size = keywords.groupBy(key).agg(F.count("*").alias("dl"))
    per = keywords.join(match, "keyword").groupBy(key, "term", "times").agg(F.count("*").alias("tf"), F.max("idf").alias("best"))
    part = F.col("times") * F.col("best") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return per.join(size, key).crossJoin(F.broadcast(average_keywords(keywords, key))).groupBy(key).agg(F.sum(part).alias("score")).filter("score > 0")


def context_hits(keywords: DataFrame, terms: DataFrame, key: str = "dir") -> DataFrame:
    """(key, hits): how many of the query's terms (term, times) hold, or are held by, a keyword of the module. terms is one query's, so it is small."""
    match = keywords.join(F.broadcast(terms), F.contains("keyword", F.col("term")) | F.contains(F.col("term"), F.col("keyword"))).select(key, "term", "times").distinct()
    return match.groupBy(key).agg(F.sum("times").cast("long").alias("hits"))


def keyword_hits(keywords: DataFrame, prompt: str, key: str = "dir") -> DataFrame:
    """(key, hits): how many of a module's keywords the prompt holds; the measure for indexes without BM25 statistics."""
    return keywords.filter(F.contains(F.lit(prompt.lower()), F.lower("keyword"))).groupBy(key).agg(F.count("*").alias("hits"))


def test_lines(mapping: DataFrame, assertions: DataFrame, names: int = 5, each: int = 2) -> DataFrame:
    """(source, text): the tests of a file, its first names with up to two assertions each. mapping: (source, test, test_names); assertions: (path, test, k, text)."""
    listed = mapping.select("source", "test", F.size("test_names").alias("n"), F.posexplode(F.slice("test_names", 1, names)).alias("i", "name"))
    few = assertions.withColumn("r", F.row_number().over(Window.partitionBy("path", "test").orderBy("k"))).filter(F.col("r") <= each)
    own = few.groupBy(F.col("path").alias("test"), F.col("test").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: F.concat(F.lit("\n    "), F.trim(x["text"]))), "").alias("a"))
    wide = listed.join(own.hint("merge"), ["test", "name"], "left").withColumn("line", F.concat(F.lit("\n  - "), "name", F.coalesce("a", F.lit(""))))
    return wide.groupBy("source", "test", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "").alias("lines")).select("source", F.concat(F.lit("# Tests for "), "source", F.lit(": "), "test", F.lit(" ("), F.col("n").cast("string"), F.lit(" tests)"), "lines").alias("text"))


def terms_of(spark, query: str, kind: str) -> DataFrame:
    """(term, times) of a query; repeated terms count again."""
    one = spark.createDataFrame([(query,)], "q string").select(F.explode(query_terms(F.col("q"), kind)).alias("term"))
    return one.groupBy("term").agg(F.count("*").alias("times"))


def issue_candidates(symbols: DataFrame, files: DataFrame, terms: DataFrame, most: int = 8) -> DataFrame:
    """(path, score) of the files that an issue's terms point to: for each term 2 for an exported symbol, else 1 for another, and 1 for the path; the best `most`, ties by path."""
    text = F.lower(F.concat_ws(" ", "name", "signature", F.coalesce("description", F.lit(""))))
    few = F.broadcast(terms)
    hit = symbols.select("path", F.when(F.col("exported"), 2).otherwise(1).alias("worth"), text.alias("hay")).join(few, F.contains("hay", F.col("term"))).groupBy("path", "term", "times").agg((F.max("worth") * F.col("times")).alias("s"))
    by_path = files.select("path").join(few, F.contains(F.lower("path"), F.col("term"))).select("path", "term", "times", F.col("times").alias("s"))
    total = hit.unionByName(by_path).groupBy("path").agg(F.sum("s").cast("long").alias("score"))
    return total.orderBy(F.desc("score"), "path").limit(most)


def pack_prefix(items: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Items in order while what stands before them is below the budget: the last may reach beyond it."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("used_before", before).filter(F.col("used_before") < budget)


def pack_skipping(items: DataFrame, group: list[str], order: str, name: str, size: str, budget: int) -> DataFrame:
    """(group..., picked, used): items in order, each taken if it still fits; those that don't fit are passed over. The items of a group are its ranked candidates, a bounded list."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("x"), F.col(size).alias("s"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("picked"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["s"] <= budget
        return F.when(fits, F.struct((a["used"] + x["s"]).cast("long").alias("used"), F.concat(a["picked"], F.array(x["x"].cast("string"))).alias("picked"))).otherwise(a)

    return items.groupBy(*group).agg(listed.alias("l")).select(*group, F.aggregate("l", start, step).alias("r")).select(*group, F.col("r.picked").alias("picked"), F.col("r.used").alias("used"))


def pack_ranked(items: DataFrame, order: list[Column], name: str, size: str, budget: int, parts: int = 200, few: int = 10_000) -> DataFrame:
    """(name, used_before): items of one ranked list, each taken if it still fits, those that don't passed over; any number of items in bounded memory. Items of equal order go by name.

    What is taken before the first item that doesn't fit is a prefix by running size. Each of `parts` parts of the list keeps its own prefix, which is all that the whole's can hold, and these meet in one. Behind the item that stopped the prefix only smaller
    ones than it can fit, so the next round looks at these alone, with what is left. A list of at most `few` is packed by pack_skipping."""
    ranked = materialize(items.filter(F.col(size) <= budget).select(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col(name).cast("string").alias("name")).alias("o"), F.col(name).cast("string").alias("x"), F.col(size).cast("long").alias("s")), "ranked")
    taken, used, after = [], 0, None
    while True:
        rest = ranked.filter(F.col("s") <= budget - used)
        rest = rest if after is None else rest.join(F.broadcast(after), rest["o"] > after["stop"]).drop("stop")  # one row
        if rest.limit(few + 1).count() <= few:
            break
        left, running = budget - used, lambda by: F.sum("s").over(by.orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
        own = rest.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(parts))).withColumn("run", running(Window.partitionBy("part")))
        # One item beyond the prefix of each part goes along, so the first that doesn't fit is there.
        near = own.filter(F.col("run") - F.col("s") <= left).withColumn("one", F.lit(1))
        whole = materialize(near.withColumn("run", running(Window.partitionBy("one"))).select("o", "x", "s", "run"), "prefix")
        stop = whole.filter(F.col("run") > left).agg(F.min("o").alias("stop"))
        taken.append(whole.filter(F.col("run") <= left).select(F.col("x").alias(name), (F.col("run") - F.col("s") + used).alias("used_before")))
        used += whole.filter(F.col("run") <= left).agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
        after = materialize(stop, "stop")
        if after.first()["stop"] is None:
            return reduce(DataFrame.unionByName, taken)
    start = F.struct(F.lit(used).cast("long").alias("used"), F.array().cast("array<struct<x:string,at:bigint>>").alias("picked"))
    step = lambda a, i: F.when(a["used"] + i["s"] <= budget, F.struct((a["used"] + i["s"]).alias("used"), F.concat(a["picked"], F.array(F.struct(i["x"].alias("x"), a["used"].alias("at")))).alias("picked"))).otherwise(a)
    last = rest.groupBy().agg(F.array_sort(F.collect_list(F.struct("o", "x", "s"))).alias("l")).select(F.explode(F.aggregate("l", start, step)["picked"]).alias("p")).select(F.col("p.x").alias(name), F.col("p.at").alias("used_before"))
    return reduce(DataFrame.unionByName, [*taken, last])


def skeleton(files: DataFrame, symbols: DataFrame, n_files: int) -> DataFrame:
    """(dir, path, text, tokens, used_before): the most central files of the most central directories, within the adaptive budget. files: path, rank, refs, score (complexity)."""
    budget, most = min(8000, 1000 + 2 * n_files), min(200, 50 + n_files // 5)
    public = symbols.filter("exported").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "name", "signature"))), lambda s: F.struct(s["name"].alias("name"), s["signature"].alias("signature"))).alias("s"))
    rows = files.join(public, "path").withColumn("dir", dir_name(F.col("path")))
    name = F.concat(F.regexp_extract("path", r"([^/]*)$", 1), F.when(F.col("refs") > 0, F.concat(F.lit(" ★"), F.col("refs").cast("string"))).otherwise(""))
    detailed = (F.col("score") >= 5) | (F.col("refs") >= 3)
    text = F.when(detailed, F.concat_ws("\n", F.concat(F.array(name), F.transform(F.slice("s", 1, 10), lambda s: F.concat(F.lit("  "), s["signature"]))))).otherwise(F.concat(name, F.lit(": "), F.array_join(F.transform("s", lambda s: F.element_at(F.split(s["name"], r"\."), -1)), ", ")))
    # The best of each directory are enough: no more than `most` files come in all.
    top = rows.withColumn("dir_rank", F.sum("rank").over(Window.partitionBy("dir"))).orderBy(F.desc("dir_rank"), "dir", F.desc("rank"), "path").limit(most)
    sized = top.withColumn("text", text).withColumn("tokens", token_estimate(F.col("text"))).withColumn("one", F.lit(1))
    return pack_prefix(sized, ["one"], [F.desc("dir_rank"), F.col("dir"), F.desc("rank"), F.col("path")], "tokens", budget).select("dir", "path", "text", "tokens", "used_before")


def modules(files: DataFrame, keywords: DataFrame, complexity: DataFrame) -> DataFrame:
    """(dir, name, files, n_files, keywords, complexity) of each directory. n_files needs no list of the files: where files is not asked for, none is made."""
    scored = files.select("path", dir_name(F.col("path")).alias("dir")).join(complexity.select("path", "score"), "path", "left")
    grouped = scored.groupBy("dir").agg(F.array_sort(F.collect_list("path")).alias("files"), F.count("*").alias("n_files"), round_half_up(F.avg(F.coalesce("score", F.lit(0.0))), 1).alias("complexity"))
    words = keywords.groupBy("dir").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return grouped.join(words, "dir", "left").withColumn("name", F.coalesce(F.nullif(F.regexp_replace(F.translate("dir", "/\\", "--"), "^-", ""), F.lit("")), F.lit("root")))


def module_contracts(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, dependencies, dependents): file edges lifted to directories, own ones left out."""
    of = files.select("path", dir_name(F.col("path")).alias("m"))
    lifted = edges.join(of.select(F.col("path").alias("src"), F.col("m").alias("a")), "src").join(of.select(F.col("path").alias("dst"), F.col("m").alias("b")), "dst").filter("a != b").select("a", "b").distinct()
    deps = lifted.groupBy(F.col("a").alias("module")).agg(F.array_sort(F.collect_set("b")).alias("dependencies"))
    back = lifted.groupBy(F.col("b").alias("module")).agg(F.array_sort(F.collect_set("a")).alias("dependents"))
    return of.select(F.col("m").alias("module")).distinct().join(deps, "module", "left").join(back, "module", "left")
