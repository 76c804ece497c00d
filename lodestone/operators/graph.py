"""Iterative and graph operators over edges (src, dst, weight) and nodes (id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.scalars import base_name
from lodestone.plans.state import materialize, new_folder


def page_rank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) after `rounds` synchronous rounds: shares by weight, dangling mass spread by teleport.

    seeds (id, weight): teleport goes to them in proportion, nowhere else; without any positive weight, to all alike. Each round is one
    join and one aggregation on the edges; what the driver sees of a round is one number, the dangling mass. What nothing links to has its teleport times
    a rate, the same for all such nodes: they and their edges are summed up once, and the rounds move only the others.
    """
    total = F.sum("weight").over(Window.partitionBy("src"))
    shares = materialize(edges.repartition("src").groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("share", F.col("weight") / total).select("src", "dst", "share"), "shares")
    n = nodes.count()
    teleport = nodes.select("id", F.lit(1.0 / max(1, n)).alias("tp"))
    if seeds is not None and (mass := seeds.agg(F.sum("weight")).first()[0]) and mass > 0:
        teleport = nodes.select("id").join(seeds.groupBy("id").agg(F.sum("weight").alias("weight")), "id", "left").select("id", F.coalesce(F.col("weight") / mass, F.lit(0.0)).alias("tp"))
    ends = shares.select(F.col("src").alias("id"), F.lit(True).alias("out"), F.lit(False).alias("in")).unionByName(shares.select(F.col("dst").alias("id"), F.lit(False).alias("out"), F.lit(True).alias("in"))).groupBy("id").agg(F.bool_or("out").alias("out"), F.bool_or("in").alias("in"))
    base = materialize(teleport.join(ends.hint("merge"), "id", "left").select("id", "tp", (~F.coalesce("out", F.lit(False))).alias("dangling"), F.coalesce("in", F.lit(False)).alias("fed")), "teleport")
    unfed, given = base.filter("NOT fed"), F.sum(F.col("tp") * F.col("share")).alias("given")
    constant = shares.join(unfed.select(F.col("id").alias("src"), "tp").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(given)
    core = materialize(base.filter("fed").join(constant.hint("merge"), "id", "left").select("id", "tp", "dangling", F.coalesce("given", F.lit(0.0)).alias("given")), "core")
    inner = materialize(shares.join(core.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi"), "inner")
    lone = unfed.filter("dangling").agg(F.sum("tp")).first()[0] or 0.0
    mass_of = F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0))
    at, rate = core.withColumn("rank", F.col("tp")), 1.0
    dangling = (at.agg(mass_of).first()[0] or 0.0) + lone
    for k in range(rounds):
        sent = inner.join(at.select(F.col("id").alias("src"), "rank").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = (1 - damping) * F.col("tp") + damping * (F.coalesce("got", F.lit(0.0)) + rate * F.col("given")) + damping * dangling * F.col("tp")
        seen = Observation(f"round{k}")
        new = core.join(sent.hint("merge"), "id", "left").select("id", "dangling", rank.alias("rank"))
        at = materialize(new.observe(seen, mass_of.alias("mass")).select("id", "rank"), "rank")
        rate = 1 - damping + damping * dangling
        dangling = (seen.get["mass"] or 0.0) + rate * lone
    return at.select("id", "rank").unionByName(unfed.select("id", (rate * F.col("tp")).alias("rank")))


def ref_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, refs): distinct sources of each node, zeros included."""
    counted = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("refs"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))


def _bits(numbers: DataFrame) -> DataFrame:
    """(bucket, bits): numbers (n, from 0) as bitmaps of 32768 each."""
    return numbers.groupBy(F.bitmap_bucket_number(F.col("n") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("n") + 1)).alias("bits"))


def _unmarked(rows: DataFrame, marked: DataFrame, column: str) -> DataFrame:
    """The rows whose number isn't in the bitmaps."""
    place = F.bitmap_bit_position(F.col(column) + 1)
    at = rows.withColumn("bucket", F.bitmap_bucket_number(F.col(column) + 1)).join(marked, "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", F.coalesce(byte, F.lit(0)), (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return at.filter(~held).select(*rows.columns)


def transitive_dependents(edges: DataFrame, start: DataFrame, most_rounds: int = 100_000, wide: float = 0.05) -> DataFrame:
    """(id, depth) of all nodes from which a start (id) can be reached; a start is among them only through a cycle.

    Nodes are numbered once, so rounds move longs. A round writes its new nodes as one more folder and a bitmap of all reached so far (a bit for each node of the buckets touched, rewritten in each round); it reads the last frontier and that bitmap, never the folders before, so what is written
    grows with the result. A frontier of more than a share `wide` of the nodes turns the step round: edges from unreached nodes are picked by the bitmap first, and only these look for the frontier."""
    spark, into = edges.sparkSession, edges.select(F.col("dst").alias("id"), F.col("src").alias("next"))
    ids = into.select("id").unionByName(into.select(F.col("next").alias("id"))).distinct()
    # Numbers of a partition follow each other, so buckets are dense but for the last of each.
    nodes = materialize(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()), "nodes")
    total = nodes.count()
    numbered = into.join(nodes.select("id", F.col("n").alias("a")), "id").join(nodes.select(F.col("id").alias("next"), F.col("n").alias("b")), "next")
    steps = materialize(numbered.select("a", "b").distinct(), "steps")
    folder = new_folder(spark, "closure")
    frontier, marked = materialize(nodes.join(start.select("id").distinct(), "id", "left_semi").select("n"), "start"), None
    size = frontier.count()
    for depth in range(1, most_rounds + 1):
        if size > wide * total and marked is not None:
            new = _unmarked(steps, marked, "b").join(frontier.select(F.col("n").alias("a")), "a", "left_semi").select(F.col("b").alias("n")).distinct()
        else:
            new = frontier.join(steps.withColumnRenamed("a", "n"), "n").select(F.col("b").alias("n")).distinct()
            new = new if marked is None else _unmarked(new, marked, "n")
        new.write.parquet(f"{folder}/depth={depth}")
        frontier = spark.read.schema("n long").parquet(f"{folder}/depth={depth}")
        size = frontier.count()  # from the footers
        if not size:
            break
        bits = _bits(frontier)
        marked = materialize(bits if marked is None else bits.unionByName(marked).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")), "marked")
    else:
        raise RuntimeError("the closure did not end")
    return spark.read.schema("n long, depth int").option("basePath", folder).parquet(folder).join(nodes, "n").select("id", "depth")


def dependents_within_two(edges: DataFrame) -> DataFrame:
    """(id, dependent, depth): direct dependents of each node and theirs, the node itself left out."""
    one = edges.select(F.col("dst").alias("id"), F.col("src").alias("dependent")).distinct()
    two = one.join(one.select(F.col("id").alias("dependent"), F.col("dependent").alias("far")), "dependent").select("id", F.col("far").alias("dependent"))
    both = one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2)))
    return both.filter("id != dependent").groupBy("id", "dependent").agg(F.min("depth").alias("depth"))


def call_chain(edges: DataFrame, ranks: DataFrame, start: DataFrame, seeds: DataFrame | None = None, hops: int = 6) -> DataFrame:
    """(id, chain): from each start, up to `hops` steps to the unvisited importer of highest rank (ties: least id); ends at a seed after the first step."""
    importers = edges.select(F.col("dst").alias("at"), F.col("src").alias("importer")).distinct().join(ranks.select(F.col("id").alias("importer"), "rank"), "importer")
    walk = start.select("id", F.col("id").alias("at"), F.array("id").alias("chain"), F.lit(True).alias("open"))
    ends = seeds.select(F.col("id").alias("at"), F.lit(True).alias("seed")) if seeds is not None else None
    for depth in range(hops):
        going = walk.filter("open")
        if ends is not None and depth:
            going = going.join(ends, "at", "left").filter(F.col("seed").isNull()).drop("seed")
        step = going.join(importers, "at").filter(~F.array_contains("chain", F.col("importer")))
        best = step.groupBy("id").agg(F.min_by("importer", F.struct(-F.col("rank"), F.col("importer"))).alias("next"))
        moved = walk.join(best, "id", "left")
        walk = moved.select("id", F.coalesce("next", "at").alias("at"), F.when(F.col("next").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("next"))).alias("chain"), (F.col("open") & F.col("next").isNotNull()).alias("open"))
        if depth % 2:
            walk = materialize(walk, "walk")
    return walk.select("id", "chain")


def call_trace(calls: DataFrame, start: DataFrame, width: int = 5) -> DataFrame:
    """(id, callee, depth): up to `width` callees of each start and of each of these, by position; each callee once, where it comes first. calls: (caller, callee, pos)."""
    first = calls.withColumn("k", F.row_number().over(Window.partitionBy("caller").orderBy("pos", "callee"))).filter(F.col("k") <= width)
    one = start.select("id").join(first.select(F.col("caller").alias("id"), "callee", "k"), "id").withColumn("depth", F.lit(1)).withColumn("order", F.col("k") * 1000)
    two = one.select("id", F.col("callee").alias("via"), F.col("order").alias("above")).join(first.select(F.col("caller").alias("via"), "callee", "k"), "via").select("id", "callee", F.lit(2).alias("depth"), (F.col("above") + F.col("k")).alias("order"))
    seen = one.select("id", "callee", "depth", "order").unionByName(two).filter("id != callee")
    return seen.groupBy("id", "callee").agg(F.min_by("depth", "order").alias("depth"), F.min("order").alias("position"))


def entry_seeds(files: DataFrame) -> DataFrame:
    """(id, weight) of files that others start from. files: id, in_edges, out_edges, exported (count), most_callers."""
    name = base_name(F.col("id"))
    weight = (
        F.when((F.col("in_edges") == 0) & (F.col("out_edges") > 0), 2).otherwise(0)
        + F.when(F.col("id").rlike(r"(?i)(?:^|\/)(index|main|app|cli|server|routes?|router|entry|start|mod|lib)\.[jt]sx?$") | F.col("id").contains("/bin/"), 3).otherwise(0)
        + F.when(name.rlike("(?i)(?:route|controller|handler|endpoint)"), 2).otherwise(0)
        + F.when(name.rlike("(?i)(?:schema|model|migration|prisma)"), 2).otherwise(0)
        + F.when((F.col("exported") >= 5) & (F.col("out_edges") <= 2), 3).otherwise(0)
        + F.when(F.col("most_callers") >= 3, 1).otherwise(0)
        + F.when(F.col("most_callers") >= 10, 1).otherwise(0)
    )
    return files.select("id", weight.cast("double").alias("weight")).filter("weight > 0")


def importance(files: DataFrame) -> DataFrame:
    """files with importance: rank, churn, ownership, fan-out, complexity and tests, each capped and weighted. Missing signals count as zero."""
    w = rules.IMPORTANCE
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    score = F.least(zero("rank") * w["rank"][0], F.lit(w["rank"][1])) * w["rank"][2]
    for signal in ("commits", "minor_authors", "fan_out", "complexity"):
        score = score + F.least(zero(signal) / w[signal][0], F.lit(1.0)) * w[signal][1]
    return files.withColumn("importance", score + F.coalesce(F.col("has_tests").cast("double"), F.lit(0.0)) * w["tests"])


def tiers(scored: DataFrame, score: str, order: list[str]) -> DataFrame:
    """scored with tier: critical from the score at place floor(0.2 n) of the descending order up, peripheral below that at floor(0.8 n), standard between.

    The two cut-offs are read by their places after a range-partitioned sort; no task holds all rows."""
    n = scored.count()
    cuts = {}
    if n:
        placed = _placed(scored.select(score, *[c for c in order if c != score]), [F.col(score).desc(), *[F.col(c) for c in order]])
        wanted = {"critical": int(0.2 * n), "peripheral": min(n - 1, int(0.8 * n))}
        found = {r["place"]: r[score] for r in placed.filter(F.col("place").isin(list(wanted.values()))).select("place", score).collect()}
        cuts = {k: found[v] for k, v in wanted.items()}
    value = F.col(score)
    return scored.withColumn("tier", F.when(value >= cuts.get("critical", 0.0), "critical").when(value < cuts.get("peripheral", 0.0), "peripheral").otherwise("standard"))


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """rows with place, from 0 in a global order, without a window over the whole table: a range-partitioned sort, and each partition's rows counted before."""
    ordered = materialize(rows.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number for each partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] if before else F.lit(0)
    return ordered.withColumn("place", (start + F.col("at")).cast("long")).drop("part", "at")


def most_annotated(n: int) -> int:
    """How many of n files to annotate: 15 %, within 60 and 200."""
    return min(max(60, -(-n * 15 // 100)), 200)
