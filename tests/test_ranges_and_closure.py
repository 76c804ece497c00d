"""Forward fill over ranges, closures with bitmaps, packing of ranked lists: each against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.sources import tree


@pytest.fixture
def ranges(spark):
    """Small ranges stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def test_fill_over_many_ranges_of_one_key(ranges):
    spark = ranges
    rng, rows = random.Random(5), []
    for key in ("a", "b", None):
        rows += [(key, k, rng.choice([None, None, None, f"v{k}"])) for k in range(400 if key == "a" else 30)]
    frame = spark.createDataFrame(rows, "key string, k long, v string").repartition(5)
    got = {(r.key, r.k): r.filled for r in tree.fill_forward(frame, "key", "k", F.col("v"), "filled").collect()}
    want, last = {}, {}
    for key, k, v in rows:
        last[key] = v if v is not None else last.get(key)
        want[key, k] = last[key]
    assert got == want


def test_one_log_is_filled_in_many_tasks(ranges):
    spark = ranges
    rows = [("r", k, f"COMMIT:c{k}" if k % 50 == 0 else f"f{k}") for k in range(2000)]
    frame = spark.createDataFrame(rows, "log string, line long, text string")
    got = {r.file: r.author for r in tree.git_log(frame).collect()}
    assert got == {f"f{k}": f"c{k - k % 50}" for k in range(2000) if k % 50}
    placed = frame.repartitionByRange("log", "line").select(F.spark_partition_id().alias("p")).distinct().count()
    assert placed > 1


def closure(edges, start):
    found, front, depth = {}, set(start), 0
    while front:
        depth += 1
        front = {a for a, b in edges if b in front} - set(found)
        found |= dict.fromkeys(front, depth)
    return found


@pytest.mark.parametrize("wide", [0.0, 2.0])
def test_closure_in_both_directions(spark, wide):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(320)] + [("x", "x")]
    frame = spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, weight long")
    start = ["n2", "x", "nowhere"]
    got = {r.id: r.depth for r in G.transitive_dependents(frame, spark.createDataFrame([(s,) for s in start], "id string"), wide=wide).collect()}
    assert got == closure(edges, start) and got["x"] == 1


def test_deep_chain_writes_with_the_result(spark, tmp_path, monkeypatch):
    from lodestone.plans import state

    monkeypatch.setattr(state, "shared_dir", lambda spark: str(tmp_path))
    frame = spark.createDataFrame([(f"{k + 1:04}", f"{k:04}", 1) for k in range(6)], "src string, dst string, weight long")
    got = {r.id: r.depth for r in G.transitive_dependents(frame, spark.createDataFrame([("0000",)], "id string")).collect()}
    assert got == {f"{k:04}": k for k in range(1, 7)}
    rounds = spark.read.parquet(*[str(p) for p in tmp_path.glob("closure-*/depth=*")])
    assert rounds.count() == 6
    maps = [spark.read.parquet(str(p)) for p in tmp_path.glob("marked-*")]
    assert len(maps) == 6 and max(m.count() for m in maps) <= 5


def plain_packing(items, budget):
    used, out = 0, {}
    for rank, name, size in sorted(items):
        if used + size <= budget:
            out[name] = used
            used += size
    return out


@pytest.mark.parametrize("few,parts", [(2, 7), (10_000, 5)])
def test_ranked_packing_is_the_plain_loop(spark, few, parts):
    rng = random.Random(few + parts)
    items = [(rng.randrange(40), f"i{k:03}", rng.choice([3, 5, 8, 40, 90])) for k in range(60)]
    frame = spark.createDataFrame(items, "rank int, name string, size long")
    got = {r.name: r.used_before for r in R.pack_ranked(frame, [F.col("rank")], "name", "size", 100, parts, few).collect()}
    assert got == plain_packing(items, 100)
    assert R.pack_ranked(frame.filter("false"), [F.col("rank")], "name", "size", 100, parts, few).count() == 0
