"""The tree source, the bundle of tables and the queue of batches."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import bundle, tree
from lodestone.sources.tree_source import TreeReader, read_tree
from lodestone.streaming.work_queue import WorkQueue, numbered_batches, split_cached

TREE = {
    "src/a.ts": "export const a = 1", "src/deep/er/b.py": "x = 1", "src/c.md": "no", "README": "no", "node_modules/p/i.js": "no", "src/.hidden/h.ts": "no", "dist/d.ts": "no", "gen/g.ts": "no", "gen2/g.ts": "yes",
    "src/big.ts": "x" * 600_000, "src/é.ts": "é", "vendor/v.go": "no", "lib/x.spec.ts": "no",
}


@pytest.fixture
def root(tmp_path):
    for path, text in TREE.items():
        (tmp_path / "t" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / path).write_text(text)
    return str(tmp_path / "t")


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_scan_is_whole_and_pruned(spark, root, tasks):
    got = {r.path: r for r in read_tree(spark, root, ["gen/", "*.spec.ts"], tasks=tasks).collect()}
    assert set(got) == {"src/a.ts", "src/deep/er/b.py", "gen2/g.ts", "src/é.ts"}
    assert got["src/a.ts"].content == TREE["src/a.ts"] and got["src/a.ts"].ext == ".ts" and got["src/a.ts"].size_bytes == 18 and got["src/é.ts"].content == "é"


def opened(reader, monkeypatch):
    """Directories listed and files opened by all tasks of a reader."""
    import lodestone.sources.tree_source as source

    seen, plain = [], source._store

    class Spy:
        def __init__(self, store):
            self.store = store

        def get_file_info(self, selector):
            seen.append(selector.base_dir)
            return self.store.get_file_info(selector)

        def open_input_stream(self, path):
            seen.append(path)
            return self.store.open_input_stream(path)

    monkeypatch.setattr(source, "_store", lambda r: (Spy(plain(r)[0]), plain(r)[1]))
    rows = [row for share in reader.partitions() for row in reader.read(share)]
    return rows, {os.path.relpath(s, reader.root) for s in seen}


def test_skipped_files_are_never_opened(root, monkeypatch):
    rows, seen = opened(TreeReader({"path": root, "ignore": '["gen/"]', "tasks": "2"}), monkeypatch)
    assert {r[0] for r in rows} == {"src/a.ts", "src/deep/er/b.py", "gen2/g.ts", "src/é.ts", "lib/x.spec.ts"}
    assert seen == {".", "src", "src/deep", "src/deep/er", "gen2", "lib", *(r[0] for r in rows)}


def test_filters_reach_the_listing(spark, root, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = TreeReader({"path": root})
    left = list(reader.pushFilters([EqualTo(("ext",), ".py"), StringStartsWith(("path",), "src/deep"), GreaterThan(("size_bytes",), 1)]))
    assert left == [GreaterThan(("size_bytes",), 1)]
    rows, seen = opened(reader, monkeypatch)
    assert [r[0] for r in rows] == ["src/deep/er/b.py"] and seen == {".", "src", "src/deep", "src/deep/er", "src/deep/er/b.py"}
    frame = read_tree(spark, root).filter((F.col("ext") == ".py") & F.col("path").startswith("src/") & (F.col("size_bytes") > 1))
    assert [r.path for r in frame.collect()] == ["src/deep/er/b.py"]


def test_unreadable_files_are_rows_and_the_rest_is_whole(spark, root):
    os.symlink("nowhere.ts", f"{root}/src/gone.ts")  # no file at all
    os.symlink("/proc/self/mem", f"{root}/src/mem.ts")
    files, broken = tree.split_unreadable(read_tree(spark, root))
    assert files.count() == 6 and "error" not in files.columns
    assert {r.path for r in broken.collect()} == {"src/mem.ts"} and broken.filter("error = ''").count() == 0
    assert tree.scan_files(spark, root).count() == 6


def test_files_come_back_as_written(spark, tmp_path):
    rows = [(f"d{k % 3}/f{k}.ts", f"text {k} é\n") for k in range(40)] + [("top.py", None)]
    assert tree.write_files(spark.createDataFrame(rows, "path string, content string").repartition(3), str(tmp_path / "w")) == 41
    got = {r.path: r.content for r in tree.scan_files(spark, str(tmp_path / "w")).collect()}
    assert got == {p: c or "" for p, c in rows}
    with pytest.raises(Exception, match="leaves the folder"):
        tree.write_files(spark.createDataFrame([("../x.ts", "")], "path string, content string"), str(tmp_path / "w"))


def test_bundle_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "b")
    make = lambda k: {n: spark.range(k).select((F.col("id") * k).alias(n)) for n in ("one", "two")}
    assert bundle.open_bundle(spark, root) == {} and bundle.publish(spark, make(3), root) == 1
    held = bundle.open_bundle(spark, root)
    broken = make(5) | {"two": spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("two"))}
    with pytest.raises(Exception, match="broken"):
        bundle.publish(spark, broken, root)
    assert {n: d.count() for n, d in bundle.open_bundle(spark, root).items()} == {"one": 3, "two": 3}
    assert bundle.publish(spark, make(5), root) == 2 and bundle.publish(spark, make(0), root) == 3
    assert {n: d.count() for n, d in bundle.open_bundle(spark, root).items()} == {"one": 0, "two": 0} and bundle.open_bundle(spark, root)["two"].columns == ["two"]
    assert {n: d.count() for n, d in bundle.open_bundle(spark, root, 2).items()} == {"one": 5, "two": 5}
    assert held["two"].count() == 3
    bundle.retire(spark, root)
    assert bundle.versions(spark, root) == [2, 3] and sum(n.startswith("tables-") for n in os.listdir(root)) == 2
    with pytest.raises(FileExistsError):
        bundle.Folder(spark, root).write("manifest-0000000003.json", "{}")


def items(spark, n=60):
    return spark.createDataFrame([(f"k{k:03}", f"text {k}", 1 + k % 7) for k in range(n)], "key string, text string, size long")


def test_batches_follow_the_order_within_their_size(spark):
    rows = numbered_batches(items(spark), "key", "size", 20).orderBy("key").collect()
    assert [r.batch for r in rows] == sorted(r.batch for r in rows) and len(rows) == 60
    sizes = {}
    for r in rows:
        sizes[r.batch] = sizes.get(r.batch, 0) + r["size"]
    assert max(sizes.values()) <= 20 + 7 and sorted(sizes) == list(range(len(sizes)))


def test_killed_and_restarted_queue_gives_the_same(spark, tmp_path):
    asked = []

    def annotate(rows, fail=()):
        numbers = sorted(r.batch for r in rows.select("batch").distinct().collect())
        asked.append(numbers)
        bad = F.when(F.col("batch").isin(list(fail)) & (F.col("key") > ""), F.raise_error(F.lit("killed")).cast("string")) if fail else F.lit(None).cast("string")
        return rows.select("key", "batch", F.coalesce(bad, F.upper("text")).alias("note"), F.lit(1.0).alias("cost"))

    whole = WorkQueue(spark, str(tmp_path / "whole"))
    whole.fill(items(spark), most=20)
    assert whole.run(annotate, batches_a_round=3) == "done"
    plain, asked_plain = sorted(map(tuple, whole.results().collect())), list(asked)
    asked.clear()
    torn = WorkQueue(spark, str(tmp_path / "torn"))
    torn.fill(items(spark), most=20)
    with pytest.raises(Exception, match="killed"):
        torn.run(lambda rows: annotate(rows, fail=[4]), batches_a_round=3)
    again = WorkQueue(spark, str(tmp_path / "torn"))
    again.fill(items(spark).filter("false"), most=5)  # a filled queue keeps its batches
    assert again.run(annotate, batches_a_round=3) == "done"
    assert sorted(map(tuple, again.results().collect())) == plain and len(plain) == 60
    assert asked[0] == asked_plain[0] and asked[1] == asked[2] == asked_plain[1] and asked[3:] == asked_plain[2:]
    assert again.claims().count() == len(asked)
    assert again.run(annotate) == "done" and again.claims().count() == len(asked)


def test_queue_stops_at_its_budget(spark, tmp_path):
    queue = WorkQueue(spark, str(tmp_path / "q"))
    queue.fill(items(spark), most=20)
    note = lambda rows: rows.select("key", F.col("size").cast("double").alias("cost"))
    assert queue.run(note, budget=50.0, batches_a_round=1) == "budget"
    spent = queue.results().agg(F.sum("cost")).first()[0]
    assert 50 <= spent < 90 and queue.run(note, budget=50.0) == "budget" and queue.results().agg(F.sum("cost")).first()[0] == spent
    assert queue.run(note, batches_a_round=50) == "done" and queue.results().count() == 60


def test_cache_split(spark):
    hits, misses = split_cached(items(spark, 5), spark.createDataFrame([("k001", "n"), ("zz", "n")], "key string, note string"))
    assert [r.key for r in hits.collect()] == ["k001"] and misses.count() == 4
