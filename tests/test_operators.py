"""Graphs, retrieval, matching, evaluation, sources and streaming on small cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.operators import evaluation as E
from lodestone.operators import graph as G
from lodestone.operators import matching as M
from lodestone.operators import retrieval as R
from lodestone.sources import tree
from lodestone.streaming import incremental


def graph(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame([(a, b, w) for a, b, w in edges], "src string, dst string, weight long")


def slow_rank(nodes, edges, seeds=None, rounds=20, d=0.85):
    total, share = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total[a] += w
        share[a, b] += w
    mass = sum((seeds or {}).values())
    tp = {n: (seeds.get(n, 0) / mass if mass else 1 / len(nodes)) for n in nodes} if seeds else {n: 1 / len(nodes) for n in nodes}
    r = dict(tp)
    for _ in range(rounds):
        lost = sum(r[n] for n in nodes if not total[n])
        r = {n: (1 - d) * tp[n] + d * lost * tp[n] + d * sum(r[a] * w / total[a] for (a, b), w in share.items() if b == n) for n in nodes}
    return r


@pytest.mark.parametrize("seeds", [None, {"a": 1.0, "d": 3.0}])
def test_page_rank(spark, seeds):
    rng = random.Random(1)
    nodes = list("abcdefgh")
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.randint(1, 4)) for _ in range(14)]
    n, e = graph(spark, nodes, edges)
    s = spark.createDataFrame(list(seeds.items()), "id string, weight double") if seeds else None
    got = {r.id: r["rank"] for r in G.page_rank(n, e, s).collect()}
    want = slow_rank(nodes, edges, seeds)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and abs(sum(got.values()) - 1) < 1e-9


def test_page_rank_of_nothing_and_lone_nodes(spark):
    n, e = graph(spark, [], [])
    assert G.page_rank(n, e).count() == 0
    n, e = graph(spark, ["a", "b"], [])
    assert {r["rank"] for r in G.page_rank(n, e).collect()} == {0.5}


def test_closure_and_cycles(spark):
    _, e = graph(spark, [], [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("x", "c", 1)])
    got = {r.id: r.depth for r in G.transitive_dependents(e, spark.createDataFrame([("c",)], "id string")).collect()}
    assert got == {"b": 1, "x": 1, "a": 2, "c": 3}
    near = {(r.id, r.dependent): r.depth for r in G.dependents_within_two(e).collect()}
    assert near["c", "b"] == 1 and near["c", "a"] == 2 and ("c", "c") not in near and near["a", "x"] == 2
    assert G.transitive_dependents(e, spark.createDataFrame([("x",)], "id string")).count() == 0


def test_call_chain_and_trace(spark):
    _, e = graph(spark, [], [("b", "a", 1), ("c", "a", 1), ("d", "c", 1), ("a", "d", 1)])
    ranks = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.1)], "id string, rank double")
    start = spark.createDataFrame([("a",)], "id string")
    assert G.call_chain(e, ranks, start).first().chain == ["a", "c", "d"]
    assert G.call_chain(e, ranks, start, spark.createDataFrame([("c",)], "id string")).first().chain == ["a", "c"]
    calls = spark.createDataFrame([("f", "g", 0), ("f", "h", 1), ("g", "h", 0), ("g", "k", 1)], "caller string, callee string, pos int")
    got = {r.callee: r.depth for r in G.call_trace(calls, spark.createDataFrame([("f",)], "id string")).collect()}
    assert got == {"g": 1, "h": 1, "k": 2} or got == {"g": 1, "h": 2, "k": 2}


def test_importance_and_tiers(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(10)], "id int, s double")
    got = {r.id: r.tier for r in G.tiers(rows, "s", ["id"]).collect()}
    assert [got[k] for k in range(10)] == ["peripheral", "standard", "standard", "standard", "standard", "standard", "standard", "critical", "critical", "critical"]
    same = spark.createDataFrame([(k, 1.0) for k in range(5)], "id int, s double")
    assert {r.tier for r in G.tiers(same, "s", ["id"]).collect()} == {"critical"}
    one = spark.createDataFrame([(None, 60, None, 3, 5.0, True)], "rank double, commits int, minor_authors int, fan_out int, complexity double, has_tests boolean")
    assert abs(G.importance(one).first().importance - (1.0 + 0.2 + 0.4 + 0.5)) < 1e-9
    assert (G.most_annotated(10), G.most_annotated(1000), G.most_annotated(10_000)) == (60, 150, 200)


def test_packing_rules(spark):
    rows = spark.createDataFrame([("g", k, f"i{k}", s) for k, s in enumerate([5, 9, 3, 4, 2])], "g string, k int, name string, size int")
    assert [r["name"] for r in R.pack_prefix(rows, ["g"], [F.col("k")], "size", 10).orderBy("k").collect()] == ["i0", "i1"]
    got = R.pack_skipping(rows, ["g"], "k", "name", "size", 10).first()
    assert got.picked == ["i0", "i2", "i4"] and got.used == 10


def test_bm25_and_hits(spark):
    words = spark.createDataFrame([("m1", "modal"), ("m1", "modaldialog"), ("m2", "dialog"), ("m3", "other")], "dir string, keyword string")
    got = {r.dir: r.score for r in R.bm25(words, R.terms_of(spark, "modal", "bm25")).collect()}
    assert set(got) == {"m1"} and got["m1"] > 0
    twice = {r.dir: r.score for r in R.bm25(words, R.terms_of(spark, "modal modal", "bm25")).collect()}
    assert abs(twice["m1"] - 2 * got["m1"]) < 1e-9
    assert {r.dir: r.hits for r in R.context_hits(words, R.terms_of(spark, "dia modal", "context")).collect()} == {"m1": 2, "m2": 1}


def test_module_keywords(spark):
    files = spark.createDataFrame([("src/userStore/api.ts",), ("src/userStore/api.test.ts",)], "path string")
    symbols = spark.createDataFrame([("src/userStore/api.ts", "loadUser", "Fetches accounts with the given index", True), ("src/userStore/api.ts", "hid", None, True)], "path string, name string, description string, exported boolean")
    got = {r.keyword for r in R.module_keywords(files, symbols).collect()}
    assert got == {"userstore", "user", "store", "api", "loaduser", "fetches", "accounts"}


def test_test_candidates(spark):
    sources = spark.createDataFrame([("src/a.ts",), ("lib/util.py",), ("pkg/x.go",)], "path string")
    tests = spark.createDataFrame([("src/a.test.ts",), ("tests/test_util.py",), ("pkg/x_test.go",), ("other/ab.spec.ts",)], "path string")
    got = {(r.source, r.test): r.score for r in M.test_candidates(sources, tests).collect()}
    assert got["src/a.ts", "src/a.test.ts"] == 24 and got["lib/util.py", "tests/test_util.py"] == 8 and got["pkg/x.go", "pkg/x_test.go"] == 10 and got["src/a.ts", "other/ab.spec.ts"] == 2
    mapping = M.test_mapping(sources.unionByName(tests), spark.createDataFrame([("src/a.test.ts", "t1", 0)], "path string, name string, pos int"))
    best = {r.source: r for r in mapping.collect()}
    assert best["src/a.ts"].confidence == 1.0 and best["src/a.ts"].test_names == ["t1"] and abs(best["lib/util.py"].confidence - 0.8) < 1e-9
    assert M.look_up_tests(mapping, "src/a").first().source == "src/a.ts" and M.look_up_tests(mapping, "util").first().source == "lib/util.py"


def test_usages_and_lookups(spark):
    files = spark.createDataFrame([("a.ts", ".ts", "export function go() {}\n"), ("b.ts", ".ts", 'import { go } from "./a";\ngo();\ngoing();\nx(go)\n'), ("c.ts", ".ts", "go();\n")], "path string, ext string, content string")
    symbols = spark.createDataFrame([("a.ts", 1, "go", "go()")], "path string, line int, name string, signature string")
    refs = spark.createDataFrame([("a.ts", "go", "b.ts")], "def_path string, name string, importer string")
    assert [(r.path, r.line) for r in M.usages(files, symbols, refs, "go").orderBy("line").collect()] == [("b.ts", 2), ("b.ts", 4)]
    ranks = spark.createDataFrame([("a.ts", 0.5)], "id string, rank double")
    assert M.look_up_symbol(symbols, refs, ranks, "G").first().importers == 1 and M.suggestions(symbols, "gox").count() == 0
    assert M.caller_context(files, refs).first().line == 2
    used = M.env_consumers(files, spark.createDataFrame([("go",), ("NONE",)], "name string"))
    assert {r["name"]: r["files"] for r in used.collect()} == {"go": 3, "NONE": 0}


def test_blast_radius_projects_routes(spark):
    _, e = graph(spark, [], [("route.ts", "svc.ts", 1), ("svc.ts", "db.ts", 1)])
    ranks = spark.createDataFrame([("route.ts", 0.1), ("svc.ts", 0.2)], "id string, rank double")
    routes = spark.createDataFrame([("GET", "/x", "route.ts"), ("GET", "/y", "else.ts")], "method string, path string, file string")
    models = spark.createDataFrame([("M", "db.ts")], "name string, source string")
    got = M.blast_radius(e, spark.createDataFrame([("db.ts",)], "id string"), ranks, routes, models)
    assert {(r.id, r.direct) for r in got["affected"].collect()} == {("svc.ts", True), ("route.ts", False)} and got["routes"].count() == 1 and got["models"].count() == 1


def test_transcripts(spark):
    lines = [
        '{"type":"assistant","message":{"usage":{"input_tokens":5,"output_tokens":2,"cache_read_input_tokens":10},"content":[{"type":"tool_use","name":"Read","input":{"file_path":"a"}},{"type":"tool_use","name":"mcp__db__q","input":{}}]}}',
        "not json",
        '{"type":"result","subtype":"success","result":"done","duration_ms":12.0,"num_turns":3,"total_cost_usd":0.5,"usage":{"input_tokens":1,"output_tokens":1},"is_error":false}',
    ]
    path = spark.createDataFrame([(x,) for x in lines], "value string")
    events = path.select(F.from_json("value", E.EVENT, {"mode": "PERMISSIVE"}).alias("e"), F.monotonically_increasing_id().alias("line")).select(F.lit("t").alias("task"), "line", "e.*")
    got = E.transcript_metrics(events).first()
    assert (got.input_tokens, got.output_tokens, got.tool_calls, got.file_reads, got.mcp_calls, got.mcp_by_server, got.cost, got.success) == (15, 2, 2, 1, 1, {"db": 1}, 0.5, True)


def test_judges_and_annotations(spark):
    raw = ['```json\n{"a": 5, "b": 1, "notes": "x"}\n```', '{"a": 0, "b": 1}', '{"a": 2.5, "b": 1}', '{"a": 2}', "no json"]
    got = [r.score for r in E.judge_scores(spark.createDataFrame([(x,) for x in raw], "raw string").coalesce(1), ["a", "b"]).collect()]
    assert (got[0].a, got[0].b) == (5, 1) and got[1:] == [None] * 4
    replies = spark.createDataFrame([('Here: {"f.ts::go": "does it", "f.ts::no": {"description": "d", "danger": "z"}, "bad": "x"} ok',)], "raw string")
    assert {(r.path, r["name"], r.description, r.danger) for r in E.annotations_of(replies).collect()} == {("f.ts", "go", "does it", None), ("f.ts", "no", "d", "z")}


def test_diffs_costs_and_grids(spark):
    text = ["junk", "diff --git a/x.ts b/x.ts", "+1", "diff --git a/.gitignore b/.gitignore", "+2", "diff --git a/y b/y", "+3"]
    rows = spark.createDataFrame([("d", k, t) for k, t in enumerate(text)], "d string, line int, text string")
    assert {(r.path, r.block.count("\n")) for r in E.filter_diff(rows, "d").collect()} == {("x.ts", 1), ("y", 1)}
    cells = spark.createDataFrame([("g", 1, 5.0), ("g", 2, -1.0), ("g", 3, 6.0), ("g", 4, 1.0)], "g string, k int, cost double")
    assert [r.within_cap for r in E.within_cost(cells, ["g"], [F.col("k")], "cost", 10.0).orderBy("k").collect()] == [True, True, True, False]
    arms, tasks = spark.createDataFrame([("a",), ("b",)], "arm string"), spark.createDataFrame([(1,), (2,)], "task int")
    assert E.grid(arms, tasks, spark.createDataFrame([("a", 1)], "arm string, task int"), ["arm", "task"]).count() == 3
    assert E.rerun_cells("arm=x,task=y; arm=z,task=w") == [{"arm": "x", "task": "y"}, {"arm": "z", "task": "w"}]
    assert E.shuffled(tasks, 1).collect() == E.shuffled(tasks, 1).collect()


def test_scan_of_a_tree(spark, tmp_path):
    for p, t in {"src/a.ts": "x", "node_modules/b.ts": "x", ".hid/c.ts": "x", "src/d.txt": "x", "gen/e.py": "x", "big.go": "x" * 600_000, "k.key": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = tree.scan_files(spark, str(tmp_path), ["gen/"])
    assert [r.path for r in got.collect()] == ["src/a.ts"] and tree.roll_up(got).first().n == 1
    (tmp_path / "ig").write_text("# c\n\n*.log\n dist/ \n")
    assert sorted(tree.ignore_patterns(spark, str(tmp_path / "ig"))) == ["*.log", "dist/"]


def test_manifests_and_workspaces(spark):
    m = spark.createDataFrame([('{"dependencies":{"next":"^14.0","jest":"1"},"devDependencies":{"jest":"~2.1"},"scripts":{"serve":"s","test":"t"}}',)], "content string")
    assert {r["name"]: r.version for r in tree.manifest_versions(m).collect()} == {"next": "14.0", "jest": "2.1"}
    assert {r.slot: r.command for r in tree.scripts_of(m).collect()} == {"dev": "s", "test": "t"}
    stack = tree.stack_of(spark.createDataFrame([(".ts",), (".py",)], "ext string"), tree.manifest_versions(m))
    assert {(r.kind, r.value) for r in stack.collect()} == {("language", "typescript"), ("language", "python"), ("framework", "Next.js"), ("test", "jest")}
    paths = spark.createDataFrame([("packages/a/x.ts",), ("y.ts",)], "path string")
    assert {r.path: r.package for r in tree.workspace_of(paths, ["packages/*"]).collect()} == {"packages/a/x.ts": "packages/a", "y.ts": None}


def test_csv_tasks(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('instance_id,repo,base_commit,problem_statement,language\r\n1,r,c,"a ""q"", b\nnext",Python\r\n2,r,c,x,Go\r\n3,r\r\n')
    rows = tree.read_tasks(spark, str(p), ["python"]).collect()
    assert len(rows) == 1 and rows[0].problem_statement == 'a "q", b\nnext'
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tree.read_tasks(spark, str(p))


def test_git_sources(spark):
    log = spark.createDataFrame([("r", k, t) for k, t in enumerate(["COMMIT:ann", "a.ts", "", "COMMIT:bob", "a.ts", "b.ts"])], "log string, line int, text string")
    commits = tree.git_log(log)
    assert {(r.author, r.file) for r in commits.collect()} == {("ann", "a.ts"), ("bob", "a.ts"), ("bob", "b.ts")}
    many = spark.createDataFrame([("f", "x")] * 30 + [("f", "y")], "file string, author string")
    assert tuple(tree.git_signals(many).first()) == ("f", 31, 1)


def test_index_updates_by_content(spark, tmp_path):
    extract = lambda f: f.select("path", F.length("content").alias("n"))
    old = spark.createDataFrame([("a", "1"), ("b", "22"), ("c", "333")], "path string, content string")
    extract(old).join(tree.cache_diff(old, old.select("path", F.lit("").alias("hash"))).select("path", "hash"), "path").write.parquet(str(tmp_path / "v1"))
    new = spark.createDataFrame([("a", "1"), ("b", "2222"), ("d", "4")], "path string, content string")
    state = tree.update_index(spark, new, str(tmp_path / "v1"), str(tmp_path / "v2"), extract)
    assert state == {"hit": 1, "miss": 2, "prune": 1}
    assert {r.path: r.n for r in tree.load_index(spark, str(tmp_path / "v2")).collect()} == {"a": 1, "b": 4, "d": 1}


def test_stream_keeps_the_newest(spark, tmp_path):
    put = lambda rows, n: spark.createDataFrame(rows, "path string, content string, version long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    extract = lambda f: f.select("path", F.length("content").alias("n"))
    for rows in ([("a", "1", 1), ("b", "22", 1)], [("a", "4444", 2)]):
        put(rows, 0)
        incremental.follow(spark, str(tmp_path / "in"), "path string, content string, version long", str(tmp_path / "ix"), str(tmp_path / "ck"), extract).awaitTermination()
    got = incremental.latest(spark.read.parquet(str(tmp_path / "ix")))
    assert {r.path: r.n for r in got.collect()} == {"a": 4, "b": 2}


def test_block_splice():
    assert tree.splice_block(None, "b", "<", ">") == "<\nb\n>\n"
    assert tree.splice_block("x\n<\nold\n>\ny", "b", "<", ">") == "x\n<\nb\n>\ny" and tree.splice_block("x", "b", "<", ">") == "x\n\n<\nb\n>\n"


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_catalogue_queries_have_rows(spark):
    from lodestone.plans import catalogue

    for name in ("synth_import_edges", "synth_routes_grouped", "bm25_scores", "transcript_metrics", "diff_block_islands", "synth_skeleton"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1, name


def test_monorepos_and_installed_versions(spark):
    m = lambda *rows: tree.monorepo_of(spark.createDataFrame(list(rows), "path string, content string")).collect()
    assert [tuple(r) for r in m(("package.json", '{"workspaces":["a/*","b"]}'), ("turbo.json", "{}"))] == [("npm", ["a/*", "b"])]
    assert [tuple(r) for r in m(("package.json", "{}"), ("pnpm-workspace.yaml", "packages:\n  - 'apps/*'\n  - libs/x\n"))] == [("pnpm", ["apps/*", "libs/x"])]
    assert m(("go.work", "go 1.2\nuse (\n  ./a\n  b\n)\n"))[0].globs == ["a", "b"] and m(("Cargo.toml", '[workspace]\nmembers = ["x", "y/*"]'))[0].kind == "cargo"
    assert m(("package.json", "{}")) == []
    v = lambda *rows: spark.createDataFrame(list(rows), "name string, version string")
    assert {tuple(r) for r in tree.installed_versions(v(("a", "1"), ("b", "2")), v(("a", "1.5"))).collect()} == {("a", "1.5"), ("b", "2")}


def test_hits_test_lines_prompts_and_sums(spark):
    words = spark.createDataFrame([("m1", "modal"), ("m1", "menu"), ("m2", "menu")], "dir string, keyword string")
    assert {r.dir: r.hits for r in R.keyword_hits(words, "Open the MODAL").collect()} == {"m1": 1}
    mapping = spark.createDataFrame([("a.ts", "a.test.ts", ["t1", "t2"])], "source string, test string, test_names array<string>")
    said = spark.createDataFrame([("a.test.ts", "t1", k, f" expect({k})") for k in range(3)], "path string, test string, k int, text string")
    assert R.test_lines(mapping, said).first().text == "# Tests for a.ts: a.test.ts (2 tests)\n  - t1\n    expect(0)\n    expect(1)\n  - t2"
    tasks = spark.createDataFrame([("n", "q?", "a", ["x"], [])], "name string, question string, answer string, must_contain array<string>, must_not array<string>")
    assert "It should say:\n- x" in E.judge_prompts(tasks).first().prompt
    rows = spark.createDataFrame([('{"type":"assistant","message":{"usage":{"input_tokens":3,"output_tokens":1}}}',), ('{"type":"result","total_cost_usd":0.25}',)], "v string").select(F.lit("c").alias("cell"), F.from_json("v", E.EVENT).alias("e")).select("cell", "e.*")
    assert tuple(E.token_sums(rows, ["cell"]).first()) == ("c", 3, 1, 0.25, None)
