"""Reports, renderings, the whole index and its nine questions."""

from pyspark.sql import functions as F

from lodestone.operators import reports as P
from lodestone.operators import retrieval as R
from lodestone.plans.build import Tools, build_index, register


def test_reports(spark):
    files = spark.createDataFrame([(".ts",)] * 3 + [(".py",)], "ext string")
    assert [(r.ext, r.n, r.tokens) for r in P.plan_report(files).collect()] == [(".ts", 3, 860), (".py", 1, 860)]
    outputs = spark.createDataFrame([("l1", "x" * 3700), ("l1", "")], "layer string, text string")
    assert tuple(P.token_statistics(outputs).first()) == ("l1", 2, 1000, "1.0K")
    facts = spark.createDataFrame([(True, 50_000, 3, 2, False)], "has_index boolean, skeleton_chars int, commits_behind int, modules int, has_hooks boolean")
    assert {r.status: r.n for r in P.status_counts(P.check_report(facts)).collect()} == {"pass": 3, "warn": 2}


def test_danger_notes(spark):
    notes = spark.createDataFrame([("src/payment/charge.ts", "chargeCard", "must never retry without idempotency key"), ("src/ui/a.ts", "draw", "slow")] + [(f"src/o{k}/x.ts", f"fn{k}", "harmless") for k in range(12)], "file string, symbol string, danger string")
    got = P.danger_hits(notes, R.terms_of(spark, "fix the payment retry idempotency", "bm25")).collect()
    assert [r.symbol for r in got] == ["chargeCard"]
    assert P.danger_rules(notes).first().n == 1
    assert "card" in {r.keyword for r in P.danger_keywords(notes).collect()}


def test_lines(spark):
    v = spark.createDataFrame([(f"V{k}", k % 2 == 0, True, "api") for k in range(24)], "name string, has_default boolean, required boolean, category string")
    assert P.required_variables(v).first().text == "V1, V11, V13 +9 more"
    p = spark.createDataFrame([("a", None, 5, False), ("@m/b", "1.0", 1, True)], "name string, version string, import_count long, is_private boolean")
    assert [r.text for r in P.package_lines(p).collect()] == ["  - @m/b@1.0 — 1 imports [private]", "  - a — 5 imports"]
    g = spark.createDataFrame([("/x", ["GET", "POST"], ["mw"], "required", "S")], "path string, methods array<string>, middleware array<string>, auth string, body_schema string")
    assert P.route_lines(g).first().text == "  GET,POST /x [required, body:S, mw]"
    c = spark.createDataFrame([("naming", "a")], "category string, text string")
    assert P.convention_lines(c).first().text == "a"
    s = spark.createDataFrame([(7, 10, True)], "changed long, files long, stale boolean")
    assert P.staleness_line(s, F.lit("2h")).first().text.startswith("index is stale: 7 files")
    o = spark.createDataFrame([(f"src/a/f{f}.ts", k, f"s{k}") for f in range(8) for k in range(6)], "path string, line int, name string")
    assert P.overview_groups(o).count() == 24
    ranked = spark.createDataFrame([("m1", 1), ("m2", 2)], "module string, k int")
    contracts = spark.createDataFrame([("m1", ["m2", "m3"], ["m4"]), ("m2", ["m3"], None)], "module string, dependencies array<string>, dependents array<string>")
    assert {(r.module, r.relation, r.k) for r in P.related_modules(ranked, contracts).collect()} == {("m3", "dependency", 1), ("m4", "dependent", 1)}


SOURCES = [
    ("src/db.ts", ".ts", 'export function query(sql: string): string {\n  return process.env.DATABASE_URL;\n}\n'),
    ("src/users.ts", ".ts", 'import { query } from "./db";\nexport function findUser(id: string): string {\n  return query(id);\n}\n'),
    ("src/api/users.ts", ".ts", 'import { findUser } from "../users";\napp.get("/users", requireAuth, (q) => findUser(q));\n'),
    ("src/users.test.ts", ".ts", "it('finds a user', () => {\n  expect(findUser('1')).toBe('x');\n});\n"),
    ("db/a.prisma", ".prisma", "model User {\n  id Int @id\n}\n"),
    (".env.local", ".local", "SECRET=1"),
]


def test_index_and_tools(spark, tmp_path):
    index = build_index(spark.createDataFrame(SOURCES, "path string, ext string, content string"))
    assert index["files"].count() == 5
    tools = Tools(index)
    assert [r.path for r in tools.find_usages("query").collect()] == ["src/users.ts"]
    assert {r.id for r in tools.blast_radius("src/db.ts")["affected"].collect()} == {"src/users.ts", "src/api/users.ts"}
    assert tools.blast_radius("src/db.ts")["routes"].count() == 1
    assert tools.routes("get").first().auth == "required" and tools.schema("USER").count() == 1
    assert tools.test_map("src/users.ts").first().test == "src/users.test.ts"
    assert tools.env_audit().first().files == 1
    assert tools.symbol("finduser").first().importers == 1
    assert tools.issue_candidates("findUser is broken").first().path == "src/users.ts"
    assert tools.context("users in the api").count() >= 1
    register(index, "ix_")
    assert spark.sql("SELECT count(*) AS n FROM ix_symbols WHERE exported").first().n == 2
    P.write_artifacts({"edges": index["edges"]}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 2
    got = P.auth_context(index["routes"], index["symbols"], index["models"])
    assert got["routes"].count() == 1 and got["models"].first().name == "User"


def test_route_graph_and_prompts(spark):
    from lodestone.operators import extract as X
    from lodestone.operators import graph as G
    from lodestone.operators import matching as M
    from lodestone.operators import routes as RT
    from lodestone.sources import tree

    text = 'import { save } from "./db";\nexport function createUser(q: Req): string {\n  return save(q);\n}\n'
    rows = [("a.ts", ".ts", text), ("r.ts", ".ts", 'import { createUser } from "./a";\nrouter.post("/users", validateBody(UserSchema), createUser);\nrouter.get("/ping", h); router.get("/ping", h);\n'), ("db.ts", ".ts", "export function save(q: Req): string {\n}\n")]
    files = spark.createDataFrame(rows, "path string, ext string, content string")
    symbols, used = X.symbols(files), X.imports(files)
    found = RT.routes(files)
    calls = spark.createDataFrame([("r.ts", "createUser")], "caller string, callee string")
    models = spark.createDataFrame([("User", ["id", "name"])], "name string, fields array<string>")
    tests = spark.createDataFrame([("r.ts", [f"t{k}" for k in range(7)])], "source_file string, test_names array<string>")
    got = {(r.method, r.path): r for r in RT.route_graph(found, symbols, calls, models, tests).collect()}
    assert len(got) == 2 and got["POST", "/users"].fields == ["id", "name"] and got["POST", "/users"].calls == ["createUser"] and len(got["GET", "/ping"].tests) == 5
    resolved = X.resolve_imports(files, used)
    edges, nodes = X.import_edges(resolved), files.select(F.col("path").alias("id"))
    chains = G.call_chain(edges, G.page_rank(nodes, edges, rounds=2), nodes)
    contexts = M.caller_context(files, X.symbol_refs(resolved))
    tiers = nodes.select(F.col("id").alias("path"), F.lit("standard").alias("tier"))
    asked = {r.path: r.text for r in P.prompt_rows(symbols, M.code_windows(symbols), X.lines(files), chains, contexts, X.test_assertions(files), tiers).collect()}
    assert "Describe:\nsave" in asked["db.ts"] and "a.ts:3: return save(q);" in asked["db.ts"] and "r.ts → a.ts → db.ts" in asked["db.ts"]
    assert files.agg(tree.mentions(files, "USERSCHEMA").alias("m")).first().m and not files.agg(tree.mentions(files, "nothing").alias("m")).first().m
    assert {r.path: r.group for r in RT.filter_routes(found, "GET").collect()} == {"/ping": "ping"}
