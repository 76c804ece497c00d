"""Queries over sources in many forms (scripts, routes of each framework, models of each kind, secrets, stacks), made from table rows with their SQL oracles.

One SQL expression makes the sources for Spark and tells the oracle what must be found, so every row of a table is a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import evaluation as E
from lodestone.operators import extract as X
from lodestone.operators import graph as G
from lodestone.operators import matching as M
from lodestone.operators import models as D
from lodestone.operators import reports as P
from lodestone.operators import retrieval as R
from lodestone.operators import routes as RT
from lodestone.operators.scripts import scan_scripts, scope_names
from lodestone.plans.catalogue import oracle_sql as _catalogue_sql
from lodestone.plans.contracts import file_tasks, sources, table
from lodestone.plans.state import materialize, new_folder
from lodestone.sources import tree
from lodestone.sources.tree_source import read_tree

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_TEST_MAPPING = _catalogue_sql()["synth_test_mapping"]


def query(sql: str):
    def register(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def made(spark: SparkSession, sf: str, name: str, key: str, folder: str, ext: str, template: str, where: str = "true", path: str | None = None) -> DataFrame:
    """A file for each row of a table: the template with any {column} filled in, and so the path, which is the key in the folder if none is given; {key} there is the key."""
    rows, columns = table(spark, sf, name).filter(where).repartition(file_tasks(spark), key), table(spark, sf, name).columns

    def filled(text: str) -> Column:
        out = F.lit(text.replace("{key}", "{" + key + "}"))
        for c in columns:
            if "{" + c + "}" in text.replace("{key}", "{" + key + "}"):
                out = F.replace(out, F.lit("{" + c + "}"), F.col(c).cast("string"))
        return out

    return rows.select(filled(path or f"{folder}/{{key}}{ext}").alias("path"), F.lit(ext).alias("ext"), filled(template).alias("content"))


# Scripts

_SCRIPT = """import { a{p_size}, b{p_partkey} } from "./lib";
import * as all from "../all";
// export function commented{p_partkey}() {}
const quoted = "export class Quoted{p_partkey} {}";
const shaped = `export function templated${ all.x }() {`;
export class P{p_partkey} extends Base<N{p_size}> implements Kept {
  async load{p_partkey}(
    id: string,
    n = (1 + {p_size}),
  ): Promise<
    void> {
    if (/[}"]/.test(id)) throw new Missing{p_size}(id);
    a{p_size}(id);
  }
  private hidden() { b{p_partkey}(); }
}
/** Either form of part {p_partkey}. */
export type T{p_partkey} =
  | "x"
  | { n: {p_size} };
export enum E{p_partkey} { One, Two = {p_size}, Three }
export function outer{p_partkey}(f: (x: string) => void): { ok: boolean } {
  function inner{p_partkey}() { return b{p_partkey}("a{p_size}"); }
  return a{p_size}(all);
}
"""
_COMMON = "const { a{p_size} } = require('./lib');\nmodule.exports = { x{p_partkey}, y: {p_size}, z() {} };\n"


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each part; every fourth one exports by module.exports."""
    return made(spark, sf, "part", "p_partkey", "src/part", ".ts", _SCRIPT, "p_partkey % 4 != 0").unionByName(made(spark, sf, "part", "p_partkey", "src/part", ".js", _COMMON, "p_partkey % 4 = 0"))


@query(r"""SELECT concat('src/part/', p_partkey, '.ts') AS path, s.line, s.name, s.kind, s.signature, s.exported FROM part, LATERAL (VALUES
  (6, concat('P', p_partkey), 'class', concat('P', p_partkey, ' extends Base<N', p_size, '> implements Kept'), true),
  (7, concat('P', p_partkey, '.load', p_partkey), 'method', concat('load', p_partkey, '(id: string, n = (1 + ', p_size, ')): Promise<', chr(10), '    void>'), false),
  (18, concat('T', p_partkey), 'type', concat('T', p_partkey, ' = | "x"', chr(10), '  | { n: ', p_size, ' }'), true),
  (21, concat('E', p_partkey), 'enum', concat('E', p_partkey, ' = One | Two | Three'), true),
  (22, concat('outer', p_partkey), 'function', concat('outer', p_partkey, '(f: (x: string) => void): { ok: boolean }'), true)) AS s(line, name, kind, signature, exported) WHERE p_partkey % 4 <> 0
UNION ALL SELECT concat('src/part/', p_partkey, '.js'), 2, n, 'variable', n, true FROM part, LATERAL (VALUES (concat('x', p_partkey)), ('y'), ('z')) AS s(n) WHERE p_partkey % 4 = 0""")
def script_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations over several lines, none from comments, strings and templates, and the keys of module.exports."""
    return X.symbols(scripts(spark, sf)).select("path", F.col("line").cast("int").alias("line"), "name", "kind", "signature", "exported")


@query(r"""SELECT concat('src/part/', p_partkey, '.ts') AS path, s.name, s.calls, s.throws FROM part, LATERAL (VALUES
  (concat('P', p_partkey, '.load', p_partkey), concat('a', p_size), concat('Missing', p_size)), (concat('outer', p_partkey), concat('a', p_size, ',all'), ''), (concat('inner', p_partkey), concat('b', p_partkey), '')) AS s(name, calls, throws) WHERE p_partkey % 4 <> 0""")
def script_scope_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by the innermost function around them: the nested function has its own."""
    files = scripts(spark, sf)
    local = X.imports(files).filter("is_relative").select("path", F.explode("names").alias("word")).distinct()
    found = scope_names(scan_scripts(files), local)
    return found.select("path", "name", F.array_join("calls", ",").alias("calls"), F.array_join("throws", ",").alias("throws"))


_CLAUSES = """import def{s_suppkey}, { x, type Y as z{s_nationkey} } from "./a";
import * as ns{s_suppkey} from './b';
import other, * as all from "../c";
import type Shape{s_nationkey} from "./d";
import "./side";
const { q, r: s } = require("pkg{s_nationkey}");
"""


@query("""SELECT concat('src/imp/', s_suppkey, '.ts') AS path, v.source, v.names, v.is_type_only FROM supplier, LATERAL (VALUES
  ('./a', concat('def', s_suppkey, ',x,z', s_nationkey), false), ('./b', concat('ns', s_suppkey), false), ('../c', 'other,all', false), ('./d', concat('Shape', s_nationkey), true), (concat('pkg', s_nationkey), 'q,r: s', false)) AS v(source, names, is_type_only)""")
def import_clauses(spark: SparkSession, sf: str) -> DataFrame:
    files = made(spark, sf, "supplier", "s_suppkey", "src/imp", ".ts", _CLAUSES)
    return X.imports(files).select("path", "source", F.array_join("names", ",").alias("names"), "is_type_only")


# Routes: a file of each framework for each supplier, as (folder or path, extension, template, routes as SQL).

_K, _N = "{s_suppkey}", "{s_nationkey}"
_ROUTES = (
    ("src/app/shop{key}/(pay)/cart/route.ts", ".ts", "export async function GET() {}\nexport function POST() { await getServerSession() }", "('GET', concat('/shop', k, '/cart')), ('POST', concat('/shop', k, '/cart'))"),
    ("pages/api/users{key}/index.ts", ".ts", "export default function handler() {}", "('ALL', concat('/api/users', k))"),
    ("src/exp/{key}.ts", ".ts", f"app.get('/exp{_K}/n{_N}', requireAuth, h);\nrouter.post(\"/exp{_K}\", h);\nserver.all('/exp{_K}/all', h);", "('GET', concat('/exp', k, '/n', n)), ('POST', concat('/exp', k)), ('ALL', concat('/exp', k, '/all'))"),
    ("src/fast/{key}.ts", ".ts", f"fastify.get('/exp{_K}/n{_N}', h);\nfastify.put('/fast{_K}', h);", "('PUT', concat('/fast', k))"),
    ("src/hono/{key}.ts", ".ts", f"import {{ Hono }} from 'hono';\nconst q = new Hono();\nq.delete('/hono{_K}', h);", "('DELETE', concat('/hono', k))"),
    ("app/routes/posts{key}.$id.tsx", ".tsx", "export async function loader() {}\nexport async function action() {}", "('GET', concat('/posts', k, '/:id')), ('POST', concat('/posts', k, '/:id'))"),
    ("src/routes/blog{key}/[slug]/+server.ts", ".ts", "export const GET = 1;\nexport async function PATCH() {}", "('GET', concat('/blog', k, '/:slug')), ('PATCH', concat('/blog', k, '/:slug'))"),
    ("py/fastapi/{key}.py", ".py", f"@router.get('/fa{_K}')\n@login_required\ndef f(): pass\n", "('GET', concat('/fa', k))"),
    ("py/flask/{key}.py", ".py", f"@app.route('/fl{_K}', methods=['GET', 'put'])\n@bp.route('/fl{_K}/n{_N}')\n", "('GET', concat('/fl', k)), ('PUT', concat('/fl', k)), ('GET', concat('/fl', k, '/n', n))"),
    ("py/django/{key}.py", ".py", f"urlpatterns = [path('dj{_K}/', view{_N})]\n", "('ALL', concat('/dj', k, '/'))"),
    ("go/gin/{key}.go", ".go", f'r.GET("/gin{_K}", h)\nr.OPTIONS("/gin{_K}", h)\n', "('GET', concat('/gin', k)), ('OPTIONS', concat('/gin', k))"),
    ("go/echo/{key}.go", ".go", f'import "github.com/labstack/echo"\ne.PUT("/echo{_K}", h)\n', "('PUT', concat('/echo', k))"),
    ("go/fiber/{key}.go", ".go", f'import "github.com/gofiber/fiber"\nf.Post("/fiber{_K}", h)\n', "('POST', concat('/fiber', k))"),
    ("go/chi/{key}.go", ".go", f'import "github.com/go-chi/chi"\nr.Get("/chi{_K}", h)\nr.Head("/chi{_K}", h)\n', "('GET', concat('/chi', k)), ('HEAD', concat('/chi', k))"),
    ("rs/actix/{key}.rs", ".rs", f'#[get("/ax{_K}")]\nasync fn a() {{}}\n', "('GET', concat('/ax', k))"),
    ("rs/axum/{key}.rs", ".rs", f'let app = Router::new().route("/axum{_K}", post(h));\n', "('POST', concat('/axum', k))"),
)


def _rails(spark: SparkSession, sf: str) -> DataFrame:
    """One routes file, as its name is fixed: a line and a resource for each nation."""
    line = F.concat(F.lit("get '/r"), "n_nationkey", F.lit("', to: 'x#y'\nresources :things"), "n_nationkey")
    return table(spark, sf, "nation").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content")).select(F.lit("config/routes.rb").alias("path"), F.lit(".rb").alias("ext"), "content")



def _routes_sql() -> str:
    parts = []
    for path, _, _, found in _ROUTES:
        place = path.replace("{key}", "', k, '")
        parts.append(f"SELECT v.m AS method, v.p AS path, concat('{place}') AS file FROM s, LATERAL (VALUES {found}) AS v(m, p)")
    parts.append("SELECT v.m, v.p, 'config/routes.rb' FROM nation, LATERAL (VALUES ('GET', concat('/r', n_nationkey)), ('GET', concat('/things', n_nationkey)), ('POST', concat('/things', n_nationkey)), ('PUT', concat('/things', n_nationkey)), ('DELETE', concat('/things', n_nationkey))) AS v(m, p)")
    return "WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) " + " UNION ALL ".join(parts)


@query(_routes_sql())
def framework_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Files of sixteen frameworks for each supplier, and a Rails file; Fastify's copy of an Express route doesn't count."""
    files = _rails(spark, sf)
    for path, ext, template, _ in _ROUTES:
        files = files.unionByName(made(spark, sf, "supplier", "s_suppkey", "", ext, template, path=path))
    return RT.routes(files).select("method", "path", "file")


# Models

_PRISMA = "model User{s_suppkey} {\n  id Int @id @default(autoincrement())\n  mail String? @unique\n  nation Nation{s_nationkey}\n  posts Post{s_suppkey}[]\n  // note\n  @@map(\"u\")\n}\n"
_DRIZZLE = "export const t{s_suppkey} = pgTable('table{s_suppkey}', {\n  id: serial('id'),\n  name{s_nationkey}: text('name')\n})\n"
_DJANGO = "class Post{s_suppkey}(models.Model):\n    title = models.CharField(max_length={s_nationkey}, unique=True)\n    author = models.ForeignKey('User{s_nationkey}')\n    tags = models.ManyToManyField(Tag)\n\nclass Other:\n    pass\n"
_TYPEORM = "@Entity()\nexport class Item{s_suppkey} {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column({ nullable: true })\n  note{s_nationkey}?: string;\n  @OneToMany('X')\n  xs: Box{s_nationkey};\n}\n"


@query("""SELECT v.* FROM supplier, LATERAL (VALUES
  (concat('User', s_suppkey), concat('prisma/', s_suppkey, '.prisma'), 'id Int false false true autoincrement(,mail String true true false', concat('nation Nation', s_nationkey, ' one-to-one,posts Post', s_suppkey, ' one-to-many')),
  (concat('table', s_suppkey), concat('drizzle/', s_suppkey, '.ts'), concat('id serial false false true,name', s_nationkey, ' text false false false'), ''),
  (concat('Post', s_suppkey), concat('dj/models/', s_suppkey, '.py'), 'title CharField false true false', concat('author User', s_nationkey, ' one-to-many,tags Tag many-to-many')),
  (concat('Item', s_suppkey), concat('typeorm/', s_suppkey, '.ts'), concat('id number false false true,note', s_nationkey, ' string true false false'), concat('xs Box', s_nationkey, ' one-to-many'))) AS v(name, source, fields, relations)""")
def model_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Prisma, Drizzle, Django and TypeORM models of each supplier, with all fields and relations."""
    files = made(spark, sf, "supplier", "s_suppkey", "prisma", ".prisma", _PRISMA)
    for folder, ext, template in (("drizzle", ".ts", _DRIZZLE), ("dj/models", ".py", _DJANGO), ("typeorm", ".ts", _TYPEORM)):
        files = files.unionByName(made(spark, sf, "supplier", "s_suppkey", folder, ext, template))
    field = lambda f: F.concat_ws(" ", f["name"], f["type"], f["optional"].cast("string"), f["unique"].cast("string"), f["is_pk"].cast("string"), f["default"])
    relation = lambda r: F.concat_ws(" ", r["field"], r["target"], r["type"])
    return D.models(files).select("name", "source", F.array_join(F.transform("fields", field), ",").alias("fields"), F.array_join(F.transform("relations", relation), ",").alias("relations"))


# Secrets: one line of each kind, filled with the key to the length that its pattern needs, among lines that don't count.

_SECRETS = """const api_key = 'abcdefgh{c_custkey}';
const password = "p{c_custkey}";
client_secret: 'longsecret{c_custkey}'
-----BEGIN RSA PRIVATE KEY-----
const u = 'postgres://me:pw{c_custkey}@host';
Authorization: bearer abcdefghijklmnopqrst{c_custkey}
aws_secret_access_key = ABCDEFGHIJKLMNOPQRST{c_custkey}
ghp_abcdefghijklmnopqrstuvwxyz0123{c_custkey}
sk-abcdefghijklmnopqrst{c_custkey}
// a comment about password handling
const api_key = process.env.API_KEY || 'abcdefgh{c_custkey}';
const api_key = 'short';
"""


@query("""SELECT concat('src/keys/', c_custkey, '.ts') AS path, v.line, v.type, v.detail FROM customer, LATERAL (VALUES (1, 'api_key', 'Possible API key found'), (2, 'password', 'Possible password found'), (3, 'secret', 'Possible secret found'),
  (4, 'private_key', 'Possible private key found'), (5, 'connection_string', 'Possible connection string with credentials found'), (6, 'token', 'Possible auth token found'), (7, 'secret', 'Possible AWS secret key found'),
  (8, 'token', 'Possible GitHub token found'), (9, 'api_key', 'Possible OpenAI/Stripe secret key found')) AS v(line, type, detail)""")
def secret_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """All nine kinds in a file of each customer; no line that only speaks of one or reads it from a variable."""
    return X.secret_warnings(made(spark, sf, "customer", "c_custkey", "src/keys", ".ts", _SECRETS)).select("path", "line", "type", "detail")


# The stack


@query("""SELECT kind, value FROM (VALUES ('language', 'typescript'), ('language', 'javascript'), ('language', 'python'), ('language', 'go'), ('framework', 'next.js'), ('framework', 'react'), ('framework', 'express'), ('framework', 'fastapi'), ('framework', 'gin'),
  ('package_manager', 'pnpm'), ('orm', 'sqlalchemy'), ('test', 'pytest'), ('entry', 'pages/index.tsx'), ('entry', 'main.go')) AS v(kind, value)
UNION ALL SELECT 'entry', concat('dist/', max(s_suppkey), '.js') FROM supplier""")
def stack_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The stack of one project: its manifests, with the sources that customers make around them, and an entry that the suppliers name."""
    main = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("k"))
    package = F.concat(F.lit('{"main": "dist/'), "k", F.lit('.js", "dependencies": {"next": "1", "react": "1", "express": "1", "drizzle-orm": "1", "knex": "1"}, "devDependencies": {"vitest": "1", "mocha": "1"}}'))
    texts = F.array(*[F.struct(F.lit(p).alias("path"), t.alias("content")) for p, t in (("package.json", package), ("pyproject.toml", F.lit("fastapi\nsqlalchemy\npytest\n")), ("go.mod", F.lit("require github.com/gin-gonic/gin")), ("pnpm-lock.yaml", F.lit("")), ("main.go", F.lit("package main")))])
    manifests = main.select(F.explode(texts).alias("x")).select("x.path", "x.content")
    sources = table(spark, sf, "customer").select(F.concat(F.lit("src/c"), "c_custkey", F.lit(".ts")).alias("path"), F.lit("export const x = 1").alias("content"))
    return tree.detect_stack(sources.unionByName(manifests)).select("kind", "value")


# Commands of projects: each customer is one, with some of the manifests

_PACKAGE = """CASE WHEN c_custkey % 2 = 0 THEN concat('{"scripts": {"serve": "s', c_custkey, '", "start": "run --watch", "test": "", "test:unit": "t', c_custkey, '", "prepare": "p", "docs', c_nationkey, '": "d", "a-name-of-twenty-letters": "x"}}')
  WHEN c_custkey % 3 = 0 THEN '{broken' END"""


@query("""WITH p AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 2 = 0 AS pkg, c_custkey % 5 <> 0 AS make, c_custkey % 7 = 0 AS go, c_custkey % 11 = 0 AS cargo, c_custkey % 4 = 0 AS py FROM customer), f AS (
  SELECT k, 'dev' AS slot, CASE WHEN pkg THEN concat('s', k) WHEN make THEN 'make dev' END AS command FROM p
  UNION ALL SELECT k, 'start', CASE WHEN pkg THEN 'run --watch' END FROM p
  UNION ALL SELECT k, 'test', CASE WHEN pkg THEN concat('t', k) WHEN make THEN 'make test' WHEN go THEN 'go test ./...' WHEN cargo THEN 'cargo test' WHEN py THEN 'pytest' END FROM p
  UNION ALL SELECT k, 'build', CASE WHEN go THEN 'go build ./...' WHEN cargo THEN 'cargo build' END FROM p)
SELECT k AS project, slot, slot AS name, command FROM f WHERE command IS NOT NULL
UNION ALL SELECT k, 'other', concat('docs', n), 'd' FROM p WHERE pkg UNION ALL SELECT k, 'other', 'test:unit', concat('t', k) FROM p WHERE pkg""")
def project_commands(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    texts = (("package.json", F.expr(_PACKAGE)), ("Makefile", F.when(F.col("c_custkey") % 5 != 0, F.lit("all: x\n\tmake y\ntest : unit\ndev:\nlint-all:\n"))), ("go.mod", F.when(F.col("c_custkey") % 7 == 0, F.lit("module m"))), ("Cargo.toml", F.when(F.col("c_custkey") % 11 == 0, F.lit(""))), ("pyproject.toml", F.when(F.col("c_custkey") % 4 == 0, F.lit(""))))
    files = c.select(F.col("c_custkey").alias("project"), F.explode(F.array(*[F.struct(F.lit(p).alias("path"), t.alias("content")) for p, t in texts])).alias("x")).select("project", "x.path", "x.content").filter("content IS NOT NULL")
    return tree.project_scripts(files)


# Reports of the quality matrix and of two arms: a cell for each order of a customer, the arm by its priority

_CELLS_SQL = """SELECT o_custkey AS task, concat('arm', o_orderkey % 3) AS arm, max(CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE (o_orderkey % 977) * 1000.0::DOUBLE END) AS duration_ms, max(CAST(floor(o_totalprice) AS BIGINT) * 100 + 3) AS input_tokens, max(o_orderkey % 1000 / 4.0::DOUBLE) AS cost,
  max(CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 5 + 1 AS INTEGER) END) AS overall, max(CAST(o_orderkey % 5 + 1 AS INTEGER)) AS coverage, max(CAST(o_orderkey % 5 + 1 AS INTEGER)) AS accuracy FROM orders GROUP BY 1, 2"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders_of_reports")
    return spark.sql(_CELLS_SQL.replace("::DOUBLE", "D").replace("FROM orders", "FROM orders_of_reports")).withColumn("error", F.concat(F.lit("failed "), F.col("task").cast("string")))


_SHORT = "CASE WHEN {n} >= 1000000 THEN printf('%.1fM', {n} / 1000000.0::DOUBLE) WHEN {n} >= 1000 THEN printf('%.1fK', {n} / 1000.0::DOUBLE) ELSE CAST(CAST({n} AS BIGINT) AS VARCHAR) END"
_PAD = "lpad({x}, greatest(length({x}), {w})::INTEGER, ' ')"


def _line_sql() -> str:
    pad = lambda x, w: _PAD.format(x=x, w=w)
    score = lambda c, w, none: pad(f"CASE WHEN overall IS NULL THEN '{none}' ELSE concat({c}, '/5') END", w)
    return f"concat('    ', arm, '  ', {pad("printf('%.1f', duration_ms / 1000)", 7)}, 's ', {pad(_SHORT.format(n='input_tokens'), 10)}, ' $', {pad("printf('%.4f', cost)", 6)}, ' ', {score('overall', 8, 'unscored')}, ' ', {score('coverage', 9, '-')}, ' ', {score('accuracy', 9, '-')})"


@query(f"SELECT task, arm, CASE WHEN duration_ms IS NULL THEN concat('    ', arm, '  failed ', task) ELSE {_line_sql()} END AS text FROM ({_CELLS_SQL})")
def quality_matrix_lines(spark: SparkSession, sf: str) -> DataFrame:
    return E.quality_lines(_cells(spark, sf))


@query(f"""SELECT arm, count(*) AS cells, round(avg(duration_ms) / 1000, 1) AS seconds, {_SHORT.format(n="floor(avg(input_tokens) + 0.5)")} AS tokens, round(avg(cost), 4) AS cost, round(avg(overall), 2) AS overall
FROM ({_CELLS_SQL}) WHERE duration_ms IS NOT NULL GROUP BY arm""")
def quality_matrix_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.quality_summary(_cells(spark, sf))


_BOTH_SQL = f"WITH c AS ({_CELLS_SQL}), b AS (SELECT * FROM c WHERE arm <> 'arm2' AND task IN (SELECT task FROM c WHERE arm <> 'arm2' GROUP BY task HAVING count(DISTINCT arm) = 2))"


@query(f"""{_BOTH_SQL} SELECT server, CAST(sum(CASE WHEN arm = 'arm0' THEN n ELSE 0 END) AS BIGINT) AS before, CAST(sum(CASE WHEN arm = 'arm1' THEN n ELSE 0 END) AS BIGINT) AS after FROM (
  SELECT arm, concat('server', task % 4) AS server, coverage AS n FROM b UNION ALL SELECT arm, 'shared', 1 FROM b WHERE arm = 'arm1') GROUP BY server""")
def calls_by_server(spark: SparkSession, sf: str) -> DataFrame:
    own = F.create_map(F.concat(F.lit("server"), F.col("task") % 4), F.col("coverage").cast("long"))
    shared = F.when(F.col("arm") == "arm1", F.map_concat(own, F.create_map(F.lit("shared"), F.lit(1).cast("long")))).otherwise(own)
    return E.server_calls(_cells(spark, sf).withColumn("mcp_by_server", shared), "task", "arm", "arm0", "arm1")


@query(f"""{_BOTH_SQL}, l AS (SELECT task, arm, 'cost' AS metric, cost AS v FROM b UNION ALL SELECT task, arm, 'input_tokens', input_tokens FROM b), s AS (SELECT metric, count(DISTINCT task) AS tasks, sum(v) FILTER (arm = 'arm0') AS x, sum(v) FILTER (arm = 'arm1') AS y FROM l GROUP BY metric)
SELECT metric, tasks, round(x / tasks, 6) AS before, round(y / tasks, 6) AS after FROM s""")
def arms_compared(spark: SparkSession, sf: str) -> DataFrame:
    return E.comparison_summary(_cells(spark, sf), "task", "arm", "arm0", "arm1", ["cost", "input_tokens"]).select("metric", "tasks", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


# Predicates on paths and names

_PATH = """concat(CASE p_partkey % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'a/__tests__/' WHEN 3 THEN 'a/test/' ELSE 'gen/out/' END,
  CASE p_partkey % 7 WHEN 0 THEN concat('f', p_partkey, '.ts') WHEN 1 THEN concat('f', p_partkey, '.test.py') WHEN 2 THEN '.env.local' WHEN 3 THEN 'id_rsa' WHEN 4 THEN concat('f', p_partkey, '_test.go') WHEN 5 THEN concat('k', p_partkey, '.pem') ELSE concat('test_', p_partkey, '.rb') END)"""
_IGNORE = ["gen/", "*.pem", "src/f1*0.ts", "a/test/f28.ts"]


@query(rf"""WITH p AS (SELECT p_partkey, {_PATH} AS path FROM part), n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '[^/](\.[^./]+)$', 1) AS ext FROM p)
SELECT p_partkey, path, ext, CASE ext WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.rb' THEN 'ruby' END AS language, regexp_matches(name, '^\.env|^id_rsa$|\.(pem|key|p12)$') AS sensitive,
  regexp_matches(path, '^node_modules/') AS skipped, regexp_matches(name, '\.test\.|_test\.|^test_') OR regexp_matches(path, '/(test|__tests__)/') AS test_file, regexp_matches(path, '^gen/|\.pem$|^src/f1.*0\.ts$|^a/test/f28\.ts$') AS ignored FROM n""")
def path_predicates(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_PATH).alias("path"))
    return rows.select("p_partkey", "path", S.extension(path).alias("ext"), S.language_of(S.extension(path)).alias("language"), S.is_sensitive(path).alias("sensitive"), S.in_skipped_dir(path).alias("skipped"), S.is_test_file(path).alias("test_file"), tree.ignored(path, _IGNORE).alias("ignored"))


_NAME = "CASE c_custkey % 6 WHEN 0 THEN concat('Card', c_custkey) WHEN 1 THEN 'PATCH' WHEN 2 THEN 'MAX_SIZE' WHEN 3 THEN concat('load', c_custkey) WHEN 4 THEN 'NODE_ENV' ELSE concat(c_mktsegment, '_API_', c_custkey) END"


@query(f"""WITH n AS (SELECT c_custkey, {_NAME} AS name FROM customer)
SELECT c_custkey, CASE WHEN name = 'PATCH' THEN 'route' WHEN regexp_matches(name, '^[A-Z]') AND NOT regexp_full_match(name, '[A-Z_]+') THEN 'component' ELSE 'function' END AS kind, regexp_matches(name, '^[A-Z]') AND NOT regexp_full_match(name, '[A-Z_]+') AS component, name <> 'NODE_ENV' AS accepted,
  CASE WHEN contains(name, '_API_') THEN 'api' ELSE 'config' END AS category, concat('repo', c_custkey) AS repo, CASE c_custkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'str' ELSE 'own' END AS short FROM n""")
def name_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows, key, name = table(spark, sf, "customer").withColumn("name", F.expr(_NAME)), F.col("c_custkey"), F.col("name")
    url = F.concat(F.lit("https://host/team/repo"), key, F.when(key % 2 == 0, ".git").otherwise(F.when(key % 3 == 0, "/").otherwise("")))
    kind = F.when(key % 3 == 0, "IntegerField").when(key % 3 == 1, "String").otherwise("Own")
    return rows.select("c_custkey", S.symbol_kind(name).alias("kind"), S.is_component(name).alias("component"), S.is_accepted_var(name).alias("accepted"), S.env_category(name).alias("category"), S.repo_name(url).alias("repo"), S.short_type(kind).alias("short"))


_OTHERS = (
    (".go", "package a\nfunc Run{s_suppkey}(a int) error {\n}\nfunc (s *Store) get{s_suppkey}(k string) (int, error) {\ntype Shape{s_nationkey} interface {\ntype box{s_suppkey} struct {\n"),
    (".rs", "pub fn run{s_suppkey}(x: u{s_nationkey}) -> u8 {\npub(crate) async fn go{s_suppkey}() {\npub struct A{s_suppkey} {\npub enum B{s_suppkey} {\npub trait C{s_suppkey} {\nfn hidden() {\n"),
    (".java", "public class Main{s_suppkey} extends X{s_nationkey} {\n  public static int run{s_suppkey}(String[] a) {\n  private void no() {\n"),
    (".rb", "def hello{s_suppkey}\nend\n"),
)


@query("""SELECT concat('other/', s_suppkey, v.ext) AS path, v.name, v.kind, v.signature, v.exported FROM supplier, LATERAL (VALUES
  ('.go', concat('Run', s_suppkey), 'function', concat('Run', s_suppkey, '(a int) error'), true), ('.go', concat('Store.get', s_suppkey), 'method', concat('get', s_suppkey, '(k string) (int, error)'), true),
  ('.go', concat('Shape', s_nationkey), 'interface', concat('Shape', s_nationkey, ' interface'), true), ('.go', concat('box', s_suppkey), 'class', concat('box', s_suppkey, ' struct'), false),
  ('.rs', concat('run', s_suppkey), 'function', concat('run', s_suppkey, '(x: u', s_nationkey, ') -> u8'), true), ('.rs', concat('go', s_suppkey), 'function', concat('go', s_suppkey, '()'), true), ('.rs', concat('A', s_suppkey), 'class', concat('struct A', s_suppkey), true),
  ('.rs', concat('B', s_suppkey), 'enum', concat('enum B', s_suppkey), true), ('.rs', concat('C', s_suppkey), 'interface', concat('trait C', s_suppkey), true),
  ('.java', concat('Main', s_suppkey), 'class', concat('public class Main', s_suppkey, ' extends X', s_nationkey), true), ('.java', concat('run', s_suppkey), 'method', concat('public static int run', s_suppkey, '(String[] a)'), true),
  ('.rb', concat('hello', s_suppkey), 'function', concat('hello', s_suppkey), true)) AS v(ext, name, kind, signature, exported)""")
def other_language_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Go, Rust, Java and Ruby."""
    files = None
    for ext, template in _OTHERS:
        more = made(spark, sf, "supplier", "s_suppkey", "other", ext, template)
        files = more if files is None else files.unionByName(more)
    return X.symbols(files).select("path", "name", "kind", F.trim(F.regexp_replace("signature", r"\s*\{$", "")).alias("signature"), "exported")


# Lookups


@query("""SELECT concat('User', s_suppkey) AS name, (SELECT array_to_string(list_sort(list(concat('Post', p.s_suppkey))), ',') FROM supplier p WHERE p.s_nationkey = 3) AS referrers FROM supplier WHERE s_suppkey = 3""")
def model_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A model by its name in any case, with the models that refer to it."""
    files = made(spark, sf, "supplier", "s_suppkey", "prisma", ".prisma", _PRISMA).unionByName(made(spark, sf, "supplier", "s_suppkey", "dj/models", ".py", _DJANGO))
    return D.look_up(D.models(files), "uSER3").select("name", F.array_join("referrers", ",").alias("referrers"))


@query("""WITH s AS (SELECT concat('src/nation/n', n_nationkey, '.ts') AS path, concat('n', n_nationkey) AS name, n_nationkey AS k FROM nation WHERE contains(concat('n', n_nationkey), 'n1') ORDER BY path LIMIT 5), u AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
SELECT path, name, nullif((SELECT count(*) FROM u WHERE u.k = s.k), 0) AS importers, (SELECT count(*) FROM u WHERE u.k = s.k) AS rank FROM s""")
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first five symbols that hold a name in any case, with their importers; the rank is their file's fan-in here."""
    files = sources(spark, sf)
    resolved = materialize(X.resolve_imports(files, materialize(X.imports(files), "imports")), "resolved")
    fan_in = G.ref_counts(files.select(F.col("path").alias("id")), X.import_edges(resolved)).select("id", F.col("refs").alias("rank"))
    return M.look_up_symbol(X.symbols(files), X.symbol_refs(resolved), fan_in, "N1").select("path", "name", "importers", "rank")


@query(f"""SELECT source, test FROM ({_TEST_MAPPING}) WHERE source = 'src/customer/c10.ts'""")
def test_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping found by its path without the extension, before any that only holds it."""
    files = sources(spark, sf)
    return M.look_up_tests(M.test_mapping(files.select("path"), X.test_names(files)), "src/customer/c10").select("source", "test")


@query(f"""SELECT source, concat('# Tests for ', source, ': ', test, ' (1 tests)', chr(10), '  - ', names, chr(10), '    expect(f', replace(names, 'handles ', ''), '(1)).toBe("x");') AS text FROM ({_TEST_MAPPING})""")
def tests_to_load(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown of the best test of each source: its names and their assertions."""
    files = sources(spark, sf)
    names = X.test_names(files)
    return R.test_lines(M.test_mapping(files.select("path"), names), X.test_assertions(files))


# Task files


@query("""SELECT CAST(p_partkey AS VARCHAR) AS instance_id, concat('org/', p_brand) AS repo, concat('say "', p_name, '",', chr(10), 'then ', p_type) AS problem_statement, language FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' ELSE 'go' END AS language FROM part) WHERE lower(language) = 'go' AND p_partkey % 10 <> 0""")
def csv_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of each part written as CSV, with quotes, commas and line breaks inside; rows without a commit are dropped, languages are chosen in any case."""
    p, folder = table(spark, sf, "part"), new_folder(spark, "tasks")
    text = F.concat(F.lit('say "'), "p_name", F.lit('",\nthen '), "p_type")
    language = F.when(F.col("p_partkey") % 3 == 0, "Python").when(F.col("p_partkey") % 3 == 1, "Go").otherwise("go")
    rows = p.select(F.col("p_partkey").cast("string").alias("instance_id"), F.concat(F.lit("org/"), "p_brand").alias("repo"), F.when(F.col("p_partkey") % 10 != 0, F.lit("abc")).alias("base_commit"), text.alias("problem_statement"), language.alias("language"))
    rows.write.csv(folder, header=True, quote='"', escape='"')
    return tree.read_tasks(spark, folder, ["GO"]).select("instance_id", "repo", "problem_statement", "language")


# Further reports


@query("""SELECT concat('src/size', p_size) AS dir, count(*) AS n, string_agg(concat('- make', p_partkey, ': ', p_name), chr(10) ORDER BY concat('- make', p_partkey, ': ', p_name)) AS text FROM part GROUP BY p_size ORDER BY n DESC, dir LIMIT 30""")
def danger_by_directory(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "part").select(F.concat(F.lit("src/size"), "p_size", F.lit("/part"), "p_partkey", F.lit(".ts")).alias("file"), F.concat(F.lit("make"), "p_partkey").alias("symbol"), F.col("p_name").alias("danger"))
    return P.danger_rules(notes)


@query("""WITH f AS (SELECT (SELECT sum(length(s_name)) FROM supplier) AS chars, (SELECT count(*) FROM nation) AS behind, (SELECT count(*) FROM region) AS modules), r AS (
  SELECT unnest([CASE WHEN modules > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN chars IS NULL THEN 'fail' WHEN chars > 40000 THEN 'warn' ELSE 'pass' END, CASE WHEN behind > 10 THEN 'warn' ELSE 'pass' END, CASE WHEN modules > 0 THEN 'pass' ELSE 'warn' END, 'warn']) AS status FROM f)
SELECT status, count(*) AS n FROM r GROUP BY status""")
def health_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of an index as the tables give them: its size by the suppliers' names, its age by the nations, its modules by the regions."""
    facts = table(spark, sf, "supplier").agg(F.sum(F.length("s_name")).alias("skeleton_chars")).crossJoin(table(spark, sf, "nation").agg(F.count("*").alias("commits_behind"))).crossJoin(table(spark, sf, "region").agg(F.count("*").alias("modules")))
    return P.status_counts(P.check_report(facts.select("*", (F.col("modules") > 0).alias("has_index"), F.lit(False).alias("has_hooks"))))


@query("""SELECT path, functions FROM (SELECT concat('src/auth', s_nationkey, '/s', s_suppkey, '.ts') AS path, concat('check', s_suppkey, ',login', s_suppkey, ',open,out,page') AS functions FROM supplier) ORDER BY path LIMIT 20""")
def access_context(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty files whose paths tell of access, with their first five symbols; others stay out."""
    text = "export function login{s_suppkey}() {}\nexport function check{s_suppkey}() {}\nexport function open() {}\nexport function out() {}\nexport function page() {}\nexport function rest() {}\n"
    named = made(spark, sf, "supplier", "s_suppkey", "", ".ts", text, path="src/auth{s_nationkey}/s{key}.ts")
    every = named.unionByName(made(spark, sf, "nation", "n_nationkey", "src/plain", ".ts", "export function other() {}\n"))
    return P.auth_context(RT.routes(every), X.symbols(every), D.models(every))["files"].select("path", F.array_join("functions", ",").alias("functions"))


@query("""SELECT p_partkey, CAST(floor(CASE WHEN p_size % 10 + 1 <= 3 THEN 1500 WHEN p_size % 10 + 1 <= 6 THEN 5000 ELSE 9000 END * CASE WHEN p_partkey % 40 >= 30 THEN 1.0 WHEN p_partkey % 40 >= 15 THEN 0.6 ELSE 0.3 END + 0.5) AS BIGINT) AS budget FROM part""")
def injection_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.injection_budget(F.col("p_size") % 10 + 1, (F.col("p_partkey") % 40) / 10).alias("budget"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'cached' WHEN o_orderkey % 3 = 0 THEN '—' ELSE concat(printf('$%.2f', o_custkey / 4.0::DOUBLE), ' / ', o_orderkey % 300, 's / ', coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 50 AS VARCHAR) END, '?'), ' turns') END AS cell FROM orders""")
def report_cells(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    cost = F.when(k % 3 != 0, F.col("o_custkey") / 4)
    return o.select("o_orderkey", S.cell_text(F.when(k % 7 == 0, "broken"), k % 5 == 0, cost, (k % 300).cast("double"), F.when(k % 2 == 0, F.col("o_custkey") % 50)).alias("cell"))


# The tree

_FOLDER = "CASE WHEN doc_id % 5 = 0 THEN 'node_modules/' WHEN doc_id % 7 = 0 THEN '.hidden/' ELSE 'src/' END"
_EXT = "CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '.ts' ELSE '.py' END"


@query(f"""SELECT concat('src/', source, '/', doc_id, {_EXT}) AS path, {_EXT} AS ext, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, sha256(coalesce(text, '')) AS content_sha256, false AS unreadable
FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND strlen(coalesce(text, '')) <= 500000""")
def tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as files of a tree, some in skipped and hidden directories or with other extensions, and scanned again with what can't be read."""
    root = new_folder(spark, "tree")
    files = table(spark, sf, "documents").select(F.concat(F.expr(_FOLDER), "source", F.lit("/"), F.col("doc_id").cast("string"), F.expr(_EXT)).alias("path"), F.col("text").alias("content"))
    tree.write_files(files, root)
    found = read_tree(spark, root)
    return found.select("path", "ext", "size_bytes", F.sha2(F.encode("content", "UTF-8"), 256).alias("content_sha256"), F.col("error").isNotNull().alias("unreadable"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
