"""Registry of the repository-analytics queries, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
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
from lodestone.plans.contracts import EDGES_SQL, NODES_SQL, SOURCES_SQL, documents_as_files, file_tasks, foreign_key_graph, sources, table
from lodestone.plans.state import materialize
from lodestone.sources import tree

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Scans and roll-ups


@query("SELECT lang AS ext, count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def scan_rollup_by_ext(spark: SparkSession, sf: str) -> DataFrame:
    return tree.roll_up(documents_as_files(spark, sf))


@query("SELECT source AS dir, CAST(sum(ceil(octet_length(encode(coalesce(text, ''))) / 3.7::DOUBLE)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_estimate_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return documents_as_files(spark, sf).groupBy("dir").agg(F.sum(S.token_estimate(F.col("content"))).alias("tokens"))


@query("SELECT source AS dir, CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY source")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    files = documents_as_files(spark, sf)
    return X.lines(files).join(files.select("path", "dir"), "path").groupBy("dir").agg(F.count("*").alias("lines"))


@query("""WITH cur AS (SELECT doc_id, sha256(coalesce(text, ''))[1:16] AS h FROM documents WHERE doc_id % 7 != 0),
old AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(coalesce(text, ''))[1:16] END AS h FROM documents WHERE doc_id % 3 != 0)
SELECT CASE WHEN cur.h IS NULL THEN 'prune' WHEN cur.h = old.h THEN 'hit' ELSE 'miss' END AS state, count(*) AS n FROM cur FULL JOIN old USING (doc_id) GROUP BY 1""")
def cache_hit_miss_prune(spark: SparkSession, sf: str) -> DataFrame:
    """The cache holds other files than the tree, and some with old content: both sides are made from the same table."""
    files = documents_as_files(spark, sf)
    cached = files.filter(F.col("ord") % 3 != 0).select("path", F.when(F.col("ord") % 5 == 0, "x").otherwise(S.hash16(F.col("content"))).alias("hash"))
    return tree.cache_diff(files.filter(F.col("ord") % 7 != 0), cached).groupBy("state").agg(F.count("*").alias("n"))


# Scalar functions


@query("""SELECT o_orderkey,
  CASE WHEN o_orderkey * 100 + 3 >= 1000 THEN printf('%.1fK', (o_orderkey * 100 + 3) / 1000) ELSE CAST(o_orderkey * 100 + 3 AS VARCHAR) END AS tokens_text,
  floor(o_totalprice / 7 * 10 + 0.5) / 10 AS rounded,
  CASE WHEN o_orderkey % 86400 * 3 < 60 THEN concat(o_orderkey % 86400 * 3, 's') WHEN o_orderkey % 86400 * 3 < 3600 THEN concat((o_orderkey % 86400 * 3) // 60, 'm') WHEN o_orderkey % 86400 * 3 < 86400 THEN concat((o_orderkey % 86400 * 3) // 3600, 'h') ELSE concat((o_orderkey % 86400 * 3) // 86400, 'd') END AS age,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN concat('@s', o_custkey % 5, '/lib') ELSE concat('pkg', o_custkey % 9) END AS package,
  greatest(0.0, least(o_totalprice / 100000, 3.0)) AS clamped
FROM orders""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    source = F.when(key % 3 == 0, F.concat(F.lit("./local"), key)).when(key % 3 == 1, F.concat(F.lit("@s"), cust % 5, F.lit("/lib/deep"))).otherwise(F.concat(F.lit("pkg"), cust % 9, F.lit("/x")))
    return o.select("o_orderkey", S.human_tokens(key * 100 + 3).alias("tokens_text"), S.round_half_up(F.col("o_totalprice") / 7, 1).alias("rounded"), S.age_text(key % 86400 * 3).alias("age"), S.package_name(source).alias("package"), S.clamp(F.col("o_totalprice") / 100000, 0.0, 3.0).alias("clamped"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(replace(regexp_replace(concat(p_type, 'Of', p_brand, '_', p_name), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '\\s+'), lambda x: x <> ''), '|') AS words FROM part")
def identifier_words(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_type", F.lit("Of"), "p_brand", F.lit("_"), "p_name")
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.split_identifier(name), "|").alias("words"))


# Secrets

_TOKEN_RULE = ((r"token = \"[0-9a-f]{40}\"", "token", "assigned token"),)


@query("""WITH l AS (SELECT concat(source, '/', doc_id, '.', lang) AS path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT path, CAST(line AS INTEGER) AS line, 'token' AS type FROM l WHERE regexp_matches(t, 'token = "[0-9a-f]{40}"') AND NOT contains(t, 'process.env') AND NOT contains(t, 'os.environ') AND NOT contains(t, '${') AND NOT contains(t, 'getenv')""")
def secret_scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    return X.secret_warnings(documents_as_files(spark, sf), _TOKEN_RULE).select("path", "line", "type")


@query("SELECT doc_id, sha256(regexp_replace(text, 'token = \"[0-9a-f]{40}\"', '[REDACTED assigned token]')) AS redacted FROM documents")
def redact_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.encode(S.redact_first(F.col("text"), [(p, label) for p, _, label in _TOKEN_RULE]), "UTF-8"), 256).alias("redacted"))


# Code made from tables


@query(f"""WITH f AS ({SOURCES_SQL}) SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir, n FROM (
  SELECT path, 1 AS n FROM f WHERE contains(content, 'export function') AND NOT contains(path, '.test.')
  UNION ALL SELECT path, 2 FROM f WHERE starts_with(path, 'src/region/') UNION ALL SELECT path, 1 FROM f WHERE starts_with(path, 'src/supplier/'))""")
def synth_symbols_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return X.symbols(sources(spark, sf)).groupBy("path").agg(F.count("*").cast("int").alias("n")).select("path", S.dir_name(F.col("path")).alias("dir"), "n")


@query("""SELECT concat('src/customer/c', c_custkey, '.ts') AS path, CAST(CASE WHEN c_custkey % 4 = 0 THEN 4 ELSE 4 END AS INTEGER) - 1 AS line, concat('f', c_custkey) AS name, 'function' AS kind, concat('f', c_custkey, '(id: number): string') AS signature FROM customer
UNION ALL SELECT concat('src/nation/n', n_nationkey, '.ts'), 3, concat('n', n_nationkey), 'function', concat('n', n_nationkey, '(id: number): string') FROM nation
UNION ALL SELECT concat('src/supplier/s', s_suppkey, '.ts'), 2, concat('g', s_suppkey), 'function', concat('g', s_suppkey, '(id: number)') FROM supplier
UNION ALL SELECT concat('src/region/r', r_regionkey, '/index.ts'), 1, concat('r', r_regionkey), 'function', concat('r', r_regionkey, '(id: number)') FROM region
UNION ALL SELECT concat('src/region/r', r_regionkey, '/index.ts'), 2, 'other', 'variable', 'other' FROM region""")
def synth_function_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return X.symbols(sources(spark, sf)).select("path", F.col("line").cast("int").alias("line"), "name", "kind", "signature")


@query("""SELECT concat('n', n_nationkey) AS name, concat('nation number ', n_nationkey) AS description FROM nation UNION ALL SELECT concat('f', c_custkey), NULL FROM customer
UNION ALL SELECT concat('g', s_suppkey), NULL FROM supplier UNION ALL SELECT unnest([concat('r', r_regionkey), 'other']), NULL FROM region""")
def synth_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return X.symbols(sources(spark, sf)).select("name", "description")


@query("""SELECT concat('src/customer/c', c_custkey, '.ts') AS src, concat('src/nation/n', c_nationkey, '.ts') AS dst, CAST(1 AS BIGINT) AS weight FROM customer
UNION ALL SELECT concat('src/supplier/s', s_suppkey, '.ts'), concat('src/nation/n', s_nationkey, '.ts'), 1 FROM supplier
UNION ALL SELECT concat('src/nation/n', n_nationkey, '.ts'), concat('src/region/r', n_regionkey, '/index.ts'), 2 FROM nation""")
def synth_import_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Import resolution must give the foreign keys back."""
    files = sources(spark, sf)
    return X.import_edges(X.resolve_imports(files, X.imports(files))).select("src", "dst", "weight")


@query("SELECT concat('n', n_nationkey) AS name, count(DISTINCT p) AS importers FROM (SELECT c_nationkey AS n_nationkey, concat('c', c_custkey) AS p FROM customer UNION ALL SELECT s_nationkey, concat('s', s_suppkey) FROM supplier) GROUP BY n_nationkey UNION ALL SELECT concat('r', n_regionkey), count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'other', count(*) FROM nation HAVING count(*) > 0")
def synth_symbol_refs(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    refs = X.symbol_refs(X.resolve_imports(files, X.imports(files)))
    return refs.groupBy("name").agg(F.count_distinct("importer").alias("importers"))


@query("""SELECT name, import_count, is_private FROM (
  SELECT concat('@scope', c_custkey % 7, '/lib') AS name, count(*) AS import_count, true AS is_private FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1
  UNION ALL SELECT concat('pkg', c_custkey % 11), count(*), false FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1)""")
def synth_external_packages(spark: SparkSession, sf: str) -> DataFrame:
    return X.packages(X.imports(sources(spark, sf))).select("name", "import_count", "is_private")


@query("SELECT concat(c_mktsegment, '_TOKEN') AS name, min(concat('src/customer/c', c_custkey, '.ts')) AS source, true AS required, 'auth' AS category FROM customer GROUP BY c_mktsegment")
def synth_env_first_writer(spark: SparkSession, sf: str) -> DataFrame:
    return X.env_vars(sources(spark, sf)).select("name", "source", "required", "category")


@query("SELECT concat(c_mktsegment, '_TOKEN') AS name, count(*) AS files, array_to_string(list_sort(list(concat('src/customer/c', c_custkey, '.ts')))[1:3], ',') AS shown FROM customer GROUP BY c_mktsegment")
def synth_env_consumers(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    return M.env_consumers(files, X.env_vars(files)).select("name", "files", F.array_join("shown", ",").alias("shown"))


@query("""SELECT concat('src/customer/c', c_custkey, '.ts') AS file, 'GET' AS method, concat('/c/', c_custkey % 50) AS path, NULL AS auth, NULL AS body_schema FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT concat('src/customer/c', c_custkey, '.ts'), m, concat('/c/', c_custkey % 50), 'required', 'CustomerSchema' FROM customer, (VALUES ('GET'), ('POST')) AS v(m) WHERE c_custkey % 10 = 0""")
def synth_routes(spark: SparkSession, sf: str) -> DataFrame:
    return RT.routes(sources(spark, sf)).select("file", "method", "path", "auth", "body_schema")


@query("""SELECT concat('/c/', c_custkey % 50) AS path, CASE WHEN c_custkey % 50 % 10 = 0 THEN 'GET,POST' ELSE 'GET' END AS methods, CASE WHEN c_custkey % 50 % 10 = 0 THEN 'required' END AS auth, CASE WHEN c_custkey % 50 % 10 = 0 THEN 'CustomerSchema' END AS body_schema
FROM customer GROUP BY c_custkey % 50""")
def synth_routes_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return RT.group_routes(RT.routes(sources(spark, sf))).select("path", F.array_join("methods", ",").alias("methods"), "auth", "body_schema")


@query("SELECT concat('src/customer/c', c_custkey, '.ts') AS file, concat('/c/', c_custkey % 50) AS path, 'c' AS grp FROM customer WHERE c_custkey % 10 = 0 AND contains(concat('/c/', c_custkey % 50), '/c/4')")
def synth_route_filter(spark: SparkSession, sf: str) -> DataFrame:
    return RT.filter_routes(RT.routes(sources(spark, sf)), "post", "/C/4").select("file", "path", F.col("group").alias("grp"))


_FAN_IN = """SELECT concat('src/nation/n', c_nationkey, '.ts') AS path, count(*) AS fan_in FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1
UNION ALL SELECT concat('src/region/r', n_regionkey, '/index.ts'), count(*) FROM nation GROUP BY 1"""


@query(f"""WITH f AS (SELECT concat('src/customer/c', c_custkey, '.ts') AS path, 1 AS fan_out, CASE WHEN c_custkey % 6 = 0 THEN 3 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS branch_count,
    8 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS lines, 1 AS symbols FROM customer
  UNION ALL SELECT concat('src/customer/c', c_custkey, '.test.ts'), 0, 0, 4, 0 FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT concat('src/supplier/s', s_suppkey, '.ts'), 1, 0, 3, 1 FROM supplier UNION ALL SELECT concat('src/nation/n', n_nationkey, '.ts'), 1, 0, 6, 1 FROM nation
  UNION ALL SELECT concat('src/region/r', r_regionkey, '/index.ts'), 0, 0, 3, 2 FROM region), i AS ({_FAN_IN})
SELECT f.path, CAST(fan_out AS BIGINT) AS fan_out, coalesce(fan_in, 0) AS fan_in, CAST(branch_count AS BIGINT) AS branch_count,
  floor(least(10.0::DOUBLE, fan_out / 3.0::DOUBLE + least(coalesce(fan_in, 0) / 3.0::DOUBLE, 3.0) + branch_count / 15.0::DOUBLE + lines / 200.0::DOUBLE + symbols / 10.0::DOUBLE) * 10 + 0.5) / 10 AS score
FROM f LEFT JOIN i ON i.path = f.path""")
def synth_complexity(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    used = materialize(X.imports(files), "imports")
    edges = X.import_edges(X.resolve_imports(files, used))
    n = X.symbols(files).groupBy("path").agg(F.count("*").alias("symbol_count"))
    fan_in = G.ref_counts(files.select(F.col("path").alias("id")), edges).select(F.col("id").alias("path"), F.col("refs").alias("fan_in"))
    return X.complexity(files, fan_in, n, used).select("path", "fan_out", "fan_in", "branch_count", "score")


@query("""SELECT concat('f', c_custkey) AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('n', c_nationkey) ELSE '' END AS calls, CASE WHEN c_custkey % 6 = 0 THEN 'CaseError' ELSE '' END AS throws FROM customer
UNION ALL SELECT concat('g', s_suppkey), concat('n', s_nationkey), '' FROM supplier UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), '' FROM nation
UNION ALL SELECT unnest([concat('r', r_regionkey), 'other']), '', '' FROM region""")
def synth_calls_and_throws(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    scanned = X.scanned_scripts(files)
    return X.bodies(files, X.symbols(files, scanned), X.imports(files), scanned).select("name", F.array_join("calls", ",").alias("calls"), F.array_join("throws", ",").alias("throws"))


@query("""WITH s AS (SELECT c_custkey AS k FROM customer), t AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 = 0), c AS (
  SELECT concat('src/customer/c', s.k, '.ts') AS source, concat('src/customer/c', t.k, '.test.ts') AS test, CAST(CASE WHEN s.k = t.k THEN 24 ELSE 2 END AS BIGINT) AS score, t.k FROM s, t
  WHERE contains(concat('c', t.k), concat('c', s.k)) OR contains(concat('c', s.k), concat('c', t.k)))
SELECT source, test, score, least(score / 10.0::DOUBLE, 1.0::DOUBLE) AS confidence, concat('handles ', k) AS names FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, test) = 1""")
def synth_test_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """The best test of each source, its own or one of a kindred name."""
    files = sources(spark, sf)
    return M.test_mapping(files.select("path"), X.test_names(files)).select("source", "test", "score", "confidence", F.array_join("test_names", ",").alias("names"))


@query("""WITH s AS (SELECT c_custkey AS k FROM customer), t AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 = 0)
SELECT concat('src/customer/c', s.k, '.ts') AS source, concat('src/customer/c', t.k, '.test.ts') AS test, CAST(CASE WHEN s.k = t.k THEN 24 ELSE 2 END AS BIGINT) AS score FROM s, t
WHERE contains(concat('c', t.k), concat('c', s.k)) OR contains(concat('c', s.k), concat('c', t.k))""")
def synth_test_candidates(spark: SparkSession, sf: str) -> DataFrame:
    paths = sources(spark, sf).select("path")
    return M.test_candidates(paths.filter(~S.is_test_file(F.col("path"))), paths.filter(S.is_test_file(F.col("path"))))


@query("SELECT concat('src/customer/c', c_custkey, '.test.ts') AS path, concat('handles ', c_custkey) AS test, concat('  expect(f', c_custkey, '(1)).toBe(\"x\");') AS text FROM customer WHERE c_custkey % 5 = 0")
def synth_test_assertions(spark: SparkSession, sf: str) -> DataFrame:
    return X.test_assertions(sources(spark, sf)).select("path", "test", "text")


@query("""WITH u AS (SELECT concat('src/customer/c', c_custkey, '.ts') AS path, 4 AS line, concat('if (id > ', c_nationkey, ') { return n', c_nationkey, '(id); }') AS context FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 = 0
  UNION ALL SELECT concat('src/supplier/s', s_suppkey, '.ts'), 1, 'const { n3 } = require("../nation/n3");' FROM supplier WHERE s_nationkey = 3
  UNION ALL SELECT concat('src/supplier/s', s_suppkey, '.ts'), 2, concat('export const g', s_suppkey, ' = (id: number) => n3(id);') FROM supplier WHERE s_nationkey = 3)
SELECT * FROM u WHERE path IN (SELECT DISTINCT path FROM u ORDER BY path LIMIT 20)""")
def synth_usages(spark: SparkSession, sf: str) -> DataFrame:
    """Usages of n3: the first 20 files, as the report shows."""
    files = sources(spark, sf)
    used = X.resolve_imports(files, materialize(X.imports(files), "imports"))
    return M.usages(files, X.symbols(files), X.symbol_refs(used), "n3")


@query("""WITH r AS (SELECT concat('src/nation/n', c_nationkey, '.ts') AS def_path, concat('src/customer/c', c_custkey, '.ts') AS importer, CASE WHEN c_custkey % 3 = 0 THEN 4 END AS line FROM customer
  UNION ALL SELECT concat('src/nation/n', s_nationkey, '.ts'), concat('src/supplier/s', s_suppkey, '.ts'), 1 FROM supplier
  UNION ALL SELECT concat('src/region/r', n_regionkey, '/index.ts'), concat('src/nation/n', n_nationkey, '.ts'), 4 FROM nation)
SELECT def_path, importer, line FROM r QUALIFY row_number() OVER (PARTITION BY def_path ORDER BY importer) <= 3 AND line IS NOT NULL""")
def synth_caller_context(spark: SparkSession, sf: str) -> DataFrame:
    """Callers of every symbol; the second export of a region is imported but never used, so it has no line."""
    files = sources(spark, sf)
    refs = X.symbol_refs(X.resolve_imports(files, X.imports(files)))
    return M.caller_context(files, refs).select("def_path", "importer", F.col("line").cast("int").alias("line"))


@query("SELECT 'src/customer' AS module, 'src/nation' AS dependencies, NULL AS dependents UNION ALL SELECT 'src/supplier', 'src/nation', NULL UNION ALL SELECT 'src/nation', (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT concat('src/region/r', n_regionkey) AS d FROM nation)), 'src/customer,src/supplier' UNION ALL SELECT DISTINCT concat('src/region/r', r_regionkey), NULL, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation) THEN 'src/nation' END FROM region")
def synth_module_contracts(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    edges = X.import_edges(X.resolve_imports(files, X.imports(files)))
    return R.module_contracts(files, edges).select("module", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


@query(f"""WITH direct AS (SELECT concat('src/nation/n', c_nationkey, '.ts') AS id, concat('src/customer/c', c_custkey, '.ts') AS dependent, c_nationkey AS n FROM customer
  UNION ALL SELECT concat('src/nation/n', s_nationkey, '.ts'), concat('src/supplier/s', s_suppkey, '.ts'), s_nationkey FROM supplier UNION ALL SELECT concat('src/region/r', n_regionkey, '/index.ts'), concat('src/nation/n', n_nationkey, '.ts'), NULL FROM nation),
f AS (SELECT id, count(*) AS fan_in FROM direct GROUP BY id ORDER BY fan_in DESC, id LIMIT 30),
near AS (SELECT id, dependent FROM direct UNION SELECT concat('src/region/r', n_regionkey, '/index.ts'), dependent FROM direct JOIN nation ON n = n_nationkey),
wide AS (SELECT id, dependent FROM near SEMI JOIN f USING (id) UNION SELECT id, id FROM f),
r AS (SELECT DISTINCT id, concat(method, ' ', path) AS r FROM wide JOIN ({_SQL["synth_routes"]}) ON file = dependent), t AS (SELECT DISTINCT id, test FROM wide JOIN ({_SQL["synth_test_mapping"]}) ON source = dependent)
SELECT f.id, f.fan_in, (SELECT count(*) FROM near WHERE near.id = f.id) AS dependents, (SELECT array_to_string(list_sort(list(r))[1:10], ',') FROM r WHERE r.id = f.id) AS routes, (SELECT array_to_string(list_sort(list(test))[1:10], ',') FROM t WHERE t.id = f.id) AS tests FROM f""")
def synth_impact_map(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    edges = X.import_edges(X.resolve_imports(files, X.imports(files)))
    tests = M.test_mapping(files.select("path"), X.test_names(files)).select("source", "test")
    return M.impact_map(edges, RT.routes(files), tests).select("id", "fan_in", "dependents", F.array_join("routes", ",").alias("routes"), F.array_join("tests", ",").alias("tests"))


@query("""WITH f AS (SELECT c_custkey AS k FROM customer ORDER BY concat('src/customer/c', c_custkey, '.ts') LIMIT 20), n AS (SELECT count(*) AS files, count(*) FILTER (k % 6 = 0) AS throws FROM f)
SELECT 'patterns: prefers named exports over default exports' AS habit FROM n WHERE files > 0
UNION ALL SELECT 'testing: uses .test.{ext} naming convention' FROM (SELECT count(*) AS t FROM customer WHERE c_custkey % 5 = 0) WHERE t > 0
UNION ALL SELECT 'imports: prefers relative imports' FROM n WHERE files > 2 * files""")
def synth_conventions(spark: SparkSession, sf: str) -> DataFrame:
    """All habits that the first twenty files show; their imports are half relative, their names hold digits, their errors are no classes of their own."""
    files = sources(spark, sf)
    return M.conventions(files, materialize(X.symbols(files), "symbols"), X.imports(files)).select(F.concat_ws(": ", "category", "text").alias("habit"))


@query()
def synth_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked, budgeted map of the sources. Tested against a loop over a fixture."""
    files = sources(spark, sf)
    used, declared = materialize(X.imports(files), "imports"), materialize(X.symbols(files), "symbols")
    edges = X.import_edges(X.resolve_imports(files, used))
    nodes = files.select(F.col("path").alias("id"))
    ranks, refs = G.page_rank(nodes, edges, rounds=5), G.ref_counts(nodes, edges)
    n = declared.groupBy("path").agg(F.count("*").alias("symbol_count"))
    cx = X.complexity(files, refs.select(F.col("id").alias("path"), F.col("refs").alias("fan_in")), n, used)
    central = ranks.join(refs, "id").select(F.col("id").alias("path"), "rank", "refs").join(cx.select("path", "score"), "path")
    return R.skeleton(central, declared, files.count())


@query("""SELECT concat('P', p_partkey) AS name, 'id:int,title:str' AS fields, concat('owner->Brand', p_size) AS relations FROM part""")
def synth_models(spark: SparkSession, sf: str) -> DataFrame:
    """A Prisma model for each part."""
    text = F.concat(F.lit("model P"), F.col("p_partkey"), F.lit(" {\n  id Int @id @default(1)\n  title String?\n  owner Brand"), F.col("p_size"), F.lit("\n\n  // note\n}\n"))
    files = table(spark, sf, "part").select(F.concat(F.lit("db/p"), "p_partkey", F.lit(".prisma")).alias("path"), F.lit(".prisma").alias("ext"), text.alias("content"))
    return D.models(files).select("name", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), S.short_type(f["type"]))), ",").alias("fields"), F.array_join(F.transform("relations", lambda r: F.concat(r["field"], F.lit("->"), r["target"])), ",").alias("relations"))


# Graphs


def _rank_sql(teleport: str, rounds: int = 20) -> str:
    """Page rank as a chain of materialized tables."""
    parts = [f"nodes AS MATERIALIZED (SELECT id, {teleport} AS tp FROM ({NODES_SQL}))", f"e AS MATERIALIZED ({EDGES_SQL})", "share AS MATERIALIZED (SELECT src, dst, sum(weight) / sum(sum(weight)) OVER (PARTITION BY src) AS w FROM e GROUP BY src, dst)", "r0 AS MATERIALIZED (SELECT id, tp, CAST(tp AS DOUBLE) AS r FROM nodes)"]
    for k in range(rounds):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT n.id, n.tp, 0.15 * n.tp + 0.85 * coalesce(i.s, 0) + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM share)) * n.tp AS r "
            f"FROM nodes n LEFT JOIN (SELECT dst, sum(r * w) AS s FROM share JOIN r{k} ON id = src GROUP BY dst) i ON i.dst = n.id)"
        )
    return f"WITH {', '.join(parts)} SELECT id, round(r, 9) AS rank FROM r{rounds}"


@query(_rank_sql(f"1.0::DOUBLE / (SELECT count(*) FROM ({NODES_SQL}))"))
def pagerank_fk(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = foreign_key_graph(spark, sf)
    return G.page_rank(nodes, edges).select("id", F.round("rank", 9).alias("rank"))


@query(_rank_sql("CASE WHEN id = 'c1' THEN 0.25::DOUBLE WHEN id = 'o5' THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END"))
def pagerank_seeded(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = foreign_key_graph(spark, sf)
    seeds = spark.createDataFrame([("c1", 1.0), ("o5", 3.0)], "id string, weight double")
    return G.page_rank(nodes, edges, seeds).select("id", F.round("rank", 9).alias("rank"))


@query(f"WITH e AS ({EDGES_SQL}) SELECT n.id, count(DISTINCT e.src) AS refs FROM ({NODES_SQL}) n LEFT JOIN e ON e.dst = n.id GROUP BY n.id")
def refcounts_with_zeros(spark: SparkSession, sf: str) -> DataFrame:
    return G.ref_counts(*foreign_key_graph(spark, sf))


@query("SELECT concat('n', n_nationkey) AS id, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT concat('c', c_custkey), 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT concat('s', s_suppkey), 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT concat('o', o_orderkey), 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def blast_radius_region(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = foreign_key_graph(spark, sf)
    return G.transitive_dependents(edges, spark.createDataFrame([("r1",)], "id string"))


@query(f"WITH e AS ({EDGES_SQL}), one AS (SELECT dst AS id, src AS d FROM e), two AS (SELECT a.id, b.d FROM one a JOIN one b ON b.id = a.d), u AS (SELECT id, d, 1 AS k FROM one UNION ALL SELECT id, d, 2 FROM two) SELECT id, count(DISTINCT d) AS dependents, count(DISTINCT CASE WHEN k = 1 THEN d END) AS direct FROM u WHERE id <> d GROUP BY id")
def impact_depth2(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = foreign_key_graph(spark, sf)
    return G.dependents_within_two(edges).groupBy("id").agg(F.count("*").alias("dependents"), F.count_if(F.col("depth") == 1).alias("direct"))


@query()
def call_chain_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """The walk from each region to its most central importers. Tested against a loop."""
    nodes, edges = foreign_key_graph(spark, sf)
    chains = G.call_chain(edges, G.page_rank(nodes, edges, rounds=3), nodes.filter(F.col("id").startswith("r")))
    return chains.select("id", F.array_join("chain", " < ").alias("chain"))


@query("SELECT host, count(DISTINCT href) AS targets FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY host")
def page_href_edges(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("host").agg(F.count_distinct("href").alias("targets"))


@query(f"""WITH i AS ({_FAN_IN}), n AS (SELECT concat('src/nation/n', n_nationkey, '.ts') AS id, CASE WHEN coalesce(fan_in, 0) = 0 THEN 2 ELSE 0 END AS w, coalesce(fan_in, 0) AS f FROM nation LEFT JOIN i ON i.path = concat('src/nation/n', n_nationkey, '.ts')
  UNION ALL SELECT concat('src/region/r', r_regionkey, '/index.ts'), 3, coalesce(fan_in, 0) FROM region LEFT JOIN i ON i.path = concat('src/region/r', r_regionkey, '/index.ts'))
SELECT concat('src/customer/c', c_custkey, '.ts') AS id, CAST(2 AS DOUBLE) AS weight FROM customer UNION ALL SELECT concat('src/supplier/s', s_suppkey, '.ts'), 2 FROM supplier
UNION ALL SELECT id, w + CASE WHEN f >= 3 THEN 1 ELSE 0 END + CASE WHEN f >= 10 THEN 1 ELSE 0 END FROM n WHERE w > 0 OR f >= 3""")
def synth_entry_seeds(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    resolved = materialize(X.resolve_imports(files, materialize(X.imports(files), "imports")), "resolved")
    edges = X.import_edges(resolved)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("out_edges"))
    callers = X.symbol_refs(resolved).groupBy(F.col("def_path").alias("id"), "name").agg(F.count_distinct("importer").alias("n")).groupBy("id").agg(F.max("n").alias("most_callers"))
    own = X.symbols(files).groupBy(F.col("path").alias("id")).agg(F.count_if("exported").alias("exported"))
    nodes = files.select(F.col("path").alias("id"))
    wide = G.ref_counts(nodes, edges).withColumnRenamed("refs", "in_edges").join(out, "id", "left").join(callers, "id", "left").join(own, "id", "left").fillna(0)
    return G.entry_seeds(wide)


# Ranking


@query("""SELECT l_partkey AS file, count(*) AS commits, CAST(0 AS BIGINT) AS minor_authors FROM lineitem GROUP BY l_partkey HAVING count(*) <= 20
UNION ALL SELECT file, commits, (SELECT count(*) FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey = file GROUP BY l_suppkey) WHERE n < 0.05 * commits) FROM (SELECT l_partkey AS file, count(*) AS commits FROM lineitem GROUP BY l_partkey HAVING count(*) > 20)""")
def churn_minor_authors(spark: SparkSession, sf: str) -> DataFrame:
    commits = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"))
    return tree.git_signals(commits).select("file", "commits", "minor_authors")


_IMPORTANCE_SQL = """SELECT c_custkey, round(least(coalesce(r, 0) * 500 / 1e6, 1) * 4.0 + least(coalesce(n, 0) / 30.0::DOUBLE, 1) + least((c_custkey % 9) / 5.0::DOUBLE, 1) * 2.0 + least((c_nationkey % 20) / 15.0::DOUBLE, 1) + least((c_custkey % 13) / 10.0::DOUBLE, 1) * 0.8 + CASE WHEN c_custkey % 5 = 0 THEN 0.5 ELSE 0 END, 9) AS importance
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) / 500 AS r FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""


def _important(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("commits"), (F.max("o_totalprice") / 500 / 1e6).alias("rank"))
    key = F.col("c_custkey")
    files = table(spark, sf, "customer").join(orders, "c_custkey", "left").select("c_custkey", "commits", "rank", (key % 9).alias("minor_authors"), (F.col("c_nationkey") % 20).alias("fan_out"), (key % 13).alias("complexity"), (key % 5 == 0).alias("has_tests"))
    return G.importance(files).select("c_custkey", F.round("importance", 9).alias("importance"))


@query(_IMPORTANCE_SQL)
def importance_blended(spark: SparkSession, sf: str) -> DataFrame:
    return _important(spark, sf)


@query(f"WITH s AS ({_IMPORTANCE_SQL}), k AS (SELECT importance, row_number() OVER (ORDER BY importance DESC, c_custkey) - 1 AS p, count(*) OVER () AS n FROM s), a AS (SELECT max(CASE WHEN p = floor(0.2 * n) THEN importance END) AS hi, max(CASE WHEN p = least(n - 1, floor(0.8 * n)) THEN importance END) AS lo FROM k) SELECT c_custkey, CASE WHEN importance >= hi THEN 'critical' WHEN importance < lo THEN 'peripheral' ELSE 'standard' END AS tier FROM s, a")
def tier_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return G.tiers(_important(spark, sf), "importance", ["c_custkey"]).select("c_custkey", "tier")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("dir"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).filter(F.length("keyword") >= 5).distinct()


_WORDS_SQL = "SELECT DISTINCT source AS dir, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS keyword FROM documents"


@query(f"WITH w AS (SELECT * FROM ({_WORDS_SQL}) WHERE length(keyword) >= 5) SELECT keyword, count(*) AS df, round(ln((20 - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM w GROUP BY keyword")
def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    return R.idf(_words(spark, sf)).select("keyword", "df", F.round("idf", 6).alias("idf"))


_QUESTION = "Why does thereand fail after onthere and whether ething breaks thereand"
_MATCH_SQL = "(k.keyword = t.term OR (length(t.term) >= 4 AND (starts_with(k.keyword, t.term) OR ends_with(k.keyword, t.term))) OR (length(k.keyword) >= 4 AND (starts_with(t.term, k.keyword) OR ends_with(t.term, k.keyword))))"


@query(
    f"""WITH w AS MATERIALIZED (SELECT * FROM ({_WORDS_SQL}) WHERE length(keyword) >= 5), k AS MATERIALIZED (SELECT keyword, ln((20 - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM w GROUP BY keyword),
t AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_split_to_array(lower('{_QUESTION}'), '\\s+')) AS term) WHERE length(term) >= 4 GROUP BY term), m AS (SELECT k.keyword, k.idf, t.term, t.times FROM k, t WHERE {_MATCH_SQL}),
d AS (SELECT dir, count(*) AS dl FROM w GROUP BY dir), a AS (SELECT avg(dl) AS avgdl FROM d), p AS (SELECT w.dir, m.term, m.times, count(*) AS tf, max(m.idf) AS best FROM w JOIN m USING (keyword) GROUP BY w.dir, m.term, m.times)
SELECT p.dir, round(sum(times * best * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN d USING (dir), a GROUP BY p.dir"""
)
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(_words(spark, sf), R.terms_of(spark, _QUESTION, "bm25")).select("dir", F.round("score", 6).alias("score"))


@query(f"WITH w AS MATERIALIZED (SELECT * FROM ({_WORDS_SQL}) WHERE length(keyword) >= 5), t(term, times) AS (VALUES ('thereand', 2), ('fail', 1), ('after', 1), ('onthere', 1), ('whether', 1), ('ething', 1), ('breaks', 1), ('does', 0)) SELECT dir, CAST(sum(times) AS BIGINT) AS hits FROM (SELECT DISTINCT dir, term, times FROM w, t WHERE times > 0 AND (contains(keyword, term) OR contains(term, keyword))) GROUP BY dir")
def context_hits(spark: SparkSession, sf: str) -> DataFrame:
    return R.context_hits(_words(spark, sf), R.terms_of(spark, _QUESTION, "context"))


@query("""SELECT path, score FROM (SELECT concat('src/customer/c', c_custkey, '.ts') AS path, CAST(CASE WHEN contains(concat('f', c_custkey), 'f12') THEN 2 ELSE 0 END + 2 + 1 AS BIGINT) AS score FROM customer
UNION ALL SELECT concat('src/customer/c', c_custkey, '.test.ts'), 1 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT concat('src/nation/n', n_nationkey, '.ts'), 2 FROM nation UNION ALL SELECT concat('src/supplier/s', s_suppkey, '.ts'), 2 FROM supplier UNION ALL SELECT concat('src/region/r', r_regionkey, '/index.ts'), 2 FROM region) ORDER BY score DESC, path LIMIT 8""")
def issue_candidates_top8(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    return R.issue_candidates(X.symbols(files), files, R.terms_of(spark, "The f12 number on customer", "issue"))


@query("""SELECT conv_id, turn, greatest(1, least(10, 3 + CASE WHEN length(text) > 200 THEN 1 ELSE 0 END + CASE WHEN length(text) > 500 THEN 1 ELSE 0 END - CASE WHEN length(text) < 30 THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])test') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])add($|[^\\p{L}\\p{N}_])') THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9_]+\\.[A-Za-z0-9_]{2,4}')) >= 2 THEN 2 ELSE 0 END)) AS complexity FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def prompt_complexity_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", S.prompt_complexity(F.coalesce("text", F.lit(""))).alias("complexity"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'env-audit' WHEN 1 THEN 'auth-context' WHEN 2 THEN 'route-graph' WHEN 3 THEN 'impact-map' ELSE '' END AS labels FROM customer""")
def task_classifier(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    prompt = F.when(key % 5 == 0, "list the env of ").when(key % 5 == 1, "trace login for ").when(key % 5 == 2, "GET /api/customer/").when(key % 5 == 3, "what is affected by ").otherwise("tidy up ")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(S.task_labels(F.concat(prompt, key)), ",").alias("labels"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders) WHERE coalesce(b, 0) < 500000")
def budget_prefix_stop(spark: SparkSession, sf: str) -> DataFrame:
    return R.pack_prefix(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], "o_totalprice", 500_000).select("o_custkey", "o_orderkey")


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey AS g, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT g FROM o) UNION ALL SELECT r.g, r.i + 1, CASE WHEN r.used + o.s <= 600000 THEN r.used + o.s ELSE r.used END, CASE WHEN r.used + o.s <= 600000 THEN r.n + 1 ELSE r.n END FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
SELECT g AS o_custkey, max(used) AS used, max(n) AS picked FROM r GROUP BY g"""
)
def budget_greedy_skip(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("size"))
    return R.pack_skipping(orders, ["o_custkey"], "o_orderkey", "o_orderkey", "size", 600_000).select("o_custkey", "used", F.size("picked").cast("long").alias("picked"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def topk_per_group_cap5(spark: SparkSession, sf: str) -> DataFrame:
    return M.group_top(table(spark, sf, "orders"), F.col("o_custkey"), [F.desc("o_totalprice"), "o_orderkey"], None, 5).select("o_custkey", "o_orderkey")


@query("WITH s AS (SELECT DISTINCT concat('src/c', c_custkey % 40) AS path, greatest(1, (c_custkey % 97 + 1) - 2 + i) AS line FROM customer, range(0, 27) t(i) WHERE c_custkey % 97 + 1 - 2 + i >= 1), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS k, coalesce(line - lag(line) OVER (PARTITION BY path ORDER BY line) > 1, false) AS gap FROM s) SELECT path, CAST(line AS INTEGER) AS line, gap FROM k WHERE k <= 180")
def code_windows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    marks = table(spark, sf, "customer").select(F.concat(F.lit("src/c"), key % 40).alias("path"), (key % 97 + 1).cast("int").alias("line"))
    return M.code_windows(marks)


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'own' END, CASE WHEN quality IS NOT NULL THEN concat('q', quality) END) AS description FROM documents LEFT JOIN labels USING (doc_id)")
def merge_annotations(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.lit("d").alias("path"), F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 3 == 0, "own").alias("description"))
    given = table(spark, sf, "labels").select(F.lit("d").alias("path"), F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("q"), "quality").alias("description"))
    return M.merge_annotations(docs, given).select("doc_id", "description")


# Evaluation


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as transcript lines: users are tasks, values tokens, event types tools."""
    e = table(spark, sf, "events")
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "error", "Grep").otherwise(F.concat(F.lit("mcp__"), "event_type", F.lit("__run")))
    content = F.array(F.struct(F.lit("tool_use").alias("type"), tool.alias("name"), F.struct(F.concat(F.lit("f"), F.col("event_id") % 7).alias("file_path")).alias("input")))
    tokens = F.floor("value").cast("long")
    usage = F.struct(tokens.alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(2).cast("long").alias("cache_creation_input_tokens"), F.lit(3).cast("long").alias("cache_read_input_tokens"))
    none = F.lit(None)
    return e.select(F.col("user_id").alias("task"), F.col("event_id").alias("line"), F.lit("assistant").alias("type"), none.cast("string").alias("subtype"), F.struct(usage.alias("usage"), content.alias("content")).alias("message"), none.cast(E.USAGE).alias("usage"), none.cast("string").alias("result"), none.cast("double").alias("duration_ms"), none.cast("int").alias("num_turns"), none.cast("double").alias("total_cost_usd"), none.cast("boolean").alias("is_error"), none.cast("string").alias("session_id"))


@query("SELECT user_id AS task, CAST(sum(floor(value) + 5) AS BIGINT) AS input_tokens, count(*) AS output_tokens, count(*) AS tool_calls, count(*) FILTER (event_type = 'view') AS file_reads, count(*) FILTER (event_type = 'click') AS file_edits, count(*) FILTER (event_type IN ('signup', 'purchase')) AS mcp_calls, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id % 7 END) AS files_read FROM events GROUP BY user_id")
def transcript_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.transcript_metrics(_transcripts(spark, sf)).select("task", "input_tokens", "output_tokens", "tool_calls", "file_reads", "file_edits", "mcp_calls", "files_read")


@query("SELECT role, count(*) AS turns, CAST(sum(ceil(octet_length(encode(text)) / 3.7::DOUBLE)) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def transcript_roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(S.token_estimate(F.col("text"))).alias("tokens"))


_CELLS = "SELECT user_id, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY user_id, event_type"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query(f"WITH c AS ({_CELLS}) SELECT a.user_id, 'n' AS metric, CAST(a.n AS DOUBLE) AS before, CAST(b.n AS DOUBLE) AS after, floor((b.n - a.n) / a.n * 100 + 0.5) AS delta FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'")
def paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    return E.paired_deltas(_cells(spark, sf), "user_id", "event_type", "view", "click", ["n"])


@query(f"WITH c AS ({_CELLS}) SELECT user_id, max(CASE WHEN event_type = 'view' THEN n END) AS view, max(CASE WHEN event_type = 'click' THEN n END) AS click, max(CASE WHEN event_type = 'error' THEN n END) AS error FROM c GROUP BY user_id")
def arm_pivot_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.pivot_report(_cells(spark, sf), "user_id", "event_type", "n", ["view", "click", "error"])


@query(f"SELECT event_type, count(*) AS cells, round(avg(n), 6) AS mean_n, CAST(sum(n) AS BIGINT) AS sum_n FROM ({_CELLS}) GROUP BY event_type")
def arm_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.summary(_cells(spark, sf), "event_type", ["n"]).select("event_type", F.col("n").alias("cells"), F.round("mean_n", 6).alias("mean_n"), "sum_n")


@query("SELECT o_custkey, o_orderkey, round(t, 2) AS running_cost, t - o_totalprice < 300000 AS within_cap FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders)")
def running_cost_cap(spark: SparkSession, sf: str) -> DataFrame:
    return E.within_cost(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", 300_000.0).select("o_custkey", "o_orderkey", F.round("running_cost", 2).alias("running_cost"), "within_cap")


@query("SELECT a AS event_type, user_id FROM (VALUES ('view'), ('click'), ('error')) t(a), (SELECT DISTINCT user_id FROM events) u WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = a AND e.value > 40)")
def grid_resume(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    arms = spark.createDataFrame([(a,) for a in E.select_arms(["view", "click", "error", "none"], ["view", "click", "error"])], "event_type string")
    return E.grid(arms, e.select("user_id").distinct(), e.filter("value > 40").select("event_type", "user_id"), ["event_type", "user_id"])


@query("SELECT o_custkey AS diff, count(*) AS blocks FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey")
def diff_block_islands(spark: SparkSession, sf: str) -> DataFrame:
    """A diff for each customer with a file block for each order, every fourth a tool artifact."""
    o = table(spark, sf, "orders")
    path = F.when(F.col("o_orderkey") % 4 == 0, F.lit(".gitignore")).otherwise(F.concat(F.lit("src/o"), "o_orderkey", F.lit(".ts")))
    text = F.array(F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.lit("@@ -1 +1 @@"), F.concat(F.lit("+"), "o_orderkey"))
    rows = o.select(F.col("o_custkey").alias("diff"), "o_orderkey", F.posexplode(text).alias("k", "text")).select("diff", (F.col("o_orderkey") * 3 + F.col("k")).alias("line"), "text")
    return E.filter_diff(rows, "diff").groupBy("diff").agg(F.count("*").alias("blocks"))


@query("SELECT o_custkey AS instance_id, max(o_orderkey) AS line FROM orders GROUP BY o_custkey")
def predictions_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return tree.latest_predictions(table(spark, sf, "orders").select(F.col("o_custkey").alias("instance_id"), F.col("o_orderkey").alias("line")))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 5 AND p_partkey % 6 BETWEEN 1 AND 5 THEN CAST(p_size + p_partkey % 6 AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS total FROM part")
def judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('Sure.\n```json\n{"accuracy": '), F.col("p_size"), F.lit(', "depth": '), F.col("p_partkey") % 6, F.lit(', "notes": "n"}\n```'))
    return E.judge_scores(table(spark, sf, "part").select("p_partkey", raw.alias("raw")), ["accuracy", "depth"]).select("p_partkey", F.coalesce((F.col("score.accuracy") + F.col("score.depth")).cast("long"), F.lit(-1).cast("long")).alias("total"))


@query("SELECT concat('src/p', p_partkey, '.ts') AS path, concat('f', p_size) AS name, p_name AS description, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS danger FROM part")
def annotation_replies(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("src/p"), F.col("p_partkey"), F.lit(".ts::f"), F.col("p_size"))
    plain = F.concat(F.lit('{"'), key, F.lit('": "'), "p_name", F.lit('"}'))
    full = F.concat(F.lit('Here:\n```json\n{"'), key, F.lit('": {"description": "'), "p_name", F.lit('", "danger": "'), "p_type", F.lit('"}}\n```'))
    return E.annotations_of(table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, full).otherwise(plain).alias("raw")))


@query("SELECT CASE WHEN l_returnflag = 'A' THEN 'x' ELSE l_returnflag END AS k, count(*) FILTER (l_quantity > 25) AS passed, count(*) FILTER (l_quantity <= 25) AS failed FROM lineitem GROUP BY 1")
def pass_fail_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "A", "x").otherwise(F.col("l_returnflag")).alias("k"), (F.col("l_quantity") > 25).alias("resolved"))
    return E.pass_fail(rows, "k")


# Further sources and reports


@query("SELECT concat('r', o_custkey % 7) AS log, concat('c', o_custkey) AS author, count(*) AS files FROM orders GROUP BY o_custkey")
def git_log_forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A log for each seventh of the customers: a commit line for each, then its orders as files."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("g"), "o_custkey", "o_orderkey")
    heads = o.select("g", "o_custkey").distinct().select("g", "o_custkey", F.lit(-1).cast("long").alias("o_orderkey"))
    rows = o.unionByName(heads)
    text = F.when(F.col("o_orderkey") < 0, F.concat(F.lit("COMMIT:c"), "o_custkey")).otherwise(F.concat(F.lit("o"), "o_orderkey"))
    lines = rows.select(F.concat(F.lit("r"), "g").alias("log"), (F.col("o_custkey") * 10_000_000 + F.col("o_orderkey") + 1).alias("line"), text.alias("text"))
    return tree.git_log(lines).groupBy("log", "author").agg(F.count("*").alias("files"))


@query("SELECT count(*) FILTER (doc_id % 11 = 0 AND doc_id > 100) AS changed, count(*) AS files, count(*) FILTER (doc_id % 11 = 0 AND doc_id > 100) > 5 AS stale FROM documents")
def index_staleness(spark: SparkSession, sf: str) -> DataFrame:
    files = documents_as_files(spark, sf).select("path", F.col("ord").alias("modified"), "ord")
    return tree.staleness(files.select("path", "modified"), files.filter(F.col("ord") % 11 == 0).select("path"), 100)


@query("SELECT lang AS ext, count(*) AS n, (SELECT least(4000, greatest(800, 800 + 15 * count(*))) FROM documents) AS tokens FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 8")
def plan_report(spark: SparkSession, sf: str) -> DataFrame:
    return P.plan_report(documents_as_files(spark, sf)).select("ext", "n", "tokens")


@query("SELECT source AS layer, count(*) AS files, CAST(sum(ceil(octet_length(encode(coalesce(text, ''))) / 3.7::DOUBLE)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return P.token_statistics(documents_as_files(spark, sf).select(F.col("dir").alias("layer"), F.col("content").alias("text"))).select("layer", "files", "tokens")


@query("""SELECT concat('pkg', p_partkey) AS name, CASE p_partkey % 3 WHEN 0 THEN concat('1.', p_size) WHEN 1 THEN concat('2.', p_size) ELSE concat('3.', p_size) END AS version FROM part""")
def manifest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of each part, with one kind of dependencies, two or three; the later kind counts."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = lambda name, mark: F.concat(F.lit(f'"{name}":{{"pkg'), key, F.lit(f'":"{mark}'), size, F.lit('"}'))
    one, two, three = kind("dependencies", "^1."), kind("devDependencies", "~2."), kind("peerDependencies", ">=3.")
    body = F.when(key % 3 == 0, one).when(key % 3 == 1, F.concat_ws(",", two, kind("dependencies", "~9."))).otherwise(F.concat_ws(",", three, two, kind("dependencies", "8.")))
    return tree.manifest_versions(table(spark, sf, "part").select(F.concat(F.lit("{"), body, F.lit("}")).alias("content")))


@query("SELECT concat('packages/', source, '/', doc_id) AS path, CASE WHEN doc_id % 2 = 0 THEN concat('packages/', source) END AS package FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT concat('misc/', doc_id), NULL FROM documents WHERE doc_id % 2 = 1")
def workspace_packages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    paths = d.select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("packages/"), "source", F.lit("/"), "doc_id")).otherwise(F.concat(F.lit("misc/"), "doc_id")).alias("path"))
    return tree.workspace_of(paths, ["packages/*"])


@query("SELECT name, source, description, category FROM (SELECT concat('VAR_', n_nationkey, '_URL') AS name, '.env.example' AS source, concat('about ', n_nationkey) AS description, 'api' AS category FROM nation)")
def env_example_comments(spark: SparkSession, sf: str) -> DataFrame:
    """One example file that lists a variable for each nation, each under a comment."""
    line = F.concat(F.lit("# about "), "n_nationkey", F.lit("\nVAR_"), "n_nationkey", F.lit("_URL=x\n"))
    text = table(spark, sf, "nation").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    files = text.select(F.lit(".env.example").alias("path"), F.lit(".example").alias("ext"), "content")
    return X.env_vars(files).select("name", "source", "description", "category")


@query("SELECT concat('Repo', s_suppkey, '.find') AS name, 'method' AS kind, concat('find(key: int) -> N', s_nationkey) AS signature FROM supplier UNION ALL SELECT concat('Repo', s_suppkey), 'class', concat('Repo', s_suppkey, '(Base)') FROM supplier UNION ALL SELECT concat('run', s_suppkey), 'function', concat('run', s_suppkey, '(x)') FROM supplier")
def synth_python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.concat(F.lit("class Repo"), k, F.lit("(Base):\n    def find(self, key: int) -> N"), n, F.lit(":\n        pass\n    def _hide(self):\n        pass\n\ndef run"), k, F.lit("(x):\n    pass\n"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("py/s"), k, F.lit(".py")).alias("path"), F.lit(".py").alias("ext"), text.alias("content"))
    return X.symbols(files).select("name", "kind", "signature")


@query("SELECT concat('Store', s_suppkey, '.read') AS name, concat('read(key: N', s_nationkey, '): string') AS signature FROM supplier")
def synth_class_methods(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.concat(F.lit("export class Store"), k, F.lit(" {\n  read(key: N"), n, F.lit("): string {\n    if (key) {\n    }\n    return key;\n  }\n  private hide(): void {\n  }\n}\n"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("ts/s"), k, F.lit(".ts")).alias("path"), F.lit(".ts").alias("ext"), text.alias("content"))
    return X.symbols(files).filter("kind = 'method'").select("name", "signature")


@query("SELECT concat('/c/', c_custkey % 50) AS path, CASE WHEN c_custkey % 50 % 10 = 0 THEN concat('  GET,POST /c/', c_custkey % 50, ' [required, body:CustomerSchema, requireAuth]') ELSE concat('  GET /c/', c_custkey % 50) END AS text FROM customer GROUP BY c_custkey % 50")
def route_lines(spark: SparkSession, sf: str) -> DataFrame:
    return P.route_lines(RT.group_routes(RT.routes(sources(spark, sf))))


@query("""SELECT dir, keyword FROM (SELECT 'src/customer' AS dir, unnest(['customer', concat('c', c_custkey), concat('f', c_custkey)]) AS keyword FROM customer WHERE true)
WHERE length(keyword) > 3 OR starts_with(keyword, 'c') GROUP BY dir, keyword
UNION SELECT 'src/supplier', k FROM (SELECT unnest(['supplier', concat('s', s_suppkey), concat('g', s_suppkey)]) AS k FROM supplier) WHERE length(k) > 3 OR starts_with(k, 's')
UNION SELECT 'src/nation', unnest(['nation', concat('n', n_nationkey)]) FROM nation UNION SELECT concat('src/region/r', r_regionkey), unnest(['region', 'other']) FROM region""")
def synth_module_keywords(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    return R.module_keywords(files, materialize(X.symbols(files), "symbols"))


@query(f"SELECT regexp_extract(path, '^(.*)/', 1) AS dir, count(*) AS files, floor(avg(score) * 10 + 0.5) / 10 AS complexity FROM ({_SQL['synth_complexity']}) GROUP BY 1")
def synth_modules(spark: SparkSession, sf: str) -> DataFrame:
    files = sources(spark, sf)
    used, declared = materialize(X.imports(files), "imports"), materialize(X.symbols(files), "symbols")
    fan_in = G.ref_counts(files.select(F.col("path").alias("id")), X.import_edges(X.resolve_imports(files, used))).select(F.col("id").alias("path"), F.col("refs").alias("fan_in"))
    cx = X.complexity(files, fan_in, declared.groupBy("path").agg(F.count("*").alias("symbol_count")), used)
    return R.modules(files, R.module_keywords(files, declared), cx).select("dir", F.col("n_files").alias("files"), "complexity")


@query("SELECT grp, count(*) AS n FROM (SELECT concat('src/', c_mktsegment) AS grp, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY concat('n', c_nationkey)) AS f FROM customer) WHERE k <= 4 AND f <= 6 GROUP BY grp")
def overview_groups(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    rows = c.select(F.concat(F.lit("src/"), "c_mktsegment", F.lit("/n"), "c_nationkey").alias("path"), F.col("c_custkey").alias("line"), F.col("c_name").alias("name"))
    return P.overview_groups(rows).groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT concat('f', o_custkey) AS caller, concat('g', o_orderkey) AS callee, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT caller AS id, count(*) AS callees FROM t WHERE k <= 5 GROUP BY caller""")
def call_trace_capped(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "orders").select(F.concat(F.lit("f"), "o_custkey").alias("caller"), F.concat(F.lit("g"), "o_orderkey").alias("callee"), F.col("o_orderkey").alias("pos"))
    return G.call_trace(calls, calls.select(F.col("caller").alias("id")).distinct()).groupBy("id").agg(F.count("*").alias("callees"))


@query("""WITH r AS (SELECT concat('V', n_nationkey + 1, '_TOKEN') AS name, row_number() OVER (ORDER BY concat('V', n_nationkey + 1, '_TOKEN')) AS k, count(*) OVER () AS n FROM nation)
SELECT 'auth' AS category, concat(string_agg(name, ', ' ORDER BY name) FILTER (k <= 3), ' +', max(n) - 3, ' more') AS text FROM r""")
def required_variables(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("V"), F.col("n_nationkey") + 1, F.lit("_TOKEN")).alias("name"))
    return P.required_variables(n.select("name", F.lit(False).alias("has_default"), F.lit(True).alias("required"), S.env_category(F.col("name")).alias("category")))


@query()
def danger_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes made from parts against a request; tested on a fixture."""
    notes = table(spark, sf, "part").repartition(file_tasks(spark), "p_partkey").select(F.concat(F.lit("src/size"), "p_size", F.lit("/part"), "p_partkey", F.lit(".ts")).alias("file"), F.concat(F.lit("make"), "p_partkey").alias("symbol"), F.concat("p_name", F.lit(" requires the "), F.lower("p_type"), F.lit(" handling")).alias("danger"))
    return P.danger_hits(notes, R.terms_of(spark, "why does the economy handling of make12 fail", "bm25"))
