"""Column contracts over the driver's tables: files, edges, modules and transcripts, and source text made from table rows.

The synthetic sources are one SQL expression that Spark and the oracle both run, so extractors meet real code at any scale and
what they find can be told from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_tasks(spark: SparkSession) -> int:
    """Into how many tasks, three a core, rows are dealt by their key before each becomes a file: a million short rows are one row group of a table, which one task would read and scan."""
    return 3 * spark.sparkContext.defaultParallelism


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, dir, ext, content, size_bytes, ord) of documents: the source is the directory, the language the extension."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("source").alias("dir"), F.col("lang").alias("ext"), F.coalesce("text", F.lit("")).alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"), F.col("doc_id").alias("ord"))


_s = lambda x: f"CAST({x} AS STRING)"

#: Source files of customers, suppliers, nations and regions, with tests for every fifth customer.
SOURCES_SQL = f"""
SELECT concat('src/customer/c', {_s("c_custkey")}, '.ts') AS path, '.ts' AS ext, concat(
  'import {{ n', {_s("c_nationkey")}, ' }} from "../nation/n', {_s("c_nationkey")}, '";', {NL},
  CASE WHEN c_custkey % 4 = 0 THEN concat('import {{ z, y as w }} from "@scope', {_s("c_custkey % 7")}, '/lib/deep";', {NL}) ELSE concat('import lodash from "pkg', {_s("c_custkey % 11")}, '";', {NL}) END,
  'export function f', {_s("c_custkey")}, '(id: number): string {{', {NL},
  CASE WHEN c_custkey % 3 = 0 THEN concat('  if (id > ', {_s("c_nationkey")}, ') {{ return n', {_s("c_nationkey")}, '(id); }}', {NL}) ELSE '' END,
  CASE WHEN c_custkey % 6 = 0 THEN concat('  else if (id) {{ throw new CaseError(id); }}', {NL}) ELSE '' END,
  '  const key = process.env.', c_mktsegment, '_TOKEN;', {NL}, '  return key;', {NL}, '}}', {NL},
  'router.get("/c/', {_s("c_custkey % 50")}, '", f', {_s("c_custkey")}, ');', {NL},
  CASE WHEN c_custkey % 10 = 0 THEN concat('router.post("/c/', {_s("c_custkey % 50")}, '", requireAuth, validateBody(CustomerSchema));', {NL}) ELSE '' END) AS content
FROM customer
UNION ALL
SELECT concat('src/customer/c', {_s("c_custkey")}, '.test.ts'), '.ts', concat('it("handles ', {_s("c_custkey")}, '", () => {{', {NL}, '  expect(f', {_s("c_custkey")}, '(1)).toBe("x");', {NL}, '}});', {NL})
FROM customer WHERE c_custkey % 5 = 0
UNION ALL
SELECT concat('src/supplier/s', {_s("s_suppkey")}, '.ts'), '.ts', concat('const {{ n', {_s("s_nationkey")}, ' }} = require("../nation/n', {_s("s_nationkey")}, '");', {NL}, 'export const g', {_s("s_suppkey")}, ' = (id: number) => n', {_s("s_nationkey")}, '(id);', {NL})
FROM supplier
UNION ALL
SELECT concat('src/nation/n', {_s("n_nationkey")}, '.ts'), '.ts', concat('import {{ r', {_s("n_regionkey")}, ', other }} from "../region/r', {_s("n_regionkey")}, '";', {NL}, '// nation number ', {_s("n_nationkey")}, {NL}, 'export function n', {_s("n_nationkey")}, '(id: number): string {{', {NL}, '  return r', {_s("n_regionkey")}, '(id);', {NL}, '}}', {NL})
FROM nation
UNION ALL
SELECT concat('src/region/r', {_s("r_regionkey")}, '/index.ts'), '.ts', concat('export const r', {_s("r_regionkey")}, ' = (id: number) => id;', {NL}, 'export const other = 1;', {NL})
FROM region
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, ext, content) made from the tables."""
    sql = SOURCES_SQL
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", None), ("region", None)):
        rows = f"parquet.`{sf_dir}/{name}.parquet`"
        rows = f"(SELECT /*+ REPARTITION({file_tasks(spark)}, {key}) */ * FROM {rows})" if key else rows
        sql = sql.replace(f"FROM {name}\n", f"FROM {rows}\n").replace(f"FROM {name} ", f"FROM {rows} ")
    return spark.sql(sql)


#: Edges (src, dst, weight) from each order, customer, supplier and nation to what it belongs to.
EDGES_SQL = f"""
SELECT concat('o', {_s("o_orderkey")}) AS src, concat('c', {_s("o_custkey")}) AS dst, 1 AS weight FROM orders
UNION ALL SELECT concat('c', {_s("c_custkey")}), concat('n', {_s("c_nationkey")}), 1 FROM customer
UNION ALL SELECT concat('s', {_s("s_suppkey")}), concat('n', {_s("s_nationkey")}), 1 FROM supplier
UNION ALL SELECT concat('n', {_s("n_nationkey")}), concat('r', {_s("n_regionkey")}), 1 FROM nation
"""
NODES_SQL = f"""
SELECT concat('o', {_s("o_orderkey")}) AS id FROM orders UNION ALL SELECT concat('c', {_s("c_custkey")}) FROM customer UNION ALL SELECT concat('s', {_s("s_suppkey")}) FROM supplier
UNION ALL SELECT concat('n', {_s("n_nationkey")}) FROM nation UNION ALL SELECT concat('r', {_s("r_regionkey")}) FROM region
"""


def foreign_key_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the foreign keys."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    parts = (("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"))
    edges = nodes = None
    for name, a, src, b, dst in parts:
        t = table(spark, sf_dir, name)
        e, n = t.select(key(a, src).alias("src"), key(b, dst).alias("dst"), F.lit(1).cast("long").alias("weight")), t.select(key(a, src).alias("id"))
        edges, nodes = (e, n) if edges is None else (edges.unionByName(e), nodes.unionByName(n))
    return nodes.unionByName(table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"))), edges
