"""The whole index of a tree in one call, as named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import extract as X
from lodestone.operators import graph as G
from lodestone.operators import matching as M
from lodestone.operators import models as D
from lodestone.operators import retrieval as R
from lodestone.operators import routes as RT
from lodestone.plans.state import materialize
from lodestone.sources import bundle
from lodestone.sources.tree import without_sensitive


def build_index(files: DataFrame, manifests: DataFrame | None = None, gate_by_stack: bool = False) -> dict[str, DataFrame]:
    """files (path, ext, content): symbols, imports, edges, ranks, complexity, tests, packages, routes, models, variables, keywords, modules, contracts. Symbols and imports are written to the shared folder, as most others read them.

    files may be rows of read_tree, with an error where content couldn't be read: these are the table unreadable, and the index holds all others.

    gate_by_stack: routes only where a server framework or language is there, models only where an ORM is."""
    from lodestone.sources.tree import manifest_versions, split_unreadable, stack_of

    unreadable = files.select("path", F.lit("").alias("error")).limit(0)
    if "error" in files.columns:
        files, unreadable = split_unreadable(files)
    files = without_sensitive(files)
    symbols, used = materialize(X.symbols(files), "symbols"), materialize(X.imports(files), "imports")
    resolved = materialize(X.resolve_imports(files, used), "resolved")
    edges, nodes = X.import_edges(resolved), files.select(F.col("path").alias("id"))
    ranks, refs = G.page_rank(nodes, edges), G.ref_counts(nodes, edges)
    counts = symbols.groupBy("path").agg(F.count("*").alias("symbol_count"))
    complexity = X.complexity(files, refs.select(F.col("id").alias("path"), F.col("refs").alias("fan_in")), counts, used)
    versions = manifest_versions(manifests) if manifests is not None else None
    keywords = R.module_keywords(files, symbols)
    routes, models = RT.routes(files), D.models(files)
    if gate_by_stack and versions is not None:
        # At most one row for each language and each entry of the fixed table. Server languages bring frameworks of their own.
        stack = {(r["kind"], r["value"]) for r in stack_of(files, versions).collect()}
        kinds = {k for k, _ in stack} | {"server" for k, v in stack if k == "language" and v not in ("typescript", "javascript")}
        routes = routes if kinds & {"framework", "server"} else routes.limit(0)
        models = models if kinds & {"orm", "server"} else models.limit(0)
    names = X.test_names(files)
    return {
        "files": files, "symbols": symbols, "imports": used, "edges": edges, "symbol_refs": X.symbol_refs(resolved), "ranks": ranks, "refs": refs, "complexity": complexity,
        "tests": M.test_mapping(files.select("path"), names), "assertions": X.test_assertions(files), "packages": X.packages(used, versions), "routes": routes, "models": models,
        "env_vars": X.env_vars(files), "keywords": keywords, "idf": R.idf(keywords), "modules": R.modules(files, keywords, complexity), "contracts": R.module_contracts(files, edges),
        "conventions": M.conventions(files, symbols, used), "unreadable": unreadable,
    }


def publish_index(index: dict[str, DataFrame], root: str, tables: list[str] | None = None) -> int:
    """Publish the tables of an index, or some of them, as the next version below root: all at once, see bundle. The version's number is given back; read_index reads the newest."""
    spark = index["files"].sparkSession
    return bundle.publish(spark, {name: index[name] for name in tables or index}, root)


def read_index(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    return bundle.open_bundle(spark, root, version)


def register(index: dict[str, DataFrame], prefix: str = "") -> None:
    """The tables of an index as temporary views, for SQL."""
    for name, df in index.items():
        df.createOrReplaceTempView(prefix + name)


class Tools:
    """The nine questions that an index answers, each as a DataFrame."""

    def __init__(self, index: dict[str, DataFrame]):
        self.index = index

    def context(self, query: str, budget: int = 12_000) -> DataFrame:
        spark = self.index["files"].sparkSession
        hits = R.context_hits(self.index["keywords"], R.terms_of(spark, query, "context"))
        ranked = hits.join(self.index["modules"], "dir").withColumn("size", F.length(F.concat_ws(",", "files")).cast("long"))
        picked = R.pack_ranked(ranked, [-F.col("hits"), -F.col("complexity"), F.col("dir")], "dir", "size", budget)
        sized = picked.join(ranked.select("dir", "size"), "dir")
        return sized.select("dir", F.max(F.col("used_before") + F.col("size")).over(Window.partitionBy()).alias("used"))

    def env_audit(self) -> DataFrame:
        return self.index["env_vars"].join(M.env_consumers(self.index["files"], self.index["env_vars"]), "name")

    def issue_candidates(self, text: str) -> DataFrame:
        spark = self.index["files"].sparkSession
        return R.issue_candidates(self.index["symbols"], self.index["files"], R.terms_of(spark, text, "issue")).join(self.index["refs"].withColumnRenamed("id", "path"), "path", "left")

    def symbol(self, name: str) -> DataFrame:
        return M.look_up_symbol(self.index["symbols"], self.index["symbol_refs"], self.index["ranks"], name)

    def routes(self, method: str | None = None, path: str | None = None) -> DataFrame:
        return RT.filter_routes(self.index["routes"], method, path)

    def schema(self, model: str | None = None) -> DataFrame:
        return D.look_up(self.index["models"], model)

    def find_usages(self, name: str) -> DataFrame:
        return M.usages(self.index["files"], self.index["symbols"], self.index["symbol_refs"], name)

    def blast_radius(self, file: str) -> dict[str, DataFrame]:
        start = self.index["files"].sparkSession.createDataFrame([(file,)], "id string")
        return M.blast_radius(self.index["edges"], start, self.index["ranks"], self.index["routes"], self.index["models"])

    def test_map(self, file: str | None = None) -> DataFrame:
        return M.look_up_tests(self.index["tests"], file)
