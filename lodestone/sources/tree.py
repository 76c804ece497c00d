"""Sources: file trees, ignore files, manifests, version-control lists, tables of text, transcripts; and the index cache."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.scalars import hash16, is_sensitive
from lodestone.plans.state import materialize
from lodestone.sources.tree_source import _store, read_tree


def scan_files(spark: SparkSession, root: str, ignore: list[str] | None = None, most_bytes: int = rules.MOST_FILE_BYTES) -> DataFrame:
    """(path, ext, size_bytes, modified, content) of a tree's source files that can be read: known extensions, no skipped or dot directories, nothing ignored or beyond the size. What is left out is never opened; see tree_source."""
    return read_tree(spark, root, ignore, most_bytes).filter("error IS NULL").drop("error")


def split_unreadable(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files of read_tree that were read, and (path, error) of what could not be. One pass over the tree gives both."""
    kept = materialize(scanned, "scanned-tree")
    return kept.filter("error IS NULL").drop("error"), kept.filter("error IS NOT NULL").select("path", "error")


def write_files(files: DataFrame, root: str) -> int:
    """Write each row (path, content) as a file below root, each under another name first and then renamed, so a repeated task leaves whole files; the number of files written."""
    def run(batches):
        import uuid

        import pyarrow as pa

        store, base = _store(root)
        for batch in batches:
            n = 0
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"the path leaves the folder: {path}")
                folder, _, name = f"{base.rstrip('/')}/{path}".rpartition("/")
                store.create_dir(folder, recursive=True)
                staged = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(staged) as out:
                    out.write((content or "").encode("utf-8", "surrogatepass"))
                store.move(staged, f"{folder}/{name}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def without_sensitive(files: DataFrame) -> DataFrame:
    return files.filter(~is_sensitive(F.col("path")))


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Lines of an ignore file, without blanks and comments."""
    return [r.value for r in spark.read.text(path).select(F.trim("value").alias("value")).filter("value != '' AND NOT startswith(value, '#')").collect()]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path meets a pattern: dir/ as a prefix, *suffix, an inner * as any text, or the exact path or a parent of it."""

    def one(p: str) -> Column:
        if p.endswith("/"):
            return path.startswith(p)
        if p.startswith("*"):
            return path.endswith(p[1:])
        if "*" in p:
            return path.rlike("^" + ".*".join(re.escape(x) for x in p.split("*")) + "$")
        return (path == p) | path.startswith(p + "/")

    return reduce(or_, [one(p) for p in patterns], F.lit(False))


def roll_up(files: DataFrame) -> DataFrame:
    """(ext, n, bytes) by extension."""
    return files.groupBy("ext").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def cache_diff(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, hash, state): hit, miss or prune, by path and content hash. current: (path, content); cached: (path, hash)."""
    now = current.select("path", hash16(F.col("content")).alias("hash"))
    both = now.join(cached.select("path", F.col("hash").alias("old")), "path", "full_outer")
    state = F.when(F.col("hash").isNull(), "prune").when(F.col("hash") == F.col("old"), "hit").otherwise("miss")
    return both.select("path", F.coalesce("hash", "old").alias("hash"), state.alias("state"))


def update_index(spark: SparkSession, files: DataFrame, index_path: str, out_path: str, extract) -> dict[str, int]:
    """Write a new index version: hits are taken over, misses extracted, others pruned. extract(files) gives the rows (path, ...) of the files passed in."""
    cached = spark.read.parquet(index_path)
    state = cache_diff(files, cached.select("path", "hash").distinct())
    new = extract(files.join(state.filter("state = 'miss'").select("path"), "path", "left_semi")).join(state.select("path", "hash"), "path")
    kept = cached.join(state.filter("state = 'hit'").select("path"), "path", "left_semi")
    kept.unionByName(new.select(*kept.columns)).write.mode("overwrite").parquet(out_path)
    return {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fill_forward(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the last known value at or before each in the order of its key, null before the first.

    Rows are dealt by ranges of (key, order), so one key spreads over many tasks. The last value of each range, a row for each key and range, is carried on to the ranges after it; within a range a window fills. Rows of one key and order are taken in order of the value, nulls last."""
    columns = rows.columns
    dealt = rows.withColumn("_v", value).repartitionByRange(F.col(key), F.col(order), F.asc_nulls_last("_v")).sortWithinPartitions(key, order, F.asc_nulls_last("_v"))
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))
    by = Window.partitionBy(key).orderBy("_part")
    ends = placed.groupBy(key, "_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_end"))
    carried = ends.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.last("_end", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy(key, "_part").orderBy("_at"))
    filled = placed.withColumn("_own", own).join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    return filled.select(*[c for c in columns if c != name], F.coalesce("_own", "_before").alias(name))


def git_log(lines: DataFrame) -> DataFrame:
    """(log, author, file) from logs whose commits start with COMMIT:author; the lines after it are files. lines: (log, line, text); log tells repositories apart."""
    head = F.when(F.col("text").startswith("COMMIT:"), F.substr("text", F.lit(8)))
    filled = fill_forward(lines.select("log", "line", "text"), "log", "line", head, "author")
    return filled.filter(~F.col("text").startswith("COMMIT:") & (F.trim("text") != "")).select("log", "author", F.trim("text").alias("file"))


def git_signals(commits: DataFrame) -> DataFrame:
    """(file, commits, minor_authors): authors with under 5 % of a file's commits are minor."""
    each = commits.groupBy("file", "author").agg(F.count("*").alias("n"))
    whole = commits.groupBy("file").agg(F.count("*").alias("commits"))
    return each.join(whole, "file").groupBy("file", "commits").agg(F.count_if(F.col("n") < 0.05 * F.col("commits")).alias("minor_authors"))


def staleness(files: DataFrame, changed: DataFrame, index_time, most: int = 5, share: float = 0.1) -> DataFrame:
    """One row: changed files newer than the index, all files, and whether the index is stale (more than 5 files, or a tenth). files: (path, modified); changed: (path)."""
    newer = files.join(changed.select("path").distinct(), "path", "left_semi").filter(F.col("modified") > F.lit(index_time)).agg(F.count("*").alias("changed"))
    return newer.crossJoin(files.agg(F.count("*").alias("files"))).withColumn("stale", (F.col("changed") > most) | (F.col("changed") > share * F.col("files")))


def read_tasks(spark: SparkSession, path: str, languages: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Evaluation tasks from a CSV with quoted fields; five columns must be there, short rows are dropped."""
    need = ["instance_id", "repo", "base_commit", "problem_statement", "language"]
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if missing := [c for c in need if c not in rows.columns]:
        raise ValueError(f"the task file lacks {', '.join(missing)}")
    rows = rows.select(*need).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in need]))
    if languages:
        rows = rows.filter(F.lower("language").isin([x.lower() for x in languages]))
    return rows.limit(most) if most is not None else rows


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a transcript, one JSON object a line; bad lines are dropped."""
    rows = spark.read.schema(f"{schema.removeprefix('struct<').removesuffix('>')},_bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad IS NULL").drop("_bad").withColumn("line", F.monotonically_increasing_id())


def latest_predictions(rows: DataFrame) -> DataFrame:
    """The last row of each instance. rows: (instance_id, line, ...)."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("line")))).filter("k = 1").drop("k")


def append_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def manifest_versions(manifests: DataFrame) -> DataFrame:
    """(name, version) of package.json texts (content): dependencies, devDependencies, peerDependencies, the later over the earlier, range marks stripped."""
    kinds = ("dependencies", "devDependencies", "peerDependencies")
    each = [manifests.select(F.lit(k).alias("k"), F.explode(F.from_json(F.get_json_object("content", f"$.{kind}"), "map<string,string>")).alias("name", "version")) for k, kind in enumerate(kinds)]
    rows = reduce(DataFrame.unionByName, each)
    return rows.groupBy("name").agg(F.max_by(F.regexp_replace("version", r"^[\^~>=<]+", ""), "k").alias("version"))


def scripts_of(manifests: DataFrame) -> DataFrame:
    """(slot, command) of a package.json: the first script that fills each of the usual slots."""
    wanted = {"dev": ("dev", "serve", "start"), "build": ("build", "compile"), "test": ("test",), "lint": ("lint",), "typecheck": ("typecheck", "type-check", "tsc"), "format": ("format", "prettier")}
    found = manifests.select(F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>").alias("s"))
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.coalesce(*[F.get(F.array(F.col("s")[n]), F.lit(0)) for n in names]).alias("command")) for k, names in wanted.items()])
    return found.select(F.explode(slots).alias("x")).select("x.*").filter("command IS NOT NULL")


#: Slots of commands and the scripts of a package.json that fill them, in order; names that are no further commands.
SCRIPT_SLOTS = {"build": ("build",), "dev": ("dev", "serve"), "test": ("test", "test:unit"), "lint": ("lint", "lint:fix"), "start": ("start",), "deploy": ("deploy", "release")}
KNOWN_SCRIPTS = ("build", "dev", "test", "lint", "start", "deploy", "serve", "postinstall", "prepare", "precommit")
MAKE_SLOTS = ("build", "test", "dev", "lint", "deploy")
#: What a manifest's being there gives, in order of the manifests.
MANIFEST_COMMANDS = (("go.mod", "build", "go build ./..."), ("go.mod", "test", "go test ./..."), ("Cargo.toml", "build", "cargo build"), ("Cargo.toml", "test", "cargo test"), ("pyproject.toml", "test", "pytest"))
OTHER_NAME = 20


def project_scripts(files: DataFrame) -> DataFrame:
    """(project, slot, name, command) of projects: how each is built, run, tested and so on. files: (project, path, content), paths from the project's root.

    A slot takes the first of package.json, Makefile, go.mod, Cargo.toml and pyproject.toml that fills it; an empty command fills nothing. Further scripts of package.json with short names are slots named other. Broken manifests count as empty ones."""
    named = lambda n: files.filter(F.col("path") == n)
    listed = named("package.json").select("project", F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>").alias("s")).filter("s IS NOT NULL")
    filled = F.array(*[F.struct(F.lit(slot).alias("slot"), F.coalesce(*[F.nullif(F.get(F.array(F.col("s")[n]), F.lit(0)), F.lit("")) for n in names]).alias("command")) for slot, names in SCRIPT_SLOTS.items()])
    package = listed.select("project", F.explode(filled).alias("x")).select("project", "x.slot", F.lit(0).alias("rank"), "x.command").filter("command IS NOT NULL")
    targets = named("Makefile").select("project", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^(\w[\w-]*)\s*:"), F.lit(1)))).alias("slot"))
    make = targets.filter(F.col("slot").isin(*MAKE_SLOTS)).select("project", "slot", F.lit(1).alias("rank"), F.concat(F.lit("make "), "slot").alias("command"))
    given = F.array(*[F.struct(F.lit(m).alias("path"), F.lit(slot).alias("slot"), F.lit(2 + k).alias("rank"), F.lit(c).alias("command")) for k, (m, slot, c) in enumerate(MANIFEST_COMMANDS)])
    there = files.filter(F.col("path").isin(*{m for m, _, _ in MANIFEST_COMMANDS})).select("project", F.explode(F.filter(given, lambda g: g["path"] == F.col("path"))).alias("x")).select("project", "x.slot", "x.rank", "x.command")
    slots = package.unionByName(make).unionByName(there).groupBy("project", "slot").agg(F.min_by("command", "rank").alias("command"))
    other = listed.select("project", F.explode("s").alias("name", "command")).filter(~F.col("name").isin(*KNOWN_SCRIPTS) & (F.length("name") < OTHER_NAME) & F.col("command").isNotNull())
    return slots.select("project", "slot", F.col("slot").alias("name"), "command").unionByName(other.select("project", F.lit("other").alias("slot"), "name", "command"))


def stack_of(files: DataFrame, versions: DataFrame) -> DataFrame:
    """(kind, value): languages by extension; frameworks, ORM and test framework by dependency, the first of each kind's list. Next.js is shown by its display name here; detect_stack gives the plain one."""
    languages = files.select(F.lit("language").alias("kind"), F.create_map(*[F.lit(x) for kv in rules.EXTENSION_LANGUAGE.items() for x in kv])[F.col("ext")].alias("value")).filter("value IS NOT NULL").distinct()
    table = [(kind, name, "Next.js" if value == "next.js" else value, k) for k, (kind, names, value) in enumerate(rules.STACK_DEPENDENCIES) for name in names]
    known = files.sparkSession.createDataFrame(table, "kind string, name string, value string, priority int")
    hit = versions.select("name").join(F.broadcast(known), "name")  # the fixed table above
    single = hit.filter("kind != 'framework'").groupBy("kind").agg(F.min_by("value", "priority").alias("value"))
    return languages.unionByName(hit.filter("kind = 'framework'").select("kind", "value").distinct()).unionByName(single)


def detect_stack(files: DataFrame) -> DataFrame:
    """(kind, value, pos) of the project whose files (path, content) are given, paths from its root: language, framework, package_manager, orm, test and entry, in order.

    One pass keeps a few texts and flags, whatever the size of the tree; no manifest, no row. A broken or null manifest counts as an empty one."""
    path = F.col("path")
    names = sorted({f for f, _ in (*rules.LOCK_FILES, *rules.LANGUAGE_MANIFESTS)} | {"main.go", "src/main.rs", "src/lib.rs"})
    text = lambda p: F.coalesce(F.max(F.when(path == p, F.col("content"))), F.lit(""))
    under = lambda d: F.coalesce(F.bool_or(path.startswith(d + "/")), F.lit(False))
    seen = files.agg(F.collect_set(F.when(path.isin(*names), path)).alias("there"), text("package.json").alias("package"), text("pyproject.toml").alias("pyproject"), text("go.mod").alias("gomod"), under("src/app").alias("src_app"), under("app").alias("app"), under("cmd").alias("cmd"))
    has = lambda *p: reduce(or_, [F.array_contains("there", x) for x in p])
    keys = lambda field: F.coalesce(F.map_keys(F.from_json(F.get_json_object("package", f"$.{field}"), "map<string,string>")), F.array().cast("array<string>"))
    deps = F.array_union(keys("dependencies"), keys("devDependencies"))
    needs = lambda names_: has("package.json") & reduce(or_, [F.array_contains(deps, n) for n in names_])
    words = {"pyproject.toml": F.col("pyproject"), "go.mod": F.col("gomod")}
    one = lambda kind, value, when: F.when(when, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    first = lambda kind, choices: one(kind, F.coalesce(*[F.when(c, v) for v, c in choices]), reduce(or_, [c for _, c in choices]))
    kinds = lambda kind: [(F.lit(v), needs(n)) for k, n, v in rules.STACK_DEPENDENCIES if k == kind]
    said = lambda kind: [(F.lit(v), words[f].contains(w)) for f, w, k, v in rules.STACK_WORDS if k == kind]
    languages = list(dict.fromkeys(x for _, ls in rules.LANGUAGE_MANIFESTS for x in ls))
    found = [one("language", F.lit(x), has(*[f for f, ls in rules.LANGUAGE_MANIFESTS if x in ls])) for x in languages]
    found += [one("framework", v, c) for v, c in kinds("framework") + said("framework")]
    found.append(one("package_manager", F.coalesce(*[F.when(has(f), m) for f, m in rules.LOCK_FILES], F.lit("npm")), has("package.json")))
    # What a Python manifest names goes before the dependencies of a script project.
    found += [first(kind, said(kind) + kinds(kind)) for kind in ("orm", "test")]
    main = F.get_json_object("package", "$.main")
    found.append(one("entry", F.when(F.col("src_app"), "src/app/layout.tsx").when(F.col("app"), "app/layout.tsx").otherwise("pages/index.tsx"), needs(("next",))))
    found.append(one("entry", main, has("package.json") & (F.coalesce(main, F.lit("")) != "")))
    found.append(one("entry", F.when(has("main.go"), "main.go").otherwise("cmd/"), has("go.mod") & (has("main.go") | F.col("cmd"))))
    found.append(one("entry", F.when(has("src/main.rs"), "src/main.rs").otherwise("src/lib.rs"), has("Cargo.toml") & has("src/main.rs", "src/lib.rs")))
    return seen.select(F.posexplode(F.array_compact(F.array(*found))).alias("pos", "x")).select("x.kind", "x.value", "pos")


def installed_versions(declared: DataFrame, installed: DataFrame) -> DataFrame:
    """(name, version): the installed version of each package where it is known, else the declared one. Both: (name, version)."""
    own = installed.select("name", F.col("version").alias("found"))
    return declared.join(own, "name", "full_outer").select("name", F.coalesce("found", "version").alias("version"))


def monorepo_of(manifests: DataFrame) -> DataFrame:
    """(kind, globs): the first kind of workspace that manifests (path, content) at the root declare, and the globs of its packages."""
    name, text = F.col("path"), F.col("content")
    listed = lambda c, pattern: F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x != "")
    array = F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("content", "$.workspaces.packages"), "array<string>"))
    block = lambda pattern: F.regexp_extract(text, pattern, 1)
    found = (
        F.when((name == "package.json") & array.isNotNull(), F.struct(F.lit(0).alias("k"), F.lit("npm").alias("kind"), array.alias("globs")))
        .when(name == "pnpm-workspace.yaml", F.struct(F.lit(1).alias("k"), F.lit("pnpm").alias("kind"), listed(text, r"(?m)^\s*-\s*['\"]?([^'\"\n#!]+?)['\"]?\s*$").alias("globs")))
        .when(name == "turbo.json", F.struct(F.lit(2).alias("k"), F.lit("turbo").alias("kind"), F.array(F.lit("apps/*"), F.lit("packages/*")).alias("globs")))
        .when(name == "go.work", F.struct(F.lit(3).alias("k"), F.lit("go").alias("kind"), listed(block(r"use\s*\(([\s\S]*?)\)"), r"(?m)^\s*(?:\./)?(\S+)\s*$").alias("globs")))
        .when(name == "lerna.json", F.struct(F.lit(4).alias("k"), F.lit("lerna").alias("kind"), F.coalesce(F.from_json(F.get_json_object("content", "$.packages"), "array<string>"), F.array(F.lit("packages/*"))).alias("globs")))
        .when(name == "nx.json", F.struct(F.lit(5).alias("k"), F.lit("nx").alias("kind"), F.array(F.lit("apps/*"), F.lit("libs/*"), F.lit("packages/*")).alias("globs")))
        .when((name == "Cargo.toml") & text.contains("[workspace]"), F.struct(F.lit(6).alias("k"), F.lit("cargo").alias("kind"), listed(block(r"members\s*=\s*\[([\s\S]*?)\]"), r"\"([^\"]+)\"").alias("globs")))
    )
    return manifests.select(found.alias("f")).filter("f IS NOT NULL").agg(F.min_by("f", "f.k").alias("f")).filter("f IS NOT NULL").select("f.kind", "f.globs")


def workspace_of(paths: DataFrame, globs: list[str]) -> DataFrame:
    """(path, package): the workspace package of each path, by globs of package directories; the longest that fits."""
    spots = [re.escape(g.rstrip("/")).replace(r"\*\*", ".+").replace(r"\*", "[^/]+") for g in globs]
    fit = F.array(*[F.regexp_extract("path", f"^({s})/", 1) for s in spots]) if spots else F.array(F.lit(""))
    best = F.reduce(fit, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return paths.select("path", F.nullif(best, F.lit("")).alias("package"))


def mentions(files: DataFrame, word: str) -> Column:
    """Whether any of the files holds a word, whatever the case; an aggregate."""
    return F.bool_or(F.col("content").rlike(f"(?i){re.escape(word)}"))


def write_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def splice_block(text: str | None, block: str, start: str, end: str) -> str:
    """A text with the block between two marks replaced, or added at its end."""
    marked = f"{start}\n{block}\n{end}"
    if text and start in text and end in text:
        return text[: text.index(start)] + marked + text[text.index(end) + len(end) :]
    return f"{text.rstrip()}\n\n{marked}\n" if text else marked + "\n"
