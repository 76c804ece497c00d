"""What must not grow with the input: joins of generated lines, tables sent to the driver, rows of a single task."""

import math

from pyspark.sql import functions as F

from lodestone.operators import extract as X
from lodestone.operators import graph as G
from lodestone.operators import matching as M
from lodestone.operators import reports as P
from lodestone.operators import retrieval as R
from lodestone.operators.scripts import _TOKEN, Tokens, scan_scripts, scope_names
from lodestone.plans.catalogue import queries
from lodestone.plans.contracts import file_tasks, sources


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_script_descriptions_need_no_join(spark):
    text = "\n".join(["/**", " * Sums two numbers.", " */", "// a plain note", "export function a() {}", "export function b() {}", "// eslint-disable-line", "export const c = 1;", '"""a docstring"""', "", "/** @internal */ ", "let z = 1", "export class D { run() {} }"])
    files = spark.createDataFrame([("a.ts", ".ts", text), ("b.ts", ".ts", "// the only note\nexport const e = 1;"), ("c.ts", ".ts", None)], "path string, ext string, content string")
    declared = X.script_declarations(files)
    assert "Join" not in plan(declared) and "Exchange" not in plan(declared)
    # What the lines themselves give, by windows.
    said = X.lines(files).withColumn("near", X._description()).select("path", "line", "near")
    got = {(r.path, r.name): (r.description, r.near) for r in declared.join(said, ["path", "line"]).collect()}
    assert got["a.ts", "a"] == ("Sums two numbers.",) * 2 and got["b.ts", "e"] == ("the only note",) * 2
    assert set(got) == {("a.ts", x) for x in ("a", "b", "c", "D", "D.run")} | {("b.ts", "e")} and all(a == b for a, b in got.values())


def test_danger_notes_are_never_broadcast(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("src/pay/f"), "id", F.lit(".ts")).alias("file"), F.concat(F.lit("charge"), "id").alias("symbol"), F.when(F.col("id") < 3, "never retry without idempotency").otherwise("harmless words").alias("danger"))
    rows.write.parquet(f"{tmp_path}/notes")
    hits = P.danger_hits(spark.read.parquet(f"{tmp_path}/notes"), R.terms_of(spark, "payment retry idempotency retry", "bm25"))
    assert "BroadcastHashJoin" not in plan(hits)  # only the terms and single rows go to all tasks
    got = hits.collect()
    assert [r.symbol for r in got] == ["charge0", "charge1", "charge2"]
    # One keyword in three notes of 400 for each term; a note holds its symbol and its split word, stem, directory and words.
    idf, dl = math.log((400 - 3 + 0.5) / 3.5 + 1), {r.symbol: r.n for r in P.danger_keywords(rows).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    mean = sum(dl.values()) / len(dl)
    one = idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl["charge0"] / mean))
    assert abs(got[0].score - one * sum(r.times for r in R.terms_of(spark, "payment retry idempotency retry", "bm25").collect() if r.term != "payment")) < 1e-9


def test_symbols_used_twice_are_scanned_once(spark):
    for name in ("synth_conventions", "synth_module_keywords", "synth_modules"):
        assert "MapInArrow" not in plan(queries()[name](spark, "/root/testdata/sf0.001")), name


def test_rows_are_dealt_before_they_become_files(spark):
    # Of a table of one row group, one task would make all files.
    assert plan(sources(spark, "/root/testdata/sf0.001")).count(f"{file_tasks(spark)}), REPARTITION_BY_NUM") >= 3


def test_bodies_and_symbols_share_one_scan(spark):
    assert "MapInArrow" not in plan(queries()["synth_calls_and_throws"](spark, "/root/testdata/sf0.001"))


def test_numbered_names_meet_few_that_do_not_hold_them(spark):
    names = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id") + 100_000).alias("name"))
    assert M.contained_names(names, names).count() == 20_000
    # Pieces of three characters alone made each name meet hundreds.
    assert M._meeting_names(names, names).count() <= 2 * 20_000


def test_matching_tests_sends_no_names_to_all_tasks(spark):
    for name in ("synth_test_candidates", "synth_test_mapping"):
        # Only the one empty name that all hold may be sent around (see _related_names).
        assert "BroadcastHashJoin" not in plan(queries()[name](spark, "/root/testdata/sf0.001")), name


def test_rounds_of_page_rank_move_only_what_is_linked_to(spark, tmp_path, monkeypatch):
    sizes = []
    write = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: (lambda out: sizes.append((label, out.count())) or out)(write(df, label)))
    edges = spark.range(500).select(F.concat(F.lit("o"), "id").alias("src"), F.concat(F.lit("c"), F.col("id") % 5).alias("dst"), F.lit(1).alias("weight"))
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")).distinct()).unionByName(spark.createDataFrame([("lone",)], "id string"))
    got = {r.id: r["rank"] for r in G.page_rank(nodes, edges, rounds=3).collect()}
    assert {n for label, n in sizes if label in ("rank", "core")} == {5} and {n for label, n in sizes if label == "inner"} == {0}
    rank = {n: 1 / 506 for n in got}
    for _ in range(3):
        spread = sum(r for x, r in rank.items() if not x.startswith("o"))
        rank = {x: 0.15 / 506 + 0.85 * spread / 506 + (0.85 * sum(rank[f"o{k}"] for k in range(int(x[1:]), 500, 5)) if x.startswith("c") else 0) for x in rank}
    assert len(got) == 506 and all(abs(got[x] - rank[x]) < 1e-12 for x in rank)


def test_imports_that_share_a_base_are_tried_once(spark):
    based = spark.range(1000).select(F.concat(F.lit("src/a/f"), "id", F.lit(".ts")).alias("path"), F.lit("src/n/n1").alias("base"))
    assert X._candidates(based).count() == X._candidates(based.limit(1)).count() <= 17
    files = based.select("path").unionByName(spark.createDataFrame([("src/n/n1.ts",), ("src/n/n1.js",)], "path string"))
    used = based.select("path", F.lit("../n/n1").alias("source"), F.array(F.lit("n1")).alias("names"), F.lit(True).alias("is_relative"), F.lit(False).alias("is_type_only"))
    assert [tuple(r) for r in X.resolve_imports(files, used).groupBy("dst").agg(F.count_distinct("src")).collect()] == [("src/n/n1.ts", 1000)]


def test_imports_are_searched_for_once_after_rows_are_dealt(spark):
    for name in ("synth_import_edges", "synth_routes"):
        text = plan(queries()[name](spark, "/root/testdata/sf0.001"))
        assert not [x for x in text.split("\n") if "Filter" in x and "regexp_extract_all" in x], name


def test_usages_scan_once(spark):
    files = spark.createDataFrame([("a.ts", ".ts", "export function n3() {}"), ("b.ts", ".ts", "import { n3 } from './a';\n" + "  n3();\n" * 7)], "path string, ext string, content string")
    used = M.usages(files, X.symbols(files), spark.createDataFrame([("a.ts", "n3", "b.ts")], "def_path string, name string, importer string"), "n3")
    assert plan(used).count("MapInArrow") == 1
    assert sorted(tuple(r) for r in used.collect()) == [("b.ts", k, "n3();") for k in range(2, 7)]


def test_counted_files_are_not_listed(spark):
    text = plan(queries()["synth_modules"](spark, "/root/testdata/sf0.001"))
    assert "collect_list" not in text and "collect_set" not in text


def test_imports_used_twice_are_searched_for_once(spark):
    from lodestone.plans.forms import queries as forms

    for name, f in [(x, queries()[x]) for x in ("synth_complexity", "synth_modules", "synth_usages", "synth_entry_seeds", "synth_skeleton")] + [("symbol_lookup", forms()["symbol_lookup"])]:
        assert r"\bimport\s+(type" not in plan(f(spark, "/root/testdata/sf0.001")), name


def test_blanks_are_no_tokens():
    tokens = Tokens("a \t b\n\n  `x${ c }y`\t;\r\n")
    assert tokens.text == ["a", "b", "`x$", "{", "c", "}", "}y`", ";"] and tokens.line == [1, 1, 3, 3, 3, 3, 3, 3] and tokens.mate[3] == 5
    # A search passes over blanks, so a run of them costs no step of the loop.
    assert len(list(_TOKEN.finditer("a" + " " * 50 + "b"))) == 2 and [m[0] for m in _TOKEN.finditer("a  \n  b")] == ["a", "\n  ", "b"]


def test_scopes_read_the_scan_once_and_imports_the_text_once(spark):
    files = spark.range(3).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.lit(".ts").alias("ext"), F.lit("import { a } from './l';\nimport type T, { type U as v } from \"./m\";\nconst { q, r: s } = require('./n'), x = 1;\nfunction f() { a(); if (q) throw new E(); }").alias("content"))
    used = X.imports(files)
    assert plan(used).count("Range (") == 1  # one pass over the rows searches for both forms
    assert {(r.source, tuple(r.names), r.is_type_only) for r in used.collect()} == {("./l", ("a",), False), ("./m", ("T", "v"), True), ("./n", ("q", "r: s"), False)}
    named = scope_names(scan_scripts(files), used.select("path", F.explode("names").alias("word")).distinct())
    assert plan(named).count("MapInArrow") == 1
    assert {tuple(map(str, (r.path, r.symbol, r.name, r.calls, r.throws))) for r in named.collect()} == {(f"f{k}.ts", "0", "f", "['a', 'q']", "['E']") for k in range(3)}
