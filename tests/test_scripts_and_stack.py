"""Declarations and imports of scripts in their many forms, and the stack of a project."""

import pytest

from lodestone.operators import extract as X
from lodestone.sources import tree


@pytest.fixture
def files(spark):
    return lambda d: spark.createDataFrame([(p, "." + p.rsplit(".", 1)[-1], c) for p, c in d.items()], "path string, ext string, content string")


SCRIPT = """import def, { x, type Y as z } from "./a";
import * as ns from './b';
import other, * as all from "../c";
import type Shape from "./d";
// import nothing of note
import last from "pkg";

function internal(a: number): string {
  function nested() {}
}
export async function load(
  id: string,
  more = 1,
): Promise<User> {
  return 1;
}
interface Hidden extends Base {
}
export enum Color {
  Red,
  Green = 2, // the second
  Blue
}
enum Tiny { A, B }
const enum Many { a, b, c, d, e, f, g, h, i }
export type Long = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa";
class Own<T> extends Base<T> {
  read(key: string): string {
  }
}
export const arrow = async (
  a: string
): Promise<void> => {
}
export default internal;
"""


def test_imports_of_all_clauses(files):
    got = {(r.source, tuple(r.names), r.is_type_only) for r in X.imports(files({"src/a.ts": SCRIPT})).collect()}
    assert got == {("./a", ("def", "x", "z"), False), ("./b", ("ns",), False), ("../c", ("other", "all"), False), ("./d", ("Shape",), True), ("pkg", ("last",), False)}


def test_declarations_over_lines_and_not_exported(files):
    rows = X.symbols(files({"src/a.ts": SCRIPT})).collect()
    got = {(r.name, r.kind, r.signature, r.exported, r.line) for r in rows if "Long" not in r.name}
    assert got == {
        ("internal", "function", "internal(a: number): string", False, 8),
        ("load", "function", "load(id: string, more = 1): Promise<User>", True, 11),
        ("Hidden", "interface", "Hidden extends Base", False, 17),
        ("Color", "enum", "Color = Red | Green | Blue", True, 19),
        ("Tiny", "enum", "Tiny = A | B", False, 24),
        ("Many", "enum", "Many = a | b | c | d | e | f | g | h | ...", False, 25),
        ("Own", "class", "Own extends Base<T>", False, 27),
        ("Own.read", "method", "read(key: string): string", False, 28),
        ("arrow", "function", "arrow(a: string): Promise<void>", True, 31),
        ("internal", "function", "internal (default export)", True, 35),
    }
    long_ = next(r for r in rows if r.name == "Long")
    assert long_.signature.endswith("...") and len(long_.signature) == len("Long = ") + 63


def test_empty_and_null_sources(files):
    f = files({"a.ts": "", "b.ts": None, "c.ts": "\n\n", "d.ts": "function open(\n  a,\n", "e.ts": "enum Open {\n  A,"})
    assert {(r.path, r.name) for r in X.symbols(f).collect()} == {("e.ts", "Open")} and X.imports(f).count() == 0


def test_one_pattern_of_go_and_rust_types(files):
    f = files({"a.go": "type A struct {\ntype B interface {\nfunc (s *Store) Get(k string) error {\n", "b.rs": "pub struct C;\npub(crate) enum D {\npub trait E {\n"})
    got = {(r.name, r.kind, r.signature, r.exported) for r in X.symbols(f).collect()}
    assert got == {("A", "class", "A struct", True), ("B", "interface", "B interface", True), ("Store.Get", "method", "Get(k string) error", True), ("C", "class", "struct C", True), ("D", "enum", "enum D", True), ("E", "interface", "trait E", True)}


def stack(spark, contents):
    rows = spark.createDataFrame(list(contents.items()), "path string, content string")
    return [(r.kind, r.value) for r in tree.detect_stack(rows).orderBy("pos").collect()]


def test_stack_of_scripts(spark):
    got = stack(spark, {"package.json": '{"main":"m.js","dependencies":{"next":"1","hono":"2","knex":"3","typeorm":"1"},"devDependencies":{"@playwright/test":"1"}}', "pnpm-lock.yaml": "", "src/app/x.tsx": "", "deep/yarn.lock": ""})
    assert got == [("language", "typescript"), ("language", "javascript"), ("framework", "next.js"), ("framework", "hono"), ("package_manager", "pnpm"), ("orm", "typeorm"), ("test", "playwright"), ("entry", "src/app/layout.tsx"), ("entry", "m.js")]


def test_stack_of_other_languages(spark):
    assert stack(spark, {"pyproject.toml": "fastapi sqlalchemy pytest", "package.json": '{"dependencies":{"prisma":"1","jest":"1"}}'}) == [("language", "typescript"), ("language", "javascript"), ("language", "python"), ("framework", "fastapi"), ("package_manager", "npm"), ("orm", "sqlalchemy"), ("test", "pytest")]
    assert stack(spark, {"go.mod": "require gin-gonic/gin", "cmd/a.go": "", "Cargo.toml": "", "src/lib.rs": "", "pom.xml": ""}) == [("language", "go"), ("language", "rust"), ("language", "java"), ("framework", "gin"), ("entry", "cmd/"), ("entry", "src/lib.rs")]
    assert stack(spark, {"readme.md": "x"}) == [] and stack(spark, {"package.json": "{broken", "requirements.txt": None}) == [("language", "typescript"), ("language", "javascript"), ("language", "python"), ("package_manager", "npm")]


def test_empty_tree_has_no_stack(spark):
    assert tree.detect_stack(spark.createDataFrame([], "path string, content string")).count() == 0
