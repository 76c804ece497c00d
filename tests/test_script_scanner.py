"""The scanner of scripts, and uses by the innermost body around them."""

import random

import pytest

from lodestone.operators import extract as X
from lodestone.operators.scripts import Script, innermost, scan_scripts, scope_names

HARD = r'''
const s = "export function no() {}"; // export class Nope {}
const t = `export function ${ (() => { return "}" })() } class No2 {}`;
/* export enum Nah { A } */
export function f(a: { x: number, y?: (z: string) => void } = { x: 1 }, ...rest: Array<Map<string, number>>): { ok: boolean } {
  const r = /[}"]/.test("x"); if (a) throw err;
  const inner = async (q) => { throw new Deep(); };
  return { ok: r };
}
export class A<T extends { a: 1 }> extends mixin(B, { c: 2 }) implements I, J<K, L> {
  private x = 1
  @dec({ a: 1 }) static async run(
    a: string,
    b = (1 + 2),
  ): Promise<
    void
  > {
    return
  }
  get y(): number { return 1 }
  prop = () => { foo() }
  abstract over(a: string): void
  over(a: any) { }
  _no() {}
  private alsoNo() {}
  constructor(private readonly z: Z) { }
}
/** What a function may be. */
export type Fn<T> =
  | { kind: "a" }
  | (T extends string ? 1 : 2)
export interface P<T> extends Q<T>, R { a: string; type: number; class: string }
export const one = 1, two = (x: number) => x + 1, three: Handler = async function () { throw new TypeError("x"); };
namespace N { export function inNs() {} }
if (x) { function inIf() {} }
const hid = () => { function inArrow() {} };
export default async function main<T>(x: T) { }
export const enum E2 { "a b" = 1, B = 1 << 2, C = g(1, 2) }
export const Comp = () => <div className="a">Hello {two} </div>
export function last(cb: () => void): asserts cb is never {}
'''


def test_declarations_of_all_forms():
    got = [(x["name"], x["kind"], x["signature"], x["exported"], x["line"]) for x in Script(HARD).symbols]
    assert got == [
        ("f", "function", "f(a: { x: number, y?: (z: string) => void } = { x: 1 }, rest: Array<Map<string, number>>): { ok: boolean }", True, 5),
        ("A", "class", "A extends mixin(B, { c: 2 }) implements I, J<K, L>", True, 10),
        ("A.run", "method", "run(a: string, b = (1 + 2)): Promise<\n    void\n  >", False, 12),
        ("A.over", "method", "over(a: string): void", False, 22),
        ("A.over", "method", "over(a: any)", False, 23),
        ("Fn", "type", 'Fn = | { kind: "a" }\n  | (T extends string ? 1 : 2)', True, 29),
        ("P", "interface", "P extends Q<T>, R", True, 32),
        ("one", "variable", "one", True, 33),
        ("two", "function", "two(x: number)", True, 33),
        ("three", "function", "three: Handler", True, 33),
        ("inNs", "function", "inNs()", True, 34),
        ("inIf", "function", "inIf()", False, 35),
        ("inArrow", "function", "inArrow()", False, 36),
        ("main", "function", "main(x: T)", True, 37),
        ("E2", "enum", "E2 = a b | B | C", True, 38),
        ("Comp", "component", "Comp()", True, 39),
        ("last", "function", "last(cb: () => void): asserts cb is never", True, 40),
    ]
    assert [x["doc"] for x in Script(HARD).symbols if x["doc"]] == ["What a function may be."]


@pytest.mark.parametrize(
    "source,names",
    [
        ("module.exports = { a, b: 1, c() {}, d: { e: 2 },\n f };", ["a", "b", "c", "d", "f"]),
        ("module.exports = class X {}", ["X"]),
        ("module.exports = foo;", ["foo"]),
        ("function shown() {}\nmodule.exports = { other };", ["shown"]),
        ("", []),
        ("}}}}((( ```${{{", []),
        ("`${`${a}`}` ; function g() {}", ["g"]),
        ("class A {", ["A"]),
        ("a = b / c; function h() {} d / e", ["h"]),
        ("x = y.replace(/'/g, ''); export function q() {}", ["q"]),
    ],
)
def test_exports_and_broken_sources(source, names):
    assert [x["name"] for x in Script(source).symbols] == names


def test_any_text_is_read_and_bodies_nest():
    rng = random.Random(1)
    parts = ["export ", "function ", "class ", "{", "}", "(", ")", "<", ">", "`", "${", "'", '"', "/", "=>", "=", ":", "type ", "x ", "enum ", "const ", "\n", ",", ";", "async ", "import ", "from ", "@", "interface ", "[", "]", "default ", "throw ", "new ", "?"]
    for _ in range(4000):
        s = Script("".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))))
        s.uses(), s.throws()
        spans = [(x["start"], x["stop"]) for x in s.scopes]
        assert all(a <= b for a, b in spans)
        assert all(b[0] > a[1] or a[0] > b[1] or (a[0] <= b[0] and b[1] <= a[1]) or (b[0] <= a[0] and a[1] <= b[1]) for a in spans for b in spans)


def slow_innermost(at, spans):
    around = [s for s in spans if s[1] <= at <= s[2]]
    return min(around, key=lambda s: s[2] - s[1])[0] if around else None


def test_innermost_is_the_narrowest_span(spark):
    rng, spans, points = random.Random(4), [], []

    def nest(key, low, high, depth):
        while low + 2 < high:
            a = rng.randrange(low, min(high, low + 8))
            b = rng.randrange(a, min(high, a + 40))
            spans.append((key, len(spans), a, b))
            if depth < 4:
                nest(key, a + 1, b, depth + 1)
            low = b + 1

    for key in "abc":
        nest(key, 0, 200, 0)
        points += [(key, rng.randrange(200), f"w{k}") for k in range(300)]
    got = innermost(spark.createDataFrame(points, "path string, at int, word string"), spark.createDataFrame(spans, "path string, n int, start int, stop int"), "path").collect()
    assert len(got) == len(points) and len(spans) > 30
    for r in got:
        assert r.n == slow_innermost(r.at, [s[1:] for s in spans if s[0] == r.path]), r


NESTED = """import { a, b, c } from "./lib";
const unused = a;
export function outer() {
  function inner() { b(); throw new Inner(); }
  const arrow = () => { c("b // c"); };
  a();
  throw new Outer();
}
export class K { run() { return b; } other() { /* c */ } }
"""


def test_nested_functions_get_their_own_calls(spark):
    files = spark.createDataFrame([("src/x.ts", ".ts", NESTED), ("src/y.ts", ".ts", None)], "path string, ext string, content string")
    words = spark.createDataFrame([("src/x.ts", w) for w in "abc"], "path string, word string")
    got = {r.name: (r.calls, r.throws) for r in scope_names(scan_scripts(files), words).collect()}
    assert got == {"outer": (["a"], ["Outer"]), "inner": (["b"], ["Inner"]), "arrow": (["c"], []), "K.run": (["b"], [])}
    whole = {r.name: (r.calls, r.throws) for r in X.bodies(files, X.symbols(files), X.imports(files)).collect()}
    assert whole == {"outer": (["a", "b", "c"], ["Inner", "Outer"]), "K": ([], []), "K.run": (["b"], []), "K.other": ([], [])}
