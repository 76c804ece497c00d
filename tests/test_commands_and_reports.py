"""Commands of projects, lines and sums of reports."""

from lodestone.operators import evaluation as E
from lodestone.sources import tree


def commands(spark, **files):
    rows = [("p", p.replace("_", "."), c) for p, c in files.items()] + [("q", "Cargo.toml", "")]
    got = tree.project_scripts(spark.createDataFrame(rows, "project string, path string, content string")).collect()
    assert {(r.slot, r.command) for r in got if r.project == "q"} == {("build", "cargo build"), ("test", "cargo test")}
    return {(r.slot, r.name): r.command for r in got if r.project == "p"}


def test_slots_take_the_first_manifest_that_fills_them(spark):
    package = '{"scripts": {"build": "tsc", "start": "node --watch x", "test": "", "precommit": "p", "docs": "d", "a-very-long-script-name": "x"}}'
    assert commands(spark, package_json=package, Makefile="dev: a\nbuild:\ntest:\nother:\n\tlint: no\n", go_mod="module m") == {("build", "build"): "tsc", ("start", "start"): "node --watch x", ("dev", "dev"): "make dev", ("test", "test"): "make test", ("other", "docs"): "d"}
    assert commands(spark, package_json="{broken", go_mod="", pyproject_toml="") == {("build", "build"): "go build ./...", ("test", "test"): "go test ./..."}
    assert commands(spark, package_json=None, pyproject_toml="x") == {("test", "test"): "pytest"}


CELLS = "task string, arm string, duration_ms double, input_tokens long, cost double, overall int, coverage int, accuracy int, error string, mcp_by_server map<string,long>"


def test_lines_and_means_of_the_matrix(spark):
    cells = spark.createDataFrame([("t", "A", 1500.0, 1234, 0.5, 4, 5, 3, None, {"x": 2}), ("t", "B", None, None, None, None, None, None, "out of time " * 10, None), ("u", "A", 500.0, 2_000_000, 0.25, None, None, None, None, {"y": 1}), ("u", "Long arm", 10.0, 7, 12.0, 1, 1, 1, "", {"x": 1, "z": 9})], CELLS)
    lines = {(r.task, r.arm): r.text for r in E.quality_lines(cells).collect()}
    assert lines["t", "A"] == "    A         1.5s       1.2K $0.5000      4/5       5/5       3/5"
    assert lines["t", "B"] == "    B     " + ("out of time " * 10)[:60] and lines["u", "A"].endswith("2.0M $0.2500 unscored         -         -") and lines["u", "Long arm"].startswith("    Long arm     0.0s          7 $12.0000")
    means = {r.arm: r for r in E.quality_summary(cells).collect()}
    assert set(means) == {"A", "Long arm"} and (means["A"].cells, means["A"].seconds, means["A"].tokens, means["A"].cost, means["A"].overall) == (2, 1.0, "1.0M", 0.375, 4.0)
    servers = {r.server: (r.before, r.after) for r in E.server_calls(cells, "task", "arm", "A", "Long arm").collect()}
    assert servers == {"y": (1, 0), "x": (0, 1), "z": (0, 9)}
    both = {r.metric: (r.tasks, r.before, r.after) for r in E.comparison_summary(cells, "task", "arm", "A", "Long arm", ["cost"]).collect()}
    assert both == {"cost": (1, 0.25, 12.0)}
