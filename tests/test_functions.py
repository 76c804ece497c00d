"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S


def one(spark, expression, **values):
    frame = spark.range(1)
    for k, v in values.items():
        frame = frame.withColumn(k, F.lit(v))
    return frame.select(expression.alias("r")).first().r


@pytest.mark.parametrize("text,want", [("", 0), ("abc", 1), ("é" * 37, 20), ("x" * 38, 11)])
def test_token_estimate_counts_bytes(spark, text, want):
    assert one(spark, S.token_estimate(F.col("t")), t=text) == want


@pytest.mark.parametrize("value,want", [(2.25, 2.3), (-2.25, -2.2), (0.05, 0.1), (1.0, 1.0)])
def test_halves_round_up(spark, value, want):
    assert one(spark, S.round_half_up(F.col("v"), 1), v=value) == want


@pytest.mark.parametrize("source,want", [("react", "react"), ("react/dom", "react"), ("@s/p/x", "@s/p"), ("@s", None), ("./a", None), ("/a", None), ("", None)])
def test_package_names(spark, source, want):
    assert one(spark, S.package_name(F.col("s")), s=source) == want


def test_private_and_standard_packages(spark):
    rows = spark.createDataFrame([("@types/node",), ("@mine/x",), ("react",), ("fs",), ("node:fs",)], "n string")
    got = rows.select(S.is_private_package(F.col("n")).alias("p"), S.is_stdlib(F.col("n")).alias("s")).collect()
    assert [(r.p, r.s) for r in got] == [(False, False), (True, False), (False, False), (False, True), (False, True)]


@pytest.mark.parametrize("name,want", [("camelCaseName", ["camel", "Case", "Name"]), ("snake_case", ["snake", "case"]), ("kebab-case x", ["kebab", "case", "x"]), ("ABC", ["ABC"])])
def test_identifier_split(spark, name, want):
    assert one(spark, S.split_identifier(F.col("n")), n=name) == want


@pytest.mark.parametrize("name,want", [("DATABASE_URL", "database"), ("JWT_KEY", "auth"), ("API_URL", "api"), ("AWS_X", "services"), ("FLAG", "config"), ("redis_token", "database")])
def test_env_category_precedence(spark, name, want):
    assert one(spark, S.env_category(F.col("n")), n=name) == want


def test_accepted_variables(spark):
    rows = spark.createDataFrame([("HOME",), ("AB",), ("foo",), ("REAL",)], "n string")
    assert [r.a for r in rows.select(S.is_accepted_var(F.col("n")).alias("a")).collect()] == [False, False, False, True]


@pytest.mark.parametrize("path,want", [("src/a.test.ts", True), ("src/a.spec.js", True), ("x/a_test.go", True), ("x/test_a.py", True), ("a/tests/b.ts", True), ("test/b.ts", False), ("src/attest.ts", False)])
def test_test_files(spark, path, want):
    assert one(spark, S.is_test_file(F.col("p")), p=path) is want


@pytest.mark.parametrize("path,want", [(".env", True), (".env.local", True), ("a/id_rsa", True), ("k.pem", True), ("a/b.p12", True), ("env.ts", False)])
def test_sensitive_files(spark, path, want):
    assert one(spark, S.is_sensitive(F.col("p")), p=path) is want


@pytest.mark.parametrize("name,want", [("GET", "route"), ("UserCard", "component"), ("MAX_SIZE", "function"), ("run", "function")])
def test_symbol_kinds(spark, name, want):
    assert one(spark, S.symbol_kind(F.col("n")), n=name) == want


def test_paths(spark):
    rows = spark.createDataFrame([("src/a.b.ts",), ("x",), ("d/.env",)], "p string")
    got = rows.select(S.base_name(F.col("p")).alias("b"), S.dir_name(F.col("p")).alias("d"), S.stem(F.col("p")).alias("s"), S.extension(F.col("p")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("a.b.ts", "src", "a.b", ".ts"), ("x", ".", "x", ""), (".env", "d", ".env", "")]


@pytest.mark.parametrize("prompt,low,high", [("fix typo", 1, 1), ("refactor the system architecture and migrate a.ts and b.ts", 10, 10), ("please add a small thing to this page", 4, 4)])
def test_prompt_complexity(spark, prompt, low, high):
    assert low <= one(spark, S.prompt_complexity(F.col("p")), p=prompt) <= high


def test_three_tokenizers(spark):
    text = "Why does the my_var/path fail-fast, at 404?"
    assert one(spark, S.query_terms(F.col("t"), "context"), t=text) == ["var", "path", "fail", "fast", "404"]
    assert one(spark, S.query_terms(F.col("t"), "issue"), t=text) == ["my_var/path", "fail-fast", "404"]
    assert one(spark, S.query_terms(F.col("t"), "bm25"), t=text) == ["does", "path", "fail", "fast"]


def test_redaction_takes_the_first_of_each_pattern(spark):
    text = "password='a1' and password='b2'\npassword='c3'"
    got = one(spark, S.redact_first(F.col("t"), [(r"(?i)password\s*[:=]\s*['\"][^'\"]+", "password")]), t=text)
    assert got == "[REDACTED password]' and password='b2'\npassword='c3'"


def test_deltas(spark):
    rows = spark.createDataFrame([(100.0, 150.0), (100.0, 50.0), (0.0, 5.0), (0.0, 0.0)], "a double, b double")
    got = [r.d for r in rows.select(S.delta_text(F.col("a"), F.col("b"), False).alias("d")).collect()]
    assert got == ["+50% ✗", "-50% ✓", "n/a", "0%"]


def test_budget_and_age(spark):
    assert one(spark, S.injection_budget(F.lit(7), F.lit(2.0))) == 5400 and one(spark, S.injection_budget(F.lit(2), F.lit(0.1))) == 450
    assert [one(spark, S.age_text(F.lit(x))) for x in (59, 60, 7200, 90000)] == ["59s", "1m", "2h", "1d"]


def test_texts(spark):
    assert one(spark, S.repo_name(F.lit("https://x.org/a/my-repo.git"))) == "my-repo"
    assert one(spark, S.human_tokens(F.lit(1234))) == "1.2K" and one(spark, S.human_bytes(F.lit(2_500_000))) == "2.5MB" and one(spark, S.human_number(F.lit(12))) == "12"
    assert one(spark, S.signature_text(F.lit("class"), F.lit("A"), F.lit("A extends B"), F.lit("d" * 90))) == "class A extends B — " + "d" * 77 + "..."
    assert one(spark, S.branch_count(F.lit("if (a) {} else if (b) { switch (c) { case 1: } } x ? y : z; try {} catch (e) {}"))) == 7
    assert one(spark, S.short_type(F.lit("CharField"))) == "str" and one(spark, S.short_type(F.lit("Money"))) == "money"
    assert len(one(spark, S.hash16(F.lit("a")))) == 16 and one(spark, S.annotation_key(F.lit("c"), F.array(F.lit("b"), F.lit("a")), "1")) == one(spark, S.annotation_key(F.lit("c"), F.array(F.lit("a"), F.lit("b")), "1"))
    assert one(spark, S.cell_text(F.lit(None).cast("string"), F.lit(False), F.lit(1.5), F.lit(20.0), F.lit(None).cast("int"))) == "$1.50 / 20s / ? turns"
    assert one(spark, S.task_labels(F.lit("where is the env var used"))) == ["env-audit"]
