"""Scalar functions, each a Column expression that stays in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import rules


def token_estimate(text: Column) -> Column:
    """Tokens of a text: its UTF-8 bytes over 3.7, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(3.7)).cast("long")


def round_half_up(value: Column, places: int = 0) -> Column:
    """Rounding as in JavaScript: halves go up, towards positive infinity."""
    scale = 10.0**places
    return (F.floor(value * scale + 0.5) / scale).cast("double")


def human_tokens(n: Column) -> Column:
    return F.when(n >= 1000, F.format_string("%.1fK", n / 1000)).otherwise(n.cast("string"))


def human_bytes(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fMB", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fKB", n / 1000)).otherwise(F.concat(n.cast("string"), F.lit("B")))


def human_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fK", n / 1000)).otherwise(n.cast("string"))


def package_name(source: Column) -> Column:
    """The package of an import: its first segment, two for scoped names; null for relative, absolute and empty sources."""
    parts = F.split(source, "/")
    scoped = F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    return F.when(source.isNull() | (source == "") | source.startswith(".") | source.startswith("/"), None).when(source.startswith("@"), scoped).otherwise(F.get(parts, F.lit(0)))


def is_private_package(name: Column) -> Column:
    return name.startswith("@") & ~F.substring_index(name, "/", 1).isin(*rules.PUBLIC_SCOPES)


def is_stdlib(name: Column) -> Column:
    return name.isin(*rules.STDLIB) | name.startswith("node:")


def split_identifier(name: Column) -> Column:
    """Words of a camelCase, snake_case or kebab-case name."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"[_-]", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def hash16(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def annotation_key(content: Column, exported: Column, version: str) -> Column:
    """Cache key of a file's annotations: content, sorted exported names and the prompt's version."""
    return hash16(F.concat_ws("\x00", content, F.array_join(F.array_sort(exported), ","), F.lit(version)))


def percent_delta(before: Column, after: Column) -> Column:
    """Change in whole percent; null where there is nothing to compare with, 0 for 0 to 0."""
    return F.when((before == 0) & (after == 0), F.lit(0.0)).when(before == 0, None).otherwise(round_half_up((after - before) / before * 100))


def delta_text(before: Column, after: Column, higher_is_better: bool) -> Column:
    d = percent_delta(before, after)
    better = (d > 0) if higher_is_better else (d < 0)
    sign = F.when(d > 0, "+").otherwise("")
    return F.when(d.isNull(), "n/a").when(d == 0, "0%").otherwise(F.concat(sign, d.cast("int").cast("string"), F.lit("% "), F.when(better, "✓").otherwise("✗")))


def age_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h"))).otherwise(F.concat(F.floor(s / 86400), F.lit("d")))


def repo_name(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]+?)(?:\.git)?/?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def language_of(ext: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in rules.EXTENSION_LANGUAGE.items() for x in kv])[ext]


def is_sensitive(path: Column) -> Column:
    name = base_name(path)
    return name.isin(*rules.SENSITIVE_NAMES) | reduce(or_, [name.endswith(s) for s in rules.SENSITIVE_SUFFIXES]) | name.startswith(".env")


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in rules.SKIP_DIRS]))


def is_test_file(path: Column) -> Column:
    name = base_name(path)
    return name.contains(".test.") | name.contains(".spec.") | name.contains("_test.") | name.startswith("test_") | path.contains("/test/") | path.contains("/tests/") | path.contains("/__tests__/")


def is_component(name: Column) -> Column:
    return name.rlike("^[A-Z]") & ~name.rlike("^[A-Z_]+$")


def symbol_kind(name: Column) -> Column:
    return F.when(name.isin(*rules.VERBS, "HEAD", "OPTIONS"), "route").when(is_component(name), "component").otherwise("function")


def env_category(name: Column) -> Column:
    n = F.upper(name)
    out = F
    for category, parts in rules.ENV_CATEGORIES:
        out = out.when(reduce(or_, [n.contains(p) for p in parts]), category)
    return out.otherwise("config")


def is_accepted_var(name: Column) -> Column:
    return ~name.isin(*rules.SYSTEM_VARS) & (F.length(name) > 2) & ~name.rlike(rules.PLACEHOLDER_VARS)


def short_type(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in rules.SHORT_TYPES.items() for x in kv])[kind], F.lower(kind))


def signature_text(kind: Column, name: Column, signature: Column, description: Column) -> Column:
    """One line for a symbol: its kind where that isn't plain, its signature, and its description cut at 80 characters."""
    base = F.when(kind.isin("class", "interface", "enum", "type"), F.concat_ws(" ", kind, signature)).when(kind == "component", F.concat(F.lit("<"), name, F.lit("> "), signature)).otherwise(signature)
    cut = F.when(F.length(description) > 80, F.concat(F.left(description, F.lit(77)), F.lit("..."))).otherwise(description)
    return F.when(F.coalesce(description, F.lit("")) == "", base).otherwise(F.concat(base, F.lit(" — "), cut))


def branch_count(content: Column) -> Column:
    return reduce(add, [F.regexp_count(content, F.lit(p)) for p in rules.BRANCHES])


def query_terms(text: Column, kind: str = "context") -> Column:
    """Terms of a question. context: letters and digits, 3 or more, no stop words; issue: keeps _ / -; bm25: 4 or more, stop words stay."""
    keep = r"[^a-z0-9\s_/-]" if kind == "issue" else r"[^a-z0-9\s]"
    words = F.split(F.regexp_replace(F.lower(text), keep, " "), r"\s+")
    if kind == "bm25":
        return F.filter(words, lambda w: F.length(w) >= 4)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*rules.QUERY_STOP_WORDS))


def prompt_complexity(prompt: Column) -> Column:
    """1 to 10: how much context a request asks for."""
    hits = lambda patterns, weight: [F.when(prompt.rlike("(?i)" + p), weight).otherwise(0) for p in patterns]
    n = F.length(prompt)
    parts = hits(rules.PROMPT_HIGH, 2) + hits(rules.PROMPT_MEDIUM, 1) + hits(rules.PROMPT_LOW, -2)
    parts += [(n > 200).cast("int"), (n > 500).cast("int"), -(n < 30).cast("int"), F.when(F.regexp_count(prompt, F.lit(r"\w+\.\w{2,4}")) >= 2, 2).otherwise(0)]
    return F.greatest(F.lit(1), F.least(F.lit(10), F.lit(3) + reduce(add, parts)))


def task_labels(prompt: Column) -> Column:
    """Labels of the kinds of question that a prompt is."""
    return F.filter(F.array(*[F.when(reduce(or_, [prompt.rlike(p) for p in patterns]), label) for label, patterns in rules.TASKS]), lambda x: x.isNotNull())


def injection_budget(complexity: Column, top_score: Column) -> Column:
    share = F.when(top_score >= 3.0, 1.0).when(top_score >= 1.5, 0.6).otherwise(0.3)
    return round_half_up(F.when(complexity <= 3, 1500).when(complexity <= 6, 5000).otherwise(9000) * share).cast("long")


def redact_first(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The first match of each (pattern, label), in order, replaced by a note."""
    for pattern, label in patterns:
        flags = "(?is)" if pattern.startswith("(?i)") else "(?s)"
        body = pattern.removeprefix("(?i)")
        text = F.regexp_replace(text, f"{flags}^(.*?)(?:{body})", f"$1[REDACTED {label}]")
    return text


def cell_text(error: Column, cached: Column, cost: Column, seconds: Column, turns: Column) -> Column:
    """A report cell: error, cached, or cost, seconds and turns."""
    full = F.format_string("$%.2f / %.0fs / %s turns", cost, seconds, F.coalesce(turns.cast("string"), F.lit("?")))
    return F.when(error.isNotNull(), "error").when(cached, "cached").when(cost.isNull(), "—").otherwise(full)
