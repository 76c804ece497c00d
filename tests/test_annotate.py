"""Annotation of a small index: cache, order, restart."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.matching import merge_annotations
from lodestone.plans.annotate import annotate_index
from lodestone.plans.build import build_index, publish_index, read_index

FILES = [
    ("src/db.ts", ".ts", "export function save(q: Req): string {\n  return q;\n}\n"),
    ("src/api.ts", ".ts", 'import { save } from "./db";\nexport function create(q: Req): string {\n  return save(q);\n}\n'),
    ("src/ui.ts", ".ts", 'import { create } from "./api";\n/** Shows the whole form. */\nexport function show(): void {\n  create(1);\n}\n'),
]


def test_annotations_are_cached_and_survive_a_restart(spark, tmp_path):
    rows = [(*f, None) for f in FILES] + [("src/lost.ts", ".ts", None, "OSError: gone")]
    index = build_index(spark.createDataFrame(rows, "path string, ext string, content string, error string"))
    assert [tuple(r) for r in index["unreadable"].collect()] == [("src/lost.ts", "OSError: gone")] and index["files"].count() == 3
    assert publish_index(index, str(tmp_path / "index"), ["files", "symbols", "unreadable"]) == 1
    assert {n: d.count() for n, d in read_index(spark, str(tmp_path / "index")).items()} == {"files": 3, "symbols": 3, "unreadable": 1}
    asked = []

    def ask(rows, broken=False):
        found = rows.orderBy("turn").collect()
        asked.append([r.path for r in found])
        if broken:
            raise RuntimeError("killed")
        name = F.regexp_extract("text", r"Describe:\n(\w+)", 1)
        raw = F.concat(F.lit('{"'), "path", F.lit("::"), name, F.lit('": {"description": "Does '), name, F.lit('.", "danger": "none"}}'))
        return rows.select("key", raw.alias("raw"), F.lit(1.0).alias("cost"))

    with pytest.raises(RuntimeError, match="killed"):
        annotate_index(index, str(tmp_path / "q"), lambda rows: ask(rows, True), "v1")
    notes, cache, ended = annotate_index(index, str(tmp_path / "q"), ask, "v1")
    want = {("src/db.ts", "save", "Does save."), ("src/api.ts", "create", "Does create.")}
    assert {(r.path, r.name, r.description) for r in notes.collect()} == want and ended == "done"
    assert asked[0] == asked[1] and sorted(asked[1]) == ["src/api.ts", "src/db.ts"]  # the documented export isn't asked about
    said = {r.name: r.description for r in merge_annotations(index["symbols"], notes).collect()}
    assert said == {"save": "Does save.", "create": "Does create.", "show": "Shows the whole form."}
    kept = cache.filter(F.col("raw").contains("save"))
    notes, _, _ = annotate_index(index, str(tmp_path / "q2"), ask, "v1", cache=kept)
    assert asked[2:] == [["src/api.ts"]] and {(r.path, r.name, r.description) for r in notes.collect()} == want
