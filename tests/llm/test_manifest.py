"""The Merkle manifest against a slow tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm.merkle_manifest import as_hex, fold_proof, merkle_manifest, siblings

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, leaf string, children string, row string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_tree(leaves):
    """root, and for each leaf its runs from below: (run, place in it)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            paths[k].append((nodes[i // 8 * 8 : i // 8 * 8 + 8], i % 8))
        at, nodes = [i // 8 for i in at], [sha("".join(nodes[j : j + 8])) for j in range(0, len(nodes), 8)]
    return nodes[0], paths


def slow_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in order:
        own = sorted(((r[0] is not None, r[0] or 0, slow_leaf(r), r) for r in groups[g]), key=lambda x: x[:3])
        trees[g] = own, *slow_tree([x[2] for x in own])
    root, tops = slow_tree([trees[g][1] for g in order])
    for g, top in zip(order, tops):
        own, subroot, paths = trees[g]
        for (_, _, leaf, r), path in zip(own, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now = slow_leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))) if changed else leaf
            for run, k in path + top:
                now = sha("".join([*run[:k], now, *run[k + 1 :]]))
            proof = "".join(d for run, k in path + top for j, d in enumerate(run) if j != k)
            out.append((r[0], leaf, subroot, root, sha(proof), now))
    return sorted(out, key=str)


def sample(n, langs, seed=1):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Ab", "no capitals", "É 日本 😀", "Word " * rng.randrange(1, 2000)])
    rows = [(rng.choice([None, rng.randrange(10**6)]) if rng.random() < 0.02 else k, rng.choice([None, "", "web", "b:k"]), rng.choice(langs), rng.choice([None, 0, 7]), text()) for k in range(n)]
    return rows + [rows[0]] * 3 if rows else rows


@pytest.mark.parametrize("n,langs", [(700, ["en", "en", "en", "de", None, "", "zz", "é"]), (1, ["en"]), (2, [None]), (120, [f"l{k}" for k in range(90)]), (600, ["en"])])
def test_manifest_is_the_slow_trees(spark, tmp_path, n, langs):
    from lodestone.llm import registry

    rows = sample(n, langs)
    frame = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "g", "l", "c", "r") for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op13_manifest(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=str) == slow_manifest(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert all(r.verified for r in got if r.doc_id is None) and len(got) == len(rows)


def test_a_change_anywhere_in_a_proof_is_seen(spark):
    frame = spark.createDataFrame([(k, "t", "en", "s", 1, "", "", "", "") for k in range(100)], SCHEMA)
    proven = merkle_manifest(frame, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id"), "g": F.col("g")})
    swapped = F.transform("proof", lambda s, k: F.when(k == 1, F.struct(s["right"].alias("left"), s["left"].alias("right"))).otherwise(s))
    got = proven.select("doc_id", "g", (fold_proof(F.col("leaf"), F.col("proof")) == F.col("root")).alias("good"), (fold_proof(F.col("leaf"), swapped) == F.col("root")).alias("bad"), F.length(as_hex(siblings(F.col("proof")))).alias("n")).collect()
    assert len(got) == 100 and all(r.good and r.g == "" for r in got)
    assert not any(r.bad for r in got)
    assert {r.n for r in got} == {64 * (7 + 7 + 1), 64 * (7 + 4 + 1), 64 * (3 + 4 + 1)}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(none, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")}).count() == 0
