"""Merkle manifest of a dataset: rows are leaves of a tree for each group, the groups' roots are leaves of one more tree.

Bottom-up build: a level is a table of runs of up to eight children, keyed by their parent; the parent's digest is the hash of the children's.
Each level is written to the shared folder and the next is made from it, so the work is that of the leaves and an eighth more.
Top-down proof push: from the root down, each level is joined with its parents' proofs, and each child puts its siblings before the
proof that it inherits. The proof of a leaf is thus a list of (left, right), the digests of the siblings on its two sides, from the
leaf's run up to the root's. fold_proof gives the root back from a leaf and its proof.

A leaf is the SHA-256 of the row's fields, each `-` if null, else its length in UTF-8 bytes, a colon and its value. A node is the
SHA-256 of its children's digests as hex text. A group of one row has the leaf as its root, a dataset of one group that group's root.

Defined results: nulls in any field, and in the group and the order, where they come first; rows that are equal in the order take the
order of their leaves; repeated rows are leaves of their own; an empty table gives an empty one; texts of any length are hashed whole; columns besides the fields
and the kept ones don't enter, whatever their names. A group may hold any share of the rows: no task holds more than a range of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize
from lodestone.llm.positions import with_positions

FAN_OUT = 8


def leaf_hash(*fields: Column) -> Column:
    """The digest (binary) of a row's fields."""
    shown = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*shown), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def node_hash(digests: Column) -> Column:
    """The digest of a node, from its children's digests one after the other (binary)."""
    return F.unhex(F.sha2(as_hex(digests), 256))


def joined(digests: Column) -> Column:
    """An array of digests as one binary."""
    return F.aggregate(digests, F.lit("").cast("binary"), lambda a, d: F.concat(a, d))


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda own, s: node_hash(F.concat(s["left"], own, s["right"])))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one binary, level by level, left to right."""
    return F.aggregate(proof, F.lit("").cast("binary"), lambda a, s: F.concat(a, s["left"], s["right"]))


def build_levels(nodes: DataFrame, label: str, fan_out: int = FAN_OUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels over nodes (g, i, n, digest, row), bottom-up, and the roots (g, level, digest, row). i: position among the n nodes of g. A level holds (g, parent, n, children), children in order as (i, digest, row)."""
    left, levels, roots = nodes.agg(F.max("n")).first()[0] or 1, [], nodes.filter("n = 1").select("g", F.lit(0).alias("level"), "digest", "row")
    while left > 1:
        runs = nodes.filter("n > 1").groupBy("g", "n", F.floor(F.col("i") / fan_out).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("i", "digest", "row"))).alias("children"))
        levels.append(materialize(runs.select("g", "parent", "n", "children"), f"{label}-level{len(levels)}"))
        left = -(-left // fan_out)
        nodes = levels[-1].select("g", F.col("parent").alias("i"), F.ceil(F.col("n") / fan_out).alias("n"), node_hash(joined(F.col("children.digest"))).alias("digest"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
        roots = roots.unionByName(nodes.filter("n = 1").select("g", F.lit(len(levels)).alias("level"), "digest", "row"))
    return levels, roots


def push_proofs(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(digest, row, above, proof) of all leaves. roots: (g, level, digest, row, above, proof), above being whatever the leaves of g shall inherit."""
    at = lambda k: roots.filter(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), "digest", "row", "above", "proof")
    nodes = at(len(levels))
    for k in reversed(range(len(levels))):
        parents = nodes.select("g", F.col("i").alias("parent"), "above", "proof")
        child = levels[k].join(parents, ["g", "parent"]).select("g", "above", "proof", F.col("children.digest").alias("run"), F.posexplode("children").alias("at", "c"))
        own = F.struct(joined(F.slice("run", F.lit(1), F.col("at"))).alias("left"), joined(F.slice("run", F.col("at") + 2, F.size("run"))).alias("right"))
        nodes = child.select("g", "c.i", "c.digest", "c.row", "above", F.concat(F.array(own), F.col("proof")).alias("proof")).unionByName(at(k))
    return nodes.select("digest", "row", "above", "proof")


def merkle_manifest(rows: DataFrame, fields: list[str], group: str, order: str, keep: dict[str, Column]) -> DataFrame:
    """The kept columns of each row with leaf, subroot, root (binary) and proof (array of left, right)."""
    kept = F.struct(*[c.alias(n) for n, c in keep.items()])
    # A group's key is never null and sorts as its value does, null first.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = materialize(rows.select(key.alias("g"), F.col(order).alias("o"), leaf_hash(*[F.col(f) for f in fields]).alias("digest"), kept.alias("row")), "leaves")
    placed = with_positions(leaves, "g", [F.col("o"), F.col("digest")], "placed").select("g", F.col("position").alias("i"), F.col("group_rows").alias("n"), "digest", "row")
    levels, roots = build_levels(placed, "rows")
    subroots = materialize(roots, "subroots")
    # The tree over the groups: its leaves are the subroots, each with its group and level for the way down.
    top = with_positions(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "digest", F.struct(F.col("g").alias("g"), "level", "row").alias("row")), "g", [F.col("o")], "groups")
    top_levels, whole = build_levels(top.select("g", F.col("position").alias("i"), F.col("group_rows").alias("n"), "digest", "row"), "groups")
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    groups = push_proofs(top_levels, whole.select("*", F.col("digest").alias("above"), none.alias("proof")))
    down = groups.select("row.g", "row.level", "digest", "row.row", F.struct(F.col("digest").alias("subroot"), F.col("above").alias("root")).alias("above"), "proof")
    proven = push_proofs(levels, materialize(down, "group-proofs"))
    return proven.select(*[F.col("row").getField(n).alias(n) for n in keep], F.col("digest").alias("leaf"), "above.subroot", "above.root", "proof")
