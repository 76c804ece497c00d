"""Near-duplicates by bottom-k sketches of one hash function.

1. Shingles of four words are hashed to 64 bits; a document's sketch is its 64 least hashes. Documents of equal sets form a class, and
   one of each class goes on.
2. Inverted lists: each class enters the lists of its 16 least hashes, of which only the rarest `16 - t + 1` are kept, t being the
   number that two linked documents share of these (5 with a chance above 0.99999 at the threshold, whatever their sizes). Sets of up to
   64 are compared whole: among them t is 0.8 |s|, for sure. Sets from 51, which may be linked with longer ones, enter both ways. In one
   order of all values, two sets that share t values share one of these, so passages common to many documents make no lists unless a
   document is hardly anything else.
3. Lists of up to 64 classes generate pairs, and the part of the union that both sketches reach estimates their likeness; pairs 4.5
   deviations below the threshold drop out. Longer lists are dealt as units (see 4), whose tasks make the same estimate by a matrix
   product and return a spanning set of the likely pairs. The components of all likely pairs are the groups within which any link must lie.
4. Each group is confirmed on full sets: its texts go once to one task, which compares all pairs by a matrix product and returns a spanning
   set of the links. A group beyond the bounds of a unit is cut by set size (linked sets differ by a factor of 0.8 at most) and by a
   hash into units, and each pair of units that can hold links is a task of its own. No task holds more than two units, whatever the group.
5. Components of the links, by class; members take their class's.

Sets are compared by 64-bit hashes of their shingles. Nothing but counts comes to the driver. All tables that are read twice lie in the shared folder.

Defined results: null texts and texts without words have an empty set and are linked with nothing; with fewer words than a shingle has, the whole
sequence is one; rows with equal or null ids are documents of their own; a component's id is its least doc_id (null if all
are), and exactly one row of each component is kept: of least doc_id, nulls last.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches, materialize, worker_cached
from lodestone.llm.components import components

SKETCH, INDEXED = 64, 16
SHORT_LIST = 64
#: Classes and shingles of a unit of a long list, about.
UNIT_ROWS, UNIT_WEIGHT = 512, 300_000
_LOWER = {k: k + 32 for k in range(65, 91)}


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes() -> WordHashes:
    return worker_cached(("hashes",), WordHashes)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone change, six characters split
    if not words:
        return np.empty(0, np.uint64)
    table = word_hashes()
    h = np.array([table[w] for w in words], np.uint64)
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _as_lists(arrays: list[np.ndarray]) -> pa.Array:
    """Hashes as longs in the same order: the sign bit is turned, as SQL compares longs by sign."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((flat ^ np.uint64(1 << 63)).view(np.int64)))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """docs (uid, doc_id, text, ...) with n (set size), signature (of the whole set) and sketch (its least hashes, in order, as longs)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _as_lists([s[:SKETCH] for s in sets])]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "n", "signature", "sketch"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, schema)


def sure_overlap(threshold: float) -> int:
    """How many of its INDEXED least hashes a set shares with those of a linked one, but for a chance below 1 in 100,000.

    A hash of both sets among the INDEXED least of the union is among those of each, and of the union's hashes `threshold` are of both at the
    least, so a binomial tail bounds the chance, whatever the sets' sizes."""
    chance = 0.0
    for k in range(INDEXED + 1):
        chance += comb(INDEXED, k) * threshold**k * (1 - threshold) ** (INDEXED - k)
        if chance >= 1e-5:
            return max(1, k)
    return INDEXED


def list_entries(classes: DataFrame, threshold: float) -> DataFrame:
    """(v, uid, n, sketch): the entries of classes (uid, n, sketch) in inverted lists of two or more."""
    whole, n = F.col("whole"), F.col("n")
    # Two sets of up to SKETCH are compared whole, all others by their least; sets that may have partners of both kinds enter both ways. The values of the whole sets make lists of their own.
    kinds = F.array(F.when(n <= SKETCH, F.lit(True)), F.when(n >= floor(SKETCH * threshold), F.lit(False)))
    dealt = classes.select("uid", "n", "sketch", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("whole"))
    own = F.when(whole, F.transform("sketch", lambda v: F.xxhash64(v))).otherwise(F.slice("sketch", 1, INDEXED))
    single = dealt.select("uid", "n", "whole", F.explode(own).alias("v"))
    often = single.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    k = F.when(whole, n).otherwise(F.least(n, F.lit(INDEXED)))
    # As many values as can be missing from the other set or sketch, and one more; values of one document only fill their share of these.
    prefix = F.when(whole, n - F.ceil(n * round(100 * threshold) / 100) + 1).otherwise(k - sure_overlap(threshold) + 1)
    ranked = single.join(often, "v").groupBy("uid", "n", "whole").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
    room = F.greatest(F.lit(0), prefix - (k - F.size("shared"))).cast("int")
    chosen = ranked.select("uid", F.slice("shared", F.lit(1), room).alias("x")).filter(F.size("x") > 0)
    return chosen.join(classes, "uid").select(F.explode("x.v").alias("v"), "uid", "n", "sketch")


def least_estimate(percent: int) -> float:
    """The estimates of linked sets lie above this: 4.5 deviations below the threshold."""
    t = percent / 100
    return t - 4.5 * (t * (1 - t) / SKETCH) ** 0.5


def estimated(a: Column, b: Column) -> Column:
    """The likeness of two sets from their hashes up to the lower of the two sketches' ends, up to which both are known."""
    end = lambda x: F.when(F.size(x) >= SKETCH, F.element_at(x, -1))
    cut = F.least(F.coalesce(end(a), end(b)), F.coalesce(end(b), end(a)))
    known = lambda x: F.size(F.filter(x, lambda v: cut.isNull() | (v <= cut)))
    common = F.size(F.array_intersect(a, b))  # all below the cut
    return common / (known(a) + known(b) - common)


def short_list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of the classes of lists (entries) of up to SHORT_LIST."""
    t = percent / 100
    a, b = entries.alias("a"), entries.alias("b")
    near = (F.col("a.v") == F.col("b.v")) & (F.col("a.uid") < F.col("b.uid")) & (F.least("a.n", "b.n") >= t * F.greatest("a.n", "b.n"))
    likely = estimated(F.col("a.sketch"), F.col("b.sketch")) >= least_estimate(percent)
    return a.join(b, near).filter(likely).select(F.col("a.uid").alias("a"), F.col("b.uid").alias("b")).distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    values, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[back] > 1
    row, column = np.repeat(np.arange(n), [len(s) for s in sets])[shared], (np.cumsum(times > 1) - 1)[back[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int((times > 1).sum()), 2048):  # values in slices, so the dense matrix stays small
        i, j = np.searchsorted(column, [low, low + 2048])
        x = np.zeros((n, min(2048, column[j - 1] - low + 1 if j > i else 1)), np.float32)
        x[row[i:j], column[i:j] - low] = 1
        out += x @ x.T
    return out


def _spanning(uids: np.ndarray, link: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of a boolean matrix; with two sides, links between them only."""
    if side.any():
        link = link & (side[:, None] != side[None, :])
    out, free = [], np.ones(len(uids), bool)
    for start in range(len(uids)):
        if not free[start]:
            continue
        free[start], queue = False, [start]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(link[at] & free)
            free[new] = False
            queue += new.tolist()
            out += [(int(uids[at]), int(uids[k])) for k in new]
    return out


def sketch_links(sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs that are likely by the estimate of short lists (estimated)."""
    common = _common(sketches)
    ends = np.array([s[-1] for s in sketches])
    order = np.argsort(ends)
    whole = np.array([len(s) < SKETCH for s in sketches])
    known = np.empty(common.shape, np.float32)  # of each row's set, the hashes up to the end of each column's
    for k, s in enumerate(sketches):
        known[k, order] = np.searchsorted(s, ends[order], "right")
        known[k, whole] = len(s)
    return common / (known + known.T - common).astype(np.float64) >= least_estimate(percent)


def set_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    common, size = _common(sets), np.array([len(s) for s in sets], np.float32)
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def _compare_sketches(payload: list, percent: int, width: int) -> np.ndarray:
    return sketch_links([np.array(s, np.int64) for s in payload], percent)


def _compare_texts(payload: list, percent: int, width: int) -> np.ndarray:
    return set_links([shingles(t, width) for t in payload], percent)


def unit_tasks(entries: DataFrame, percent: int) -> DataFrame:
    """entries (v, uid, n, ...) dealt to tasks: with side and task instead of v and n.

    A v that fits a unit is one task. Others are cut by size class and hash, and each pair of units that can hold links is a task."""
    step = float(np.log(100 / percent))
    weight = F.greatest(F.ceil(F.count("*") / UNIT_ROWS), F.ceil(F.sum("n") / UNIT_WEIGHT)).cast("int")
    whole = entries.groupBy("v").agg(weight.alias("parts"))
    # Linked sets lie in one size class or in neighbouring ones.
    sized = entries.join(whole, "v").withColumn("c", F.when(F.col("parts") == 1, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / step)).cast("int"))
    small = sized.filter("parts = 1").withColumn("side", F.lit(0)).withColumn("task", F.xxhash64("v", F.lit(0)))
    large = sized.filter("parts > 1")
    units = large.groupBy("v", "c").agg(weight.alias("units"))
    above = units.select("v", (F.col("c") - 1).alias("c"), F.col("units").alias("above"))
    below = units.select("v", (F.col("c") + 1).alias("c"), F.col("units").alias("below"))
    known = large.join(units.join(above, ["v", "c"], "left").join(below, ["v", "c"], "left"), ["v", "c"]).withColumn("u", F.pmod(F.xxhash64("uid"), F.col("units")).cast("int"))
    numbers = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    u, c = F.col("u"), F.col("c")
    place = lambda low, i, high, j, side: F.struct(low.alias("c1"), i.alias("u1"), high.alias("c2"), j.alias("u2"), side.cast("int").alias("side"))
    places = F.concat(
        F.transform(numbers(F.col("units")), lambda k: place(c, F.least(u, k), c, F.greatest(u, k), F.when(u > k, 1).otherwise(0))),
        F.transform(numbers(F.col("above")), lambda k: place(c, u, c + 1, k, F.lit(0))),
        F.transform(numbers(F.col("below")), lambda k: place(c - 1, k, c, u, F.lit(1))),
    )
    dealt = known.withColumn("p", F.explode(places)).withColumn("side", F.col("p.side")).withColumn("task", F.xxhash64("v", "p.c1", "p.u1", "p.c2", "p.u2"))
    rest = [x for x in entries.columns if x not in ("v", "n")]
    return small.select(*rest, "side", "task").unionByName(dealt.select(*rest, "side", "task"))


def task_links(dealt: DataFrame, payload: str, compare, percent: int, width: int) -> DataFrame:
    """Spanning links (a, b) of each task of dealt (uid, side, task, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list) -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            return _spanning(np.array([r[0] for r in rows]), compare([r[2] for r in rows], percent, width), np.array([r[1] for r in rows]))

        at, held, found = None, [], []
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                for row in zip(*(part.column(c).to_pylist() for c in ("task", "uid", "side", payload)), strict=True):
                    if row[0] != at:
                        found += links(held)
                        at, held = row[0], []
                    held.append(row[1:])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found = []
        found += links(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.select("uid", "side", "task", payload).repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 80) -> DataFrame:
    """A row for each document: uid (its number in this run), doc_id, n_shingles, component_id, keep.

    width: words of a shingle; percent: least likeness of linked sets, of 100."""
    return duplicate_classes(base_table(docs, text, doc_id, width), width, percent)


def without_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """docs, one of each component: the row of the least doc_id."""
    base = base_table(docs, text, doc_id, width, keep=True)
    kept = duplicate_classes(base, width, percent).filter("keep").select("uid")
    return base.select("uid", "row").join(kept, "uid", "left_semi").select("row.*")


def base_table(docs: DataFrame, text: str, doc_id: str, width: int, keep: bool = False) -> DataFrame:
    """uid, doc_id, text, n, signature and sketch of each row, in the shared folder; with keep=True also row, all its columns."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")] if keep else []))
    base = materialize(sketched(rows, width), "sketches")
    if keep:
        base = base.withColumn("row", F.struct(*[(F.col("text") if c == text else F.col("rest")[c]).alias(c) for c in docs.columns])).drop("rest")
    return base


def duplicate_classes(base: DataFrame, width: int, percent: int) -> DataFrame:
    groups = base.filter("n > 0").groupBy("signature").agg(F.min("uid").alias("uid"))
    classes = base.select("uid", "n", "sketch").join(groups.select("uid"), "uid", "left_semi")
    entries = materialize(list_entries(materialize(classes, "classes"), percent / 100), "entries")
    length = entries.groupBy("v").agg(F.count("*").alias("m"))
    short, long_ = (entries.join(length.filter(c).select("v"), "v", "left_semi") for c in (f"m > 1 AND m <= {SHORT_LIST}", f"m > {SHORT_LIST}"))
    likely = short_list_pairs(short, percent).unionByName(task_links(unit_tasks(long_, percent), "sketch", _compare_sketches, percent, width))
    # Any link lies within a component of the likely pairs.
    suspects = components(likely)
    suspects = suspects.unionByName(suspects.select(F.col("root").alias("node"), "root").distinct())
    members = base.select("uid", "n", "text").join(suspects.select(F.col("node").alias("uid"), F.col("root").alias("v")), "uid")
    links = task_links(unit_tasks(members, percent), "text", _compare_texts, percent, width)
    rooted = components(links)
    own = base.select("uid", "doc_id", "n", "signature").join(groups.select("signature", F.col("uid").alias("class")), "signature", "left")
    placed = own.join(rooted.select(F.col("node").alias("class"), "root"), "class", "left")
    placed = placed.select("uid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "class")).otherwise(F.col("uid")).alias("root"))
    # The least id, nulls last, and of equal ids the first row.
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    out = placed.join(first, "root")
    return out.select("uid", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("uid") == F.col("first.uid")).alias("keep"))
