"""Character n-gram models with modified Kneser-Ney smoothing: counted by Spark, looked up in sorted hash arrays. The spelling model of toxicity;
the models of quality rules, one for each language, are in byte_model.

Tasks count 4-grams of a 43-letter alphabet (char_codes) by group and send each distinct one once; Spark adds them up and
derives the lower orders' continuation counts with aggregates; discounts and back-off weights follow on the driver. The model is bounded by the
alphabet, not by the corpus: 43^4 4-grams for each of at most MOST_GROUPS groups (toxicity has one), so it may be collected and broadcast.
Each n-gram's key (group, order, gram) is mixed to 64 bits, one to one, and the keys are kept sorted beside their
probabilities and back-off weights; a batch looks its distinct n-grams up by binary search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.char_codes import ORDER, SIZE, grams
from lodestone.llm.common import release_memory

#: Groups with a model of their own; all others share one. Bounds the model.
MOST_GROUPS = 32
POOLED = ""


def key_of(group: np.ndarray | int, order: int, gram: np.ndarray) -> np.ndarray:
    """64-bit keys: a one-to-one mix of (group, order, gram)."""
    x = (np.asarray(gram, np.uint64) | np.uint64(order << 24)) | (np.asarray(group, np.uint64) << np.uint64(32))
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


@dataclass
class HashedModel:
    """groups: name -> number. keys, sorted, with log10 probability (n-grams) and log10 back-off (contexts)."""

    groups: dict[str, int]
    gram_keys: np.ndarray
    gram_logp: np.ndarray
    context_keys: np.ndarray
    context_logb: np.ndarray
    #: Tells models apart in a worker that has met several.
    stamp: str = field(default_factory=lambda: uuid.uuid4().hex)

    def group(self, name: str | None) -> int:
        return self.groups.get(name or POOLED, self.groups.get(POOLED, 0))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def log10(self, group: int, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each 4-gram's last character after its first three."""
        out, open_, off = np.zeros(len(gram)), np.arange(len(gram)), np.zeros(len(gram))
        for order in range(ORDER, 0, -1):
            g = gram[open_] % SIZE**order
            seen, logp = self._find(self.gram_keys, self.gram_logp, key_of(group, order, g))
            out[open_[seen]] = off[open_[seen]] + logp[seen]
            open_, g = open_[~seen], g[~seen]
            has, logb = self._find(self.context_keys, self.context_logb, key_of(group, order, g // SIZE))
            off[open_] += np.where(has, logb, 0)
        out[open_] = off[open_] - np.log10(SIZE)
        return out


def gram_counts(docs: DataFrame, group: str, text: str, take=None, letters_only: bool = False) -> DataFrame:
    """(group, gram, n): how often each 4-gram comes in the texts of a group. take(text): whether a text counts. letters_only: 4-grams of letters and white space alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def fold(name: str) -> None:
            ids = np.concatenate([i for i, _ in held[name]])
            order = np.argsort(ids, kind="stable")
            ids, n = ids[order], np.concatenate([n for _, n in held[name]])[order]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            held[name] = [(ids[first], np.add.reduceat(n, first))]
            size[name] = len(first)

        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                by: dict[str, list] = {}
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if t and (take is None or take(t)):
                        by.setdefault(name or POOLED, []).append(grams(t, letters_only))
                for name, found in by.items():
                    held.setdefault(name, []).append(np.unique(np.concatenate(found), return_counts=True))
                    size[name] = size.get(name, 0) + len(held[name][-1][0])
                    if size[name] > 500_000 and len(held[name]) > 1:
                        fold(name)
        for name in held:
            fold(name)
            ids, n = held[name][0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(n, pa.int64())], names=["group", "gram", "n"])

    counted = docs.select(F.col(group).alias("group"), F.col(text).alias("text")).mapInArrow(run, "group string, gram int, n long")
    return counted.groupBy("group", "gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> HashedModel:
    """The smoothed model of each of the groups with the most characters, and a pooled one for all others."""
    largest = counts.groupBy("group").agg(F.sum("n").alias("n")).filter(F.col("group") != POOLED).orderBy(F.desc("n"), "group").limit(MOST_GROUPS - 1).collect()
    names = {r["group"]: k + 1 for k, r in enumerate(largest)}
    # The pooled model learns from every group: a text in a rare or unknown language meets all that is known.
    number = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("group")], F.lit(0)) if names else F.lit(0)
    per = counts.select(F.explode(F.array_distinct(F.array(number, F.lit(0)))).alias("group"), "gram", "n").groupBy("group", "gram").agg(F.sum("n").alias("n"))
    levels, table = [], per.select("group", F.lit(ORDER).alias("order"), F.col("gram").cast("long").alias("gram"), "n")
    levels.append(table)
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        table = table.groupBy("group", (F.col("gram") % SIZE**order).alias("gram")).agg(F.count("*").alias("n")).select("group", F.lit(order).alias("order"), "gram", "n")
        levels.append(table)
    grams_ = levels[0]
    for t in levels[1:]:
        grams_ = grams_.unionByName(t)
    rows = grams_.toArrow()  # at most MOST_GROUPS * 43^4 rows, whatever the corpus
    group, order, gram, n = (rows.column(c).to_numpy() for c in ("group", "order", "gram", "n"))
    model = _smooth({POOLED: 0} | names, group.astype(np.int64), order.astype(np.int64), gram.astype(np.int64), n.astype(np.float64))
    del rows, group, order, gram, n
    release_memory()
    return model


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken from counts of 1, 2 and 3 or more, from the counts of counts; absolute discounting where these are too few."""
    c = [int((n == k).sum()) for k in range(1, 5)]
    if not all(c[:3]):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = c[0] / (c[0] + 2 * c[1])
    d = [1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]]
    return np.array([0.0, *(min(max(x, 0.1), k + 0.9) for k, x in enumerate(d))])


def smoothed_levels(gram: np.ndarray, n: np.ndarray, base: int = SIZE, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1: n-grams and their log10 probabilities, contexts and their log10 back-off weights, from distinct n-grams of the highest order and their counts."""
    sort = np.argsort(gram)
    levels = [(gram[sort], n[sort])]
    for k in range(order - 1, 0, -1):  # continuation counts: distinct characters before
        ids, c = np.unique(levels[-1][0] % base**k, return_counts=True)
        levels.append((ids, c.astype(np.float64)))
    yield from _levels(levels[::-1], base)


def _levels(levels: list[tuple[np.ndarray, np.ndarray]], base: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same from the counts of each order, sorted by n-gram."""
    lower_keys, lower_p = np.zeros(1, np.int64), np.array([1 / base])  # order 0: all alike
    for k, (ids, c) in enumerate(levels, 1):
        if not len(ids):
            yield ids, np.empty(0), ids, np.empty(0)
            continue
        d = discounts(c)[np.minimum(c, 3).astype(int)]
        context, start = np.unique(ids // base, return_index=True)
        total = np.add.reduceat(c, start)
        kept = np.add.reduceat(d, start) / total
        of = np.searchsorted(context, ids // base)
        below = ids % base ** (k - 1)
        p = (c - d) / total[of] + kept[of] * lower_p[np.searchsorted(lower_keys, below)]
        yield ids, np.log10(p), context, np.log10(kept)
        lower_keys, lower_p = ids, p


def _smooth(groups: dict[str, int], group, order, gram, n) -> HashedModel:
    keys, logp, ckeys, logb = [], [], [], []
    for g in np.unique(group):
        levels = []
        for k in range(1, int(order[group == g].max()) + 1):
            mine = (group == g) & (order == k)
            sort = np.argsort(gram[mine])
            levels.append((gram[mine][sort], n[mine][sort]))
        for k, (ids, p, context, kept) in enumerate(_levels(levels, SIZE), 1):
            keys.append(key_of(int(g), k, ids))
            logp.append(p)
            ckeys.append(key_of(int(g), k, context))
            logb.append(kept)
    empty = [np.empty(0, np.uint64)], [np.empty(0)]
    a, b = np.concatenate(keys or empty[0]), np.concatenate(logp or empty[1])
    x, y = np.concatenate(ckeys or empty[0]), np.concatenate(logb or empty[1])
    s, t = np.argsort(a), np.argsort(x)
    return HashedModel(groups, a[s], b[s].astype(np.float32), x[t], y[t].astype(np.float32))
