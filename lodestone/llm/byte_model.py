"""Byte n-gram models with modified Kneser-Ney smoothing, one for each group of texts: counted by Spark, smoothed by a task for each group, looked up in sorted hash arrays.

Texts are lower-cased UTF-8 bytes with all digits alike and all white space alike, so every script has letters of its own. Tasks count 4-grams by group and send
each distinct one once; Spark adds them up; a group's counts meet in one task, which derives continuation counts, discounts and back-off weights and
writes the model as four pairs of arrays. A group's counts are its distinct 4-grams, so they don't grow with its text but towards a limit of its script. The model is
a row of a table. It never comes to the driver: whoever scores texts joins them with the rows of their groups.

Each order's n-grams are 32-bit numbers, mixed one to one to hashes, and sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.kneser_ney import POOLED, smoothed_levels

ORDER, BASE = 4, 256
_FOLD = bytes(0x20 if b in b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" and b < 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
MODEL = "group string, texts long, bytes long, keys array<binary>, logp array<binary>, contexts array<binary>, logb array<binary>"


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def byte_grams(text: str) -> np.ndarray:
    """The 4-gram that ends at each byte, the oldest byte highest; the text begins with three zero bytes."""
    c = np.frombuffer(b"\x00\x00\x00" + folded(text), np.uint8).astype(np.uint32)
    return c[:-3] << np.uint32(24) | c[1:-2] << np.uint32(16) | c[2:-1] << np.uint32(8) | c[3:]


def hashed(gram: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 32-bit numbers."""
    x = gram.astype(np.uint32)
    with np.errstate(over="ignore"):
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
        return x ^ (x >> np.uint32(16))


class ByteModel:
    """For each order: hashes of n-grams with log10 probabilities, and hashes of contexts with log10 back-off weights, both sorted."""

    def __init__(self, keys: list[bytes], logp: list[bytes], contexts: list[bytes], logb: list[bytes]):
        self.grams = [(np.frombuffer(k, np.uint32), np.frombuffer(v, np.float32)) for k, v in zip(keys, logp, strict=True)]
        self.contexts = [(np.frombuffer(k, np.uint32), np.frombuffer(v, np.float32)) for k, v in zip(contexts, logb, strict=True)]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each 4-gram's last byte after its first three."""
        gram = gram.astype(np.uint32)
        out, open_, off = np.zeros(len(gram)), np.arange(len(gram)), np.zeros(len(gram))
        for order in range(ORDER, 0, -1):
            g = gram[open_] & np.uint32(2 ** (8 * order) - 1)
            seen, logp = self._find(self.grams[order - 1], hashed(g))
            out[open_[seen]] = off[open_[seen]] + logp[seen]
            open_, g = open_[~seen], g[~seen]
            has, logb = self._find(self.contexts[order - 1], hashed(g >> np.uint32(8)))
            off[open_] += np.where(has, logb, 0)
        out[open_] = off[open_] - np.log10(BASE)
        return out


def smoothed(gram: np.ndarray, n: np.ndarray) -> dict[str, list[bytes]]:
    """The arrays of a model from distinct 4-grams and their counts."""
    out: dict[str, list[bytes]] = {"keys": [], "logp": [], "contexts": [], "logb": []}
    for ids, logp, contexts, logb in smoothed_levels(gram.astype(np.int64), n.astype(np.float64), BASE, ORDER):
        for (a, b), (k, v) in zip((("keys", "logp"), ("contexts", "logb")), ((ids, logp), (contexts, logb)), strict=True):
            h = hashed(k)
            sort = np.argsort(h)
            out[a].append(h[sort].tobytes())
            out[b].append(v[sort].astype(np.float32).tobytes())
    return out


#: Numbers of the rows that count a group's texts and its bytes, beside those of its 4-grams.
TEXTS, BYTES = -1, -2


def counts(docs: DataFrame, group: str, text: str, take: Callable[[str], bool]) -> DataFrame:
    """(group, gram, n): how often each 4-gram comes in the texts of a group that `take` accepts; TEXTS: how many these are; BYTES: bytes of all its texts. Null groups count as POOLED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        seen: dict[str, list[int]] = {}

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
                    told = seen.setdefault(name or POOLED, [0, 0])
                    told[1] += len(t or "")
                    if t and take(t):
                        told[0] += 1
                        by.setdefault(name or POOLED, []).append(byte_grams(t))
                for name, found in by.items():
                    held.setdefault(name, []).append(np.unique(np.concatenate(found), return_counts=True))
                    size[name] = size.get(name, 0) + len(held[name][-1][0])
                    if size[name] > 500_000 and len(held[name]) > 1:
                        fold(name)
        for name, (texts, total) in seen.items():
            ids, n = np.empty(0, np.int64), np.empty(0, np.int64)
            if name in held:
                fold(name)
                ids, n = held[name][0]
            ids, n = np.r_[ids.astype(np.int64), TEXTS, BYTES], np.r_[n.astype(np.int64), texts, total]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["group", "gram", "n"])

    return docs.select(F.col(group).alias("group"), F.col(text).alias("text")).mapInArrow(run, "group string, gram long, n long").groupBy("group", "gram").agg(F.sum("n").alias("n"))


def models(counted: DataFrame, least_texts: int) -> DataFrame:
    """A row for each group, of the columns MODEL; without arrays for groups of fewer than least_texts texts. POOLED is the group of all texts."""
    # A text in a rare or unknown language meets all that is known: the pooled model learns from every group.
    both = counted.select(F.explode(F.array_distinct(F.array("group", F.lit(POOLED)))).alias("group"), "gram", "n").groupBy("group", "gram").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if at is None:
                return
            gram, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            texts, size = (int(n[gram == k].sum()) for k in (TEXTS, BYTES))
            own = gram >= 0
            rows = smoothed(gram[own], n[own]) if texts >= least_texts or at == POOLED else dict.fromkeys(("keys", "logp", "contexts", "logb"))
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.binary())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((at, texts, size, *rows.values()), kinds, strict=True)], names=["group", "texts", "bytes", *rows])

        for batch in batches:
            group, gram, n = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            ends = [*(np.flatnonzero(np.diff(pa.compute.index_in(group, group.unique()).to_numpy())) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            low = 0
            for high in ends:
                name = group[low].as_py()
                if name != at:
                    yield from close()
                    at, parts = name, []
                parts.append((gram[low:high], n[low:high]))
                low = high
        yield from close()

    return both.repartition("group").sortWithinPartitions("group").mapInArrow(run, MODEL)
