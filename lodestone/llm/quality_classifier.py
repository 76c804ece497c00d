"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of a text.

Words `[^\\x20\\x09-\\x0D]+` are hashed to WORDS numbers, weighted by 1 + log of their count and scaled to a fixed length. A structure statistic is
a share or a size, put in one of BINS bins: letters in capitals, symbols, digits, exclamation and question marks, other scripts, mean length of words, distinct words, words within repeated
five-word windows, repeated lines, words on a line, words without a letter or digit, lines that end as sentences do. The metadata is the recorded number of
characters, where there is one. Pairs of all these interact by their factors.

The machine is fitted to at most about `train_rows` labelled rows, chosen by a hash of their key, which is no input of a score.

Defined results: null and empty texts are scored by their structure alone; equal texts with equal metadata get equal scores; texts of any length are read whole, with as many entries as
they have distinct words; without labelled rows every score is one half; an empty table gives an empty one; other columns stay, and a column named score is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches
from lodestone.llm.factorisation_machine import Sparse, fit, margins, sigmoid

WORDS, BINS, STATISTICS = 1 << 15, 16, 14
SIZE = STATISTICS * BINS + WORDS
#: Length of the word part of a row, and value of each bin.
WORD_PART, BIN_PART = 2.0, 0.5
#: Kinds of bytes: 1 capital, 2 small letter, 3 digit, 4 sentence mark, 5 exclamation or question mark, 6 other mark, 7 of another script, 0 white space.
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
for _c in range(33, 127):
    _KIND[_c] = _KIND[_c] or (4 if chr(_c) in ".,;:'\"()-" else 5 if chr(_c) in "!?" else 6)
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def repeated_windows(codes: np.ndarray, width: int = 5) -> float:
    """The share of words within windows that occur twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0.0
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ codes[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, which, often = np.unique(mixed, return_inverse=True, return_counts=True)
    inside = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(often[which] > 1)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + width, -1)
    return float((np.cumsum(inside[:-1]) > 0).mean())


def statistics(text: str, data: bytes, words: list[bytes], counts: Counter, recorded: int | None) -> list[float]:
    """Values from 0 to 1, in a fixed order; -1 where there is none. data: the text in UTF-8."""
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8)
    n, letters, shown = len(words), max(1, kinds[1] + kinds[2]), max(1, kinds[1:].sum())
    lines = [x for x in map(bytes.strip, data.split(b"\n")) if x]
    size = lambda x, most: min(1.0, math.log2(1 + x) / most)
    order = {w: k for k, w in enumerate(counts)}
    return [
        size(len(text), 20),
        kinds[1] / letters if n else -1,
        kinds[6] / shown if n else -1,
        kinds[3] / shown if n else -1,
        min(1.0, kinds[5] / n) if n else -1,
        kinds[7] / shown if n else -1,
        min(1.0, len(text) / n / 16) if n else -1,
        len(counts) / n if n else -1,
        repeated_windows(np.fromiter(map(order.__getitem__, words), np.int64, n)) if n else -1,
        1 - len(set(lines)) / len(lines) if lines else -1,
        size(n / len(lines), 12) if lines else -1,
        sum(c for w, c in counts.items() if not w.translate(None, _MARKS)) / n if n else -1,
        sum(x[-1] in b".!?" for x in lines) / len(lines) if lines else -1,
        size(recorded, 20) if recorded is not None and recorded >= 0 else -1,
    ]


def entries(text: str | None, recorded: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text, and their values."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are cut at the six characters of ASCII white space, and no others
    counts = Counter(words)
    # Bin 0 means that there is no value.
    bins = [k * BINS + (0 if v < 0 else 1 + min(BINS - 2, int(v**0.5 * (BINS - 1)))) for k, v in enumerate(statistics(text, data, words, counts, recorded))]
    if not counts:
        return np.array(bins, np.int64), np.full(len(bins), BIN_PART)
    at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORDS
    weight = np.log(np.fromiter(counts.values(), np.float64, len(counts))) + 1
    found, which = np.unique(at, return_inverse=True)
    weight = np.bincount(which, weights=weight)
    weight *= WORD_PART / np.sqrt((weight**2).sum())
    return np.concatenate([bins, found + STATISTICS * BINS]), np.concatenate([np.full(len(bins), BIN_PART), weight])


def sample_rows(labelled: DataFrame, key: str, train_rows: int) -> DataFrame:
    """Labelled rows, at most about train_rows, by a hash of their key."""
    known = labelled.filter(F.col("label").isNotNull())
    share = min(1.0, train_rows / max(1, known.count()))
    return known.filter(F.xxhash64(key, F.lit(1)).cast("double") / 2.0**64 + 0.5 <= share)


def learn(labelled: DataFrame, key: str, train_rows: int = 20_000, updates: int = 30) -> dict[str, np.ndarray]:
    """Weights from labelled (key, text, recorded, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [entries(t, r) for t, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["label", "deal", "features", "values"])

    taken = sample_rows(labelled, key, train_rows).select("text", F.col("recorded").cast("long"), F.col("label").cast("double"), F.xxhash64(key, F.lit(2)))
    return fit(taken.mapInArrow(run, "label double, deal long, features binary, values binary"), SIZE, updates)[0]


def score_quality(docs: DataFrame, weights: dict[str, np.ndarray], text: str = "text", recorded: str = "n_chars") -> DataFrame:
    """docs without the text and the recorded length, with score."""
    kept = [f for f in docs.schema.fields if f.name not in (text, recorded, "score")]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [entries(t, r) for t, r in zip(part.column(text).to_pylist(), part.column(recorded).to_pylist())]
                starts = np.concatenate([[0], np.cumsum([len(f) for f, _ in found[:-1]])]).astype(np.int64)
                z, _ = margins(shared.value, Sparse(np.concatenate([f for f, _ in found]), np.concatenate([v for _, v in found]), starts))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(sigmoid(z))], names=[*names, "score"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", train_rows: int = 20_000) -> DataFrame:
    """docs (text, n_chars, ...) without these two, with score. labelled: (key, text, recorded, label 0 or 1)."""
    bound_batches(docs.sparkSession)
    return score_quality(docs, learn(labelled, key, train_rows))
