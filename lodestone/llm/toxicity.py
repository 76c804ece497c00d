"""Toxicity: restore obfuscated words (deobfuscation), then score the restored text.

The character language model is counted over all documents (kneser_ney). Word weights come from labelled rows: at most about `train_rows` of
them, chosen by a hash, enter. A feature is a restored word or a prefix of 4 to 6 letters of one, as inflected words share these.
For each feature of so many toxic training texts that chance alone would hardly keep it out of all clean ones, its weight is the lower confidence bound of the
share of toxic ones among the texts that have it; on the toxic side a feature counts once for each distinct pair of neighbour words, so copies of one text
don't make all its words suspect. Weights below 0.5 are dropped, and below 0.9 those of
prefixes, which clean words may share. A text's score is the chance that at least
one of its distinct words is toxic, with a small floor.

Defined results: null and empty texts get the floor; equal texts get equal scores; very long texts, words and spelled-out spans are read whole; without toxic labels every score is the floor; an empty table
gives an empty one;
other columns stay, and columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches, materialize, worker_cached
from lodestone.llm.deobfuscation import Restorer
from lodestone.llm.kneser_ney import HashedModel, fit, gram_counts

FLOOR = 0.02
#: Toxic texts, and places, that a feature must have at least.
LEAST = 3
_WORD = re.compile(r"[^\W\d_]+")


def restorer(shared) -> Restorer:
    """One restorer for each worker process and model."""
    model = shared.value
    return worker_cached(("restorer", model.stamp), lambda: Restorer(model))


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


def spelling_model(docs: DataFrame, text: str = "text") -> HashedModel:
    """The language model of lower-case letters, over all texts. Look-alikes and separators are left out, or obfuscated words would teach it their own spelling."""
    return fit(gram_counts(docs.select(F.lit(None).cast("string").alias("group"), F.lower(text).alias("text")), "group", "text", letters_only=True))


def learn(labelled: DataFrame, shared_model, train_rows: int = 20_000, z: float = 1.64) -> dict[str, float]:
    """feature -> weight, from labelled (text, toxic), toxic 0 or 1."""
    known = labelled.filter(F.col("text").isNotNull() & F.col("toxic").isNotNull())
    total = known.count()
    share = min(1.0, train_rows / max(1, total))
    # A hash as a number from 0 to 1, fine enough for any share.
    taken = known.filter(F.xxhash64("text").cast("double") / 2.0**64 + 0.5 <= share).select("text", "toxic")

    def toxic_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = restorer(shared_model)
        for batch in batches:
            for at in range(0, batch.num_rows, 20):
                rows = []
                for t in batch.slice(at, 20).column("text").to_pylist():
                    tokens = fix.text(t).split()
                    near = ["", *tokens, ""]
                    rows += {(f, hash_text(t), hash_text(f"{near[k]} {near[k + 2]}")) for k, token in enumerate(tokens) for w in _WORD.findall(token) for f in features(w)}
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["f", "d", "c"])

    toxic = taken.filter("toxic = 1").select("text")
    counted = toxic.mapInArrow(toxic_side, "f string, d long, c long").groupBy("f").agg(F.count_distinct("d").alias("d"), F.count_distinct("c").alias("c"))
    counted = materialize(counted, "features")
    # So many toxic texts and no clean one: by chance alone, less than one feature is expected to have that.
    share_toxic = min(0.5, toxic.count() / max(1, taken.count()))
    least = max(LEAST, math.ceil(math.log(max(1, counted.count())) / -math.log(share_toxic))) if share_toxic else LEAST
    often = {r["f"]: min(r["d"], r["c"]) for r in counted.filter(f"d >= {least} AND c >= {least}").collect()}  # bounded by train_rows
    wanted = labelled.sparkSession.sparkContext.broadcast(set(often))

    def clean_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix, want, count = restorer(shared_model), wanted.value, Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                words = set(_WORD.findall(fix.text(t)))
                count.update({f for w in words for f in features(w)} & want)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["f", "n"])

    clean = {r["f"]: r["n"] for r in taken.filter("toxic = 0").select("text").mapInArrow(clean_side, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    weights = {f: lower_bound(a, clean.get(f, 0), z) for f, a in often.items()}
    return {f: w for f, w in weights.items() if w >= (0.5 if f[0] == "=" else 0.9)}


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def lower_bound(hits: int, misses: int, z: float) -> float:
    """Wilson's lower confidence bound of hits / (hits + misses)."""
    n = hits + misses
    p = hits / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


class Suspects:
    """Finds the weighted words of a restored text: one pass of an automaton over all features."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.weights, self.automaton = weights, ahocorasick.Automaton()
        for stem in {f.lstrip("=") for f in weights}:
            self.automaton.add_word(stem, stem)
        if weights:
            self.automaton.make_automaton()

    def words(self, text: str) -> dict[str, float]:
        """Each distinct word with a weight, and its weight."""
        found: dict[str, float] = {}
        if not self.weights:
            return found
        for last, stem in self.automaton.iter(text):
            first = last + 1 - len(stem)
            if (first and text[first - 1].isalpha()) or not stem.isalpha():
                continue
            word = _WORD.match(text, first)[0]
            found[word] = max(self.weights.get(f, 0.0) for f in features(word))
        return found

    def score(self, text: str) -> float:
        clean = 1.0 - FLOOR
        for w in sorted(self.words(text).values()):
            clean *= 1.0 - w
        return 1.0 - clean


def score_toxicity(docs: DataFrame, shared_model, weights: dict[str, float], text: str = "text", restored: bool = False) -> DataFrame:
    """docs with score, and with restored=True the restored text."""
    new = {"score": T.DoubleType()} | ({"restored": T.StringType()} if restored else {})
    kept = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix, suspects = restorer(shared_model), Suspects(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                fixed = [fix.text(t or "") for t in part.column(text).to_pylist()]
                scores = [suspects.score(t) for t in fixed]
                columns = [pa.array(scores, pa.float64())] + ([pa.array(fixed, pa.string())] if restored else [])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(k, v) for k, v in new.items())]))


def toxicity(docs: DataFrame, labelled: DataFrame, text: str = "text", train_rows: int = 20_000, restored: bool = False) -> DataFrame:
    """docs with score. labelled: (text, toxic)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spelling_model(docs, text))  # bounded by the alphabet
    return score_toxicity(docs, shared, learn(labelled, shared, train_rows), text, restored)
