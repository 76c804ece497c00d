"""Near-duplicates of contained texts: a text and the same with a passage appended are the widest apart of linked pairs."""

import random

import numpy as np
import pytest

from lodestone.llm import minhash_dedup
from lodestone.llm.minhash_dedup import near_duplicates


def contained(rng, pairs):
    """Two texts for each (large, small): so many shingles of four words, the small text's all in the large one's."""
    rows = []
    for large, small in pairs:
        words = [f"w{rng.getrandbits(60):x}" for _ in range(large + 3)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: small + 3]))]
    return rows


def lost(spark, rows):
    """Pairs (2k, 2k + 1) that are not in one component."""
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return sum(got[k] != got[k + 1] for k in range(0, len(rows), 2))


def test_contained_sets_about_the_sketch_size_are_linked(spark):
    rng = random.Random(3)
    pairs = [(large, -(-large * percent // 100)) for large in range(66, 200, 2) for percent in (80, 81, 82, 83, 85)]
    assert lost(spark, contained(rng, pairs)) == 0


def test_short_contained_sets_are_linked(spark):
    rng = random.Random(4)
    pairs = [(large, -(-large * 80 // 100)) for large in [20] * 60 + list(range(2, 90))]
    assert lost(spark, contained(rng, pairs)) == 0


def test_the_index_overlap_is_that_of_contained_sets():
    from lodestone.llm.minhash_dedup import INDEXED, sure_overlap

    rng, least = np.random.default_rng(5), INDEXED
    for _ in range(20_000):
        values = rng.permutation(200)
        least = min(least, int((values[:INDEXED] < 160).sum()))  # of the large set's least, those of the small one
    assert sure_overlap(0.8) <= least and sure_overlap(1.0) == INDEXED


@pytest.mark.parametrize("large", [60, 70, 100, 500, 2000])
def test_long_lists_pass_contained_sets(large):
    rng = np.random.default_rng(large)
    for _ in range(400):
        values = rng.integers(-(2**63), 2**63, large)
        small, all_ = (np.sort(values[:n])[: minhash_dedup.SKETCH] for n in (-(-large * 4 // 5), large))
        assert minhash_dedup.sketch_links([small, all_], 80)[0, 1]


def test_lists_of_any_length_follow_one_rule(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    sets = []
    for _ in range(200):
        values = rng.integers(-(2**63), 2**63, rng.integers(2, 400))
        sets.append([np.sort(values[rng.random(len(values)) < rng.choice([0.7, 0.8, 0.9])])[: minhash_dedup.SKETCH] for _ in range(2)])
    sets = [p for p in sets if all(map(len, p))]
    frame = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(sets)], "k int, a array<bigint>, b array<bigint>")
    got = {r.k: r.e for r in frame.select("k", minhash_dedup.estimated(F.col("a"), F.col("b")).alias("e")).collect()}
    for k, p in enumerate(sets):
        assert (got[k] >= minhash_dedup.least_estimate(80)) == minhash_dedup.sketch_links(p, 80)[0, 1]
