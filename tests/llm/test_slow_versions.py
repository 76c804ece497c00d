"""Registered queries against slow versions, and what training and evolution gain."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import registry
from lodestone.llm.grouping_ga import Solution, best_fit, evolve, lower_bound
from lodestone.llm.maxent_lm import CLASSES, SKIPS, first_weights, gradient, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, ids string"
TEXTS = [None, "", "one", "Line one\nline two\n", "é 日本 😀 abc", "word " * 3000, "same text", "same text", "a b c d e f g h i j k l m n", " \t\n "]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k * 3 + 1, t, "en", "s", None if t is None else len(t), "x", "y", "z") for k, t in enumerate(TEXTS * 12)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), {r[0]: r[1] or "" for r in rows}


def test_shards_have_the_slow_sizes_and_digests(spark, folder):
    place, texts = folder
    got = registry.op3_shards(spark, place).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {k: (len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts.items()} and len(got) == len(texts)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) == set(range(40))
    assert {len(s) for s in shards.values()} == {len(texts) // 40} and {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_fingerprints_are_of_the_slow_edits(spark, folder):
    place, texts = folder
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in registry.op5_fingerprints(spark, place).collect()}
    prints = {}
    for k, own in enumerate(order):
        text, following = texts[own], texts[order[(k + 1) % len(order)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert got[own].n_chars == len(text) and got[own].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(text, set()).add(got[own].fingerprint)
        prints.setdefault(edited, set()).add(got[own].edited_fingerprint)
        assert 0 <= got[own].near_edited <= 1 and 0 <= got[own].near_next <= 1
        if edited == text:
            assert got[own].near_edited == 1
    assert all(len(p) == 1 for p in prints.values()) and len(got) == len(order)


def test_ids_are_those_of_the_library(spark, folder):
    import public_tokenizers
    import sentencepiece

    place, texts = folder
    codec = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for r in registry.op2_sentencepiece(spark, place).collect():
        ids = codec.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def test_evolution_packs_triplets_tighter_than_best_fit():
    """Forty bins that three items each fill to the brim: the optimum is known, and best fit misses it."""
    rng, lengths = random.Random(4), []
    for _ in range(40):
        a = rng.randrange(380, 490)
        b = rng.randrange(250, (1000 - a) // 2)
        lengths += [a, b, 1000 - a - b]
    lengths.sort(reverse=True)
    plain = best_fit(Solution([], []), list(range(len(lengths))), lengths, 1000)
    people = evolve(lengths, 1000, [], population=10, generations=60, seed=3)
    bins = min(len(p.bins) for p in people)
    assert lower_bound(lengths, 1000) == 40 <= bins < len(plain.bins)
    assert all(Counter(i for b in p.bins for i in b) == Counter(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 1000 for b in p.bins) for p in people)


def test_training_gains_over_its_start(spark):
    rng = np.random.default_rng(2)
    ctx = rng.integers(0, 40 * SKIPS, 4000)
    classes = (ctx // SKIPS * 7 + (ctx % SKIPS) * 3 + (rng.random(4000) < 0.2) * rng.integers(0, CLASSES, 4000)) % CLASSES
    counted = Counter(zip(ctx.tolist(), classes.tolist()))
    rows = [(c, k, n) for (c, k), n in counted.items()]
    weights = train(spark.createDataFrame(rows, "ctx int, class int, n long"))
    arrays = [np.array(x) for x in zip(*rows)]
    both = np.zeros((len(weights["before"]), CLASSES))
    np.add.at(both, (arrays[0] // SKIPS, arrays[1]), arrays[2])
    start, end = (gradient({k: w.astype(np.float64) for k, w in x.items()}, *arrays)[1] for x in (first_weights(both), weights))
    assert abs(end) < 0.97 * abs(start)
