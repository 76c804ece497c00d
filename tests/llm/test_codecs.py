"""SentencePiece codec, byte-level ids, packing and sharding against the libraries and plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.best_fit_packing import pack, token_pieces
from lodestone.llm.bpe_ids import PretokenTable
from lodestone.llm.grouping_ga import Solution, best_fit, crossover, evolve, from_genome, lower_bound
from lodestone.llm.sentencepiece_codec import WordTable, crossing_pieces, encode_decode
from lodestone.llm.shuffle_shards import block_sizes, matrix_row, shuffle_shards

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
texts = st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁ab'1é ß日😀<|endoftext|>"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def words():
    return WordTable(MODEL, 50)


@pytest.fixture(scope="module")
def pretokens():
    return PretokenTable(BPE, 50)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_marked_words_encode_as_the_library(words, text):
    ids, decoded = words.encode(text)
    whole = words.processor.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == whole
    assert decoded == words.processor.decode(whole)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pretokens_encode_as_the_library(pretokens, text):
    assert pretokens.encode_batch([text])[0] == pretokens.whole(text)


def test_special_string_and_odd_space(pretokens):
    for t in ["a<|endoftext|>b", "x\x1cy", "a  b", "  lead", "trail  ", "I'll 's ' s", "日本 語"]:
        assert pretokens.encode_batch([t])[0] == pretokens.whole(t)


def test_no_piece_crosses_markers(words):
    assert crossing_pieces(words.processor) == []


def test_encode_decode_keeps_rows_and_columns(docs, no_docs, words):
    out = encode_decode(docs, MODEL).collect()
    assert len(out) == docs.count() and {"uid", "score", "n"} <= set(out[0].asDict())
    for r in out:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == words.processor.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(r.ids) // 4
    assert encode_decode(no_docs, MODEL).count() == 0


def test_shards_are_exact_and_uniform(spark, docs, no_docs):
    out = shuffle_shards(docs, 3).collect()
    assert len(out) == 10
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [3, 3, 4] and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert shuffle_shards(no_docs, 3).count() == 0
    few = shuffle_shards(docs.limit(2), 5).collect()
    assert sorted(r.slot for r in few) == [0, 0]


def test_many_blocks_and_repeatable(spark):
    frame = spark.range(1000).repartition(7)
    runs = [{r.id: (r.shard, r.slot) for r in shuffle_shards(frame, 4, seed=s, block_rows=40).collect()} for s in (1, 2)]
    for run in runs:
        assert sorted(run.values()) == [(s, k) for s in range(4) for k in range(250)]
    assert runs[0] != runs[1]


def test_matrix_rows_sum_to_partitions_and_blocks():
    counts = np.array([5, 0, 17, 3, 40])
    sizes = block_sizes(65, 4, 6)
    matrix = np.array([matrix_row(counts, sizes, p, 3) for p in range(5)])
    assert (matrix.sum(axis=1) == counts).all() and (matrix.sum(axis=0) == sizes).all() and (matrix >= 0).all()


def test_matrix_is_hypergeometric():
    # Two partitions of 6 and 4 rows into blocks of 5: the first sends 3 to each on average.
    draws = [matrix_row(np.array([6, 4]), np.array([5, 5]), 0, s)[0] for s in range(4000)]
    assert abs(np.mean(draws) - 3) < 0.05 and abs(np.var(draws) - 6 * 4 * 5 * 5 / (10 * 10 * 9)) < 0.05


def check_packing(pieces, capacity):
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_places_every_piece(docs, no_docs):
    pieces = token_pieces(docs, BPE, capacity=64, ids=True)
    packed = pack(pieces, capacity=64, block_items=50).collect()
    assert len(packed) == pieces.count()
    n = check_packing(packed, 64)
    assert n <= -(-sum(r.length for r in packed) // 64) + 6
    long_ = sorted((r for r in packed if r.doc_id == 6), key=lambda r: r.piece)
    assert [r.piece for r in long_] == list(range(len(long_))) and all(r.length == 64 for r in long_[1:])
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in packed)
    empty = [r for r in packed if r.doc_id in (2, 3)]
    assert [r.length for r in empty] == [1, 1]
    assert pack(token_pieces(no_docs, BPE), 1024).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_evolution_is_valid_and_never_worse(lengths):
    lengths.sort(reverse=True)
    first = best_fit(Solution([], []), list(range(len(lengths))), lengths, 100)
    best = evolve(lengths, 100, [], 4, 10, 1)[0]
    assert sorted(i for b in best.bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) == f <= 100 for b, f in zip(best.bins, best.fills, strict=True))
    assert lower_bound(lengths, 100) <= len(best.bins) <= len(first.bins)
    again = from_genome(best.genome(len(lengths)), lengths)
    assert again.fitness() == best.fitness()


def test_crossover_keeps_each_item_once():
    import random

    lengths = sorted((random.Random(3).randint(1, 100) for _ in range(80)), reverse=True)
    a, b = (best_fit(Solution([], []), sorted(range(80), key=lambda i, s=s: (i * s) % 83), lengths, 100) for s in (5, 7))
    child = crossover(a, b, lengths, 100, random.Random(1))
    assert sorted(i for x in child.bins for i in x) == list(range(80)) and max(child.fills) <= 100
