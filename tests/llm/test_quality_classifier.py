"""The factorisation machine against plain sums, and the quality classifier on held-out rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import factorisation_machine as M
from lodestone.llm.quality_classifier import BINS, SIZE, STATISTICS, entries, learn, quality, repeated_windows, score_quality


def plain_margin(weights, features, values):
    """All pairs, one by one."""
    z = float(weights["bias"][0, 0]) + sum(float(weights["linear"][i, 0]) * v for i, v in zip(features, values))
    for a in range(len(features)):
        for b in range(a):
            z += float(weights["factors"][features[a]].astype(float) @ weights["factors"][features[b]].astype(float)) * values[a] * values[b]
    return z


def random_rows(n, size, seed):
    rng = np.random.default_rng(seed)
    rows = [(rng.choice(size, k, replace=False), rng.normal(size=k)) for k in rng.integers(1, 12, n)]
    starts = np.concatenate([[0], np.cumsum([len(f) for f, _ in rows[:-1]])])
    return rows, M.Sparse(np.concatenate([f for f, _ in rows]), np.concatenate([v for _, v in rows]), starts), rng.integers(0, 2, n).astype(float)


def test_linear_time_sum_is_that_of_all_pairs():
    weights = {k: (w + np.random.default_rng(1).normal(0, 0.3, w.shape)).astype(np.float32) for k, w in M.first_weights(40).items()}
    rows, sparse, _ = random_rows(50, 40, 2)
    assert np.allclose(M.margins(weights, sparse)[0], [plain_margin(weights, f, v) for f, v in rows], atol=1e-5)


def test_gradient_is_the_slope_of_the_loss():
    weights = {k: (w + np.random.default_rng(3).normal(0, 0.3, w.shape)).astype(np.float64) for k, w in M.first_weights(15).items()}
    _, sparse, labels = random_rows(30, 15, 4)
    slope, _ = M.gradient(weights, sparse, labels)
    for name, at in [("bias", (0, 0)), ("linear", (3, 0)), ("factors", (5, 2)), ("factors", (11, 3))]:
        losses = []
        for step in (1e-5, -1e-5):
            moved = {k: w.copy() for k, w in weights.items()}
            moved[name][at] += step
            losses.append(M.gradient(moved, sparse, labels)[1])
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(slope[name][at], rel=1e-3, abs=1e-5)


def test_tasks_sum_one_gradient(spark):
    rows, sparse, labels = random_rows(200, 30, 5)
    frame = spark.createDataFrame([(k, float(y), f.astype("<i4").tobytes(), v.astype("<f4").tobytes()) for k, (y, (f, v)) in enumerate(zip(labels, rows))], "deal long, label double, features binary, values binary")
    found = [M.fit(frame.repartition(k), 30, updates=6) for k in (1, 7)]
    whole = M.gradient(M.first_weights(30), sparse, labels)[1] / 200
    assert found[0][1][0] == pytest.approx(whole, rel=1e-5) and found[0][1][-1] < found[0][1][0]
    assert all(np.array_equal(found[0][0][k], found[1][0][k]) for k in found[0][0])


def test_pairs_tell_what_single_features_cannot(spark):
    """Exclusive or of two features."""
    kinds = [((0, 2), 0.0), ((1, 3), 0.0), ((0, 3), 1.0), ((1, 2), 1.0)] * 50
    frame = spark.createDataFrame([(k, y, np.array(f, "<i4").tobytes(), np.ones(2, "<f4").tobytes()) for k, (f, y) in enumerate(kinds)], "deal long, label double, features binary, values binary")
    weights, _ = M.fit(frame, 4, updates=200, ridge=0.0)
    z = M.margins(weights, M.Sparse(np.array([f for f, _ in kinds[:4]]).ravel(), np.ones(8), np.arange(0, 8, 2)))[0]
    assert (z > 0).tolist() == [False, False, True, True]


def test_repeated_windows():
    slow = lambda w: sum(any(w[s : s + 5] == w[q : q + 5] for s in range(max(0, i - 4), min(i, len(w) - 5) + 1) for q in range(len(w) - 4) if q != s) for i in range(len(w))) / len(w)
    rng = random.Random(6)
    for _ in range(60):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        assert repeated_windows(np.array(words)) == pytest.approx(slow(words))


def test_entries_are_distinct_and_whole():
    for text in (None, "", " \t", "a", "x " * 100_000, " ".join(map(str, range(80_000))), "no\x1cbreak here\xa0word"):
        features, values = entries(text, None)
        assert len(set(features.tolist())) == len(features) == len(values) and features.max() < SIZE
    words = (entries("no\x1cbreak here\xa0word", 5)[0] >= STATISTICS * BINS).sum()
    assert words == 2
    assert (entries("a b", 1)[0] != entries("a b", 10**6)[0]).sum() == 1


def sample(n, seed=9):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "lorem", "ipsum"]) + str(rng.randrange(50)) for _ in range(rng.randrange(20, 60)))
        bad = rng.random() < 0.3
        kind = rng.randrange(3)
        text = text if not bad else text.upper() if kind == 0 else text.replace(" ", "%% ") if kind == 1 else (text + " ") * 4
        rows.append((k, text, len(text), int(not bad)))
    return rows


SCHEMA = "doc_id long, text string, n_chars long, label int, score string, features string, row string"


def test_held_out_rows_are_told(spark):
    rows = sample(1500)
    frame = spark.createDataFrame([(*r, "s", "f", "r") for r in rows], SCHEMA)
    part = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2
    labelled = frame.filter(~part).select("doc_id", "text", F.col("n_chars").alias("recorded"), "label")
    got = {r.doc_id: r for r in quality(frame.drop("label"), labelled).collect()}
    told = [(r[3], got[r[0]].score) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    good, bad = ([s for y, s in told if y == k] for k in (1, 0))
    assert np.mean([s >= 0.7 for s in good]) > 0.98 and np.mean([s < 0.7 for s in bad]) > 0.9
    assert all(r.features == "f" and r.row == "r" for r in got.values())


def test_bounded_sample_and_odd_rows(spark):
    odd = [(1, None, None, 1), (2, "", 0, 1), (2, "", 0, 1), (None, " \n", -5, None), (4, "word " * 50_000, 3, 0), (5, "é 日本 😀", 5, None)]
    frame = spark.createDataFrame([(*r, "s", "f", "r") for r in odd], SCHEMA)
    labelled = frame.select("doc_id", "text", F.col("n_chars").alias("recorded"), "label")
    got = quality(frame, labelled).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    same = Counter(r.score for r in got if r.doc_id == 2)
    assert len(same) == 1
    none = quality(frame.filter("false"), labelled.filter("false"))
    assert none.count() == 0
    blind = score_quality(frame, learn(labelled.filter("label IS NULL"), "doc_id"))
    assert {round(r.score, 1) for r in blind.collect()} == {0.5}
    many = spark.createDataFrame([(*r, "", "", "") for r in sample(400)], SCHEMA).select("doc_id", "text", F.col("n_chars").alias("recorded"), "label")
    from lodestone.llm.quality_classifier import sample_rows

    assert 20 < sample_rows(many, "doc_id", 50).count() < 90 and sample_rows(many, "doc_id", 10_000).count() == 400
