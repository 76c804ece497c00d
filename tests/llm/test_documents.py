"""Fingerprints, quality rules, near-duplicates, toxicity, language model and pipeline on small fixtures and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.deobfuscation import Restorer, suspicious_spans
from lodestone.llm.fingerprints import as_text, delete, fingerprint_vector, insert, likeness, passage_sum, passages
from lodestone.llm.kneser_ney import POOLED, _smooth, fit, gram_counts, key_of
from lodestone.llm.char_codes import EDGE, ORDER, SIZE, codes, grams
from lodestone.llm.maxent_lm import CLASSES, SKIPS, gradient, log_softmax, score_texts
from lodestone.llm.minhash_dedup import near_duplicates, shingles, without_duplicates
from lodestone.llm.neighbours import with_next
from lodestone.llm.quality_rules import base_counts, quality_rules, repeat_words
from lodestone.llm.toxicity import lower_bound, toxicity
from tests.llm.conftest import LONG


# fingerprints


def test_fingerprint_is_homomorphic(spark):
    row = spark.createDataFrame([("a b.\nc d.\ng h", "g h\na b.\nc d.")], "x string, y string")
    v = row.select(
        as_text(fingerprint_vector(F.col("x"))).alias("x"),
        as_text(fingerprint_vector(F.col("y"))).alias("y"),
        as_text(insert(fingerprint_vector(F.lit("a b.")), F.array(F.lit("c d."), F.lit("g h")))).alias("built"),
        as_text(delete(fingerprint_vector(F.col("x")), F.array(F.lit("c d.")))).alias("less"),
        as_text(passage_sum(F.array(F.lit("g h"), F.lit("a b.")))).alias("rest"),
        as_text(fingerprint_vector(F.lit(None).cast("string"))).alias("none"),
    ).first()
    assert v.x == v.y == v.built and v.less == v.rest and v.x != v.less
    assert len(v.x) == 45 * 15 and set(v.none) == {"0"}


def test_likeness_follows_the_shared_passages(spark):
    rng = random.Random(5)
    base = [f"bit {rng.random()}." for _ in range(200)]
    other = [f"bit {rng.random()}." for _ in range(200)]
    data = [(k, "\n".join(base), "\n".join(base[:k] + other[k:])) for k in (0, 50, 100, 150, 200)]
    got = spark.createDataFrame(data, "k int, x string, y string").select("k", likeness(fingerprint_vector(F.col("x")), fingerprint_vector(F.col("y"))).alias("l")).collect()
    for r in got:
        assert abs(r.l - r.k / 200) < 0.2
    assert next(r.l for r in got if r.k == 200) == 1.0


def test_passages_cut_lines_and_clauses(spark):
    assert spark.range(1).select(passages(F.lit("one, two\n\nthe end now")).alias("p")).first().p == ["one,", "two", "the", "end now"]


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_next_row_is_that_of_a_sort(docs, size):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = with_next(rows, "doc_id", [F.col("text")], ["doc_id", "text"], bucket_rows=size).collect()
    want = sorted(rows.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text))
    pairs = Counter((r.doc_id, r.text, r.next.doc_id, r.next.text) for r in got)
    assert pairs == Counter((a.doc_id, a.text, b.doc_id, b.text) for a, b in zip(want, want[1:] + want[:1], strict=True))


def test_next_of_one_and_none(docs, no_docs):
    one = with_next(docs.filter("doc_id = 1"), "doc_id", [F.col("text")], ["doc_id"]).first()
    assert one.next.doc_id == 1
    assert with_next(no_docs, "doc_id", [F.col("text")], ["doc_id"]).count() == 0


# quality


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_match_brute_force():
    rng = random.Random(1)
    texts = ["", " \n ", LONG, "a b c d e a b c d e", "x y z é"] + ["".join(rng.choice("ab \n#|\té") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    for t in texts:
        assert base_counts(t) == slow_counts(t)
    assert repeat_words(["w"] * 7) == 7 and repeat_words(["w"] * 5) == 0


def slow_kneser_ney(texts):
    """The smoothed model by its definition, over strings of codes."""
    full = Counter(g for t in texts for g in [tuple(([EDGE] * 3 + codes(t).tolist())[i : i + 4]) for i in range(len(t))])
    levels = {ORDER: full}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discount(c):
        n = [sum(1 for v in c.values() if v == k) for k in range(1, 5)]
        if not all(n[:3]):
            return [0.0, 0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0, *(min(max(x, 0.1), k + 0.9) for k, x in enumerate((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])))]

    d = {k: discount(levels[k]) for k in levels}

    def p(g):
        if not g:
            return 1 / SIZE
        k, below = len(g), p(g[1:])
        near = {x: c for x, c in levels[k].items() if x[:-1] == g[:-1]}
        total = sum(near.values())
        if not total:
            return below
        own = levels[k].get(g, 0)
        return (own - d[k][min(own, 3)]) / total * (own > 0) + sum(d[k][min(c, 3)] for c in near.values()) / total * below

    return p


def test_kneser_ney_matches_its_definition(spark):
    texts = ["abab abc", "cab bac!", "aabb abab", "zzz"]
    frame = spark.createDataFrame([("x", t) for t in texts], "g string, t string")
    model, slow = fit(gram_counts(frame, "g", "t")), slow_kneser_ney(texts)
    for t in ["abab", "cabz", "qq!", "ab ab"]:
        got = model.log10(model.group("x"), grams(t).astype(np.int64))
        padded = [EDGE] * 3 + codes(t).tolist()
        assert np.allclose(got, [math.log10(slow(tuple(padded[i : i + 4]))) for i in range(len(t))], atol=1e-5)
    assert abs(sum(10 ** model.log10(1, np.arange(SIZE) + SIZE * 77))) - 1 < 1e-4
    assert (np.diff(model.gram_keys.astype(object)) > 0).all()


def test_keys_are_one_to_one():
    g = np.arange(50_000)
    assert len(np.unique(np.concatenate([key_of(k, o, g) for k in (0, 5) for o in (1, 4)]))) == 200_000


def test_quality_bands_reject_junk(spark, docs, no_docs):
    rng = random.Random(2)
    clean = [(k, " ".join(rng.choice(["the", "river", "runs", "past", "old", "stones", "and", "green", "fields"]) + str("") for _ in range(60)), "en") for k in range(300)]
    junk = [(1000 + k, " ".join(f"q{rng.choice('#$%')}{rng.choice('xzq')}|" for _ in range(60)), "en") for k in range(5)]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert not any(out[k].kept for k, _, _ in junk) and sum(out[k].kept for k, _, _ in clean) >= 295 - sum(out[k].base_failed for k, _, _ in clean)
    got = quality_rules(docs).collect()
    assert len(got) == 10 and all(not r.kept for r in got if (r.text or "").split().__len__() < 10)
    assert quality_rules(no_docs).count() == 0


# near-duplicates


def slow_components(rows, width, percent):
    sets = [set(map(int, shingles(t, width))) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return Counter(min((i for i in g if i is not None), default=None) for g in groups.values() for _ in g), len(groups)


def noisy(words, rng, rate):
    return " ".join(w if rng.random() > rate else f"x{rng.randint(0, 9999)}" for w in words)


def near_rows(seed, groups=12, copies=9):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 30, 120, 300]))]
        rows += [(len(rows) + k, noisy(words, rng, rng.choice([0, 0.01, 0.03, 0.06]))) for k in range(copies)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("short", [64, 3])
def test_components_match_all_pairs(spark, monkeypatch, seed, short):
    from lodestone.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "SHORT_LIST", short)
    monkeypatch.setattr(minhash_dedup, "UNIT_ROWS", 4 if short == 3 else 512)
    rows = near_rows(seed)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, n = slow_components(rows, 4, 80)
    assert Counter(r.component_id for r in got) == want and sum(r.keep for r in got) == n


def test_odd_documents_and_one_kept(docs, no_docs):
    got = near_duplicates(docs).collect()
    assert len(got) == 10 and sum(r.keep for r in got) == 8
    assert all(r.keep for r in got if r.n_shingles == 0)
    same = [r for r in got if r.doc_id in (1, 7)]
    assert {r.component_id for r in same} == {1} and sum(r.keep for r in same) == 1
    kept = without_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    assert near_duplicates(no_docs).count() == 0


def test_short_texts_are_one_shingle():
    assert len(shingles("a b", 4)) == 1 and len(shingles("A  b\n", 4)) == 1 and (shingles("A b", 4) == shingles("a b", 4)).all()
    assert len(shingles(None, 4)) == 0 and len(shingles("a b c d e", 4)) == 2 and (shingles("a b", 4) != shingles("a b c", 4)).all()


# toxicity


@pytest.fixture(scope="module")
def restorer(spark):
    texts = ["the idiot and the loser are stupid clowns", "a pathetic moron is worthless", "the clean river runs in the green field", "letters and words and the rest of it", "stupid idiot clown moron loser"] * 20
    return Restorer(fit(gram_counts(spark.createDataFrame([(None, t) for t in texts], "g string, t string"), "g", "t")))


@pytest.mark.parametrize("bad,good", [("1d1ot", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("m0r0n", "moron"), ("l0$er", "loser"), ("stuuupid", "stupid"), ("cl0wn", "clown"), ("w0rthl3ss", "worthless"), ("cl000wn", "clown"), ("1111diot", "idiot")])
def test_obfuscated_words_are_restored(restorer, bad, good):
    assert restorer.text(f"the {bad} is") == f"the {good} is"


@pytest.mark.parametrize("text", ["", "plain words stay", "trail*** marks%%% stay$$$", "a b", "x | y | z", "see you at 10:30, room 5", "Über ß"])
def test_plain_texts_stay(restorer, text):
    assert restorer.text(text) == text.lower()


def test_spans_of_odd_texts():
    for t in ["", "a", "ab", "é😀 ퟿", LONG]:
        assert suspicious_spans(t) == []


def test_toxic_words_are_learned_and_scored(spark, docs, no_docs):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(200)]
    plain = lambda: [rng.choice(vocabulary) for _ in range(40)]
    def spoiled():
        words = plain()
        words[rng.randint(0, 39)] = rng.choice(["moron", "scum"])
        return words
    train = [(" ".join(spoiled()), 1) for _ in range(60)] + [(" ".join(plain()), 0) for _ in range(200)]
    labelled = spark.createDataFrame(train, "text string, toxic int")
    test = spark.createDataFrame([(1, " ".join(plain())), (2, "such a moron they are"), (3, "such scum"), (4, None), (5, ""), (6, "such a m0r0n they are")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity(test.unionByName(labelled.select(F.lit(99).cast("long").alias("doc_id"), "text")), labelled).filter("doc_id < 99").collect()}
    assert got[2] > 0.8 and got[3] > 0.8 and got[6] > 0.8 and got[1] < 0.3 and got[4] == got[5] < 0.3
    none = toxicity(docs, labelled.filter("false")).collect()
    assert len(none) == 10 and len({r.score for r in none}) == 1
    assert toxicity(no_docs, labelled.filter("false")).count() == 0


def test_wilson_bound():
    assert lower_bound(10, 0, 1.64) < 1 and lower_bound(100, 0, 1.64) > lower_bound(10, 0, 1.64) > lower_bound(10, 10, 1.64)


# language model


def test_scores_match_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "of", "Der", "le", "river,", "stone.", "x9"] + [f"r{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), k % 5 != 2) for k in range(200)] + [(900, None, False), (901, "", True), (902, "never seen", False)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "learn").collect()}
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) + ["\n"]
    counts = Counter(w for _, t, take in rows if take for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok(t)), sum(counts[w] > 0 for w in tok(t)), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tok(t))) < 1e-6
        assert r.score < 0


def test_scores_without_training_and_documents(spark, docs, no_docs):
    got = score_texts(docs.withColumn("learn", F.lit(False)), "learn").collect()
    assert len(got) == 10 and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert score_texts(no_docs.withColumn("learn", F.lit(True)), "learn").count() == 0


def test_classes_are_a_distribution_and_the_gradient_is_right():
    rng = np.random.default_rng(0)
    w = {"bias": rng.normal(size=CLASSES), "before": rng.normal(size=(CLASSES, CLASSES)) * 0.1, "skip": rng.normal(size=(SKIPS, CLASSES)) * 0.1, "pair": rng.normal(size=(1024, CLASSES)) * 0.1}
    assert np.allclose(np.exp(log_softmax(w, np.arange(40))).sum(axis=1), 1)
    ctx, cls, n = np.array([5, 5, 700]), np.array([1, 2, 3]), np.array([4, 1, 2])
    g, at = gradient(w, ctx, cls, n)
    for key, place in (("bias", (1,)), ("before", (0, 2)), ("skip", (5, 1))):
        moved = {k: x.copy() for k, x in w.items()}
        moved[key][place] += 1e-6
        assert abs((gradient(moved, ctx, cls, n)[1] - at) / 1e-6 - g[key][place]) < 1e-3


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    good = [(k, " ".join(rng.choice(["the", "river", "runs", "past", "old", "stones", "and", "green", "fields", "under", "cold", "skies"]) for _ in range(80)), "en", "s", 0) for k in range(120)]
    rows = good + [(500, good[3][1], "en", "s", 0), (501, None, "en", "s", 0), (502, "too short", "en", "s", 0), (503, good[5][1] + " you utter moron", "en", "s", 0)]
    rows += [(600 + k, " ".join(rng.choice(["the", "river", "moron", "runs", "past"]) for _ in range(60)), "en", "s", 0) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    spark.createDataFrame([(r[0], 1, int("moron" in (r[1] or ""))) for r in rows if fold(r[0])], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    kept = {r.doc_id for r in at.collect()}
    assert not kept & {500, 501, 502} and not any(600 <= k < 620 for k in kept) and len(kept & set(range(120))) > 100
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept and len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 1024) + 1


def test_digests_are_stable():
    assert hashlib.sha256(shingles("a b c d e", 4).tobytes()).hexdigest() == hashlib.sha256(shingles("A b c d  e", 4).tobytes()).hexdigest()


def test_pooled_model_is_there():
    m = _smooth({POOLED: 0}, *[np.array(x) for x in ([0] * SIZE, [1] * SIZE, list(range(SIZE)))], np.ones(SIZE))
    assert np.allclose(10 ** m.log10(0, np.array([3])), 1 / SIZE)
