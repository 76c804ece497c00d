"""A hashed maximum-entropy language model with a class-factored softmax.

p(word | history) = p(class | history) * p(word | class). The classes are the `SINGLE` most frequent training tokens, each by itself, and buckets
hashed from a word's last two characters for all others, known or not. The features of a history are words: the word before (2-gram), of which the `FIRST` most frequent have a
feature each and all others a hashed one; the word two before (skip), likewise with `SECOND`; and both together, hashed (3-gram). Their weights form a softmax over the classes. Within a
class, a word has its training count plus one, and unknown words share one more.

The corpus enters as sums over all training tokens: word counts, and how often each class follows each pair of history features. Both tables grow with the corpus and stay distributed.
The likelihood and its gradient depend on the latter alone, so each update is a distributed sum of gradients over these
rows: they lie by the word before, so each task gives back the weights of its own words, and all gradients together are one of the model's fixed size. Weights start at the smoothed 2-gram frequencies.

Scoring is one pass in numpy batches: features and classes by table, log-probabilities by the pair of features. The counts of the `FREQUENT`
most frequent words go along, a bounded table (words of more than LONGEST bytes as digests); all other words are joined with the count table by a shuffle, in which no key is frequent.

Defined results: null texts are empty; an empty text is the end token alone; very long texts and words are scored whole; without training texts both scores rest on the
added ones; equal rows are scored each; an empty table gives an empty one; other columns stay, and columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches, free_name, materialize, release_memory, worker_cached

CLASSES, SINGLE = 256, 96
#: Features of the word before, of the word two before, and of both; of the first two, words by themselves.
BEFORE, SKIPS, PAIRS = 1024, 32, 8192
FIRST, SECOND = 768, 24
FREQUENT = 200_000
#: Bytes of a frequent word at most; longer words are in the table by their digests, so its size is bounded.
LONGEST = 64
#: Tasks of the training rows, and tokens that a task holds before it adds them up.
TRAINERS, HELD = 8, 1_000_000
END = b"\n"  # no word has white space


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def bucket_class(word: bytes) -> int:
    """The class of a word that isn't a class by itself."""
    last = word.decode("utf-8", "replace")[-2:]
    return SINGLE + zlib.crc32(last.encode()) % (CLASSES - SINGLE)


def context(before: np.ndarray, two_before: np.ndarray) -> np.ndarray:
    """The number of a pair of features: of the word before, and of the word two before."""
    return before.astype(np.int64) * SKIPS + two_before


def pair_bucket(ctx: np.ndarray, first: int = BEFORE, pairs: int = PAIRS) -> np.ndarray:
    """The hashed feature of a pair. The features of one word before lie together."""
    each = pairs // first
    return ctx // SKIPS * each + (ctx % SKIPS * 2654435761 % 2**32) * each // 2**32


def hashed_features(word: bytes) -> tuple[int, int]:
    """The features of a word that has none by itself: as the word before, and as the word two before."""
    h = zlib.crc32(word)
    return FIRST + h % (BEFORE - FIRST), SECOND + (h >> 16) % (SKIPS - SECOND)


def short(word: bytes) -> bytes:
    """A word, or its digest if it is long. No word begins with a zero byte and has 17."""
    return word if len(word) <= LONGEST else b"\x00" + hashlib.md5(word).digest()


class WordCodes(dict):
    """Word -> its number among the frequent words, or for others -1 - (class and features)."""

    def __init__(self, frequent: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(frequent))
        self.base, self.frequent = len(self), frequent

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONGEST and (known := self.get(short(word))) is not None:
            return known
        if len(self) > self.base + 100_000:
            self.clear()
            self.update((w, k) for k, w in enumerate(self.frequent))
        first, second = hashed_features(word)
        value = self[word] = -1 - ((first * SKIPS + second) * CLASSES + bucket_class(word))
        return value


class Lexicon:
    """The frequent words, as `short` has them, with their counts, classes and features: arrays, so the driver holds no object for each word."""

    def __init__(self, words: pa.Array, counts: np.ndarray, buckets: np.ndarray, hashes: np.ndarray):
        self.words, self.counts, self.stamp = words, counts.astype(np.int64), uuid.uuid4().hex
        place = np.arange(len(words))
        self.classes = np.where(place < SINGLE, place, buckets)
        self.first = np.where(place < FIRST, place, FIRST + hashes % (BEFORE - FIRST))
        self.second = np.where(place < SECOND, place, SECOND + (hashes >> 16) % (SKIPS - SECOND))

    def end(self) -> tuple[int, int]:
        """The features of the end token, which stands before each text."""
        at = pc.index(self.words, END).as_py()
        return (int(self.first[at]), int(self.second[at])) if at >= 0 else hashed_features(END)


def word_codes(shared) -> tuple[Lexicon, WordCodes]:
    """One table for each worker process and lexicon."""
    lexicon = shared.value
    return worker_cached(("lexicon", lexicon.stamp), lambda: (lexicon, WordCodes(lexicon.words.to_pylist())))


def scorer(shared, model) -> tuple[Lexicon, WordCodes, np.ndarray]:
    """One table for each worker process and model, with the scores of all contexts."""
    lexicon = shared.value
    return worker_cached(("scorer", lexicon.stamp), lambda: (lexicon, WordCodes(lexicon.words.to_pylist()), score_table(model.value[0])))


def coded(texts: list[str | None], lexicon: Lexicon, codes: WordCodes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token lists; and for all tokens in a row: codes, classes, contexts; and each text's first position."""
    words = [tokens(t) for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.empty(0, np.int64)
    code = np.fromiter((codes[w] for ws in words for w in ws), np.int64, int(size.sum()))
    packed, at = -1 - code, np.maximum(code, 0)
    none = np.zeros(1, np.int64)
    of = lambda table, other: np.where(code >= 0, (table if len(table) else none)[at], other)
    class_ = of(lexicon.classes, packed % CLASSES)
    first, second = of(lexicon.first, packed // CLASSES // SKIPS), of(lexicon.second, packed // CLASSES % SKIPS)
    end_first, end_second = lexicon.end()
    before = np.concatenate([[0], first[:-1]])
    before[start] = end_first
    two = np.concatenate([[0, 0], second[:-2]])[: len(class_)]
    two[start] = end_second
    two[start[size > 1] + 1] = end_second
    return words, code, class_, context(before, two), start


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, c): the tokens of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for t in batch.slice(at, 500).column(0).to_pylist():
                    held.update(tokens(t))
                if len(held) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    return texts.select(F.col(text)).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def class_counts(texts: DataFrame, text: str, shared) -> DataFrame:
    """(ctx, class, n): how often each class follows each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, codes = word_codes(shared)
        total, held, size = np.zeros(BEFORE * SKIPS * CLASSES, np.int32), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                _, _, class_, ctx, _ = coded(batch.slice(at, 400).column(0).to_pylist(), lexicon, codes)
                held.append((ctx * CLASSES + class_).astype(np.int32))
                size += len(ctx)
                if size > HELD:
                    cells, n = np.unique(np.concatenate(held), return_counts=True)
                    total[cells] += n.astype(np.int32)
                    held, size = [], 0
        if held:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            total[cells] += n.astype(np.int32)
        cells = np.flatnonzero(total)
        for low in range(0, len(cells), 500_000):
            part = cells[low : low + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(part // CLASSES, pa.int32()), pa.array(part % CLASSES, pa.int32()), pa.array(total[part], pa.int64())], names=["ctx", "class", "n"])

    return texts.select(F.col(text)).mapInArrow(run, "ctx int, class int, n long").groupBy("ctx", "class").agg(F.sum("n").alias("n"))


def log_softmax(weights: dict[str, np.ndarray], ctx: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of the classes in each context."""
    pair = pair_bucket(ctx, len(weights["before"]), len(weights["pair"]))
    z = weights["bias"] + weights["before"][ctx // SKIPS] + weights["skip"][ctx % SKIPS] + weights["pair"][pair]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradient(weights: dict[str, np.ndarray], ctx: np.ndarray, class_: np.ndarray, n: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradient of the log-likelihood of rows (ctx, class, n), and the log-likelihood."""
    out, fit = {k: np.zeros_like(w) for k, w in weights.items()}, 0.0
    if (ctx[1:] < ctx[:-1]).any():
        order = np.argsort(ctx, kind="stable")
        ctx, class_, n = ctx[order], class_[order], n[order]
    first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
    seen, ends = ctx[first], np.r_[first, len(ctx)]
    row = np.repeat(np.arange(len(seen)), np.diff(ends))
    for k in range(0, len(seen), 2048):  # in slices, so the matrix of contexts and classes stays small
        own, low, high = seen[k : k + 2048], ends[k], ends[min(k + 2048, len(seen))]
        logp = log_softmax(weights, own)
        counts = np.bincount((row[low:high] - k) * CLASSES + class_[low:high], n[low:high], len(own) * CLASSES).reshape(len(own), CLASSES)
        gap = counts - counts.sum(axis=1, keepdims=True) * np.exp(logp)
        out["bias"] += gap.sum(axis=0)
        np.add.at(out["before"], own // SKIPS, gap)
        np.add.at(out["skip"], own % SKIPS, gap)
        np.add.at(out["pair"], pair_bucket(own, len(weights["before"]), len(weights["pair"])), gap)
        fit += float((counts * logp).sum())
    return out, fit


def first_weights(two: np.ndarray) -> dict[str, np.ndarray]:
    """Weights that give the smoothed 2-gram frequencies. two: how often each class follows each word before."""
    total = two.sum(axis=0) + 0.5
    bias = np.log(total / total.sum())
    smooth = (two + 5.0 * total / total.sum()) / (two.sum(axis=1, keepdims=True) + 5.0)
    return {"bias": bias, "before": np.log(smooth) - bias, "skip": np.zeros((SKIPS, CLASSES)), "pair": np.zeros((PAIRS, CLASSES))}


def packed(rows: DataFrame) -> DataFrame:
    """(ctx, class, n) of rows as arrays of 32-bit, 8-bit and 64-bit integers in order of ctx: a row for each of TRAINERS tasks, which lie by the word before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(k).to_numpy() for k in range(3)] for b in batches if b.num_rows]
        if parts:
            ctx, class_, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(ctx, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([x[order].astype(t).tobytes()], pa.binary()) for x, t in ((ctx, "<i4"), (class_, "u1"), (n, "<i8"))], names=["ctx", "class", "n"])

    return rows.repartition(TRAINERS, F.floor(F.col("ctx") / SKIPS)).mapInArrow(run, "ctx binary, class binary, n binary")


def train(rows: DataFrame, updates: int = 12, rate: float = 0.3, ridge: float = 1.0) -> dict[str, np.ndarray]:
    """Weights after `updates` full gradients of the ridge-penalised likelihood of rows (ctx, class, n), each summed over all tasks."""
    spark = rows.sparkSession
    rows = materialize(rows, "classes")
    two = rows.groupBy(F.floor(F.col("ctx") / SKIPS).cast("int").alias("before"), "class").agg(F.sum("n").alias("n")).toArrow()  # BEFORE * CLASSES rows at most
    by = np.zeros((BEFORE, CLASSES))
    by[two.column("before").to_numpy(), two.column("class").to_numpy()] = two.column("n").to_numpy()
    weights = {k: w.astype(np.float32) for k, w in first_weights(by).items()}
    scale = {k: np.full_like(w, 1e-8) for k, w in weights.items()}
    arrays = materialize(packed(rows), "arrays")  # read in each update: bytes cost less than rows
    for _ in range(updates):
        shared = spark.sparkContext.broadcast(weights)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ctx, class_, n = (np.frombuffer(b.column(k)[i].as_py(), t).astype(np.int64) for k, t in enumerate(("<i4", "u1", "<i8")))
                    g, fit = gradient({k: w.astype(np.float64) for k, w in shared.value.items()}, ctx, class_, n)
                    for k, (name, w) in enumerate(sorted(g.items())):
                        w = np.atleast_2d(w)
                        used = np.flatnonzero(w.any(axis=1))
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([used.astype("<i4").tobytes()]), pa.array([w[used].astype("<f4").tobytes()]), pa.array([fit * (k == 0)], pa.float64())], names=["name", "used", "g", "fit"])

        got = arrays.mapInArrow(run, "name string, used binary, g binary, fit double").toArrow()  # parts of one gradient
        if not got.num_rows:
            break
        got = got.sort_by([("name", "ascending"), ("used", "ascending"), ("g", "ascending")])  # sums don't depend on the order of tasks
        for name, w in weights.items():
            step = np.zeros((w.size // CLASSES, CLASSES), np.float32)
            own = got.filter(pc.field("name") == name)
            for used, g in zip(own.column("used"), own.column("g"), strict=True):
                step[np.frombuffer(used.as_buffer(), "<i4")] += np.frombuffer(g.as_buffer(), "<f4").reshape(-1, CLASSES)
            step = step.reshape(w.shape)
            for low in range(0, len(w), 1024):  # in slices and in place
                at = slice(low, low + 1024)
                move = step[at] - ridge * w[at] * (name != "bias")
                scale[name][at] += move**2
                w[at] += rate * move / np.sqrt(scale[name][at])
        del got
        shared.destroy()
    return weights


def score_table(weights: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probabilities of the classes in all contexts."""
    weights = weights | {"bias": weights["bias"].astype(np.float64)}  # sums are of this type then
    out = np.empty((BEFORE * SKIPS, CLASSES), np.float32)
    for low in range(0, len(out), 2048):
        out[low : low + 2048] = log_softmax(weights, np.arange(low, low + 2048)) / np.log(10)
    return out


def frequent_words(counts: DataFrame) -> Lexicon:
    """The most frequent words; long ones by digest, with the class and features of the whole word."""
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT)
    long_ = F.octet_length("word") > LONGEST
    last = F.right(F.decode("word", "UTF-8"), F.lit(2))
    bucket = (F.crc32(F.encode(last, "UTF-8")) % (CLASSES - SINGLE) + SINGLE).cast("int")
    key = F.when(long_, F.concat(F.unhex(F.lit("00")), F.unhex(F.md5("word")))).otherwise(F.col("word"))
    rows = top.select(key.alias("key"), "c", bucket.alias("bucket"), F.crc32("word").alias("h"), F.monotonically_increasing_id().alias("k")).orderBy(F.desc("c"), "k").toArrow()
    return Lexicon(rows.column("key").combine_chunks(), *(rows.column(k).to_numpy() for k in ("c", "bucket", "h")))


def score_texts(docs: DataFrame, learn_from: str, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score (log10). learn_from: a boolean column, the training texts."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*new)
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    uid, known, counted, classed, others = (free_name(docs, n) for n in ("uid", "known", "counted", "classed", "others"))
    training = docs.filter(F.col(learn_from)).select(text)
    counts = materialize(word_counts(training, text), "words")
    lexicon = frequent_words(counts)
    release_memory()
    shared = spark.sparkContext.broadcast(lexicon)  # FREQUENT words of LONGEST bytes at most
    # The same classes in SQL: the most frequent words by place, all others by their last two characters.
    bucket = (F.crc32(F.encode(F.right(F.decode("word", "UTF-8"), F.lit(2)), "UTF-8")) % (CLASSES - SINGLE) + SINGLE).cast("int")
    class_ = bucket
    for k, w in enumerate(lexicon.words[:SINGLE].to_pylist()):
        same = F.concat(F.unhex(F.lit("00")), F.unhex(F.md5("word"))) == F.lit(w) if w[:1] == b"\x00" and len(w) == 17 else F.col("word") == F.lit(w)
        class_ = F.when(same, k).otherwise(class_)
    sums = {r["k"]: (r["c"], r["v"]) for r in counts.groupBy(class_.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    n, v = sum(c for c, _ in sums.values()), sum(v for _, v in sums.values())
    within = np.array([np.log10(sums.get(k, (0, 0))[0] + sums.get(k, (0, 0))[1] + 1) for k in range(CLASSES)])
    model = spark.sparkContext.broadcast((train(class_counts(training, text, shared)), within))  # of fixed size; workers make the table of scores
    release_memory()
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in kept]
    added = {"n_tokens": T.LongType(), known: T.LongType(), counted: T.DoubleType(), classed: T.DoubleType(), others: T.ArrayType(T.BinaryType())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, codes, table = scorer(shared, model)
        within = model.value[1]
        logc = np.log10(np.append(lexicon.counts, 0) + 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                words, code, class_, ctx, start = coded(part.column(part.schema.get_field_index(text)).to_pylist(), lexicon, codes)
                by_class = np.add.reduceat(table[ctx, class_].astype(np.float64) - within[class_], start)
                by_count = np.add.reduceat(np.where(code >= 0, logc[np.maximum(code, 0)], 0.0), start)
                found = np.add.reduceat((code >= 0).astype(np.int64), start)
                ends = [*start[1:].tolist(), len(code)]
                rest = [[words[k][i] for i in np.flatnonzero(code[s:e] < 0).tolist()] for k, (s, e) in enumerate(zip(start.tolist(), ends, strict=True))]
                columns = [pa.array([len(w) for w in words], pa.int64()), pa.array(found, pa.int64()), pa.array(by_count), pa.array(by_class), pa.array(rest, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), *columns], names=[*names, *added])

    scored = docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(k, t) for k, t in added.items())]))
    scored = materialize(scored.withColumn(uid, F.monotonically_increasing_id()), "scored")
    rare = scored.select(F.col(uid).alias("u"), F.explode(others).alias("word")).join(counts, "word").groupBy("u").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_counted"), F.count("*").alias("rare_known"))
    rare = rare.select(F.col("u").alias(uid), F.struct("rare_counted", "rare_known").alias(others))
    both = scored.drop(others).join(rare, uid, "left")
    counts_all = F.col(counted) + F.coalesce(F.col(others)["rare_counted"], F.lit(0.0))
    return both.select(
        *[f"`{c}`" for c in names],
        "n_tokens",
        (F.col(known) + F.coalesce(F.col(others)["rare_known"], F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (counts_all - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (counts_all + F.col(classed)).alias("score"),
    )
