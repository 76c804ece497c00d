"""Quality rules: base counts, and bands of n-gram perplexity for each language.

A byte model with modified Kneser-Ney smoothing (byte_model) is counted for each language over all its documents of ten words or
more whose words hold at most one symbol in a hundred characters, and one for all languages together. A document's perplexity is measured under
its language's model; languages of fewer than `least_texts` such documents, and null, use the common one. The bands are measured too, for each language: from all its
reference documents, the median of the entropy, and the median of the deviations below and above it, each scaled
to one byte, as short texts stray further. Documents below the lower bound are repetitive or of few words; above the upper bound they are
not of their language. As clean documents may hold passages in other languages, a document above its language's upper bound stays if it lies below
the bound that the language's documents have under the common model. Its own language's model alone decides the lower bound.

Models are rows of a table. Documents are dealt to parts by language, a language having parts in proportion to its text, and each part gets a copy of
its language's model and of the common one, so a task holds two models, whatever the number of languages.

Defined results: null texts have no words; texts of fewer than ten words fail the base rules; a null language, and one of few documents, is measured by the common model, and
all of these share one band; very long texts are measured whole, like others; equal rows get equal verdicts; an empty table gives an empty
one; other columns stay, and columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.byte_model import ByteModel, byte_grams, counts, models
from lodestone.llm.common import bound_batches, free_name, materialize, squeezed, tasks_for, unsqueezed
from lodestone.llm.kneser_ney import POOLED

SYMBOLS = b"#*$%&|<>"
_SPACES = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))

#: How far a band reaches from the median: scaled median deviations, and bits a byte.
WIDTH, SLACK = 6.0, 0.05
#: Columns that the rules add.
COUNTS = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType()}


def repeat_words(words: list) -> int:
    """Words in windows of five words that the text holds twice or more."""
    n = len(words)
    if n < 6:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        key = ids[: n - 4].copy()
        for k in range(1, 5):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : n - 4 + k]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    maybe = np.unique(np.r_[order[1:][same], order[:-1][same]])
    windows: dict = {}
    for i in maybe.tolist():  # the windows themselves decide
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = np.zeros(n + 1, np.int64)
    for at in windows.values():
        if len(at) > 1:
            np.add.at(covered, at, 1)
            np.add.at(covered, [i + 5 for i in at], -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the contract's six characters
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text.translate(_SPACES)) if words else 0, symbols, len(lines) - len(set(lines)), repeat_words(words)


def is_reference(text: str) -> bool:
    """Texts that the models are counted from: ten words or more, one symbol in a hundred characters at most."""
    raw = text.encode("utf-8", "surrogatepass")
    return 100 * (len(raw) - len(raw.translate(None, SYMBOLS))) <= len(raw) and len(raw.split(None, 10)) > 9


#: What a text is measured to: its language's group, bytes, bits a byte under its group's model and under the common one, and whether it is a reference.
MEASURES = {"model_group": T.StringType(), "n_scored": T.LongType(), "entropy": T.DoubleType(), "common": T.DoubleType(), "reference": T.BooleanType()}
#: Characters of a part's texts, about.
PART_CHARS = 16_000_000


def language_models(docs: DataFrame, text: str = "text", lang: str = "lang", least_texts: int = 50) -> DataFrame:
    return materialize(models(counts(docs, lang, text, is_reference), least_texts), "models")


def measure(docs: DataFrame, found: DataFrame, text: str = "text", lang: str = "lang", drop_text: bool = False) -> DataFrame:
    """A struct row of docs' other columns, text (but for drop_text), the base counts, base_failed and MEASURES. found: the models' rows."""
    spare = free_name(docs, "none")  # a struct needs a field
    kept = [*(f for f in docs.schema.fields if f.name != text), T.StructField(spare, T.IntegerType(), False)]
    new = COUNTS | {"base_failed": T.BooleanType()} | MEASURES
    parts = F.greatest(F.lit(1), F.ceil(F.col("bytes") / PART_CHARS)).cast("int")
    plan = materialize(found.filter(F.col("group") != POOLED).select(F.col("group").alias("g"), parts.alias("parts"), F.col("keys").isNotNull().alias("own")), "plan")
    group = F.coalesce(F.nullif(F.col(f"`{lang}`").cast("string"), F.lit(POOLED)), F.lit(POOLED))
    rows = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in kept[:-1]], F.lit(0).alias(spare)).alias("row"), F.col(f"`{text}`").alias("text"), group.alias("g"), F.monotonically_increasing_id().alias("id"))
    rest = found.filter(F.col("group") == POOLED).select(parts.alias("p")).first()
    # A narrow row for each language, broadcast behind a check of their number.
    known = rows.join(F.broadcast(plan) if plan.count() <= FEW_GROUPS else plan, "g", "left")
    own = F.coalesce("own", F.lit(False))
    # Parts of languages without a model of their own are numbered together, as parts of the common one.
    texts = known.select("row", "text", F.when(own, F.col("g")).otherwise(POOLED).alias("g"), F.pmod(F.col("id"), F.when(own, F.col("parts")).otherwise(rest["p"] if rest else 1)).cast("int").alias("part"))
    arrays = ["keys", "logp", "contexts", "logb"]
    numbered = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "part")
    places = numbered(plan.filter("own").select("g", "parts")).unionByName(numbered(found.filter(F.col("group") == POOLED).select(F.col("group").alias("g"), parts.alias("parts"))))
    mine = places.join(found.select(F.col("group").alias("g"), *arrays), "g").select("g", "part", F.lit(1).alias("kind"), *arrays)
    shared = places.crossJoin(found.filter(F.col("group") == POOLED).select(*arrays)).select("g", "part", F.lit(0).alias("kind"), *arrays)  # the one common model, for each part
    texts = squeezed(texts, "text")
    both = texts.withColumn("kind", F.lit(2)).unionByName(mine.unionByName(shared), allowMissingColumns=True)
    dealt = both.repartition(tasks_for(docs, 24_000_000), "g", "part").sortWithinPartitions("g", "part", "kind")
    columns = ["g", "kind", "text", *arrays]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = model = None
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                g, kind, text = (part.column(c).to_pylist() for c in columns[:3])
                text = unsqueezed(text)
                low = 0
                for k in range(len(kind) + 1):
                    if k == len(kind) or kind[k] < 2:
                        if k > low:
                            yield judged(part.slice(low, k - low), text[low:k], g[low:k], model, common)
                        low = k + 1
                    if k < len(kind) and kind[k] < 2:
                        blobs = [part.column(c)[k].as_py() for c in arrays]
                        if kind[k] == 0:
                            common = ByteModel(*blobs)
                        else:
                            model = ByteModel(*blobs)

    own_columns = ["row"] if drop_text else ["row", "text"]
    spoken = [] if drop_text else ["text"]

    def judged(part: pa.RecordBatch, texts: list, group: list, model, common) -> pa.RecordBatch:
        told = [pa.array(texts, pa.string()) for _ in spoken]
        texts = [t or "" for t in texts]
        base = [base_counts(t) for t in texts]
        found = [byte_grams(t) for t in texts]
        sizes = np.array([len(f) for f in found])
        entropy, pooled = np.zeros(len(texts)), np.zeros(len(texts))
        some = np.flatnonzero(sizes)
        if len(some):
            ids, back = np.unique(np.concatenate([found[i] for i in some]), return_inverse=True)
            start = np.r_[0, np.cumsum(sizes[some])[:-1]]
            for out, by in ((entropy, model), (pooled, common)):
                out[some] = np.add.reduceat((-np.log2(10) * by.log10(ids))[back], start) / sizes[some]
        failed = [b[0] < 10 or 100 * b[4] > 20 * b[0] for b in base]
        columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(5)]
        columns += [pa.array(failed, pa.bool_()), pa.array(group, pa.string()), pa.array(sizes, pa.int64()), pa.array(entropy), pa.array(pooled)]
        columns.append(pa.array([not f and is_reference(t) for f, t in zip(failed, texts, strict=True)], pa.bool_()))
        return pa.RecordBatch.from_arrays([part.column("row"), *told, *columns], names=[*own_columns, *new])

    kinds = [T.StructField("row", T.StructType(kept)), T.StructField("text", T.StringType())][: len(own_columns)]
    return dealt.mapInArrow(run, T.StructType([*kinds, *(T.StructField(k, v) for k, v in new.items())]))


#: Groups up to which their bands, some 80 bytes each, are broadcast; more are joined by group.
FEW_GROUPS = 50_000


def by_group(rows: DataFrame, table: DataFrame, n_groups: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of one narrow row for each model_group, of which there are n_groups at most: broadcast behind a check of their number, as a third of all rows may be of one group."""
    return rows.join(F.broadcast(table) if n_groups <= FEW_GROUPS else table, "model_group", how)


def bands(measured: DataFrame, n_groups: int = 1) -> DataFrame:
    """(model_group, middle, below, above, common_middle, common_above) from the reference documents: medians of the entropies, and of their deviations times the root of the length."""
    reference = measured.filter("reference").select("model_group", "n_scored", "entropy", "common")
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    middle = reference.groupBy("model_group").agg(median("entropy").alias("middle"), median("common").alias("common_middle"))
    apart = lambda c, m: (F.col(c) - F.col(m)) * F.sqrt("n_scored")
    side = lambda x, sign: F.coalesce(median(F.when(sign * x > 0, sign * x)), F.lit(0.0))
    own, common = apart("entropy", "middle"), apart("common", "common_middle")
    return by_group(reference, middle, n_groups).groupBy("model_group").agg(F.first("middle").alias("middle"), side(own, -1).alias("below"), side(own, 1).alias("above"), F.first("common_middle").alias("common_middle"), side(common, 1).alias("common_above"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = WIDTH, slack: float = SLACK, drop_text: bool = False, least_texts: int = 50) -> DataFrame:
    """docs with the counts, base_failed, entropy, low and high (the bounds of its band) and kept.

    A band reaches from the language's median entropy by `slack` bits and `width` scaled median deviations of a text of that length, to either side."""
    bound_batches(docs.sparkSession)
    added = [*COUNTS, "base_failed", "entropy", "low", "high", "kept"]
    columns = [c for c in docs.columns if c not in added]
    found = language_models(docs, text, lang, least_texts)
    measured = materialize(measure(docs.select(*[f"`{c}`" for c in columns]), found, text, lang, drop_text), "quality")
    n_groups = found.select("group").count()
    judged = by_group(measured, bands(measured, n_groups), n_groups, "left")
    reach = lambda side: F.lit(slack) + width * 1.4826 * F.col(side) / F.sqrt(F.greatest("n_scored", F.lit(1)))
    judged = judged.withColumn("low", F.col("middle") - reach("below")).withColumn("high", F.col("middle") + reach("above"))
    inside = (F.col("entropy") >= F.col("low")) & ((F.col("entropy") <= F.col("high")) | (F.col("common") <= F.col("common_middle") + reach("common_above")))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    own = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns if not (drop_text and c == text)]
    return judged.select(*own, *added)
