"""Homomorphic multiset hashes of documents.

A document is the multiset of its passages. Lines are paragraphs, and no passage crosses from one to the next. Within a paragraph, cuts
depend on the characters beside them, so an edit moves the cuts around it and few others: at white space after a mark,
after a Latin letter or digit whose code is 5 or 6 modulo 8, or after any letter of another script, and after eight words at the latest; in scripts beyond U+0E00, many of which have no spaces, after a character of
one sixteen of each sixty-four codes, and after sixteen at the latest. A run of more than 24 other characters is cut after those whose code is 5 modulo 8, in pieces of 16 to
64. Each passage hashes to a wide vector; a document's fingerprint is the sum of its passages' vectors, each component
modulo 2^60. Sums don't depend on the order, and adding or taking away a passage's vector inserts or deletes it.

The vector has 45 components. Four are 60-bit hashes, derived from two 64-bit hashes of the passage: two documents of different passages have equal
fingerprints with a chance of about 2^-120. Forty hold three 20-bit lanes each, which count how many passages
have a certain hash bit set (120 lanes in all), and one counts passages. The lanes are a random projection of the multiset: from the lanes'
differences follows an estimate of the number of passages that are in one document only, with a relative error of
about 13 %, and so a likeness between 0 and 1.

DataFrame functions only. `with_vectors` sums whole tables: passages are exploded and added up by plain aggregates, which compiled code does without
a lambda's cost for each passage. `fingerprint_vector`, `insert` and `delete` are the same sums as expressions over one row.

Defined results: null and empty texts have the zero vector; two of these have likeness 1; equal rows have equal fingerprints, and tied rows of a
group are summed as one multiset; an empty table gives an empty one; very long texts are cut like others (a text of more than 2^23 passages, some 200 MB, stops with an
overflow error); with_vectors returns the columns it is asked for, whatever else the table has, and raises where a name it adds is among these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2**60 - 1  # as a mask
BITS = (1 << 40) | (1 << 20) | 1
LANE = 1 << 20
SHIFTS, WHOLE = 20, 4
WIDTH = 2 * SHIFTS + WHOLE + 1


def _passage_pattern() -> str:
    """Three kinds of passages: words up to one that ends in a cut, pieces of a run of more than 24 characters, and pieces of scripts beyond U+0E00, which may have no spaces. Possessive repeats keep the cost linear."""
    word_end = "".join(chr(c) for c in range(128) if chr(c).isalnum() and c % 8 in (5, 6))
    anywhere = "".join(f"\\x{{{c:x}}}" for c in range(33, 127) if c % 8 == 5)
    cuts = "".join(f"\\x{{{c:x}}}-\\x{{{c + 15:x}}}" for c in range(0x0E00, 0xA000, 64))
    one = r"[^ \t\n\x0B\f\r\x{E00}-\x{FFFF}]"
    end = rf"[[^\p{{L}}\p{{N}}\s][{word_end}][^\x00-\x{{36F}}]]"
    words = rf"{one}{{1,24}}+(?!{one})(?:(?<!{end})[^\S\n]++{one}{{1,24}}+(?!{one})){{0,7}}+"
    run = rf"{one}{{16,63}}?(?:(?<=[{anywhere}])|(?!{one}))|{one}{{1,64}}+"
    pieces = rf"[\x{{E00}}-\x{{FFFF}}&&[^{cuts}]]{{1,15}}+[{cuts}]?+|[\x{{E00}}-\x{{FFFF}}]"
    return f"{words}|{run}|{pieces}"


def passages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_passage_pattern()), F.lit(0))


def _add(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(F.lit(MODULUS))


def _hashes(passage: Column) -> list[Column]:
    return [F.xxhash64(F.lit(s), passage) for s in range(2)]


def _lanes(h: list[Column]) -> list[Column]:
    return [F.shiftright(x, i).bitwiseAND(F.lit(BITS)) for x in h for i in range(SHIFTS)]


def _whole(h: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(2 + i), *h).bitwiseAND(F.lit(MODULUS)) for i in range(WHOLE)]


def passage_sum(items: Column) -> Column:
    """The sum of the vectors of the passages in an array: 45 longs below 2^60."""
    hashed = F.transform(items, lambda p: F.struct(*[h.alias(f"h{s}") for s, h in enumerate(_hashes(p))]))
    zeros = F.struct(*[F.lit(0).cast("long").alias(f"v{i}") for i in range(WIDTH)])

    def step(acc: Column, x: Column) -> Column:
        # Plain fields: a lambda for each component would cost several times as much.
        h = [x["h0"], x["h1"]]
        return F.struct(*[_add(acc[f"v{i}"], v).alias(f"v{i}") for i, v in enumerate([*_lanes(h), *_whole(h), F.lit(1).cast("long")])])

    return F.aggregate(hashed, zeros, step, lambda acc: F.array(*[acc[f"v{i}"] for i in range(WIDTH)]))


def fingerprint_vector(text: Column) -> Column:
    return passage_sum(passages(F.coalesce(text, F.lit(""))))


def with_vectors(rows: DataFrame, keys: list[str], text: str, vector: str = "vector") -> DataFrame:
    """The keys of rows, and vector: the fingerprint of the texts of each group of equal keys. Needs no exchange where rows are partitioned by some of the keys already."""
    if vector in keys or "_p" in keys:
        raise ValueError(f"keys may not be named {vector} or _p")
    cut = rows.select(*keys, F.explode_outer(passages(F.coalesce(F.col(text), F.lit("")))).alias("_p"))
    h = [F.col("_h0"), F.col("_h1")]
    hashed = cut.select(*keys, F.col("_p").isNotNull().alias("_is"), *[x.alias(f"_h{k}") for k, x in enumerate(_hashes(F.col("_p")))])
    own = lambda c: F.sum(F.when(F.col("_is"), c).otherwise(F.lit(0).cast("long")))
    # Whole hashes are added up in two halves: sums of 60 bits would overflow.
    low, high = [own(w.bitwiseAND(F.lit(2**30 - 1))) for w in _whole(h)], [own(F.shiftright(w, 30)) for w in _whole(h)]
    sums = [*(own(x) for x in _lanes(h)), *low, *high, F.count_if("_is")]
    wide = hashed.groupBy(*keys).agg(*[x.alias(f"_v{i}") for i, x in enumerate(sums)])
    at, mask = 2 * SHIFTS, F.lit(MODULUS)
    lanes = [F.col(f"_v{i}").bitwiseAND(mask) for i in range(at)]
    whole = [(F.col(f"_v{at + i}") + F.shiftleft(F.col(f"_v{at + WHOLE + i}").bitwiseAND(F.lit(2**30 - 1)), 30)).bitwiseAND(mask) for i in range(WHOLE)]
    return wide.select(*keys, F.array(*lanes, *whole, F.col(f"_v{at + 2 * WHOLE}")).alias(vector))


def insert(vector: Column, items: Column) -> Column:
    """The fingerprint after the passages in `items` were added."""
    return F.zip_with(vector, passage_sum(items), _add)


def delete(vector: Column, items: Column) -> Column:
    """The fingerprint after the passages in `items` were taken away."""
    return F.zip_with(vector, passage_sum(items), lambda a, b: (a - b).bitwiseAND(F.lit(MODULUS)))


def as_text(vector: Column) -> Column:
    """15 hex digits for each component."""
    return F.array_join(F.transform(vector, lambda v: F.lower(F.lpad(F.hex(v), 15, "0"))), "")


def energy(vector: Column) -> Column:
    """Estimate of the sum of the squared multiplicities of a (signed) multiset, from its vector."""
    n = F.element_at(vector, WIDTH)
    half = F.lit(LANE // 2)

    def squares(acc: Column, d: Column) -> Column:
        # Balanced digits to base 2^20 give back the lanes, whatever has been carried.
        second = F.shiftright(d + half, 20)
        third = F.shiftright(second + half, 20)
        digits = [(x + half).bitwiseAND(F.lit(LANE - 1)) - half for x in (d, second, third)]
        return F.struct(sum((F.pow(2 * x - acc["n"], F.lit(2.0)) for x in digits), acc["sum"]).alias("sum"), acc["n"].alias("n"))

    # The count rides along: in a lambda it would be worked out anew for each component.
    start = F.struct(F.lit(0.0).alias("sum"), F.when(n > MODULUS // 2, n - MODULUS - 1).otherwise(n).alias("n"))
    return F.aggregate(F.slice(vector, 1, 2 * SHIFTS), start, squares, lambda acc: acc["sum"]) / (6 * SHIFTS)


def likeness(left: Column, right: Column) -> Column:
    """1 - (energy of the difference) / (energies of both), within 0 and 1: for sets, twice the common passages over the passages of both."""
    apart = energy(F.zip_with(left, right, lambda a, b: (a - b).bitwiseAND(F.lit(MODULUS))))
    return F.when(left == right, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / F.greatest(energy(left) + energy(right), F.lit(1.0)))))
