"""Repair of the structure of conversations: faults are counted, and the cheapest edits give turns that follow `(s?(ua)+)?`.

A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (the last
character that is no white space is none of `.!?`). Blank and duplicate rows must go. See repair_costs for edits and their costs.

Conversations are dealt by their key; a task reads them in order and repairs some thousands at once, in arrays by length (powers of two).
A conversation of more than `stretch` rows, or `most_bytes` of text, doesn't meet in one task: its rows are placed by ranges and cut into stretches. Each
stretch gives a matrix of costs between states; these, a few numbers for each thousand rows, give the costs behind each stretch, from which each
stretch is traced for all four states before it; the traces are then chained. Only the digest of a long conversation reads it in one
stream, row by row, as SHA-256 can't be computed in parts.

Defined results: order is by turn (nulls first), then role and text; null roles and texts are one space; rows of a null key are one conversation;
`gaps` is 0 where all turns are null; a conversation without present rows has zeros, an empty audit and the digest of an empty text; an empty table gives an empty one; other columns don't enter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import repair_costs as R
from lodestone.llm.common import bound_batches, materialize, tasks_for
from lodestone.llm.positions import with_positions

STRETCH, MOST_BYTES = 1024, 32_000_000
#: Rows and bytes that are repaired at once.
CHUNK_ROWS, CHUNK_BYTES = 20_000, 16_000_000
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_DONE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) damaged by CRC-32 of `conv_id:turn`; a dropped row stays with present false, so its conversation is known."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8")), F.lit(20))
    said, role = shown("text"), shown("role")
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(said, r"[.!?]", "")).when(fault != 0, said)
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").when(fault != 0, role).alias("role"), text.alias("text"), (fault != 0).alias("present"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _features(rows: DataFrame, key: str) -> DataFrame:
    """(g, conv, turn, role, text, present, initial, blank, cut), white space being the ASCII characters."""
    g = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    kinds = F.create_map(*[F.lit(x) for kv in R.INITIALS.items() for x in kv])
    named = rows.select(g.alias("g"), F.col(key).alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(F.col("present"), role).alias("role"), F.when(F.col("present"), text).alias("text"), F.coalesce("present", F.lit(False)).alias("present"))
    return named.select("*", F.coalesce(kinds[F.left("role", F.lit(1))], F.lit(3)).cast("byte").alias("initial"), F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("blank"), F.coalesce(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), F.lit(False)).alias("cut"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that stand together, with the group of each row. The groups of a table are of bounded size together, or one group."""
    held: list[pa.Table] = []
    rows = size = 0
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held.append(part)
        rows, size = rows + part.num_rows, size + part.nbytes
        if rows < CHUNK_ROWS and size < CHUNK_BYTES:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        owner = _owners(whole, keys)
        last = int(np.searchsorted(owner, owner[-1]))
        if last:
            yield whole.slice(0, last), owner[:last]
        held, rows, size = [whole.slice(last)], whole.num_rows - last, whole.slice(last).nbytes
    if rows:
        whole = pa.concat_tables(held).combine_chunks()
        yield whole, _owners(whole, keys)


def _owners(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    for k in keys:
        c = rows.column(k).combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, max(0, len(c) - 1))))
    return np.cumsum(new)


def _numbers(rows: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return rows.column(name).fill_null(null).to_numpy().astype(np.int64)


def _by_length(owner: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of groups by length: (their numbers, rows, group of each row within the bucket, place of each row, lengths)."""
    lengths = np.bincount(owner, minlength=n)
    place = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(lengths)])[owner]
    bucket = np.frexp(lengths)[1]
    for b in np.unique(bucket):
        groups = np.flatnonzero(bucket == b)
        rows = np.flatnonzero(bucket[owner] == b)
        yield groups, rows, np.searchsorted(groups, owner[rows]), place[rows], lengths[groups]


def _kinds(blank: np.ndarray, again: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.where(blank | again, R.FAULTY, np.where(cut, R.CUT, R.SOUND)).astype(np.int8)


def _tallies(owner: np.ndarray, n: int, turn: np.ndarray, known: np.ndarray, initial: np.ndarray, blank: np.ndarray, again: np.ndarray, cut: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each of n groups: first and last turn, distinct turns, faults, illegal neighbours."""
    count = lambda mask: np.bincount(owner[mask], minlength=n).astype(np.int64)
    low, high = np.full(n, 2**62), np.full(n, -(2**62))
    np.minimum.at(low, owner[known], turn[known])
    np.maximum.at(high, owner[known], turn[known])
    first, same = np.ones(len(owner), bool), np.zeros(len(owner), bool)
    same[1:] = owner[1:] == owner[:-1]
    first[1:] = ~(same[1:] & known[:-1] & (turn[1:] == turn[:-1]))
    illegal = np.zeros(len(owner), bool)
    illegal[1:] = same[1:] & ~_LEGAL[initial[:-1], initial[1:]]
    return {"low": low, "high": high, "distinct": count(known & first), "blank": count(blank), "duplicate": count(again & ~blank), "truncated": count(cut & ~blank & ~again), "illegal": count(illegal)}


def _repair_chunk(rows: pa.Table, owner: np.ndarray, turns: bool) -> pa.RecordBatch:
    """The results of whole conversations."""
    n = int(owner[-1]) + 1
    heads = np.searchsorted(owner, np.arange(n))
    conv = rows.column("conv").take(pa.array(heads)).combine_chunks()
    here = np.asarray(rows.column("present"))
    rows, owner = rows.filter(pa.array(here)), owner[here]
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    seen: set = set()
    again = np.zeros(len(owner), bool)
    for k, said in enumerate(zip(owner.tolist(), roles, texts)):
        again[k] = said in seen
        seen.add(said)
    initial = _numbers(rows, "initial").astype(np.int8)
    blank, cut = (np.asarray(rows.column(c)).astype(bool) for c in ("blank", "cut"))
    found = _tallies(owner, n, _numbers(rows, "turn"), ~np.asarray(rows.column("turn").is_null()), initial, blank, again, cut)
    kind, cost, audits = _kinds(blank, again, cut), np.zeros(n, np.int64), [b""] * n
    for groups, at, own, place, lengths in _by_length(owner, n):
        first, what = R.align(own, place, lengths, initial[at], kind[at])
        known = R.costs(first, what, np.repeat(R.END[:, None], len(groups), 1))
        edits, _ = R.trace(first, what, known, np.zeros(len(groups), np.int64), True)
        cost[groups] = known[0, 0]
        for g, letters in zip(groups.tolist(), edits):
            audits[g] = letters
    ends = np.searchsorted(owner, np.arange(n + 1))
    repaired = [R.replay(audits[g], 0, roles[ends[g] : ends[g + 1]], texts[ends[g] : ends[g + 1]])[0] for g in range(n)]
    if turns:
        flat = [(g, k, role, text) for g, said in enumerate(repaired) for k, (role, text) in enumerate(said)]
        return pa.RecordBatch.from_arrays([conv.take(pa.array([f[0] for f in flat], pa.int64())), *(pa.array([f[j] for f in flat], t) for j, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string())))], names=["conv", "place", "role", "text"])
    digests = [hashlib.sha256("\n".join(f"{role}:{text}" for role, text in said).encode("utf-8", "surrogatepass")).hexdigest() for said in repaired]
    found["gaps"] = np.where(found["distinct"] > 0, found["high"] - found["low"] + 1 - found["distinct"], 0)
    found["cost"] = cost
    return pa.RecordBatch.from_arrays([conv, *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array([a.decode() for a in audits]), pa.array(digests)], names=["conv", *COUNTS, "audit", "repaired_sha256"])


def _result_schema(rows: DataFrame, turns: bool) -> T.StructType:
    conv = T.StructField("conv", rows.schema["conv"].dataType)
    return T.StructType([conv, *(T._parse_datatype_string("place long, role string, text string").fields if turns else _DONE.fields)])


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations that fit a task, by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, owner in _groups(batches, ["g"]):
            yield _repair_chunk(table, owner, turns)

    dealt = rows.repartition(tasks_for(rows), "g").sortWithinPartitions("g", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(run, _result_schema(rows, turns))


_MARKS = "g string, seg long, conv_turn_low long, conv_turn_high long, first_turn long, last_turn long, first_initial byte, last_initial byte, distinct long, blank long, duplicate long, truncated long, illegal long, costs array<long>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch its counts, what stands at its ends, and its costs between states."""
    for rows, owner in _groups(batches, ["g", "seg"]):
        n = int(owner[-1]) + 1
        heads = np.searchsorted(owner, np.arange(n + 1))
        initial = _numbers(rows, "initial").astype(np.int8)
        blank, again, cut = (np.asarray(rows.column(c)).astype(bool) for c in ("blank", "again", "cut"))
        found = _tallies(owner, n, _numbers(rows, "turn"), ~np.asarray(rows.column("turn").is_null()), initial, blank, again, cut)
        kind, moves = _kinds(blank, again, cut), [None] * n
        for groups, at, own, place, lengths in _by_length(owner, n):
            for g, m in zip(groups.tolist(), R.transfer(*R.align(own, place, lengths, initial[at], kind[at])).reshape(-1, 16).tolist()):
                moves[g] = m
        ends = [rows.column(c).take(pa.array(at)).combine_chunks() for c in ("turn", "initial") for at in (heads[:-1], heads[1:] - 1)]
        some = found["distinct"] > 0
        turns = [pa.array(found[c], pa.int64(), mask=~some) for c in ("low", "high")]
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(c).take(pa.array(heads[:-1])).combine_chunks() for c in ("g", "seg")), *turns, *ends, *(pa.array(found[c]) for c in ("distinct", "blank", "duplicate", "truncated", "illegal")), pa.array(moves, pa.list_(pa.int64()))],
            names=[f.split()[0] for f in _MARKS.split(", ")],
        )


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stretches (g, seg, costs), the last first: the costs behind each."""
    g, behind = None, None
    for batch in batches:
        out = []
        for key, moves in zip(batch.column("g").to_pylist(), batch.column("costs").to_pylist()):
            if key != g:
                g, behind = key, R.END.astype(np.int64)
            out.append(behind.tolist())
            behind = np.minimum((np.array(moves).reshape(4, 4) + behind).min(1), R.NEVER)
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("seg"), pa.array(out, pa.list_(pa.int64()))], names=["g", "seg", "behind"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch and each state before it: its edits, its cost with all that follows, and the state behind it."""
    for rows, owner in _groups(batches, ["g", "seg"]):
        n = int(owner[-1]) + 1
        heads = np.searchsorted(owner, np.arange(n))
        initial = _numbers(rows, "initial").astype(np.int8)
        kind = _kinds(*(np.asarray(rows.column(c)).astype(bool) for c in ("blank", "again", "cut")))
        behind = np.array(rows.column("behind").take(pa.array(heads)).to_pylist()).T
        last = np.asarray(rows.column("is_last").take(pa.array(heads)))
        keys = [rows.column(c).take(pa.array(heads)).combine_chunks() for c in ("g", "seg")]
        for closes in (False, True):
            for groups, at, own, place, lengths in _by_length(owner, n):
                picked = last[groups] == closes
                if not picked.any():
                    continue
                few = picked[own]
                number = np.cumsum(picked) - 1
                first, what = R.align(number[own[few]], place[few], lengths[picked], initial[at[few]], kind[at[few]])
                known = R.costs(first, what, behind[:, groups[picked]])
                each = [R.trace(first, what, known, np.full(first.shape[1], s), closes) for s in range(4)]
                index = pa.array(groups[picked])
                yield pa.RecordBatch.from_arrays(
                    [*(k.take(index) for k in keys), pa.array([[e[0][k].decode() for e in each] for k in range(first.shape[1])], pa.list_(pa.string())), pa.array([[int(e[1][k]) for e in each] for k in range(first.shape[1])], pa.list_(pa.int32())), pa.array(known[0].T.tolist(), pa.list_(pa.int64()))],
                    names=["g", "seg", "audits", "states", "total"],
                )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stretches in order: the edits of each, given the state before it."""
    g, state = None, 0
    for batch in batches:
        starts, audits = [], []
        for key, edits, states in zip(*(batch.column(c).to_pylist() for c in ("g", "audits", "states"))):
            if key != g:
                g, state = key, 0
            starts.append(state)
            audits.append(edits[state])
            state = states[state]
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("seg"), pa.array(starts, pa.int32()), pa.array(audits)], names=["g", "seg", "state", "audit"])


def _long(rows: DataFrame, turns: bool, stretch: int) -> DataFrame:
    """Conversations of any length, in stretches."""
    placed = with_positions(rows.filter("present"), "g", [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "talks")
    placed = materialize(placed.withColumn("seg", F.floor(F.col("position") / stretch)).withColumn("is_last", F.floor((F.col("group_rows") - 1) / stretch) == F.col("seg")), "talks-placed")
    # Whoever says it first: one row for each text, so no key is hot.
    said = F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), "UTF-8"), 256)
    first = placed.groupBy("g", said.alias("said")).agg(F.min("position").alias("position")).select("g", "position", F.lit(False).alias("again"))
    slim = placed.select("g", "position", "seg", "is_last", "turn", "initial", "blank", "cut").join(first, ["g", "position"], "left").withColumn("again", F.coalesce("again", F.lit(True)))
    slim = materialize(slim, "talks-slim")
    tasks = tasks_for(slim)
    by_stretch = lambda df: df.repartition(tasks, "g", "seg").sortWithinPartitions("g", "seg", "position")
    marks = materialize(by_stretch(slim).select("g", "seg", "turn", "initial", "blank", "again", "cut").mapInArrow(_measure, _MARKS), "talks-marks")
    behind = marks.select("g", "seg", "costs").repartition(tasks, "g").sortWithinPartitions("g", F.desc("seg")).mapInArrow(_costs_behind, "g string, seg long, behind array<long>")
    traced = materialize(by_stretch(slim.join(behind, ["g", "seg"])).select("g", "seg", "is_last", "initial", "blank", "again", "cut", "behind").mapInArrow(_traces, "g string, seg long, audits array<string>, states array<int>, total array<long>"), "talks-traces")
    chained = materialize(traced.select("g", "seg", "audits", "states").repartition(tasks, "g").sortWithinPartitions("g", "seg").mapInArrow(_chain, "g string, seg long, state int, audit string"), "talks-edits")
    edited = placed.select("g", "conv", "seg", "position", "role", "text").join(chained, ["g", "seg"]).repartition(tasks, "g").sortWithinPartitions("g", "position")
    if turns:
        return edited.mapInArrow(_long_turns, _result_schema(rows, True))
    digests = edited.mapInArrow(_long_digest, T.StructType([T.StructField("g", T.StringType()), rows.schema["conv"], T.StructField("repaired_sha256", T.StringType())]))
    edges = F.array_sort(F.collect_list(F.struct("seg", "first_turn", "last_turn", "first_initial", "last_initial")))
    met = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: F.struct((a["last_turn"] == b["first_turn"]).alias("same"), F.array_contains(F.array(*[F.lit(10 * i + j) for i, j in zip(*map(list, np.nonzero(_LEGAL)))]), 10 * a["last_initial"] + b["first_initial"]).alias("legal")))
    total = lambda c: F.sum(c).alias(c)
    counted = marks.groupBy("g").agg(F.min("conv_turn_low").alias("low"), F.max("conv_turn_high").alias("high"), *(total(c) for c in ("distinct", "blank", "duplicate", "truncated", "illegal")), edges.alias("edges")).withColumn("met", met)
    size_of = lambda test: F.size(F.filter("met", test))
    shown = counted.select("g", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct") + size_of(lambda m: F.coalesce(m["same"], F.lit(False))), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + size_of(lambda m: ~m["legal"])).alias("illegal"))
    audits = chained.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    cost = traced.filter("seg = 0").select("g", F.get("total", F.lit(0)).alias("cost"))
    return shown.join(cost, "g").join(audits, "g").join(digests, "g").select("conv", *COUNTS, "audit", "repaired_sha256")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str, object, list]]:
    """(g, g's conv, repaired turns) of each stretch, in order."""
    for rows, owner in _groups(batches, ["g", "seg"]):
        heads = np.searchsorted(owner, np.arange(int(owner[-1]) + 2)).tolist()
        for low, high in zip(heads, heads[1:]):
            part = rows.slice(low, high - low)
            value = lambda c: part.column(c)[0].as_py()
            yield value("g"), value("conv"), R.replay(value("audit").encode(), value("state"), part.column("role").to_pylist(), part.column("text").to_pylist())[0]


def _long_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, conv, repaired_sha256) of conversations read as a stream."""
    g = conv = digest = None
    kind = None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([g]), pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["g", "conv", "repaired_sha256"])

    def kept(source):
        nonlocal kind
        for b in source:
            kind = b.schema.field("conv").type
            yield b

    for key, own, said in _pieces(kept(batches)):
        if key != g or digest is None:
            if digest is not None:
                yield done()
            g, conv, digest, empty = key, own, hashlib.sha256(), True
        for role, text in said:
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            empty = False
    if digest is not None:
        yield done()


def _long_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, place, role, text) of conversations read as a stream."""
    g, place, kind = None, 0, None

    def kept(source):
        nonlocal kind
        for b in source:
            kind = b.schema.field("conv").type
            yield b

    for key, conv, said in _pieces(kept(batches)):
        g, place = (g, place) if key == g else (key, 0)
        yield pa.RecordBatch.from_arrays([pa.array([conv] * len(said), kind), pa.array(range(place, place + len(said)), pa.int64()), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.string())], names=["conv", "place", "role", "text"])
        place += len(said)


def repair_conversations(rows: DataFrame, key: str = "conv_id", turns: bool = False, stretch: int = STRETCH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """For each conversation of rows (key, turn, role, text, and present, false where a row only tells that its conversation exists): key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. With turns: the repaired turns, as rows (key, place, role, text)."""
    bound_batches(rows.sparkSession)
    marked = rows if "present" in rows.columns else rows.withColumn("present", F.lit(True))
    plain = _features(marked.select(key, "turn", "role", "text", "present"), key)
    size = F.sum(F.octet_length("text"))
    long_ = materialize(plain.groupBy("g").agg(F.count_if("present").alias("n"), size.alias("bytes")).filter((F.col("n") > stretch) | (F.col("bytes") > most_bytes)).select("g"), "long-talks")
    if long_.isEmpty():
        return _short(plain, turns).withColumnRenamed("conv", key)
    both = _short(plain.join(long_, "g", "left_anti"), turns).unionByName(_long(plain.join(long_, "g", "left_semi"), turns, stretch))
    return both.withColumnRenamed("conv", key)
