"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversation_repair
from lodestone.llm import repair_costs as R
from lodestone.llm.conversation_repair import COUNTS, damage, repair_conversations

SPACE = " \t\n\x0b\x0c\r"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def slow_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        for role in ("user", "assistant"):
            after = steps.get((state, role[0]))
            if after and inserted < 3:
                c, letters, said = best(i, after, inserted + 1)
                options.append((c + 3, "I" + letters, ((role, ""), *said)))
            if after and i < len(rows) and kinds[i] not in ("blank", "duplicate"):
                c, letters, said = best(i + 1, after, 0)
                options.append((c + 3 + 3 * (kinds[i] == "truncated"), "R" + letters, ((role, rows[i][2]), *said)))
        if i < len(rows):
            c, letters, said = best(i + 1, state, 0)
            options.append((c + 4, "D" + letters, said))
            after = steps.get((state, rows[i][1][:1]))
            if after and kinds[i] not in ("blank", "duplicate"):
                c, letters, said = best(i + 1, after, 0)
                options.append((c + 3 * (kinds[i] == "truncated"), "K" + letters, ((rows[i][1], rows[i][2]), *said)))
        return min(options) if options else (10**9, "", ())

    cost, audit, said = best(0, "", 0)
    count = {k: kinds.count(k) for k in ("blank", "duplicate", "truncated")}
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return (gaps, *count.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest), said


SCHEMA = "conv_id long, turn long, role string, text string, g string, seg string, conv string, audit string"


def sample(convs, most, seed=3):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for k in range(rng.randrange(0, most + 1)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.75 else rng.choice(["system", "tool", None, "", "summary", "User"])
            text = rng.choice(["Yes.", "No", "What?", "Well! \n", "", " \t", None, "é", "x" * 300 + ".", f"own {k}."])
            rows.append((None if c == 0 else c, None if rng.random() < 0.05 else k + rng.choice([0, 0, 0, 1, 5]), role, text))
    return rows + rows[:3]


def expected(rows):
    convs = {}
    for conv, *_ in rows:
        convs.setdefault(conv, [])
    for conv, *rest in slow_damage(rows):
        convs[conv].append(tuple(rest))
    return {c: slow_repair(r) for c, r in convs.items()}


@pytest.mark.parametrize("stretch,most_bytes,chunk", [(1024, 10**9, 20_000), (3, 10**9, 7), (1, 10**9, 50), (1024, 200, 20_000)])
def test_repair_is_the_plain_search(spark, monkeypatch, stretch, most_bytes, chunk):
    monkeypatch.setattr(conversation_repair, "CHUNK_ROWS", chunk)
    rows = sample(120, 9)
    frame = damage(spark.createDataFrame([(*r, "g", "s", "c", "a") for r in rows], SCHEMA))
    want = expected(rows)
    got = {r.conv_id: r for r in repair_conversations(frame, stretch=stretch, most_bytes=most_bytes).collect()}
    assert set(got) == set(want) and len({w[0][6] for w in want.values()}) > 40
    for c, (row, _) in want.items():
        assert (*(got[c][k] for k in COUNTS), got[c].audit, got[c].repaired_sha256) == row, c
    turns = {}
    for r in repair_conversations(frame, turns=True, stretch=stretch, most_bytes=most_bytes).collect():
        turns.setdefault(r.conv_id, {})[r.place] = (r.role, r.text)
    assert {c: tuple(t[k] for k in range(len(t))) for c, t in turns.items()} == {c: said for c, (_, said) in want.items() if said}


def test_a_long_conversation_in_stretches(spark):
    rows = sample(1, 0) + [(5, k, "user" if k % 3 else "assistant", f"t{k % 700}.") for k in range(3000)]
    frame = damage(spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA))
    whole, cut = (repair_conversations(frame, stretch=s).collect() for s in (10_000, 128))
    assert whole == cut and len(whole) == 1 and len(whole[0].audit) > 3000


def test_stored_costs_are_those_of_all_lengths():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 7, 400)
    owner = np.repeat(np.arange(400), lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    initial, kind = rng.integers(0, 4, len(owner)).astype(np.int8), rng.integers(1, 4, len(owner)).astype(np.int8)
    first, what = R.align(owner, place, lengths, initial, kind)
    known = R.costs(first, what, np.repeat(R.END[:, None], 400, 1))
    audits, _ = R.trace(first, what, known, np.zeros(400, int), True)
    for n in range(400):
        own = [(None, "suat"[i] if i < 3 else "t", {1: f"{k}.", 2: "", 3: f"{k}"}[w]) for k, (i, w) in enumerate(zip(initial[owner == n], kind[owner == n]))]
        rows = [(k, r, t) for k, (_, r, t) in enumerate(own)]
        want = slow_repair(rows)[0]
        assert (known[0, 0, n], audits[n].decode()) == (want[5], want[6])


def test_no_rows_and_dropped_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(damage(none)).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "x", False), (None, None, None, None, False)], "conv_id long, turn long, role string, text string, present boolean")
    got = repair_conversations(gone).collect()
    assert {r.conv_id for r in got} == {1, None}
    assert all([r[c] for c in COUNTS] == [0] * 6 and r.audit == "" and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got)


def test_damage_is_the_slow_damage(spark):
    rows = sample(60, 9, seed=8)
    frame = damage(spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA))
    got = sorted((tuple(r) for r in frame.filter("present").select("conv_id", "turn", "role", "text").collect()), key=str)
    assert got == sorted(slow_damage(rows), key=str)
    assert frame.filter(~F.col("present")).count() > 0
