"""Repaired conversations against a search over all edits, with long conversations cut into many chunks."""

import functools
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import dialogue_repair

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def searched(conv, rows):
    """Least (cost, audit) over all edits of one conversation, and what it describes."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials, turns = [r[1][:1] for r in rows], [r[0] for r in rows if r[0] is not None]

    @functools.cache
    def best(i, state, inserted):
        free = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[free]
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def take(cost, edit, rest, line=None):
            found.append((cost + rest[0], edit + rest[1], (() if line is None else (line,)) + rest[2]))
        if inserted < 3:
            take(3, "I", best(i, free, inserted + 1), f"{name}:")
        if i < len(rows):
            take(4, "D", best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                more, (_, role, text), own = 3 * (faults[i] == "truncated"), rows[i], initials[i]
                take(3 + more, "R", best(i + 1, free, 0), f"{name}:{text}")
                if own == free or own == "s" and state == "":
                    take(more, "K", best(i + 1, own, 0), f"{role}:{text}")
        return min(found, default=(10 ** 9, "~", ()))
    cost, audit, lines = best(0, "", 0)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, harm=True):
    by = {r[0]: [] for r in rows}
    for conv, *row in damaged(rows) if harm else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        by[conv].append(row)
    return sorted((searched(c, r) for c, r in by.items()), key=repr)


def generated(shape, seed):
    rnd, rows = random.Random(seed), []
    for conv in (None, 1, 2, 3):
        for i in range(rnd.choice([0, 1, 20, 45])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if shape == "mixed" else shape
            text = rnd.choice(["a.", "b?", "hello there.", "cut off", " \x0b ", "", None, "x! ", "é…"]) if shape == "mixed" else f"t{i}."
            rows.append((conv, rnd.choice([None, i, i // 2]), role, text))
    return rows


@pytest.mark.parametrize("shape, limits", [("mixed", {}), ("mixed", {"chunk_rows": 5}), ("mixed", {"chunk_rows": 3, "passes": 0}), ("system", {"chunk_rows": 4}), ("user", {"chunk_rows": 4, "passes": 2})])
def test_like_a_search_over_all_edits(spark, shape, limits):
    rows = generated(shape, len(shape)) + [(9, 0, "user", "  "), (10, 3, "assistant", "w" * 40_000 + "."), (10, 9, "user", "w" * 40_000)]
    table = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("chunk"), F.lit("x").alias("letters"), F.lit(0).alias("conv")).repartition(3)
    got = dialogue_repair.repair(table, harm=True, **limits)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_undamaged_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a."), (2, 0, "assistant", "a."), (2, 2, "user", "u."), (2, 2, "user", "u."), (3, None, None, None)]
    got = sorted(map(tuple, dialogue_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == expected(rows, harm=False) and got[0][6:8] == (0, "KKK")


def test_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = dialogue_repair.repair(spark.createDataFrame([(conv, 0, "user", "a.")], SCHEMA), harm=True).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert dialogue_repair.repair(spark.createDataFrame([], SCHEMA), harm=True).collect() == []


def test_repeats_across_chunks_and_turns_on_both_sides(spark):
    rows = [(1, i // 3, ("user", "assistant")[i % 2], "the same.") for i in range(30)] + [(1, 50, "user", "new.")]
    got = [tuple(r) for r in dialogue_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(4), chunk_rows=4).collect()]
    assert got == expected(rows, harm=False) and got[0][3] == 28


@pytest.mark.parametrize("seed", range(5))
def test_cost_vectors_of_chunks(seed):
    """A chunk's matrix gives the vector that a run over its rows gives; runs from vectors that differ by a constant differ by it."""
    rnd = np.random.default_rng(seed)
    letters = [rnd.integers(0, 17, n).astype(np.uint8) for n in rnd.integers(0, 30, 8)]
    ends = rnd.integers(0, 9, (8, 4))
    found, every = dialogue_repair._backward(letters, ends, keep=True)
    shifted, _ = dialogue_repair._backward(letters, ends + 7)
    assert (shifted == found + 7).all() and all((e[0] == f).all() for e, f in zip(every, found) if len(e))
    for own, end, f in zip(letters, ends, found):
        vector = end
        for x in own[::-1]:
            vector = (dialogue_repair.STEPS[x] + vector).min(axis=1)
        assert (vector == f).all()
