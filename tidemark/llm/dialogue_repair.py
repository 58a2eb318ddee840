"""Repairing the structure of conversations at the least cost of edits, by a rank-convergence parallel Viterbi.

Rows are range-sorted by conversation and turn and cut into chunks, so a very long conversation is many chunks in many
tasks. A row needs one letter for the Viterbi: initial of its role, and whether it is faulty. Costs are carried backwards
over four states (nothing yet, after the system's, the user's, the assistant's row). The last chunk of a conversation starts
from the true end, the others from a speculative cost vector; a fix-up pass gives each chunk the vector that its
successor has found and runs it again where that differs from the assumed one by more than a constant. Where some chunk never
converges within a few passes, chunks run once more from the four unit vectors, and their cost matrices are multiplied
along the conversation. With the stitched costs every chunk traces its ASCII-least audit from each state it may start in;
the states are then composed along the conversation.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.batches import only, released, rows as record, slices
from tidemark.plans.checkpoints import stable

CHUNK_ROWS, CHUNK_BYTES = 4_096, 4 << 20
PASSES = 6
SPACE = "\x20\t\n\x0b\x0c\r"
RETAG, DELETE, INSERT, CUT = 3, 4, 3, 3  # costs; an undeleted truncated row costs CUT more
NONE, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows end with so far
FAR = 1 << 40  # no way there; far above any cost, far below an overflow
DROPPED, MUST_GO, TRUNCATED, REPEAT = 16, 1, 2, 3  # letters: DROPPED, or 4 * initial and one of 0, MUST_GO (blank), TRUNCATED, REPEAT (must go too)
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an inserted or retagged row


def _closure() -> np.ndarray:
    """Least cost of insertions from state to state."""
    cost = np.full((4, 4), FAR)
    for i in range(4):
        j, paid = i, 0
        while paid < cost[i, j]:
            cost[i, j] = paid
            j, paid = NEXT[j], paid + INSERT
    return cost


def _step(letter: int) -> np.ndarray:
    """Least cost from state to state by insertions and then one row of this kind."""
    edit = np.full((4, 4), FAR)
    if letter == DROPPED:
        edit[range(4), range(4)] = 0
    else:
        edit[range(4), range(4)] = DELETE
        if not letter & MUST_GO:
            extra = CUT if letter & TRUNCATED else 0
            for i in range(4):
                edit[i, NEXT[i]] = min(edit[i, NEXT[i]], RETAG + extra)
                if (j := _kept(letter, i)) is not None:
                    edit[i, j] = min(edit[i, j], extra)
    return np.minimum(FAR, (_closure()[:, :, None] + edit[None, :, :]).min(axis=1))


def _kept(letter: int, state: int) -> int | None:
    """The state after keeping the row as it is; None where the roles then don't fit."""
    initial = letter >> 2
    if initial == 0:
        return SYSTEM if state == NONE else None
    return NEXT[state] if initial < 3 and NEXT[state] == (USER, ASSISTANT)[initial - 1] else None


STEPS = np.stack([_step(i) for i in range(DROPPED + 1)])
END = _closure()[:, [NONE, ASSISTANT]].min(axis=1)


def _backward(letters: list[np.ndarray], ends: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cost vectors before the first row of every chunk, for cost vectors after its last; and those before every row, if asked for.

    All chunks go together, longest first, so a step works on the chunks that still have rows.
    """
    order = np.argsort([-len(x) for x in letters], kind="stable")
    vectors, lengths = ends.astype(np.int64).copy(), np.array([len(x) for x in letters], np.int64)
    every = [np.empty((n, 4), np.int64) for n in lengths] if keep else []
    longest = int(lengths.max()) if len(lengths) else 0
    for back in range(1, longest + 1):
        alive = order[:int(np.searchsorted(-lengths[order], -back, side="right"))]
        step = STEPS[np.array([letters[i][-back] for i in alive])]
        vectors[alive] = np.minimum(FAR, (step + vectors[alive][:, None, :]).min(axis=2))
        for i in alive if keep else ():
            every[i][-back] = vectors[i]
    return vectors, every


def _trace(letters: np.ndarray, costs: np.ndarray, end: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least audit of least cost from ``state``, and the state after it.

    ``costs`` holds the vectors before each row, ``end`` that after the last row. In ASCII, Delete is before Insert, Keep and Rerole, and
    each letter leads to one state, so the least letter with an optimal rest is right each time.
    """
    audit, n = [], len(letters)
    for t in range(n):
        letter, after = int(letters[t]), costs[t + 1] if t + 1 < n else end
        if letter == DROPPED:
            continue
        extra = CUT if letter & TRUNCATED else 0
        while True:
            left = costs[t][state]
            if DELETE + after[state] == left:
                audit.append("D")
                break
            if INSERT + costs[t][NEXT[state]] == left:
                audit.append("I")
                state = NEXT[state]
                continue
            kept = None if letter & MUST_GO else _kept(letter, state)
            if kept is not None and extra + after[kept] == left:
                audit.append("K")
                state = kept
            else:
                audit.append("R")
                state = NEXT[state]
            break
    while last and state in (SYSTEM, USER):
        audit.append("I")
        state = NEXT[state]
    return "".join(audit), state


def _repaired(audit: str, state: int, letters: list[int], roles: list, texts: list) -> tuple[list[str], int]:
    """``role:text`` of the repaired rows, and what the edits cost."""
    out, cost = [], 0
    rows = (i for i, x in enumerate(letters) if x != DROPPED)
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            cost += DELETE
            continue
        state = _kept(letters[row], state) if edit == "K" else NEXT[state]
        role = roles[row] if edit == "K" else ("user", "assistant")[state - USER]
        out.append(f"{role}:{'' if row is None else texts[row]}")
        cost += (0 if edit == "K" else INSERT if edit == "I" else RETAG) + (CUT if row is not None and letters[row] & TRUNCATED else 0)
    return out, cost


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, dropped) of (conv, turn, role, text): nulls of role and text become a space, then crc32(``conv:turn``) modulo 20 decides.

    0 drops the row, 1 empties its text, 2 takes out all of ``.!?``, 3 repeats it, 4 gives it the role user.
    """
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hurt = rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return hurt.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")


CHUNK_TYPE = "conv long, chunk long, letters binary, turns array<long>, roles array<string>, texts array<string>"


def _signature(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _letter(role: str, text: str) -> int:
    bare = text.rstrip(SPACE)
    return 4 * INITIALS.get(role[:1], 3) + (MUST_GO if not bare else 0 if bare[-1] in ".!?" else TRUNCATED)


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(conv, chunk, letters, turns, roles, texts): neighbouring rows of a conversation in order; numbers of chunks rise along it.

    Rows are ordered by turn, nulls first, then by the md5 of role and text. A row that repeats an earlier one of its chunk must go.
    """
    tie = F.md5(F.concat_ws(":", "role", "text").cast("binary"))
    sorted_ = rows.withColumn("_tie", tie).repartitionByRange("conv", "turn", "_tie").sortWithinPartitions("conv", "turn", "_tie").drop("_tie")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def whole() -> tuple:
            conv, letters, turns, roles, texts, _, _ = held
            return conv, number, bytes(letters), turns, roles, texts

        def packed(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=schema)
        schema, done, size = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("letters", pa.binary()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]), [], 0
        for batch in slices(batches, limit=chunk_bytes):
            for conv, turn, role, text, dropped in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "dropped"))):
                if held is not None and (held[0] != conv or len(held[1]) >= chunk_rows or held[6] >= chunk_bytes):
                    done.append(whole())
                    number, size, held = number + 1, size + held[6], None
                    if size >= chunk_bytes or len(done) >= chunk_rows:
                        yield packed(done)
                        done, size = [], 0
                if held is None:
                    held = [conv, bytearray(), [], [], [], set(), 0]
                letter = DROPPED if dropped else _letter(role, text)
                if not dropped and not letter & MUST_GO:
                    sign = _signature(role, text)
                    if sign in held[5]:
                        letter |= REPEAT
                    held[5].add(sign)
                held[1].append(letter)
                held[2].append(turn)
                held[3].append("" if dropped else role)
                held[4].append("" if dropped else text)
                held[6] += len(text)
        if held is not None:
            done.append(whole())
        if done:
            yield packed(done)
    return sorted_.mapInArrow(run, CHUNK_TYPE)


def _repeats(table: DataFrame, long: DataFrame) -> DataFrame:
    """(conv, chunk, again): of conversations with several chunks, the rows that repeat one of an earlier chunk.

    Each chunk gives a text once, so a text that fills a conversation has one row a chunk here.
    """
    @released
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, chunk, letters, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "letters", "roles", "texts"))):
                at = [i for i, x in enumerate(letters) if x != DROPPED and not x & MUST_GO]
                yield record(conv=pa.array([conv] * len(at), pa.int64()), chunk=pa.array([chunk] * len(at), pa.int64()), at=pa.array(at, pa.int32()), sign=pa.array([_signature(roles[i], texts[i]) for i in at], pa.binary()))
    several = table.join(long, "chunk", "left_semi").select("conv", "chunk", "letters", "roles", "texts").mapInArrow(signs, "conv long, chunk long, at int, sign binary")
    firsts = several.groupBy("conv", "sign").agg(F.min("chunk").alias("_first"))
    later = several.join(firsts.withColumnRenamed("conv", "_conv"), (F.col("conv").eqNullSafe(F.col("_conv"))) & (several["sign"] == firsts["sign"]) & (F.col("chunk") > F.col("_first")))
    return later.groupBy("chunk").agg(F.collect_list("at").alias("again"))


def _flat(vectors: np.ndarray) -> np.ndarray:
    """Cost vectors without their constant."""
    return vectors - vectors[:, :1]


def _run(table: DataFrame) -> DataFrame:
    """(conv, chunk, last, used, found) of (conv, chunk, last, letters, used): the cost vector before the chunk, without its constant, for ``used`` after it."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ends = batch.column("used").flatten().to_numpy().reshape(-1, 4)
                found, _ = _backward([np.frombuffer(x, np.uint8) for x in batch.column("letters").to_pylist()], ends)
                yield record(**{c: batch.column(c) for c in ("conv", "chunk", "last", "used")}, found=pa.array(_flat(found).tolist(), pa.list_(pa.int64())))
    return table.select("conv", "chunk", "last", "letters", "used").mapInArrow(run, "conv long, chunk long, last boolean, used array<long>, found array<long>")


def _matrices(table: DataFrame) -> DataFrame:
    """(chunk, matrix): least costs from state to state through the whole chunk, row by row."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                letters = [np.frombuffer(x, np.uint8) for x in batch.column("letters").to_pylist()]
                unit = [np.where(np.arange(4) == j, 0, FAR) for j in range(4)]
                columns = [_backward(letters, np.tile(u, (len(letters), 1)))[0] for u in unit]
                yield record(chunk=batch.column("chunk"), matrix=pa.array(np.stack(columns, axis=2).reshape(len(letters), 16).tolist(), pa.list_(pa.int64())))
    return table.select("chunk", "letters").mapInArrow(run, "chunk long, matrix array<long>")


def _vector(values: np.ndarray) -> Column:
    return F.array(*[F.lit(int(x)).cast("long") for x in values])


def _stitched(table: DataFrame, passes: int) -> DataFrame:
    """(chunk, end): the cost vector after the last row of every chunk, without its constant, of (conv, chunk, letters, first, last)."""
    along = Window.partitionBy("conv").orderBy("chunk")
    guess = F.when(F.col("last"), _vector(END)).otherwise(_vector(np.zeros(4, int)))
    alone = table.filter(F.col("first") & F.col("last")).select("chunk", _vector(END).alias("end"))
    several = stable(table.filter(~(F.col("first") & F.col("last"))).select("conv", "chunk", "letters", "last", guess.alias("used")))
    state = stable(_run(several))
    for _ in range(passes):
        moved = state.withColumn("want", F.when(F.col("last"), F.col("used")).otherwise(F.lead("found").over(along)))
        state = stable(moved.withColumn("fits", F.col("want") == F.col("used")))
        again = state.filter(~F.col("fits"))
        if again.isEmpty():
            return alone.unionByName(state.select("chunk", F.col("used").alias("end")))
        rerun = _run(again.select("conv", "chunk", "last", F.col("want").alias("used")).join(several.select("chunk", "letters"), "chunk"))
        state = stable(state.filter("fits").select(*rerun.columns).unionByName(rerun))
    return alone.unionByName(_multiplied(several))


def _multiplied(several: DataFrame) -> DataFrame:
    """The same from cost matrices, whatever the rows: one task carries the vectors of a conversation, a few numbers a chunk."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = END
        for batch in batches:
            ends = []
            for last, matrix in zip(batch.column("last").to_pylist(), batch.column("matrix").to_pylist()):
                vector = END if last else vector
                ends.append([int(x) for x in vector])
                vector = (np.array(matrix, np.int64).reshape(4, 4) + vector[None, :]).min(axis=1)
                vector = vector - vector[0]
            yield record(chunk=batch.column("chunk"), end=pa.array(ends, pa.list_(pa.int64())))
    ready = _matrices(several).join(several.select("conv", "chunk", "last"), "chunk").repartition("conv").sortWithinPartitions("conv", F.col("chunk").desc())
    return ready.select("chunk", "last", "matrix").mapInArrow(run, "chunk long, end array<long>")


def _starts(table: DataFrame) -> DataFrame:
    """(chunk, state): where the trace of each chunk starts, of (conv, chunk, letters, end, first, last).

    A chunk alone starts from nothing; elsewhere every chunk is traced from each state and the states are handed on along the conversation.
    """
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                letters, ends = [np.frombuffer(x, np.uint8) for x in batch.column("letters").to_pylist()], np.array(batch.column("end").to_pylist(), np.int64)
                _, costs = _backward(letters, ends, keep=True)
                after = [[_trace(x, c, e, s, False)[1] for s in range(4)] for x, c, e in zip(letters, costs, ends)]
                yield record(**{c: batch.column(c) for c in ("conv", "chunk", "first")}, after=pa.array(after, pa.list_(pa.int32())))

    @released
    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = NONE
        for batch in batches:
            states = []
            for first, after in zip(batch.column("first").to_pylist(), batch.column("after").to_pylist()):
                state = NONE if first else state
                states.append(state)
                state = after[state]
            yield record(chunk=batch.column("chunk"), state=pa.array(states, pa.int32()))
    several = table.filter(~(F.col("first") & F.col("last"))).select("conv", "chunk", "letters", "end", "first")
    traced = several.mapInArrow(run, "conv long, chunk long, first boolean, after array<int>").repartition("conv").sortWithinPartitions("conv", "chunk")
    alone = table.filter(F.col("first") & F.col("last")).select("chunk", F.lit(NONE).alias("state"))
    return alone.unionByName(traced.select("chunk", "first", "after").mapInArrow(hand_on, "chunk long, state int"))


PIECE_TYPE = "conv long, chunk long, cost long, audit string, repaired string, sha string, blank long, duplicate long, truncated long, illegal long, initials string, low long, high long, turns long, turn_a long, turn_b long"


def _pieces(table: DataFrame) -> DataFrame:
    """What every chunk adds: its part of the audit and of the repaired text (only its hash where it is the whole conversation), and counts."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv", "chunk", "letters", "turns", "roles", "texts", "end", "state", "first", "last")
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = list(zip(*(batch.column(c).to_pylist() for c in names)))
            letters, ends = [np.frombuffer(x[2], np.uint8) for x in lines], np.array([x[6] for x in lines], np.int64)
            _, costs = _backward(letters, ends, keep=True)
            out = []
            for (conv, chunk, _, turns, roles, texts, _, state, first, last), own, cost, end in zip(lines, letters, costs, ends):
                audit, _ = _trace(own, cost, end, state, last)
                kinds = own.tolist()
                parts, paid = _repaired(audit, state, kinds, roles, texts)
                live = [i for i, x in enumerate(kinds) if x != DROPPED]
                faults = Counter(kinds[i] & 3 for i in live)
                initials = [roles[i][:1] or "-" for i in live]
                there = [turns[i] for i in live if turns[i] is not None]
                whole = "\n".join(parts)
                out.append({"conv": conv, "chunk": chunk, "cost": paid, "audit": audit, "repaired": None if first and last or not parts else whole,
                            "sha": hashlib.sha256(whole.encode()).hexdigest() if first and last else None,
                            "blank": faults[MUST_GO], "duplicate": faults[REPEAT], "truncated": faults[TRUNCATED],
                            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "initials": "".join(initials[:1] + initials[-1:]),
                            "low": min(there, default=None), "high": max(there, default=None), "turns": len(set(there)), "turn_a": there[0] if there else None, "turn_b": there[-1] if there else None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, types[k]) for n, k in (c.split() for c in PIECE_TYPE.split(", "))])
    return table.mapInArrow(run, PIECE_TYPE)


def _sums(pieces: DataFrame) -> DataFrame:
    """One row a conversation from its chunks' pieces, read in order; the hash of a long conversation is carried from chunk to chunk."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, seen = None, None, False

        def done() -> pa.RecordBatch:
            gaps = held["high"] - held["low"] + 1 - held["turns"] if held["low"] is not None else 0
            return pa.RecordBatch.from_pylist([{"conv": conv, "gaps": gaps, **{k: held[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")},
                                                "audit": "".join(held["audit"]), "sha": held["sha"] or held["hash"].hexdigest()}], schema=schema)
        for batch in batches:
            for row in batch.to_pylist():
                if seen and row["conv"] != conv:
                    yield done()
                if not seen or row["conv"] != conv:
                    seen, conv = True, row["conv"]
                    held = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0) | {"audit": [], "hash": hashlib.sha256(), "any": False, "sha": None, "low": None, "high": None, "initial": "", "turn": None}
                for k in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    held[k] += row[k]
                held["audit"].append(row["audit"])
                held["sha"] = row["sha"]
                if row["repaired"] is not None:
                    held["hash"].update(("\n" * held["any"] + row["repaired"]).encode())
                    held["any"] = True
                if row["initials"]:
                    held["illegal"] += bool(held["initial"]) and held["initial"] + row["initials"][0] not in LEGAL
                    held["initial"] = row["initials"][-1]
                if row["low"] is not None:
                    held["turns"] -= held["turn"] == row["turn_a"]  # a turn on both sides of the cut
                    held["low"], held["high"], held["turn"] = row["low"] if held["low"] is None else held["low"], row["high"], row["turn_b"]
        if seen:
            yield done()
    schema = pa.schema([("conv", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("sha", pa.string())])
    return pieces.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(run, "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string")


def _letters(table: DataFrame) -> DataFrame:
    """(conv, chunk, letters, first, last) with the repeats across chunks marked."""
    along = Window.partitionBy("conv").orderBy("chunk")
    ends = stable(table.select("conv", "chunk", "letters", F.lag("chunk").over(along).isNull().alias("first"), F.lead("chunk").over(along).isNull().alias("last")))
    alone = F.col("first") & F.col("last")

    @released
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for letters, again in zip(batch.column("letters").to_pylist(), batch.column("again").to_pylist()):
                own = np.frombuffer(letters, np.uint8).copy()
                own[again or []] |= REPEAT
                out.append(own.tobytes())
            yield record(**{c: batch.column(c) for c in ("conv", "chunk")}, letters=pa.array(out, pa.binary()), **{c: batch.column(c) for c in ("first", "last")})
    several = ends.filter(~alone)
    marked = several.join(_repeats(table, several.select("chunk")), "chunk", "left").select("conv", "chunk", "letters", "first", "last", "again")
    return stable(ends.filter(alone).unionByName(marked.mapInArrow(mark, "conv long, chunk long, letters binary, first boolean, last boolean").select(*ends.columns)))


def repair(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", harm: bool = False,
           chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, passes: int = PASSES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for every conversation.

    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (doesn't end in ``.!?``). Keeping a row costs
    nothing, retagging it 3, deleting it 4 (a must for blank and duplicate ones), inserting an empty one 3, an undeleted truncated row 3 more.
    The cheapest edits after which initials of roles read ``(s?(ua)+)?`` make the audit, the ASCII-least of equals. ``harm`` damages the rows
    first (see ``damage``); a conversation that loses all rows has zeros, an empty audit and the hash of an empty text.

    Null ids are one conversation; null turns come first and count in no gap; a null role or text is one space. Equal rows of a turn are
    interchangeable, others of a turn are in the order of md5(role:text). Other roles than system, user, assistant go by their initial.
    Extra columns don't matter; an empty table gives no rows. Only the finished hash of a conversation is taken in sequence, chunk by
    chunk; no task holds more than a chunk.
    """
    plain = only(rows, conv=conv_id, turn=turn, role=role, text=text).select(F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    given = damage(plain) if harm else plain.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))
    table = stable(chunks(given, chunk_rows, chunk_bytes))
    letters = _letters(table)
    known = stable(letters.join(_stitched(letters, passes), "chunk"))
    traced = known.join(_starts(known), "chunk").select("chunk", "letters", "end", "state", "first", "last")
    found = _sums(_pieces(table.drop("letters").join(traced, "chunk")))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def _added(value: str, cost: str, letter: str, line: str | None) -> str:
    """SQL for a step before ``value``: cost in six digits, audit, a mark, the repaired lines. Values are compared as they are."""
    mark = f"strpos({value}, chr(1))"
    text = f"substr({value}, {mark} + 1)"
    lines = text if line is None else f"{line} || CASE WHEN {text} = '' THEN '' ELSE chr(10) || {text} END"
    return f"lpad((substr({value}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || '{letter}' || substr({value}, 7, {mark} - 7) || chr(1) || {lines}"


def _sql() -> str:
    name = {USER: "user", ASSISTANT: "assistant"}
    own = "(r.role || ':' || r.text)"

    def after_row(i: int) -> str:
        free = NEXT[i]
        kept = [f"CASE WHEN NOT must AND substr(r.role, 1, 1) = '{letter}' THEN {_added(f'b{to}', 'CASE WHEN cut THEN 3 ELSE 0 END', 'K', own)} END"
                for letter, to in ((name[free][0], free), *([("s", SYSTEM)] if i == NONE else []))]
        moved = _added(f"b{free}", "CASE WHEN cut THEN 6 ELSE 3 END", "R", f"'{name[free]}:' || r.text")
        return f"least({_added(f'b{i}', '4', 'D', None)}, {', '.join(kept)}, CASE WHEN NOT must THEN {moved} END) AS x{i}"

    def inserted(i: int) -> str:
        one, two = NEXT[i], NEXT[NEXT[i]]
        first = _added(f"x{one}", "3", "I", f"'{name[one]}:'")
        second = _added(f"x{two}", "6", "II", f"'{name[one]}:' || chr(10) || '{name[two]}:'")
        return f"least(x{i}, {first}" + (f", {second}" if two != i else "") + f") AS b{i}"
    ends = {NONE: "'000000' || chr(1)", SYSTEM: "'000006II' || chr(1) || 'user:' || chr(10) || 'assistant:'", USER: "'000003I' || chr(1) || 'assistant:'", ASSISTANT: "'000000' || chr(1)"}
    return f"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
 tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
 ky AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 cr AS (SELECT ky.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::INT])), 4294967295) % 20 AS h FROM ky, tab),
 hu AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM cr WHERE h <> 0),
 nu AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hu),
 fa AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
   lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substr(role, 1, 1) AS pair FROM nu),
 r AS (SELECT *, blank OR again AS must, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM fa),
 w(conv_id, n, b0, b1, b2, b3) AS (SELECT conv_id, max(n) + 1, {ends[0]}, {ends[1]}, {ends[2]}, {ends[3]} FROM r GROUP BY conv_id
   UNION ALL SELECT conv_id, n, {", ".join(inserted(i) for i in range(4))}
     FROM (SELECT w.conv_id, r.n, {", ".join(after_row(i) for i in range(4))} FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n - 1)),
 st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum((again AND NOT blank)::INT)::BIGINT AS duplicate, sum(cut::INT)::BIGINT AS truncated,
   sum(coalesce(pair NOT IN ('su', 'ua', 'au'), false)::INT)::BIGINT AS illegal FROM r GROUP BY conv_id),
 al AS (SELECT DISTINCT conv_id FROM conversations)
SELECT al.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(substr(b0, 1, 6)::BIGINT, 0) AS cost, coalesce(substr(b0, 7, strpos(b0, chr(1)) - 7), '') AS audit, sha256(coalesce(substr(b0, strpos(b0, chr(1)) + 1), '')) AS repaired_sha256
FROM al LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM al.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM al.conv_id AND w.n = 1
"""


SQL = _sql()
