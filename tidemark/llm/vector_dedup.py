"""Near-duplicate vectors by cosine, with a packed kd-tree and partial distances.

Unit vectors u, v have cosine >= c exactly if their squared distance is at most D = 2 - 2c. They are rotated by the singular vectors of
a sample, so the first coordinates tell most. Rows are sorted by the leaves of a kd-tree of that sample and packed, a few
megabytes of vectors in one row with its bounding box; equal vectors, known by a 128-bit digest, are one class with a count
before that. Two packs meet where their boxes are no further apart than D. A pack is stored once and read by the tasks that
pair it, so what is written grows as the table does, however many packs meet.

In a meeting the squared distance is summed block by block of coordinates, by matrix products in single precision with room for
their rounding; a pair is left as soon as its sum is past D, and what remains is judged by its cosine in double precision. Each pair
meets in one task. Tasks give link counts and, for the components, a tree of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.batches import only, released
from tidemark.llm.components import connected, tree
from tidemark.llm.vectors import SAMPLE_ROWS, matrix, rotation, usable
from tidemark.plans.checkpoints import drop_stable, stable

BLOCKS = 4
PACK_BYTES = 2 << 20  # of vectors
LEAST_PACK = 512  # rows
PACKS = 32  # of a small table
FILE_PACKS = 2
LEAF_ROWS = 8  # of the sample
BOX = 8  # coordinates
TILE = (256, 512)  # stays in a core's cache
FEW = 16  # a tile with at most one pair in so many is judged pair by pair
PAIRS = 1 << 16
PACKED = "no long, c binary, n binary, p binary, q binary, v binary, lo array<double>, hi array<double>"


class Plan:
    """Rotation, blocks of coordinates, the limit of the squared distance, and a kd-tree of the sample."""

    def __init__(self, turn: np.ndarray, sample: np.ndarray, cosine: float, blocks: int, kind: str, rows: int):
        dim = len(turn)
        self.dim, self.turn, self.cosine, self.kind = dim, turn, cosine, kind
        self.cuts = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
        self.limit = (2 - 2 * cosine) * (1 + 1e-6) + 1e-4  # rounding of single precision included
        self.size = max(1, min(PACK_BYTES // (dim * np.dtype(kind).itemsize), max(LEAST_PACK, rows // PACKS)))
        self.axes: list[int] = []
        self.at: list[float] = []
        depth = max(0, min(int(np.ceil(np.log2(max(8 * rows / self.size, 1)))), int(np.log2(max(len(sample) / LEAF_ROWS, 1)))))
        cells = [sample[:, :self.cuts[1]]]
        for _ in range(depth):
            halves = []
            for x in cells:
                axis = int(x.var(axis=0).argmax()) if len(x) else 0
                cut = float(np.median(x[:, axis])) if len(x) else 0.0
                self.axes.append(axis)
                self.at.append(cut)
                halves += [x[x[:, axis] <= cut], x[x[:, axis] > cut]]
            cells = halves
        self.depth = depth

    def leaves(self, z: np.ndarray) -> np.ndarray:
        at, axes, cuts, rows = np.zeros(len(z), np.int64), np.array(self.axes, np.int64), np.array(self.at), np.arange(len(z))
        for _ in range(self.depth):
            at = 2 * at + 1 + (z[rows, axes[at]] > cuts[at])
        return at

    def vectors(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows by their length in double precision; the largest component goes first, so nothing overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _digests(v: np.ndarray) -> np.ndarray:
    """Two whole numbers for each row, the same for equal rows."""
    return np.frombuffer(b"".join(blake2b(r.tobytes(), digest_size=16).digest() for r in v + 0.0), np.int64).reshape(-1, 2)


def _unit(one: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit_rows(matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": pa.ListArray.from_arrays(np.arange(0, u.size + 1, dim, dtype=np.int32), u.ravel())})
    return one.mapInArrow(run, "id long, v array<double>")


def _members(one: DataFrame, dim: int) -> DataFrame:
    """(id, p, q): the digest of each row's vector."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _digests(matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "p": d[:, 0].copy(), "q": d[:, 1].copy()})
    return one.mapInArrow(run, "id long, p long, q long")


def _placed(one: DataFrame, plan: Plan) -> DataFrame:
    """(leaf, p, q, c, n, v): a row per distinct vector of a batch, with its least id and its number of rows."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"), plan.dim)
            d = _digests(v)
            _, first, own = np.unique(d, axis=0, return_index=True, return_inverse=True)
            c = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(c, own.ravel(), batch.column("id").to_numpy())
            raw = np.ascontiguousarray((v[first] + 0.0).astype(plan.kind))
            yield pa.RecordBatch.from_pydict({"leaf": plan.leaves(unit_rows(v[first]) @ plan.turn[:, :plan.cuts[1]]), "p": d[first, 0], "q": d[first, 1], "c": c,
                                              "n": np.bincount(own.ravel(), minlength=len(first)), "v": pa.array([r.tobytes() for r in raw], pa.binary())})
    return one.mapInArrow(run, "leaf long, p long, q long, c long, n long, v binary")


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """[p, q, c, n, v] with rows of the same digest, which are neighbours, made one."""
    held = None
    for batch in batches:
        if batch.num_rows:
            some = [batch.column(x).to_numpy() for x in ("p", "q", "c", "n")] + [np.array(batch.column("v").to_pylist(), object)]
            if held is not None:
                some = [np.concatenate(x) for x in zip(held, some)]
            starts = np.nonzero(np.r_[True, (np.diff(some[0]) != 0) | (np.diff(some[1]) != 0)])[0]
            made = [some[0][starts], some[1][starts], np.minimum.reduceat(some[2], starts), np.add.reduceat(some[3], starts), some[4][starts]]
            held = [x[-1:] for x in made]
            yield [x[:-1] for x in made]
    if held is not None:
        yield held


def _packs(placed: DataFrame, plan: Plan) -> DataFrame:
    """Neighbouring classes in rows of ``plan.size``."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def pack(rows: list[np.ndarray]) -> pa.RecordBatch:
            raw = b"".join(rows[4])
            z = unit_rows(plan.vectors(raw).astype(float)) @ plan.turn[:, :min(BOX, plan.dim)]
            p, q, c, n = (x.astype(np.int64).tobytes() for x in rows[:4])
            return pa.RecordBatch.from_pydict({"no": [number], "c": [c], "n": [n], "p": [p], "q": [q], "v": [raw], "lo": [z.min(axis=0).tolist()], "hi": [z.max(axis=0).tolist()]})
        for some in _classes(batches):
            held = some if held is None else [np.concatenate(x) for x in zip(held, some)]
            while len(held[0]) >= plan.size:
                yield pack([x[:plan.size] for x in held])
                held, number = [x[plan.size:] for x in held], number + 1
        if held is not None and len(held[0]):
            yield pack(held)
    return placed.mapInArrow(run, PACKED)


def _unpacked(packs: DataFrame) -> DataFrame:
    """(p, q, c, n) of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in zip(*(batch.column(x).to_pylist() for x in ("p", "q", "c", "n"))):
                yield pa.RecordBatch.from_pydict({x: np.frombuffer(raw, np.int64) for x, raw in zip(("p", "q", "c", "n"), line)})
    return packs.select("p", "q", "c", "n").mapInArrow(run, "p long, q long, c long, n long")


class Side:
    """A pack as one side of a meeting: per block a matrix whose products with the other side's are squared distances."""

    def __init__(self, plan: Plan, c: bytes, n: bytes, v: bytes, left: bool):
        self.c, self.n = np.frombuffer(c, np.int64), np.frombuffer(n, np.int64).astype(float)
        self.u = unit_rows(plan.vectors(v).astype(float))
        self.left, self.turn, self.cuts = left, plan.turn, plan.cuts
        self.made: list[np.ndarray] = []

    def block(self, k: int) -> np.ndarray:
        while len(self.made) <= k:  # most meetings need the first alone
            a, b = self.cuts[len(self.made)], self.cuts[len(self.made) + 1]
            z = self.u @ self.turn[:, a:b]
            s, one = (z * z).sum(axis=1, keepdims=True), np.ones((len(z), 1))
            made = np.concatenate([-2 * z, s, one] if self.left else [z, one, s], axis=1).astype(np.float32)
            self.made.append(made if self.left else np.ascontiguousarray(made.T))
        return self.made[k]


def _true(cells: np.ndarray) -> np.ndarray:
    """Where a table of booleans holds, counted along its rows; mostly it doesn't, so eight are looked at at once."""
    flat = cells.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    near = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return near[flat[near]]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(number, smallest number that the pairs (a, b) reach from it): a tree instead of all pairs."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    low = np.arange(len(names))
    while True:
        least, after = np.minimum(low[x], low[y]), low.copy()
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        after = after[after]
        if (after == low).all():
            both = np.stack([names, names[low]], axis=1)
            return both[both[:, 0] != both[:, 1]]
        low = after


def _meet(plan: Plan, a: Side, b: Side, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of both sides' rows that two packs, or a pack with itself, add, and links that hang the linked classes together."""
    count_a, count_b, ends, pairs, open_, waiting = np.zeros(len(a.c)), np.zeros(len(b.c)), [], [], [], 0

    def judge() -> None:
        rows, cols = (np.concatenate(x) for x in zip(*open_))
        open_.clear()
        for at in range(0, len(rows), PAIRS):
            r, s = rows[at:at + PAIRS], cols[at:at + PAIRS]
            close = np.einsum("ij,ij->i", a.u[r], b.u[s]) >= plan.cosine
            r, s = r[close], s[close]
            if len(r):
                np.add.at(count_a, r, b.n[s])
                np.add.at(count_b, s, a.n[r])
                pairs.append(np.stack([a.c[r], b.c[s]]))
    for i in range(0, len(a.c), TILE[0]):
        for j in range(0, len(b.c), TILE[1]):
            high, wide = min(TILE[0], len(a.c) - i), min(TILE[1], len(b.c) - j)
            if same and j + wide <= i:
                continue
            far, few = a.block(0)[i:i + high] @ b.block(0)[:, j:j + wide], False
            for k in range(1, len(plan.cuts)):
                found = _true(far <= np.float32(plan.limit))
                few = len(found) * FEW <= high * wide
                if few or k == len(plan.cuts) - 1:
                    break
                far += a.block(k)[i:i + high] @ b.block(k)[:, j:j + wide]
            rows, cols = found // wide + i, found % wide + j
            if same:
                rows, cols = rows[rows < cols], cols[rows < cols]
            if not len(rows):
                continue
            if few:
                open_.append((rows, cols))
                waiting += len(rows)
                if waiting > PAIRS:
                    judge()
                    waiting = 0
                continue
            some, others = np.unique(rows), np.unique(cols)
            close = a.u[some] @ b.u[others].T >= plan.cosine
            if same:
                close &= some[:, None] < others[None, :]
            count_a[some] += close @ b.n[others]
            count_b[others] += close.T @ a.n[some]
            ends.append(tree(close, a.c[some], b.c[others]))
    if open_:
        judge()
    if pairs:
        ends.append(_forest(*np.concatenate(pairs, axis=1)))
    return count_a, count_b, np.concatenate(ends) if ends else np.zeros((0, 2), np.int64)


def _apart(coordinates: int) -> Column:
    """Least squared distance of two boxes."""
    gap = lambda k: F.greatest(F.lit(0.0), F.get("b_lo", F.lit(k)) - F.get("a_hi", F.lit(k)), F.get("a_lo", F.lit(k)) - F.get("b_hi", F.lit(k)))
    return reduce(lambda x, y: x + y, [gap(k) * gap(k) for k in range(coordinates)])


def _links(packs: DataFrame, plan: Plan) -> DataFrame:
    """(c, n_links, low): a class's links found in one meeting of two packs, and rows that hang it on the smallest class it reaches there."""
    a, b = (packs.select(*[F.col(x).alias(f"{side}_{x}") for x in ("no", "c", "n", "v", "lo", "hi")]) for side in ("a", "b"))
    even = F.xxhash64(F.least("a_no", "b_no"), F.greatest("a_no", "b_no")) % 2 == 0  # either order, so that all tasks have a part
    once = (F.col("a_no") == F.col("b_no")) | ((F.col("a_no") < F.col("b_no")) == even) & (F.col("a_no") != F.col("b_no"))
    met = a.join(b.hint("shuffle_replicate_nl"), once & (_apart(min(BOX, plan.dim)) <= plan.limit))  # the packs are read again for every task, nothing is shuffled

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, left = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                a_no, a_c, a_n, a_v, b_no, b_c, b_n, b_v = (batch.column(x)[at].as_py() for x in ("a_no", "a_c", "a_n", "a_v", "b_no", "b_c", "b_n", "b_v"))
                if number != a_no:
                    number, left = a_no, Side(plan, a_c, a_n, a_v, True)
                right = Side(plan, b_c, b_n, b_v, False)
                *counts, edges = _meet(plan, left, right, a_no == b_no)
                for c, count in zip((left.c, right.c), counts):
                    found = np.nonzero(count)[0]
                    if len(found):
                        yield pa.RecordBatch.from_pydict({"c": c[found], "n_links": count[found].astype(np.int64), "low": c[found]})
                if len(edges):
                    yield pa.RecordBatch.from_pydict({"c": edges[:, 0].copy(), "n_links": np.zeros(len(edges), np.int64), "low": edges[:, 1].copy()})
    return met.select("a_no", "a_c", "a_n", "a_v", "b_no", "b_c", "b_n", "b_v").mapInArrow(run, "c long, n_links long, low long")


def _single(clean: DataFrame) -> DataFrame:
    """One row per id: of rows that repeat an id the least vector. Only these are shuffled with their vectors."""
    twice = stable(clean.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id"))
    if twice.isEmpty():
        drop_stable(twice)
        return clean
    least = stable(clean.join(twice, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))
    return clean.join(twice, "id", "left_anti").unionByName(least)


def near_duplicates(table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Linked are other ids with a cosine of at least ``cosine`` (above 0). Vectors that are null, empty, zero or hold null or non-finite components
    and null ids link with nothing and are kept; of rows that repeat an id the least vector counts and all get its result; shorter
    vectors are filled with zeros. An empty table gives no rows.
    """
    source = only(table, id=vec_id, v=vector)
    clean = source.filter(usable(F.col("v")) & F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)).select(F.col("id").cast("long").alias("id"), "v")
    dim, rows = clean.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not dim:
        return source.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    element = clean.schema["v"].dataType.elementType
    short = isinstance(element, T.FloatType)
    filled = F.concat("v", F.array_repeat(F.lit(0).cast(element), F.lit(dim) - F.size("v")))
    one = _single(clean).select("id", (filled if short else F.transform(filled, lambda x: x.cast("double"))).alias("v"))
    cut = int(min(1.0, 1.5 * SAMPLE_ROWS / rows) * (1 << 64)) - (1 << 63) - 1  # a third more than the sample needs
    turn, sample = rotation(_unit(one.filter(F.xxhash64("id") <= cut), dim), dim)
    plan = Plan(turn, sample, cosine, blocks, "<f4" if short else "<f8", rows)
    dealt = _placed(one, plan).repartitionByRange(max(1, -(-rows // (FILE_PACKS * plan.size))), "leaf", "p", "q").sortWithinPartitions("leaf", "p", "q")
    packs = stable(_packs(dealt, plan))
    classes, found = stable(_unpacked(packs)), stable(_links(packs, plan))
    drop_stable(packs)
    counts = found.groupBy("c").agg(F.sum("n_links").alias("others"))
    roots = connected(found.select("c", "low"), "c", "low")
    named = (classes.join(counts, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
             .select("p", "q", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "c").alias("component")))
    by_id = _members(one, dim).join(named, ["p", "q"]).select("id", "n_links", "component")
    out = source.select(F.col("id").alias("_raw"), F.col("id").cast("long").alias("id")).join(by_id, "id", "left")
    return out.select(F.col("_raw").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
                      F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, min(embedding) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
 u AS (SELECT vec_id, list_transform(v, lambda x: x::DOUBLE) AS v FROM e),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
       WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.95),
 r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, low) AS component_id, vec_id = least(vec_id, low) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
