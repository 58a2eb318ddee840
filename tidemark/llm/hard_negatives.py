"""Hard negatives of anchors by a sort-tile-recursive packed R-tree.

Rows are packed bottom up: a range sort by label and the coordinate that varies most cuts slabs, a slab is tiled by the next
coordinate into nodes of one label, a node by a third one into pages. Every node and page has a minimum bounding box, so
coordinate by coordinate the inner product with an anchor lies in a known interval. Nodes whose interval misses what a block
of anchors still needs never meet it; within a node each anchor takes pages from a queue, highest possible score first, and
leaves those outside its windows or strictly below its k-th score. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.batches import released
from tidemark.llm.vectors import SAMPLE_ROWS, matrix, usable, width
from tidemark.plans.checkpoints import stable

PAGE, NODE, SLAB = 64, 4_096, 65_536  # rows
ANCHORS = 1_024
FIRST_PAGES = 8  # of the queue that are opened at once; then twice as many each time
EXACT = 2.0 ** 52
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BOX = "lo array<double>, hi array<double>"
NODE_TYPE = f"node long, label long, kind string, ids binary, parts binary, marks binary, {BOX}"
BLOCK_TYPE = f"block long, label long, kind string, ids binary, parts binary, extra binary, low double, high double, {BOX}"


def _kind(parts: np.ndarray) -> str:
    """The shortest integer type that holds all of them."""
    least, most = (parts.min(), parts.max()) if parts.size else (0, 0)
    return next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max)


def _box(parts: np.ndarray) -> dict:
    return {"lo": [parts.min(axis=0).astype(float).tolist()], "hi": [parts.max(axis=0).astype(float).tolist()]}


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one label, at most ``size`` at a time."""
    held, count, label = [], 0, None
    for batch in batches:
        labels = batch.column("label").to_numpy()
        cuts = [0, *(np.nonzero(np.diff(labels))[0] + 1), len(labels)]
        for a, b in zip(cuts, cuts[1:]):
            while a < b:
                if count and (label != labels[a] or count == size):
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, count = [], 0
                take = min(b - a, size - count)
                held.append(batch.slice(a, take))
                count, label, a = count + take, labels[a], a + take
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _longs(batch: pa.RecordBatch, name: str, wide: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, wide)


def _nodes(rows: DataFrame, dim: int, axes: list[int]) -> DataFrame:
    """Slabs tiled into nodes: rows of a node are in the order of their pages."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for slab in _runs(batches, SLAB):
            ids, parts, marks = slab.column("id").to_numpy(), _longs(slab, "v", dim), slab.column("mark").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, parts[:, axes[1]]))
            for at in range(0, len(order), NODE):
                tile = order[at:at + NODE]
                tile = tile[np.lexsort((ids[tile], parts[tile, axes[2]]))]
                kind = _kind(parts[tile])
                yield pa.RecordBatch.from_pydict({"node": [number], "label": [slab.column("label")[0].as_py()], "kind": [kind], "ids": [ids[tile].tobytes()],
                                                  "parts": [parts[tile].astype(kind).tobytes()], "marks": [marks[tile].tobytes()], **_box(parts[tile])})
                number += 1
    return rows.mapInArrow(run, NODE_TYPE)


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _blocks(rows: DataFrame, dim: int, wide: int, low: int | None, high: int | None) -> DataFrame:
    """Blocks of anchors of one label with ``extra``: a score to reach, or for each positive its id, its score and a score to reach.

    ``low`` and ``high`` of a block hold the scores that any of its anchors can use.
    """
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for some in _runs(batches, ANCHORS):
            parts, extra = _longs(some, "v", dim), _longs(some, "extra", wide)
            if low is None:
                least, most = float(extra.min()), float("inf")
            else:
                spans = [_window(int(p), low, high) for p in np.unique(extra[:, 1::3]) if p >= 0]
                least, most = (float(min(a for a, _ in spans)), float(max(b for _, b in spans))) if spans else (float("inf"), float("-inf"))
            kind = _kind(parts)
            yield pa.RecordBatch.from_pydict({"block": [number], "label": [some.column("label")[0].as_py()], "kind": [kind], "ids": [some.column("id").to_numpy().tobytes()],
                                              "parts": [parts.astype(kind).tobytes()], "extra": [extra.tobytes()], "low": [least], "high": [most], **_box(parts)})
            number += 1
    return rows.mapInArrow(run, BLOCK_TYPE)


class Tree:
    """A node's rows, and the boxes of its pages."""

    def __init__(self, ids: bytes, parts: bytes, kind: str, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        whole = np.frombuffer(parts, kind).reshape(-1, dim)
        starts = np.arange(0, len(whole), PAGE)
        self.lo, self.hi = (f(whole, starts, axis=0).astype(float) for f in (np.minimum.reduceat, np.maximum.reduceat))
        self.parts = whole.astype(float)
        self.whole = whole
        self.reach = float(np.sqrt((self.parts ** 2).sum(axis=1).max()))

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each anchor (row) with any row of each page (column), a little widened."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        most, least = up @ self.hi.T + down @ self.lo.T, up @ self.lo.T + down @ self.hi.T
        slack = 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T) + 1e-3
        return least - slack, most + slack

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer products; doubles hold them exactly below 2**52, Python's integers do beyond, limited to 64 bits."""
        if self.reach * float(np.sqrt((anchor.astype(float) ** 2).sum())) < EXACT:
            return (self.parts[rows] @ anchor.astype(float)).astype(np.int64)
        found = self.whole[rows].astype(object) @ anchor.astype(object)
        return np.array([max(LEAST, min(MOST, s)) for s in found], np.int64)


def _best_first(tree: Tree, anchor: np.ndarray, own: int, least: np.ndarray, most: np.ndarray, spans: list[tuple[int, int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the first ``k`` rows in each span (low, high, score to reach), ties to the smaller id; rows below the score to reach may be left out."""
    order = np.argsort(-most, kind="stable")
    none = np.empty(0, np.int64)
    best, need = [(none, none)] * len(spans), [max(a, r) for a, _, r in spans]
    at, step = 0, FIRST_PAGES
    while at < len(order) and most[order[at]] >= min(need):  # what follows in the queue is lower still
        pages = order[at:at + step]
        useful = np.zeros(len(pages), bool)
        for n, (_, b, _) in zip(need, spans):
            useful |= (most[pages] >= n) & (least[pages] <= b)
        at, step = at + len(pages), 2 * step
        rows = (pages[useful][:, None] * PAGE + np.arange(PAGE)).ravel()
        rows = rows[rows < len(tree.ids)]
        if not len(rows):
            continue
        scores = tree.scores(rows, anchor)
        some = np.nonzero((scores >= min(need)) & (scores <= max(b for _, b, _ in spans)) & (tree.ids[rows] != own))[0]
        ids, scores = tree.ids[rows[some]], scores[some]
        for i, (a, b, _) in enumerate(spans):
            fits = (scores >= need[i]) & (scores <= b)
            if fits.any():
                both = np.concatenate([best[i][0], ids[fits]]), np.concatenate([best[i][1], scores[fits]])
                first = np.lexsort((both[0], ~both[1]))[:k]  # ~s is falling in s, without overflow
                best[i] = both[0][first], both[1][first]
                if len(first) == k:
                    need[i] = max(need[i], int(best[i][1][-1]))
    return best


def _emit(anchors: list, positives: list, ids: list, scores: list) -> pa.RecordBatch:
    flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.RecordBatch.from_pydict({"anchor_id": flat(anchors), "positive_id": flat(positives), "id": flat(ids), "score": flat(scores)})


FOUND = "anchor_id long, positive_id long, id long, score long"


def _at_home(nodes: DataFrame, dim: int, k: int) -> DataFrame:
    """The best rows of its own node for each anchor: scores that its positives reach at least."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, parts, kind, marks in zip(*(batch.column(c).to_pylist() for c in ("ids", "parts", "kind", "marks"))):
                tree, out = Tree(ids, parts, kind, dim), ([], [], [], [])
                mine = np.nonzero(np.frombuffer(marks, bool))[0]
                least, most = tree.intervals(tree.parts[mine])
                for i, row in enumerate(mine):
                    (found, scores), = _best_first(tree, tree.whole[row], int(tree.ids[row]), least[i], most[i], [(LEAST, MOST, LEAST)], k)
                    for column, values in zip(out, (np.full(len(found), tree.ids[row]), np.full(len(found), -1), found, scores)):
                        column.append(values)
                yield _emit(*out)
    return nodes.select("ids", "parts", "kind", "marks").mapInArrow(run, FOUND)


def _meet(pairs: DataFrame, dim: int, wide: int, k: int, low: int | None, high: int | None) -> DataFrame:
    """What the anchors of a block find in a node."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("ids", "parts", "kind", "a_ids", "a_parts", "a_kind", "extra")
        key, tree = None, None
        for batch in batches:
            for ids, parts, kind, a_ids, a_parts, a_kind, extra in zip(*(batch.column(c).to_pylist() for c in names)):
                if key != (ids, kind):
                    key, tree = (ids, kind), Tree(ids, parts, kind, dim)
                anchors, own = np.frombuffer(a_parts, a_kind).reshape(-1, dim), np.frombuffer(a_ids, np.int64)
                asked = np.frombuffer(extra, np.int64).reshape(-1, wide)
                least, most = tree.intervals(anchors.astype(float))
                out = ([], [], [], [])
                for i in range(len(own)):
                    if low is None:
                        spans, positives = [(LEAST, MOST, int(asked[i, 0]))], [-1]
                    else:
                        lines = [(int(p), int(s), int(r)) for p, s, r in asked[i].reshape(-1, 3) if s >= 0]
                        spans, positives = [(*_window(s, low, high), r) for _, s, r in lines], [p for p, _, _ in lines]
                    if not spans:
                        continue
                    for positive, (found, scores) in zip(positives, _best_first(tree, anchors[i], int(own[i]), least[i], most[i], spans, k)):
                        for column, values in zip(out, (np.full(len(found), own[i]), np.full(len(found), positive), found, scores)):
                            column.append(values)
                yield _emit(*out)
    return pairs.mapInArrow(run, FOUND)


def _interval(which) -> Column:
    """Bound of the products of two boxes, coordinate by coordinate."""
    corner = F.zip_with(F.arrays_zip("a_lo", "a_hi"), F.arrays_zip("lo", "hi"), lambda a, b: which(a["a_lo"] * b["lo"], a["a_lo"] * b["hi"], a["a_hi"] * b["lo"], a["a_hi"] * b["hi"]))
    return F.aggregate(corner, F.lit(0.0), lambda s, x: s + x)


def _pairs(blocks: DataFrame, nodes: DataFrame, same: bool) -> DataFrame:
    """(block, node, most) that can give a score which some anchor of the block needs; only boxes and labels are compared."""
    a = blocks.select("block", F.col("label").alias("a_label"), "low", "high", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = nodes.select("node", "label", "lo", "hi")
    met = a.join(b, (F.col("a_label") == F.col("label")) if same else (F.col("a_label") != F.col("label")))
    bound = met.select("block", "node", "low", "high", _interval(F.least).alias("least"), _interval(F.greatest).alias("most"))
    slack = 1e-9 * F.greatest(F.abs("least"), F.abs("most")) + 1e-3
    return bound.filter((F.col("most") + slack >= F.col("low")) & (F.col("least") - slack <= F.col("high"))).select("block", "node", "most")


def _joined(pairs: DataFrame, blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    asked = blocks.select("block", F.col("ids").alias("a_ids"), F.col("parts").alias("a_parts"), F.col("kind").alias("a_kind"), "extra")
    return pairs.select("block", "node").join(asked, "block").join(nodes.select("node", "ids", "parts", "kind"), "node")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)


def mine(table: DataFrame, is_anchor: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: float = 256.0,
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its ``positives`` best other rows of the same label by inner product of floor(scale * x); for each one the
    ``negatives`` best rows of other labels with low * positive_score <= 100 * score <= high * positive_score (in percent), ties to the
    smaller id. ``is_anchor`` is a condition on the column ``id``. Rows with a null id or label or an unusable vector take no part; of rows
    that repeat an id the least (label, vector) counts; shorter vectors are filled with zeros. Anchors without another row of their label,
    and windows without a row (all of a negative score), give no rows; an empty table gives none. Components and scores are limited to 64
    bits. A label may hold any share of the rows: its nodes are cut by a range sort that ends with the id.
    """
    empty = table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), (F.col(f"`{label}`") if isinstance(label, str) else label).cast("long").alias("label"))
    clean = named.filter(usable(F.col("v")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    dim = width(clean)
    if not dim:
        return empty
    one = clean.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", F.transform("r.v", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))
    rows = stable(one.select("id", "label", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("mark")))
    few = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    axes = [int(i) for i in np.argsort(-matrix(few, dim).var(axis=0), kind="stable")[[0, min(1, dim - 1), min(2, dim - 1)]]]  # where to cut, never what is found
    count, asked = rows.agg(F.count(F.lit(1)), F.count_if("mark")).first()
    cut = F.col("v")[axes[0]]
    packed = rows.withColumn("_cut", cut).repartitionByRange(max(1, -(-count // SLAB)), "label", "_cut", "id").sortWithinPartitions("label", "_cut", "id").drop("_cut")
    nodes = stable(_nodes(packed, dim, axes))
    anchors = rows.filter("mark").select("id", "label", "v")
    parts = max(1, -(-asked // ANCHORS))

    def blocks(extra: DataFrame, wide: int, span: tuple[int | None, int | None]) -> DataFrame:
        given = anchors.join(extra, "id", "left").withColumn("_cut", cut)
        ready = given.repartitionByRange(parts, "label", "_cut", "id").sortWithinPartitions("label", "_cut", "id")
        return stable(_blocks(ready.select("id", "label", "v", F.coalesce("extra", F.array(*[F.lit(LEAST)] * wide)).alias("extra")), dim, wide, *span))

    home = _first(_at_home(nodes, dim, positives), ["anchor_id"], positives).filter(F.col("rank") == positives)
    ask = blocks(home.select(F.col("anchor_id").alias("id"), F.array("score").alias("extra")), 1, (None, None))
    near = _first(_meet(_joined(_pairs(ask, nodes, True), ask, nodes), dim, 1, positives, None, None), ["anchor_id"], positives)
    near = stable(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"))

    def windows(reach: DataFrame) -> DataFrame:
        """Blocks with (positive, its score, score to reach) for each positive; -1 and a negative score stand for none."""
        line = F.struct("rank", F.array("positive_id", "positive_score", F.coalesce("reach", F.lit(LEAST))).alias("x"))
        lines = near.join(reach, ["anchor_id", "positive_id"], "left").groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("l"))
        flat = F.flatten(F.transform("l", lambda s: s["x"]))
        none = F.array_repeat(F.lit(-1).cast("long"), 3 * positives - F.size(flat))
        return blocks(lines.select("id", F.concat(flat, none).alias("extra")), 3 * positives, (low, high))

    nothing = table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, reach long")
    ask = windows(nothing)
    keys = ["anchor_id", "positive_id"]
    seeds = _pairs(ask, nodes, False).groupBy("block").agg(F.max_by("node", F.struct("most", "node")).alias("node"))
    seen = _first(_meet(_joined(seeds, ask, nodes), dim, 3 * positives, negatives, low, high), keys, negatives)
    ask = windows(seen.filter(F.col("rank") == negatives).select(*keys, F.col("score").alias("reach")))
    far = _first(_meet(_joined(_pairs(ask, nodes, False), ask, nodes), dim, 3 * positives, negatives, low, high), keys, negatives)
    return far.join(near.select(*keys, "positive_score"), keys).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH e AS (SELECT vec_id, min(struct_pack(l := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, v := embedding)) AS r FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
 i AS (SELECT vec_id, r.l AS label, list_transform(r.v, lambda x: floor(256 * x::DOUBLE)) AS v FROM e),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM i a JOIN i b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
       FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
 n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
       FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
