"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders the shingles of all documents; a document's sketch is its k smallest hashes. Two documents that
are similar enough share a known part of their sketches, but for a chance of ``MISS``, so their rarest retained values
have one in common: only those go into inverted lists, and values of widespread passages stay out. Documents with equal
shingle sets are one class from the start.

In each list the classes are held against one leader. The smallest hashes of the union of two sketches estimate the
similarity, pairs that may be similar are verified on their full sets. With 1 - Jaccard being a metric, a class linked to
the leader can only link to one within twice the distance limit of it; where a list has none of those, its linked classes
are done. What remains of the lists, as far as links have not joined it yet, is compared exactly in blocks, and each block
gives a tree of its links. So a group of near copies costs about one comparison for each and never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.batches import only, released, slices
from tidemark.llm.components import connected, tree
from tidemark.plans.checkpoints import drop_stable, stable

SKETCH = 32
MISS = 1e-7
BLOCK = 1_000
BLOCK_SHINGLES = 1_000_000
COLUMNS = 4_096
CACHE_WORDS = 200_000
ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct hashes of a text's word shingles; A-Z in lower case, words between ASCII white space."""

    def __init__(self, width: int):
        self.width, self.hashes = width, _Hashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        if not words:
            return h
        w = min(self.width, len(words))  # fewer words are one shingle
        total = np.full(len(h) - w + 1, w, np.uint64)
        for i in range(w):
            total = _mix(total * ODD[0] + h[i:len(h) - w + 1 + i])
        return np.unique(total)


def fingerprint(shingles: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return b"".join(np.add.reduce(_mix(shingles ^ seed), dtype=np.uint64).tobytes() for seed in ODD[1:3])


def shared_least(similarity: float, size: int = SKETCH, miss: float = MISS) -> int:
    """Of the ``size`` smallest hashes of a union, how many both sets have at least, but for the chance ``miss``."""
    below = 0.0
    for x in range(size + 1):
        below += comb(size, x) * similarity ** x * (1 - similarity) ** (size - x)
        if below > miss:
            return x
    return size


def _binary(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.col("text").cast("binary"))


def sketches(docs: DataFrame, width: int, size: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, f, sketch): ``f`` names the shingle set (null: no shingle)."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in slices(batches):
            sets = [shingler(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                                              pa.array([s[:size].tobytes() for s in sets], pa.binary())], ["doc_id", "n_shingles", "f", "sketch"])
    return _binary(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, f binary, sketch binary")


def inverted_lists(classes: DataFrame, similarity: float, size: int = SKETCH) -> DataFrame:
    """(list, f): the classes that have a value among their rarest ones; lists with the same classes are given once."""
    share = shared_least(similarity, size) / size

    @released
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(s, np.int64) for s in batch.column("sketch").to_pylist()]
            counts = [len(v) for v in values]
            owner = pa.array(np.repeat(np.arange(len(values)), counts))
            yield pa.RecordBatch.from_arrays([batch.column("f").take(owner), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)),
                                              pa.array(np.repeat(counts, counts), pa.int32())], ["f", "value", "kept"])
    values = classes.select("f", "sketch").mapInArrow(explode, "f binary, value long, kept int")
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = values.join(often, "value").groupBy("f", "kept").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))  # at most ``size``
    room = F.col("kept") - F.ceil(F.col("kept") * share) + 1 - (F.col("kept") - F.size("values"))  # values in one document only come first
    posted = stable(shared.filter(room > 0).select("f", F.explode(F.slice("values", F.lit(1), room.cast("int"))).alias("v")).select("f", F.col("v.value").alias("list")))
    alike = (posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("f").cast("decimal(20,0)")).alias("s"), F.min("f").alias("least"))
             .filter("n > 1").groupBy("n", "s", "least").agg(F.min("list").alias("list")).select("list"))
    return stable(posted.join(alike, "list"))


def _estimate(left: list[bytes], right: list[bytes], size: int) -> np.ndarray:
    """How much of the smallest hashes of each union both sketches have, as a share of ``size`` or of the union if smaller."""
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right)):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        merged = np.sort(np.concatenate([a, b]), kind="stable")
        twice = np.zeros(len(merged), bool)
        twice[1:] = merged[1:] == merged[:-1]
        first = ~twice
        within = np.cumsum(first) <= size
        out[i] = (twice & within).sum() / max(1, min(size, int(first.sum())))
    return out


def near_pairs(pairs: DataFrame, classes: DataFrame, least: float, size: int = SKETCH) -> DataFrame:
    """The (a, b) whose union sketch says that they may be similar."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _estimate(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), size) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], ["a", "b"])
    wide = (pairs.join(classes.select(F.col("f").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(classes.select(F.col("f").alias("b"), F.col("sketch").alias("sb")), "b"))
    return wide.mapInArrow(run, "a binary, b binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(f, shingles) of the wanted classes, from the text of the document that stands for each."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), set()
        for batch in slices(batches):
            names, sets = [], []
            for text, f in zip(batch.column("text").to_pylist(), batch.column("f").to_pylist()):
                if f in seen:  # rows that repeat
                    continue
                s = shingler(text)
                if fingerprint(s) == f:  # another text of the same id is not the one
                    seen.add(f)
                    names.append(f)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["f", "shingles"])
    return _binary(docs).join(wanted.select("doc_id", "f"), "doc_id").mapInArrow(run, "f binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, any): sizes of intersection and union of the full sets."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(a, b, assume_unique=True))
                both.append(n)
                either.append(len(a) + len(b) - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "any"])
    wide = pairs.join(sets.select(F.col("f").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("f").alias("b"), F.col("shingles").alias("xb")), "b")
    return wide.mapInArrow(run, "a binary, b binary, both long, any long")


def leader_round(lists: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Holds every list's classes against its smallest one; gives what was verified and what is left of the lists."""
    limit = 1 - percent / 100
    led = stable(lists.join(lists.groupBy("list").agg(F.min("f").alias("leader")), "list"))
    pairs = led.filter("f <> leader").select(F.col("f").alias("a"), F.col("leader").alias("b")).distinct()
    checked = stable(verified(near_pairs(pairs, classes, shared_least(1 - 2 * limit) / SKETCH), sets))
    far = 2 * limit + 1e-9
    known = checked.select(F.col("a").alias("f"), F.col("b").alias("leader"), (1 - F.col("both") / F.col("any")).alias("d"),
                           (100 * F.col("both") >= percent * F.col("any")).alias("linked"))
    own = F.col("f") == F.col("leader")
    placed = led.join(known, ["f", "leader"], "left").select(
        "list", "f", (own | F.coalesce("linked", F.lit(False))).alias("done"), F.when(own, 0.0).otherwise(F.coalesce("d", F.lit(far))).alias("d"))
    rest = placed.filter(~F.col("done")).groupBy("list").agg(F.min("d").alias("nearest"))
    kept = placed.join(rest, "list").filter(~F.col("done") | (F.col("d") + limit + 1e-9 >= F.col("nearest")))
    return checked, kept.select("list", "f")


def _both(rows_: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of each set in ``rows_`` with each in ``columns``, as products of membership matrices over the shared hashes."""
    out = np.zeros((len(rows_), len(columns)), np.float32)
    values, at = np.unique(np.concatenate([*rows_, *columns]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows_) + len(columns)), [len(s) for s in (*rows_, *columns)])
    inside = np.bincount(at[owner < len(rows_)], minlength=len(values)) * np.bincount(at[owner >= len(rows_)], minlength=len(values)) > 0
    place = np.cumsum(inside) - 1
    hit = inside[at]
    column, owner = place[at[hit]], owner[hit]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int(inside.sum())
    for start in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        member = np.zeros((len(rows_) + len(columns), min(COLUMNS, total - start)), np.float32)
        member[owner[a:b], column[a:b] - start] = 1
        out += member[:len(rows_)] @ member[len(rows_):].T
    return out


def remaining_links(lists: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links within the lists (list, f, root) between classes of different roots, as trees.

    A long list is cut into blocks and each two blocks meet in a task. Only classes outside a meeting's commonest root are
    compared with the others, and the sets decide; no pairs are handed on.
    """
    def run(key, table):
        names, roots = table.column("f").to_pylist(), table.column("root").to_pylist()
        sets_ = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        part, own, other = table.column("part").to_numpy(), key[1].as_py(), key[2].as_py()
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        root = np.fromiter((number[r] for r in roots), np.int64, len(roots))
        size = np.fromiter(map(len, sets_), np.float64, len(sets_))
        main = np.bincount(root).argmax()
        left, right = np.nonzero(part == own)[0], np.nonzero(part == other)[0]
        meetings = [(left[root[left] != main], right)]
        if own != other:
            meetings.append((left[root[left] == main], right[root[right] != main]))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in meetings:
            if len(a) and len(b):
                both = _both([sets_[i] for i in a], [sets_[i] for i in b]).astype(float)
                close = (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)) & (root[a][:, None] != root[b][None, :])
                if close.any():
                    found.append(tree(close, a, b))
        edges = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array([names[i] for i in edges[:, 0]], pa.binary()), "b": pa.array([names[i] for i in edges[:, 1]], pa.binary())})
    sized = lists.join(classes.select("f", "n_shingles"), "f")
    blocks = sized.groupBy("list").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    cut = lists.join(blocks, "list").withColumn("part", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("part", o).alias("own"), F.greatest("part", o).alias("other")))
    spread = cut.withColumn("_m", F.explode(meets)).select("list", "f", "root", "part", "_m.own", "_m.other").join(sets, "f")
    return spread.groupBy("list", "own", "other").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, with_set: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``with_set`` adds ``f``, the name of its shingle set (see ``sketches``).

    Linked are documents with 100 * intersection >= ``percent`` * union of their shingle sets (above 50). ``component_id`` is the
    smallest id that links reach, ``kept`` marks its bearer. Null, empty and wordless texts and null ids link with nothing and are kept.
    Repeated rows get the same result each; an empty table gives no rows.
    """
    source = only(docs, doc_id=doc_id, text=text)
    rows_ = stable(sketches(source, width))
    named = rows_.filter(F.col("f").isNotNull() & F.col("doc_id").isNotNull())
    classes = stable(named.groupBy("f").agg(F.min(F.struct("doc_id", "sketch", "n_shingles")).alias("s")).select("f", "s.doc_id", "s.sketch", "s.n_shingles"))
    similarity = percent / 100
    lists = inverted_lists(classes, similarity)
    named_in = lists.select("f").distinct()
    few = stable(classes.join(named_in, "f", "left_semi"))
    sets = stable(shingle_sets(source, few, width))
    checked, lists = leader_round(lists, few, sets, percent)
    links = checked.filter(100 * F.col("both") >= percent * F.col("any")).select("a", "b")
    roots = stable(connected(links, "a", "b"))
    rooted = stable(lists.join(roots.withColumnRenamed("node", "f"), "f", "left").select("list", "f", F.coalesce("root", "f").alias("root")))
    apart = rooted.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("list")
    more = stable(remaining_links(rooted.join(apart, "list"), few, sets, percent))
    if more.take(1):
        roots = stable(connected(links.unionByName(more), "a", "b"))
    members = roots.join(classes.select(F.col("f").alias("node"), "doc_id"), "node")
    least = members.groupBy("root").agg(F.min("doc_id").alias("component"))
    moved = members.join(least, "root").select(F.col("node").alias("f"), "component")
    drop_stable(sets)
    placed = classes.select("f", F.col("doc_id").alias("first")).join(moved, "f", "left").select("f", F.coalesce("component", "first").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = rows_.join(placed, "f", "left").select("doc_id", "n_shingles", component.alias("component_id"), *["f"] * with_set)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *["f"] * with_set)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
 x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)),
 r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, low) AS component_id, doc_id = least(doc_id, low) AS kept FROM s LEFT JOIN c ON c.a = doc_id
"""
