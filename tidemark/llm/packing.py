"""Packing documents into sequences by order-preserving dynamic programming.

The ids of a run of documents form one line. Windows of at most ``length`` ids follow each other on it; a window that ends
at a document costs nothing, at a sentence or at a grid point inside a long sentence a penalty for the truncation, and
every window costs its padding. With c the position of a cut, cost[j] = min(cost[i] + c[i]) + length - c[j] + penalty[j]
over the cuts i within reach, and that minimum comes from a monotone queue. Windows of a
power of two need no padding, but a penalty keeps them few.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.batches import only, released, rows, slices, texts
from tidemark.llm.word_ids import BATCH_BYTES, lengths, word_ids

LENGTH = 1024
GRID = 64
SENTENCE_PENALTY = 2.0
GRID_PENALTY = 12.0
SHORT_PENALTY = 16.0


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, in order from 0, and their penalties."""
    total = int(doc_ends[-1])
    points = np.concatenate([np.arange(0, total, grid), sentence_ends, [0], doc_ends])
    costs = np.concatenate([np.full(-(-total // grid), GRID_PENALTY), np.full(len(sentence_ends), SENTENCE_PENALTY), [0.0], np.zeros(len(doc_ends))])
    order = np.lexsort((costs, points))
    points, costs = points[order], costs[order]
    keep = np.concatenate([[True], points[1:] != points[:-1]])
    return points[keep], costs[keep]


def best_cuts(points: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ends of the windows that minimise padding plus penalties from the first point to the last."""
    n = len(points)
    place, cost_of = points.tolist(), costs.tolist()
    shorter = []  # for windows of a half and a quarter: the point that far back, or none
    for power in ((length >> 1, length >> 2) if length & (length - 1) == 0 else (length, length)):
        at = np.searchsorted(points, points - power)
        shorter.append(np.where(points[np.minimum(at, n - 1)] == points - power, at, -1).tolist())
    best, back = [0.0] * n, [0] * n
    keys, who, head = [float(place[0])], [0], 0  # the queue: cost + position, rising, and whose
    for j, (c, cost, half, quarter) in enumerate(zip(place, cost_of, *shorter)):
        if not j:
            continue
        far = c - length
        while place[who[head]] < far:
            head += 1
        i = who[head]
        value = keys[head] - far
        if half >= 0 and best[half] + SHORT_PENALTY < value:
            value, i = best[half] + SHORT_PENALTY, half
        if quarter >= 0 and best[quarter] + SHORT_PENALTY < value:
            value, i = best[quarter] + SHORT_PENALTY, quarter
        value += cost
        best[j], back[j] = value, i
        key = value + c
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            who.pop()
        keys.append(key)
        who.append(j)
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(place[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def pieces(ids: np.ndarray, doc_ends: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """The stretches between neighbouring ends of documents or windows."""
    ends = np.union1d(doc_ends, cuts)
    starts = np.concatenate([[0], ends[:-1]])
    doc, window = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(cuts, starts, "right")
    doc_starts, window_starts = np.concatenate([[0], doc_ends[:-1]]), np.concatenate([[0], cuts[:-1]])
    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return {"doc": doc, "start": starts - doc_starts[doc], "length": ends - starts, "doc_tokens": (doc_ends - doc_starts)[doc], "window": window,
            "offset": starts - window_starts[window], "ids_crc32": np.fromiter((zlib.crc32(view[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(ends)),
            "from": starts}


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece of a document in a sequence.

    Documents are packed in the order of the input's partitions, without a shuffle; each stretch of at most 4 MB of text is
    a line of its own, so memory doesn't grow with the input and the last window of a stretch alone may be padded more.
    A sequence's id is the partition's number and a running number. Null and empty texts are the end id alone; repeated rows
    are packed each; a document longer than a window is cut. An empty table gives no rows.
    """
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = word_ids(tokenizer), TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=BATCH_BYTES):
            encoded = words.encode(texts(batch))
            sizes = lengths(encoded)
            before = np.cumsum(sizes)
            ids = np.insert(encoded.ids, before, end_id).astype(np.uint32)
            doc_ends = before + np.arange(1, len(sizes) + 1)
            owner = np.repeat(np.arange(len(sizes)), encoded.docs)
            points, costs = cut_points(doc_ends, (np.cumsum(encoded.parts) + owner)[encoded.sentence])
            cuts = best_cuts(points, costs, length)
            p = pieces(ids, doc_ends, cuts)
            out = {"doc_id": batch.column("doc_id").take(pa.array(p["doc"])), "start": p["start"], "length": p["length"], "ids_crc32": p["ids_crc32"],
                   "doc_tokens": p["doc_tokens"], "sequence_id": p["window"] + first, "offset": p["offset"]}
            if with_ids:
                offsets = np.concatenate([p["from"], [len(ids)]]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            first += len(cuts)
            yield rows(**out)
    source = only(docs, doc_id=doc_id, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
