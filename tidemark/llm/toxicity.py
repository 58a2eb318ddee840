"""Toxic spans and document scores from a conditional random field over words.

Labels come per document, so tokens are labelled first: within the training sample, a token of a toxic document is toxic
if its word, or the beginning of its word, stands in toxic documents more often than chance allows for that many
candidates (a likelihood ratio test). The field learns from these tokens; its affix and n-gram weights also reach forms
of a word that the sample lacks. A document's score is a logistic curve over the sum of what its tokens' marginals have above a faint one, fitted on
the sample's document labels; its spans are the tokens whose marginal is at least a half.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import crf
from tidemark.llm.batches import only, released, rows, slices, texts
from tidemark.llm.langid import remainder, sample

PER_LABEL = 1000
STEMS = (4, 5, 6)
THRESHOLD = 0.3
SPAN = 0.5
FAINT = 0.2


def _keys(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def without_copies(docs: list[list[str]], shared: float = 0.5, rare: int = 20) -> list[list[str]]:
    """Documents that don't have half of their rarer words in common with an earlier one; copies are no further evidence."""
    holders: dict[str, list[int]] = {}
    sets = [set(d) for d in docs]
    for i, words in enumerate(sets):
        for w in words:
            holders.setdefault(w, []).append(i)
    kept, out = set(), []
    for i, words in enumerate(sets):
        few = [w for w in words if 1 < len(holders[w]) <= rare]
        single = sum(len(holders[w]) == 1 for w in words)
        met = Counter(j for w in few for j in holders[w] if j < i and j in kept)
        if met and max(met.values()) >= shared * (len(few) + single):
            continue
        kept.add(i)
        out.append(docs[i])
    return out


def toxic_keys(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Words and beginnings of words (with a star) that mark toxic documents."""
    inside, outside = Counter(), Counter()
    for found, docs in ((inside, toxic), (outside, clean)):
        for words in docs:
            found.update({k for w in set(words) for k in _keys(w)})
    if not toxic or not clean:
        return set()
    share = len(toxic) / (len(toxic) + len(clean))
    known, a = list(inside), np.fromiter(inside.values(), float, len(inside))
    c = np.fromiter((outside[k] for k in known), float, len(known))
    p = a / (a + c)
    gain = a * np.log(p / share) + np.where(c > 0, c * np.log(np.where(c > 0, 1 - p, 1) / (1 - share)), 0)
    chosen = (p > share) & (p >= 0.8) & (gain > np.log(len(known)) + 1)
    return {k for k, yes in zip(known, chosen) if yes}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for slope and intercept."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (weight * (y - p)) - ridge * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def evidence(marginals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What each text's marginals have above ``FAINT``, summed, on a log scale: faint tokens of a long text don't add up to a clear one."""
    return np.log(crf.by_text(np.maximum(marginals - FAINT, 0), sizes) + 0.01)


def fit(rows_: list[tuple[str, int]], share: float, **options) -> crf.Model | None:
    """A model from (text, toxic) rows; ``share`` is the toxic share of all labelled documents. None without both labels."""
    docs = [([w for w in map(crf.bare, t.split()) if w], int(y)) for t, y in rows_]
    docs = [(words, y) for words, y in docs if words]
    toxic, clean = [w for w, y in docs if y], [w for w, y in docs if not y]
    if not toxic or not clean:
        return None
    keys = toxic_keys(without_copies(toxic), without_copies(clean))
    tags = [np.fromiter((y and any(k in keys for k in _keys(w)) for w in words), np.int64, len(words)) for words, y in docs]
    model = crf.train([w for w, _ in docs], tags, [0, 1], [frozenset(k for k in keys if not k.endswith("*"))], **options)
    marginals, _, sizes = crf.Tagger(model)([" ".join(w) for w, _ in docs])
    y = np.array([y for _, y in docs], float)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.extra["curve"] = _logistic(evidence(marginals[:, 1], sizes), y, weight)
    return model


def score(docs: DataFrame, model: crf.Model | None, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, span: float = SPAN) -> DataFrame:
    """(doc_id, score, predicted, spans) of every row, in one pass without a shuffle.

    ``spans`` lists (start, end) of offending tokens in code points, end exclusive. Null and empty texts score as texts without
    toxic tokens; without a model every score is 0. Repeated rows each get their result; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its slots

    def offsets(text: str, marks: np.ndarray) -> list[dict[str, int]]:
        found, at = [], 0
        for word, mark in zip(text.split(), marks):
            at = text.index(word, at)
            if mark:
                found.append({"start": at, "end": at + len(word)})
            at += len(word)
        return found

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = crf.Tagger(shared.value) if shared.value else None
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, limit=crf.BATCH_BYTES):
            found = texts(batch)
            if tagger is None:
                value, spans = np.zeros(len(found)), [[] for _ in found]
            else:
                marginals, _, sizes = tagger(found)
                slope, level = shared.value.extra["curve"]
                value = 1 / (1 + np.exp(-(slope * evidence(marginals[:, 1], sizes) + level)))
                ends = np.cumsum(sizes)
                bad = marginals[:, 1] >= span
                some = crf.by_text(bad.astype(float), sizes) > 0
                spans = [offsets(t, bad[e - n:e]) if s else [] for t, n, e, s in zip(found, sizes, ends, some)]
            yield rows(doc_id=batch.column("doc_id"), score=value, predicted=pa.array(value >= threshold).cast(pa.int32()), spans=pa.array(spans, kind))
    source = only(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int, spans array<struct<start:bigint,end:bigint>>")


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL, folds: int = 4, held_out: int = 2) -> crf.Model | None:
    """A model from at most ``per_label`` whole documents of each label, none of the held-out fold; a document that has both labels counts as toxic."""
    marked = (only(labels, doc_id=doc_id, toxic=label).filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), folds) != held_out))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return None
    source = only(docs, doc_id=doc_id, text=text)
    present = marked.join(source.select("doc_id"), "doc_id", "left_semi")
    return fit(sample(present, source, "toxic", per_label), counts[1] / (counts[0] + counts[1]))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned outside the held-out fold, scored for every row."""
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), 4), F.lit(-1)) == 2).alias("held_out"), "score", "predicted")
