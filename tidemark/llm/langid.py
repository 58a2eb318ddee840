"""Language of whole texts from a conditional random field over their words.

The field is trained on a bounded sample of labelled documents, each joined to one of another language, so that it learns
where a text changes its language. A document's language is the label with the largest mean marginal over its words that
have letters; the marginals themselves label the words of code-switched text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import crf
from tidemark.llm.batches import only, released, rows, slices, texts

PER_LANGUAGE = 60
LEXICON_WORDS = 200
UNKNOWN = "und"


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def sample(marked: DataFrame, docs: DataFrame, label: str, per_label: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_label`` rows of each label in ``marked`` (doc_id, label): those with the smallest hash of the id.

    Only ids and labels are ranked, and Spark keeps ``per_label`` rows of a label per partition before it moves any; no text is shuffled.
    """
    ranked = Window.partitionBy(label).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
    few = marked.select("doc_id", label).withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= per_label)
    chosen = F.broadcast(few.groupBy("doc_id", label).agg(F.min("_rank").alias("_rank")))  # per_label rows of each label
    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", label, "_rank").collect()
    return [(r["text"] or "", r[label]) for r in sorted(found, key=lambda r: (str(r[label]), r["_rank"], r["text"] or ""))]


def fit(rows_: list[tuple[str, str]], *, lexicon_words: int = LEXICON_WORDS, **options) -> crf.Model | None:
    """A model from (text, language) rows; None where there is none to learn from."""
    by = {label: [[w for w in map(crf.bare, t.split()) if w] for t, _ in group] for label, group in groupby(rows_, key=lambda r: r[1])}
    by = {label: [t for t in found if t] for label, found in by.items()}
    labels = sorted(label for label, found in by.items() if found)
    if not labels:
        return None
    lexicons = [frozenset(w for w, _ in Counter(w for t in by[label] for w in t).most_common(lexicon_words)) for label in labels]
    sequences, tags = [], []
    for i in range(max(map(len, by.values()))):
        turn = [(k, by[label][i]) for k, label in enumerate(labels) if i < len(by[label])]
        for (a, left), (b, right) in zip(turn, turn[1:] + turn[:1]):
            sequences.append(left + right if a != b else left)
            tags.append(np.repeat([a, b], [len(left), len(right)]) if a != b else np.repeat(a, len(left)))
    return crf.train(sequences, tags, labels, lexicons, **options)


PRIOR_WORDS = 3  # counted as known in every text, so that a word or two is no evidence


def _predicted(batches: Iterator[pa.RecordBatch], model: crf.Model | None, text: str) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray]]:
    """Each batch with its texts' languages and scores, and the share of their letter groups that training met."""
    tagger = crf.Tagger(model) if model else None
    for batch in slices(batches, text, crf.BATCH_BYTES):
        if tagger is None:
            yield batch, [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            continue
        marginals, letters, sizes = tagger(texts(batch, text))
        count = crf.by_text(letters.astype(float), sizes)
        mean = crf.by_text(marginals * letters[:, None], sizes) / np.maximum(count, 1)[:, None]
        met = (crf.by_text(tagger.shares * letters, sizes) + PRIOR_WORDS) / (count + PRIOR_WORDS)
        best = mean.argmax(axis=1)
        score = np.clip(np.where(count > 0, mean[np.arange(len(best)), best], 0.0), 0.0, 1.0)
        yield batch, [model.labels[b] if c else UNKNOWN for b, c in zip(best, count)], score, met


def identify(docs: DataFrame, model: crf.Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, in one pass without a shuffle.

    ``score`` is the mean marginal of the predicted language. Null, empty and letterless texts are ``und`` with score 0, and
    so is everything where the model is None. Repeated rows each get their result; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its slots

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, score, _ in _predicted(batches, shared.value, "text"):
            yield rows(doc_id=batch.column("doc_id"), lang_pred=found, score=score)
    source = only(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep(docs: DataFrame, model: crf.Model | None, least_known: float, *, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that have letters of which at least ``least_known`` of the groups occur in the learned texts.

    A marginal only says which of the learned languages is likeliest, and is one over their number at least; that a text is in none of them
    shows in letter groups which the model has never met.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, _, met in _predicted(batches, shared.value, text):
            yield batch.filter(pa.array([f != UNKNOWN and m >= least_known for f, m in zip(found, met)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def label_words(text: str, model: crf.Model) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of each word of one text."""
    marginals, _, _ = crf.Tagger(model)([text])
    return [(w, model.labels[m.argmax()], float(m.max())) for w, m in zip(text.split(), marginals)]


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, folds: int = 5) -> crf.Model | None:
    """A model from at most ``per_language`` whole documents of each language, none of the held-out fold."""
    labelled = only(docs, doc_id=doc_id, text=text, lang=lang).filter((remainder(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return fit(sample(labelled, labelled, "lang", per_language))


def predict(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned outside the held-out fold, predicted for every row."""
    found = identify(docs, learn(docs, **options))
    return found.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), 5), F.lit(-1)) == 0).alias("held_out"), "lang_pred", "score")
