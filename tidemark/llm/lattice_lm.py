"""Log probability of texts under a subword lattice.

The pieces of an existing vocabulary are arcs over a word's characters. Their first weights come from the vocabulary's own
scores (merge ranks, so a Zipf curve); one expectation step over the training words re-estimates them, and the
vocabulary's weights stay as a prior. A word's probability is the sum over all its segmentations, by forward recursion in
log space. The word as a whole is one more arc, weighted by its discounted count; the discount's mass goes to the pieces.
A text is its words and one end, each drawn on its own.

Counts and expected counts cover all training documents: words are counted per input block before they are shuffled, and
only piece weights (one number per piece of the vocabulary) reach the driver. Each block gets the counts and probabilities
of its own distinct words back; no task sees the whole word list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.batches import only, released, slices
from tidemark.llm.langid import remainder

START = "▁"  # the vocabulary's mark before a word
DISCOUNT = 0.75
PRIOR_PIECES = 1_000.0
ZIPF_SHIFT = 10.0
WORDS_AT_ONCE = 20_000
BLOCK_BYTES = 32 << 20
LOWEST = -1e30
NO_PIECE = -2


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], np.ndarray, list[int], int]:
    """(number of each piece, its prior log weight, numbers of the 256 byte pieces, longest piece) of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)])
    rank = np.array([-model.get_score(i) for i in range(size)])
    weight = np.where(usable, 1 / (ZIPF_SHIFT + np.maximum(rank, 0)), 0.0)
    weight[bytes_] = weight[usable].min()
    number = {model.id_to_piece(i): i for i in range(size) if usable[i] and not model.is_byte(i)}
    with np.errstate(divide="ignore"):
        return number, np.log(weight / weight.sum()), bytes_, max(map(len, number))


@lru_cache(maxsize=2)
def beginnings(path: str) -> dict[str, int]:
    """The number of each piece, and -1 for what begins one but is none itself."""
    number = pieces(path)[0]
    return {piece[:k]: -1 for piece in number for k in range(1, len(piece))} | number


class Lattice:
    def __init__(self, path: str, log_weight: np.ndarray | None = None):
        self.number, prior, self.bytes_, self.longest = pieces(path)
        self.begun = beginnings(path)
        self.log_weight = prior if log_weight is None else log_weight

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, from, to, piece, log weight) of every arc; a character without a piece is an arc of its bytes (piece -1)."""
        get, longest = self.begun.get, self.longest
        which, begin, end, piece = [], [], [], []
        bare: list[tuple[int, int, str]] = []
        for w, word in enumerate(words):
            text = START + word
            n = len(text)
            for i in range(n):
                single = get(text[i], NO_PIECE)
                if single < 0:
                    bare.append((w, i, text[i]))
                for j in range(i + 1, min(n, i + longest) + 1):
                    p = single if j == i + 1 else get(text[i:j], NO_PIECE)
                    if p == NO_PIECE:  # nor does any piece begin so
                        break
                    if p >= 0:
                        which.append(w)
                        begin.append(i)
                        end.append(j)
                        piece.append(p)
        log = self.log_weight[np.array(piece, np.int64)] if piece else np.zeros(0)
        if bare:
            which += [w for w, _, _ in bare]
            begin += [i for _, i, _ in bare]
            end += [i + 1 for _, i, _ in bare]
            piece += [-1] * len(bare)
            log = np.concatenate([log, [sum(self.log_weight[self.bytes_[b]] for b in c.encode("utf-8", "replace")) for _, _, c in bare]])
        return np.array(which, np.int64), np.array(begin, np.int64), np.array(end, np.int64), np.array(piece, np.int64), log

    def forward(self, words: list[str], arcs=None) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word, forward values of all places); all words take a step together."""
        which, begin, end, _, log = arcs or self.arcs(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        base = np.cumsum(sizes) - sizes
        value = np.full(int(sizes.sum()), LOWEST)
        value[base] = 0.0
        _sweep(value, base[which] + begin, base[which] + end, end, log)
        return value[base + sizes - 1], value

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, each word counted so often."""
        arcs = self.arcs(words)
        which, begin, end, piece, log = arcs
        total, alpha = self.forward(words, arcs)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        base = np.cumsum(sizes) - sizes
        beta = np.full(len(alpha), LOWEST)
        beta[base + sizes - 1] = 0.0
        _sweep(beta, base[which] + end, base[which] + begin, -begin, log)
        posterior = np.exp(np.minimum(alpha[base[which] + begin] + log + beta[base[which] + end] - total[which], 0.0)) * counts[which]
        known = piece >= 0
        return np.bincount(piece[known], posterior[known], len(self.log_weight))


def _sweep(value: np.ndarray, source: np.ndarray, target: np.ndarray, level: np.ndarray, log: np.ndarray) -> None:
    """value[target] = logsumexp over arcs of value[source] + log, levels in rising order."""
    order = np.lexsort((target, level))
    source, target, level, log = source[order], target[order], level[order], log[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(level))[0] + 1, [len(level)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        scores, to = value[source[a:b]] + log[a:b], target[a:b]
        first = np.concatenate([[0], np.nonzero(np.diff(to))[0] + 1])
        top = np.maximum.reduceat(scores, first)
        reach = np.repeat(top, np.diff(np.concatenate([first, [len(to)]])))
        value[to[first]] = top + np.log(np.add.reduceat(np.exp(scores - reach), first))


@dataclass
class Model:
    path: str
    log_weight: np.ndarray
    n: int  # training tokens, ends included
    v: int  # distinct training tokens, the end included
    ends: int  # training documents

    def log10(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """Discounted whole-word weight plus the lattice's share of the discount."""
        if not self.n:
            return lattice / np.log(10)
        spread = np.log(DISCOUNT * self.v / self.n) + lattice
        whole = np.log(np.maximum(counts - DISCOUNT, 1e-300) / self.n)
        return np.where(counts > 0, np.logaddexp(whole, spread), spread) / np.log(10)

    def end(self) -> float:
        """The end has no letters; unseen, it has the smallest share."""
        return float(np.log10(max(self.ends, DISCOUNT) / max(self.n, 1)))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case; the end is not among them."""
    return (text or b"").lower().split()


def _bytes_setting(spark, key: str) -> int:
    raw = spark.conf.get(key).lower().rstrip("b")
    return int(raw.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(raw[-1], 0)


def _located(docs: DataFrame) -> DataFrame:
    """The documents with a block number: where in its file a row was read and, so that blocks stay small, a hash of its id.

    Both scans of the same files see the same blocks. Rows that come from no file are dealt by the hash alone.
    """
    spark = docs.sparkSession
    split = _bytes_setting(spark, "spark.sql.files.maxPartitionBytes")
    within = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-split // BLOCK_BYTES))))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    block = F.when(F.input_file_name() == "", spread).otherwise(F.xxhash64(F.input_file_name(), F.input_file_block_start(), within))
    return docs.select("*", block.alias("block")).withColumn("text", F.col("text").cast("binary"))


def word_counts(docs: DataFrame, every: bool) -> DataFrame:
    """(block, word, n): words of each block and how often its training documents have them; with ``every`` all words, else training words."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {}

        def out(block: int, counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), block, np.int64)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              ["block", "word", "n"])
        for batch in slices(batches):
            for text, block, train in zip(batch.column("text").to_pylist(), batch.column("block").to_pylist(), batch.column("train").to_pylist()):
                counts = found.setdefault(block, Counter())
                words = tokens(text)
                if train:
                    counts.update(words)
                elif every:
                    for w in words:
                        if w not in counts:
                            counts[w] = 0
            for block in [b for b, c in found.items() if len(c) > 1_000_000]:
                yield out(block, found.pop(block))
        for block, counts in found.items():
            yield out(block, counts)
    return docs.select("text", "block", "train").mapInArrow(run, "block long, word binary, n long")


def learn(located: DataFrame, vocabulary: str) -> Model:
    """Counts and one expectation step over the training words."""
    words = word_counts(located.filter("train"), False).groupBy("word").agg(F.sum("n").alias("n"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary)
        total, n, v = np.zeros(len(lattice.log_weight)), 0, 0
        for batch in batches:
            counts = batch.column("n").to_numpy()
            names = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            for i in range(0, len(names), WORDS_AT_ONCE):
                total += lattice.expected(names[i:i + WORDS_AT_ONCE], counts[i:i + WORDS_AT_ONCE].astype(float))
            n, v = n + int(counts.sum()), v + len(counts)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"piece": np.concatenate([used, [-1, -2]]), "uses": np.concatenate([total[used], [float(n), float(v)]])})
    uses = {r["piece"]: r["uses"] for r in words.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
    ends = located.filter("train").count()
    n, v = int(uses.pop(-1, 0)), int(uses.pop(-2, 0))
    prior = np.exp(pieces(vocabulary)[1])
    counts = PRIOR_PIECES * prior
    for piece, use in sorted(uses.items()):
        counts[piece] += use
    with np.errstate(divide="ignore"):
        return Model(vocabulary, np.log(counts / counts.sum()), n + ends, v + (ends > 0), ends)


def score(docs: DataFrame, vocabulary: str, is_training: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``is_training`` is a condition on the column ``doc_id``. Null and empty texts are the end alone; repeated rows count and are scored
    each; without training documents the vocabulary's own weights serve. An empty table gives no rows.
    """
    located = _located(only(docs, doc_id=doc_id, text=text).withColumn("train", F.coalesce(is_training, F.lit(False))))
    spark = docs.sparkSession
    model = learn(located, vocabulary)
    shared = spark.sparkContext.broadcast(model)  # one number per piece

    @released
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, last, kept = Lattice(vocabulary, shared.value.log_weight), None, 0.0
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            fresh = [i for i, w in enumerate(words) if w != (words[i - 1] if i else last)]  # sorted: equal words are neighbours
            log = np.concatenate([lattice.forward([words[i].decode("utf-8", "replace") for i in fresh[k:k + WORDS_AT_ONCE]])[0]
                                  for k in range(0, len(fresh), WORDS_AT_ONCE)]) if fresh else np.zeros(0)
            if not fresh or fresh[0]:
                fresh, log = [0, *fresh], np.concatenate([[kept], log])
            logs = np.repeat(log, np.diff([*fresh, len(words)]))
            last, kept = words[-1], logs[-1]
            counts = batch.column("c").to_numpy().astype(float)
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "word": batch.column("word"), "c": batch.column("c"), "log": shared.value.log10(counts, logs)})

    words = word_counts(located, True)
    counted = words.select("block", "word", F.sum("n").over(Window.partitionBy("word")).alias("c"))
    weighed = counted.mapInArrow(weigh, "block long, word binary, c long, log double")

    def apply(texts_, weights):
        m = shared.value
        place = {w: i for i, w in enumerate(weights.column("word").to_pylist())} if len(weights) else {}
        c = weights.column("c").to_numpy() if len(weights) else np.zeros(0)
        log = weights.column("log").to_numpy() if len(weights) else np.zeros(0)
        base = m.base(c)
        out = []
        for text in texts_.column("text").to_pylist():
            words = tokens(text)
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            out.append((len(words) + 1, int((c[at] > 0).sum()) + (m.ends > 0), m.n, float(base[at].sum() + m.base(np.array([m.ends]))[0]), float(log[at].sum() + m.end())))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table({"doc_id": texts_.column("doc_id"), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()),
                         "train_tokens": pa.array(cols[2], pa.int64()), "base_score": pa.array(cols[3], pa.float64()), "score": pa.array(cols[4], pa.float64())})
    kind = located.schema["doc_id"].dataType.simpleString()
    return (located.select("doc_id", "text", "block").groupBy("block").cogroup(weighed.groupBy("block"))
            .applyInArrow(apply, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 7), F.lit(-1)) == 2


def predict(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned outside the held-out fold, scored for every row."""
    found = score(docs, vocabulary, ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
