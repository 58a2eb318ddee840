"""A linear-chain conditional random field over the words of a text.

A word's features are its prefixes and suffixes, its character pairs and triples with word marks (all hashed), and which
lexicons hold it. Feature weights, transitions and start weights are learned together by gradient ascent on the
regularised conditional likelihood; forward-backward gives the expectations for it and the marginals of a new text.
All steps run over many words or texts at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

PREFIXES = 6
SUFFIXES = 4
MIX = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 1 << 20
WORDS_AT_ONCE = 20_000
EDGES = ".,;:!?\"'()[]{}«»|"


@dataclass
class Features:
    """Hashed feature numbers of words: affixes as a table (-1: the word is too short), n-grams as one list cut by word."""

    affixes: np.ndarray
    grams: np.ndarray
    gram_counts: np.ndarray
    lexicon: np.ndarray  # words x lexicons, 0 or 1


def _slot(code: np.ndarray, kind: int, bits: int) -> np.ndarray:
    mixed = (code ^ np.uint64(kind)) * MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def featurize(words: list[str], lexicons: list[frozenset[str]], bits: int) -> Features:
    """Words in lower case, without marks around them."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    first = np.cumsum(sizes + 2) - sizes - 1  # place of each word's first character
    affixes = np.full((len(words), PREFIXES + SUFFIXES), -1, np.int64)
    for count, step, column in ((PREFIXES, 1, 0), (SUFFIXES, -1, PREFIXES)):
        code = np.zeros(len(words), np.uint64)
        for k in range(count):
            has = sizes > k
            at = np.where(has, (first if step > 0 else first + sizes - 1) + step * k, 0)
            if len(codes):
                code = code * np.uint64(0x100000001B3) + codes[at] + np.uint64(1)
            affixes[:, column + k] = np.where(has, _slot(code, 101 + column + k, bits), -1)
    if not len(codes):
        return Features(affixes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(lexicons))))
    mark = codes == 3
    pairs = codes[:-1] * np.uint64(0x1000003) + codes[1:]
    triples = pairs[:-1] * np.uint64(0x1000003) + codes[2:]
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    inside2, inside3 = ~mark[:-1], ~(mark[:-2] | mark[1:-1])
    grams = np.concatenate([_slot(pairs[inside2], 201, bits), _slot(triples[inside3], 202, bits)])
    owners = np.concatenate([owner[:-1][inside2], owner[:-2][inside3]])
    order = np.argsort(owners, kind="stable")
    lexicon = np.array([[w in known for known in lexicons] for w in words], float).reshape(len(words), len(lexicons))
    return Features(affixes, grams[order], np.bincount(owners, minlength=len(words)), lexicon)


def forward_backward(emit: np.ndarray, sizes: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of each word's label, and with ``pairs`` the expected transitions and the log normalisers' sum.

    ``emit`` holds the log weights (words x labels) of texts of ``sizes`` words, one after the other; no size is 0.
    """
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begin, falling = begin[order], -sizes[order]
    top = emit.max(axis=1, keepdims=True)
    weight, move = np.exp(emit - top), np.exp(trans)
    alpha, scale = np.empty_like(weight), np.empty(len(emit))
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(falling, -np.arange(longest), "left")
    a = weight[begin] * np.exp(start)
    for t in range(longest):
        rows = begin[:active[t]] + t
        if t:
            a = (a[:active[t]] @ move) * weight[rows]
        s = a.sum(axis=1)
        a = a / s[:, None]
        alpha[rows], scale[rows] = a, s
    beta = np.ones((len(sizes), emit.shape[1]))
    expected = np.zeros_like(move)
    for t in range(longest - 1, 0, -1):
        rows, n = begin[:active[t]] + t, active[t]
        right = weight[rows] * beta[:n] / scale[rows, None]
        if pairs:
            expected += alpha[rows - 1].T @ right
        alpha[rows] *= beta[:n]
        beta[:n] = right @ move.T
    if longest:
        alpha[begin] *= beta
    if pairs:
        return alpha, expected * move, float(np.log(scale).sum() + top.sum())
    return alpha


@dataclass
class Model:
    labels: list
    bits: int
    lexicons: list[frozenset[str]]
    weights: np.ndarray  # (slots + lexicons) x labels
    start: np.ndarray
    trans: np.ndarray
    extra: dict = field(default_factory=dict)
    seen: np.ndarray | None = None  # slots of the n-grams that training met

    def emissions(self, words: list[str]) -> np.ndarray:
        return self.judged(words)[0]

    def judged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions, and the share of each word's n-grams that training met, whatever their label."""
        f = featurize(words, self.lexicons, self.bits)
        share = np.ones(len(words))
        if self.seen is not None and len(f.grams):
            share = np.add.reduceat(self.seen[f.grams].astype(float), np.cumsum(f.gram_counts) - f.gram_counts) / f.gram_counts
        return _emissions(f, self.weights, 1 << self.bits), share


def _emissions(f: Features, weights: np.ndarray, slots: int) -> np.ndarray:
    padded = np.vstack([weights[:slots], np.zeros((1, weights.shape[1]))])
    out = padded[f.affixes].sum(axis=1) + f.lexicon @ weights[slots:]
    if len(f.grams):  # a word has a pair at least, so no stretch is empty
        out += np.add.reduceat(weights[f.grams], np.cumsum(f.gram_counts) - f.gram_counts, axis=0)
    return out


def _gradient(f: Features, by_word: np.ndarray, slots: int) -> np.ndarray:
    labels = by_word.shape[1]
    out = np.empty((slots + f.lexicon.shape[1], labels))
    spread = np.repeat(np.arange(len(by_word)), f.gram_counts)
    affix, row = f.affixes[f.affixes >= 0], np.nonzero(f.affixes >= 0)[0]
    for k in range(labels):
        out[:slots, k] = np.bincount(affix, by_word[row, k], slots) + np.bincount(f.grams, by_word[spread, k], slots)
    out[slots:] = f.lexicon.T @ by_word
    return out


def train(texts: list[list[str]], tags: list[np.ndarray], labels: list, lexicons: list[frozenset[str]], *, bits: int = 17, rounds: int = 30,
          ridge: float = 1e-4, rate: float = 0.15) -> Model:
    """Fits on tagged texts (words as ``featurize`` wants them; tags are label numbers; -1 is no word's tag)."""
    slots, n_labels = 1 << bits, len(labels)
    vocabulary = sorted({w for t in texts for w in t})
    number = {w: i for i, w in enumerate(vocabulary)}
    words = np.fromiter((number[w] for t in texts for w in t), np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gold = np.concatenate(tags)
    f = featurize(vocabulary, lexicons, bits)
    begin = np.cumsum(sizes) - sizes
    inner = np.ones(len(words), bool)
    inner[begin] = False
    later = np.nonzero(inner)[0]
    seen_moves = np.bincount(gold[later - 1] * n_labels + gold[later], minlength=n_labels ** 2).reshape(n_labels, n_labels).astype(float)
    seen_start = np.bincount(gold[begin], minlength=n_labels).astype(float)
    seen = np.bincount(words * n_labels + gold, minlength=len(vocabulary) * n_labels).reshape(-1, n_labels)
    parts = [np.zeros((slots + len(lexicons), n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels))]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        weights, start, trans = parts
        emit = _emissions(f, weights, slots)[words]
        gamma, moves, _ = forward_backward(emit, sizes, start, trans, pairs=True)
        expected = np.stack([np.bincount(words, gamma[:, k], len(vocabulary)) for k in range(n_labels)], axis=1)
        slopes = [_gradient(f, seen - expected, slots), seen_start - gamma[begin].sum(axis=0), seen_moves - moves]
        for i, (slope, total) in enumerate(zip(slopes, (len(words), len(texts), len(words)))):
            slope = slope / total - ridge * parts[i]
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope ** 2
            parts[i] = parts[i] + rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    met = np.zeros(slots, bool)
    met[f.grams] = True
    return Model(labels, bits, lexicons, *parts, seen=met)


def bare(word: str) -> str:
    return word.lower().strip(EDGES)


class _Places(dict):
    def __init__(self, owner: "Tagger"):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        self.owner.waiting.append(word)
        self[word] = at = len(self)
        return at


class Tagger:
    """Marginals for whole texts; a distinct word's weights are computed once per task and kept up to ``limit`` words."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self._reset()

    def _reset(self) -> None:
        self.places, self.waiting, self.size = _Places(self), [], 0
        self.emit = np.zeros((1024, len(self.model.labels)))
        self.letters = np.zeros(1024, bool)
        self.met = np.zeros(1024)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginals, which words have letters, words in each text); words are cut at white space."""
        if self.size > self.limit:
            self._reset()
        at = []
        for t in texts:
            words = t.split()
            at.append(np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)))
        if self.waiting:
            end = self.size + len(self.waiting)
            if end > len(self.emit):
                room = max(end, 2 * len(self.emit)) - len(self.emit)
                self.emit = np.vstack([self.emit, np.zeros((room, self.emit.shape[1]))])
                self.letters = np.concatenate([self.letters, np.zeros(room, bool)])
                self.met = np.concatenate([self.met, np.zeros(room)])
            for i in range(0, len(self.waiting), WORDS_AT_ONCE):
                some = [bare(w) for w in self.waiting[i:i + WORDS_AT_ONCE]]
                own = slice(self.size + i, self.size + i + len(some))
                self.emit[own], self.met[own] = self.model.judged(some)
            self.letters[self.size:end] = [w.isalpha() or any(map(str.isalpha, w)) for w in self.waiting]
            self.size, self.waiting = end, []
        sizes = np.fromiter(map(len, at), np.int64, len(at))
        words = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.shares = self.met[words]  # of the n-grams of each word, those that training met
        return forward_backward(self.emit[words], sizes[sizes > 0], self.model.start, self.model.trans), self.letters[words], sizes


def by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's words."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]
