"""Secret scan: patterns of known kinds, and a token-efficiency test for random strings.

A byte-pair vocabulary spends few tokens on words and many on random characters. A run of key-like characters is held
against the vocabulary: fewer characters per token than ``max_ratio`` mark it as random. Where the whole run passes, its
parts between = / - _ + are held against it as well, so a readable name or path does not hide the value beside it. Runs and
parts that are known digests or identifiers (a digest of usual length, UUID, number, address, path, version or plain
words) are left out first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.batches import only, released, rows, slices, texts

# The kinds, their patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # leftmost and greedy: whole runs
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}

MIN_LENGTH = 16  # of a run or a part of one; shorter random values can't be told from short words by their tokens
LETTERS_LENGTH = 24  # of a run of small letters or of capitals only, as long words are
PART = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])|[A-Za-z0-9]+")  # a UUID is one part
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)  # of md5, sha1, sha224, sha256, sha384, sha512 in hexadecimal
HEXADECIMAL = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
NUMBER = re.compile(r"[0-9+/_=-]+\Z")
MAX_RATIO = 2.0
MIN_CLASSES = 2  # of lower case, upper case and digits


@lru_cache(maxsize=8)
def runs(min_length: int) -> re.Pattern:
    """Whole runs of key-like characters, ``min_length`` or longer."""
    return re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min_length},}}")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken vocabulary in a file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests and identifiers: random to the eye, but no secrets. So are numbers and words: one class of characters, save many letters in a row."""
    if HEXADECIMAL.match(run) and len(run) in DIGEST_LENGTHS or UUID.match(run) or NUMBER.match(run):
        return True
    inner = run[1:]  # a capital at the start is a word's
    if sum((inner.lower() != inner, inner.upper() != inner, any("0" <= c <= "9" for c in inner))) >= MIN_CLASSES:
        return False
    return len(run) < LETTERS_LENGTH or not run.isalpha()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the three kinds: leftmost, not overlapping within a kind, those that are too short dropped."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def random_parts(run: str, ranks, max_ratio: float, min_length: int = MIN_LENGTH) -> Iterator[tuple[int, int]]:
    """Stretches of parts that are each short of ``max_ratio``; a part that is readable or known ends a stretch.

    A value in base64 has + / - _ of its own, so neighbouring parts that all look random are one stretch.
    """
    stretch = []
    for m in [*PART.finditer(run), None]:
        part = m.group() if m else ""
        if m and not UUID.match(part) and not (HEXADECIMAL.match(part) and len(part) in DIGEST_LENGTHS) and _dear(part, ranks, max_ratio):
            stretch.append(m)
            continue
        if stretch:
            start, end = stretch[0].start(), stretch[-1].end()
            whole = run[start:end]
            if len(whole) >= min_length and not known(whole) and _dear(whole, ranks, max_ratio):
                yield start, end
        stretch = []


def _dear(run: str, ranks, max_ratio: float) -> bool:
    """Whether the vocabulary needs many tokens for it."""
    return len(run) < max_ratio * len(ranks.encode_ordinary(run))


def _random_run(run: str, ranks, max_ratio: float, min_length: int) -> list[tuple[int, int]]:
    if len(run) < min_length or known(run):
        return []
    return [(0, len(run))] if _dear(run, ranks, max_ratio) else list(random_parts(run, ranks, max_ratio, min_length))


def _gaps(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of [start, end) beside the spans ``taken``."""
    out = []
    for s, e in sorted(taken):
        if s > start:
            out.append((start, min(s, end)))
        start = max(start, e)
    return [(a, b) for a, b in [*out, (start, end)] if a < b]


def random_spans(text: str, taken: list[tuple[int, int, str]], ranks, max_ratio: float = MAX_RATIO, min_length: int = MIN_LENGTH) -> list[tuple[int, int, str]]:
    """Runs of key-like characters that the vocabulary can't shorten and no other kind has.

    Where a hexadecimal or access span is only a piece of a random stretch of letters and digits, the rest of that stretch is marked,
    however short; what else a run has beside such spans is tested like a run.
    """
    found = []
    for m in runs(min_length).finditer(text):
        start, end = m.span()
        own = [(s, e, k) for s, e, k in taken if s < end and start < e]
        done = [(s, e) for s, e, _ in own]
        for s, e, k in own:
            if k == "assign":
                continue
            a, b = max(s, start), min(e, end)
            while a > start and text[a - 1].isalnum():
                a -= 1
            while b < end and text[b].isalnum():
                b += 1
            if (a, b) != (s, e) and b - a >= min_length and not known(text[a:b]) and _dear(text[a:b], ranks, max_ratio):
                rest = _gaps(a, b, done)
                found += [(x, y, "random") for x, y in rest]
                done += rest
        for a, b in _gaps(start, end, done) if done else [(start, end)]:
            found += [(a + x, a + y, "random") for x, y in _random_run(text[a:b], ranks, max_ratio, min_length)]
    return found


def spans_of(text: str, ranks, max_ratio: float = MAX_RATIO, min_length: int = MIN_LENGTH) -> tuple[list, list]:
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS[s[2]]))
    return base, sorted(base + random_spans(text, base, ranks, max_ratio, min_length), key=lambda s: (s[0], KINDS[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", max_ratio: float = MAX_RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row, in one pass without a shuffle.

    ``spans`` lists kind:start:end in code points, end exclusive. Random values shorter than ``min_length`` are not looked for. A null or empty text has no span; repeated rows each get
    their result; an empty table gives no rows.
    """
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = encoding(vocabulary)
        for batch in slices(batches):
            found = [spans_of(t, ranks, max_ratio, min_length) for t in texts(batch)]
            count = {k: [sum(s[2] == k for s in spans) for _, spans in found] for k in KINDS}
            yield rows(doc_id=batch.column("doc_id"), n_assign=count["assign"], n_access=count["access"], n_hex=count["hex"], n_random=count["random"],
                       base_sha256=[hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
                       spans=pa.array([joined(spans) for _, spans in found], pa.string()))
    source = only(docs, doc_id=doc_id, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, vocabulary: str, *, text: str = "text", mark: str = "[secret]", max_ratio: float = MAX_RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; null texts stay null."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = encoding(vocabulary)
        for batch in slices(batches, text):
            clean = []
            for t in batch.column(text).to_pylist():
                if t:
                    parts, at = [], 0
                    for start, end, _ in spans_of(t, ranks, max_ratio, min_length)[1]:
                        if end <= at:
                            continue
                        parts += [t[at:max(at, start)], mark if start >= at else ""]
                        at = end
                    t = "".join([*parts, t[at:]])
                clean.append(t)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
    return docs.mapInArrow(run, docs.schema)
