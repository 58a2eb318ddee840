"""Token ids of whole texts with the tokenizers library, encoding each distinct part once as long as it is remembered.

A byte-level tokenizer that keeps a leading space with its word, and one that drops white space, both read a text cut at
single spaces (and before single line ends) between two other characters as the parts read alone. So many new parts are
encoded in one call, with a mark between them in the ids, and a text's ids are looked up. Spaces beside other white space
are no such cut: texts that hold one are cut elsewhere only.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

CUT = re.compile(r"(?<=\S) (?=\S)")
ENDS = (".", "!", "?", ".\"", "!\"", "?\"")
CACHE_PARTS = 250_000  # remembered parts; when there are more, the half that was used most stays
AT_ONCE = 4_096
BATCH_BYTES = 4 << 20
LEARN_CHARS = 1 << 20  # of text whose parts are looked up, and the new ones encoded, together
NEW, ODD = -1, -2  # numbers of parts not met yet, and of those beside a space that is no cut
BETWEEN = "~"  # stands between parts whose ids show no beginnings


@dataclass
class Encoded:
    ids: np.ndarray  # of all texts, one after the other
    parts: np.ndarray  # ids in each part
    sentence: np.ndarray  # whether a part ends a sentence
    docs: np.ndarray  # parts in each text


class WordIds:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would only wait for work
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        described = json.dumps(json.loads(self.tokenizer.pre_tokenizer.__getstate__()), sort_keys=True)  # not the whole file, which is large once it is read
        keeps = '"add_prefix_space": false' in described and '"use_regex": true' in described
        drops = '"behavior": "Removed"' in described and r"[^\\s\\p{L}\\p{N}]+" in described
        if not (keeps or drops):
            raise ValueError("how this tokenizer treats spaces is not known")
        self.keeps_space, self.limit = keeps, cache_parts
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # Marks where a word begins (keeps) or ends (drops) in the ids of many words, where a line begins, and what stands between parts.
        self.edge = np.array([n.startswith("Ġ") if keeps else n.endswith("</w>") for n in names])
        self.line = np.array([n == "Ċ" for n in names])
        self.between = np.array([n == BETWEEN + "</w>" for n in names])
        # Numbers of parts after a space (of all parts where spaces are dropped), of those that begin a text, and the same in texts that are cut elsewhere.
        self.rest, self.first, self.odd_rest, self.odd_first = {}, {}, {}, {}
        self.size = self.used = 0
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.uses = np.zeros(1024, np.int64)
        self.ends = np.zeros(1024, bool)
        self.flat = np.zeros(4096, np.uint32)

    def _forget(self) -> None:
        """Keeps the half of the parts that was used most."""
        stay = np.sort(np.argsort(-self.uses[:self.size], kind="stable")[:self.limit // 2])
        moved = np.full(self.size, NEW)
        moved[stay] = np.arange(len(stay))
        for name in ("rest", "first", "odd_rest", "odd_first"):
            table = getattr(self, name)
            to = moved[np.fromiter(table.values(), np.int64, len(table))].tolist() if table else []
            setattr(self, name, {part: at for part, at in zip(table, to) if at >= 0})
        counts = self.count[stay]
        begins = np.cumsum(counts) - counts
        self.flat = self.flat[np.repeat(self.start[stay] - begins, counts) + np.arange(int(counts.sum()))]
        self.start, self.count, self.ends, self.uses = begins, counts, self.ends[stay], self.uses[stay] >> 1
        self.size, self.used = len(stay), len(self.flat)

    def _together(self, parts: list[str], join: str, marks: np.ndarray, separate: bool = False) -> None:
        """Stores parts encoded in one call: each begins with one of ``marks``, and no other id of it is one (or, with ``separate``, follows one)."""
        for i in range(0, len(parts), AT_ONCE):
            some = parts[i:i + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([join + join.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            begins = np.nonzero(marks[ids])[0]
            if len(begins) != len(some):  # a character that the tokenizer's normal form changes
                self._apart(some, "" if separate else join)
                continue
            counts = np.diff(np.append(begins, len(ids)))
            self._store(some, np.delete(ids, begins) if separate else ids, counts - separate)

    def _letters(self, words: list[str]) -> None:
        """The same for runs of letters where only ends of words show."""
        for i in range(0, len(words), AT_ONCE):
            some = words[i:i + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.nonzero(self.edge[ids])[0]
            if len(ends) != len(some):  # a letter that the tokenizer's normal form splits
                self._apart(some, "")
                continue
            self._store(some, ids, np.diff(np.append(-1, ends)))

    def _apart(self, parts: list[str], before: str) -> None:
        """The same with a call's text for each part."""
        for i in range(0, len(parts), AT_ONCE):
            some = parts[i:i + AT_ONCE]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([before + p for p in some], add_special_tokens=False)]
            self._store(some, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _learn(self, table: dict[str, int], new: list[str], begin_texts: bool, strict: bool) -> None:
        """Numbers and ids of new parts."""
        at, known = self.size, []
        if begin_texts:
            groups = [(new, lambda parts: self._apart(parts, ""))]
        elif self.keeps_space:
            clean = [p for p in new if p and p.strip() == p and " " not in p]
            other = [p for p in new if not (p and p.strip() == p and " " not in p)]
            lines = [p for p in other if strict and p[:1] == "\n" and len(p) > 1 and p[1:].strip() == p[1:]]
            groups = [(clean, lambda parts: self._together(parts, " ", self.edge)), (lines, lambda parts: self._together(parts, "", self.line))]
            if not strict:
                groups.append((other, lambda parts: self._apart(parts, " ")))
            elif len(lines) < len(other):
                table.update(dict.fromkeys(set(other).difference(lines), ODD))
        else:
            letters = [p for p in new if p.isalpha() and self._stays_letters(p)]
            met = set(letters)
            other = [p for p in new if p not in met]
            groups = [(letters, self._letters), ([p for p in other if BETWEEN not in p], lambda parts: self._together(parts, f" {BETWEEN} ", self.between, True)),
                      ([p for p in other if BETWEEN in p], lambda parts: self._apart(parts, ""))]
        for parts, learn in groups:
            learn(parts)
            known += parts
        table.update(zip(known, range(at, self.size)))

    def _stays_letters(self, word: str) -> bool:
        """Whether a normal form with small letters is a run of letters still."""
        return word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha()

    def _store(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, total = len(parts), len(ids)
        for name, need in (("start", self.size + n), ("count", self.size + n), ("uses", self.size + n), ("ends", self.size + n), ("flat", self.used + total)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, len(old) * 3 // 2) - len(old), old.dtype)]))
        own = slice(self.size, self.size + n)
        self.start[own], self.count[own], self.uses[own] = self.used + np.cumsum(counts) - counts, counts, 0
        self.ends[own] = [p.endswith(ENDS) for p in parts]
        self.flat[self.used:self.used + total] = ids
        self.size += n
        self.used += total

    def _numbers(self, table: dict[str, int], parts: list[str], begin_texts: bool = False, strict: bool = False) -> np.ndarray:
        found = np.fromiter(map(table.get, parts, repeat(NEW)), np.int64, len(parts))
        at = np.nonzero(found == NEW)[0]
        if len(at):
            unmet = [parts[i] for i in at.tolist()]
            new = list(dict.fromkeys(unmet))
            if strict and begin_texts:
                odd = {p: ODD for p in new if not p or p.strip() != p}
                table.update(odd)
                new = [p for p in new if p not in odd]
            self._learn(table, new, begin_texts, strict)
            found[at] = np.fromiter(map(table.__getitem__, unmet), np.int64, len(unmet))
        return found

    def _places(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the parts of each text."""
        parts, sizes = [], []
        for t in texts:
            own = t.replace("\n", " \n").split(" ") if t else []
            parts += own
            sizes.append(len(own))
        keeps, ends = self.keeps_space, np.cumsum(sizes, dtype=np.int64)
        found = self._numbers(self.rest, parts, strict=keeps)
        if keeps and parts:
            begins = np.unique(ends - sizes)
            begins = begins[begins < len(parts)]
            found[begins] = self._numbers(self.first, [parts[i] for i in begins.tolist()], True, True)
        each = np.split(found, ends[:-1])
        if keeps and parts:
            for i in np.unique(np.searchsorted(ends, np.nonzero(found == ODD)[0], "right")).tolist():
                own = CUT.split(texts[i])
                each[i] = np.concatenate([self._numbers(self.odd_first, own[:1], True), self._numbers(self.odd_rest, own[1:])])
        return each

    def encode(self, texts: list[str]) -> Encoded:
        if self.size > self.limit:
            self._forget()
        places, at, unread = [], 0, 0
        for i, t in enumerate(texts):
            unread += len(t)
            if unread > LEARN_CHARS or i == len(texts) - 1:
                places += self._places(texts[at:i + 1])
                at, unread = i + 1, 0
        docs = np.fromiter(map(len, places), np.int64, len(places))
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.uses[:self.size] += np.bincount(at, minlength=self.size)
        counts = self.count[at]
        begins = np.cumsum(counts) - counts
        ids = self.flat[np.repeat(self.start[at] - begins, counts) + np.arange(int(counts.sum()))]
        return Encoded(ids, counts, self.ends[at], docs)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The encoder of a worker process; what it has learned serves the tasks that follow."""
    return WordIds(path)


def lengths(encoded: Encoded) -> np.ndarray:
    """Ids in each text."""
    upto = np.concatenate([[0], np.cumsum(encoded.parts)])
    ends = np.cumsum(encoded.docs)
    return upto[ends] - upto[ends - encoded.docs]
