"""Byte-level BPE ids of whole texts, with each distinct word encoded once.

The vocabulary's split of a text into words (letters, digits, other signs,
white space, each with at most one space before it) never lets a merge cross a
word, so the ids of a text are the ids of its words in a row. Words are found
for a whole slice at once; only words not met before by this worker go through
the ``tokenizers`` library. Texts with characters outside the Latin, Greek,
Cyrillic, Armenian and general punctuation blocks go through it whole. For a
vocabulary that drops white space and lower-cases, a space joins no word, and
texts with combining marks go through whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np

from shipwatch.llm import batches as B

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 1_000_000             # distinct words kept by a worker before it starts anew
RECENT_WORDS = 50_000               # of them in a dictionary, the others in ordered arrays
PART_CHARS = 1 << 19                # a longer text is split between words
_LETTER, _NUMBER, _SPACE, _OTHER, _FOREIGN = range(5)
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Unicode White_Space below U+2300 (fixed values)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]


def _classes() -> np.ndarray:
    table = np.full(0x2301, _FOREIGN, np.uint8)
    for c in (*range(0x0590), *range(0x2000, 0x2300)):
        kind = unicodedata.category(chr(c))[0]
        table[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    table[_WHITE] = _SPACE
    return table


_CLASS = _classes()
#: where a normaliser works on signs: what may melt into, or turn into more than, its neighbours is foreign
_PLAIN_CLASS = np.where([c in (0x130, 0x2300) or unicodedata.category(chr(c))[0] == "M" for c in range(0x2301)], _FOREIGN, _CLASS)
_POWERS = B._Powers(0x8CB92BA72F3D8DD7)
_MIXED = B.mix(np.arange(1, 0x2302, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _contractions(code: np.ndarray, kind: np.ndarray, first: np.ndarray, begin: np.ndarray) -> None:
    """An apostrophe that begins a word, before s t m d re ve ll, takes these letters only."""
    n = len(code)
    at = np.flatnonzero((code[:-1] == 0x27) & begin[:-1] & (kind[1:] == _LETTER) & ~first[1:n])
    if len(at):
        x = code[at + 1]
        more = at + 2
        y = np.where((more < n) & ~first[np.minimum(more, n)], code[np.minimum(more, n - 1)], 0)
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        begin[at[one | two] + 1] = False
        after = np.concatenate([at[one] + 2, at[two] + 3])
        after = after[after < n]
        begin[after[~first[after] & (kind[after] == _LETTER)]] = True


def word_starts(code: np.ndarray, kind: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Mask of the positions at which a word begins; ``texts``: offsets of the texts in ``code``."""
    n = len(code)
    first = np.zeros(n + 1, bool)
    first[texts] = True
    begin = first[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # the last sign of a white run stands before what follows: a space joins it, others stay alone
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n])
    begin[last] = True
    begin[last[code[last] == 0x20] + 1] = False
    _contractions(code, kind, first, begin)
    return begin


def white_starts(code: np.ndarray, kind: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The same for a vocabulary that drops white space and takes capital letters for small ones."""
    first = np.zeros(len(code) + 1, bool)
    first[texts] = True
    begin = first[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    _contractions(np.where((code >= 0x41) & (code <= 0x5A), code + 0x20, code), kind, first, begin)
    return begin


class Encoder:
    """Ids of many texts at a time. One per worker process and vocabulary file."""

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, with_ids: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer, self.with_ids = Tokenizer.from_file(path), with_ids
        self.tokenizer.encode_special_tokens = True     # their strings in a text are ordinary text
        drops_white = self.tokenizer.encode(" a", add_special_tokens=False).ids == self.tokenizer.encode(
            "a", add_special_tokens=False).ids
        self.starts, self.classes = (white_starts, _PLAIN_CLASS) if drops_white else (word_starts, _CLASS)
        self._clear()

    @classmethod
    def at(cls, path: str, with_ids: bool = True) -> Encoder:
        """``with_ids`` false: for ``counts`` only, in less time and memory."""
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = (path, with_ids)
        return cls._made.get(key) or cls._made.setdefault(key, cls(path, with_ids))

    @classmethod
    def forget(cls) -> None:
        """Drop the vocabularies and words of this worker; the next task loads them anew."""
        cls._made.clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}      # words learned lately
        self.known = np.zeros(0, np.uint64)   # the others: hashes in order, with their slots
        self.known_slot = np.zeros(0, np.int32)
        self.size = 0
        self.begin = np.zeros(1024, np.int32)
        self.count = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        found = self.tokenizer.encode_batch(words, add_special_tokens=False)
        need = self.size + len(found)
        while need > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        lengths = np.array([len(x) for x in found], np.int64)
        total = int(lengths.sum())
        if self.with_ids:
            while self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32, total)
        self.begin[self.size:need] = self.used + np.cumsum(lengths) - lengths
        self.count[self.size:need] = lengths
        self.slot.update(zip(hashes, range(self.size, need)))
        self.size, self.used = need, self.used + total

    def _settle(self) -> None:
        """Move what was learned lately into the ordered arrays, which take a tenth of the memory."""
        keys = np.concatenate([self.known, np.fromiter(self.slot, np.uint64, len(self.slot))])
        slots = np.concatenate([self.known_slot, np.fromiter(self.slot.values(), np.int32, len(self.slot))])
        order = np.argsort(keys)
        self.known, self.known_slot, self.slot = keys[order], slots[order], {}

    def _slots(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache slots of all words, and the number of words of each part."""
        joined = "".join(parts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        kind = self.classes[code]
        start = np.flatnonzero(self.starts(code, kind, offsets))
        end = np.concatenate([start[1:], [len(code)]])
        up, down = _POWERS.take(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_MIXED[code] * up[:len(code)], out=total[1:])
        h = B.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        unique, at, back = np.unique(h, return_index=True, return_inverse=True)
        if self.size + len(unique) > CACHE_WORDS:
            self._clear()
        slots = np.full(len(unique), -1, np.int64)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
            slots = np.where(self.known[near] == unique, self.known_slot[near], -1).astype(np.int64)
        rest = np.flatnonzero(slots < 0)
        keys = unique[rest].tolist()
        missing = [k for k, x in enumerate(keys) if x not in self.slot]
        if missing:
            where = at[rest[missing]]
            self._learn([keys[k] for k in missing],
                        [joined[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())])
        slots[rest] = np.fromiter((self.slot[x] for x in keys), np.int64, len(keys))
        if len(self.slot) > RECENT_WORDS:
            self._settle()
        return slots[back], np.diff(np.searchsorted(start, offsets))

    def _split(self, texts: Iterable[str]) -> tuple[list[str], list[int], dict[int, str]]:
        parts, owner, foreign = [], [], {}
        for k, t in enumerate(texts):
            if not t:
                continue
            if not t.isascii() and (self.classes[np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), 0x2300)]
                                    == _FOREIGN).any():
                foreign[k] = t
                continue
            a = 0
            while len(t) - a > PART_CHARS and (m := _SAFE_CUT.search(t, a + PART_CHARS)):
                parts.append(t[a:m.start()])
                owner.append(k)
                a = m.start()
            parts.append(t[a:])
            owner.append(k)
        return parts, owner, foreign

    def _groups(self, texts: list[str]):
        """(slots, words per text) of runs of parts with about PART_CHARS characters."""
        parts, owner, foreign = self._split(texts)
        i = 0
        while i < len(parts):
            j, chars = i, 0
            while j < len(parts) and (j == i or chars + len(parts[j]) <= PART_CHARS):
                chars += len(parts[j])
                j += 1
            slots, words = self._slots(parts[i:j])
            yield slots, words, owner[i:j]
            i = j
        for k, t in foreign.items():
            yield None, self.tokenizer.encode(t, add_special_tokens=False).ids, k

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for slots, words, owner in self._groups(texts):
            if slots is None:
                out[owner] += len(words)
                continue
            total = np.concatenate([[0], np.cumsum(self.count[slots], dtype=np.int64)])
            ends = np.cumsum(words)
            np.add.at(out, owner, total[ends] - total[ends - words])
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        pieces: list[list[np.ndarray]] = [[] for _ in texts]
        for slots, words, owner in self._groups(texts):
            if slots is None:
                pieces[owner].append(np.array(words, np.uint32))
                continue
            count = self.count[slots].astype(np.int64)
            flat = self.flat[B.ranges(self.begin[slots].astype(np.int64), count)]
            total = np.concatenate([[0], np.cumsum(count)])
            ends = np.cumsum(words)
            for k, x, y in zip(owner, total[ends - words].tolist(), total[ends].tolist()):
                pieces[k].append(flat[x:y])
        return [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.uint32), *p]) for p in pieces]
