"""Periodic runs of words, found by uniting suffix classes by falling LCP.

A run is a stretch of consecutive words of one text with smallest period q
(words q apart are equal), at least ``max(6, 4 * q)`` words long, that cannot
be made longer on either side. Words are ``[^\\x20\\x09-\\x0D]+``.

Per text, the suffixes are ordered by prefix doubling, and the longest common
prefixes (LCP) of neighbours come from prefix hashes. Neighbours are then
united by falling LCP, as Kruskal's algorithm does, with a union-find whose
classes are ordered sets of positions. When two classes meet at LCP l, every
pair i < j that becomes adjacent has exactly l words in common. With q = j - i
and 3 * q <= l, the words from i to j + l have period q, and no smaller one
(a smaller period would have put a position between i and j earlier). The pair
at the first word of the run seeds it: there word i - 1 differs from word
j - 1. A run of length L is seeded at LCP L - q, which is never under
``LEAST`` = 5; so the uniting stops there, and suffixes whose first five words
stand only once in their text take no part.

Texts are independent of each other: nothing is shuffled. Slices of texts are
bounded in bytes; only a single longer text stands alone.

Defined cases: null, empty and blank texts have no words and no runs; repeated
rows are handled row by row; a null doc_id is kept (the query's looped words
need an id, so such a text stays as it is); extra columns are kept, except
``runs`` and ``collapsed``, which are replaced; an empty table gives an empty
result. Runs are listed by start, then period.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shipwatch.llm import batches as B

SHORTEST = 6
REPEATS = 4
LEAST = 5                    # the smallest LCP that seeds a run: q = 1 and length 6
_PLAIN = 2048                # positions that one plain list keeps; larger sets are lists of blocks

_RUN = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
_RUN_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


class Positions:
    """An ordered set of positions in blocks, so that an insertion moves at most one block."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, ordered: list[int]):
        half = _PLAIN // 2
        self.blocks = [ordered[k:k + half] for k in range(0, len(ordered), half)]
        self.lows = [b[0] for b in self.blocks]
        self.size = len(ordered)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int, int]:
        """The nearest smaller and larger position, or -1."""
        k = bisect_left(self.lows, x) - 1
        if k < 0:
            return -1, self.lows[0]
        block = self.blocks[k]
        at = bisect_left(block, x)
        after = block[at] if at < len(block) else self.lows[k + 1] if k + 1 < len(self.lows) else -1
        return block[at - 1], after

    def add(self, x: int) -> None:
        k = max(bisect_left(self.lows, x) - 1, 0)
        block = self.blocks[k]
        insort(block, x)
        self.lows[k] = block[0]
        self.size += 1
        if len(block) > _PLAIN:
            half = len(block) // 2
            self.blocks[k:k + 1] = [block[:half], block[half:]]
            self.lows[k:k + 1] = [block[0], block[half]]


def _around(members: list[int] | Positions, x: int) -> tuple[int, int]:
    if isinstance(members, Positions):
        return members.around(x)
    k = bisect_left(members, x)
    return (members[k - 1] if k else -1), (members[k] if k < len(members) else -1)


def _united(small: list[int] | Positions, large: list[int] | Positions) -> tuple[list[tuple[int, int]], list[int] | Positions]:
    """The pairs that become adjacent when the two sets become one, and that set."""
    pairs = []
    last, after = -1, -2                            # the last position of ``small`` seen, and what follows it in ``large``
    for x in small:
        low, high = _around(large, x)
        if high != after:                           # a new gap of ``large``: the one before is closed
            if after >= 0:
                pairs.append((last, after))
            if low >= 0:
                pairs.append((low, x))
        last, after = x, high
    if after >= 0:
        pairs.append((last, after))
    if isinstance(large, list) and len(large) + len(small) > _PLAIN:
        large = Positions(large)
    if isinstance(large, Positions):
        for x in small:
            large.add(x)
    else:
        large.extend(small)
        large.sort()                                # two sorted stretches: a merge
    return pairs, large


def suffix_order(word: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rank of every suffix; ``end`` is the end of each position's text.

    ``word`` must tell texts apart too, so that no two texts share a class.
    Only classes with more than one suffix are ordered again, by the class of
    the suffix that begins as many words later as are already compared.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    rank, open_ = np.empty(n, np.int64), order
    begin = np.zeros(n, np.int64)
    new = word[order][1:] != word[order][:-1]
    begin[1:] = np.where(new, np.arange(1, n), 0)
    begin = np.maximum.accumulate(begin)
    rank[order] = begin
    k = 1
    while True:
        count = np.bincount(rank, minlength=n)
        open_ = open_[count[rank[open_]] > 1]
        if not len(open_):
            return rank
        later = open_ + k
        inside = later < end[open_]
        key = rank[open_] * np.int64(n + 1)
        key[inside] += rank[later[inside]] + 1
        at = np.argsort(key, kind="stable")
        open_, key = open_[at], key[at]
        old = rank[open_]
        index = np.arange(len(open_))
        fresh = np.ones(len(open_), bool)
        fresh[1:] = old[1:] != old[:-1]
        first = np.maximum.accumulate(np.where(fresh, index, 0))        # the old class begins here
        fresh[1:] |= key[1:] != key[:-1]
        rank[open_] = old + np.maximum.accumulate(np.where(fresh, index, 0)) - first
        k *= 2


class _Prefixes:
    """Equality of word stretches by two 64-bit prefix hashes."""

    def __init__(self, *hashes: np.ndarray):
        self.tables = []
        for h, powers in zip(hashes, B._WORD_POWERS):
            up, down = powers.take(len(h) + 1)
            total = np.zeros(len(h) + 1, B.U64)
            np.cumsum(h * up[:len(h)], out=total[1:])
            self.tables.append((total, down))

    def same(self, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
        out = np.ones(len(i), bool)
        for total, down in self.tables:
            out &= (total[i + length] - total[i]) * down[i] == (total[j + length] - total[j]) * down[j]
        return out

    def common(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, at most ``limit``."""
        got = np.zeros(len(i), np.int64)
        step = 1 << max(int(limit.max(initial=0)).bit_length() - 1, 0)
        while step:
            some = np.flatnonzero(got + step <= limit)
            some = some[self.same(i[some] + got[some], j[some] + got[some], step)]
            got[some] += step
            step >>= 1
        return got


def runs_of(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: tuple[np.ndarray, np.ndarray],
            candidate: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; positions count through all texts given.

    ``ids`` are equal where words of one text are equal, ``begin`` and ``end``
    are the bounds of each position's text, ``candidate`` marks the suffixes
    that may share ``LEAST`` words with another one of their text.
    """
    rank = suffix_order(ids, end)
    at = np.flatnonzero(candidate)
    at = at[np.argsort(rank[at])]
    a, b = at[:-1], at[1:]
    near = np.flatnonzero(end[a] == end[b])
    a, b = a[near], b[near]
    lcp = _Prefixes(*hashes).common(a, b, np.minimum(end[a] - a, end[b] - b))
    much = np.flatnonzero(lcp >= LEAST)
    much = much[np.argsort(-lcp[much], kind="stable")]
    parent: dict[int, int] = {}
    classes: dict[int, list[int] | Positions] = {}
    found: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while True:
            p = parent.setdefault(x, x)
            if p == x:
                return x
            parent[x] = x = parent[p]

    for i, j, common in zip(a[much].tolist(), b[much].tolist(), lcp[much].tolist()):
        i, j = root(i), root(j)
        small, large = classes.pop(i, None) or [i], classes.pop(j, None) or [j]
        if len(small) > len(large):
            small, large, i, j = large, small, j, i
        pairs, members = _united(small, large)
        parent[i] = j
        classes[j] = members
        for x, y in pairs:
            if 3 * (y - x) <= common and y - x + common >= SHORTEST:
                found.append((x, y - x + common, y - x))
    return [(x, n, q) for x, n, q in found if x == begin[x] or ids[x - 1] != ids[x + q - 1]]


def _word_ids(hash1: np.ndarray, hash2: np.ndarray) -> np.ndarray:
    ids = np.unique(hash1, return_inverse=True)[1]
    second = np.empty(int(ids.max(initial=-1)) + 1, B.U64)
    second[ids] = hash2
    if (second[ids] != hash2).any():                 # two words with one hash
        ids = np.unique(np.stack([hash1, hash2]), axis=1, return_inverse=True)[1].reshape(-1)
    return ids.astype(np.int64)


def slice_runs(texts: B.Texts) -> tuple[B.Words, list[list[tuple[int, int, int]]]]:
    """The words of a slice of texts and each text's runs, counted from its first word."""
    words = B.words_of(texts, B.NOT_SPACE, double=True)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    at = B.window_starts(words.first, LEAST)
    owner = np.repeat(np.arange(len(texts)), np.maximum(np.diff(words.first) - LEAST + 1, 0))
    windows = B.window_hash(words.hash, LEAST)
    key = B.mix(windows[at] ^ B.mix(owner.astype(B.U64))) if len(at) else np.zeros(0, B.U64)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    if not repeated.any():
        return words, out
    texts_in = np.unique(owner[repeated])            # texts with a repeated window
    size = np.diff(words.first)[texts_in]
    place = B.ranges(words.first[texts_in], size)
    candidate = np.zeros(len(words.hash), bool)
    candidate[at[repeated]] = True
    stop = np.cumsum(size)
    begin, end = np.repeat(stop - size, size), np.repeat(stop, size)
    h1, h2 = words.hash[place], words.hash2[place]
    ids = _word_ids(h1, h2)
    ids += np.repeat(np.arange(len(size)), size) * np.int64(len(ids) + 1)
    for x, n, q in sorted(runs_of(ids, begin, end, (h1, h2), candidate[place])):
        out[texts_in[int(np.searchsorted(stop, x, "right"))]].append((x - int(begin[x]), n, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return words, out


def _kept(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    split = text.split()
    if runs:
        delta = np.zeros(len(split) + 1, np.int64)
        for x, n, q in runs:
            delta[x + q] += 1
            delta[x + n] -= 1
        split = compress(split, (np.cumsum(delta)[:-1] == 0).tolist())
    return b" ".join(split)


def with_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``runs``, the runs of each text, and ``collapsed``, the text in
    which every run keeps its first period only (words joined by one space)."""
    B.prepare(docs.sparkSession)
    docs = docs.drop("runs", "collapsed")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                found = slice_runs(B.texts_of(part.column("text")))[1]
                raw = pc.fill_null(part.column("text").cast(pa.large_binary()), b"")
                kept = [_kept(t.as_py(), r) for t, r in zip(raw, found)]
                runs = pa.array([[{"start": x, "length": n, "period": q} for x, n, q in r] for r in found], _RUN_ARROW)
                yield pa.RecordBatch.from_arrays([*part.columns, runs, pa.array(kept, pa.binary()).cast(pa.string())],
                                                 names=[*part.schema.names, "runs", "collapsed"])

    schema = StructType([*docs.schema.fields, StructField("runs", _RUN), StructField("collapsed", StringType())])
    return docs.mapInArrow(run, schema)


def looped(docs: DataFrame) -> DataFrame:
    """Stand-in input: (doc_id, text) in which every tenth text ends in a loop.

    With h = crc32(doc_id) and g = floor(h / 10), a text of n > 0 words with
    h % 10 = 0 has its words from a = g % n on replaced by the
    p = 1 + floor((n - a) / (3 + g % 8)) words from a, again and again.
    """
    spaces = "[\\x20\\x09-\\x0D]+"
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), spaces), lambda w: w != "")
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"),
                        F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
        F.col("words"), F.when(i < a, i).otherwise(a + (i - a) % p))), " ")
    return split.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document: n_runs, the longest run (ties: smallest start, then period), digests of all runs and of the collapsed text."""
    found = with_runs(docs.select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.short")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
