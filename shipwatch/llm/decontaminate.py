"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are the strings of one automaton over word ids.
Documents stream through it word by word: the automaton keeps the length of
the longest suffix of what was read that occurs in any item, so every
occurrence of a 13-word item window (or of a whole shorter item) is found in
one pass, and the state tells which items hold it.

Size: an automaton is made for at most ``SHARD_WORDS`` item words and sent to
the executors; a larger benchmark is cut into several such shards (an item is
never cut) and the documents pass each of them, so nothing unbounded is
collected or broadcast. Documents are never shuffled.

Defined cases: null or word-free texts have no words and are never hit; null
or word-free items have no window; repeated items all count by their ids; a
null item id is hit but not listed; extra columns are ignored; an empty
benchmark leaves every document clean; rows with a null doc_id are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from shipwatch.llm import batches as B

WINDOW = 13
SHARD_WORDS = 1_000_000
HIT_SHARE = 20          # contaminated if n_hit * HIT_SHARE >= n_words
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}

SPANS = ("doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class SuffixAutomaton:
    """A generalised suffix automaton of word-id strings, with the items of each state."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items = [0]                       # bit set of items
        self.names: list[str | None] = []
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.vocabulary: dict[bytes, int] = {}

    def _state(self, length: int, link: int, copy: int | None = None) -> int:
        self.next.append({} if copy is None else dict(self.next[copy]))
        self.link.append(link)
        self.length.append(length)
        self.items.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, name: str | None, words: list[str]) -> None:
        if not words:
            return
        ids = [self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in words]
        self.names.append(name)
        last = 0
        for c in ids:
            last = self._extend(last, c)
        self._strings.append(ids)

    @classmethod
    def of(cls, items: list[tuple[str | None, list[str]]], window: int = WINDOW) -> SuffixAutomaton:
        a = cls(window)
        a._strings = []
        for name, words in items:
            a.add(name, words)
        a._finish()
        return a

    def _finish(self) -> None:
        # which items pass through each state, then down the suffix links
        for k, ids in enumerate(self._strings):
            s = 0
            for c in ids:
                s = self.next[s][c]
                self.items[s] |= 1 << k
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                self.items[self.link[s]] |= self.items[s]
        own: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(self._strings):
            if len(ids) < self.window:
                s = 0
                for c in ids:
                    s = self.next[s][c]
                own.setdefault(s, []).append((len(ids), k))
        self.top = [-1] * len(self.next)       # the state of the window that ends here
        for s in reversed(order):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.top[s] = s if self.length[up] < self.window else self.top[up]
            found = own.get(s, []) + self.short.get(up, [])
            if found:
                self.short[s] = found
        self.least = min([self.window, *(len(x) for x in self._strings)], default=self.window)
        words = sorted(self.vocabulary.items(), key=lambda kv: kv[1])
        data = b" ".join(w for w, _ in words)
        ends = np.cumsum([len(w) + 1 for w, _ in words], dtype=np.int64) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        h = B.span_hash(np.frombuffer(data, np.uint8), starts, ends) if words else np.zeros(0, np.uint64)
        self.order = np.argsort(h).astype(np.int64)
        self.hashes = h[self.order]
        self.words = [w for w, _ in words]
        del self._strings

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of hashed words, -1 for words of no item."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first word, end, bit set of items) of every occurrence of a window in ``ids``."""
        s = length = 0
        step, link, size, top, short, window = self.next, self.link, self.length, self.top, self.short, self.window
        for i, c in enumerate(ids):
            while s and c not in step[s]:
                s = link[s]
                length = size[s]
            t = step[s].get(c)
            if t is None:
                s = length = 0
                continue
            s, length = t, length + 1
            if length >= window:
                yield i + 1 - window, i + 1, self.items[top[s]]
            if s in short:
                for k, item in short[s]:
                    if length >= k:
                        yield i + 1 - k, i + 1, 1 << item


def _run(a: SuffixAutomaton, ids: np.ndarray) -> tuple[list[list[int]], int]:
    spans: list[list[int]] = []
    bits = 0
    for x, y, items in a.stream(ids.tolist()):
        if spans and x <= spans[-1][1]:
            spans[-1][0] = min(spans[-1][0], x)
            spans[-1][1] = y
        else:
            spans.append([x, y])
        bits |= items
    return spans, bits


def _hits(a: SuffixAutomaton, texts: B.Texts, words: B.Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """Per text index: merged hit spans in words of the text, and item names."""
    ids = a.ids(words.hash)
    if not len(ids):
        return {}
    # runs of item words inside one text; only those long enough can hold a window
    known = ids >= 0
    edge = np.ones(len(ids), bool)
    edge[1:] = known[1:] != known[:-1]
    edge[words.first[:-1][words.first[:-1] < len(ids)]] = True
    begin = np.flatnonzero(edge)
    end = np.concatenate([begin[1:], [len(ids)]])
    keep = known[begin] & (end - begin >= a.least)
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for b, e in zip(begin[keep].tolist(), end[keep].tolist()):
        spans, bits = _run(a, ids[b:e])
        k = int(np.searchsorted(words.first, b, "right")) - 1
        wrong = [w for x, y in spans for w in range(b + x, b + y)
                 if texts.data[words.start[w]:words.end[w]].tobytes().lower() != a.words[ids[w]]]
        if wrong:                               # the bytes decide: no hit rests on a hash
            ids[wrong] = -1
            spans, bits = _run(a, ids[b:e])
        if not spans:
            continue
        at = out.setdefault(k, ([], set()))
        base = b - int(words.first[k])
        at[0].extend((base + x, base + y) for x, y in spans)
        i = 0
        while bits:
            if bits & 1 and a.names[i] is not None:
                at[1].add(a.names[i])
            bits >>= 1
            i += 1
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _automata(benchmark: DataFrame, window: int) -> list[SuffixAutomaton]:
    """One automaton per shard of at most SHARD_WORDS item words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = 1 + total // (2 * SHARD_WORDS)     # a word and what follows it are two bytes at least
    out = []
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        rows = sorted((r.item, r.text) for r in part.collect() if r.item is not None)
        rows += [(None, r.text) for r in part.where("item is null").collect()]
        out.append(SuffixAutomaton.of([(n, item_words(t)) for n, t in rows], window))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit word spans (disjoint, in words) and the ids of the items that occur."""
    sc = docs.sparkSession.sparkContext
    B.prepare(docs.sparkSession)
    sent = [sc.broadcast(a) for a in _automata(benchmark, window)]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        ("items", pa.list_(pa.string()))])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                texts = B.texts_of(part.column("text"))
                words = B.words_of(texts, B.ALNUM, lower=True)
                found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
                for a in sent:
                    for k, (spans, items) in _hits(a.value, texts, words).items():
                        at = found.setdefault(k, ([], set()))
                        at[0].extend(spans)
                        at[1].update(items)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array([[{"start": x, "end": y} for x, y in _merged(found[k][0])] if k in found else []
                              for k in range(n)], schema.field("spans").type),
                    pa.array([sorted(found[k][1]) if k in found else [] for k in range(n)],
                             pa.list_(pa.string()))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(B.released(scan), SPANS)


def verdicts(found: DataFrame, share: int = HIT_SHARE) -> DataFrame:
    """Digest columns of ``contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (found.withColumn("n_hit", hit)
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   share: int = HIT_SHARE) -> DataFrame:
    """The documents with every hit span removed; contaminated documents are dropped.

    A document below the coverage limit keeps its text but for the hit words
    (from the first byte of the first hit word to the end of the last one).
    All other columns pass unchanged; nothing is shuffled.
    """
    sc = docs.sparkSession.sparkContext
    B.prepare(docs.sparkSession)
    sent = [sc.broadcast(a) for a in _automata(benchmark, window)]

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                texts = B.texts_of(part.column("text"))
                words = B.words_of(texts, B.ALNUM, lower=True)
                found: dict[int, list[tuple[int, int]]] = {}
                for a in sent:
                    for k, (spans, _) in _hits(a.value, texts, words).items():
                        found.setdefault(k, []).extend(spans)
                if not found:
                    yield part
                    continue
                column, keep = part.column("text").to_pylist(), np.ones(len(texts), bool)
                for k, spans in found.items():
                    first, n = int(words.first[k]), int(words.first[k + 1] - words.first[k])
                    spans = _merged(spans)
                    if share * sum(y - x for x, y in spans) >= n:
                        keep[k] = False
                        continue
                    raw, at, pieces = texts.data, int(texts.offsets[k]), []
                    for x, y in spans:
                        pieces.append(raw[at:words.start[first + x]].tobytes())
                        at = int(words.end[first + y - 1])
                    pieces.append(raw[at:texts.offsets[k + 1]].tobytes())
                    column[k] = b"".join(pieces).decode()
                i = part.schema.get_field_index("text")
                yield part.set_column(i, part.schema.field(i), pa.array(column, part.schema.field(i).type)).filter(
                    pa.array(keep))

    return docs.mapInArrow(B.released(scan), docs.schema)


__all__ = ["SuffixAutomaton", "contamination", "decontaminated", "item_words", "verdicts"]
