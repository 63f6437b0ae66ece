"""Substring dedup with difference-cover anchors.

A window of 13 words is removed where its word sequence also starts in a
document with a smaller id. The anchors are 7-word windows at the word
positions whose remainder modulo 7 lies in the difference cover {0, 1, 3}:
for any two positions i and j some shift d < 7 puts i + d and j + d both in
the cover, so two equal 13-word windows always share an aligned anchor that
lies inside both. Three sevenths of the positions are hashed instead of all.

1. Every text yields its anchors, packed per bucket of the anchor hash into
   binary blocks (some 15 bytes an anchor, no row per anchor).
2. Buckets (one shuffle): places of anchors found in two documents are sent,
   packed again, to the homes of their texts (a home is a hash class of rows).
3. Extension: texts and places meet by home; only the 13-word windows around
   kept anchors are hashed, with 96 bits, packed and bucketed the same way;
   the smallest document id of each window decides.
4. The decisions meet the texts by home (the same exchange of the texts).

Numbers of buckets and homes follow the bytes of text, so a group of either
holds about ``BUCKET_BYTES`` of text at any size of input. A passage or text
that a third of all rows hold is reduced before each shuffle: what a slice of
texts can decide by itself (a hash it sees under a smaller id too) is sent
home as decided, and only the slice's smallest document asks the bucket. So a
bucket gets at most one document per hash and slice.

Defined cases: null and empty texts have no words; texts under 13 words lose
nothing; rows that repeat a doc_id are one document for the comparison (equal
ids never remove each other's words) and each row gets its own result; rows
with a null doc_id are compared as if their id were larger than any other;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from shipwatch.llm import batches as B

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)                       # a perfect difference cover modulo 7
ANCHOR = WINDOW - PERIOD + 1
NULL_ID = np.iinfo(np.int64).max
BUCKET_BYTES = 12 << 20                 # of text behind one bucket or home, on average
_IN_COVER = np.isin(np.arange(PERIOD), COVER)

_BLOCK = "bucket int, hashes binary, more binary, idx binary, places binary, ids binary, rows binary"
_NAMES = ["bucket", "hashes", "more", "idx", "places", "ids", "rows"]
_FOUND = "home int, idx binary, places binary, ids binary, rows binary"


def anchor_starts(first: np.ndarray) -> np.ndarray:
    """Word indexes of the cover positions of each text at which an anchor fits."""
    at = B.window_starts(first, ANCHOR)
    base = np.repeat(first[:-1], np.maximum(np.diff(first) - ANCHOR + 1, 0))
    return at[_IN_COVER[(at - base) % PERIOD]]


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(int(NULL_ID)), np.int64)


def _blocks(key: np.ndarray, columns: dict[str, np.ndarray | None], which: np.ndarray, ids: np.ndarray,
            rows: np.ndarray, name: str) -> pa.Table:
    """One row per key with the records of the key as binary columns.

    The row lists its texts, (id, row key), once; a bit per record (``idx``)
    says whether the record begins the next text of the list. Ids and places
    are kept as differences, which compress well.
    """
    order = np.lexsort((which, key))
    key, which = key[order], which[order]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_text = new_key.copy()
    new_text[1:] |= which[1:] != which[:-1]
    begin = np.flatnonzero(new_key)
    end = np.concatenate([begin[1:], [len(order)]]).astype(np.int64)
    seq = np.cumsum(new_text) - 1
    texts = which[new_text]
    list_begin = seq[begin]
    list_end = np.concatenate([list_begin[1:], [len(texts)]]).astype(np.int64)

    def column(a: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> pa.Array:
        return pa.array([b"" if a is None else a[i:j].tobytes() for i, j in zip(x.tolist(), y.tolist())], pa.binary())

    out = {name: pa.array(key[begin].astype(np.int32))}
    for c, a in columns.items():
        a = None if a is None else a[order]
        if c == "places":                       # differences: runs of places pack to almost nothing
            a = np.diff(a, prepend=np.int32(0)).astype(np.int32)
            first = columns[c][order][begin]
            a[begin] = first
        out[c] = column(a, begin, end)
    listed = ids[texts]
    step = np.diff(listed, prepend=np.int64(0))
    step[list_begin] = listed[list_begin]
    bits = [np.packbits(new_text[x:y]).tobytes() for x, y in zip(begin.tolist(), end.tolist())]
    out |= {"idx": pa.array(bits, pa.binary()), "ids": column(step, list_begin, list_end),
            "rows": column(rows[texts].astype(np.int32), list_begin, list_end)}
    return pa.table(out)


def _asked(hashes: np.ndarray, more: np.ndarray | None, which: np.ndarray, places: np.ndarray, ids: np.ndarray,
           rows: np.ndarray, buckets: int) -> pa.Table:
    """Records of a slice: those it decides go under key -1 - home, the others under their bucket.

    With ``more`` (windows) a record is decided if the slice has its hash under a smaller id;
    without (anchors) if the slice has it under another id. The smallest id always asks.
    """
    doc = ids[which]
    _, low, high = _extremes(hashes, more, doc)
    ask = doc == low
    known = doc > low if more is not None else high > low
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    places = places.astype(np.int32)
    # inside its bucket 32 bits tell an anchor well enough (it only proposes); a window keeps 96
    value = hashes.astype(np.uint32) if more is None else hashes
    asked = _blocks(bucket[ask], {"hashes": value[ask], "more": None if more is None else more[ask].astype(np.uint32),
                                  "places": places[ask]},
                    which[ask], ids, rows, "bucket")
    told = _blocks(-1 - home_of(doc[known], buckets), {"hashes": None, "more": None, "places": places[known]},
                   which[known], ids, rows, "bucket")
    return pa.concat_tables([asked.select(_NAMES), told.select(_NAMES)])


def _extremes(hashes: np.ndarray, more: np.ndarray | None, doc: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, and for each record the smallest and largest id that has its hash."""
    low, high = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    if not len(doc):
        return np.zeros(0, np.int64), low, high
    order = np.argsort(hashes, kind="stable") if more is None else np.lexsort((more, hashes))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(h)]]))
    low[order] = np.repeat(np.minimum.reduceat(d, begin), size)
    high[order] = np.repeat(np.maximum.reduceat(d, begin), size)
    return order, low, high


def home_of(ids: np.ndarray, homes: int) -> np.ndarray:
    """``pmod(xxhash64(id), homes)`` as Spark computes it for a long."""
    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))     # fixed values
    h = np.uint64((42 + int(p5) + 8) % 2 ** 64) ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % homes


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, row key, place) of every record of a group of blocks."""
    ids, rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for i, p, a, b in zip(*(table.column(c).to_pylist() for c in ("idx", "places", "ids", "rows"))):
        places.append(np.cumsum(np.frombuffer(p, np.int32), dtype=np.int32))
        i = np.cumsum(np.unpackbits(np.frombuffer(i, np.uint8))[:len(places[-1])].astype(np.int64)) - 1
        ids.append(np.cumsum(np.frombuffer(a, np.int64))[i])
        rows.append(np.frombuffer(b, np.int32)[i].astype(np.int64))
    return np.concatenate(ids), np.concatenate(rows), np.concatenate(places)


def _sent_home(ids: np.ndarray, rows: np.ndarray, places: np.ndarray, homes: int) -> pa.Table:
    """Places packed per home of their text."""
    order = np.lexsort((rows, ids))
    ids, rows, places = ids[order], rows[order], places[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    which = np.cumsum(new) - 1
    return _blocks(home_of(ids, homes), {"places": places.astype(np.int32)}, which, ids[new], rows[new], "home").select(
        ["home", "idx", "places", "ids", "rows"])


class _Places:
    """Places of the texts of a home."""

    def __init__(self, table: pa.Table):
        ids, rows, places = _texts(table)
        order = np.lexsort((places, rows, ids))
        ids, rows, self.places = ids[order], rows[order], places[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
        begin = np.flatnonzero(new).tolist()
        self.at = {k: (x, y) for k, x, y in zip(zip(ids[begin].tolist(), rows[begin].tolist()), begin,
                                                [*begin[1:], len(ids)])}

    def of(self, doc: int, row: int) -> np.ndarray | None:
        """Sorted, without repeats; None if there are none."""
        span = self.at.get((doc, row))
        return None if span is None else np.unique(self.places[span[0]:span[1]])


def _shared(key: tuple, table: pa.Table, whole: bool, homes: int) -> pa.Table:
    """Places of a bucket whose hash also occurs in another document, packed per home.

    ``whole``: 96-bit window hashes; only places outside the smallest document count.
    """
    docs, rows, places = _texts(table)
    if key[0].as_py() < 0:                      # decided by its slice
        return _sent_home(docs, rows, places, homes)
    _, low, high = _extremes(_joined(table, "hashes", np.uint64 if whole else np.uint32),
                             _joined(table, "more", np.uint32) if whole else None, docs)
    keep = docs > low if whole else high > low
    return _sent_home(docs[keep], rows[keep], places[keep], homes)


def _slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        yield from B.slices(batch)


def _homes(docs: DataFrame) -> int:
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return int(min(1 << 24, 1 + total // BUCKET_BYTES))


def _found(blocks: DataFrame, whole: bool, homes: int) -> DataFrame:
    return blocks.groupBy("bucket").applyInArrow(lambda k, t: _shared(k, t, whole, homes), _FOUND)


def repeated_windows(keyed: DataFrame, placed: DataFrame, homes: int, window: int = WINDOW) -> DataFrame:
    """Word positions at which a window starts that a smaller document has too, packed per home.

    ``keyed``: _doc long, _row long, home int, text string; ``placed``: the same rows, spread by home.
    """

    def anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                words = B.words_of(B.texts_of(part.column("text")), B.NOT_SPACE)
                at = anchor_starts(words.first)
                which = np.searchsorted(words.first, at, "right") - 1
                yield from _asked(B.window_hash(words.hash, ANCHOR)[at], None, which, at - words.first[which],
                                  _ids(part.column("_doc")), _ids(part.column("_row")), homes).to_batches()

    def windows(home: pa.Table, found: pa.Table) -> pa.Table:
        places, none = _Places(found), np.zeros(0, np.int64)
        out = [_asked(none.view(np.uint64), none.view(np.uint64), none, none, none, none, homes)]
        for part in _slices(home):
            ids, rows = _ids(part.column("_doc")), _ids(part.column("_row"))
            near = [places.of(d, r) for d, r in zip(ids.tolist(), rows.tolist())]
            some = [k for k, p in enumerate(near) if p is not None]
            if not some:
                continue
            words = B.words_of(B.texts_of(part.column("text").take(pa.array(some))), B.NOT_SPACE, double=True)
            n, marked = np.diff(words.first), []
            for k, p in enumerate(near[i] for i in some):
                # windows that hold the anchor at p start at p - (window - ANCHOR) .. p
                around = np.unique(B.ranges(p - (window - ANCHOR), np.full(len(p), window - ANCHOR + 1)))
                marked.append(around[(around >= 0) & (around <= n[k] - window)] + words.first[k])
            at = np.concatenate(marked)
            which = np.searchsorted(words.first, at, "right") - 1
            out.append(_asked(B.window_hash(words.hash, window)[at], B.window_hash(words.hash2, window, 1)[at], which,
                              at - words.first[which], ids[some], rows[some], homes))
        return pa.concat_tables(out)

    near = _found(keyed.select("_doc", "_row", "text").mapInArrow(anchors, _BLOCK), False, homes)
    blocks = placed.groupBy("home").cogroup(near.groupBy("home")).applyInArrow(windows, _BLOCK)
    return _found(blocks, True, homes)


def _kept(part: pa.RecordBatch, places: _Places, window: int) -> tuple[B.Texts, B.Words, np.ndarray]:
    """The words of a slice and which of them go."""
    texts = B.texts_of(part.column("text"))
    words = B.words_of(texts, B.NOT_SPACE)
    gone, n = np.zeros(len(words.start), bool), np.diff(words.first)
    for k, row in enumerate(zip(_ids(part.column("_doc")).tolist(), _ids(part.column("_row")).tolist())):
        if (p := places.of(*row)) is not None:
            a = int(words.first[k])
            gone[a:a + n[k]] = B.union_of_spans(p, window, int(n[k]))
    return texts, words, gone


def _decided(docs: DataFrame, finish, schema, window: int) -> DataFrame:
    """``finish(slice, texts, words, gone)`` of every slice of ``docs``, as a table."""
    B.prepare(docs.sparkSession)
    homes = _homes(docs)
    # rows that repeat an id and a text are one document: equal ids never remove each other
    keyed = (docs.withColumn("_doc", F.coalesce("doc_id", F.lit(int(NULL_ID)))).withColumn("_row", F.hash("text").cast("long"))
             .withColumn("home", F.pmod(F.xxhash64("_doc"), F.lit(homes)).cast("int")))
    placed = keyed.repartition(homes, "home")
    found = repeated_windows(keyed, placed, homes, window)

    def run(home: pa.Table, where: pa.Table) -> pa.Table:
        places = _Places(where)
        return pa.concat_tables([finish(part, *_kept(part, places, window)) for part in _slices(home)])

    return placed.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(run, schema)


def substring_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by a space."""

    def digest(part: pa.RecordBatch, texts: B.Texts, words: B.Words, gone: np.ndarray) -> pa.Table:
        removed, sums = [], []
        raw, start, end = texts.data.tobytes(), words.start.tolist(), words.end.tolist()
        for k in range(len(texts)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            drop = gone[a:b]
            removed.append(int(drop.sum()))
            left = (np.flatnonzero(~drop) + a).tolist()
            sums.append(hashlib.sha256(b" ".join([raw[start[w]:end[w]] for w in left])).hexdigest())
        return pa.table({"doc_id": part.column("doc_id").cast(pa.int64()),
                         "n_words": pa.array(np.diff(words.first), pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string())})

    return _decided(docs.select("doc_id", "text"), digest,
                    "doc_id long, n_words long, n_removed long, kept_sha256 string", window)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words cut out of their texts (kept words joined by a space)."""
    columns = docs.columns
    inner = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(columns)]      # no clash with our own

    def cut(part: pa.RecordBatch, texts: B.Texts, words: B.Words, gone: np.ndarray) -> pa.Table:
        raw, column = texts.data.tobytes(), part.column("text").to_pylist()
        for k in range(len(texts)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if gone[a:b].any():
                column[k] = b" ".join(raw[words.start[w]:words.end[w]]
                                      for w in (np.flatnonzero(~gone[a:b]) + a).tolist()).decode()
        rest = pa.Table.from_batches([part]).select(inner)
        i = rest.schema.get_field_index("text")
        return rest.set_column(i, rest.schema.field(i), pa.array(column, rest.schema.field(i).type)).rename_columns(
            columns)

    return _decided(docs.toDF(*inner), cut, docs.schema, window)
