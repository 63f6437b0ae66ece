"""Near-duplicates by weighted Jaccard similarity of word-shingle multisets (BagMinHash).

A shingle of weight w owns independent Poisson processes over the dyadic
weight intervals [0, 1), [1, 2), [2, 4), [4, 8) ... up to w, each with its
length as rate. A point has a register, and a place in its interval that it
reaches by halves; in the last, partly filled interval only places below w
count. A register keeps the earliest time of all points that hit it, so two
texts agree in a register with the probability of their weighted Jaccard
similarity. Points are drawn in order of time and stop at the text's latest
register, so a text costs its distinct shingles plus a constant.

Stages: (1) a map makes signatures and drops the texts; (2) texts that are
equal word for word become one node, told by 128 bits of the word sequence
(summed per task first); ids play no part in what is a node; (3) nodes meet in band buckets; buckets with the same members, and buckets
inside another bucket, go once; (4) buckets are cut into blocks of ``BLOCK``
members and every pair of blocks is verified by exact multiset overlap in one
bounded group, which gives at most a spanning forest of links, never all
pairs; (5) connected components.

With 20 bands of 4 registers a pair of similarity 0.8 is missed with a
probability of 3e-5, one of 0.9 with 1e-9.

Words are runs of letters and digits in lower case; shingles have five words
(shorter texts are one shingle). A class is made of texts; its class id is the
smallest doc_id that any of its rows has. Defined cases: rows whose text is
null or has no words are classes of their own; a null doc_id counts as larger
than any other, rows with one are told apart by their texts, and the class id
is null if all its members' are; rows that repeat a doc_id with the same text
are one document; different texts under one id are different documents (two
classes may then have one class id, never one class two texts that no links
join); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from shipwatch.llm import batches as B
from shipwatch.llm.graph import components
from shipwatch.llm.store import settled

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
BLOCK = 256
SALTS = 16
NULL_ID = np.iinfo(np.int64).max

_SIGNED = "doc long, k1 long, k2 long, bands array<long>"


def _words(part: pa.RecordBatch) -> B.Words:
    return B.words_of(B.texts_of(pc.utf8_lower(part.column("text").cast(pa.large_string()))), B.ALNUM, double=True)


def shingles(words: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and the text of each (ascending)."""
    n = np.diff(words.first)
    at = B.window_starts(words.first, SHINGLE)
    long_hash = B.window_hash(words.hash, SHINGLE)[at]
    owner = np.repeat(np.arange(len(n)), np.maximum(n - SHINGLE + 1, 0))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if not len(short):
        return long_hash, owner
    whole = np.array([B.window_hash(words.hash[a:a + k], int(k))[0] for a, k in zip(words.first[short], n[short])], np.uint64)
    owner, h = np.concatenate([owner, short]), np.concatenate([long_hash, whole])
    order = np.argsort(owner, kind="stable")
    return h[order], owner[order]


def bag(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) and how often each stands: owner, shingle, weight."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], h[begin], np.diff(np.concatenate([begin, [len(h)]]))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers (infinite where a text has no shingle)."""
    registers = np.full((n, m), np.inf)
    doc, seed, rate, limit = [], [], [], []
    low, level = 0, 0
    while True:                                 # interval [low, low + length): [0,1) [1,2) [2,4) [4,8) ...
        length = max(low, 1)
        some = weight > low
        if not some.any():
            break
        doc.append(owner[some])
        seed.append(B.mix(shingle[some] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2 ** 64 - 1))))
        rate.append(np.full(int(some.sum()), float(length)))
        limit.append(np.minimum(weight[some] - low, length))
        low, level = low + length, level + 1
    if not doc:
        return registers
    doc, seed, rate, limit = (np.concatenate(x) for x in (doc, seed, rate, limit))
    time, point = np.zeros(len(doc)), 0
    flat = registers.reshape(-1)
    while len(doc):
        point += 1
        r = B.mix(seed + np.uint64((0xD1342543DE82EF95 * point) & (2 ** 64 - 1)))
        s = B.mix(r ^ np.uint64(0xA0761D6478BD642F))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
        at = doc * m + ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        # the place in the interval: its length is a power of two, the low bits choose the halves
        hit = (s & np.uint64(0xFFFFFFFF)) % rate.astype(np.uint64) < limit.astype(np.uint64)
        np.minimum.at(flat, at[hit], time[hit])
        texts, back = np.unique(doc, return_inverse=True)
        go = time < registers[texts].max(axis=1)[back]
        doc, seed, rate, limit, time = doc[go], seed[go], rate[go], limit[go], time[go]
    return registers


def band_hashes(registers: np.ndarray) -> np.ndarray:
    bits = registers.view(np.uint64).reshape(len(registers), BANDS, ROWS)
    out = np.zeros((len(registers), BANDS), np.uint64)
    for j in range(ROWS):
        out = B.mix((out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j]).reshape(-1)).reshape(out.shape)
    return out


def text_keys(words: B.Words, has: np.ndarray) -> list[np.ndarray]:
    """128 bits of the word sequence of the texts ``has``."""
    keys = []
    for which, h in enumerate((words.hash, words.hash2)):
        up, down = B._WORD_POWERS[which].take(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:len(h)], out=total[1:])
        a, b = words.first[:-1][has], words.first[1:][has]
        keys.append(B.signed(B.mix((total[b] - total[a]) * down[a])))
    return keys


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text key ``k1``, ``k2`` (null: no words) and ``doc``, the id with null as ``NULL_ID``.

    Columns of ``docs`` with these names must not be there.
    """
    B.prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                words = _words(part)
                none = np.diff(words.first) == 0
                k1, k2 = text_keys(words, np.arange(part.num_rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(k1, mask=none), pa.array(k2, mask=none)],
                                                 names=[*part.schema.names, "k1", "k2"])

    rows = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))))
    schema = StructType([*rows.schema.fields, StructField("k1", LongType()), StructField("k2", LongType())])
    return rows.mapInArrow(B.released(run), schema)


def signed(docs: DataFrame) -> DataFrame:
    """(doc, k1, k2, bands) of every row: the text key and the band hashes, null without words."""
    B.prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                words = _words(part)
                n = len(words.first) - 1
                none = np.diff(words.first) == 0
                bands = band_hashes(signatures(*bag(*shingles(words)), n))
                keys = [pa.array(k, mask=none) for k in text_keys(words, np.arange(n))]
                ids = np.asarray(part.column("doc_id").cast(pa.int64()).fill_null(int(NULL_ID)), np.int64)
                bands[none] = 0
                flat = pa.array(B.signed(np.ascontiguousarray(bands[~none]).reshape(-1)))
                offsets = np.concatenate([[0], np.cumsum(~none)]) * BANDS
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *keys, lists], names=["doc", "k1", "k2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(B.released(run), _SIGNED)


def buckets(nodes: DataFrame) -> DataFrame:
    """(gid, size, node): the members of every bucket that is neither repeated nor inside another."""
    rows = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    made = (rows.groupBy("band", "h").agg(F.count("*").alias("size"), F.min("node").alias("low"),
                                          F.bit_xor(F.xxhash64("node")).alias("print"))
            .where("size > 1"))
    once = made.groupBy("size", "low", "print").agg(F.min(F.struct("band", "h")).alias("b")).select(
        "size", F.xxhash64("b.band", "b.h", "low", "print").alias("gid"), F.col("b.band").alias("band"), F.col("b.h").alias("h"))
    members = settled(rows.join(once, ["band", "h"]).select("gid", "size", "node"), "near-members")
    home = members.groupBy("node").agg(F.max(F.struct("size", "gid")).alias("home")).select("node", F.col("home.gid").alias("home"))
    inside = (members.join(home, "node").groupBy("gid").agg(F.min("home").alias("x"), F.max("home").alias("y"))
              .where("x = y and x <> gid").select("gid"))
    return settled(members.join(inside, "gid", "left_anti"), "near-buckets")


def _overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i, how many elements it shares with every set (element hashes, without repeats)."""
    size = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    owners = owner[order]
    count = np.bincount(ids)
    begin = np.cumsum(count) - count
    at = np.cumsum([0, *size])
    for i in range(len(sets)):
        mine = ids[at[i]:at[i + 1]]
        mine = mine[count[mine] > 1]
        yield i, np.bincount(owners[B.ranges(begin[mine], count[mine])], minlength=len(sets))


def links(nodes: list[int], sets: list[np.ndarray], left: list[bool], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (one of them on the left) of at least this similarity."""
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size, side, out = np.array([len(s) for s in sets]), np.array(left), []
    for i, common in _overlaps(sets):
        near = common >= similarity * (size + size[i] - common) - 1e-9
        near[:i + 1] = False
        if not side[i]:
            near &= side
        for j in np.flatnonzero(near).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((nodes[i], nodes[j]))
    return out


def verified(members: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that join all members whose texts have at least this weighted Jaccard similarity.

    ``members``: gid, size, node. ``nodes``: node, k1, k2. ``docs``: doc_id, text.
    """
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                owner, h, w = bag(*shingles(_words(part)))
                # an element per occurrence: equal multisets have equal elements
                k = np.repeat(np.arange(len(h)), w)
                nth = np.arange(len(k)) - np.repeat(np.cumsum(w) - w, w)
                e = B.mix(h[k] + nth.astype(np.uint64))
                cut = np.searchsorted(owner[k], np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([e[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["node", "elements"])

    wanted = members.select("node").distinct().join(nodes.select("node", "k1", "k2"), "node")
    # one text of each key; copies go in the task that reads them
    once = keyed(docs.select("doc_id", "text")).where("k1 is not null").groupBy("k1", "k2").agg(F.min("text").alias("text"))
    texts = once.join(wanted.hint("merge"), ["k1", "k2"]).select("node", "text")
    elements = texts.mapInArrow(B.released(sets), "node long, elements binary")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (members.withColumn("n", blocks).withColumn("own", F.pmod(F.xxhash64("node", "gid"), F.col("n")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .select("gid", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                      (F.col("own") <= F.col("other")).alias("left")))
    rows = placed.hint("merge").join(elements, "node").repartition("gid", "x", "y").sortWithinPartitions("gid", "x", "y")

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def close() -> None:
            if len(group) > 1:
                out.extend(links([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], similarity))

        def rows_of(batch: pa.RecordBatch):
            return zip(*(batch.column(c).to_pylist() for c in ("gid", "x", "y", "node", "left", "elements")))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()),
                                               pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])
        for batch in it:
            for gid, x, y, node, left, e in rows_of(batch):
                if (gid, x, y) != key:
                    close()
                    key, group = (gid, x, y), []
                group.append((node, np.unique(np.frombuffer(e, np.uint64)), left))
            yield table()
            out.clear()
        close()
        yield table()

    return rows.mapInArrow(B.released(pairs), "a long, b long")


def _rooted(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc, k1, k2) of every row, and (k1, k2, node, low, copies, root) of every different text."""
    made = settled(signed(docs), "near-signed")
    grouped = made.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("doc").alias("low"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # numbers given once and written: a node is a text, whatever ids it stands under
    nodes = settled(grouped.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    roots = settled(components(verified(buckets(nodes), nodes, docs, similarity)), "near-roots")
    rooted = nodes.select("node", "k1", "k2", "low", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return made.select("doc", "k1", "k2"), settled(rooted, "near-rooted")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) per row of ``docs``: the smallest id that links of near-duplicates lead to."""
    B.prepare(docs.sparkSession)
    rows, texts = _rooted(docs, similarity)
    lows = texts.groupBy("root").agg(F.min("low").alias("class"))
    # rows ask only where the answer is not their own id; a text with many rows is spread over the salts
    asked = (texts.join(lows, "root").where("copies > 1 or class <> low").select("k1", "k2", "class")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    told = (rows.withColumn("salt", F.pmod(F.xxhash64("doc", F.spark_partition_id()), F.lit(SALTS)).cast("int"))
            .join(asked, ["k1", "k2", "salt"], "left"))
    null = F.lit(int(NULL_ID))
    return told.select(F.nullif("doc", null).alias("doc_id"), F.nullif(F.coalesce("class", "doc"), null).alias("class_id"))


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: one with the class's smallest id, of its text with the smallest key among several.

    Rows without words are classes of their own and all stay.
    """
    columns = docs.columns
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("given"))
    _, texts = _rooted(docs, similarity)
    kept = texts.groupBy("root").agg(F.min(F.struct("low", "k1", "k2")).alias("x")).select(F.col("x.low").alias("doc"), "x.k1", "x.k2")
    tagged = keyed(inner).drop("doc_id", "text")
    # rows that repeat an id and a text are one document: the copies of a task go before the exchange
    once = tagged.where("k1 is not null").dropDuplicates(["doc", "k1", "k2"]).join(kept.hint("merge"), ["doc", "k1", "k2"], "left_semi")
    return once.select("given.*").unionByName(tagged.where("k1 is null").select("given.*"))
