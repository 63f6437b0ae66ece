"""The trie of conversation prefixes, with count-min screening of prefix digests.

A node is a distinct sequence of first d turns (role, text); its members are
the conversations that begin with it. Per node: smallest member, members,
children, leaves and saved tokens of its subtree, and its ends (the members of
exactly d turns).

1. A turn becomes a 128-bit digest of role and text, and the bytes of its text;
   texts go no further. The turns are put in order (``chunks``), and every
   prefix gets a 128-bit digest: a polynomial in the digests of its turns, so a
   conversation of any length is walked by many tasks.
2. Screening: each task counts its prefix digests in a count-min sketch of
   counters that stop at two; the sketches are added, and the counters that
   reached two are broadcast. A prefix with a counter at one has one member
   only, which is a proof; all longer prefixes of that conversation are then
   alone too. Such a tail is a chain of nodes whose figures are known at once:
   it is emitted on the spot.
3. Only prefixes that may be shared are exchanged: grouped exactly by digest
   (summed per task first, so common first turns cost little), and met with
   their group's smallest member and size. The groups that hold over a
   thousandth of these rows, a thousand at most, go by broadcast.
4. Each conversation is walked from its last shared prefix up. A node's weight
   ((members - 1) times the bytes of its last text) belongs to its smallest
   member, so that what the subtree of a prefix sums to is the sum over its
   members of what each of them owns further down.
5. Ends are sorted by node and id, hashed where a node lies in one chunk, and
   piece by piece (65,536 ids a row) where it goes on over several.

The sketch has four counters a prefix up to ``MOST_COUNTERS`` a row (32 MB of
bits in all). Beyond some hundred million turns it proves fewer prefixes alone:
more rows are exchanged, the result stays the same.

Defined cases: turns follow ``turn``, nulls first; turns with one number follow
each other by digest, repeated rows all count; null role or text is empty; rows
with a null conv_id belong to no conversation; a conversation without turns is
a member and an end of the root; extra columns are ignored; without any
conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from shipwatch.llm import batches as B
from shipwatch.llm.chunks import chunked, rows_of, run_begins
from shipwatch.llm.store import settled

MOST_COUNTERS = 1 << 27
SKETCH_ROWS = 2
_BLOCK = 1 << 15                        # bytes of one row of the sketch that travel together
_ALONE, _ALONE_END = 4, 5               # a stretch of prefixes with one member: g1 is its last depth
_NONE = hashlib.sha256(b"").hexdigest()
_SHARED = "conv_id long, depth long, g1 long, g2 long, bytes long, kind int"


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, bytes) of every turn of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))

    def half(at: int) -> Column:
        return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")

    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", half(1).alias("h1"),
                                                     half(17).alias("h2"), F.octet_length(text).cast("long").alias("bytes"))


# ---------------------------------------------------------------- prefixes in order

class Walk:
    """What the chunks before one hand over: (turns, digest, digest) of a conversation that goes on in it."""

    def __init__(self, chunks: DataFrame):
        def summary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for (part, seq), c in rows_of(batch):
                    conv = np.asarray(c["conv_id"])
                    begins = run_begins(conv)
                    d = _local(c, begins)
                    last = [int(x[-1]) for x in d]
                    yield pa.RecordBatch.from_pylist([dict(part=part, seq=seq, first=int(conv[0]), last=int(conv[-1]), runs=len(begins),
                                                           rows=len(conv), n=last[0], d1=_signed(last[1]), d2=_signed(last[2]))])

        got = chunks.mapInArrow(summary, "part long, seq long, first long, last long, runs long, rows long, n long, d1 long, d2 long").collect()
        self.order = [(r.part, r.seq) for r in sorted(got)]
        self.rows = sum(r.rows for r in got)
        self.before: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.goes_on: set[tuple[int, int]] = set()
        state, key, at = (0, 0, 0), None, None
        for r in sorted(got):
            now = (r.part, r.seq)
            if key == r.first and at is not None:
                self.before[now] = state
                self.goes_on.add(at)
            else:
                state = (0, 0, 0)
            here = (r.n, r.d1, r.d2)
            state = _joined(state, here) if r.runs == 1 else here
            key, at = r.last, now


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _joined(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The prefix of a's turns followed by b's."""
    return (a[0] + b[0], *(_signed((x + pow(p.base, a[0], 1 << 64) * y) % (1 << 64)) for x, y, p in zip(a[1:], b[1:], B._WORD_POWERS)))


def _local(c: dict[str, pa.Array], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turn numbers and prefix digests, counted from where a conversation begins in the chunk."""
    n = len(c["conv_id"])
    start = np.zeros(n, np.int64)
    start[begins] = begins
    start = np.maximum.accumulate(start)
    place = np.arange(n) - start
    out = [place + 1]
    for name, powers in zip(("h1", "h2"), B._WORD_POWERS):
        up, _ = powers.take(n + 1)
        total = np.zeros(n + 1, B.U64)
        np.cumsum(np.asarray(c[name]).view(B.U64) * up[place], out=total[1:])
        out.append(total[1:] - total[start])
    return tuple(out)


def prefixes(at: tuple[int, int], c: dict[str, pa.Array], before: dict, goes_on: set):
    """(conv, depth, g1, g2, bytes, is the last turn) of the rows of a chunk."""
    conv = np.asarray(c["conv_id"])
    begins = run_begins(conv)
    depth, d1, d2 = _local(c, begins)
    if at in before:
        n, *carried = before[at]
        stop = begins[1] if len(begins) > 1 else len(conv)
        depth[:stop] += n
        for d, x, p in zip((d1, d2), carried, B._WORD_POWERS):
            d[:stop] = B.U64(x % (1 << 64)) + B.U64(pow(p.base, n, 1 << 64)) * d[:stop]
    last = np.zeros(len(conv), bool)
    last[begins[1:] - 1] = True
    last[-1] = at not in goes_on
    g1, g2 = (B.signed(B.mix(d + B.mix(depth.astype(B.U64)))) for d in (d1, d2))
    return conv, depth, g1, g2, np.asarray(c["bytes"]), last


# ---------------------------------------------------------------- count-min sketch

def _places(g1: np.ndarray, g2: np.ndarray, width: int) -> list[np.ndarray]:
    a, b = g1.view(B.U64), g2.view(B.U64)
    return [((a ^ B.mix(b + B.U64(k))) & B.U64(width - 1)).astype(np.int64) for k in range(SKETCH_ROWS)]


def sketch_width(prefixes_: int) -> int:
    return min(max(1 << 15, 1 << (4 * max(prefixes_, 1) - 1).bit_length()), MOST_COUNTERS)


def _set(plane: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(plane, places >> 3, (1 << (places & 7)).astype(np.uint8))


def _bits(plane: np.ndarray, places: np.ndarray) -> np.ndarray:
    return plane[places >> 3] >> (places & 7).astype(np.uint8) & 1 == 1


class Sketch:
    """Counters that stop at two, as two planes of bits: at least one, at least two."""

    def __init__(self, width: int):
        self.width = width
        self.one = np.zeros((SKETCH_ROWS, width >> 3), np.uint8)
        self.two = np.zeros((SKETCH_ROWS, width >> 3), np.uint8)

    def count(self, g1: np.ndarray, g2: np.ndarray) -> None:
        for k, p in enumerate(_places(g1, g2, self.width)):
            p, n = np.unique(p, return_counts=True)
            _set(self.two[k], p[(n > 1) | _bits(self.one[k], p)])
            _set(self.one[k], p)

    def blocks(self) -> pa.RecordBatch:
        size = min(_BLOCK, self.width >> 3)
        keys, one, two = [], [], []
        for k in range(SKETCH_ROWS):
            for b in range(0, self.width >> 3, size):
                if self.one[k, b:b + size].any():
                    keys.append(k * (self.width >> 3) + b)
                    one.append(self.one[k, b:b + size].tobytes())
                    two.append(self.two[k, b:b + size].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(one, pa.binary()), pa.array(two, pa.binary())],
                                          names=["block", "one", "two"])


def add_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of sketches, block by block as they arrive."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in it:
        for key, one, two in zip(batch.column("block").to_pylist(), batch.column("one"), batch.column("two")):
            one, two = (np.frombuffer(x.as_buffer(), np.uint8) for x in (one, two))
            if key in held:
                held[key][1] |= two | (held[key][0] & one)
                held[key][0] |= one
            else:
                held[key] = [one.copy(), two.copy()]
    for key, (one, two) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([one.tobytes()], pa.binary()),
                                          pa.array([two.tobytes()], pa.binary())], names=["block", "one", "two"])


def screened(chunks: DataFrame, walk: Walk) -> tuple[int, np.ndarray]:
    """The width of the sketch of all prefixes and its plane of counters at two."""
    width = sketch_width(walk.rows)
    before, goes_on = walk.before, walk.goes_on

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, empty = Sketch(width), True
        for batch in it:
            for at, c in rows_of(batch):
                _, _, g1, g2, _, _ = prefixes(at, c, before, goes_on)
                sketch.count(g1, g2)
                empty = False
        if not empty:
            yield sketch.blocks()

    schema = "block long, one binary, two binary"
    parts = max(1, min(64, SKETCH_ROWS * (width >> 3) // _BLOCK))
    got = chunks.mapInArrow(build, schema).repartition(parts, "block").mapInArrow(add_blocks, schema).select("block", "two").collect()
    two = np.zeros(SKETCH_ROWS * (width >> 3), np.uint8)
    for r in got:
        two[r.block:r.block + len(r.two)] = np.frombuffer(r.two, np.uint8)
    return width, two.reshape(SKETCH_ROWS, -1)


def proven_alone(g1: np.ndarray, g2: np.ndarray, width: int, two: np.ndarray) -> np.ndarray:
    """Whether the estimate of a prefix is one, which is never less than its count."""
    out = np.zeros(len(g1), bool)
    for k, p in enumerate(_places(g1, g2, width)):
        out |= ~_bits(two[k], p)
    return out


# ---------------------------------------------------------------- tails and shared prefixes

def split(chunks: DataFrame) -> DataFrame:
    """Prefixes that may be shared, and the stretches that are not (``_SHARED``).

    kind of a prefix that may be shared: 0 the next one may be too, 1 the
    conversation ends, 2 the next one is alone, 3 it is alone and the last.
    """
    walk = Walk(chunks)
    sc = chunks.sparkSession.sparkContext
    width, two = screened(chunks, walk)
    sent = sc.broadcast((walk.before, walk.goes_on, width, two))

    def proofs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, goes_on, width, two = sent.value
        for batch in it:
            for at, c in rows_of(batch):
                if at in before or at in goes_on:
                    conv, _, g1, g2, _, last = prefixes(at, c, before, goes_on)
                    alone, begins = proven_alone(g1, g2, width, two), run_begins(conv)
                    yield pa.RecordBatch.from_pylist([dict(
                        part=at[0], seq=at[1], runs=len(begins), first=bool(alone[0]), ends=bool(last[0]),
                        head=bool(alone[:begins[1] if len(begins) > 1 else None].any()), tail=bool(alone[begins[-1]:].any()))])

    got = {(r.part, r.seq): r for r in chunks.mapInArrow(
        proofs, "part long, seq long, runs long, first boolean, ends boolean, head boolean, tail boolean").collect()}
    alone_before: set[tuple[int, int]] = set()          # chunks that a conversation enters which is alone already
    follows: dict[tuple[int, int], tuple[bool, bool]] = {}
    alone = False
    for at, after in zip(walk.order, [*walk.order[1:], None]):
        if at in got:
            r = got[at]
            if at in walk.before and alone:
                alone_before.add(at)
            alone = r.tail or (r.runs == 1 and at in alone_before)
            if at in walk.goes_on:
                follows[at] = (alone or got[after].first, got[after].ends)
    carried = sc.broadcast((alone_before, follows))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, goes_on, width, two = sent.value
        alone_before, follows = carried.value
        for batch in it:
            for at, c in rows_of(batch):
                conv, depth, g1, g2, size, last = prefixes(at, c, before, goes_on)
                begins = run_begins(conv)
                ends = np.append(begins[1:], len(conv))
                alone = proven_alone(g1, g2, width, two)
                if at in alone_before:
                    alone[0] = True
                seen = np.cumsum(alone)                                 # within a conversation, alone from the first proof on
                alone = seen - np.repeat((seen - alone)[begins], ends - begins) > 0
                next_alone, next_last = np.append(alone[1:], False), np.append(last[1:], False)
                next_alone[-1], next_last[-1] = follows.get(at, (False, False))
                kind = np.where(last, 1, np.where(next_alone, np.where(next_last, 3, 2), 0))
                shared = np.flatnonzero(~alone)
                yield _batch(conv[shared], depth[shared], g1[shared], g2[shared], size[shared], kind[shared])
                # the first node of a tail hangs on a prefix that may be shared, or on the root at depth one
                has = np.add.reduceat(alone, begins) > 0
                first = ends - np.add.reduceat(alone, begins)
                entered = np.zeros(len(begins), bool)
                entered[0] = at in alone_before
                head = (first > begins) | (~entered & (depth[np.minimum(first, len(conv) - 1)] > 1))
                first = first + head
                some = has & (first < ends)
                first, stop = first[some], ends[some] - 1
                yield _batch(conv[first], depth[first], depth[stop], depth[stop], size[first], np.where(last[stop], _ALONE_END, _ALONE))

    return settled(chunks.mapInArrow(rows, _SHARED), "trie-prefixes")


def _batch(conv, depth, g1, g2, size, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(np.asarray(x), pa.int64()) for x in (conv, depth, g1, g2, size)],
                                       pa.array(np.asarray(kind), pa.int32())], names=["conv_id", "depth", "g1", "g2", "bytes", "kind"])


def grouped(shared: DataFrame) -> DataFrame:
    """The rows of ``shared`` with their node's smallest member, members and ends."""
    nodes = settled(shared.groupBy("g1", "g2").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.sum((F.col("kind") == 1).cast("long")).alias("n_ends")), "trie-nodes")
    most = shared.count() // 1000
    large = nodes.where(F.col("n") > most)              # at most a thousand nodes
    keys = ["g1", "g2"]
    hot = shared.join(F.broadcast(large), keys)
    rest = shared.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(nodes.where(F.col("n") <= most), keys)
    return settled(hot.unionByName(rest), "trie-grouped")


# ---------------------------------------------------------------- sums over subtrees

def subtree_sums(rows: DataFrame) -> DataFrame:
    """Per row of ``grouped``: what its conversation owns from there down, and the parent of the node below.

    Walks every conversation from its deepest row to its first. A row whose
    conversation is its node's smallest member owns the node.
    """
    owns = F.col("conv_id") == F.col("rep")
    leaf = (F.col("kind") >= 2) | ((F.col("kind") == 1) & owns & (F.col("n") == F.col("n_ends")))
    narrow = rows.select("conv_id", "depth", "g1", "g2", "rep", "n", "kind", F.when(owns, (F.col("n") - 1) * F.col("bytes"))
                         .otherwise(0).alias("weight"), leaf.cast("long").alias("leaf"), owns.cast("long").alias("owns"))
    chunks = chunked(narrow, ["conv_id"], [F.col("conv_id"), F.col("depth").desc()], "trie-walk")

    def summary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for (part, seq), c in rows_of(batch):
                conv = np.asarray(c["conv_id"])
                begins = run_begins(conv)
                at = begins[-1]
                yield pa.RecordBatch.from_pylist([dict(
                    part=part, seq=seq, first=int(conv[0]), last=int(conv[-1]), runs=len(begins), weight=int(np.asarray(c["weight"])[at:].sum()),
                    leaf=int(np.asarray(c["leaf"])[at:].sum()), owns=int(c["owns"][-1].as_py()), g1=c["g1"][-1].as_py(), g2=c["g2"][-1].as_py())])

    got = chunks.mapInArrow(summary, "part long, seq long, first long, last long, runs long, weight long, leaf long, owns long, g1 long, g2 long").collect()
    carried, state, key = {}, None, None
    for r in sorted(got):
        on = key == r.first and state is not None
        if on:
            carried[(r.part, r.seq)] = state
        plus = state if on and r.runs == 1 else (0, 0)
        state, key = (plus[0] + r.weight, plus[1] + r.leaf, r.owns, r.g1, r.g2), r.last
    sent = rows.sparkSession.sparkContext.broadcast(carried)

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "g1", "g2", "rep", "n", "kind", "saved", "leaves", "owned_below", "b1", "b2"]
        for batch in it:
            for at, c in rows_of(batch):
                conv = np.asarray(c["conv_id"])
                begins = run_begins(conv)
                lengths = np.diff(np.append(begins, len(conv)))
                out = []
                for name in ("weight", "leaf"):
                    total = np.cumsum(np.asarray(c[name]))
                    out.append(total - np.repeat((total - np.asarray(c[name]))[begins], lengths))
                below = [np.concatenate([[0], np.asarray(c[name])[:-1]]) for name in ("owns", "g1", "g2")]
                for b in below:
                    b[begins] = 0
                if at in sent.value:
                    weight, leaf, *row = sent.value[at]
                    out[0][:lengths[0]] += weight
                    out[1][:lengths[0]] += leaf
                    for b, v in zip(below, row):
                        b[0] = v
                yield pa.RecordBatch.from_arrays([*[c[n] for n in names[:7]], *[pa.array(x, pa.int64()) for x in out + below]], names=names)

    return chunks.mapInArrow(walk, "conv_id long, depth long, g1 long, g2 long, rep long, n long, kind int, saved long, leaves long, "
                                   "owned_below long, b1 long, b2 long")


# ---------------------------------------------------------------- ends

def end_digests(ends: DataFrame) -> DataFrame:
    """(g1, g2, ends_sha256) from (g1, g2, conv_id): the ids in order, comma-joined, hashed."""
    order = ["g1", "g2", "conv_id"]
    chunks = chunked(ends.select(*order), ["g1", "g2"], [F.col(c) for c in order], "trie-ends")

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole nodes hashed; the first and last node of a chunk may go on in others and stay text."""
        for batch in it:
            for (part, seq), c in rows_of(batch):
                g1, g2, ids = (np.asarray(c[n]) for n in order)
                begins = run_begins(g1, g2).tolist()
                text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(begins, [*begins[1:], len(ids)])]
                edge = [k in (0, len(text) - 1) for k in range(len(text))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(g1[begins]), pa.array(g2[begins]), pa.array([part] * len(text), pa.int32()), pa.array([seq] * len(text), pa.int32()),
                    pa.array([t if e else None for t, e in zip(text, edge)], pa.string()),
                    pa.array([None if e else hashlib.sha256(t.encode()).hexdigest() for t, e in zip(text, edge)], pa.string())],
                    names=["g1", "g2", "part", "seq", "piece", "ends_sha256"])

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(g1=key[0], g2=key[1], ends_sha256=state.hexdigest())])

        for batch in it:
            for a, b, piece in zip(*[batch.column(n).to_pylist() for n in ("g1", "g2", "piece")]):
                if key == (a, b):
                    state.update(b"," + piece.encode())
                else:
                    if key:
                        yield done()
                    key, state = (a, b), hashlib.sha256(piece.encode())
        if key:
            yield done()

    found = settled(chunks.mapInArrow(pieces, "g1 long, g2 long, part int, seq int, piece string, ends_sha256 string"), "trie-end-pieces")
    order = ["g1", "g2", "part", "seq"]
    whole = found.where("piece is not null").select(*order, "piece").repartition("g1", "g2").sortWithinPartitions(*order).mapInArrow(
        joined, "g1 long, g2 long, ends_sha256 string")
    return found.where("piece is null").select("g1", "g2", "ends_sha256").unionByName(whole)


# ---------------------------------------------------------------- the trie

def trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, turn, role, text).

    ``conversations`` (conv_id) names conversations that may have no turns.
    """
    B.prepare(turns.sparkSession)
    digests = turn_digests(turns)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    chunks = chunked(settled(digests, "trie-turns"), ["conv_id"], order, "trie-chunks")
    ids = chunks.select(F.explode(F.array_distinct("conv_id")).alias("conv_id"), F.lit(1).alias("turns"))
    if conversations is not None:
        ids = ids.unionByName(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).alias("turns")))
    ids = settled(ids.groupBy("conv_id").agg(F.max("turns").alias("turns")), "trie-conversations")
    members = ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).first()
    prefixes_ = split(chunks)
    shared, alone = prefixes_.where(F.col("kind") < _ALONE), prefixes_.where(F.col("kind") >= _ALONE)
    walked = settled(subtree_sums(grouped(shared)), "trie-sums")
    ends = end_digests(shared.where("kind = 1").select("g1", "g2", "conv_id").unionByName(
        ids.where("turns = 0").select(F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), "conv_id")))
    low, null = F.lit(members.low).cast("long"), F.lit(None).cast("long")
    own = walked.select("g1", "g2", "rep", "n", "depth", "saved", "leaves", ((F.col("owned_below") == 1) | (F.col("kind") >= 2)).cast("long").alias("children"),
                        F.when(F.col("depth") == 1, low).alias("parent"), F.lit(None).cast("string").alias("ends_sha256"))
    below = walked.where("owned_below = 1").select(F.col("b1").alias("g1"), F.col("b2").alias("g2"), F.col("rep").alias("parent"))
    facts = own.unionByName(below, allowMissingColumns=True).unionByName(ends.where("g1 <> 0 or g2 <> 0"), allowMissingColumns=True)
    nodes = facts.groupBy("g1", "g2").agg(
        F.max("rep").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.lit(_NONE)).alias("ends_sha256")).drop("g1", "g2")

    def single(depth: Column, parent: Column, more: Column) -> list[Column]:
        one = F.lit(1).cast("long")
        return [F.col("conv_id"), depth.cast("long").alias("depth"), parent.cast("long").alias("parent_conv_id"), one.alias("n_convs"),
                more.cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                F.when(more, F.lit(_NONE)).otherwise(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends_sha256")]

    heads = walked.where("kind >= 2").select(*single(F.col("depth") + 1, F.col("rep"), F.col("kind") == 2))
    tails = alone.select("conv_id", "kind", F.col("g1").alias("stop"), F.explode(F.sequence("depth", "g1")).alias("at")).select(
        *single(F.col("at"), F.when(F.col("at") == 1, low).otherwise(F.col("conv_id")), (F.col("at") < F.col("stop")) | (F.col("kind") == _ALONE)))
    # the root: every conversation; its children are the nodes of depth one
    top = walked.where("depth = 1").select(
        F.when(F.col("conv_id") == F.col("rep"), 1).otherwise(0).cast("long").alias("children"), "leaves", "saved").unionByName(
        alone.where("depth = 1").select(F.lit(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    root_ends = ends.where("g1 = 0 and g2 = 0").select("ends_sha256")
    root = top.unionByName(root_ends, allowMissingColumns=True).agg(
        F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(_NONE)).alias("ends_sha256")).select(
        low.alias("conv_id"), F.lit(0).cast("long").alias("depth"), null.alias("parent_conv_id"), F.lit(members.n).cast("long").alias("n_convs"),
        "n_children", F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens", "ends_sha256").where(F.lit(members.n > 0))
    return nodes.unionByName(heads).unionByName(tails).unionByName(root)


# ---------------------------------------------------------------- stand-in input

def kept_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with turns numbered from 1 in the order of turn (nulls first), role and text."""
    empty = F.lit("")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    chunks = chunked(rows, ["conv_id"], order, "trie-numbered").drop("turn")

    def summary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for (part, seq), c in rows_of(batch):
                conv = np.asarray(c["conv_id"])
                begins = run_begins(conv)
                yield pa.RecordBatch.from_pylist([dict(part=part, seq=seq, first=int(conv[0]), last=int(conv[-1]),
                                                       runs=len(begins), n=int(len(conv) - begins[-1]))])

    carried, n, key = {}, 0, None
    for r in sorted(chunks.select("part", "seq", "conv_id").mapInArrow(summary, "part long, seq long, first long, last long, runs long, n long").collect()):
        if key == r.first:
            carried[(r.part, r.seq)] = n
        n, key = (n if key == r.first and r.runs == 1 else 0) + r.n, r.last

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, c in rows_of(batch):
                conv = np.asarray(c["conv_id"])
                begins = run_begins(conv)
                lengths = np.diff(np.append(begins, len(conv)))
                turn = np.arange(1, len(conv) + 1) - np.repeat(begins, lengths)
                turn[:lengths[0]] += carried.get(at, 0)
                yield pa.RecordBatch.from_arrays([c["conv_id"], pa.array(turn, pa.int64()), c["role"], c["text"]], names=["conv_id", "turn", "role", "text"])

    return chunks.mapInArrow(number, "conv_id long, turn long, role string, text string")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stand-in input: turns of conversations that share their beginnings, and the ids of all of them.

    Conversation c begins with the first h turns of conversation c - c % 5 and
    goes on with its own turns after its first h; h = crc32(c) % 9.
    """
    turns = numbered(conversations)
    ids = settled(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), "trie-ids")
    own = turns.where(F.col("turn") > kept_turns(F.col("conv_id")))
    first = turns.where((F.col("conv_id") % 5 == 0) & (F.col("turn") <= 8)).withColumnRenamed("conv_id", "base")
    taken = first.join(ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5), "base").where(F.col("turn") <= kept_turns(F.col("conv_id")))
    return own.unionByName(taken.select(*own.columns)), ids


def trie_report(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(conversations))
