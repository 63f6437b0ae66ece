import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from shipwatch.llm import chunks as C
from shipwatch.llm import prefix_trie as P
from tests.llm.helpers import clashing

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=str)


def some_rows(seed=5):
    """Common beginnings, copies of whole conversations, odd ids and turns, ties, repeated rows."""
    r = random.Random(seed)
    say = [("user", f"hello {k} é") for k in range(3)] + [("assistant", "fine"), ("user", ""), (None, None), ("user", None)]
    rows = []
    for c in [*range(60), *range(-7, 0), 2 ** 62, -2 ** 62]:
        for t in range(r.randint(1, 9)):
            role, text = r.choice(say) if r.random() < .8 else ("user", f"only {r.random()}")
            rows.append((c, t * 3 - 2, role, text))
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(6)]
    rows += [(300, None, "user", "b"), (300, None, "user", "a"), (300, 1, "x", "a"), (300, 1, "a", "x"), (301, 4, "a", "x"), (301, 4, "a", "x")]
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("size,counters", [(1 << 16, 1 << 27), (7, 1 << 27), (7, 64), (3, 1 << 15)])
def test_rebuilt_trie_equals_brute_force(spark, monkeypatch, size, counters):
    monkeypatch.setattr(C, "CHUNK_ROWS", size)
    monkeypatch.setattr(P, "MOST_COUNTERS", counters)
    rows = some_rows()
    table = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rebuild(ordered(rows)))
    assert any(len(t) == 0 for t in rebuild(ordered(rows)).values())
    tables = (table.repartition(4), clashing(table).withColumn("kind", F.lit(None)).withColumn("n", F.lit("x"))) if size == 7 else (table.repartition(3),)
    for t in tables:
        assert got(P.trie_report(t)) == expected


@pytest.mark.parametrize("size", [1 << 16, 50])
def test_one_long_conversation_and_one_long_copy(spark, monkeypatch, size):
    monkeypatch.setattr(C, "CHUNK_ROWS", size)
    long = [("user", f"say {k % 7}") for k in range(400)]
    convs = {9: long, 4: long[:300] + [("user", "other")] * 200, 5: long[:2], 6: [], 7: [("a", "b")], 8: long, 1: [("z", "alone")] * 150}
    rows = [(c, k, *turn) for c, turns in convs.items() for k, turn in enumerate(turns)]
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert got(P.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), ids)) == brute(convs)


def test_a_common_first_turn_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 100)
    convs = {c: [("system", "be kind"), ("user", f"q {c % 5}")][:1 + c % 2] for c in range(1500)}
    convs |= {c: [("system", "be kind"), ("user", f"mine {c}"), ("assistant", "yes")] for c in range(1500, 2500)}
    rows = [(c, k, *turn) for c, turns in convs.items() for k, turn in enumerate(turns)]
    assert got(P.trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(convs)


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(P.trie(none)) == [] and got(P.trie_report(none)) == []
    assert got(P.trie_report(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
    assert got(P.trie(none, spark.createDataFrame([(7,), (3,), (3,), (None,)], "conv_id long"))) == brute({7: [], 3: []})


def test_ties_and_repeated_rows_have_one_order(spark):
    rows = [(1, None, "b", "x"), (1, None, "a", "y"), (1, 0, "a", "y"), (2, 0, "a", "y"), (2, 0, "a", "y"), (3, None, "a", "y"), (3, None, "b", "x")]
    one = got(P.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    two = got(P.trie(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1)))
    assert one == two and max(r[1] for r in one) == 3


def test_the_estimate_is_never_under_the_count(monkeypatch):
    r = np.random.default_rng(0)
    for width in (64, 1 << 12, 1 << 15):
        keys = r.integers(-2 ** 62, 2 ** 62, (500, 2))
        rows = keys[r.integers(0, 500, 900)]
        sketches = [P.Sketch(width) for _ in range(3)]
        for s, part in zip(sketches, np.array_split(rows, 3)):
            for some in np.array_split(part, 4):
                s.count(some[:, 0].copy(), some[:, 1].copy())
        two = np.zeros(P.SKETCH_ROWS * (width >> 3), np.uint8)
        for batch in P.add_blocks(iter([s.blocks() for s in sketches])):
            block = np.frombuffer(batch.column("two")[0].as_buffer(), np.uint8)
            at = batch.column("block")[0].as_py()
            two[at:at + len(block)] = block
        alone = P.proven_alone(rows[:, 0].copy(), rows[:, 1].copy(), width, two.reshape(P.SKETCH_ROWS, -1))
        count = defaultdict(int)
        for k in map(tuple, rows.tolist()):
            count[k] += 1
        assert all(count[k] == 1 for k, a in zip(map(tuple, rows.tolist()), alone) if a)
        if width == 1 << 15:
            assert alone.sum() > 0.95 * sum(v == 1 for v in count.values())


def test_only_prefixes_that_may_be_shared_are_exchanged(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(300) for t in range(10)] + [(c, 0, "user", "same") for c in range(1000, 1100)]
    chunks = C.chunked(P.turn_digests(spark.createDataFrame(rows, SCHEMA)), ["conv_id"],
                       [F.col("conv_id"), F.col("turn"), F.col("h1"), F.col("h2")], "test")
    parts = P.split(chunks)
    assert parts.where("kind < 4").count() < 200 and parts.where("kind >= 4").count() >= 290
