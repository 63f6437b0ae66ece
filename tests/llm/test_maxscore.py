import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from shipwatch.llm import maxscore as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if is_query(i):
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def table(seed, n, width=16, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, spread, (5, width))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 5] * 0.1 + r.normal(0, 0.1, width)], 0) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = table(1, 260)
    out += [(1000 + i, out[7][1], 0) for i in range(30)]                 # equal vectors: ties
    out += [(2000, None, 0), (2001, [], 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None], 0), (2004, [float("inf")], 0),
            (2010, [0.5, 0.25], 0), (2020, [0.0] * 16, 0), (None, out[3][1], 0), (2030, [-3000.0] * 16, None)]
    return out


@pytest.mark.parametrize(("shard", "block"), [(4096, 512), (40, 7)])
def test_top_k_equals_brute_force(spark, rows, shard, block, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", shard)
    monkeypatch.setattr(M, "BLOCK_ROWS", block)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("score", F.lit("y")).withColumn(
        "shard", F.lit(1)).withColumn("q", F.lit(2))
    got = {tuple(r) for r in M.top_k(frame, F.col("vec_id") % 10 == 0).collect()}
    assert got == brute(rows, lambda i: i % 10 == 0)


def test_fewer_rows_than_k(spark):
    frame = spark.createDataFrame([(0, [1.0], 0), (50, [2.0], 0), (3, [0.5], 0)], SCHEMA)
    got = {tuple(r) for r in M.top_k(frame, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1, 50, 131072), (0, 2, 3, 32768), (50, 1, 0, 131072), (50, 2, 3, 65536)}


def test_empty_table(spark):
    assert M.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_spare_work():
    r = np.random.default_rng(2)
    rows = r.normal(0, 20, (4000, 64)).astype(np.int64)
    rows[::400] = rows[0] + r.integers(-2, 3, (10, 64))
    ids = np.arange(4000)
    found, scores, finished = M.search_shard(ids, rows, 0, rows[0], 5)
    all_scores = rows @ rows[0]
    order = sorted((-s, i) for i, s in zip(ids.tolist(), all_scores.tolist()) if i != 0)[:5]
    assert list(zip((-scores).tolist(), found.tolist())) == order
    assert finished < 2000                  # most rows are given up before their last term


def test_repeated_query_ids_do_not_crash(spark):
    frame = spark.createDataFrame([(0, [1.0], 0), (0, [2.0], 0), (1, [3.0], 0)], SCHEMA)
    got = M.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    assert {r.vec_id for r in got} == {1}
