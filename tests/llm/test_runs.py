import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shipwatch.llm import runs as R
from tests.llm.helpers import clashing, docs, words


def brute(w):
    """All runs by trying every period at every word."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(
                    all(w[x] == w[x + r] for x in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def loop(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def expected(doc_id, text):
    w = loop(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute(w)
    gone = {k for x, n, q in runs for k in range(x + q, x + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "".join(f"{x},{n},{q}\n" for x, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4), *sha)


def found(texts):
    return R.slice_runs(R.B.texts_of(pa.array(texts)))[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_runs_equal_brute_force(texts):
    assert found([" ".join(t) for t in texts]) == [brute(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 30), st.integers(0, 5)), max_size=6), st.integers(0, 99))
def test_planted_loops_equal_brute_force(parts, seed):
    r, w = random.Random(seed), []
    for period, length, noise in parts:
        unit = [r.choice("uvw") for _ in range(period)]
        w += [unit[k % period] for k in range(length)] + [r.choice("xyz") for _ in range(noise)]
    assert found([" ".join(w)]) == [brute(w)]


def test_ordered_sets_in_blocks(monkeypatch):
    monkeypatch.setattr(R, "_PLAIN", 8)
    r = random.Random(1)
    for _ in range(60):
        every = r.sample(range(400), r.randint(2, 200))
        cut = r.randint(1, len(every) - 1)
        x, y = sorted(every[:cut]), sorted(every[cut:])
        small, large = (x, y) if len(x) < len(y) else (y, x)
        wide = R.Positions(list(large)) if r.random() < .5 else list(large)
        pairs, joined = R._united(list(small), wide)
        assert list(joined) == sorted(every) and len(joined) == len(every)
        lot = sorted(every)
        assert sorted(pairs) == [(a, b) for a, b in zip(lot, lot[1:]) if (a in set(small)) != (b in set(small))]
    text = " ".join(["x"] * 500 + ["y", "z"] * 300)
    assert found([text]) == [[(0, 500, 1), (500, 600, 2)]]


def test_one_long_text():
    w = words(3000, 5) + ["a"] * 20000 + words(3000, 6) + ["b", "c", "d"] * 5000
    got = found([" ".join(w)])[0]
    assert (3000, 20000, 1) in got and (26000, 15000, 3) in got


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(k, " ".join(words(r.randint(0, 120), k, 12)).replace("w3 ", "w3\n\t", 1)) for k in range(300)]
    out += [(k, " ".join(["again and"] * r.randint(1, 30) + words(9, k))) for k in range(300, 340)]
    out += [(900, None), (901, ""), (902, " \n "), (None, "x " * 9), (None, "x " * 9), (7, "é é é é é é ü"), (7, "p q")]
    out += [(d, "same words over " * 12) for d in (1000, 1000, 1001)]
    return out


def test_report_equals_brute_force(spark, rows, monkeypatch):
    for limit, table in ((None, docs(spark, rows).repartition(3)), (200, clashing(docs(spark, rows)))):
        if limit:
            monkeypatch.setattr(R.B, "SLICE_BYTES", limit)
        report = R.run_report(R.looped(table))
        got = [tuple(x) for x in report.collect()]
        assert sorted(got, key=str) == sorted((expected(*x) for x in rows), key=str)
    assert {zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows} == {True, False}
    assert "Exchange" not in report._jdf.queryExecution().executedPlan().toString()


def test_columns_are_kept(spark):
    table = docs(spark, [(1, "a a a a a a a b"), (None, None)]).selectExpr("*", "'mine' as runs", "1 as start")
    got = {x.doc_id: x for x in R.with_runs(table).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 7, 1)] and got[1].collapsed == "a b" and got[1].start == 1
    assert got[None].runs == [] and got[None].collapsed == ""
    assert R.run_report(docs(spark, [])).collect() == []


def test_equal_hashes_are_told_apart():
    h1, h2 = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    ids = R._word_ids(h1, h2)
    assert ids[0] == ids[3] and len(set(ids.tolist())) == 3
