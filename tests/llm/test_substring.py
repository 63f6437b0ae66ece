import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from shipwatch.llm import substring as S
from tests.llm.helpers import clashing, docs, words


def brute(rows, window=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    order = [(float("inf") if d is None else d, w) for d, w in split]
    low = {}
    for d, w in order:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            low[key] = min(low.get(key, float("inf")), d)
    out = []
    for (doc, w), (d, _) in zip(split, order):
        gone = set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@given(st.integers(0, 1000), st.integers(0, 1000))
def test_any_two_positions_share_an_aligned_anchor(i, j):
    assert any((i + d) % S.PERIOD in S.COVER and (j + d) % S.PERIOD in S.COVER for d in range(S.PERIOD))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    passages = [" ".join(words(n, n)) for n in (12, 13, 14, 20, 60, 200)]
    out = []
    for k in range(150):
        parts = [" ".join(words(r.randint(0, 40), 1000 + k))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        out.append((k * 3 % 151, r.choice([" ", "\n", " \t "]).join(parts)))
    out += [(500 + k, passages[4]) for k in range(40)]               # a group of copies
    out += [(600, None), (601, ""), (602, " \n "), (None, passages[5]), (None, passages[3]), (7, passages[5]), (7, passages[5]),
            (8, "same words " * 40), (9, "same words " * 30), (603, "x y é " + passages[2]), (604, " ".join(words(30000, 9)))]
    return out


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_report_equals_brute_force(spark, rows, size, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", size)
    monkeypatch.setattr(S.B, "SLICE_BYTES", 5000)
    for table in (docs(spark, rows).repartition(5), clashing(docs(spark, rows))):
        got = [tuple(r) for r in S.substring_report(table).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_texts_keep_their_other_columns(spark, rows):
    table = clashing(docs(spark, rows))
    got = S.without_repeats(table)
    assert got.columns == table.columns
    found = got.collect()
    assert len(found) == len(rows) and all(r.home == "x-home" and r._doc == "x-_doc" for r in found)
    report = {r.doc_id: r for r in S.substring_report(table).where("n_removed > 0 and doc_id > 400").collect()}
    for r in found:
        if r.doc_id in report:
            assert hashlib.sha256(r.text.encode()).hexdigest() == report[r.doc_id].kept_sha256


def test_empty_table(spark):
    assert S.substring_report(docs(spark, [])).collect() == []


def test_texts_are_exchanged_once(spark, rows):
    plan = S.substring_report(docs(spark, rows).repartition(3))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text.split("Initial Plan")[0]
    assert "Window" not in text and "CartesianProduct" not in text


def test_homes_are_those_of_spark(spark):
    import pyspark.sql.functions as F
    ids = [0, 1, -1, 7, 2 ** 40, S.NULL_ID, -2 ** 63]
    got = [r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(37)).alias("h")).collect()]
    assert S.home_of(np.array(ids, np.int64), 37).tolist() == got


def test_places_survive_packing():
    ids, rows = np.array([5, 5, 9, 9, 9]), np.array([1, 1, -2, -2, -2])
    places = S._Places(S._sent_home(ids, rows, np.array([3, 4, 0, 7, 7], np.int32), 1))
    assert places.of(5, 1).tolist() == [3, 4] and places.of(9, -2).tolist() == [0, 7] and places.of(5, 2) is None
