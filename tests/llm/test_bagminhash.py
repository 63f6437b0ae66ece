import random
import re
from collections import Counter

import numpy as np
import pytest

from shipwatch.llm import bagminhash as M
from shipwatch.llm.graph import components
from tests.llm.helpers import clashing, docs, words


def bag_of(text):
    w = [x.encode() for x in re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())]
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(rows, similarity=0.8):
    """Per row: the smallest id that links of at least this similarity lead to."""
    ids = [M.NULL_ID if d is None else d for d, _ in rows]
    bags = [bag_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= similarity * sum((bags[i] | bags[j]).values()):
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [(rows[i][0], None if low[root(i)] == M.NULL_ID else low[root(i)]) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out, k = [], 0
    shared = " ".join(words(60, 999))
    for g in range(25):
        base = words(r.randint(1, 120), g)
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"new{r.randrange(99)}"
            out.append((k * 7 % 1009, " ".join(w) + (" " + shared if g % 3 == 0 else "")))
            k += 1
    out += [(2000 + i, "Copy of one text, word for word, " + " ".join(words(30, 5))) for i in range(30)]
    out += [(3000, None), (3001, None), (3002, ""), (3003, "..."), (3004, "one two"), (3005, "One, TWO!"), (3006, "one two three"),
            (3007, "again and " * 400), (3008, "again and " * 390), (3009, "again and " * 200), (3010, "ÉTÉ à la mer et puis"),
            (3011, "été à la mer et puis"), (3012, " ".join(words(20000, 8))), (None, "alone with no id at all"), (2000, out[-30][1] if False else None)]
    return [x for x in out if x is not None]


@pytest.mark.parametrize("block", [256, 3])
def test_classes_equal_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = rows[:-1]
    got = [(r.doc_id, r.class_id) for r in M.classes(clashing(docs(spark, rows)).repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_one_document_of_each_class_stays(spark, rows):
    rows = rows[:-1] + [(2000, rows[-16][1]), (2000, rows[-16][1])]
    table = clashing(docs(spark, rows))
    kept = M.representatives(table)
    assert kept.columns == table.columns
    got = kept.collect()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    want = {d for d, c in brute(rows) if d == c and d is not None}
    assert len(ids) == len(set(ids)) and set(ids) == want and sum(r.doc_id is None for r in got) == 1


def test_repeated_rows_nulls_and_empty(spark):
    text = " ".join(words(40, 1))
    found = M.classes(docs(spark, [(5, text), (5, text), (None, text), (None, None), (9, text + " end")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in found) == [
        ("5", "5"), ("5", "5"), ("9", "5"), ("None", "5"), ("None", "None")]     # the null text is alone, whatever its id
    assert M.classes(docs(spark, [])).collect() == []


def near(text, k):
    return text + f" end{k}"


def test_ids_do_not_join_texts(spark):
    """Null and repeated ids stand over unrelated texts; classes and kept rows go by the texts."""
    a, b, c, d = (" ".join(words(50, 100 + k)) for k in range(4))
    rows = [(1, a), (None, near(a, 1)), (2, b), (None, near(b, 1)), (7, near(c, 1)), (7, near(d, 1)), (3, c), (4, d), (5, a + " " + d), (5, b + " " + c),
            (None, a + " " + b), (None, a + " " + b), (6, None), (6, None), (None, ""), (8, a), (8, near(a, 2)), (8, b)]
    got = sorted(((str(r.doc_id), str(r.class_id)) for r in M.classes(docs(spark, rows).repartition(5)).collect()))
    assert got == sorted((str(x), str(y)) for x, y in brute(rows))
    assert ("2", "2") in got and ("7", "3") in got and ("7", "4") in got
    kept = [(r.doc_id, r.text) for r in M.representatives(docs(spark, rows).repartition(3)).collect()]
    want = [(1, a), (2, b), (3, c), (4, d), (5, a + " " + d), (5, b + " " + c), (None, a + " " + b), (6, None), (6, None), (None, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_a_third_of_all_rows_without_id(spark):
    r = random.Random(6)
    texts = [" ".join(words(r.randint(5, 60), 700 + k)) for k in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k // 2 % 60, near(r.choice(texts), k)) for k in range(120)]
    rows += [(None, near(texts[k % 60], 500 + k % 7)) for k in range(80)] + [(None, "all the same words again") for _ in range(40)]
    got = sorted(((str(x.doc_id), str(x.class_id)) for x in M.classes(docs(spark, rows).repartition(4)).collect()))
    assert got == sorted((str(x), str(y)) for x, y in brute(rows))
    kept = M.representatives(docs(spark, rows)).collect()
    assert len({bag_key(x.text) for x in kept}) == len(kept)


def bag_key(text):
    return tuple(sorted(bag_of(text).items()))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    shingle = rng.integers(1, 2 ** 63, 60).astype(np.uint64)
    a, b = rng.integers(1, 12, 60), rng.integers(1, 12, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    owner = np.repeat([0, 1], 60)
    reg = M.signatures(owner, np.concatenate([shingle, shingle]), np.concatenate([a, b]), 2, 4000)
    assert np.isfinite(reg).all()
    assert abs((reg[0] == reg[1]).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5


def test_links_are_a_forest():
    sets = [np.arange(10, dtype=np.uint32), np.arange(1, 11, dtype=np.uint32), np.arange(10, dtype=np.uint32), np.arange(50, 60, dtype=np.uint32)]
    found = M.links([1, 2, 3, 4], sets, [True] * 4, 0.8)
    assert len(found) == 2 and {x for e in found for x in e} == {1, 2, 3}


def test_components_of_long_paths(spark):
    r = random.Random(2)
    names = list(range(300))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(198)] + [(names[i], names[i + 1]) for i in range(200, 299)] + [(7000, 7000)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(names[:199]) for n in names[:199]} | {n: min(names[200:]) for n in names[200:]}
    assert got == want
