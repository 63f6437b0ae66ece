import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shipwatch.llm import decontaminate as D
from tests.llm.helpers import clashing, docs, words

ITEMS = "item_id long, text string"


def brute(rows, items, window=13):
    found = []
    wins = []
    for item, text in items:
        w = D.item_words(text)
        k = min(len(w), window)
        wins += [(item, tuple(w[i:i + k])) for i in range(len(w) - k + 1)] if w else []
    for doc, text in rows:
        w = D.item_words(text)
        hit, ids = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        found.append((doc, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(found, key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=7), max_size=5), st.lists(st.integers(0, 3), max_size=30))
def test_automaton_finds_every_window(items, text):
    a = D.SuffixAutomaton.of([(str(k), [f"a{x}" for x in it]) for k, it in enumerate(items)], window=3)
    ids = [a.vocabulary.get(f"a{x}".encode(), -1) for x in text]
    got = {(x, y, k) for x, y, bits in a.stream(ids) for k in range(len(a.names)) if bits >> k & 1}
    want, named = set(), [it for it in items if it]
    for k, it in enumerate(named):
        n = min(3, len(it))
        for j in range(len(it) - n + 1):
            want |= {(i, i + n, k) for i in range(len(text) - n + 1) if text[i:i + n] == it[j:j + n]}
    assert got == want


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    items = [(k, " ".join(words(r.randint(1, 30), k))) for k in range(12)]
    items += [(3, items[3][1]), (None, " ".join(words(20, 77))), (50, None), (51, " .,! "), (52, "Élan VITAL"), (53, items[0][1].upper())]
    rows = [(k, " ".join(words(r.randint(0, 60), 100 + k))) for k in range(30)]
    for k, (_, t) in enumerate(items):
        rows.append((100 + k, " ".join(words(20, 300 + k)) + ". " + (t or "").title() + "; " + " ".join(words(9, 400 + k))))
    rows += [(200, None), (201, ""), (202, "..."), (None, items[1][1]), (100, rows[0][1]), (203, "élan vital"), (204, "Élan vital " * 3000)]
    return rows, items


def test_report_equals_brute_force(spark, case):
    rows, items = case
    benchmark = spark.createDataFrame(items, ITEMS)
    for table in (docs(spark, rows), clashing(docs(spark, rows))):
        got = D.verdicts(D.contamination(table, benchmark)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_shards_of_a_large_benchmark_give_the_same(spark, case, monkeypatch):
    rows, items = case
    monkeypatch.setattr(D, "SHARD_WORDS", 200)
    got = D.verdicts(D.contamination(docs(spark, rows), spark.createDataFrame(items, ITEMS))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ITEMS), docs(spark, [(1, "a b"), (2, None)])
    assert [r.contaminated for r in D.verdicts(D.contamination(some, none)).collect()] == [False, False]
    assert D.contamination(docs(spark, []), none).count() == 0
    assert D.decontaminated(some, none).count() == 2


def test_removal(spark):
    item = " ".join(f"q{k}" for k in range(13))
    rest = " ".join(words(400, 1))
    rows = [(1, "so: " + item + "!"), (2, f"{rest} {item}, end."), (3, rest), (4, None)]
    got = {r.doc_id: r.text for r in D.decontaminated(clashing(docs(spark, rows)), spark.createDataFrame([(1, item)], ITEMS)).collect()}
    assert got == {2: f"{rest} , end.", 3: rest, 4: None}
