import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shipwatch.llm import packing as P
from shipwatch.llm import tokens as T
from tests.llm.helpers import clashing, docs, words


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder.at(public_tokenizers.path(T.VOCABULARY))


PARTS = st.sampled_from(["'s", "'t", "'re", "'ve", "'ll", "'d", "'", "a", "B", "é", "Ж", "1", "²", " ", "  ", "\n", "\t", " ", " ",
                         "!", "$", "…", "\r\n", "r", "e", "日", "😀", "́", "\x00", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=25).map("".join), max_size=6))
def test_ids_are_those_of_the_library(texts):
    e = T.Encoder.at(public_tokenizers.path(T.VOCABULARY))
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.ids(texts)] == want
    assert e.counts(texts).tolist() == [len(w) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS | st.sampled_from(["\x1c", "\x85", "\xa0", "İ", "Σ", "ﬁ", "\u2028", "I'M", "'S", " 'Ll", "\u212a", "\u037e"]), max_size=25).map("".join), max_size=6))
def test_ids_of_a_vocabulary_without_white_space(texts):
    e = T.Encoder.at(public_tokenizers.path(T.WORD_VOCABULARY))
    assert e.starts is T.white_starts
    short = T.Encoder.at(public_tokenizers.path(T.WORD_VOCABULARY), with_ids=False)
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.ids(texts)] == want
    assert e.counts(texts).tolist() == short.counts(texts).tolist() == [len(w) for w in want]


def test_long_texts_and_a_full_cache(encoder, monkeypatch):
    monkeypatch.setattr(T, "PART_CHARS", 1000)
    monkeypatch.setattr(T, "CACHE_WORDS", 300)
    monkeypatch.setattr(T, "RECENT_WORDS", 50)
    text = " ".join(words(3000, 1)) + "\n\n" + "x" * 5000 + "  y"
    assert encoder.ids([text, "a"])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=80), st.sampled_from([16, 32]))
def test_packer_places_every_id_once(sizes, window):
    packer = P.Packer(7 << 32, window)
    given_ids = {k: np.arange(n, dtype=np.uint32) + 1000 * k for k, n in enumerate(sizes)}
    for k, ids in given_ids.items():
        packer.add(k, ids)
        assert packer.n_open == int(packer.level.sum())
    packer.seal()
    rows = packer.take().to_pylist()
    check_pieces(rows, given_ids, window)
    sequences = {}
    for r in rows:
        sequences[r["sequence_id"]] = sequences.get(r["sequence_id"], 0) + r["length"]
    assert sum(n < window for n in sequences.values()) <= 1          # all but the last are full


def check_pieces(rows, given_ids, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = given_ids[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].astype("<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, ids in given_ids.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(200):
        packer = P.Packer(0, 16)
        packer.level[1:16] = rng.integers(0, 3, 15)
        size = int(rng.integers(1, 16))
        costs = {}
        for h in range(0, 17 - size):
            if h and not packer.level[h]:
                continue
            after = packer.level.copy()
            if h:
                after[h] -= 1
            after[h + size] += 1
            costs[h] = int((after[1:16] ** 2).sum())
        assert costs[packer.place(size)] == min(costs.values())


def test_packing_of_a_table(spark, encoder):
    rows = [(k, " ".join(words(k * 7 % 90, k))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " ".join(words(6000, 5))), (103, "日本 text")]
    for table in (docs(spark, rows).repartition(3), clashing(docs(spark, rows))):
        got = [r.asDict() for r in P.packed(table).collect()]
        ids = {k: np.append(np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32), np.uint32(1))
               for k, t in rows}
        check_pieces(got, ids, P.WINDOW)
        assert all(r["padded_to"] in (2048, 1 << (r["padded_to"].bit_length() - 1)) for r in got)
    assert P.packed(docs(spark, [])).count() == 0
    twice = P.packed(docs(spark, [(None, "a b"), (1, "c"), (1, "c")])).collect()
    assert sorted((r.doc_id is None, r.length) for r in twice) == [(False, 2), (False, 2), (True, 3)]


def test_a_task_gives_back_what_it_held(monkeypatch):
    from shipwatch.llm import batches as B
    told = []
    monkeypatch.setattr(B, "give_back", lambda: told.append(1))
    batches = B.released(lambda it: (x for x in it))(iter([1, 2]))
    assert next(batches) == 1 and not told and list(batches) == [2] and told == [1]
    T.Encoder.at(public_tokenizers.path(T.VOCABULARY))
    T.Encoder.forget()
    assert not T.Encoder._made


def test_tables_of_powers_are_given_back():
    from shipwatch.llm import batches as B
    tables = (*B._BYTE_POWERS, *B._WORD_POWERS)
    want = [[x.copy() for x in p.take(5000)] for p in tables]
    B.give_back()
    assert all(len(p.up) == len(p.down) == 1 for p in tables)
    assert all((a == b).all() for p, w in zip(tables, want) for a, b in zip(p.take(5000), w))
