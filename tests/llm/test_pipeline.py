import zlib

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shipwatch.llm import decontaminate, packing, privacy
from shipwatch.llm.queries import QUERIES
from shipwatch.llm.store import settled
from shipwatch.llm.tokens import VOCABULARY, Encoder
from tests.conftest import SF_SMALL
from tests.llm.test_bagminhash import brute as near_classes


def test_one_query_per_operator():
    names = list(QUERIES)
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{k}" for k in range(1, 14)] and names[-1] == "pipeline"
    assert set(names) <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "privacy", "packing"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settled(stage(spark, out[-1], SF_SMALL), "test-stage"))
    return out


def test_stages_keep_the_columns_and_what_is_clean(spark, steps):
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]
    assert all(s.columns == steps[0].columns and s.schema["n_chars"] == steps[0].schema["n_chars"] for s in steps[1:-1])
    assert len(rows[1]) >= 0.99 * len(rows[0])                              # languages are recognised
    before = [(d, r.text) for d, r in rows[1].items()]
    assert set(rows[2]) == {d for d, c in near_classes(before) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    wins = set()
    for _, t in items:
        w = decontaminate.item_words(t)
        wins |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12)) if w}
    sizes = {len(w) for w in wins}
    for d, r in rows[2].items():
        w = decontaminate.item_words(r.text)
        hit = {p for k in sizes for i in range(len(w) - k + 1) if tuple(w[i:i + k]) in wins for p in range(i, i + k)}
        assert (d in rows[3]) == (not hit or 20 * len(hit) < len(w))
        if d in rows[3]:
            assert (rows[3][d].text == r.text) == (not hit) and rows[3][d].n_chars == len(rows[3][d].text or "")
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[3].items():
        want = privacy.redacted(r.text, [(privacy.KINDS[k], a, b) for k, a, b in privacy.base_spans(r.text)])
        assert rows[4][d].text == want or "[TERM]" in rows[4][d].text
        assert not privacy.base_spans(rows[4][d].text) and rows[4][d].n_chars == len(rows[4][d].text)


def test_packing_holds_every_id(steps):
    tokenizer = Encoder.at(public_tokenizers.path(VOCABULARY)).tokenizer
    ids = {r.doc_id: np.append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids, np.uint32), np.uint32(1))
           for r in steps[4].collect()}
    total = 0
    for r in steps[5].collect():
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.offset + r.length <= packing.WINDOW
        total += r.length
    assert total == sum(map(len, ids.values()))


def test_run_is_the_registered_query(spark, steps):
    got = entry.queries()["pipeline"](spark, SF_SMALL)
    assert got.count() == steps[5].count() and got.columns == steps[5].columns
