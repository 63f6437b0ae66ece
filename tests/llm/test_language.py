import zlib

import numpy as np
import pytest

from shipwatch.llm import language as L
from tests.conftest import SF_MID
from tests.llm.helpers import clashing, docs


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF_MID}/documents.parquet")


def test_held_out_accuracy(corpus):
    got = L.language_report(corpus).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == corpus.count()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_and_metadata_are_not_read(corpus, spark):
    import pyspark.sql.functions as F
    small = corpus.limit(150).cache()
    a = L.fit(small)
    b = L.fit(small.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
              .withColumn("text", F.when(L.held_out(F.col("doc_id")), F.lit("zzz")).otherwise(F.col("text"))).withColumn("source", F.lit(None).cast("string")))
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.temperature == b.temperature


def test_edges(spark):
    rows = [(k, t, lang, "s", 0) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "123 !? \n", None, "s", 0), (None, "und die Katze", "fr", "s", 0),
             (103, "the dog " * 30000, None, None, 0), (104, "日本語", None, None, 0), (1, rows[0][1], "en", "s", 0)]
    table = clashing(docs(spark, rows))
    got = {r.doc_id: r for r in L.language_report(table).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[101].score == 0
    assert got[103].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False
    assert got[104].lang_pred in ("en", "de")
    kept = L.accepted(table)
    assert kept.columns == table.columns and {100, 101, 102}.isdisjoint(r.doc_id for r in kept.collect())
    assert L.predicted(table.withColumn("score", table.doc_id), L.fit(table)).columns[-2:] == ["lang_pred", "score"]


def test_nothing_to_learn_from(spark):
    assert [tuple(r)[2:] for r in L.language_report(docs(spark, [(1, "abc", None, "s", 0)])).collect()] == [("und", 0.0)]
    assert L.language_report(docs(spark, [])).collect() == []


def test_features_are_ngrams_of_letters():
    f, owner, letters = L.features(["Ab c", "", "1", "aB-C"])
    assert letters.tolist() == [3, 0, 0, 3]
    a, b = (sorted(f[owner == k].tolist()) for k in (0, 3))
    assert a == b and not (owner == 1).any() and not (owner == 2).any()


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1, (4000, 3))
    p = L.softmax(z)
    y = np.array([rng.choice(3, p=row) for row in p])
    assert abs(L.temperature(5 * z, y) - 5) < 0.6 and L.temperature(z[:0], y[:0]) == 1.0


def test_weights_are_sparse():
    rows = [(np.array([1, 5 + k % 3]), np.array([1.0, 0.01])) for k in range(60)] + [(np.array([2]), np.array([1.0]))] * 60
    w, _ = L.ftrl(rows, [0] * 60 + [1] * 60, 2)
    assert w[1, 0] > 0 > w[2, 0] and np.count_nonzero(w[5:8]) < 6 and not w[100:].any()


def test_without_labels_lettered_documents_stay(spark):
    rows = [(1, "some words here"), (2, "été"), (3, "12 %% 7"), (4, None), (5, "")]
    table = docs(spark, rows).selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    kept = L.accepted(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_a_language_that_is_not_recognised_goes(spark):
    import corpus_pipeline
    rows = [(k, t, lang, "s", 0) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    table = docs(spark, [*rows, (200, "日本語", None, "s", 0), (201, "Hund und Katze", None, "s", 0)])
    score = {r.doc_id: r.score for r in L.predicted(table, L.fit(table)).collect()}
    assert score[200] < L.LEAST <= score[201]
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, table, "").collect()}
    assert kept == {d for d, s in score.items() if s >= L.LEAST} and 200 not in kept and 201 in kept
