import glob
import hashlib

import public_tokenizers
import pyspark.sql.functions as F
import pytest

from shipwatch.llm import token_counts as K
from shipwatch.llm.store import new_folder
from shipwatch.llm.tokens import VOCABULARY, WORD_VOCABULARY, Encoder
from tests.llm.helpers import clashing, docs

CHANGE = "op string, doc_key string, source string, lang string, version string, tokens long"
FILES = {"byte_bpe": VOCABULARY, "word_bpe": WORD_VOCABULARY}


@pytest.fixture
def ledger(spark):
    return K.TokenLedger(spark, new_folder(spark, "ledger"))


def totals(ledger, *args):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in ledger.totals(*args).collect()}


def test_signed_batches(spark, ledger):
    def batch(name, *rows):
        return ledger.commit(name, spark.createDataFrame(list(rows), CHANGE))
    assert totals(ledger) == {}
    assert batch("1", ("insert", "1", "a", "en", "v1", 10), ("insert", "2", "a", "en", "v1", 5), ("insert", "2", "a", "en", "v2", 7),
                 ("insert", "2", "a", "en", "v1", 5), ("insert", None, None, None, "v1", None))
    assert totals(ledger) == {("a", "en", "v1"): (2, 15), ("a", "en", "v2"): (1, 7), (None, None, "v1"): (1, 0)}
    # a revised count that moves a document to another source; an unknown delete; a delete beside a revision
    assert batch("2", ("revise", "1", "b", "en", "v1", 12), ("delete", "9", "a", "en", "v1", None),
                 ("delete", "2", None, None, "v2", None), ("revise", "2", "a", "en", "v2", 99))
    want = {("a", "en", "v1"): (1, 5), ("b", "en", "v1"): (1, 12), (None, None, "v1"): (1, 0)}
    assert totals(ledger) == want
    assert not batch("2", ("insert", "50", "a", "en", "v1", 1000))         # committed: nothing happens
    assert totals(ledger) == want and ledger.batches() == ["1", "2"]
    assert batch("3")                                                    # an empty batch
    assert totals(ledger) == want
    assert totals(ledger, ["1"]) == {("a", "en", "v1"): (2, 15), ("a", "en", "v2"): (1, 7), (None, None, "v1"): (1, 0)}
    assert {(r.doc_key, r.tokens) for r in ledger.current().collect()} == {("1", 12), ("2", 5), (None, 0)}
    assert batch("4", *[("delete", k, None, None, "v1", 0) for k in ("1", "2", None)])
    assert totals(ledger) == {} and ledger.current().count() == 0
    assert batch("5", ("insert", "1", "c", "en", "v1", 3)) and totals(ledger) == {("c", "en", "v1"): (1, 3)}


def test_a_batch_that_broke_off_is_written_again(spark, ledger):
    rows = spark.createDataFrame([("insert", "1", "a", "en", "v", 10)], CHANGE)
    # moves and totals stand, the commit mark does not: as after a lost driver
    half = spark.createDataFrame([("7", "a", "en", "v", 777, 1, 1, "entries", 3)], K.ENTRY + ", part string, bucket int")
    half.write.partitionBy("part", "bucket").parquet(ledger._path("moves", "1"))
    spark.createDataFrame([("a", "en", "v", 1, 777)], K.TOTAL).write.parquet(ledger._path("totals", "1"))
    assert totals(ledger) == {} and ledger.current().count() == 0
    assert ledger.commit("1", rows) and totals(ledger) == {("a", "en", "v"): (1, 10)}
    assert [r.doc_key for r in ledger.current().collect()] == ["1"]


def test_a_commit_reads_the_snapshots_of_its_buckets_only(spark, ledger):
    many = [("insert", str(k), "a", "en", "v", k) for k in range(300)]
    assert ledger.commit("1", spark.createDataFrame(many, CHANGE))
    one = spark.createDataFrame([("revise", "17", "a", "en", "v", 1000)], CHANGE)
    bucket = one.select(ledger._bucket()).first().bucket
    paths = ledger.snapshot_paths([bucket])
    assert len(paths) == 1 and paths[0].endswith(f"/bucket={bucket}")
    others = [f for f in glob.glob(ledger._path("moves", "1").removeprefix("file:") + "/part=*/bucket=*/*.parquet")
              if f"/bucket={bucket}/" not in f]
    assert others
    kept = {f: open(f, "rb").read() for f in others}
    for f in others:                            # whoever read them would fail
        open(f, "wb").write(b"no parquet")
    assert ledger.commit("2", one)
    assert totals(ledger) == {("a", "en", "v"): (300, sum(range(300)) - 17 + 1000)}
    for f, data in kept.items():
        open(f, "wb").write(data)
    assert ledger.snapshot_paths([bucket])[0].startswith(ledger._path("moves", "2"))
    now = {r.doc_key: r.tokens for r in ledger.current().collect()}
    assert now == {str(k): k for k in range(300)} | {"17": 1000}


def brute(rows):
    """Counts of all rows, and of those that are left when later copies of a text go."""
    whole, kept, low = {}, {}, {}
    order = lambda r: (r[0] is None, r[0] or 0, r[3] is not None, r[3] or "", r[2] is not None, r[2] or "")     # noqa: E731
    for r in rows:
        if r[1] is not None:
            low[r[1]] = min(low.get(r[1], order(r)), order(r))
    for v, file in FILES.items():
        e = Encoder.at(public_tokenizers.path(file)).tokenizer
        for r in rows:
            n = len(e.encode(r[1] or "", add_special_tokens=False).ids)
            for out, take in ((whole, True), (kept, r[1] is None or order(r) == low[r[1]])):
                d, t = out.get((r[3], r[2], v), (0, 0))
                out[r[3], r[2], v] = (d + take, t + n * take)
    return {k: whole[k] + kept[k] for k in whole}


def test_life_of_a_corpus(spark, ledger):
    rows = [(k, f"some text number {k % 4}" * (k % 4 + 1), ["en", "de", None][k % 3], ["x", None][k % 2], 0) for k in range(30)]
    rows += [(100, None, "en", "x", 0), (101, None, "en", "x", 0), (102, "", "en", "x", 0), (103, "日本" * 2000, "en", "x", 0)]
    # rows without an id, one id over different texts, equal rows
    rows += [(None, f"Nameless No. {k % 3}, it's", "en", "y", 0) for k in range(20)]
    rows += [(7, "one id", "en", "y", 0), (7, "another text", "en", "y", 0)] + [(8, "the same row\t twice ", "de", "y", 0)] * 2
    rows += [(None, None, None, None, 0)] * 3
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens, r.kept_docs, r.kept_tokens)
           for r in K.maintained(clashing(docs(spark, rows)), ledger).collect()}
    assert got == brute(rows)
    assert sum(v[0] for k, v in got.items() if k[2] == "word_bpe") == len(rows)


def test_keys_of_documents(spark):
    rows = [(None, "a"), (None, "b"), (None, "a"), (1, "a"), (1, None), (1, "")]
    got = K.keyed(docs(spark, rows), v=F.length("text")).collect()
    assert sorted((r.doc_id is None, r.digest or "", r.copies) for r in got) == sorted(
        [(True, hashlib.md5(b"a").hexdigest(), 2), (True, hashlib.md5(b"b").hexdigest(), 1),
         (False, hashlib.md5(b"a").hexdigest(), 1), (False, "", 1), (False, hashlib.md5(b"").hexdigest(), 1)])
    assert len({r.doc_key for r in got}) == 5


def test_counts_udf(spark):
    got = docs(spark, [(1, "a b"), (2, None)]).select(
        *[K.token_count(f)(F.coalesce("text", F.lit(""))).alias(v) for v, f in FILES.items()]).collect()
    assert [tuple(r) for r in got] == [(2, 2), (0, 0)]


def test_empty_table(spark, ledger):
    assert K.maintained(docs(spark, []), ledger).collect() == []
