"""Token-count rollups kept up to date by signed deltas.

A ledger folder holds, per batch, signed entries (a narrow row per document
and tokenizer version), the batch's additive totals by source, language and
version, and a snapshot: what the documents of the touched buckets count after
the batch. An insert or a revised count writes +new (and -old where the
document was counted before), a delete writes -old. Totals are the sum over the
batches that are committed: the commit mark is written last, a batch whose mark
stands is never applied again, and one that broke off is overwritten when
repeated. The mark also says which buckets the batch touched, so a commit reads
the newest snapshot of its own buckets and nothing of the history.

One writer at a time; a bucket is a hash of the document key. Only narrow rows
are shuffled, on (document, version), and after partial sums on the rollup's
key, so a source with most rows costs one row per task.

Defined cases: within a batch a delete wins over other changes of the same
document and version, and of several counts the largest counts; repeated rows
count once (``copies`` says how many equal rows a change stands for); deletes of
unknown documents do nothing; a null key is one document of its own; null source
or language are keys of their own; a null text has 0 tokens; an empty batch is
committed with no effect; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from shipwatch.llm import batches as B
from shipwatch.llm.tokens import VOCABULARY, WORD_VOCABULARY, Encoder

STATE = "doc_key string, source string, lang string, version string, tokens long, copies long"
ENTRY = f"{STATE}, sign int"
MARK = "batch string, number long, buckets array<int>"
KEY = ("source", "lang", "version")
TOTAL = "source string, lang string, version string, docs long, tokens long"
BUCKETS = 64                        # of the snapshots; what a commit reads grows with those that it touches
SPREAD = 8                          # tasks that write a bucket


def token_count(vocabulary: str = VOCABULARY) -> Column:
    """A pandas UDF: ids of a text under a vocabulary file of the public tokenizers."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        encoder = Encoder.at(public_tokenizers.path(vocabulary), with_ids=False)
        for s in texts:
            yield pd.Series(encoder.counts([t or "" for t in s]))

    return count


class TokenLedger:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, kind: str, batch: str) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(self._path("commits", batch) + "/_SUCCESS")

    def batches(self) -> list[str]:
        if not self._exists(f"{self.folder}/commits"):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        names = [f.getPath().getName().removeprefix("batch=") for f in found]
        return sorted(b for b in names if self.committed(b))

    def _table(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _marks(self) -> list:
        """The commit marks, oldest first: a row per batch."""
        return sorted(self._table([self._path("commits", b) for b in self.batches()], MARK).collect(),
                      key=lambda m: m.number)

    def snapshot_paths(self, buckets: list[int]) -> list[str]:
        """The newest snapshot of each of the buckets that has one."""
        newest = {k: m.batch for m in self._marks() for k in m.buckets}
        paths = [f"{self._path('moves', newest[k])}/part=state/bucket={k}" for k in buckets if k in newest]
        return [p for p in paths if self._exists(p)]

    def current(self) -> DataFrame:
        """What each document counts now, per version."""
        return self._table(self.snapshot_paths(list(range(self.buckets))), STATE)

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """The rollup after all committed batches, or the sum of the given ones: documents and tokens by key."""
        paths = [self._path("totals", b) for b in self.batches() if batches is None or b in batches]
        return (self._table(paths, TOTAL).groupBy(*KEY)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply (op, doc_key, source, lang, version, tokens[, copies]); op: insert, revise or delete.

        False if the batch is already committed: nothing is written then.
        """
        if self.committed(batch):
            return False
        copies = F.col("copies").cast("long") if "copies" in changes.columns else F.lit(1).cast("long")
        (changes.groupBy("doc_key", "version")
         .agg(F.max(F.struct((F.col("op") == "delete").alias("gone"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
                             copies.alias("copies"), "source", "lang")).alias("c"))
         .select("doc_key", "version", "c.*", self._bucket())
         .write.mode("overwrite").parquet(self._path("changes", batch)))
        new = self.spark.read.parquet(self._path("changes", batch))
        buckets = sorted(r.bucket for r in new.select("bucket").distinct().collect())     # at most self.buckets rows
        old = self._table(self.snapshot_paths(buckets), STATE).select(
            F.struct("doc_key", "source", "lang", "version", "tokens", "copies").alias("o"))
        now = F.struct("doc_key", "source", "lang", "version", "tokens", "copies").alias("n")
        new = new.select(now, "gone")
        both = new.join(old, F.col("n.doc_key").eqNullSafe(F.col("o.doc_key"))
                        & F.col("n.version").eqNullSafe(F.col("o.version")), "full")
        after = F.when(F.col("gone"), F.lit(None)).otherwise(F.coalesce("n", "o"))
        both = both.select(F.when(F.col("n").isNotNull(), F.col("o")).alias("before"), after.alias("after"),
                           F.col("n").isNotNull().alias("changed"))
        # the three parts of a document's move: its new state, and the signed entries that lead there
        rows = both.select(F.explode(F.array(
            F.struct(F.col("after").alias("e"), F.lit(0).alias("sign")),
            F.struct(F.when(F.col("changed"), F.col("after")).alias("e"), F.lit(1).alias("sign")),
            F.struct(F.col("before").alias("e"), F.lit(-1).alias("sign")))).alias("r")).where("r.e is not null")
        rows = rows.select("r.e.*", "r.sign")
        spread = F.pmod(F.xxhash64("doc_key", F.lit(1)), F.lit(SPREAD))
        (rows.withColumn("bucket", self._bucket()).repartition(F.col("bucket"), spread)
         .withColumn("part", F.when(F.col("sign") == 0, "state").otherwise("entries"))
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part", "bucket").parquet(self._path("moves", batch)))
        self._settle(batch, buckets)
        return True

    def _settle(self, batch: str, buckets: list[int]) -> None:
        """Totals of the batch, then its mark."""
        moves = self._path("moves", batch)
        written = self._table([f"{moves}/part=entries"] if self._exists(f"{moves}/part=entries") else [], ENTRY)
        (written.groupBy(*KEY).agg(F.sum(F.col("sign") * F.col("copies")).alias("docs"),
                                   F.sum(F.col("sign") * F.col("copies") * F.col("tokens")).alias("tokens"))
         .coalesce(1).write.mode("overwrite").parquet(self._path("totals", batch)))
        self.spark.createDataFrame([(batch, len(self.batches()), buckets)], MARK).coalesce(1).write.mode(
            "overwrite").parquet(self._path("commits", batch))


def keyed(docs: DataFrame, **counts: Column) -> DataFrame:
    """A row per different document (id, text, source and language), with its number of equal rows and its counts.

    Rows without an id, or with one id and different texts, are documents of their own.
    """
    counted = docs.select("doc_id", "source", "lang", F.md5("text").alias("digest"),
                          *[c.cast("long").alias(f"n_{v}") for v, c in counts.items()])
    one = counted.groupBy("doc_id", "source", "lang", "digest").agg(
        F.count(F.lit(1)).alias("copies"), *[F.max(f"n_{v}").alias(f"n_{v}") for v in counts])
    key = F.md5(F.to_json(F.struct("doc_id", "source", "lang", "digest")))
    pairs = [F.struct(F.lit(v).alias("version"), F.col(f"n_{v}").alias("tokens")) for v in counts]
    return (one.withColumn("v", F.explode(F.array(*pairs)))
            .select(key.alias("doc_key"), "doc_id", "source", "lang", "digest", "copies", "v.version", "v.tokens"))


def later_copies(docs: DataFrame, *versions: str) -> DataFrame:
    """Deletes of what also stands before: of the rows of one text, the one with the smallest id stays.

    Among several with that id the smallest source, then language stays (nulls
    first); rows without an id come last. Null texts are no copies.
    """
    rows = keyed(docs.where("text is not null"), **{v: F.lit(0) for v in versions})
    order = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "source", "lang")
    first = rows.groupBy("digest").agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") > len(versions))
    salt = F.pmod(F.xxhash64("doc_key"), F.lit(16)).cast("int")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("digest", "salt", "low")
    return (rows.withColumn("salt", salt).join(first, ["digest", "salt"]).where(order > F.col("low"))
            .select(F.lit("delete").alias("op"), "doc_key", "source", "lang", "version", "tokens", "copies"))


def maintained(docs: DataFrame, ledger: TokenLedger) -> DataFrame:
    """The life of a corpus: estimates on arrival, then exact counts, then the removal of copies.

    Both vocabularies are estimated at 4 bytes a token until their tokenizers
    have run. The second batch is sent twice, as after a lost acknowledgement.

    ``docs`` and ``tokens`` are those of all rows, after the second batch;
    ``kept_docs`` and ``kept_tokens`` those left after the third, which deletes
    what ``later_copies`` names (equal rows of the one that stays count on).
    """
    B.prepare(docs.sparkSession)
    size = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4)
    text = F.coalesce("text", F.lit(""))
    files = {"byte_bpe": VOCABULARY, "word_bpe": WORD_VOCABULARY}
    ledger.commit("0001-arrivals", keyed(docs, **dict.fromkeys(files, size)).withColumn("op", F.lit("insert")))
    counted = keyed(docs, **{v: token_count(f)(text) for v, f in files.items()}).withColumn("op", F.lit("revise"))
    ledger.commit("0002-counts", counted)
    whole = ledger.totals()
    ledger.commit("0003-copies", later_copies(docs, *files))
    ledger.commit("0002-counts", counted)
    kept = ledger.totals().select(*KEY, F.col("docs").alias("kept_docs"), F.col("tokens").alias("kept_tokens"))
    zero = F.lit(0).cast("long")
    return (whole.select(*KEY, "docs", "tokens", zero.alias("kept_docs"), zero.alias("kept_tokens"))
            .unionByName(kept.select(*KEY, zero.alias("docs"), zero.alias("tokens"), "kept_docs", "kept_tokens"))
            .groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "kept_docs", "kept_tokens")]))
