"""Language identification: multinomial logistic regression on character n-grams.

Features: n-grams of 1 to 3 characters of the lower-cased letters of the whole
text (everything between letters is one boundary sign), hashed to ``FEATURES``
slots, as relative frequency times inverse document frequency. Document
frequencies count every document that may be learned from. The weights come
from follow-the-regularised-leader with elastic-net penalties, per class
against the softmax of all; they are sparse. A temperature, fitted on a part
of the sample that the weights have not seen, calibrates the probabilities.

Weights are fitted on at most about ``PER_LANGUAGE`` documents of each
language, chosen by a hash of their ids (a documented bound: it is what is
collected). Prediction is one pass over all texts, without a shuffle.

Learned from: texts and non-null languages of documents for which
crc32(doc_id as text) mod 4 is not 2. Prediction sees the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every document when nothing can be learned from; equal probabilities go
to the first language in order; rows that repeat are predicted row by row; a
null doc_id is not learned from and not held out; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shipwatch.llm import batches as B

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
SCALE = 100.0                       # frequencies are per cent
UNKNOWN = "und"
LEAST = 0.9                         # calibrated probability from which a language counts as recognised
SLICE_BYTES = 256 << 10             # of text at a time: an n-gram costs some 100 bytes


@cache
def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for everything else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every n-gram, the text each belongs to (sorted per order), and letters per text."""
    code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    c = _letters()[np.minimum(code, 0x10FFFF)]
    letters = np.bincount(owner[c > 0], minlength=len(texts))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)       # one sign between words
    c, owner = c[keep].astype(np.uint64), owner[keep]
    found, owners = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = np.full(m, n, np.uint64)
        some = np.zeros(m, bool)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j:j + m]
            some |= c[j:j + m] > 0
        some &= owner[:m] == owner[n - 1:]
        found.append((B.mix(h[some]) >> np.uint64(48)).astype(np.int64))
        owners.append(owner[:m][some])
    return (np.concatenate(found) if found else np.zeros(0, np.int64),
            np.concatenate(owners) if owners else np.zeros(0, np.int64), letters)


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) without repeats, and n-grams per text."""
    f, owner, _ = features(texts)
    key, n = np.unique(owner * FEATURES + f, return_counts=True)
    return key // FEATURES, key % FEATURES, n, np.bincount(owner, minlength=len(texts))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray               # FEATURES x languages: idf * weight * SCALE
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        f, owner, letters = features(texts)
        total = np.bincount(owner, minlength=len(texts))
        out = np.stack([np.bincount(owner, weights=self.table[f, k], minlength=len(texts))
                        for k in range(len(self.languages))], axis=1)
        return out / np.maximum(total, 1)[:, None] + self.bias, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z, letters = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters > 0, np.clip(p.max(axis=1), 0, 1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], n_classes: int, epochs: int = EPOCHS
         ) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal) for the softmax loss; the last row is the bias."""
    z, n = np.zeros((FEATURES + 1, n_classes)), np.zeros((FEATURES + 1, n_classes))
    l1 = np.full(FEATURES + 1, L1)
    l1[-1] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        a, penalty = z[at], l1[at][:, None]
        return np.where(np.abs(a) <= penalty, 0.0,
                        -(a - np.sign(a) * penalty) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            f, x = rows[i]
            at = np.append(f, FEATURES)
            x = np.append(x, 1.0)
            w = weights(at)
            g = softmax(x @ w)
            g[y[i]] -= 1.0
            g = x[:, None] * g
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = n_new
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss (a convex problem in 1 / T: golden-section search)."""
    if not len(y):
        return 1.0

    def loss(b: float) -> float:
        p = softmax(z * b)[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(np.exp(a)) < loss(np.exp(b)):
            high = b
        else:
            low = a
    return float(np.exp(-(low + high) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    spark = docs.sparkSession
    B.prepare(spark)
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(
        ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0))

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES, np.int64)
        for batch in it:
            for part in B.slices(batch, limit=SLICE_BYTES):
                total += np.bincount(_counts(part.column("text").to_pylist())[1], minlength=FEATURES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["f", "n"])

    df = np.zeros(FEATURES)
    for r in usable.select("text").mapInArrow(B.released(frequencies), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        df[r.f] = r.n
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1

    # a share of each language by hash: about per_language documents whatever the table's size
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.where(hashed < share[F.col("lang")])

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch, limit=SLICE_BYTES):
                owner, f, n, total = _counts(part.column("text").to_pylist())
                cut = np.searchsorted(owner, np.arange(len(total) + 1))
                rows = list(zip(cut[:-1].tolist(), cut[1:].tolist(), total.tolist()))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), part.column("lang").cast(pa.string()),
                    pa.array([f[a:b].astype(np.int32).tobytes() for a, b, _ in rows], pa.binary()),
                    pa.array([(n[a:b] / max(t, 1)).astype(np.float32).tobytes() for a, b, t in rows], pa.binary())],
                    names=["doc_id", "lang", "f", "x"])

    got = sorted(sample.mapInArrow(B.released(vectors), "doc_id long, lang string, f binary, x binary").collect(),
                 key=lambda r: (r.doc_id, r.lang, r.f))
    rows, y = [], []
    for r in got:
        f = np.frombuffer(r.f, np.int32)
        rows.append((f, np.frombuffer(r.x, np.float32) * idf[f] * SCALE))
        y.append(languages.index(r.lang))
    seen = [i for i in range(len(rows)) if i % 5]
    kept = [i for i in range(len(rows)) if i % 5 == 0] if len(rows) >= 50 else []
    seen = seen if kept else list(range(len(rows)))
    w, bias = ftrl([rows[i] for i in seen], [y[i] for i in seen], len(languages))
    z = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in kept]).reshape(len(kept), len(languages))
    t = temperature(z, np.array([y[i] for i in kept], np.int64))
    return Model(languages, w * idf[:, None] * SCALE, bias, t)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    spark = docs.sparkSession
    B.prepare(spark)
    docs = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast(model)      # FEATURES x languages numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch, limit=SLICE_BYTES):
                names, score = sent.value.predict([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(B.released(run), schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    found = predicted(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents whose language is recognised.

    Texts without letters go, and those whose predicted language has a
    probability under ``least``: by default they are texts for which one
    prediction in ten or more is wrong. With nothing to learn from, every
    text with a letter stays: a corpus without labels is not an empty one.
    """
    columns = docs.columns
    model = fit(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return predicted(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*columns)
