"""Quality scores: ridge regression on random Fourier features, isotonic calibration.

1. One pass over the whole texts takes ``NAMES``, the statistics of a document
   (sizes, shares of kinds of bytes and words, repetition of words, word
   triples and lines). They are written once; the texts are not read again.
2. The statistics are standardised over all documents and mapped to ``FEATURES``
   random Fourier features, whose inner products approximate a Gaussian kernel
   of width ``WIDTH`` between two documents.
3. Ridge regression of the label on the features. The normal equations are sums
   over rows: each task adds its own up, and the tasks' sums are added block by
   block. Features are whole multiples of 2**-16 and the sums are whole numbers,
   so the result does not depend on the partitioning.
4. The rows with a quarter of the hashes of doc_id are kept from the fit. Their
   ridge scores, counted on a grid of ``BINS`` steps, give the isotonic
   regression that turns a ridge score into a probability.

Every labelled row that may be learned from takes part; what reaches the driver
is one matrix of FEATURES + 1 squared numbers, the grid and the moments.

Learned from: labels of documents for which crc32(doc_id as text) mod 5 is not
0. A score depends on the text alone. Predicted is 1 from a score of 0.3 on.

Defined cases: null texts are empty texts and have a score too; labels that
repeat for an id count with their mean, null labels and labels of ids without a
document do not count; rows that repeat an id are rows of their own with the
same label; a null doc_id is neither learned from nor held out; with no usable
label every score is 0.5; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from shipwatch.llm import batches as B
from shipwatch.llm.store import settled

FEATURES = 256
WIDTH = 8.0
RIDGE = 1e-4                 # of the number of rows
BINS = 2048                  # steps of the grid from -0.5 to 1.5
LIMIT = 0.3                  # predicted is 1 from this score on
CLIP = 4.0                   # standard deviations
SEED = 20240
STEP = float(1 << 16)
_ROWS = 16                   # rows of the normal equations in one block

NAMES = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "line_words",
    "letters", "upper", "digits", "spaces", "points", "symbols", "exclamations", "bars", "controls", "byte_entropy",
    "words_without_letter", "words_ending_in_symbol", "words_ending_in_point", "words_in_capitals", "short_words", "long_words",
    "distinct_words", "top_word", "words_said_twice", "repeated_triples", "repeated_lines",
)

_LETTER = B.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_UPPER = B.byte_class((0x41, 0x5A))
_LOWER = B.byte_class((0x61, 0x7A), (0x80, 0xFF))
_DIGIT = B.byte_class((0x30, 0x39))
_SPACE = ~B.NOT_SPACE
_POINT = B.byte_class(*((ord(c), ord(c)) for c in ".,;:?'\"()-"))
_CONTROL = B.byte_class((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x7F))
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _POINT | _CONTROL)
_STOP = B.byte_class(*((ord(c), ord(c)) for c in ".?!"))
_LINE = ~B.byte_class((0x0A, 0x0A))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many different hashes, and how often the commonest one stands."""
    key = B.mix(hashes ^ B.mix(owner.astype(B.U64)))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, owner[at], count)
    return np.bincount(owner[at], minlength=n).astype(float), top


def statistics_of(texts: B.Texts) -> np.ndarray:
    """The statistics ``NAMES`` of each text, a row each."""
    n = len(texts)
    size = np.diff(texts.offsets).astype(float)
    bounds = texts.offsets.tolist()
    counts = np.array([np.bincount(texts.data[a:b], minlength=256) for a, b in zip(bounds, bounds[1:])]).reshape(n, 256)

    def share(table: np.ndarray) -> np.ndarray:
        return counts @ table.astype(float) / np.maximum(size, 1)

    p = counts / np.maximum(size, 1)[:, None]
    entropy = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(1)
    words = B.words_of(texts, B.NOT_SPACE)
    n_words = np.diff(words.first).astype(float)
    each = np.maximum(n_words, 1)
    doc = words.doc()

    def inside(table: np.ndarray) -> np.ndarray:
        """Bytes of each word that are in the table."""
        total = np.concatenate([[0], np.cumsum(table[texts.data])])
        return total[words.end] - total[words.start]

    length = (words.end - words.start).astype(float)
    mean = _sums(length, words.first) / each
    spread = np.sqrt(np.maximum(_sums(length * length, words.first) / each - mean * mean, 0))
    letters, upper, lower = inside(_LETTER), inside(_UPPER), inside(_LOWER)
    last = texts.data[words.end - 1]
    lines = B.words_of(texts, _LINE)
    n_lines = np.diff(lines.first).astype(float)
    line_kinds, _ = _distinct(lines.hash, lines.doc(), n)
    kinds, top = _distinct(words.hash, doc, n)
    again = np.zeros(len(doc))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    at = B.window_starts(words.first, 3)
    n_triples = np.maximum(np.diff(words.first) - 2, 0)
    triple_kinds, _ = _distinct(B.window_hash(words.hash, 3)[at], np.repeat(np.arange(n), n_triples), n)

    def of_words(mask: np.ndarray) -> np.ndarray:
        return _sums(mask, words.first) / each

    return np.column_stack([
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), np.log1p(mean), np.log1p(spread), np.log1p(n_words / np.maximum(n_lines, 1)),
        share(_LETTER), counts @ _UPPER.astype(float) / np.maximum(counts @ _LETTER.astype(float), 1), share(_DIGIT), share(_SPACE),
        share(_POINT), share(_SYMBOL), share(B.byte_class((0x21, 0x21))), share(B.byte_class((0x7C, 0x7C))), share(_CONTROL), entropy,
        of_words(letters == 0), of_words(_SYMBOL[last]), of_words(_STOP[last]), of_words((upper >= 2) & (lower == 0)),
        of_words(length <= 3), of_words(length > 12),
        kinds / each, top / each, of_words(again), 1 - triple_kinds / np.maximum(n_triples, 1), 1 - line_kinds / np.maximum(n_lines, 1),
    ])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text, in the order of ``NAMES``."""
    B.prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                x = statistics_of(B.texts_of(part.column("text"))).astype(np.float32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), rows], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), len(NAMES))


@dataclass(frozen=True)
class Kernel:
    """Standardisation and the random projection whose cosines approximate a Gaussian kernel."""

    mean: np.ndarray
    scale: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers: the features times 2**16, the constant last."""
        r = np.random.default_rng(SEED)
        w = r.standard_normal((len(NAMES), FEATURES)) / WIDTH
        phase = r.uniform(0, 2 * np.pi, FEATURES)
        z = np.cos(np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ w + phase) * np.sqrt(2 / FEATURES)
        return np.column_stack([np.rint(z * STEP), np.full(len(x), STEP)])


def kernel(stats: DataFrame) -> Kernel:
    """Mean and deviation of every statistic over all documents, in one aggregate."""
    n = len(NAMES)
    got = stats.agg(*[F.avg(F.col("x")[i].cast("double")).alias(f"m{i}") for i in range(n)],
                    *[F.stddev_pop(F.col("x")[i].cast("double")).alias(f"s{i}") for i in range(n)]).first()
    # six digits: what is left does not depend on the order of addition
    number = [float(f"{v or 0.0:.6g}") for v in got]
    scale = np.array(number[n:])
    return Kernel(np.array(number[:n]), np.where(scale > 1e-9, scale, 1.0))


def normal_equations(rows: DataFrame, k: Kernel) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'Z, Z'y and the number of rows, for features Z of ``x`` and labels y of ``label``.

    Tasks send their sums in blocks of rows of the matrix; a block's sums are
    added as they arrive, so no task holds more than its blocks.
    """
    size = FEATURES + 1
    blocks = -(-(size + 1) // _ROWS)
    width = size + 1                                   # features, then the label

    def task_sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), np.int64)
        for batch in it:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                y = np.rint(np.asarray(part.column("label"), np.float64) * STEP)
                z = np.column_stack([k.features(_matrix(part.column("x"))), y])
                total += (z.T @ z).astype(np.int64)    # whole numbers under 2**53: exact
        if total.any():
            cuts = range(0, width, _ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(
                [total[c:c + _ROWS].tobytes() for c in cuts], pa.binary())], names=["block", "sums"])

    def block_sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in it:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums")):
                part = np.frombuffer(sums.as_buffer(), np.int64)
                total[block] = total[block] + part if block in total else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
            [v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])

    schema = "block int, sums binary"
    got = rows.select("x", "label").mapInArrow(task_sums, schema).repartition(blocks, "block").mapInArrow(block_sums, schema).collect()
    full = np.zeros((width, width))
    for r in got:                                      # one row a block
        part = np.frombuffer(bytes(r.sums), np.int64).reshape(-1, width)
        full[r.block * _ROWS:r.block * _ROWS + len(part)] = part
    full /= STEP * STEP
    return full[:size, :size], full[:size, size], int(round(full[size - 1, size - 1]))


def ridge(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Weights of least squares with a penalty of ``RIDGE * n``, none on the constant."""
    penalty = np.full(len(a), RIDGE * n)
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre, value) of the pooled stretches of the sorted x."""
    stack: list[list[float]] = []                      # weight, weighted x, weighted mean
    for xi, m, w in zip(x.tolist(), mean.tolist(), weight.tolist()):
        stack.append([w, w * xi, w * m])
        while len(stack) > 1 and stack[-2][2] * stack[-1][0] >= stack[-1][2] * stack[-2][0]:
            last = stack.pop()
            stack[-1] = [p + q for p, q in zip(stack[-1], last)]
    return np.array([s[1] / s[0] for s in stack]), np.array([s[2] / s[0] for s in stack])


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    centres: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.features(x) @ self.weights / STEP

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.centres):
            return np.full(len(x), 0.5)
        return np.round(np.clip(np.interp(self.raw(x), self.centres, self.values), 0, 1), 6)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The model learned from ``labels`` (doc_id, quality) of documents that are not held out."""
    of_id = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.avg("label").alias("label"))
    learned = settled(stats.where(~held_out(F.col("doc_id"))).join(of_id, "doc_id"), "quality-learned")
    k = kernel(stats)
    spare = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    a, b, n = normal_equations(learned.where(~spare), k)
    if not n:                                          # so few labels that all are spare, or none
        spare = F.lit(True)
        a, b, n = normal_equations(learned, k)
    none = np.zeros(0)
    if not n:
        return Model(k, np.zeros(FEATURES + 1), none, none)
    weights = ridge(a, b, n)
    uncalibrated = Model(k, weights, none, none)

    def binned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, label = np.zeros(BINS), np.zeros(BINS)
        for batch in it:
            raw = uncalibrated.raw(_matrix(batch.column("x")))
            at = np.clip(((raw + 0.5) * (BINS / 2)).astype(int), 0, BINS - 1)
            count += np.bincount(at, minlength=BINS)
            label += np.bincount(at, np.asarray(batch.column("label"), np.float64), minlength=BINS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some]), pa.array(label[some])],
                                         names=["bin", "count", "label"])

    def grid(rows: DataFrame) -> list:
        return rows.select("x", "label").mapInArrow(binned, "bin long, count double, label double").groupBy("bin").agg(
            F.sum("count").alias("n"), F.sum("label").alias("total")).orderBy("bin").collect()

    got = grid(learned.where(spare)) or grid(learned)
    x = np.array([(r.bin + 0.5) * 2 / BINS - 0.5 for r in got])
    count, total = np.array([r.n for r in got]), np.array([r.total for r in got])
    return Model(k, weights, *isotonic(x, total / count, count))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of statistics."""
    sent = stats.sparkSession.sparkContext.broadcast(model)      # some FEATURES numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(_matrix(batch.column("x"))))],
                                             names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    stats = settled(statistics(docs), "quality-statistics")
    return scored(stats, fit(stats, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
