"""Sum-of-squares online packing of token sequences.

Documents come one by one. Whole windows of a document longer than a window
are sequences of their own; the rest goes into the open sequence whose fill
level h minimises the sum over the levels of the squared number of open
sequences (a level array of ``WINDOW`` counts; level 0 is a new sequence).
Full sequences leave at once. What is still open at the end of a task (or
when ``MAX_OPEN`` sequences are open) is cut through and refilled, so a task
pads at most its last sequence.

Every task packs its own rows: no shuffle, memory bounded by the open
sequences. ``sequence_id`` is the task's partition number times 2**32 plus a
counter. Sequences shorter than the window are padded to it, except at a
power of two.

Defined cases: null texts are empty; an empty text is its end id alone; rows
that repeat a doc_id are packed as documents of their own; null ids pass;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shipwatch.llm import batches as B
from shipwatch.llm.tokens import VOCABULARY, Encoder

WINDOW = 2048
END_ID = 1
MAX_OPEN = 4096

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "padded_to long")
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def padded_length(n: int, window: int = WINDOW) -> int:
    return n if n & (n - 1) == 0 else window


class Packer:
    """Packs ids online; ``take`` returns the pieces of sequences that are complete."""

    def __init__(self, first_sequence: int = 0, window: int = WINDOW):
        self.window, self.sequence = window, first_sequence
        self.level = np.zeros(window + 1, np.int64)     # open sequences by fill
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.done: list[tuple] = []

    def place(self, size: int) -> int:
        """The fill level that takes ``size`` ids at the least sum of squares (0: a new sequence)."""
        top = self.window - size
        to = 2 * self.level[size:] + 1                  # what a sequence more at level h + size costs
        to[top] = 0                                     # complete sequences do not count
        cost = to - 2 * self.level[:top + 1] + 1
        cost[0] = to[0]
        cost[1:][self.level[1:top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))         # ties: the fullest

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for a in range(0, whole, self.window):
            self._emit([(doc, a, ids[a:a + self.window], total)])
        if whole < total:
            self._put((doc, whole, ids[whole:], total))
            if self.n_open > MAX_OPEN:
                self.seal(False)

    def _put(self, piece: tuple) -> None:
        size = len(piece[2])
        h = self.place(size)
        if h:
            sequence = self.open[h].pop()
            self.level[h] -= 1
            self.n_open -= 1
        else:
            sequence = []
        sequence.append(piece)
        if h + size == self.window:
            self._emit(sequence)
        else:
            self.open[h + size].append(sequence)
            self.level[h + size] += 1
            self.n_open += 1

    def _emit(self, sequence: list[tuple]) -> None:
        used = sum(len(p[2]) for p in sequence)
        at = 0
        for doc, start, ids, total in sequence:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at,
                              padded_length(used, self.window)))
            at += len(ids)
        self.sequence += 1

    def seal(self, last: bool = True) -> None:
        """Refill what is open, cutting pieces at the window's end."""
        rest = [p for level in reversed(self.open) for sequence in level for p in sequence]
        self.open = [[] for _ in range(self.window + 1)]
        self.level[:] = 0
        self.n_open = 0
        row, used = [], 0
        for doc, start, ids, total in rest:
            while len(ids):
                room = self.window - used
                row.append((doc, start, ids[:room], total))
                used += len(row[-1][2])
                start, ids = start + len(row[-1][2]), ids[room:]
                if used == self.window:
                    self._emit(row)
                    row, used = [], 0
        if row and last:
            self._emit(row)
        elif row:
            self.open[used].append(row)
            self.level[used] += 1
            self.n_open += 1

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        columns = zip(*rows) if rows else [[] for _ in _SCHEMA]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece; see the module. ``vocabulary`` names a file of the public tokenizers."""
    B.prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        encoder = Encoder.at(public_tokenizers.path(vocabulary))
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        end = np.array([end_id], np.uint32)
        for batch in it:
            for part in B.slices(batch):
                texts = part.column("text").to_pylist()
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.ids([t or "" for t in texts])):
                    packer.add(doc, np.concatenate([ids, end]))
                yield packer.take()
        packer.seal()
        yield packer.take()
        Encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(B.released(run), PIECES)
