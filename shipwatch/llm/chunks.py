"""Sorted rows in chunks, so that a key of any size is walked in order by many tasks.

``chunked`` deals rows by ranges of their order, sorts them, and packs
consecutive rows into one row per chunk whose columns are arrays. A chunk is
read whole and in order wherever its file is split. It ends between two keys
where it can; only a key longer than a chunk, or one that a range boundary
cuts, goes on in the next chunk. What a walk carries from one chunk to the
next (counts, sums, digests) is folded on the driver from one short row per
chunk, ``CHUNK_ROWS`` times fewer than the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from shipwatch.llm import batches as B
from shipwatch.llm.store import settled

CHUNK_ROWS = 1 << 16
CHUNK_BYTES = 4 << 20


def chunked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """(part, seq, one array per column of ``df``): the rows in ``order``, which begins with ``keys``."""
    B.prepare(df.sparkSession)
    columns = df.columns

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def row(table: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            arrays = [pa.array([part], pa.int32()), pa.array([seq], pa.int32())]
            for c in columns:
                values = table.column(c).combine_chunks()
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays(arrays, names=["part", "seq", *columns])

        def full() -> bool:
            return sum(b.num_rows for b in held) >= CHUNK_ROWS or sum(b.nbytes for b in held) >= CHUNK_BYTES

        for batch in it:
            size = max(1, min(CHUNK_ROWS, batch.num_rows * CHUNK_BYTES // max(batch.nbytes, 1)))
            for a in range(0, batch.num_rows, size):
                held.append(batch.slice(a, size))
                if full():
                    table = pa.Table.from_batches(held)
                    cut = run_begins(*[np.asarray(table.column(k)) for k in keys])[-1] or table.num_rows
                    yield row(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield row(pa.Table.from_batches(held))

    schema = StructType([StructField("part", IntegerType()), StructField("seq", IntegerType())]
                        + [StructField(f.name, ArrayType(f.dataType)) for f in df.schema])
    return settled(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, schema), name)


def run_begins(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins, in arrays sorted by key."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], dict[str, pa.Array]]]:
    """((part, seq), column arrays) of each chunk of a batch."""
    arrays = {n: batch.column(n) for n in batch.schema.names if n not in ("part", "seq")}
    for i, at in enumerate(zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist())):
        yield at, {n: a[i].values for n, a in arrays.items()}
