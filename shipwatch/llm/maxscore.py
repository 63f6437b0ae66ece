"""Exact top-k inner-product search with MaxScore.

Vectors are quantised to integers; a dimension is a term, a row's component
its weight in the term's posting list. Rows lie in shards (postings column by
column, rows in id order, with the least and largest weight of each term), and
queries in blocks. For a query, a term adds at most ``bound = max(q * max,
q * min, 0)``. Terms are taken by falling bound: the essential ones, whose rest
could still reach the k-th best score, are traversed for all rows; the
others are probed group by group, only for rows that are still competitive.
Bounds below zero are kept exactly (a term's largest possible addition may be
negative), so the result is exact. Shards are merged per query.

Every shard meets every block: both sides carry the key (block, shard), so the
work spreads over all pairs, and nothing is broadcast or gathered whole. The
shard size is fixed; numbers of shards and blocks follow the input.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part; a vector with fewer components has zeros for the
missing ones; equal scores go to the smaller vec_id; a row is never its own
result (by vec_id: rows that repeat the query's id are left out as well);
repeated ids are candidates of their own; null ids take no part; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from shipwatch.llm import batches as B

SHARD_ROWS = 4096
BLOCK_ROWS = 512
PROBE = 8                       # terms probed at a time
STEP = 512                      # rows of a shard taken at a time


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if any is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _packed(key: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        width = int(pdf["q"].map(len).max())
        m = _matrix(pdf["q"], width)
        return pd.DataFrame({key: [int(pdf[key].iloc[0])], "width": [width],
                             f"{key}_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                             f"{key}_rows": [np.ascontiguousarray(m).tobytes()]})
    return pack


def search_shard(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int
                 ) -> tuple[np.ndarray, np.ndarray, int]:
    """Top k of one shard (rows in id order): ids, scores, and how many scores were finished."""
    high, low = rows.max(axis=0) * query, rows.min(axis=0) * query
    bound = np.maximum(high, low)                   # what a term adds at most in this shard
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    finished = 0
    for a in range(0, len(ids), STEP):
        at = np.flatnonzero(ids[a:a + STEP] != query_id) + a
        if not len(at):
            continue
        limit = best[-1] if len(best) == k else None
        # essential: up to the first term after which the rest alone cannot pass the limit
        essential = len(order) if limit is None else max(1, int(np.argmax(rest <= limit)) if (rest <= limit).any() else len(order))
        terms = order[:essential]
        score = _dot(rows[at][:, terms], query[terms])
        done = essential
        while done < len(order):
            live = score + rest[done] > limit       # later ids lose ties
            at, score = at[live], score[live]
            if not len(at):
                break
            terms = order[done:done + PROBE]
            score = score + _dot(rows[np.ix_(at, terms)], query[terms])
            done += len(terms)
        if not len(at):
            continue
        finished += len(at)
        best_ids, best = np.concatenate([best_ids, ids[at]]), np.concatenate([best, score])
        keep = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[keep], best[keep]
    return best_ids, best, finished


def _dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer products; in double arithmetic where that is exact, since it is faster."""
    if rows.size and float(np.abs(rows).max()) * float(np.abs(query).max()) * len(query) < 2.0 ** 52:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return rows @ query


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row that ``queries`` selects."""
    spark = vectors.sparkSession
    B.prepare(spark)
    rows = (vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("q"))
            .where("vec_id is not null and q is not null"))
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    n_shards, n_blocks = 1 + n // SHARD_ROWS, 1 + n_queries // BLOCK_ROWS
    spread = F.xxhash64("vec_id", F.col("q"))
    shards = (rows.withColumn("shard", F.pmod(spread, F.lit(n_shards)).cast("int")).groupBy("shard")
              .applyInPandas(_packed("shard"), "shard int, width int, shard_ids binary, shard_rows binary")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    blocks = (rows.where(queries).withColumn("block", F.pmod(spread, F.lit(n_blocks)).cast("int")).groupBy("block")
              .applyInPandas(_packed("block"), "block int, width int, block_ids binary, block_rows binary")
              .withColumnRenamed("width", "block_width")
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))))

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                ids, q_ids = np.frombuffer(r.shard_ids, np.int64), np.frombuffer(r.block_ids, np.int64)
                m = np.frombuffer(r.shard_rows, np.int64).reshape(len(ids), r.width)
                q = np.frombuffer(r.block_rows, np.int64).reshape(len(q_ids), r.block_width)
                width = min(r.width, r.block_width)
                m, q = np.ascontiguousarray(m[:, :width]), q[:, :width]
                out = [(q_ids[i], *search_shard(ids, m, q_ids[i], q[i], k)[:2]) for i in range(len(q_ids))]
                yield pd.DataFrame({"query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]),
                                    "vec_id": np.concatenate([o[1] for o in out]),
                                    "score": np.concatenate([o[2] for o in out])})

    found = shards.join(blocks, ["block", "shard"]).mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
