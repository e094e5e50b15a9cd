"""Exact top-k by inner product with no-random-access aggregation (NRA)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import stored

K = 5
EVERY = 50
SCALE = 256
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024
#: Shares of the lists that are read before the bounds are looked at.
DEPTHS = (1 / 8, 1 / 2, 1.0)


def nra(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
        depths=DEPTHS) -> list[np.ndarray]:
    """For each query the rows of its ``k`` best vectors (score, then smaller
    id), rows with the query's id left out.  Entries are integers.

    Per dimension there is one list of the vectors by value; a query reads it
    from the top where its component is positive and from the bottom where it
    is negative.  After each depth a vector's score lies between what was read
    of it plus the worst, and plus the best, that the unread ends can add.  A
    query is done when no vector outside its k best lower bounds can reach the
    k-th of them; those few scores are then completed and ordered."""
    n, d = vectors.shape
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d
    if most >= 2 ** 63:
        raise OverflowError("inner products exceed 64 bits")
    kind = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64
    order = np.argsort(vectors, axis=0, kind="stable")
    from_bottom = np.empty((n, d), np.int32)
    np.put_along_axis(from_bottom, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    from_top = n - 1 - from_bottom
    lists = np.take_along_axis(vectors, order, axis=0)
    x, up, down = vectors.astype(kind), np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    out: list = [None] * len(queries)
    active = np.arange(len(queries))
    for depth in depths:
        t = min(n, max(1, round(depth * n)))
        top, bottom = (from_top < t).astype(kind), (from_bottom < t).astype(kind)
        u, v = up[active], down[active]
        known = (x * top) @ u.T + (x * bottom) @ v.T
        not_top, not_bottom = 1 - top, 1 - bottom
        low = known + not_top @ (u * lists[0].astype(kind)).T + not_bottom @ (v * lists[-1].astype(kind)).T
        high = known + not_top @ (u * lists[n - t].astype(kind)).T + not_bottom @ (v * lists[t - 1].astype(kind)).T
        open_queries = []
        for j, q in enumerate(active.tolist()):
            rows = np.flatnonzero(ids != query_ids[q])
            lo, hi = low[rows, j], high[rows, j]
            kth = np.partition(lo, len(lo) - k)[len(lo) - k] if len(lo) > k else -np.inf
            able = rows[hi >= kth]
            if len(able) <= k or t == n:
                score = vectors[able] @ queries[q]
                out[q] = able[np.lexsort((ids[able], -score))][:k]
            else:
                open_queries.append(q)
        active = np.array(open_queries, np.int64)
        if not len(active):
            break
    return out


def _integers(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(values * scale)
    if np.abs(whole).max(initial=0) >= 2 ** 62:
        raise OverflowError("components exceed 64 bits")
    return whole.astype(np.int64).reshape(len(flat), -1)


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
          scale: int = SCALE, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible
    by ``every`` the ``k`` rows of largest integer inner product of
    floor(scale * x), ties to the smaller id.

    Vectors are dealt at random into blocks, every block has its own sorted
    lists, and a task runs ``nra`` for a block of queries on a block of
    vectors; the blocks' best are ranked per query.  Queries meet all rows in
    blocks, so no task holds more than one block of each.

    Rows whose id or vector is null, or whose vector is empty or holds a null
    or non-finite component, take no part.  Vectors of different lengths do not
    meet.  Rows that share the query's id count as its own; other repeated rows
    count each.  An empty table gives no rows."""
    spark = vectors.sparkSession
    fine = F.forall(F.col("vector"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
            .where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & fine).withColumn("length", F.size("vector")))
    queries = stored(rows.where(F.col("vec_id") % every == 0).withColumn("query_row", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-rows.count() // block_vectors))
    query_blocks = max(1, -(-queries.count() // block_queries))
    data = (rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
            .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    asked = (queries.withColumn("query_block", F.pmod(F.xxhash64("query_row"), F.lit(query_blocks)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, q = _integers(left.column("vector"), scale), _integers(right.column("vector"), scale)
        ids, query_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        found = nra(x, ids, q, query_ids, k)
        at = np.repeat(np.arange(len(q)), [len(f) for f in found])
        rows = np.concatenate(found).astype(np.int64)
        return pa.table([right.column("query_row").to_numpy()[at], query_ids[at], ids[rows], (x[rows] * q[at]).sum(axis=1)], schema=schema)

    keys = ["block", "query_block", "length"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, "query_row long, query_id long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
