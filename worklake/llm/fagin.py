"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Vectors and queries are dealt into blocks, each pair of blocks is a group of its own. A group sorts its vectors by each dimension; a
query goes down the lists (up, where its component is negative), scores what it meets, and stops when its k-th score is above the
bound, the product with the components at the depth reached: nothing below can reach it. Equal scores go on, since a smaller id may
follow. The k best of the groups are merged.

Vectors that are null, hold null or non-finite components, or have no id take no part. Every other row has a number of its own: rows
repeated exactly, and rows with one id and different vectors, are candidates for each other, and queries each with ranks of its own. Vectors of different lengths: missing components count 0. Products
are exact: in doubles while these hold every sum, else in integers of any size; a score beyond a long is cut to its range.
No rows: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm.common import kept, query, table

BLOCK = 2048  # vectors of a group
QUERIES = 2048  # queries of a group
FIRST_DEPTH = 16


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """uid (a number of the row, to be written before it is used twice), vec_id, e: whole components of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id",
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("e"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    lengths = np.asarray(rows.value_lengths())
    flat = np.asarray(rows.flatten())
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def search(vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, query: np.ndarray, own: int, k: int,
           down: np.ndarray, up: np.ndarray) -> list[tuple[int, int]]:
    """[(score, place)] of the k best of one block, by the threshold algorithm. down, up: places by each dimension, (dimensions, n)."""
    n = len(vectors)
    grows, falls = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    lists = np.concatenate([down[grows], up[falls]])
    dims = np.concatenate([grows, falls])
    weights = query[dims]
    seen = uids == own
    best_scores, best = np.zeros(0, query.dtype), np.zeros(0, np.int64)
    at, depth = 0, FIRST_DEPTH
    while at < n:
        end = min(n, depth) if len(dims) else n  # a query of zeros has no list: all score 0
        new = np.zeros(n, bool)
        if len(dims):
            new[lists[:, at:end].ravel()] = True
        else:
            new[:] = True
        new = np.flatnonzero(new & ~seen)
        seen[new] = True
        best_scores, best = np.concatenate([best_scores, vectors[new] @ query]), np.concatenate([best, new])
        order = np.lexsort((ids[best], -best_scores))[:k]
        best_scores, best = best_scores[order], best[order]
        at, depth = end, depth * 2
        if len(best) == k and len(dims) and at < n:
            bound = weights @ vectors[lists[:, at - 1], dims]
            if best_scores[-1] > bound:
                break
    return list(zip(best_scores, best))


def _group(k: int):
    def run(group: pa.Table) -> pa.Table:
        is_query = np.asarray(group["is_query"])
        width = int(max(np.asarray(group["width"]).max(), 1))
        e, ids, uids = _matrix(group["e"], width), np.asarray(group["vec_id"]), np.asarray(group["uid"])
        peak = int(np.abs(e.astype(np.float64)).max()) if e.size else 0
        e = e.astype(np.float64) if peak * peak * width < 2 ** 53 else e.astype(object)
        v, vid, vuid = e[~is_query], ids[~is_query], uids[~is_query]
        out: dict[str, list] = {c: [] for c in ("query_uid", "query_id", "vec_id", "score")}
        if len(v):
            up = np.argsort(v.T.astype(np.float64) if e.dtype == object else v.T, axis=1, kind="stable")
            down = up[:, ::-1]
            if e.dtype == object:  # doubles may not tell large components apart: sort them exactly
                up = np.array([sorted(range(len(v)), key=lambda i, d=d: v[i, d]) for d in range(width)])
                down = up[:, ::-1]
            for q, qid, quid in zip(e[is_query], ids[is_query], uids[is_query]):
                for score, place in search(v, vid, vuid, q, quid, k, down, up):
                    out["query_uid"].append(int(quid))
                    out["query_id"].append(int(qid))
                    out["vec_id"].append(int(vid[place]))
                    out["score"].append(max(-2 ** 63, min(2 ** 63 - 1, int(score))))
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})
    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose id is a multiple of `every`."""
    rows = kept(scaled(vectors), "fagin-vectors")
    is_query = F.col("vec_id") % every == 0
    n, queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(queries / QUERIES))

    def dealt(df: DataFrame, own: str, of: int, other: str, others: int, flag: bool) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(of)))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
        return df.select("block", "query_block", F.lit(flag).alias("is_query"), "uid", "vec_id", "e", F.size("e").alias("width"))
    grid = dealt(rows, "block", blocks, "query_block", query_blocks, False).unionByName(
        dealt(rows.where(is_query), "query_block", query_blocks, "block", blocks, True))
    found = grid.groupBy("block", "query_block").applyInArrow(_group(k), "query_uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT uid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM v),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM i q JOIN i c ON q.uid <> c.uid WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op9_top_k", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
