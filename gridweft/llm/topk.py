"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are put in the order of their largest dimensions, so that vectors that point the same way stand together,
and cut into blocks, each with the least and greatest value of every dimension. For a query, the sum of what each
dimension can add at most bounds a block. Blocks are visited from the highest bound on and scored through their
vectors, until no bound reaches the k-th score found.

A unit of work is a group of candidates and a block of queries, so that neither the query set nor the candidates are
ever held whole; each unit gives k rows a query, which a ranking over the query's rows merges. Groups are dealt by hash,
so each has a share of every direction and finds a k-th score close to that of all candidates in its first blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors in a block, in a group of blocks, and queries in a unit.
BLOCK, GROUP, QUERIES = 256, 16384, 4096
#: Components from this size on are an error, as are scores that don't fit 64 bits.
LARGEST = float(2**62)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null, NaN or infinite components."""
    value = lambda x: F.floor(x.cast("double") * scale)
    too_large = lambda x: F.raise_error(F.concat(F.lit("a component is too large for a 64-bit score: "), x.cast("string")))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(
        vector.isNotNull() & F.coalesce(fine, F.lit(False)),
        F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < LARGEST, value(x)).otherwise(too_large(x).cast("long"))),
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), width), np.int64)
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(column: pa.ChunkedArray) -> int:
    return max((int(c.value_lengths().to_numpy(zero_copy_only=False).max()) for c in column.chunks if len(c)), default=0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: in doubles where every sum stays below 2**53, else in Python's integers."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def _scores(a: np.ndarray, b: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """_exact() as 64-bit integers, with 0 for pairs that are left out."""
    out = _exact(a, b)
    if out.dtype == object:
        out[left_out] = 0
        if out.size and max(out.max(), -out.min()) >= 2**63:
            raise OverflowError("a score doesn't fit 64 bits")
    return out.astype(np.int64)


def in_blocks(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An order of vectors by their three largest dimensions and their signs, by ids within each block."""
    largest = np.argsort(-np.abs(vectors), axis=1, kind="stable")[:, :3]
    signed = 2 * largest + (np.take_along_axis(vectors, largest, 1) < 0)
    order = np.lexsort((ids, *signed.T[::-1]))
    return order[np.lexsort((ids[order], np.arange(len(ids)) // BLOCK))]


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best vectors of each query, best first, and how many blocks were scored for a query in all.

    ``ids`` ascend within each block of rows. A query's own id is no candidate; places without a candidate have id -1.
    """
    low = np.iinfo(np.int64).min
    top, who = np.full((len(queries), k), low), np.full((len(queries), k), -1, np.int64)
    starts = np.arange(0, len(vectors), BLOCK)
    most, least = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    bounds = _exact(np.maximum(queries, 0), most) + _exact(np.minimum(queries, 0), least)
    order = np.argsort(-bounds, axis=1, kind="stable")
    visits = 0
    for rank in range(len(starts)):
        block = order[:, rank]
        bound = bounds[np.arange(len(queries)), block]
        # An equal bound may still hold an equal score with a smaller id.
        open_ = np.flatnonzero((bound >= top[:, -1]) | (who[:, -1] < 0))
        if not len(open_):
            break
        visits += len(open_)
        for b in np.unique(block[open_]):
            rows = open_[block[open_] == b]
            own = slice(starts[b], starts[b] + BLOCK)
            found = ids[own]
            same = found[None, :] == query_ids[rows][:, None]
            scores = _scores(queries[rows], vectors[own], same)
            best = np.argsort(np.where(same, np.iinfo(np.int64).max, -scores), axis=1, kind="stable")[:, :k]
            new, new_ids = np.take_along_axis(scores, best, 1), found[best]
            new_ids = np.where(np.take_along_axis(same, best, 1), -1, new_ids)
            scores = np.concatenate([top[rows], np.where(new_ids < 0, low, new)], axis=1)
            owners = np.concatenate([who[rows], new_ids], axis=1)
            by = np.argsort(np.where(owners < 0, np.iinfo(np.int64).max, owners), axis=1, kind="stable")
            scores, owners = np.take_along_axis(scores, by, 1), np.take_along_axis(owners, by, 1)
            by = np.argsort(-np.maximum(scores, low + 1), axis=1, kind="stable")[:, :k]
            top[rows], who[rows] = np.take_along_axis(scores, by, 1), np.take_along_axis(owners, by, 1)
    return top, who, visits


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k highest inner products of every query: (query_id, rank, vec_id, score); fewer where candidates are fewer.

    Components are floor(scale * x); one of 2**62 or more, and a score beyond 64 bits, is an error. Ties go to the smaller id. Vectors that are null or hold null,
    NaN or infinite components, and rows without an id, take no part; an empty vector, and what a shorter vector lacks,
    counts as zeros. A query id that is repeated is asked once, with its least vector; a candidate that is repeated
    counts each time. Rows with the query's id are no candidates. Other columns are not read. Empty tables give no rows.
    """
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows, asked = named(vectors), named(queries).groupBy("id").agg(F.min("v").alias("v"))
    groups, blocks = -(-max(1, vectors.count()) // GROUP), -(-max(1, queries.count()) // QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")).withColumn("q", every(blocks))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("g", every(groups))

    def unit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        width = max(_width(left.column("v")), _width(right.column("v")), 1)
        ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        among = _matrix(left.column("v"), width)
        order = in_blocks(among, ids)
        top, who, _ = search(_matrix(right.column("v"), width), query_ids, among[order], ids[order], k)
        found = who >= 0
        return pa.table([pa.array(np.repeat(query_ids, k).reshape(-1, k)[found]), pa.array(who[found]), pa.array(top[found])], names=names)

    found = rows.groupBy("g", "q").cogroup(asked.groupBy("g", "q")).applyInArrow(unit, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the 5 nearest of every vector whose id is divisible by 50, among all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
