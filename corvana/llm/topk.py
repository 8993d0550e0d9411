"""Exact top-k inner products by columnar branch-and-bound.

Vectors of one length are packed into blocks in vertical layout (one row a dimension). A block of queries stays in a task and
the blocks of candidates of a chunk stream past it, so that candidates are copied once for `QUERY_BLOCK` queries and no pair
of vectors is ever a row. Both are turned to the axes along which the queries have most of their mass (an orthogonal change
leaves inner products alone), axes in order of that mass. Scores grow by blocks of dimensions; what is still to come is at
most the product of the remaining norms, so candidates whose upper bound falls under the bound are dropped and the rest
compacted. The bound is the query's k-th best score so far, carried from block to block. Survivors are scored exactly on
their integers. The best k of each chunk merge by query.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of different lengths
do not meet. Ties go to the smaller vec_id. Rows that share the query's vec_id are never its candidates. Equal rows are one
query, and a candidate each. Rows with a null vec_id take no part. A table without queries gives an empty result. Scores
beyond 64 bits are clipped to them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

SCALE, DIMENSIONS = 1024, 16
#: Candidates and queries of a block.
LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 256, 32_768, 2048
#: Bytes of a block of either, which bound its vectors where these are long.
BLOCK_BYTES = 32_000_000
#: Blocks of candidates that one task streams past a block of queries.
CHUNK = 8
#: Vectors of up to so many components are turned to the queries' axes; longer ones have their own axes put in order.
TURNED = 512


def valid(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer components of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def packed(rows: DataFrame, block: Column) -> DataFrame:
    """(size, block, ids, matrix): each block's vectors in vertical layout, as 64-bit numbers."""
    keyed = rows.select("vec_id", "v", F.size("v").alias("size"), block.cast("int").alias("block"))

    def pack(key, t):
        ids = t["vec_id"].to_numpy().astype(np.int64)
        size = key[0].as_py()
        flat = t["v"].combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        matrix = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), size)
        return pa.table({"size": pa.array([size], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([np.ascontiguousarray(matrix.T).tobytes()], pa.binary())})

    return keyed.groupBy("size", "block").applyInArrow(pack, "size int, block int, ids binary, matrix binary")


def axes(queries: np.ndarray) -> np.ndarray:
    """Orthogonal axes (rows) in falling order of the mass that queries (one a column) have along them."""
    size = len(queries)
    if size <= TURNED:
        _, found = np.linalg.eigh(queries @ queries.T)
        return found.T[::-1]
    return np.eye(size)[np.argsort(-(queries**2).sum(1), kind="stable")]


class Search:
    """A block of queries, and the best k of what has streamed past them."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, step: int = DIMENSIONS):
        self.ids, self.whole, self.k, self.step = ids, matrix, k, step
        self.most = float(np.abs(matrix).max(initial=0))
        self.axes = axes(matrix.astype(float))
        self.turned = self.axes @ matrix.astype(float)
        self.tails = self.rest(self.turned)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.done = self.full = 0  # dimensions of candidates that were looked at, and all there were

    def rest(self, m: np.ndarray) -> np.ndarray:
        """Norm of each column from each step on."""
        return np.array([np.sqrt((m[at:] ** 2).sum(0)) for at in range(0, len(m) + self.step, self.step)])

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        size = len(c)
        if float(np.abs(c).max(initial=0)) * self.most * max(size, 1) >= 2**52:
            for j in range(len(self.ids)):
                self.keep(j, *exact_large(self.whole[:, j], self.ids[j], c, ids))
            return
        exact, turned = c.astype(float), self.axes @ c.astype(float)
        tails = self.rest(turned)
        for j, own in enumerate(self.ids):
            q, alive = self.turned[:, j], np.flatnonzero(ids != own)
            known = self.best[j][1]
            bound = float(known[-1]) if len(known) == self.k else -np.inf
            score = np.zeros(len(alive))
            # The size of an error by rounding, and one for whole numbers.
            blur = 1 + 1e-12 * size * self.tails[0, j] * tails[0].max(initial=0)
            self.full += size * len(alive)
            for i, at in enumerate(range(0, size, self.step)):
                part = turned[at : at + self.step]
                score += q[at : at + self.step] @ (part if len(alive) == len(ids) else part[:, alive])
                self.done += len(part) * len(alive)
                slack = self.tails[i + 1, j] * tails[i + 1, alive] + blur
                if bound == -np.inf and len(alive) > self.k:
                    least = np.partition(score - slack, len(score) - self.k)[-self.k]
                else:
                    least = bound
                stay = score + slack >= least
                alive, score = alive[stay], score[stay]
            if len(alive):
                self.keep(j, ids[alive], (self.whole[:, j].astype(float) @ exact[:, alive]).astype(np.int64))

    def keep(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.best[j][0], ids]), np.concatenate([self.best[j][1], scores])
        order = np.lexsort((ids, np.invert(scores)))[: self.k]  # -x - 1, which never overflows
        self.best[j] = ids[order], scores[order]

    def batch(self) -> pa.RecordBatch:
        out = [np.repeat(self.ids, [len(x) for x, _ in self.best]), *(np.concatenate([b[i] for b in self.best]) for i in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])


def exact_large(q: np.ndarray, own: int, c: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores that pass what doubles hold exactly, clipped to 64 bits."""
    at = np.flatnonzero(ids != own)
    scores = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q, c[:, j], strict=True)))) for j in at]
    return ids[at], np.array(scores, np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for integer vectors (vec_id, v)."""
    # Equal rows would tie as queries; one of them asks. Candidates are numbered, so that equal ones are dealt evenly.
    asked = queries.select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    rows = saved(candidates.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "candidates")
    (n, longest), nq = rows.agg(F.count("*"), F.max(F.size("v"))).first(), asked.count()
    fits = max(1, BLOCK_BYTES // (8 * max(longest or 1, 1)))
    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // 64), fits)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-nq // min(QUERY_BLOCK, fits)))
    chunks = -(-blocks // CHUNK)
    left = packed(rows, F.pmod(F.xxhash64("row"), F.lit(blocks))).select("size", (F.col("block") % chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), (F.col("block") + 1).alias("block"), "ids", "matrix")
    right = packed(asked, F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks))).select("size", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.col("block").alias("q"), F.lit(0).alias("block"), "ids", "matrix")
    where = ["size", "q", "chunk"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, search = None, None
        for batch in batches:
            for size, q, chunk, number, ids, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(ids, np.int64)
                m = np.frombuffer(matrix, np.int64).reshape(size, len(found))
                if number == 0:
                    if search:
                        yield search.batch()
                    at, search = (size, q, chunk), Search(found, m, k)
                elif at == (size, q, chunk):
                    search.meet(found, m)
        if search:
            yield search.batch()

    dealt = left.unionByName(right).repartition(*where).sortWithinPartitions(*where, "block").select(*where, "block", "ids", "matrix")
    met = dealt.mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    vectors = saved(valid(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors, 10)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
           from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""
