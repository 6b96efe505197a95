"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are dealt into blocks.  A block keeps, for each dimension, its postings by falling
impact, the quantised size of the component; a segment is a run of postings of one impact.  A
query takes the segments of all dimensions in the order of the most they can change a score, down
to a limit.  What a vector has not been given yet is bounded by the next segment of each
dimension it is missing in, so all vectors that can still reach the k-th best exact score found
are known.  If they are few they are scored exactly, else more segments are processed, in the
end all.  Nothing is left out without that proof.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohort.session import written

BLOCK, QUERY_BLOCK = 16_384, 4096
#: Bits below the quantised impact.
SHIFT = 2
#: Shares of the postings that are processed before the proof is tried.
SHARES = (0.35, 0.55, 0.75)


def _matrix(block: pa.Array, i: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row numbers and vectors of one list of (id, row, vector)."""
    rows = block[i].values
    ids, numbers, vectors = (rows.field(k) for k in range(3))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return (ids.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False),
            flat.reshape(len(ids), dims))


class Block:
    """Vectors with their postings: for each dimension, the rows by falling quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None,
                 rows: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.rows = ids if rows is None else rows
        size = np.abs(vectors)
        shift = max(SHIFT, int(size.max(initial=0)).bit_length() - 8)
        level = size >> shift
        if order is None:
            order = np.argsort(-level, axis=0, kind="stable").T
        self.order = np.ascontiguousarray(order, np.uint32)
        self.step = 1 << shift
        dims = vectors.shape[1]
        self.values = np.take_along_axis(vectors, self.order.T.astype(np.int64), axis=0).T.copy()
        # postings of a level or more; the most that a posting of lower level can hold
        self.levels = int(level.max(initial=0)) + 1
        counts = np.stack([np.bincount(level[:, d], minlength=self.levels + 1)
                           for d in range(dims)])
        self.upto = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        # plain floats multiply faster and are exact below 2 ** 53
        self.plain = vectors.astype(np.float64)

    def segments(self, size: np.ndarray, limit: float) -> np.ndarray:
        """First level of each dimension that still can add ``limit`` or more to a score."""
        least = np.ceil((limit / np.maximum(size, 1e-300) + 1) / self.step) - 1
        return np.clip(least, 0, self.levels).astype(np.int64)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) without the row ``own``; ties go to the smaller id."""
        n, dims = self.vectors.shape
        other = self.rows != own
        query = query.astype(np.float64)
        size, each = np.abs(query), np.arange(dims)

        def exact(rows: np.ndarray) -> list[tuple[int, int]]:
            scores = self.plain[rows] @ query
            best = np.lexsort((self.ids[rows], -scores))[:k]
            return list(zip(scores[best].astype(np.int64).tolist(),
                            self.ids[rows][best].tolist()))

        for share in SHARES if n > 64 else ():
            low, high = 0.0, float((size * self.levels * self.step).max()) + 1
            for _ in range(10):  # the limit that takes about this share of the postings
                limit = (low + high) / 2
                taken = self.upto[each, self.segments(size, limit)].sum()
                low, high = (limit, high) if taken > share * n * dims else (low, limit)
            level = self.segments(size, limit)
            cut = self.upto[each, level]
            rest = size * np.where(cut < n, np.maximum(level * self.step - 1, 0), 0)
            rows = np.concatenate([self.order[d, :cut[d]] for d in range(dims)])
            given = np.concatenate([self.values[d, :cut[d]] * query[d] - rest[d]
                                    for d in range(dims)])
            most = rest.sum() + np.bincount(rows, given, n)
            most[~other] = -np.inf
            lead = np.argpartition(-most, 4 * k)[:4 * k]
            best = exact(lead[other[lead]])
            if len(best) == k:
                # bounds are sums of floats: leave room for their last digits
                possible = np.flatnonzero(most >= best[-1][0] - 1e-6 * (1 + abs(best[-1][0])))
                if len(possible) <= n // 4:
                    return exact(possible)
        return exact(np.flatnonzero(other))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the impact order of each dimension to the blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            dims = batch.column(0)[i].as_py()
            _, _, vectors = _matrix(batch.column(2), i, dims)
            order = Block(np.arange(len(vectors)), vectors).order.tobytes()
            part = batch.slice(i, 1)
            yield pa.record_batch([*part.columns, pa.array([order], pa.binary())],
                                  names=["dims", "block", "m", "impact"])


def _search(k: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and asked.num_rows:
            index = index.combine_chunks().to_batches()[0]
            dims = index.column("dims")[0].as_py()
            ids, numbers, vectors = _matrix(index.column("m"), 0, dims)
            block = Block(ids, vectors, np.frombuffer(
                index.column("impact")[0].as_py(), np.uint32).reshape(dims, len(ids)), numbers)
            for batch in asked.to_batches():
                for i in range(batch.num_rows):
                    q_ids, q_rows, queries = _matrix(batch.column("q"), i, dims)
                    for own, row, query in zip(q_ids.tolist(), q_rows.tolist(), queries):
                        out += [(row, own, vec, score)
                                for score, vec in block.top(query, row, k)]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(
            ("row", "query_id", "vec_id", "score"), columns)})

    return run


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256,
                       key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of every row whose key divides by
    ``every``, among all other rows, also those that repeat its key.

    Components become floor(scale * x).  Rows without key or vector, or with a null or
    non-finite component, take no part; vectors meet only vectors of their own length.  Rows
    that repeat a key each count as candidates and, if they are queries, each give an answer.
    Scores are exact as long as they stay below 2 ** 53.  Other columns are ignored.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    rows = (vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(key).cast("bigint").alias("id"), whole.alias("v"),
                    F.size(vector).alias("dims")).where(F.col("dims") > 0)
            .withColumn("row", F.monotonically_increasing_id()))
    rows = written(rows, "vectors")
    wanted = rows.where(F.col("id") % every == 0)
    n, n_queries = rows.count(), wanted.count()
    blocks, query_blocks = -(-n // BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    member = F.collect_list(F.struct("id", "row", "v")).alias("m")

    def dealt(df: DataFrame, count: int) -> DataFrame:
        return df.groupBy("dims", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
                          .alias("block")).agg(member)

    index = written(dealt(rows, blocks).select("dims", "block", "m").mapInArrow(
        _index, "dims int, block int, m array<struct<id:bigint,row:bigint,v:array<bigint>>>, "
                "impact binary"), "impact-index")
    asked = written(dealt(wanted, query_blocks).select(
        "dims", F.col("block").alias("tile"), F.col("m").alias("q")), "queries")
    # the stated query set meets every block of the index, tile by tile: a block of the index is
    # sent once for each tile of 4,096 queries, so bytes stay far below products
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["dims", "block", "tile"]
    tiles = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (index.withColumn("tile", tiles).repartition(parts, *keys).groupBy(*keys)
             .cogroup(asked.repartition(parts, *keys).groupBy(*keys))
             .applyInArrow(_search(k), "row bigint, query_id bigint, vec_id bigint, score bigint"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
