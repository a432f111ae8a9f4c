"""Exact top-k by inner product with no-random-access aggregation.

Candidates are cut into blocks, queries into chunks, and each pair meets in one task. There every
dimension is a list of the block's rows sorted by what they add to a query's score. All lists are
read in step. A row's score is then known up to its unread dimensions, each of which can add at
most the value at the list's head and at least its last value. Once the rows that can still
reach the k-th best lower bound are few, nothing more is read and their scores are completed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wearline.llm.shared import limit_batches

BLOCK_ROWS = 2048
CHUNK_ROWS = 4096
# Shares of the lists after which bounds are compared; early ones rarely decide.
STOPS: Sequence[float] = (0.3, 0.5, 0.7, 0.8, 0.87, 0.92, 0.96, 1.0)


class Block:
    """Sorted lists of a block of integer vectors, one per dimension.

    ``place`` holds every entry's place in its ascending list. A list read to a depth has shown
    the entries with places within the depth, from the end that the query's sign asks for.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        order = np.argsort(values, axis=0, kind="stable")
        kind = np.int16 if len(ids) < 1 << 15 else np.int32
        self.place = np.empty(values.shape, kind)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=kind)[:, None], 0)
        # Bounds are kept in single precision, with a slack for its rounding; scores are exact.
        self.sorted = np.take_along_axis(values, order, 0).astype(np.float32)
        self.numbers = values.astype(np.float32)
        self.reversed = (len(ids) - 1 - self.place).astype(kind)
        self.first = 0  # the stop at which bounds are compared first

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(ids, scores, share of the lists read) of the k best rows other than the query's id.

        Ties at the k-th place go to smaller ids.
        """
        other = self.ids != query_id
        if not query.any() or other.sum() <= k:
            open_rows, read = np.flatnonzero(other), 0.0
        else:
            open_rows, read = self._read(query, other, k)
        scores = self.values[open_rows] @ query
        order = np.lexsort((self.ids[open_rows], -scores))[:k]
        return self.ids[open_rows][order], scores[order], read

    def _read(self, query: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Rows that can still be among the k best once they are few, and the share read."""
        n, weights = len(self.ids), query.astype(np.float32)
        down = weights > 0  # best first: from the large end where the weight is positive
        columns = self.sorted * weights
        depth = np.where(down, self.reversed, self.place)
        worst = np.where(down, columns[0], columns[-1])
        above = self.numbers * weights - worst  # what reading an entry adds to its least
        least = worst.sum()
        slack = np.float32(1e-6) * len(query) * np.abs(columns[[0, -1]]).max(0).sum()
        # Queries on a block stop at about the same depth; one step earlier is tried each time.
        for stop in range(self.first, len(STOPS)):
            at = min(n, int(np.ceil(STOPS[stop] * n)))
            read = (depth < at).astype(np.float32)
            lower = least + np.einsum("ij,ij->i", read, above)
            room = np.where(down, columns[n - 1 - at], columns[at]) - worst if at < n else 0 * worst
            upper = lower + (room.sum() - read @ room)
            kth = np.partition(lower[other], -k)[-k] - 2 * slack
            open_rows = np.flatnonzero((upper >= kth) & other)
            if len(open_rows) <= max(4 * k, n // 32):
                break
        self.first = max(0, stop - 1)
        return open_rows, at / n


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k best candidates of each query: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id`` and ``embedding``. Scores are inner products of the components as
    floor(256 x), which must fit a long. Ties go to smaller ids; a query with fewer candidates
    gets all. A row with a null id, null vector, or a null or non-finite component takes no part;
    a shorter vector counts as ended by zeros. Rows with the query's id are not its candidates;
    a query given twice counts once. Without queries there are no rows.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    valid = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = valid.where(is_query).select("vec_id", whole_numbers(F.col("embedding")).alias("numbers"))
    asked = asked.dropDuplicates()
    rows = valid.select("vec_id", whole_numbers(F.col("embedding")).alias("numbers"))
    blocks = max(1, -(-valid.count() // BLOCK_ROWS))
    chunks = max(1, -(-asked.count() // CHUNK_ROWS))

    def dealt(frame: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """Each row in its own block or chunk, once for every one of the other side."""
        own_number = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own)
        return frame.select("*", own_number, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    candidates = dealt(rows, "block", blocks, "chunk", chunks).groupBy("block", "chunk")
    queries = dealt(asked, "chunk", chunks, "block", blocks).groupBy("block", "chunk")

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(candidates) and len(queries):
            lists = [candidates["numbers"], queries["numbers"]]
            width = max(max(map(len, c.to_pylist()), default=0) for c in lists)
            ids = candidates["vec_id"].to_numpy()
            block = Block(ids, _matrix(lists[0], width))
            for query_id, query in zip(queries["vec_id"].to_pylist(), _matrix(lists[1], width)):
                found, scores, _ = block.best(query_id, query, k)
                out[0] += [query_id] * len(found)
                out[1] += found.tolist()
                out[2] += scores.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    found = candidates.cogroup(queries).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
