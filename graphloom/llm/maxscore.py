"""Exact top-k inner-product search by MaxScore over shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block at most (nearly); least number of shards; rows scored between updates of the threshold; terms probed at a time.
SHARD_ROWS, BLOCK_QUERIES, LEAST_SHARDS, STEP_ROWS, PROBE = 8192, 4096, 16, 1024, 8


class Shard:
    """Postings by term of some vectors: a column of values for each component, with its bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.asfortranarray(vectors[order])
        self.high, self.low = vectors.max(axis=0, initial=0), vectors.min(axis=0, initial=0)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those of id ``own``: highest score first, then smallest id.

        Terms are ordered by the most that they can add. Those of the least bounds whose sum cannot reach the current
        k-th score are non-essential: they are not traversed, but probed for the rows that are still competitive. The
        bound of a term is what its contribution may exceed its least value by, so negative products are covered.
        """
        most, least = np.maximum(query * self.high, query * self.low), np.minimum(query * self.high, query * self.low)
        order = np.argsort(least - most, kind="stable")
        none = np.zeros(1, most.dtype)
        rest = np.append(np.cumsum(most[order][::-1])[::-1], none)  # most that terms from here on add
        spread = np.append(np.cumsum((most - least)[order][::-1])[::-1], none)
        base = least.sum()
        best_ids, best = np.zeros(0, np.int64), none[:0]
        for at in range(0, len(self.ids), STEP_ROWS):
            floor = best[-1] if len(best) == k else -np.inf
            if rest[0] < floor:
                break
            essential = max(1, int(np.searchsorted(-(spread + base), -floor, "right"))) if np.isfinite(floor) else len(order)
            essential = min(essential, len(order))
            rows = np.arange(at, min(at + STEP_ROWS, len(self.ids)))
            terms = order[:essential]
            score = self.postings[rows[0] : rows[-1] + 1, terms] @ query[terms]
            keep = (score + rest[essential] >= floor) & (self.ids[rows] != own)
            rows, score = rows[keep], score[keep]
            for t in range(essential, len(order), PROBE):
                if not len(rows):
                    break
                terms = order[t : t + PROBE]
                score = score + self.postings[np.ix_(rows, terms)] @ query[terms]
                keep = score + rest[min(t + PROBE, len(order))] >= floor
                rows, score = rows[keep], score[keep]
            ids, scores = np.concatenate([best_ids, self.ids[rows]]), np.concatenate([best, score])
            pick = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[pick], scores[pick]
        return best_ids, best


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Rows of numbers of equal width; missing components are 0."""
    out = np.zeros((len(column), width), kind)
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of highest inner product, ties to the smaller vec_id.

    Both inputs have (vec_id, v) with v an array of whole numbers, null nowhere; shorter arrays count as padded with 0.
    A query's own vec_id is no candidate. Rows are dealt by hash to shards and queries to blocks; every pair of shard
    and block is searched by itself, and the shards' results are merged. Queries repeated in full are answered once, candidates
    that repeat count as often as they stand; an empty table gives an empty one. Scores are exact: they are summed as
    doubles where none can reach 2**53, else as 64-bit integers, and vectors whose scores could pass these are refused.
    """
    queries = queries.select(F.col("vec_id").alias("query_id"), "v").distinct().withColumn("query_key", F.xxhash64("query_id", "v"))
    largest = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    seen = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(largest)).first()
    asked = queries.count()
    width = max(1, seen[1] or 1)
    most = width * (seen[2] or 0.0) ** 2
    if most >= 2.0**62:
        raise ValueError("scores beyond 64-bit integers")
    kind = np.float64 if most < 2.0**53 else np.int64
    shards, blocks = max(LEAST_SHARDS, -(-seen[0] // SHARD_ROWS)), max(1, -(-asked // BLOCK_QUERIES))
    left = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_key", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        shard = Shard(rows["vec_id"].to_numpy().astype(np.int64), _matrix(rows["v"], width, kind))
        out = ([], [], [], [])
        for key, own, query in zip(asks["query_key"].to_pylist(), asks["query_id"].to_pylist(), _matrix(asks["v"], width, kind), strict=True):
            ids, scores = shard.top(query, own, k)
            for column, values in zip(out, ([key] * len(ids), [own] * len(ids), ids.tolist(), scores.astype(np.int64).tolist()), strict=True):
                column += values
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_key", "query_id", "vec_id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_key", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v) with v the floor of scale times each component; rows with a null id, a null vector or a component that is null or not finite are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c)).alias("v"))
