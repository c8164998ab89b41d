"""Exact top-k inner-product search by MaxScore over integer vectors, shard by shard, query block by query block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.common import top_k

from .common import stored

SHARD_ROWS, BLOCK_ROWS, CHUNK_ROWS = 8192, 1024, 2048


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of every component. Rows without an id or vector, or with a null or non-finite component, take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return whole.select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows (part, n, dims, ids, data), each with at most `rows` vectors as bytes; shorter vectors end in zeros."""

    def pack(batches):
        from pyspark import TaskContext

        part, held, k = TaskContext.get().partitionId(), [], 0

        def row(some):
            dims = max(len(v) for _, v in some)
            data = np.zeros((len(some), dims), np.int64)
            for i, (_, v) in enumerate(some):
                data[i, : len(v)] = v
            small = np.abs(data).max(initial=0) < 1 << 15
            ids = np.array([i for i, _ in some], np.int64)
            return pd.DataFrame({"part": [(part << 32) | k], "n": [len(some)], "dims": [dims], "wide": [not small], "ids": [ids.tobytes()], "data": [data.astype(np.int16 if small else np.int64).tobytes()]})

        for pdf in batches:
            held += zip(pdf["id"], pdf["v"], strict=True)
            while len(held) >= rows:
                yield row(held[:rows])
                held, k = held[rows:], k + 1
        if held:
            yield row(held)

    return stored(vectors.mapInPandas(pack, "part long, n int, dims int, wide boolean, ids binary, data binary"), name)


def _matrix(n: int, dims: int, wide: bool, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64 if wide else np.int16).reshape(n, dims).astype(np.int64)


class Shard:
    """The postings of one shard: for each dimension the components of its vectors, chunk by chunk, with the largest of either sign."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, dims: int):
        order = np.argsort(ids, kind="stable")
        full = np.zeros((len(ids), dims), np.int64)
        full[:, : data.shape[1]] = data[order]
        self.ids = ids[order]
        self.chunks = []
        for i in range(0, len(ids), CHUNK_ROWS):
            part = np.ascontiguousarray(full[i : i + CHUNK_ROWS].T)
            self.chunks.append((i, part, part.max(axis=1), part.min(axis=1)))

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (rows, scores) for `q`, best first, ties to the smaller id; rows with the query's own id take no part.

        A term is a dimension; its bound in a chunk is the most it can add to a score. With `worst` the k-th score so far, the terms of
        least bound whose bounds add up to less than `worst` are non-essential: vectors that score on them alone cannot enter. The
        essential postings are traversed for the chunk; then the others, largest bound first, are probed only for the vectors whose
        score so far and the bounds still open reach `worst`. A bound of a term may be negative, as scores may be.
        """
        best_rows, best = np.empty(0, np.int64), np.empty(0, np.int64)
        for first, part, high, low in self.chunks:
            bound = np.maximum(q * high, q * low)
            order = np.argsort(bound, kind="stable")
            worst = best[k - 1] if len(best) >= k else None
            essential = order
            if worst is not None:
                sums = np.cumsum(bound[order])
                if sums[-1] < worst:
                    continue
                essential = order[int(np.argmax(sums >= worst)) :]
            score = np.zeros(part.shape[1], np.int64)
            for t in essential[::-1]:
                if q[t]:
                    score += q[t] * part[t]
            rest = order[: len(order) - len(essential)]
            open_bound = int(bound[rest].sum())
            at = np.arange(len(score)) if worst is None else np.flatnonzero(score + open_bound >= worst)
            score = score[at]
            for t in rest[::-1]:
                score = score + q[t] * part[t][at]
                open_bound -= int(bound[t])
                live = score + open_bound >= worst
                if not live.all():
                    at, score = at[live], score[live]
                if not len(at):
                    break
            mine = self.ids[first + at] != own
            rows, score = np.concatenate([best_rows, first + at[mine]]), np.concatenate([best, score[mine]])
            if len(score) > 4 * k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[score >= cut], score[score >= cut]
            ranked = np.lexsort((self.ids[rows], -score))[:k]
            best_rows, best = rows[ranked], score[ranked]
        return best_rows, best


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = BLOCK_ROWS, rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row (id, v) of `queries` the k rows of `vectors` with the largest inner product.

    Vectors are packed into shards and queries into blocks of fixed size; each pair of a shard and a block is one row of a join on the
    numbers of both, so no task holds more than one of each. What shards hand on (k rows a query) is merged by rank. Ties go to the
    smaller vec_id; repeated rows of `vectors` are candidates of their own; of repeated query ids one counts (the least vector). Vectors
    with fewer components count as ending in zeros. Fewer than k candidates give fewer rows; no query or no vector gives none.
    """
    shards = packed(vectors, rows, "maxscore-shards")
    blocks = packed(queries.groupBy("id").agg(F.min("v").alias("v")), block, "maxscore-blocks")
    n_shards, n_blocks = max(1, shards.count()), max(1, blocks.count())
    place = lambda n: F.pmod(F.xxhash64("part"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = blocks.select(place(n_blocks).alias("block"), every(n_shards).alias("shard"), *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "wide", "ids", "data")])
    pairs = shards.withColumn("shard", place(n_shards)).withColumn("block", every(n_blocks)).join(asked, ["block", "shard"])

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q_ids, q = _matrix(r.q_n, r.q_dims, r.q_wide, r.q_ids, r.q_data)
                ids, data = _matrix(r.n, r.dims, r.wide, r.ids, r.data)
                dims = max(r.q_dims, r.dims)
                shard = Shard(ids, data, dims)
                out = []
                for own, v in zip(q_ids, np.pad(q, ((0, 0), (0, dims - q.shape[1]))), strict=True):
                    found, score = shard.search(int(own), v, k)
                    out.append(pd.DataFrame({"query_id": own, "vec_id": shard.ids[found], "score": score}))
                yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long")
    ranked = top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id").asc()], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
