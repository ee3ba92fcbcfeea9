"""Exact top-k by inner product, pruned with segment statistics from coarse to fine.

Vectors are cut into equal segments. With a segment's mean and deviation of a query and a candidate (m entries),
(q - v)^2 over the segment is at least m * ((mean_q - mean_v)^2 + (dev_q - dev_v)^2): a lower bound on the distance, which
with the exact norms is an upper bound on the inner product, m * (mean_q * mean_v + dev_q * dev_v). Few wide segments
bound first, more narrow ones bound what is left, and only survivors get the exact product. The bounds are taken with a
margin above their rounding error, so no true neighbour is lost.

Queries and candidates are packed into blocks of bounded size and written once. Query blocks come in waves of at most
``WAVE_BYTES``, broadcast; each task compares a wave with its own candidate blocks, which are never shuffled again, and hands
on at most k rows per query. Bounds are compared with the k-th best exact score of all blocks that the task has seen. The
driver holds one wave, whatever the number of vectors. Waves follow each other and write their result to the shared folder.

Results: null vectors and vectors with null or non-finite components take no part; vectors of another length than the
query's are no candidates; a query with fewer than k candidates gives them all; ties go to the smaller id. Rows that
share an id are candidates each, but none of them of a query with that id. An empty table gives no rows. Components whose
integer needs over 62 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.lineage import cut

EXACT = float(1 << 53)
#: Bytes of the query blocks that are compared at a time (a single block may be larger).
WAVE_BYTES = 16 << 20


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component as double, without the vectors that take no part."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < float(1 << 62) / scale, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for an integer of 64 bits")).cast("long"))
    return (vectors.where(F.col(vector_col).isNotNull() & sound & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, whole).cast("array<long>").alias("v")))


def _packed(rows: DataFrame, block: Column, ids: str, data: str, key: str) -> DataFrame:
    """One row per (dim, block): ids and matrix as bytes."""

    def pack(t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks()
        flat = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten()
        return pa.table({"dim": [t["dim"][0].as_py()], key: [t[key][0].as_py()], ids: [t["vec_id"].to_numpy().astype("<i8").tobytes()],
                         data: [flat.to_numpy(zero_copy_only=False).astype("<i8").tobytes()]},
                        schema=pa.schema([("dim", pa.int32()), (key, pa.int64()), (ids, pa.binary()), (data, pa.binary())]))

    return rows.withColumn(key, block).groupBy("dim", key).applyInArrow(pack, f"dim int, {key} long, {ids} binary, {data} binary")


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that their inner product bounds the vectors' inner product."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = [(x[:, a:b], b - a) for a, b in zip(edges, edges[1:]) if b > a]
    return np.hstack([np.stack([p.mean(axis=1), p.std(axis=1)], axis=1) * np.sqrt(m) for p, m in parts])


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels: tuple[int, ...],
                  least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, candidate ids, scores) of the k best candidates of this block, per query; those below ``least``, a score per query, may be left out."""
    dim = q.shape[1]
    if not dim:
        exact = lambda a, b: np.zeros((len(a), len(b)), np.int64)
    elif dim * float(np.abs(q).max()) * float(np.abs(c).max()) < EXACT:
        exact = lambda a, b: (a.astype(float) @ b.astype(float).T).astype(np.int64)
    else:
        exact = lambda a, b: a @ b.T
    fq, fc = q.astype(float), c.astype(float)
    margin = 1e-9 * np.linalg.norm(fq, axis=1) * (np.linalg.norm(fc, axis=1).max() if len(c) else 0) + 1e-6
    alive = q_ids[:, None] != c_ids[None, :]
    floor, new = least, True
    for segments in (s for s in levels if s < dim):
        bound = _stats(fq, segments) @ _stats(fc, segments).T
        bound[~alive] = -np.inf
        if new and len(c) > 4 * k:
            # exact scores of the k most promising candidates set a first threshold
            first = np.argpartition(-bound, k, axis=1)[:, :k]
            scores = np.einsum("qd,qkd->qk", fq, fc[first])
            scores[~np.take_along_axis(alive, first, axis=1)] = -np.inf
            floor, new = np.maximum(least, scores.min(axis=1)), False
        alive &= bound >= (floor - margin)[:, None]
    rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    score = exact(q[rows], c[cols])
    for i, r in enumerate(rows):
        left = np.flatnonzero(alive[r, cols])
        s, ids = score[i, left], c_ids[cols[left]]
        if len(s) > 4 * k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            s, ids = s[keep], ids[keep]
        best = np.lexsort((ids, -s))[:k]
        yield r, ids[best], s[best]


def fanned(blocks: DataFrame) -> DataFrame:
    """Dealt out by the session's shuffle width: a few large rows would else be read by as few tasks."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _waves(queries: DataFrame) -> list[list[tuple[int, int]]]:
    """The (dim, qb) of the query blocks, in lists of at most ``WAVE_BYTES``."""
    waves, left = [], 0
    for r in sorted(queries.select("dim", "qb", (F.length("q") + F.length("q_ids")).alias("n")).collect()):
        if not waves or r["n"] > left:
            waves.append([])
            left = WAVE_BYTES
        waves[-1].append((r["dim"], r["qb"]))
        left -= r["n"]
    return waves


def _broadcast(queries: DataFrame, wave: list[tuple[int, int]]) -> Broadcast:
    """dim -> (ids, vectors) of each of a wave's query blocks."""
    rows = queries.where(F.col("dim").isin([d for d, _ in wave]) & F.col("qb").isin([b for _, b in wave])).select("dim", "qb", "q_ids", "q").collect()
    blocks: dict[int, list] = {}
    for r in rows:
        if (r["dim"], r["qb"]) in set(wave):
            blocks.setdefault(r["dim"], []).append((bytes(r["q_ids"]), bytes(r["q"])))
    return queries.sparkSession.sparkContext.broadcast(blocks)


def _compared(shared: Broadcast, k: int, levels: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate blocks (dim, c_ids, c) to the k best of a task's blocks for each query of the wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = {dim: [(np.frombuffer(ids, "<i8"), np.frombuffer(q, "<i8").reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0), np.int64))
                      for ids, q in blocks] for dim, blocks in shared.value.items()}
        best: dict[tuple[int, int], list] = {(dim, i): [None] * len(ids) for dim, blocks in wave.items() for i, (ids, _) in enumerate(blocks)}
        least = {(dim, i): np.full(len(ids), -np.inf) for dim, blocks in wave.items() for i, (ids, _) in enumerate(blocks)}
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            c_ids = np.frombuffer(row["c_ids"], "<i8")
            c = np.frombuffer(row["c"], "<i8").reshape(len(c_ids), row["dim"])
            for i, (q_ids, q) in enumerate(wave.get(row["dim"], ())):
                own, floor = best[row["dim"], i], least[row["dim"], i]
                for r, ids, score in best_of_block(q_ids, q, c_ids, c, k, levels, floor):
                    if own[r] is not None:
                        ids, score = np.concatenate([own[r][0], ids]), np.concatenate([own[r][1], score])
                        top = np.lexsort((ids, -score))[:k]
                        ids, score = ids[top], score[top]
                    own[r] = ids, score
                    if len(score) == k:
                        floor[r] = score[-1]
        for (dim, i), own in best.items():
            q_ids = wave[dim][i][0]
            full = [r for r, x in enumerate(own) if x is not None]
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[full], [len(own[r][0]) for r in full]), pa.int64()),
                                                  pa.array(np.concatenate([own[r][0] for r in full]), pa.int64()),
                                                  pa.array(np.concatenate([own[r][1] for r in full]), pa.int64())], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                scale: float = 256.0, levels: tuple[int, ...] = (4, 16), query_block: int = 2048,
                block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row that ``is_query`` (over vec_id) selects."""
    v = cut(quantised(vectors, id_col, vector_col, scale))
    counts = v.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    n_blocks, n_queries = max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // query_block))
    numbered = F.xxhash64("vec_id")
    numbered = F.xxhash64("vec_id")
    candidates = cut(fanned(_packed(v, F.pmod(numbered, F.lit(n_blocks)), "c_ids", "c", "cb")))
    queries = cut(_packed(v.where(is_query), F.pmod(numbered, F.lit(n_queries)), "q_ids", "q", "qb"))
    schema = "query_id long, vec_id long, score long"
    found = [cut(candidates.select("dim", "c_ids", "c").mapInArrow(_compared(_broadcast(queries, wave), k, levels), schema)) for wave in _waves(queries) or [[]]]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
