"""Hard negatives of anchors, with scores bounded along a spanning tree of the anchors.

For an anchor c with parent p in the tree, |<c, x> - <p, x>| <= |c - p| * |x|. So once the root's scores are known, every
anchor's score of every candidate lies in its parent's interval widened by the edge's length times the candidate's norm; only
candidates whose interval reaches a window that still matters are scored exactly, and their intervals shrink to a point. First
the windows are "at least the k-th best same-label score so far" (positives), then "between the least and the largest share of
a positive's score, and above the k-th best found so far" (negatives). Bounds carry a margin above their rounding error.

Anchors come in waves of bounded size, put together from neighbours (same label, same nearest pivot). A wave's anchors are sorted,
cut into blocks, joined by a minimum spanning tree each, and broadcast: at most ``wave`` rows, which is counted. Each task
compares them with its own part of the candidate table, which is never shuffled; a task hands on at most k rows per anchor and
positive. Waves follow each other and write their result to the shared folder, so a lost executor costs a task.

Results: rows with a null label, a null vector or a null or non-finite component take no part; neither anchor nor partner are
compared with vectors of another length. Other rows are all rows but the anchor itself, also those that share its id or vector.
Ties go to the smaller id, then to the row read first; null ids come last (and 2^63 - 1 counts as null). Scores beyond 64
bits raise an error. Anchors without positives or negatives have no rows; an empty table gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.functions.lineage import cut, shared_folder

EXACT = float(1 << 53)
NO_ID = (1 << 63) - 1
LOWEST = -(1 << 62)
PIVOTS = 64


def candidates(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row, vec_id, label, dim, v): floor(scale * x) of each component; ``row`` tells rows of one id apart."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < float(1 << 52) / scale, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for an integer of 52 bits")).cast("long"))
    return (vectors.where(F.col(vector_col).isNotNull()).where(sound).where(label.isNotNull())
            .select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"),
                    label.cast("long").alias("label"), F.size(x).alias("dim"), F.transform(x, whole).alias("v")))


@dataclass
class Block:
    """Anchors of one length with their spanning tree, level by level from the root."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    levels: list[np.ndarray]  # anchors of each depth
    parent: np.ndarray
    edge: np.ndarray


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max())
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= float(1 << 62):
        raise OverflowError("scores of these vectors need more than 64 bits")
    return a @ b.T


def spanning_tree(row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray) -> Block:
    """Minimum spanning tree of the anchors (Prim), rooted at the one nearest to their mean."""
    f, n = v.astype(float), len(v)
    root = int(np.argmin(((f - f.mean(axis=0)) ** 2).sum(axis=1)))
    parent, depth, edge = np.full(n, -1), np.zeros(n, int), np.zeros(n)
    near, by, out = np.full(n, np.inf), np.full(n, root), np.ones(n, bool)
    newest = root
    out[root] = False
    for _ in range(n - 1):
        far = np.sqrt(((f - f[newest]) ** 2).sum(axis=1))
        closer = out & (far < near)
        near[closer], by[closer] = far[closer], newest
        newest = int(np.argmin(np.where(out, near, np.inf)))
        parent[newest], depth[newest], edge[newest], out[newest] = by[newest], depth[by[newest]] + 1, near[newest], False
    return Block(row, vec_id, label, v, [np.flatnonzero(depth == k) for k in range(int(depth.max(initial=0)) + 1)], parent, edge)


def tree_scores(block: Block, v: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, candidates, exact scores) level by level. ``wanted(anchors, low, high)`` marks the candidates whose
    score, known to lie between low and high, still matters."""
    f = v.astype(float)
    norm = np.sqrt(np.einsum("nd,nd->n", f, f))
    reach = np.sqrt((block.v.astype(float) ** 2).sum(axis=1)) * 1e-12  # more than rounding can move a score, in candidate norms
    low, high = np.empty((len(block.row), len(v))), np.empty((len(block.row), len(v)))
    for depth, anchors in enumerate(block.levels):
        if depth:
            widen = (block.edge[anchors, None] * (1 + 1e-9) + reach[anchors, None]) * norm + 1e-6
            low[anchors], high[anchors] = low[block.parent[anchors]] - widen, high[block.parent[anchors]] + widen
            open_ = wanted(anchors, low[anchors], high[anchors])
            columns = np.flatnonzero(open_.any(axis=0))
            anchors = anchors[open_.any(axis=1)]
        else:
            columns = np.arange(len(v))
        if len(anchors) and len(columns):
            exact = dots(block.v[anchors], v[columns])
            low[np.ix_(anchors, columns)] = high[np.ix_(anchors, columns)] = exact
            yield anchors, columns, exact


class Best:
    """The k best (score, id, row) of each slot, ties to the smaller id, then row."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), LOWEST, np.int64)
        self.vec_id = np.full((slots, k), NO_ID, np.int64)
        self.row = np.full((slots, k), NO_ID, np.int64)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, slot: int, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        reach = score >= self.score[slot, -1]
        if not reach.any():
            return  # also where there is no score at all
        score, vec_id, row = score[reach], vec_id[reach], row[reach]
        if len(score) > 4 * self.k:
            top = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, vec_id, row = score[top], vec_id[top], row[top]
        score, vec_id, row = (np.concatenate([a[slot], b]) for a, b in ((self.score, score), (self.vec_id, vec_id), (self.row, row)))
        best = np.lexsort((row, vec_id, -score))[:self.k]
        self.score[slot], self.vec_id[slot], self.row[slot] = score[best], vec_id[best], row[best]


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, vec_id, label, matrix) of slices of at most ``most`` candidates of one length."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            same = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
            for start in range(0, same.num_rows, most):
                part = same.slice(start, most)
                yield (*(part.column(c).to_numpy() for c in ("row", "vec_id", "label")),
                       part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(part.num_rows, int(dim)))


def find_positives(blocks: list[Block], batches: Iterator[pa.RecordBatch], k: int, most: int) -> list[Best]:
    """Per block: each anchor's k best rows of its own label among these candidates."""
    best = [Best(len(b.row), k) for b in blocks]
    labels = [np.unique(b.label) for b in blocks]
    for row, vec_id, label, v in _parts(batches, most):
        for b, found, own in zip(blocks, best, labels):
            if b.v.shape[1] != v.shape[1]:
                continue
            pick = np.flatnonzero(np.isin(label, own))
            if not len(pick):
                continue
            r, i, lab, x = row[pick], vec_id[pick], label[pick], v[pick]
            partner = lambda a: (lab == b.label[a, None]) & (r != b.row[a, None])
            for anchors, columns, exact in tree_scores(b, x, lambda a, low, high: partner(a) & (high >= found.floor()[a, None])):
                ok = partner(anchors)[:, columns] & (exact >= found.floor()[anchors, None])
                for at in np.flatnonzero(ok.any(axis=1)):
                    c = columns[ok[at]]
                    found.add(anchors[at], exact[at, ok[at]], i[c], r[c])
    return best


def find_negatives(blocks: list[Block], windows: list[tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch], k: int, most: int) -> list[Best]:
    """Per block: for each anchor and positive the k best rows of other labels with a score inside its window
    (``windows``: least and largest score, anchors x positives; an empty window has least above largest)."""
    best = [Best(w[0].size, k) for w in windows]
    for row, vec_id, label, v in _parts(batches, most):
        for b, found, (least, largest) in zip(blocks, best, windows):
            if b.v.shape[1] != v.shape[1]:
                continue
            p = least.shape[1]

            def hull(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Least and largest score that still matters to any window of the anchors."""
                floor = np.maximum(least[a], found.floor().reshape(-1, p)[a])
                open_ = floor <= largest[a]
                return np.where(open_, floor, NO_ID).min(axis=1)[:, None], np.where(open_, largest[a], LOWEST).max(axis=1)[:, None]

            def wanted(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                lowest, highest = hull(a)
                return (high >= lowest) & (low <= highest) & (label != b.label[a, None])

            for anchors, columns, exact in tree_scores(b, v, wanted):
                lowest, highest = hull(anchors)
                ok = (exact >= lowest) & (exact <= highest) & (label[columns] != b.label[anchors, None])
                for at in np.flatnonzero(ok.any(axis=1)):
                    c, s = columns[ok[at]], exact[at, ok[at]]
                    for j in range(p):
                        inside = (s >= least[anchors[at], j]) & (s <= largest[anchors[at], j])
                        found.add(anchors[at] * p + j, s[inside], vec_id[c[inside]], row[c[inside]])
    return best


def _nearest_pivot(anchors: DataFrame) -> DataFrame:
    """Adds ``cell``: the nearest of at most ``PIVOTS`` anchors (least hashes), which only decides who shares a block."""
    pivots = [(r["dim"], np.array(r["v"], float)) for r in anchors.orderBy(F.xxhash64("row")).limit(PIVOTS).select("dim", "v").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            dims, flat = batch.column("dim").to_numpy(), batch.column("v")
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                near = [(k, p) for k, (d, p) in enumerate(pivots) if d == dim]
                if near and dim:
                    x = flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(dim)).astype(float)
                    centres = np.stack([p for _, p in near])
                    cells[at] = np.array([k for k, _ in near])[np.argmin((centres ** 2).sum(axis=1) - 2 * x @ centres.T, axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    return anchors.mapInArrow(run, "row long, vec_id long, label long, dim int, v array<long>, cell int")


def _waves(anchors: DataFrame, wave: int, block: int) -> tuple[DataFrame, int]:
    """The anchors, written with the number of their wave; neighbours share a wave, none has over ``wave`` rows."""
    placed = cut(_nearest_pivot(anchors))
    group = ["dim", "label", "cell"]
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    # a group of neighbours is dealt in parts of about a block, so that no label fills a wave
    dealt = placed.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / block))).drop("size")
    n = max(1, -(-placed.count() // wave) * 2 - 1)
    while True:
        numbered = dealt.withColumn("wave", F.pmod(F.xxhash64(*group, "part"), F.lit(n)))
        if (numbered.groupBy("wave").count().agg(F.max("count")).first()[0] or 0) <= wave:
            return cut(numbered), n
        n *= 2


def _blocks(rows: list, block: int) -> list[Block]:
    """A wave's anchors in blocks of one length, a label with many anchors in blocks of its own."""
    rows = sorted(rows, key=lambda r: (r["dim"], r["label"], r["cell"], r["row"]))
    out, start = [], 0
    while start < len(rows):
        end = start + 1
        while end < len(rows) and end - start < block and rows[end]["dim"] == rows[start]["dim"]:
            if rows[end]["label"] != rows[end - 1]["label"] and end - start >= block // 8:
                break
            end += 1
        mine = rows[start:end]
        columns = (np.array([r[c] for r in mine], np.int64) for c in ("row", "vec_id", "label"))
        out.append(spanning_tree(*columns, np.array([r["v"] for r in mine], np.int64).reshape(len(mine), mine[0]["dim"])))
        start = end
    return out


def _best_rows(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


def mine_wave(spark: SparkSession, rows: DataFrame, blocks: list[Block], positives: int, negatives: int, share: tuple[int, int], most: int) -> DataFrame:
    """Negatives of one wave's anchors against all ``rows``."""
    trees = spark.sparkContext.broadcast(blocks)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in zip(trees.value, find_positives(trees.value, batches, positives, most)):
            at, k = np.nonzero(found.score > LOWEST)
            yield _best_rows(["anchor", "score", "vec_id", "row"], [b.row[at], found.score[at, k], found.vec_id[at, k], found.row[at, k]])

    order = [F.desc("score"), "vec_id", "row"]
    best = rows.mapInArrow(same, "anchor long, score long, vec_id long, row long").withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
    place = {int(r): (n, at) for n, b in enumerate(blocks) for at, r in enumerate(b.row)}
    scores = [np.full((len(b.row), positives), LOWEST, np.int64) for b in blocks]
    ids = [np.full((len(b.row), positives), NO_ID, np.int64) for b in blocks]
    for r in best.where(F.col("k") <= positives).collect():  # at most `positives` rows for each anchor of the wave
        n, at = place[r["anchor"]]
        scores[n][at, r["k"] - 1], ids[n][at, r["k"] - 1] = r["score"], r["vec_id"]
    windows = []
    for s in scores:
        least, largest = -(-s * share[0] // 100), s * share[1] // 100
        largest[s == LOWEST] = LOWEST
        least[s == LOWEST] = 0
        windows.append((least, largest))
    asked = spark.sparkContext.broadcast((windows, scores, ids))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, score, positive = asked.value
        names = ["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_score", "negative_id", "negative"]
        for b, s, i, found in zip(trees.value, score, positive, find_negatives(trees.value, edges, batches, negatives, most)):
            slot, k = np.nonzero(found.score > LOWEST)
            at, place = slot // positives, slot % positives
            yield _best_rows(names, [b.row[at], place, b.vec_id[at], i[at, place], s[at, place], found.score[slot, k], found.vec_id[slot, k], found.row[slot, k]])

    kinds = "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long, negative long"
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "negative")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return (rows.mapInArrow(other, kinds).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
                   share: tuple[int, int] = (50, 95), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: float = 256.0, wave: int = 16_384, block: int = 256, most: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor (``is_anchor`` over vec_id)
    and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score is
    between share[0] and share[1] percent of the positive's."""
    spark = vectors.sparkSession
    rows = cut(candidates(vectors, F.col(label_col) if label is None else label, id_col, vector_col, scale))
    anchors, n = _waves(rows.where(is_anchor & (F.col("vec_id") != NO_ID)), wave, block)
    path = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    done = None
    for k in range(n):
        mine = anchors.where(F.col("wave") == k).collect()  # at most `wave` rows, counted in _waves
        if mine or (done is None and k == n - 1):
            done = mine_wave(spark, rows, _blocks(mine, block), positives, negatives, share, most)
            done.write.parquet(f"{path}/wave={k}")
    return spark.read.schema(done.schema).parquet(path).select(*done.columns)
