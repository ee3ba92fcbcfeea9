"""Moments of all pairs of columns over their common rows, as one Gram matrix of masked columns.

A task adds up X'X, X'M, (X^2)'M and M'M of its batches, where M marks the finite values and X has zeros elsewhere; the partial sums
are added up in tasks. The plan has the same size for two columns and for two hundred; the driver gets 4 p^2 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.exprs import finite

#: Partial sums that one task, or the driver, adds up.
FAN_IN = 64


@dataclass
class PairMoments:
    """For columns i and j over the rows that have both: count, sum of i, sum of i^2, sum of products (all p x p)."""

    count: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    def correlations(self) -> np.ndarray:
        """Pearson r; NaN where there are no common rows or one side does not vary."""
        n = np.maximum(self.count, 1)
        spread = self.squares - self.sums ** 2 / n
        spread[spread <= 1e-12 * self.squares] = 0.0
        both = spread * spread.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(both > 0, np.clip((self.products - self.sums * self.sums.T / n) / np.sqrt(both), -1, 1), np.nan)


def pair_moments(df: DataFrame, columns: list[str]) -> PairMoments:
    p = len(columns)
    rows = df.select(*[finite(c).alias(f"x{i}") for i, c in enumerate(columns)])
    least = rows.agg(*[F.min(c).alias(c) for c in rows.columns]).first()
    origin = np.array([least[c] or 0.0 for c in rows.columns])  # so that a constant column is exactly zero

    def added(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
                    mask = np.isfinite(x).astype(float)
                    x = np.where(mask > 0, x - origin, 0.0)
                    yield np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])

        return added(parts())

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(np.array(s) for batch in batches for s in batch.column("s").to_pylist())

    parts = rows.mapInArrow(first, "s array<double>")
    tasks = rows.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(second, "s array<double>")
    found = [np.array(r["s"]).reshape(4, p, p) for r in parts.collect()]
    return PairMoments(*(sum(found[1:], found[0]) if found else np.zeros((4, p, p))))
