"""Suffix-array deduplication of byte strings by a depth-limited radix sort.

Suffixes need an order only through ``threshold`` bytes: two suffixes that agree so far hold a repeated string, and the
groups that are equal after the last digit are exactly the repeated windows. Most-significant-digit passes drop every
suffix that is alone after a digit. The first digit is the window's least 24-byte gram, which neighbouring suffixes
share, so that this pass moves one entry for a run of suffixes; the next is the core of ten neighbouring suffixes; suffixes
that still share these with different content are sorted by hashes of their first half and of the whole (see repeats.py).

Each byte covered by a window that also starts earlier (in a document with a smaller id, or earlier in the same one) is
removed. Results: null and empty texts and texts below the threshold lose nothing; rows that share an id are not compared
with each other; null ids come after all numbers; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gatelens.llm import chunks as ch
from gatelens.llm import repeats
from gatelens.llm.common import BYTE_CODES, two_columns

TEXT_PER_SHARD = 8 << 20
RUN = 10


def byte_symbols(chunk: ch.Chunk, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = chunk.offsets[i], chunk.offsets[j]
    return BYTE_CODES[chunk.data[a:b]], chunk.offsets[i:j + 1] - a


def _removed(docs: DataFrame, threshold: int, gram: int, keep: list[str], use: Callable, schema) -> DataFrame:
    chunks = ch.chunked(docs, keep=keep)
    windows = repeats.Windows(byte_symbols, threshold, min(gram, threshold), RUN, same_document=True)
    spans = repeats.earlier_windows(chunks, windows, ch.shard_count(chunks, TEXT_PER_SHARD))
    return ch.with_answers(chunks, spans, lambda c, a: use(c, repeats.removed_mask(c, a, c.offsets, threshold)), schema)


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100, gram: int = 24) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per document."""

    def use(chunk: ch.Chunk, gone: np.ndarray) -> pa.Table:
        rows = []
        for a, b in zip(chunk.offsets, chunk.offsets[1:]):
            g = gone[a:b]
            rows.append((int(b - a), int(g.sum()), int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0,
                         hashlib.sha256(chunk.data[a:b][~g].tobytes()).hexdigest()))
        cols = list(zip(*rows)) or [()] * 4
        return pa.table({"doc_id": chunk.ids, **{n: pa.array(c, t) for n, c, t in zip(
            ("n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))}})

    return _removed(two_columns(docs, id_col, text_col), threshold, gram, [], use,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100,
                    gram: int = 24) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text column; a character goes only if all of its bytes do."""
    rest = [f"__{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        *[F.col(c).alias(r) for c, r in zip(docs.columns, rest) if c != text_col])
    schema = StructType([StructField("doc_id", named.schema["doc_id"].dataType), StructField("text", named.schema["text"].dataType),
                         *named.schema.fields[2:]])

    def use(chunk: ch.Chunk, gone: np.ndarray) -> pa.Table:
        if len(gone):
            starts = np.flatnonzero((chunk.data & 0xC0) != 0x80)
            whole = np.minimum.reduceat(gone, starts)
            gone = np.repeat(whole, np.diff(np.append(starts, len(gone))))
        texts = [chunk.data[a:b][~gone[a:b]].tobytes().decode() for a, b in zip(chunk.offsets, chunk.offsets[1:])]
        out = pa.table({"doc_id": chunk.ids, "text": pa.array(texts, pa.string())})
        for name in chunk.rest.column_names if chunk.rest else ():
            out = out.append_column(name, chunk.rest[name])
        return out

    kept = _removed(named, threshold, gram, [r for i, r in enumerate(rest) if i != at], use, schema)
    return kept.select(*[F.col("text" if i == at else r).alias(c) for i, (c, r) in enumerate(zip(docs.columns, rest))])


def with_counts(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The character count of each text set anew, in the count column's own type."""
    kind = docs.schema[count_col].dataType
    return docs.withColumn(count_col, F.coalesce(F.char_length(text_col), F.lit(0)).cast(kind))
