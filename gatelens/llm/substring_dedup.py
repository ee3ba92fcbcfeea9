"""Removal of repeated word windows behind a count-min prefilter.

Partitions sketch how often windows occur: a window counts in the cells of its least gram, in two rows of hashed counters.
Sketches are sparse (cells with counts), packed by cell range and merged by adding, so a merged cell is never below the
true number of windows: an estimate of one proves that a window occurs once. The counters' width follows the corpus
(32 cells for each gram expected). A second pass groups exactly only the windows whose estimate is two or more; nothing
that repeats is lost (see repeats.py for the exact part).

A window is ``length`` consecutive words of one document; each word covered by a window whose words also start in a
document with a smaller id is removed. Results: null texts have no words; documents with fewer words lose nothing; rows
that share an id are not compared with each other; null ids come after all numbers; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gatelens.llm import chunks as ch
from gatelens.llm import repeats
from gatelens.llm.common import SPACE, mix, two_columns, word_hashes

TEXT_PER_SHARD = 8 << 20
ROWS = 2
RUN = 3


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated documents, and each document's first word."""
    word = np.concatenate([[False], ~SPACE[data], [False]])
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # a document's edge ends a word
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | fresh[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_symbols(chunk: ch.Chunk, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = chunk.offsets[i], chunk.offsets[j]
    data = chunk.data[a:b]
    starts, ends, first = word_bounds(data, chunk.offsets[i:j + 1] - a)
    return word_hashes(data, starts, ends), first


def cells(grams: np.ndarray, row: int) -> np.ndarray:
    return grams if row == 0 else mix(grams ^ np.uint64(0xA0761D6478BD642F * row & (1 << 64) - 1))


def sketch(chunk: ch.Chunk, w: repeats.Windows, n_shards: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's own sketch: counts (2 stands for more) of its grams by cell, row after row."""
    b = repeats.chunk_blocks(chunk, w)
    start = repeats.starts_of(b.gram)
    count = np.minimum(np.diff(np.append(start, len(b.gram))), 2)
    for row in range(ROWS):
        keys = cells(b.gram[start], row)
        order = np.argsort(keys, kind="stable")
        out = ch.questions([(chunk.number, (keys[order], [count[order]]))], n_shards, 1, bits)
        if out is not None:
            yield out.set_column(0, "shard", pa.compute.add(out["shard"], row * n_shards))


def merged_estimates(t: pa.Table, bits: int) -> list[bytes]:
    """The merged sketch's estimates for each asking chunk's cells: whether they reach two."""
    sizes, keys, (count,) = ch.merged(t, 1, bits=bits)
    _, cell = np.unique(keys, return_inverse=True)
    total = np.bincount(cell, weights=count)
    return [np.packbits(x).tobytes() + len(x).to_bytes(4, "little") for x in np.split(total[cell] >= 2, np.cumsum(sizes)[:-1])]


def _bits(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data[:-4], np.uint8), count=int.from_bytes(data[-4:], "little")).astype(bool)


def estimated_repeated(grams: np.ndarray, answers: list[bytes]) -> np.ndarray:
    """Which of a chunk's ascending grams reach two in every row of the sketch."""
    got = np.concatenate([_bits(a) for a in answers]) if answers else np.zeros(0, bool)
    out = np.ones(len(grams), bool)
    for row in range(ROWS):
        order = np.argsort(cells(grams, row), kind="stable")
        out[order] &= got[row * len(grams):(row + 1) * len(grams)]
    return out


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, gram: int = 6) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per document."""
    chunks = ch.chunked(two_columns(docs, id_col, text_col))
    w = repeats.Windows(word_symbols, length, min(gram, length), RUN, same_document=False)
    n = ch.shard_count(chunks, TEXT_PER_SHARD)
    bits = min(62, max(32, (n * TEXT_PER_SHARD).bit_length()))  # a gram takes about 32 bytes of text, so 32 cells each

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from sketch(ch.opened(batch.slice(i, 1).to_pylist()[0]), w, n, bits)

    estimates = ch.answer(chunks.mapInArrow(sketches, ch.question_ddl(1)), lambda t: merged_estimates(t, bits))

    def gram_questions(chunk: ch.Chunk, answers: list[bytes]) -> pa.Table:
        b = repeats.chunk_blocks(chunk, w)
        start = repeats.starts_of(b.gram)
        often = estimated_repeated(b.gram[start], answers)
        kept = b.take(np.flatnonzero(np.repeat(often, np.diff(np.append(start, len(b.gram))))))
        mask = np.packbits(often).tobytes() + len(often).to_bytes(4, "little")
        return ch.with_note(chunk.number, mask, ch.questions([(chunk.number, repeats.gram_question(chunk, kept))], n, 2), 2)

    codes = ch.answer(ch.with_answers(chunks, estimates, gram_questions, ch.question_ddl(2)), repeats.noted(repeats.gram_answers))

    def blocks(chunk: ch.Chunk, answers: list[bytes]) -> tuple[repeats.Blocks, list[bytes]]:
        b = repeats.chunk_blocks(chunk, w)
        count = np.diff(np.append(repeats.starts_of(b.gram), len(b.gram)))
        return b.take(np.flatnonzero(np.repeat(_bits(answers[0]), count))), answers[1:]

    spans = repeats.settle(chunks, codes, w, n, blocks)

    def use(chunk: ch.Chunk, answers: list[bytes]) -> pa.Table:
        starts, ends, first = word_bounds(chunk.data, chunk.offsets)
        gone = repeats.removed_mask(chunk, answers, first, length)
        data, rows = chunk.data.tobytes(), []
        for a, b in zip(first, first[1:]):
            left = np.flatnonzero(~gone[a:b]) + a
            text = b" ".join([data[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist())])
            rows.append((int(b - a), int(b - a - len(left)), hashlib.sha256(text).hexdigest()))
        cols = list(zip(*rows)) or [()] * 3
        return pa.table({"doc_id": chunk.ids, "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                         "kept_sha256": pa.array(cols[2], pa.string())})

    return ch.with_answers(chunks, spans, use, "doc_id long, n_words long, n_removed long, kept_sha256 string")
