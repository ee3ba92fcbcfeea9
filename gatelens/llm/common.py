"""Helpers shared by the operators of this folder: Arrow texts as byte arrays, rolling hashes, reruns of a job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that separate words: space and 0x09-0x0D, as ``bytes.split()`` takes them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same set as a pattern for SQL functions.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_columns(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that others may have any name."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null ids count as remainder null)."""
    return F.crc32(column.cast("string").cast("binary")) % n


def _mixed_bytes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = _mixed_bytes()


class Rolling:
    """Hashes of any slice of a symbol array: prefix sums of symbol * base^position, times base^-start."""

    _up = np.ones(1, U64)
    _down = np.ones(1, U64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        if len(Rolling._up) <= n:
            size = max(1 << 16, 1 << int(n).bit_length())
            for name, base in (("_up", BASE), ("_down", BASE_INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(symbols * Rolling._up[:n], out=self.prefix[1:])

    def every(self, length: int) -> np.ndarray:
        """Hash of each slice of one length, by start."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.prefix[length:] - self.prefix[:n]) * Rolling._down[:n])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * Rolling._down[start] + (end - start).astype(U64))


#: Words up to this long are hashed as slices; a polynomial modulo 2^64 isn't safe for longer ones.
SHORT_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words. Longer slices of a polynomial hash modulo 2^64 can be equal by construction (a Thue-Morse word and its
    complement are from about 1,000 bytes on, while 64 bytes leave 37 of 64 bits to differ in), so long words get XXH3."""
    out = Rolling(BYTE_CODES[data]).slices(starts, ends)
    for k in np.flatnonzero(ends - starts > SHORT_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]].tobytes(), 0x9E3779B97F4A7C15)
    return out


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in one byte array."""
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    return edge[::2], edge[1::2]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def byte_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``most`` bytes of text, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = byte_texts(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
