"""Chunks of documents, and questions that chunks put to shards of a key space.

A corpus-wide table of keys (window hashes, n-grams) is too large to send to every task, and a row per key and document
is too much to shuffle. Documents are therefore written once as compressed chunks of a few MB. Each chunk asks about its
distinct keys only, packed by shard (a range of the key space); each shard merges what all chunks say about its keys and
answers in the order asked; answers and chunk meet again by chunk id. A key costs one entry per chunk that holds it,
however many documents share it, so a shard's share of a hot key is bounded by the number of chunks; keys are hashes, so
shards are even. The chunk table lies in the shared folder: every step can be rerun after losing an executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.lineage import cut
from gatelens.llm.common import byte_texts

SCHEMA = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.binary()),
                    ("blob", pa.binary()), ("rest", pa.binary())])
DDL = "chunk long, size long, ids array<long>, ends binary, blob binary, rest binary"
LAST = np.iinfo(np.int64).max


@dataclass
class Chunk:
    """Documents in order of id, null ids last: ``order`` holds ids with null as the largest number."""

    number: int
    ids: pa.Array
    order: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    rest: pa.Table | None

    def slices(self, most: int) -> Iterator[tuple[int, int]]:
        """Runs of rows of about ``most`` bytes, at least one row."""
        start, n = 0, len(self.order)
        while start < n:
            stop = max(start + 1, int(np.searchsorted(self.offsets, self.offsets[start] + most, "right")) - 1)
            yield start, min(stop, n)
            start = min(stop, n)


def chunked(docs: DataFrame, most: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text and the columns ``keep``) as a written table of chunks of about ``most`` bytes of text."""
    keep = keep or []

    def emit(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        rows = rows.take(pa.compute.sort_indices(rows["doc_id"]))  # nulls last
        data, ends = byte_texts(rows["text"].combine_chunks())
        rest = b""
        if keep:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.select(keep).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.select(keep))
            rest = sink.getvalue().to_pybytes()
        blob = zstandard.ZstdCompressor(level=6).compress(data.tobytes())
        return pa.RecordBatch.from_pylist([{"chunk": number, "size": len(data), "ids": rows["doc_id"].to_pylist(),
                                            "ends": ends.astype("<i8").tobytes(), "blob": blob, "rest": rest}], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            _, ends = byte_texts(batch.column("text"))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most - size, "right")) - 1)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop] - ends[start])
                start = stop
                if size >= most or start < batch.num_rows:
                    yield emit(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield emit(held, number)

    return cut(docs.select("doc_id", "text", *keep).mapInArrow(run, DDL))


def opened(row: dict) -> Chunk:
    ids = pa.array(row["ids"], pa.int64())
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["size"])), np.uint8)
    rest = pa.ipc.open_stream(row["rest"]).read_all() if row["rest"] else None
    return Chunk(row["chunk"], ids, ids.fill_null(LAST).to_numpy(), np.frombuffer(row["ends"], "<i8"), data, rest)


def packed(values: np.ndarray) -> bytes:
    """Integers as their least value and offsets of the smallest width that holds them."""
    if not len(values):
        return b""
    low = int(values.min())
    span = int(values.max()) - low
    width = next(w for w in (1, 2, 4, 8) if span < 1 << (8 * w))
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + (values.astype(np.int64) - low).astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    return np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.int64) + int.from_bytes(data[1:9], "little", signed=True)


def stepped(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as the first and the steps between them, in the fewest bytes that hold each step."""
    if not len(keys):
        return b""
    steps = np.diff(keys).astype("<u8")
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unstepped(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    steps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 1), steps.view("<u8").reshape(-1)]), dtype=np.uint64)


def shard_count(chunks: DataFrame, text_per_shard: int) -> int:
    """So many shards that each merges the keys of about ``text_per_shard`` bytes; one number reaches the driver."""
    return max(1, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // text_per_shard))


def shard_bounds(n: int) -> np.ndarray:
    """First key of every shard after the first: the key space in n equal ranges."""
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


#: Keys in ascending order, and payload arrays aligned with them.
Question = tuple[np.ndarray, list[np.ndarray]]


def questions(rows: list[tuple[int, Question]], n_shards: int, n_payloads: int, bits: int = 64) -> pa.RecordBatch | None:
    """Question rows (shard, chunk, keys, p0, p1, ...) of several chunks; keys count by their upper ``bits`` bits."""
    shards, numbers, keys_out, out = [], [], [], [[] for _ in range(n_payloads)]
    for number, (keys, payloads) in rows:
        edges = np.concatenate([[0], np.searchsorted(keys, shard_bounds(n_shards)), [len(keys)]])
        for shard in np.flatnonzero(np.diff(edges)):
            a, b = edges[shard], edges[shard + 1]
            shards.append(int(shard))
            numbers.append(number)
            keys_out.append(keys[a:b].astype("<u8").tobytes() if bits == 64 else packed((keys[a:b] >> np.uint64(64 - bits)).astype(np.int64)))
            for o, p in zip(out, payloads):
                o.append(p[a:b].astype("<u8").tobytes() if p.dtype == np.uint64 else packed(p[a:b]))
    if not shards:
        return None
    arrays = [pa.array(shards, pa.int64()), pa.array(numbers, pa.int64()), pa.array(keys_out, pa.binary()),
              *(pa.array(o, pa.binary()) for o in out)]
    return pa.RecordBatch.from_arrays(arrays, ["shard", "chunk", "keys", *(f"p{i}" for i in range(n_payloads))])


def question_ddl(n_payloads: int) -> str:
    return "shard long, chunk long, keys binary" + "".join(f", p{i} binary" for i in range(n_payloads))


def ask(chunks: DataFrame, question: Callable[[Chunk], Question], n_payloads: int, n_shards: int, bits: int = 64) -> DataFrame:
    """Question rows of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = opened(batch.slice(i, 1).to_pylist()[0])
                out = questions([(chunk.number, question(chunk))], n_shards, n_payloads, bits)
                if out is not None:
                    yield out

    return chunks.mapInArrow(run, question_ddl(n_payloads))


def with_note(chunk: int, note: bytes, asked: pa.RecordBatch | None, n_payloads: int) -> pa.Table:
    """Question rows with a chunk's note to itself: a row of a shard of its own below zero, which is answered unchanged.

    So what a chunk has worked out travels along with its questions, in one lineage over one shuffled chunk table.
    """
    own = pa.table({"shard": pa.array([-1 - chunk], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "keys": pa.array([note], pa.binary()),
                    **{f"p{i}": pa.array([None], pa.binary()) for i in range(n_payloads)}})
    return own if asked is None else pa.concat_tables([own, pa.Table.from_batches([asked])])


def is_note(table: pa.Table) -> bool:
    return table["shard"][0].as_py() < 0


def merged(table: pa.Table, n_payloads: int, wide: tuple[int, ...] = (), bits: int = 64) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All questions of one shard: keys per row, keys, payloads (``wide`` ones are 64-bit hashes)."""
    keys = [np.frombuffer(k, "<u8") if bits == 64 else unpacked(k) for k in table["keys"].to_pylist()]
    payloads = [np.concatenate([np.frombuffer(x, "<u8") if i in wide else unpacked(x) for x in table[f"p{i}"].to_pylist()])
                for i in range(n_payloads)]
    return np.array([len(k) for k in keys]), np.concatenate(keys), payloads


def answer(questions_: DataFrame, merge: Callable[[pa.Table], list[bytes]], extra: str = "") -> DataFrame:
    """(chunk, shard, answer): ``merge`` sees one shard's questions and gives one answer per row, in the rows' order."""

    def run(t: pa.Table) -> pa.Table:
        return pa.table({"chunk": t["chunk"], "shard": t["shard"], "answer": pa.array(merge(t), pa.binary())})

    return questions_.groupBy("shard").applyInArrow(run, "chunk long, shard long, answer binary")


def with_answers(chunks: DataFrame, answers: DataFrame, use: Callable[[Chunk, list[bytes]], pa.Table], ddl: str) -> DataFrame:
    """Each chunk with its answers in key order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(right["shard"]) if right.num_rows else []
        answers_ = [right["answer"][int(i)].as_py() for i in order.to_pylist()] if right.num_rows else []
        return use(opened(left.to_pylist()[0]), answers_)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ddl)
