"""Scores of a backoff language model, run as a weighted automaton.

States are the runs of up to ``order`` - 1 words seen in training (contexts), the empty one among them. An n-gram (h, w) seen in
training is an arc out of state h, of probability share * c(h, w) / c(h) + (1 - share) * p(w | h'), where h' is h without its first
word; any other word takes the failure arc to h', of probability 1 - share. The empty state has an arc for every word,
p(w) = (c(w) + add) / (N + add * (V + 1)). So each state's probabilities sum to one, and the score of a text is a proper log10
probability. An arc leads to the longest state that ends the words read so far, at first the start of the text.

One traversal, left to right, runs all texts of a chunk at once: a position's state is carried over from the arc before it, and
positions that find no arc move on together along their failure arcs, one order at a time.

The automaton of a whole corpus fits no task. Each chunk asks about the n-grams that its documents hold (see chunks.py): shards of the
key space add up the training counts of all chunks, without any cut-off, and answer with totals; a chunk then holds just the
states and arcs that its own texts can reach. N-grams are known by 63-bit hashes; the last bit of a key marks single words.

Results: rows of which ``learns`` is not true are scored only; a null or empty text is its end alone; repeated rows count
and are scored each; without any training row every score is the base's. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.lineage import cut
from gatelens.llm import chunks as ch
from gatelens.llm.common import lowered, mix, two_columns, word_hashes
from gatelens.llm.substring_dedup import word_bounds

END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x27BB2EE687B0B0FD)
WORD_SALT, PAIR = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)
WORD_MARK = np.uint64(1)
CHUNK_BYTES = 8 << 20
SLICE = 1 << 18
TEXT_PER_SHARD = 8 << 20


def tokens(chunk: ch.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each document, the hash before each, and each document's first token."""
    parts, counts = [], [np.zeros(1, np.int64)]
    for i, j in chunk.slices(SLICE):
        a, b = chunk.offsets[i], chunk.offsets[j]
        data = lowered(chunk.data[a:b])
        starts, ends, first = word_bounds(data, chunk.offsets[i:j + 1] - a)
        parts.append(np.insert(word_hashes(data, starts, ends), first[1:], END))
        counts.append(np.diff(first) + 1)
    word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    first = np.cumsum(np.concatenate(counts))
    before = np.concatenate([[START], word[:-1]]) if len(word) else word
    before[first[:-1]] = START
    return word, before, first


def grams(word: np.ndarray, before: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: positions where an n-gram ends, and its keys. The start of a text counts as a word before the first."""
    place = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))
    out = [(np.arange(len(word)), mix(word ^ WORD_SALT) | WORD_MARK)]
    key = before
    for n in range(2, order + 1):
        key = mix(mix(key * PAIR) + word)
        at = np.flatnonzero(place >= n - 2)
        out.append((at, key[at] & ~WORD_MARK))
        key = np.concatenate([key[:1], key[:-1]])
    return out


def numbered(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in ascending order, and each n-gram's place among them."""
    keys, at = np.unique(np.concatenate([k for _, k in found]), return_inverse=True)
    return keys, np.split(at, np.cumsum([len(k) for _, k in found])[:-1])


def question(chunk: ch.Chunk, learns: Callable[[int | None], bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their training counts."""
    word, before, first = tokens(chunk)
    train = np.repeat(np.array([learns(i) for i in chunk.ids.to_pylist()], bool), np.diff(first))
    found = grams(word, before, first, order)
    keys, numbers = numbered(found)
    count = sum(np.bincount(number, weights=train[at], minlength=len(keys)) for (at, _), number in zip(found, numbers))
    return keys, count.astype(np.int64)


def ask(chunks: DataFrame, learns: Callable, order: int, n_shards: int) -> DataFrame:
    """(shard, chunk, keys, counts): a shard is a range of the keys' upper 32 bits, found by arithmetic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = ch.opened(batch.slice(i, 1).to_pylist()[0])
                keys, count = question(chunk, learns, order)
                if not len(keys):
                    continue
                shard = ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)]
                runs = list(zip(edges, edges[1:]))
                yield pa.RecordBatch.from_pydict({
                    "shard": shard[edges[:-1]], "chunk": np.full(len(runs), chunk.number, np.int64),
                    "keys": pa.array([ch.stepped(keys[a:b]) for a, b in runs], pa.binary()),
                    "counts": pa.array([counts_bytes(count[a:b]) for a, b in runs], pa.binary())})

    return chunks.mapInArrow(run, "shard long, chunk long, keys binary, counts binary")


def counts_bytes(c: np.ndarray) -> bytes:
    """One byte a count, and the counts of 255 and more after them, compressed: most are 0, 1 or 2."""
    plain = len(c).to_bytes(8, "little") + np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(plain)


def counts_of(data: bytes) -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(plain[:8], "little")
    c = np.frombuffer(plain, np.uint8, n, 8).astype(np.int64)
    c[c == 255] = np.frombuffer(plain, "<i8", offset=8 + n)
    return c


def totals(t: pa.Table) -> pa.Table:
    """One shard's totals for every asking chunk; its distinct words and training tokens stand in its first row."""
    parts = [ch.unstepped(k) for k in t["keys"].to_pylist()]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([counts_of(c) for c in t["counts"].to_pylist()])).astype(np.int64)
    words = (keys & WORD_MARK) > 0
    rest = [0] * (t.num_rows - 1)
    return pa.table({"chunk": t["chunk"], "shard": t["shard"],
                     "answer": pa.array([counts_bytes(c) for c in np.split(total[at], np.cumsum([len(p) for p in parts])[:-1])], pa.binary()),
                     "types": pa.array([int((total[words] > 0).sum()), *rest], pa.int64()),
                     "tokens": pa.array([int(total[words].sum()), *rest], pa.int64())})


@dataclass
class Automaton:
    """The part that a chunk's texts can reach, position by position: for each n the probability of the n-gram's arc (0: no arc), and
    whether the state of n - 1 words before the position exists."""

    arcs: list[np.ndarray]
    states: list[np.ndarray]
    share: float

    @staticmethod
    def build(counts: list[np.ndarray], visits: list[np.ndarray], base: np.ndarray, share: float) -> Automaton:
        """``counts[n]``: training count of the n + 1 words that end at a position; ``visits[n]``: of the n words before it."""
        arcs = [base]
        for c, v in zip(counts[1:], visits[1:]):
            arcs.append(np.where(c > 0, share * c / np.maximum(v, 1) + (1 - share) * arcs[-1], 0.0))
        return Automaton(arcs, [v > 0 for v in visits], share)

    def traverse(self) -> np.ndarray:
        """The log10 probability of each position's word: its arc, and the failure arcs on the way to it."""
        out = np.zeros(len(self.arcs[0]))
        waiting = np.arange(len(out))
        for arc, state in zip(self.arcs[:0:-1], self.states[:0:-1]):
            there = state[waiting]
            found = there & (arc[waiting] > 0)
            out[waiting[found]] += np.log10(arc[waiting[found]])
            if self.share < 1:
                out[waiting[there & ~found]] += np.log10(1 - self.share)
            waiting = waiting[~found]
        out[waiting] += np.log10(self.arcs[0][waiting])
        return out


def scores(chunk: ch.Chunk, answers: list[bytes], learns: Callable, n_tokens: int, n_types: int, order: int, share: float, add: float) -> pa.Table:
    word, before, first = tokens(chunk)
    found = grams(word, before, first, order)
    keys, numbers = numbered(found)
    total = np.concatenate([counts_of(a) for a in answers]) if answers else np.zeros(0, np.int64)
    counts = []
    for (at, _), number in zip(found, numbers):
        counts.append(np.zeros(len(word), np.int64))
        counts[-1][at] = total[number]
    # a context is what ended one position earlier; the start has as many visits as there are training texts, and so ends
    starts = first[:-1]
    visits = [np.ones(len(word), np.int64)]
    for n, c in enumerate(counts[:-1]):
        visits.append(np.concatenate([c[:1], c[:-1]]))
        visits[-1][starts] = (total[np.searchsorted(keys, mix(np.array([END ^ WORD_SALT])) | WORD_MARK)] if n == 0 else 0) if len(starts) else 0
    c = counts[0]
    base = (c + add) / (n_tokens + add * (n_types + 1))
    steps = Automaton.build(counts, visits, base, share).traverse()
    sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (np.log10(base), steps, (c > 0).astype(np.int64))]
    return pa.table({"doc_id": chunk.ids, "held_out": pa.array([not learns(i) for i in chunk.ids.to_pylist()], pa.bool_()),
                     "n_tokens": pa.array(np.diff(first), pa.int64()), "n_known": pa.array(sums[2], pa.int64()),
                     "train_tokens": pa.array(np.full(len(starts), n_tokens), pa.int64()), "base_score": pa.array(sums[0], pa.float64()),
                     "score": pa.array(sums[1], pa.float64())})


def not_one_of_five(doc_id: int | None) -> bool:
    """Rows to learn from: crc32 of the id as text, modulo 5, is not 1; rows without an id are learned from."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learns: Callable[[int | None], bool] = not_one_of_five,
                    order: int = 3, share: float = 0.5, add: float = 0.5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document; ``order`` 1 gives the base."""
    chunks = ch.chunked(two_columns(docs, id_col, text_col), most=CHUNK_BYTES)
    n = ch.shard_count(chunks, TEXT_PER_SHARD * 2 // order)
    asked = ask(chunks, learns, order, n)
    answers = cut(asked.groupBy("shard").applyInArrow(totals, "chunk long, shard long, answer binary, types long, tokens long"))
    size = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n_tokens, n_types = int(size[0]), int(size[1])
    return ch.with_answers(chunks, answers.select("chunk", "shard", "answer"),
                           lambda c, a: scores(c, a, learns, n_tokens, n_types, order, share, add),
                           "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
