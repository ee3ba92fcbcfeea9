"""Windows of a fixed length that occur earlier in the corpus, found exactly.

A window's *gram* is the slice of ``gram`` symbols in it with the least hash (leftmost on ties). Neighbouring windows mostly
share one gram occurrence; such a run of windows is a *block*. Equal windows have equal grams at equal places, so:

1. Each chunk asks about its distinct gram values, with a signature of the block (or "several") and the least document id.
   A shard answers per chunk: nothing earlier; the block is the only one with this gram and occurs earlier; or there are
   several blocks with this gram, in this chunk alone or in others too.
2. Only blocks with a several-answer are cut into short runs of windows, aligned to the gram; a run's next digit is its core,
   the symbols that all of its windows hold, and its content is its signature. The same question again drops all runs but
   those at the edges of what two places share.
3. What still has several contents is taken apart into windows. A chunk settles what it can by itself and asks about the rest,
   one entry per distinct window. A shard sorts its windows by a digit for the first half, drops those that are alone,
   and sorts the others by a digit for the whole; equal groups after the last digit are exactly the repeated windows. It answers with the windows that occur in a document with a smaller id.
4. Chunks gather the removed windows of all steps as spans.

Windows are compared by 128 bits of hash. A key counts once per chunk, so copies by the thousand cost no more than one per
chunk. Rows that share an id are not compared with each other; null ids come last, after all numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gatelens.llm import chunks as ch
from gatelens.llm.common import Rolling, mix

LOW = np.uint64((1 << 31) - 1)
EARLIER, SEVERAL, SEVERAL_HERE = 1, 2, 3
SPANS = "chunk long, shard long, answer binary"
#: Bytes of text whose rolling hashes are in memory at a time (a longer document is one slice).
SLICE = 1 << 18


@dataclass(frozen=True)
class Windows:
    """``symbols`` turns the rows [i, j) of a chunk into symbol hashes and n + 1 offsets, one symbol per unit of length."""

    symbols: Callable[[ch.Chunk, int, int], tuple[np.ndarray, np.ndarray]]
    length: int
    gram: int
    #: Windows in a run of step 2.
    run: int
    #: Whether a window that starts earlier in the same document counts.
    same_document: bool


@dataclass
class Blocks:
    gram: np.ndarray
    signature: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray

    def take(self, at: np.ndarray) -> Blocks:
        return Blocks(*(getattr(self, f)[at] for f in FIELDS))


FIELDS = ("gram", "signature", "row", "first", "last", "anchor")


def joined_blocks(parts: list[Blocks]) -> Blocks:
    """Blocks of several slices by gram, signature, document and place."""
    if not parts:
        none = np.zeros(0, np.int64)
        return Blocks(none.astype(np.uint64), none.astype(np.uint64), none, none, none, none)
    b = Blocks(*(np.concatenate([getattr(p, f) for p in parts]) for f in FIELDS))
    return b.take(np.lexsort((b.first, b.row, b.signature, b.gram)))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def slice_blocks(symbols: np.ndarray, offsets: np.ndarray, w: Windows) -> Blocks | None:
    """Blocks of one run of documents; rows count from 0, first and last window starts from their document's start."""
    n = len(symbols)
    if n < w.length:
        return None
    roll = Rolling(symbols)
    gram = roll.every(w.gram)
    gram = gram if len(gram) == n - w.gram + 1 else np.append(gram, roll.slices(np.array([n - w.gram]), np.array([n])))
    ranked = (gram & ~LOW) | np.arange(len(gram), dtype=np.uint64)
    anchor = (sliding_min(ranked, w.length - w.gram + 1) & LOW).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    inner = offsets[1:-1]
    np.add.at(edge, np.maximum(inner - w.length + 1, 0), 1)
    np.add.at(edge, inner, -1)
    inside = np.cumsum(edge)[:n - w.length + 1] == 0
    before = np.concatenate([[-1], np.where(inside, anchor, -1)[:-1]])
    first = np.flatnonzero(inside & (anchor != before))
    if not len(first):
        return None
    ends = np.flatnonzero(inside & np.concatenate([(~inside[1:]) | (anchor[1:] != anchor[:-1]), [True]]))
    at = anchor[first]
    signature = mix(roll.slices(first, ends + w.length) ^ ((at - first).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    row = np.searchsorted(offsets, first, "right") - 1
    # a least hash is small; scrambled once more, the keys fall evenly on the shards
    key = mix(gram[at] ^ np.uint64(0x589965CC75374CC3))
    return Blocks(key, signature | np.uint64(1), row, first - offsets[row], ends - offsets[row], at - offsets[row])


def chunk_blocks(chunk: ch.Chunk, w: Windows) -> Blocks:
    """All blocks of a chunk, by gram, signature, document and place."""
    parts = []
    for i, j in chunk.slices(SLICE):
        found = slice_blocks(*w.symbols(chunk, i, j), w)
        if found:
            found.row = found.row + i
            parts.append(found)
    return joined_blocks(parts)


def runs_of(chunk: ch.Chunk, b: Blocks, w: Windows) -> Blocks:
    """Blocks cut into runs of windows: a run's gram is the hash of its core, its place under the block's gram, and that gram."""
    parts = []
    b = b.take(np.argsort(b.row, kind="stable"))
    for i, j in chunk.slices(SLICE):
        lo, hi = np.searchsorted(b.row, [i, j])
        if lo == hi:
            continue
        symbols, offsets = w.symbols(chunk, i, j)
        roll = Rolling(symbols)
        p = b.take(np.arange(lo, hi))
        base = offsets[p.row - i]
        # runs are numbered by how far a window starts before the gram, so they fall alike wherever the gram stands
        low, high = (p.anchor - p.last) // w.run, (p.anchor - p.first) // w.run
        n = high - low + 1
        at = np.repeat(np.arange(len(n)), n)
        number = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        anchor, base = p.anchor[at], base[at]
        first = np.maximum(p.first[at], anchor - number * w.run - w.run + 1)
        last = np.minimum(p.last[at], anchor - number * w.run)
        core = roll.slices(base + anchor - number * w.run, base + anchor - number * w.run - w.run + 1 + w.length)
        gram = mix(core ^ mix(p.gram[at] + number.astype(np.uint64)))
        whole = roll.slices(base + first, base + last + w.length)
        signature = mix(whole ^ ((anchor - first).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        parts.append(Blocks(gram, signature | np.uint64(1), p.row[at], first, last, anchor))
    return joined_blocks(parts)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """First index of every group of equal neighbours."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def gram_question(chunk: ch.Chunk, b: Blocks) -> ch.Question:
    """Distinct grams with the block's signature (0: several blocks) and the least id."""
    if not len(b.gram):
        return b.gram, [b.signature, b.row]
    start = starts_of(b.gram)
    classes = starts_of(b.gram, b.signature)
    several = np.add.reduceat(np.isin(np.arange(len(b.gram)), classes).astype(np.int64), start) > 1
    return b.gram[start], [np.where(several, np.uint64(0), b.signature[start]), np.minimum.reduceat(chunk.order[b.row], start)]


def gram_answers(t: pa.Table) -> list[bytes]:
    sizes, keys, (signature, least) = ch.merged(t, 2, wide=(0,))
    order = np.argsort(keys, kind="stable")
    start = starts_of(keys[order])
    count = np.diff(np.append(start, len(keys)))
    low, high = np.minimum.reduceat(signature[order], start), np.maximum.reduceat(signature[order], start)
    first = np.minimum.reduceat(least[order], start)
    several = (low == 0) | (low != high)
    code = np.empty(len(keys), np.uint8)
    code[order] = np.where(np.repeat(several, count), np.where(np.repeat(count, count) > 1, SEVERAL, SEVERAL_HERE),
                           np.where(least[order] > np.repeat(first, count), EARLIER, 0))
    return [c.tobytes() for c in np.split(code, np.cumsum(sizes)[:-1])]


def settled_here(keys: tuple[np.ndarray, ...], ids: np.ndarray, row: np.ndarray, same_document: bool) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by key, id, row and place: which occur earlier in this chunk, and which still may elsewhere."""
    start = starts_of(*keys)
    count = np.diff(np.append(start, len(ids)))
    least = np.repeat(ids[start], count) if len(start) else ids
    gone = ids > least
    if same_document and len(ids):
        again = np.ones(len(ids), bool)
        again[starts_of(*keys, row)] = False
        gone |= again
    return gone, (~gone) & (ids == least)


def window_digits(chunk: ch.Chunk, b: Blocks, shared: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """(hashes of the first half and the whole, row, start, ``shared`` of its block) of every window of the given blocks."""
    digits, rows, places, marks = [], [], [], []
    half = max(1, w.length // 2)
    order = np.argsort(b.row, kind="stable")
    b, shared = b.take(order), shared[order]
    for i, j in chunk.slices(SLICE):
        lo, hi = np.searchsorted(b.row, [i, j])
        if lo == hi:
            continue
        symbols, offsets = w.symbols(chunk, i, j)
        roll = Rolling(symbols)
        n = b.last[lo:hi] - b.first[lo:hi] + 1
        row = np.repeat(b.row[lo:hi], n)
        place = np.repeat(b.first[lo:hi] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = offsets[row - i] + place
        digits.append(np.stack([roll.slices(at, at + half), roll.slices(at, at + w.length)]))
        rows.append(row)
        places.append(place)
        marks.append(np.repeat(shared[lo:hi], n))
    if not digits:
        return np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(digits, axis=1), np.concatenate(rows), np.concatenate(places), np.concatenate(marks)


def radix_groups(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: (index, group) of the entries that equal another one in all digits.

    Each pass orders only what the passes before left in groups of two or more; the rest is alone and never looked at again.
    """
    index = np.arange(len(digits[0]))
    group = np.zeros(len(index), np.int64)
    for digit in digits:
        d = digit[index]
        order = np.lexsort((d, group))
        index, group, d = index[order], group[order], d[order]
        start = starts_of(group, d)
        count = np.diff(np.append(start, len(index)))
        group = np.repeat(np.arange(len(start)), count)
        kept = np.repeat(count > 1, count)
        index, group = index[kept], group[kept]
    return index, group


def window_answers(t: pa.Table) -> pa.Table:
    """Spans rows: the windows of one shard that occur in a document with a smaller id, by asking chunk; notes pass."""
    if ch.is_note(t):
        return t.select(["chunk", "shard", "keys"]).rename_columns(["chunk", "shard", "answer"])
    sizes, whole, (half, least, row, place) = ch.merged(t, 4, wide=(0,))
    chunk = np.repeat(t["chunk"].to_numpy(), sizes)
    index, group = radix_groups([half, whole])
    gone = np.zeros(0, np.int64)
    if len(index):
        start = starts_of(group)
        first = np.minimum.reduceat(least[index], start)
        gone = index[least[index] > np.repeat(first, np.diff(np.append(start, len(index))))]
    gone = gone[np.lexsort((place[gone], row[gone], chunk[gone]))]
    edges = np.append(starts_of(chunk[gone]), len(gone))
    rows = [(int(chunk[gone[a]]), span_bytes(row[gone[a:b]], place[gone[a:b]], place[gone[a:b]])) for a, b in zip(edges, edges[1:])]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "shard": pa.array([0] * len(rows), pa.int64()),
                     "answer": pa.array([r[1] for r in rows], pa.binary())})


def bundle(*arrays: np.ndarray) -> bytes:
    """Integer arrays one after another (64-bit hashes keep their bits)."""
    parts = [ch.packed(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64)) for x in arrays]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unbundle(data: bytes) -> list[np.ndarray]:
    out = []
    while data:
        n = int.from_bytes(data[:4], "little")
        out.append(ch.unpacked(data[4:4 + n]))
        data = data[4 + n:]
    return out


def span_bytes(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    """Runs of window starts, neighbours joined; entries come sorted by row and first."""
    if not len(row):
        return b""
    joined = np.ones(len(row), bool)
    joined[1:] = (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)
    start = np.flatnonzero(joined)
    return bundle(row[start], first[start], np.maximum.reduceat(last, start))


def sorted_spans(spans: list[tuple[np.ndarray, ...]]) -> bytes:
    row, first, last = (np.concatenate(x) for x in zip(*spans))
    order = np.lexsort((first, row))
    return span_bytes(row[order], first[order], last[order])


def certain(chunk: ch.Chunk, codes: list[bytes], b: Blocks, w: Windows) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """What answers about grams settle: spans to remove, and the code of every block."""
    got = np.frombuffer(b"".join(codes), np.uint8)
    code = np.repeat(got, np.diff(np.append(starts_of(b.gram), len(b.gram)))) if len(got) else np.zeros(0, np.uint8)
    gone, _ = settled_here((b.gram,), chunk.order[b.row], b.row, w.same_document)
    whole = (code == EARLIER) | ((code == 0) & gone)
    return (b.row[whole], b.first[whole], b.last[whole]), code


def settle(chunks: DataFrame, codes: DataFrame, w: Windows, n_shards: int,
           blocks: Callable[[ch.Chunk, list[bytes]], tuple[Blocks, list[bytes]]]) -> DataFrame:
    """Steps 2 to 4: rows (chunk, shard, answer) whose answers are spans of window starts, several rows per chunk.

    ``blocks`` gives a chunk's blocks and the codes of their grams.
    """
    def ask_runs(chunk: ch.Chunk, answers: list[bytes]) -> pa.Table:
        b, got = blocks(chunk, answers)
        spans, code = certain(chunk, got, b, w)
        here, open_ = b.take(np.flatnonzero(code == SEVERAL_HERE)), b.take(np.flatnonzero(code == SEVERAL))
        # what the next step needs goes along: spans, blocks settled here by their windows, blocks to cut into runs
        note = bundle(*spans, here.row, here.first, here.last, open_.gram, open_.row, open_.first, open_.last, open_.anchor)
        return ch.with_note(chunk.number, note, ch.questions([(chunk.number, gram_question(chunk, runs_of(chunk, open_, w)))], n_shards, 2), 2)

    def ask_windows(chunk: ch.Chunk, answers: list[bytes]) -> pa.Table:
        *spans, h_row, h_first, h_last, o_gram, o_row, o_first, o_last, o_anchor = unbundle(answers[0])
        hashes = lambda x: x.astype(np.int64).view(np.uint64)
        runs = runs_of(chunk, Blocks(hashes(o_gram), hashes(o_gram), o_row, o_first, o_last, o_anchor), w)
        more, code = certain(chunk, answers[1:], runs, w)
        left = runs.take(np.flatnonzero(code >= SEVERAL))
        none = np.zeros(len(h_row), np.uint64)
        left = Blocks(*(np.concatenate(x) for x in zip((none, none, h_row, h_first, h_last, h_first), (getattr(left, f) for f in FIELDS))))
        shared = np.concatenate([np.zeros(len(h_row), bool), code[code >= SEVERAL] == SEVERAL])
        digits, row, place, shared = window_digits(chunk, left, shared, w)
        order = np.lexsort((place, row, *digits[::-1]))
        digits, row, place, shared = digits[:, order], row[order], place[order], shared[order]
        ids = chunk.order[row]
        gone, open_ = settled_here(tuple(digits), ids, row, w.same_document)
        open_ &= shared  # the windows of a gram that only this chunk holds are settled
        half, whole = digits[:, open_]
        by = np.argsort(whole, kind="stable")
        question = whole[by], [half[by], ids[open_][by], row[open_][by], place[open_][by]]
        note = sorted_spans([tuple(spans), more, (row[gone], place[gone], place[gone])])
        return ch.with_note(chunk.number, note, ch.questions([(chunk.number, question)], n_shards, 4), 4)

    run_codes = ch.answer(ch.with_answers(chunks, codes, ask_runs, ch.question_ddl(2)), noted(gram_answers))
    asked = ch.with_answers(chunks, run_codes, ask_windows, ch.question_ddl(4))
    return asked.groupBy("shard").applyInArrow(window_answers, SPANS)


def noted(merge: Callable[[pa.Table], list[bytes]]) -> Callable[[pa.Table], list[bytes]]:
    """``merge`` that lets notes pass."""
    return lambda t: t["keys"].to_pylist() if ch.is_note(t) else merge(t)


def earlier_windows(chunks: DataFrame, w: Windows, n_shards: int) -> DataFrame:
    """All three steps, without a prefilter."""
    asked = ch.ask(chunks, lambda c: gram_question(c, chunk_blocks(c, w)), 2, n_shards)
    return settle(chunks, ch.answer(asked, gram_answers), w, n_shards, lambda c, a: (chunk_blocks(c, w), a))


def removed_mask(chunk: ch.Chunk, answers: list[bytes], offsets: np.ndarray, length: int) -> np.ndarray:
    """Which symbols of a chunk lie in a removed window; ``offsets`` gives each row's first symbol."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    for a in answers:
        if a:
            row, first, last = unbundle(a)
            np.add.at(edge, offsets[row] + first, 1)
            np.add.at(edge, offsets[row] + last + length, -1)
    return np.cumsum(edge)[:-1] > 0
