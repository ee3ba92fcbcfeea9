"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

The instance is the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus), so the plan is made
from counts: reduction fixes sets that provably dominate every other set with the same longest piece, for as many
copies as there are, and best-fit decreasing packs the rest (each piece into the fullest open sequence that holds it). A plan line says which run of pieces of one length goes to
which run of sequences, at which offset; pieces get their rank within their length by block-wise totals, and meet the
plan's lines through a join on length. No group of pieces is ever gathered.

Results: a null or empty text is one piece holding the end id alone. Repeated rows and rows that share an id or have a
null id are packed each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.blocks import position
from gatelens.functions.lineage import cut
from gatelens.llm.common import two_columns

#: How byte-level BPE files split a text before merging (fixed by the file format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


GAP = re.compile(r"\s\s+")
LONG_GAP, LONG_WORD = 500, 5000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(text: str):
    """Ids of one text by the tokenizer file whose content is ``text``.

    A byte-level BPE's merges rank by id, so tiktoken's merge loop gives the ids of the tokenizers library at a third
    of the time. A text that holds one of the file's special tokens, a long run of white space (which overflows the stack of the
    pattern above) or a very long word (which the merge loop takes quadratic time for) goes to the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(text)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(code[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("pack", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_str(text)

    def encode(value: str) -> list[int]:
        if any(s in value for s in special) or len(value) > LONG_GAP and (
                any(len(w) > LONG_WORD for w in value.split()) or any(len(g) > LONG_GAP for g in GAP.findall(value))):
            return exact.encode(value, add_special_tokens=False).ids
        return fast.encode_ordinary(value)

    return encode


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); a text over capacity is cut from its end, so the first may be shorter."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a tokenizer file: a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encode(value or "") + [end_id], "<u4")
                first = len(ids) % capacity or capacity
                start, stop, piece = 0, min(first, len(ids)), 0
                while start < len(ids):
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop, piece = stop, stop + capacity, piece + 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Patterns (lengths, copies) that use every piece once, and how many sequences the reduction fixed.

    Reduction, longest length a first, with b the longest that fits beside it: {a, b} dominates if it is full, if no two
    pieces fit beside a, or if no three do and no pair that fits is longer than b; {a} alone dominates if nothing fits.
    """
    left = {k: v for k, v in counts.items() if v}
    out: list[tuple[tuple[int, ...], int]] = []

    def largest(room: int, used: dict[int, int]) -> int:
        return next((k for k in range(min(room, capacity), 0, -1) if left.get(k, 0) > used.get(k, 0)), 0)

    def take(pattern: tuple[int, ...], copies: int) -> None:
        for k in pattern:
            left[k] -= copies
            if not left[k]:
                del left[k]
        out.append((pattern, copies))

    fixed = 0
    for a in sorted(left, reverse=True):
        while left.get(a, 0):
            room = capacity - a
            b = largest(room, {a: 1})
            if not b:
                n = left[a]
                fixed += n
                take((a,), n)
                continue
            small = _smallest(left, a)
            alone = small[0] + small[1] > room
            if not (b == room or alone or small[0] + small[1] + small[2] > room and _best_pair(left, a, room) <= b):
                break  # undecided: best-fit takes it
            # taking pieces away keeps the rule true as long as both lengths last
            n = left[a] // 2 if a == b else min(left[a], left[b])
            fixed += n
            take((a, b), n)
    return out + _best_fit(left, capacity), fixed


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over runs of equal pieces: each goes to the fullest open sequence that holds it, else to a new one.

    Open sequences are kept by free room as (pattern, copies). A piece put into the smallest room that holds it leaves a smaller
    room, which the next equal piece prefers; so a sequence takes as many as fit before the next one is touched.
    """
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for k in sorted(left, reverse=True):
        n = left[k]
        for room in sorted(r for r in opened if r >= k) + [capacity]:
            while n and (room == capacity or opened.get(room)):
                pattern, copies = opened[room].pop() if room < capacity else ((), n)
                fit = room // k
                full = min(copies, n // fit)
                last = n - full * fit if full < copies else 0  # pieces for one more sequence, fewer than fit
                for taken, m in ((fit, full), (last, 1 if last else 0)):
                    if m:
                        opened.setdefault(room - taken * k, []).append((pattern + (k,) * taken, m))
                n -= full * fit + last
                if room < capacity and copies > full + (1 if last else 0):
                    opened[room].append((pattern, copies - full - (1 if last else 0)))
    return [group for groups in opened.values() for group in groups]


def _smallest(left: dict[int, int], a: int) -> list[int]:
    """The three smallest lengths left besides one piece of length a (huge where there are fewer)."""
    out: list[int] = []
    for k in sorted(left):
        out += [k] * min(3, left[k] - (k == a))
        if len(out) >= 3:
            break
    return (out + [1 << 30] * 3)[:3]


def _best_pair(left: dict[int, int], a: int, room: int) -> int:
    """The largest sum of two pieces that fits in the room beside one piece of length a."""
    free = {k: n - (k == a) for k, n in left.items()}
    keys = sorted(k for k, n in free.items() if n > 0)
    best, lo, hi = 0, 0, len(keys) - 1
    while lo <= hi:
        if lo == hi and free[keys[lo]] < 2:
            break
        total = keys[lo] + keys[hi]
        if total <= room:
            best = max(best, total)
            lo += 1
        else:
            hi -= 1
    return best


def lines(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, offset): ranks from 1 within a length, one sequence a rank."""
    rank: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, copies in patterns:
        offset = 0
        for k in pattern:
            start = rank.get(k, 0)
            out.append((k, start + 1, start + copies, sequence, offset))
            rank[k] = start + copies
            offset += k
        sequence += copies
    return out


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                  capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    cutted = cut(pieces(two_columns(docs, id_col, text_col), tokenizer, capacity, end_id))
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns, _ = plan(counts, capacity)
    rows = lines(patterns) or [(0, 0, 0, 0, 0)]
    schema = "length long, lo long, hi long, first long, offset long"
    planned = spark.createDataFrame([tuple(map(int, r)) for r in rows], schema)
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4096))
    ranked = position(cutted, ["length"], block, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank")
    placed = ranked.join(F.broadcast(planned), "length").where("rank between lo and hi")  # plan size depends on capacity alone
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
