"""SimHash links, packing, mixing and top-k search."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import reference
from pyspark.sql import functions as F

from gatelens.llm import mixing, packing, simhash, topk


def test_near_duplicates(frame, docs, nothing):
    bits = [reference.simhash(t) for _, t in docs]
    roots = reference.components(bits)
    least = {}
    for r, (i, _) in zip(roots, docs):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    sizes = Counter(roots)
    want = sorted(((i, f"{b:016x}", least[r], sizes[r] - 1) for (i, _), b, r in zip(docs, bits, roots)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(frame).collect()), key=str) == want
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("n", [40, 900])
def test_links_lose_nothing(spark, n):
    """Clouds of fingerprints around few centres (crowded keys), chains two bits apart, and random ones."""
    rng = random.Random(n)
    bits = set()
    for _ in range(n // 100 + 1):
        centre = rng.getrandbits(64)
        for _ in range(n // 4):
            bits.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    x = rng.getrandbits(64)
    for _ in range(30):
        x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        bits.add(x)
    bits |= {rng.getrandbits(64) for _ in range(50)}
    bits = sorted(bits)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    df = spark.createDataFrame([(b,) for b in signed], "bits long")
    edges = simhash.links(df)
    assert all(((a.u ^ a.v) & (1 << 64) - 1).bit_count() <= 2 and a.u > a.v for a in edges.collect())
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = Counter(root.get(b, b) for b in signed)
    assert sorted(groups.values()) == sorted(Counter(reference.components(bits)).values())


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1001, 1000)], "u long, v long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 301)} | {(1001, 1000)}


def test_one_of_each_group(frame, docs):
    out = simhash.one_of_each_group(frame)
    assert out.columns == frame.columns
    named = [(i, t) for i, t in docs if i is not None]
    roots = dict(zip((i for i, _ in docs), reference.components([reference.simhash(t) for _, t in docs])))
    left = [r.doc_id for r in out.collect()]
    assert left.count(None) == 3 and len({x for x in left if x is not None}) == len(left) - 3
    assert {roots[i] for i in left if i is not None} == {roots[i] for i, _ in named}


@pytest.mark.parametrize("seed", range(40))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 1024])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.randint(1, max(1, capacity // 3)) for _ in range(rng.randint(0, 300))]
    patterns, fixed = packing.plan(dict(Counter(lengths)), capacity)
    assert all(sum(p) <= capacity and n > 0 for p, n in patterns)
    assert Counter(k for p, n in patterns for k in p for _ in range(n)) == Counter(lengths)
    assert 0 <= fixed <= sum(n for _, n in patterns)


def least_bins(lengths, capacity):
    """Exact optimum for a few pieces."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins) if x >= lengths[i]}.values():
            bins[b] -= lengths[i]
            put(i + 1, bins)
            bins[b] += lengths[i]
        put(i + 1, [*bins, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_an_optimum(seed):
    """What the reduction fixes, with the best packing of the rest, is a best packing of all."""
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(9)]
    patterns, fixed = packing.plan(dict(Counter(lengths)), 20)
    done, rest, count = [], [], 0
    for p, n in patterns:
        for _ in range(n):
            (done if count < fixed else rest).append(p)
            count += 1
    tail = [k for p in rest for k in p]
    assert fixed + (least_bins(tail, 20) if tail else 0) == least_bins(lengths, 20)


def test_packing(frame, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    extra = frame.sparkSession.createDataFrame([(77, "a <|endoftext|> b <|endoftext"), (78, "x  \n\n  y's 12")], "doc_id long, text string")
    every = frame.select("doc_id", "text", "piece", "rank").unionByName(extra, allowMissingColumns=True)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.best_fit_pack(every, capacity=64).collect()
    want = []
    for i, t in [*docs, (77, "a <|endoftext|> b <|endoftext"), (78, "x  \n\n  y's 12")]:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            stop = start + ((len(ids) - start - 1) % 64 + 1 if piece == 0 else 64)
            want.append((i, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            start, piece = stop, piece + 1
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= 1.03 * sum(r.length for r in got) / 64 + 2
    assert packing.best_fit_pack(nothing).collect() == []


@pytest.mark.parametrize("text", [" " * 5_000_000 + "x", " \n" * 300_000, "a" * 5_000_000, "a" * 6_000 + " b", "x\u2003\t" * 400 + " " * 700 + "y",
                                  "ab" * 3_000 + "  " + "1" * 9_000])
def test_long_runs_get_the_library_s_ids(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.array([*exact.encode(text, add_special_tokens=False).ids, 2], "<u4")
    got = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert sum(r.length for r in got) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in got)


def best_fit(pieces, capacity):
    """Number of sequences of plain best-fit decreasing."""
    rooms = []
    for k in sorted(pieces, reverse=True):
        fit = min((r for r in rooms if r >= k), default=None)
        if fit is None:
            rooms.append(capacity - k)
        else:
            rooms.remove(fit)
            rooms.append(fit - k)
    return sorted(rooms)


def test_remainder_is_packed_best_fit():
    rng = np.random.default_rng(6)
    for _ in range(60):
        capacity = int(rng.integers(5, 80))
        pieces = rng.integers(1, capacity + 1, int(rng.integers(1, 120))).tolist()
        patterns = packing._best_fit(dict(Counter(pieces)), capacity)
        assert Counter(k for p, n in patterns for k in p for _ in range(n)) == Counter(pieces)
        assert sorted(capacity - sum(p) for p, n in patterns for _ in range(n)) == best_fit(pieces, capacity)


def test_mixing(frame, docs, nothing):
    got = mixing.curriculum(frame).collect()
    assert len(got) == len(docs)
    totals = Counter()
    for r in frame.collect():
        totals[r.source] += len((r.text or "").split())
    sources = sorted((s for s in totals if s is not None)) + [None]
    want = dict(zip(sources, reference.targets([totals[s] for s in sources])))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        assert r.taken == r.copies * r.size and len(r.due or []) == r.copies and all(0 <= d <= 1 for d in r.due or [])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sources:
        spare = [r.size for r in got if r.source == s and r.size and r.copies < 3]
        small = sum(r.size for r in got if r.source == s and r.size <= 0.05 * want[s])
        assert -1 <= want[s] - taken[s] <= max(0, min(spare, default=0) - 1) + 1
        assert 3 * small < want[s] or want[s] - taken[s] <= 0.05 * want[s]  # unless its documents are too long for that
    assert mixing.curriculum(nothing).collect() == [] and mixing.mixture(nothing).collect() == []


def test_mixing_caps(spark):
    rows = [(i, "w " * 10, "small" if i < 3 else "large") for i in range(60)]
    got = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.source, round(r.target)) for r in got} == {("large", 510), ("small", 90)}


def test_mixing_with_a_document_longer_than_the_target(spark):
    """The long document comes first in every order and never fits; the short one fills what it may."""
    rows = [(i, "w " * n, "a") for i, n in ((1, 9000), (2, 1000))] + [(3, "w " * 10000 + " x" * 100, "b"), (4, "y " * 13, "b"), (5, "y " * 13, "b"), (6, "", "b"), (7, None, "a")]
    for ids in ((1, 2), (2, 1)):
        renamed = [(dict(zip((1, 2), ids)).get(i, i), t, s) for i, t, s in rows]
        got = mixing.curriculum(spark.createDataFrame(renamed, "doc_id long, text string, source string"), weights=(45, 155)).collect()
        copies = {(r.source, r.size): r.copies for r in got}
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
        assert copies["a", 1000] == 3 and copies["a", 9000] == 0 and taken["a"] == 3000


def test_gap_is_filled_as_by_hand(spark):
    rng = np.random.default_rng(8)
    for case in range(3):
        sizes = rng.integers(0, [6, 60, 900][case], 80).tolist()
        rows = [(i, "w " * n, "s") for i, n in enumerate(sizes)] + [(1000, "w " * int(rng.integers(1, 9000)), "t")]
        got = {r.doc_id: r for r in mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2)).collect()}
        order = sorted(range(80), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        quota, total = round(got[0].target), sum(sizes)
        passes, upto, copies = quota // total, 0, {}
        for i in order:
            upto += sizes[i]
            copies[i] = passes + (upto <= quota - passes * total)
        gap = quota - sum(copies[i] * sizes[i] for i in order)
        for i in sorted(order, key=lambda i: -sizes[i]):  # stable: ties stay in order
            while sizes[i] and copies[i] < 3 and sizes[i] <= gap:
                copies[i] += 1
                gap -= sizes[i]
        assert {i: got[i].copies for i in order} == copies


def test_mixture_rows(frame):
    plan = {(r.doc_id, r.text_hash): r.copies for r in mixing.curriculum(frame).collect()}
    out = mixing.mixture(frame)
    assert out.columns == frame.columns
    counts = Counter((r.doc_id, r.h) for r in out.withColumn("h", F.xxhash64("text")).collect())
    repeated = Counter((r.doc_id, r.h) for r in frame.withColumn("h", F.xxhash64("text")).collect())
    for k, n in repeated.items():
        if n == 1:
            assert counts[k] == plan[k]
    assert sum(counts.values()) == sum(r.copies for r in mixing.curriculum(frame).collect())


def test_time_inverts_the_demand(spark):
    for slope in (-0.5, 0.0, 0.5, 0.9):
        df = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing._time(F.col("u"), F.lit(slope)))
        for r in df.collect():
            assert slope * r.t ** 2 + (1 - slope) * r.t == pytest.approx(r.u)


@pytest.mark.parametrize("scale, dim", [(256.0, 16), (1e7, 5), (256.0, 1)])
def test_top_k(spark, scale, dim):
    rng = np.random.default_rng(dim)
    v = np.concatenate([rng.normal(size=(150, dim)) * 0.3, np.repeat(rng.normal(size=(3, dim)), 20, axis=0)]).astype(np.float32)
    rows = [(i if i != 77 else 76, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * (dim - 2) if dim > 1 else [None], 1), (950, [float("nan")] * dim, 1), (902, [float("inf")] * dim, 1),
             (None, [0.5] * dim, 1), (1000, [0.5] * (dim + 1), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, scale=scale, query_block=2, block=50).collect()
    sound = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in e]) for i, e, _ in rows
             if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for i, q in sound:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in sound if j != i and len(c) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.exact_top_k(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()


def test_top_k_in_waves(spark, monkeypatch):
    """Queries that don't fit one wave, several vectors an id, and candidates in one task or many give the brute-force answer; no block is copied to a pair."""
    rng = np.random.default_rng(8)
    rows = [(i // 2 if i % 7 == 0 else i, rng.normal(size=6 if i % 5 else 9).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "WAVE_BYTES", 1000)
    waves, compared = [], topk._broadcast
    monkeypatch.setattr(topk, "_broadcast", lambda queries, wave: waves.append(wave) or compared(queries, wave))
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, query_block=8, block=30)
    assert len(waves) > 3 and len({b for w in waves for b in w}) == sum(map(len, waves))
    want = []
    whole = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in rows]
    for i in {i for i, _ in whole if i % 10 == 0}:
        found = sorted((-int(q @ c), j) for k, q in whole if k == i for j, c in whole if j != i and len(c) == len(q))[:5]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.schema["rank"].dataType.simpleString() == "int" and topk.exact_top_k(df.where("vec_id = 1"), F.col("vec_id") % 10 == 0).schema == got.schema
