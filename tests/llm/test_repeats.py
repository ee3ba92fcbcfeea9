"""Suffix-array and substring deduplication against sets of all windows."""

import random

import numpy as np
import pytest
import reference

from gatelens.llm import language_model, repeats, substring_dedup, suffix_dedup
from gatelens.llm.common import Rolling


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("length, gram", [(100, 24), (30, 24), (30, 5), (7, 7)])
def test_bytes(frame, docs, length, gram):
    got = suffix_dedup.removed_bytes(frame, threshold=length, gram=gram)
    assert key(got.collect()) == key(reference.removed_bytes(docs, length))


@pytest.mark.parametrize("length, gram", [(13, 6), (4, 2), (5, 5)])
def test_words(frame, docs, length, gram):
    got = substring_dedup.removed_words(frame, length=length, gram=gram)
    assert key(got.collect()) == key(reference.removed_words(docs, length))


def test_nothing(nothing):
    assert suffix_dedup.removed_bytes(nothing).collect() == [] and substring_dedup.removed_words(nothing).collect() == []


def test_crowded(spark):
    """Many copies of one text, one very common passage in ever new surroundings, and periodic texts."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    copy, passage = text(60), text(30)
    docs = [(i, copy) for i in range(60)] + [(100 + i, f"{text(12)} {passage} {text(9)}") for i in range(60)] + [(300 + i, "ab" * (70 + i)) for i in range(9)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert key(suffix_dedup.removed_bytes(df).collect()) == key(reference.removed_bytes(docs))
    assert key(substring_dedup.removed_words(df).collect()) == key(reference.removed_words(docs))


def test_cut_texts(frame, docs):
    """Whole characters only; all columns and rows stay."""
    out = suffix_dedup.without_repeats(frame)
    assert out.columns == frame.columns and out.count() == frame.count()
    texts = {r.doc_id: r.text for r in out.where("doc_id is not null and doc_id <> 1007 and doc_id <> 1008").collect()}
    for i, n, gone, _, _ in reference.removed_bytes(docs):
        if i in texts:
            left = len((texts[i] or "").encode())
            assert n - gone <= left <= n - gone + 3 * 40 and (gone or left == n)


def test_radix_groups():
    rng = np.random.default_rng(0)
    digits = [rng.integers(0, 4, 300).astype(np.uint64) for _ in range(3)]
    index, group = repeats.radix_groups(digits)
    rows = list(zip(*(d.tolist() for d in digits)))
    alone = {i for i in range(300) if rows.count(rows[i]) == 1}
    assert set(range(300)) - alone == set(index.tolist())
    by = {}
    for i, g in zip(index.tolist(), group.tolist()):
        by.setdefault(g, set()).add(rows[i])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(rows[i] for i in index.tolist()))


def test_blocks_cover_each_window_once():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 3, 400).astype(np.uint64)
    offsets = np.array([0, 5, 5, 160, 163, 400])
    w = repeats.Windows(None, 20, 6, 3, True)
    b = repeats.slice_blocks(symbols, offsets, w)
    covered = sorted((int(r), p) for r, f, l in zip(b.row, b.first, b.last) for p in range(f, l + 1))
    assert covered == [(r, p) for r in range(5) for p in range(offsets[r + 1] - offsets[r] - 19)]


def test_sketch_never_loses(frame, docs):
    """Estimates are at least the true counts: with one-bit cells nearly all collide and the result is the same."""
    assert (substring_dedup.cells(np.arange(5, dtype=np.uint64), 1) != np.arange(5)).all()
    import pyarrow as pa

    from gatelens.llm import chunks as ch
    keys = np.sort(np.array([1, 1 << 62, 3 << 61, (3 << 61) + 1], np.uint64))
    row = ch.questions([(0, (keys, [np.array([1, 1, 1, 1])]))], 1, 1, 3)
    (bits,) = substring_dedup.merged_estimates(pa.Table.from_batches([row]), 3)
    assert substring_dedup._bits(bits).tolist() == [False, False, True, True]


def test_rolling():
    x = np.arange(1, 50, dtype=np.uint64)
    twice = Rolling(np.concatenate([x, x]))
    assert twice.slices(np.array([3]), np.array([20])) == twice.slices(np.array([52]), np.array([69]))
    assert (twice.every(7)[:40] == twice.every(7)[49:89]).all()


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_long_words_that_a_polynomial_hash_confuses(spark):
    """Words of 64 to 8,192 bytes and their complements are different words to every operator on words."""
    docs = []
    for k, n in enumerate((64, 128, 1024, 2048, 4096, 8192)):
        one = thue_morse(n)
        other = one.translate(str.maketrans("ab", "ba"))
        rest = [f"w{k}x{i}" for i in range(12)]
        docs += [(10 * k, " ".join([one, *rest])), (10 * k + 1, " ".join([other, *rest])), (10 * k + 2, " ".join([one, *rest]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.removed_words(frame).collect())) == sorted(reference.removed_words(docs))
    got = {r.doc_id: r for r in language_model.language_scores(frame).collect()}
    for i, held, n, known, train, base, score in reference.language_scores(docs):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, train)
        assert got[i].base_score == pytest.approx(base)
