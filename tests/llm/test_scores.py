"""Language model, toxicity, token counts and fingerprints."""

import hashlib
import random

import numpy as np
import pytest
import reference
from pyspark.sql import functions as F

from gatelens.llm import chunks, language_model, merkle, token_counts, toxicity


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_language_model(frame, docs, order):
    got = sorted((tuple(r) for r in language_model.language_scores(frame, order=order).collect()), key=str)
    want = sorted(reference.language_scores(docs, order), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_language_model_without_training_rows(frame, docs, nothing):
    assert language_model.language_scores(nothing).collect() == []
    got = language_model.language_scores(frame, learns=lambda i: False).collect()
    assert all(r.held_out and r.n_known == 0 and r.score == r.base_score == 0.0 for r in got)


def test_language_model_mass():
    """Out of a context, the arcs and what fails sum to one."""
    c_pair, c, n, types = {"x": 3, "y": 1}, 4, 50, 9
    base = {"x": 10, "y": 5, "z": 35}
    p = {w: (base[w] + 0.5) / (n + 0.5 * (types + 1)) for w in base}
    rest = 1 - sum(p.values())
    total = sum(0.5 * c_pair.get(w, 0) / c + 0.5 * p[w] for w in base) + 0.5 * rest
    assert total == pytest.approx(1.0)


def test_keys_travel():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.uint64), np.array([2**64 - 1], np.uint64), np.array([0, 2**64 - 1], np.uint64),
                 np.unique(rng.integers(0, 2**64, 5000, np.uint64, endpoint=False))):
        assert (chunks.unstepped(chunks.stepped(keys)) == keys).all()
    assert len(chunks.stepped(keys)) < 8 * len(keys)


def test_counts_travel():
    c = np.array([0, 1, 254, 255, 256, 10**9])
    assert language_model.counts_of(language_model.counts_bytes(c)).tolist() == c.tolist()


@pytest.fixture(scope="module")
def labelled(spark):
    """Bad words with random endings and letters changed, so that held-out forms were never seen."""
    rng = random.Random(5)
    stems = ["grobnak", "wiffler", "zugzwan", "quompet"]
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 8)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.randint(10, 80))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            stem = rng.choice(stems)
            at = rng.randrange(len(stem))
            words[rng.randrange(len(words))] = stem[:at] + rng.choice("aeiou") + stem[at + 1:] + rng.choice(["", "s", "ing", "oid"])
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


def test_toxicity_held_out(labelled):
    scored = toxicity.toxicity_scores(labelled.drop("toxic"), labelled.select("doc_id", "toxic"))
    got = scored.join(labelled.select("doc_id", "toxic"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    hit = sum(r.toxic_predicted == 1 for r in got if r.toxic) / sum(r.toxic for r in got)
    wrong = sum(r.toxic_predicted == 1 for r in got if not r.toxic) / sum(1 - r.toxic for r in got)
    assert hit > 0.9 and wrong < 0.03


def test_toxicity_edges(frame, nothing, labelled, spark):
    few = toxicity.Settings(steps=3)
    labels = labelled.select("doc_id", "toxic")
    out = toxicity.toxicity_scores(frame, labels, settings=few)
    assert out.columns == [*frame.columns, "toxic_score", "toxic_predicted"] and out.count() == frame.count()
    assert all(0 <= r.toxic_score <= 1 for r in out.collect())
    assert out.where("trim(text, ' \t\n') = '' or text is null").where("toxic_score <> 0").count() == 0
    assert toxicity.toxicity_scores(nothing, labels, settings=few).count() == 0
    unlabelled = toxicity.toxicity_scores(frame, labels.where("false"), settings=few)
    assert unlabelled.where("toxic_score <> 0").count() == 0
    null = spark.createDataFrame([(None, 1), (0, None), (1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(frame, null, settings=few).count() == frame.count()


def test_toxicity_of_long_texts(labelled, spark):
    """Clean texts of 0.1 to 5 MB stay clean, and a short toxic one among them toxic."""
    short = [r.text for r in labelled.where("toxic = 0 and doc_id < 700").collect()]
    toxic = [r.text for r in labelled.where("toxic = 1 and crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()]
    size = sum(len(t) + 1 for t in short)
    rows = [(10_000 + k, " ".join(short * max(1, n // size))[:n]) for k, n in enumerate((100_000, 1_000_000, 5_000_000))]
    rows += [(20_000 + k, t) for k, t in enumerate(toxic)]
    long = labelled.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.toxic_predicted for r in toxicity.toxicity_scores(long, labelled.select("doc_id", "toxic")).where("doc_id >= 10000").collect()}
    assert [got[10_000 + k] for k in range(3)] == [0, 0, 0]
    assert sum(got[20_000 + k] for k in range(len(toxic))) > 0.9 * len(toxic)


def test_toxicity_learns_from_long_texts(spark):
    """Long labelled texts are learned from, over all of their length; rows without a word do not use up the limit."""
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(i, long if i == 5 else None if i < 5 else " .,; " if i < 10 else f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) toxic")
    s = toxicity.Settings(max_rows=6, max_chars=20_000)
    texts, y = toxicity.labelled_sample(docs, labels, F.lit(True), s, "doc_id", "text", "toxic")
    assert len(texts) == 11 and y.sum() == 6
    got = [int(w[1:]) for t in texts for w in t.split() if w[0] == "w"]
    assert len(got) > 2500 and got == sorted(got) and got[0] < 10 and got[-1] > 59_900 and max(np.diff(got)) < 10_000
    assert max(len(t) for t in texts) <= 20_000


def test_toxicity_trains_in_a_task(spark, monkeypatch):
    """The driver holds no training text and trains nothing, and the model is the one that all of the sample gives in order."""
    docs = spark.createDataFrame([(i, f"bad w{i % 7} thing" if i % 3 == 0 else f"nice w{i % 7} day") for i in range(90)], "doc_id long, text string").repartition(5)
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) toxic")
    s = toxicity.Settings(bits=12, steps=20)
    want = toxicity.train(*toxicity.labelled_sample(docs, labels, F.lit(True), s, "doc_id", "text", "toxic"), s)
    got = toxicity.trained_in_task(toxicity.sampled(docs, labels, F.lit(True), s, "doc_id", "text", "toxic"), s)
    assert got[0].dtype == np.float32 and (got[0] == want[0]).all() and got[1:] == want[1:]
    none = toxicity.trained_in_task(toxicity.sampled(docs, labels.where("toxic = 1"), F.lit(True), s, "doc_id", "text", "toxic"), s)
    assert len(none[0]) == 1 << s.bits and none[1] == -np.inf
    monkeypatch.setattr(toxicity, "labelled_sample", None)
    out = toxicity.toxicity_scores(docs, labels, F.lit(True), settings=s)
    assert out.where("toxic_predicted <> int(doc_id % 3 = 0)").count() == 0


def test_bags_end_at_documents():
    s = toxicity.Settings(passage=2)
    texts = ["ab", "", "Ab cd, ef", "!!", "ab"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    b = toxicity.bags(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]), s)
    assert b.doc.tolist() == [0, 2, 2, 4] and b.passage.tolist() == [0, 1, 1, 2, 3]
    assert b.word_hash[0] == b.word_hash[1] == b.word_hash[4]


def test_token_counts(frame, docs, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.default_vocabulary()
    exact = Tokenizer(models.Unigram([("\x00none", vocabulary[-1][1]), *vocabulary], unk_id=0))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    got = sorted(((r.doc_id, r.n_tokens, r.n_words) for r in token_counts.token_counts(frame).collect()), key=str)
    want = sorted(((i, len(exact.encode(t or "", add_special_tokens=False).ids), len((t or "").split())) for i, t in docs), key=str)
    assert got == want
    assert token_counts.token_counts(nothing).collect() == []


def test_token_ties_and_unknowns():
    """Ties go to the longest last piece; unknown characters in a row count once."""
    from tokenizers import Tokenizer, models

    rng = random.Random(2)
    vocabulary = [(p, float(-rng.randint(1, 3))) for p in ["▁", "a", "b", "ab", "ba", "aba", "▁a", "bab", "▁ab", "c"]]
    exact = Tokenizer(models.Unigram([("\x00", -3.0), *vocabulary], unk_id=0))
    model = token_counts.CountingViterbi(vocabulary)
    words = ["▁" + "".join(rng.choices("abcxy", k=rng.randint(1, 12))) for _ in range(400)]
    assert [n for n, _ in model.count_all(words)] == [len(exact.encode(w).ids) for w in words]


def test_fingerprints(frame, docs, nothing):
    got = merkle.edit_report(frame).collect()
    want = reference.edited(docs)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(((i, len(t), digest(e)) for i, t, e, _ in want), key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_print = {}
    for r in got:
        by_print.setdefault(r.fingerprint, set()).add((r.n_chars,))
    assert len(by_print) == len({t or "" for _, t in docs})
    assert merkle.edit_report(nothing).collect() == []


def test_next_over_ranges(spark):
    ids = [i * 7 for i in range(300)] + [None, 21, 2**62]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    want = {(t, n) for _, t, _, n in reference.edited([(i, f"t{i}") for i in ids])}
    got = {(r.text, r.next_text) for r in merkle.with_next(df, ranges=20, rows_per_range=5).collect()}
    assert got == want


def test_edit_shows_in_its_branch(spark):
    lines = [f"Line number {i} of the text.\n" for i in range(200)]
    changed = [*lines[:100], "Another line.\n", *lines[101:]]
    df = spark.createDataFrame([(1, "".join(lines)), (2, "".join(changed))], "doc_id long, text string")
    a, b = (r.f for r in merkle.fingerprints(df, {"text": "f"}).orderBy("doc_id").collect())
    a, b = a.split("/"), b.split("/")
    assert a[0] != b[0] and len(set(a[1:]) - set(b[1:])) <= 2 and len(set(a[1:]) & set(b[1:])) > 10


def test_native_plan(frame):
    plan = merkle.edit_report(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
