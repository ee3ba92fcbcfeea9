import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a caller's table may have them too.
CLASHES = ["chunk", "shard", "bits", "size", "key", "order", "range", "rank", "length", "piece", "copy", "due", "row", "__0", "answer"]


def sentence(rng, n):
    return " ".join("".join(rng.choices("aeioustrnl", k=rng.randint(1, 7))) for _ in range(n))


def corpus(seed=3, n=40):
    """Copies, near copies, shared passages, repeated lines, short and long texts, nulls, ties, repeated rows and ids."""
    rng, docs = random.Random(seed), []
    shared, line = sentence(rng, 40), sentence(rng, 12)
    for i in range(n):
        kind = i % 8
        text = sentence(rng, rng.randint(20, 160))
        if kind == 1:
            text = f"{text}\n{shared}. {sentence(rng, 20)}"
        elif kind == 2 and docs:
            words = docs[rng.randrange(len(docs))][1].split() or ["x"]
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 3 and docs:
            text = docs[rng.randrange(len(docs))][1]
        elif kind == 4:
            text = f"{line} {line} {sentence(rng, 9)} {line}\n" * 3
        elif kind == 5:
            text = "été ñandú ß 日本語 😀 " * rng.randint(1, 12) + text
        docs.append((i * 3, text))
    docs += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "One"), (1004, "one two"), (1005, "a" * 700), (1006, "a " * 400),
             (1007, docs[0][1]), (1007, docs[0][1]), (1008, shared), (1008, line), (None, shared), (None, None), (None, docs[1][1]),
             (1009, sentence(rng, 9000))]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def docs():
    return corpus()


@pytest.fixture(scope="session")
def frame(spark, docs):
    """The corpus as a table, with columns of clashing names."""
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 4}", None if t is None else len(t)) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, df["doc_id"] * 0)
    return df.repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(frame):
    return frame.where("false")


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    """Chunks and shards so small that a few kilobytes take many of them."""
    from gatelens.llm import chunks, language_model, substring_dedup, suffix_dedup

    monkeypatch.setattr(chunks.chunked, "__defaults__", (3000, None))
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 3000)
    for module in (language_model, substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "TEXT_PER_SHARD", 4000)
