"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's subwords are its character 3- to 6-grams with the word's edges, and the word itself, hashed into buckets; each
bucket has an embedding. The embeddings of all subwords of a passage (``passage`` consecutive words) are averaged and go
through a linear softmax; a document's odds add those of its passages (log-sum-exp), so that a few words in a long text
count. The sum is divided by 1 + n * level for n passages, where the level is ``excess`` times the mean odds of the clean
passages learned from, and a passage's odds count up to exp(``most_odds``): clean text does not turn toxic by its length.

Embeddings and softmax are trained together in numpy, in a task, from a sample of labelled rows with a word, of any
length, bounded by ``max_rows`` of each label. A text over ``max_chars`` bytes gives that much in pieces spread evenly over
all of it; it is scored whole. An unseen misspelling shares most of its character n-grams with the word. Scoring needs one
weight per bucket (the embedding's share of the softmax), a table of fixed size.

Texts are read whole as bytes, A-Z in lower case; other ASCII than letters, digits and @ $ * ends a word. Results: null and
empty texts get the score of a text without passages, 0; repeated rows are scored each; a document labelled twice is toxic
if any label says so; without labels of both kinds every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gatelens.functions.lineage import cut
from gatelens.llm.common import BYTE_CODES, Rolling, byte_texts, crc_mod, lowered, sliced

SIZES = (3, 4, 5, 6)
LETTER = np.zeros(256, bool)
LETTER[[*b"abcdefghijklmnopqrstuvwxyz0123456789@$*", *range(128, 256)]] = True
#: The same set as a pattern for SQL functions, before lowering.
HAS_WORD = "[A-Za-z0-9@$*]|[^\\x00-\\x7F]"
#: Bytes of a piece of a text that is too long to be learned from whole.
PIECE = 2000


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    dim: int = 8
    passage: int = 4
    steps: int = 100
    rate: float = 5.0
    decay: float = 1e-3
    max_rows: int = 3000
    max_chars: int = 200_000
    excess: float = 30.0
    most_odds: float = 1.0
    threshold: float = 0.3
    seed: int = 11


@dataclass
class Bags:
    """Subword buckets of concatenated texts: ``word`` per bucket entry, ``passage`` per word, ``doc`` per passage."""

    bucket: np.ndarray
    word: np.ndarray
    word_hash: np.ndarray
    passage: np.ndarray
    doc: np.ndarray


def bags(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Bags:
    low = lowered(data)
    codes = np.insert(np.where(LETTER[low], low, 0), offsets, 0)  # a gap before each text and after the last
    gap = codes == 0
    kept = ~gap | np.concatenate([[True], ~gap[:-1]])
    at = np.flatnonzero(kept)
    codes, gap = codes[kept], gap[kept]
    edge = np.flatnonzero(gap)
    n_words = max(0, len(edge) - 1)
    symbols = BYTE_CODES[codes]
    roll = Rolling(symbols)
    word_of = np.cumsum(gap) - 1
    next_gap = np.append(edge, len(codes) - 1)[np.minimum(word_of + 1, len(edge))]
    buckets, words = [], []
    for n in SIZES:
        h = roll.every(n)
        inside = np.flatnonzero(np.arange(len(h)) + n - 1 <= next_gap[:len(h)])
        inside = inside[word_of[inside] < n_words]
        buckets.append(h[inside] >> np.uint64(64 - s.bits))
        words.append(word_of[inside])
    whole = roll.slices(edge[:-1], edge[1:] + 1) if n_words else np.zeros(0, np.uint64)
    buckets.append((whole ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - s.bits))
    words.append(np.arange(n_words))
    doc_of_word = np.searchsorted(offsets + np.arange(len(offsets)), at[edge[:-1] + 1], "right") - 1 if n_words else np.zeros(0, np.int64)
    first = np.searchsorted(doc_of_word, doc_of_word)
    number = (np.arange(n_words) - first) // s.passage
    new = np.ones(n_words, bool)
    new[1:] = (doc_of_word[1:] != doc_of_word[:-1]) | (number[1:] != number[:-1])
    passage = np.cumsum(new) - 1
    return Bags(np.concatenate(buckets).astype(np.int64), np.concatenate(words), whole, passage, doc_of_word[new])


def log_odds(b: Bags, weight: np.ndarray, bias: float, level: float, s: Settings, n_docs: int) -> np.ndarray:
    """Log-sum-exp over the passages of each text of their softmax log odds, less what their number gives; minus infinity without one."""
    n = len(b.passage)
    total = np.bincount(b.word, weights=weight[b.bucket], minlength=n)
    size = np.bincount(b.word, minlength=n)
    z = np.bincount(b.passage, weights=total) / np.bincount(b.passage, weights=size) + bias if n else np.zeros(0)
    out = np.full(n_docs, -np.inf)
    np.logaddexp.at(out, b.doc, np.minimum(z, s.most_odds))
    return out - np.log1p(level * np.bincount(b.doc, minlength=n_docs))


@dataclass
class TrainingTokens:
    """Distinct words with their buckets (``owner`` per bucket entry, ``size`` per word); the word and passage of each token."""

    bucket: np.ndarray
    owner: np.ndarray
    size: np.ndarray
    kind: np.ndarray
    passage: np.ndarray
    doc: np.ndarray


def training_tokens(texts: list[str], s: Settings, most: int = 1 << 18) -> TrainingTokens:
    """Texts slice by slice, so that only distinct words keep their buckets."""
    known, hashes, sizes, buckets, tokens, passages, docs = np.zeros(0, np.uint64), [], [], [], [], [], []
    start = n_passages = 0
    while start < len(texts):
        raw, stop = [], start
        while stop < len(texts) and (not raw or sum(map(len, raw)) < most):
            raw.append(texts[stop].encode())
            stop += 1
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        b = bags(np.frombuffer(b"".join(raw), np.uint8), offsets, s)
        word, first = np.unique(b.word_hash, return_index=True)
        fresh = ~np.isin(word, known, assume_unique=True)
        order = np.argsort(b.word, kind="stable")
        lo, hi = (np.searchsorted(b.word, first[fresh], side, sorter=order) for side in ("left", "right"))
        size = hi - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())
        buckets.append(b.bucket[order[entry]].astype(np.int32))
        sizes.append(size)
        hashes.append(word[fresh])
        known = np.union1d(known, word[fresh])
        tokens.append(b.word_hash)
        passages.append((b.passage + n_passages).astype(np.int32))
        docs.append((b.doc + start).astype(np.int32))
        start, n_passages = stop, n_passages + len(b.doc)
    if not texts:
        none = np.zeros(0, np.int32)
        return TrainingTokens(none, none, none, none, none, none)
    size, every = np.concatenate(sizes), np.concatenate(hashes)
    order = np.argsort(every)
    kind = order[np.searchsorted(every, np.concatenate(tokens), sorter=order)].astype(np.int32)
    return TrainingTokens(np.concatenate(buckets), np.repeat(np.arange(len(size), dtype=np.int32), size), size, kind, np.concatenate(passages),
                          np.concatenate(docs))


def summed(at: np.ndarray, value: Callable[[slice], np.ndarray], n: int, most: int = 1 << 20) -> np.ndarray:
    """Sums of ``value`` by index, in slices, as bincount copies both of its arguments to 64 bits."""
    out = np.zeros(n)
    for start in range(0, len(at), most):
        part = slice(start, start + most)
        out += np.bincount(at[part], weights=value(part), minlength=n)
    return out


def train(texts: list[str], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float, float]:
    """Bucket weights, bias and level; embeddings and softmax learn together by full-batch Adam."""
    t = training_tokens(texts, s)
    bucket, owner, kind, passage, doc = t.bucket, t.owner, t.kind, t.passage, t.doc
    n_words, n_passages, n_docs, n_buckets = len(t.size), len(doc), len(texts), 1 << s.bits
    passage_size = summed(passage, lambda p: t.size[kind[p]], n_passages)
    has = np.zeros(n_docs, bool)
    has[doc] = True
    y = labels.astype(float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * has
    rng = np.random.default_rng(s.seed)
    # embeddings start small, so that subwords never seen in training weigh next to nothing
    params = [rng.normal(0, scale_, shape).astype(np.float32) for scale_, shape in ((0.01, (n_buckets, s.dim)), (0.3, (2, s.dim)))]
    params.append(np.zeros(2, np.float32))
    speed, scale = [np.zeros_like(p) for p in params], [0.0] * len(params)
    for step in range(1, s.steps + 1):
        embedding, out, bias = params
        direction = out[1] - out[0]
        weight = embedding @ direction
        per_word = summed(owner, lambda p: weight[bucket[p]], n_words)
        z = summed(passage, lambda p: per_word[kind[p]], n_passages) / passage_size + bias[1] - bias[0]
        total = np.full(n_docs, -np.inf)
        np.logaddexp.at(total, doc, z)
        wrong = share * (1 / (1 + np.exp(-np.clip(total, -50, 50))) - y)
        g_z = wrong[doc] * np.exp(np.minimum(z - total[doc], 0))
        g_token = g_z / passage_size
        g_word = summed(kind, lambda p: g_token[passage[p]], n_words)
        g_weight = summed(bucket, lambda p: g_word[owner[p]], n_buckets)
        g_direction = g_weight @ embedding
        grads = [np.outer(g_weight.astype(np.float32), direction) + np.float32(s.decay) * embedding, np.stack([-g_direction, g_direction]),
                 np.array([-g_z.sum(), g_z.sum()])]
        # momentum with one step size for a whole array, not one per entry: what few texts hold must not learn as fast as
        # what many share
        for i, (p, g) in enumerate(zip(params, grads)):
            speed[i] += np.float32(0.1) * (g - speed[i])
            scale[i] = max(scale[i], float(np.linalg.norm(g)))
            p -= np.float32(s.rate / (scale[i] + 1e-12)) * speed[i]
    embedding, out, bias = params
    weight = embedding @ (out[1] - out[0])
    per_word = summed(owner, lambda p: weight[bucket[p]], n_words)
    z = summed(passage, lambda p: per_word[kind[p]], n_passages) / passage_size + bias[1] - bias[0]
    clean = np.exp(np.minimum(z[y[doc] == 0], 0))
    return weight, float(bias[1] - bias[0]), s.excess * float(clean.mean()) if len(clean) else 0.0


def spread(text: str, most: int) -> str:
    """The text, or of a longer one ``most`` bytes in pieces of whole words at even distances from its start to its end."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    parts = []
    for at in np.linspace(0, len(raw) - min(PIECE, most), max(1, most // PIECE)).astype(int):
        words = raw[at:at + min(PIECE, most)].split()
        parts.append(b" ".join(words[1:-1] or words))
    return b" ".join(parts).decode(errors="ignore")


def sampled(docs: DataFrame, labels: DataFrame, learns: Column, s: Settings, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc_id, y, text): at most ``max_rows`` texts of each label, by a fixed pseudo-random order of the ids that have a text with a word."""
    marked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
              .groupBy("doc_id").agg(F.max("y").alias("y")).where(learns))
    order = F.xxhash64(F.col("doc_id"), F.lit(s.seed))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(HAS_WORD))
    # ids alone are ranked, and their texts fetched
    usable = cut(marked.join(texts.select("doc_id"), "doc_id", "left_semi"))
    ids = [usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(s.max_rows) for y in (0, 1)]
    chosen = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "y", "text")

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(2, "text", pa.array([spread(t, s.max_chars) for t in batch.column(2).to_pylist()], pa.string()))

    return chosen.mapInArrow(shorter, "doc_id long, y int, text string")


def labelled_sample(docs: DataFrame, labels: DataFrame, learns: Column, s: Settings, id_col: str, text_col: str,
                    label_col: str) -> tuple[list[str], np.ndarray]:
    """Texts and labels of ``sampled``, in order of their ids."""
    rows = sampled(docs, labels, learns, s, id_col, text_col, label_col).orderBy("doc_id").collect()
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], int)


def trained_in_task(sample: DataFrame, s: Settings) -> tuple[np.ndarray, float, float]:
    """``train`` on the rows of ``sampled``, in one task, as they are bounded; the driver gets 2^bits weights and two numbers."""
    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        y = rows["y"].to_numpy()
        weight, bias, level = train(rows["text"].to_pylist(), y, s) if 0 < y.sum() < len(y) else (np.zeros(0), -np.inf, 0.0)
        return pa.table({"weight": pa.array([weight.astype(np.float32).tobytes()], pa.binary()), "bias": [float(bias)], "level": [float(level)]})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "weight binary, bias double, level double").collect()
    if not found or not found[0]["weight"]:
        return np.zeros(1 << s.bits, np.float32), -np.inf, 0.0
    return np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"], found[0]["level"]


def toxicity_scores(docs: DataFrame, labels: DataFrame, learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with columns ``toxic_score`` (0 to 1) and ``toxic_predicted`` (1 if the score reaches the threshold)."""
    learns = crc_mod(F.col("doc_id"), 4) != 2 if learns is None else learns
    model = trained_in_task(sampled(docs, labels, learns, settings, id_col, text_col, label_col), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights, whatever the corpus
    named = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)], F.col(text_col).alias("__text"))
    fields = [*named.schema.fields[:-1], StructField("toxic_score", DoubleType()), StructField("toxic_predicted", IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, level = shared.value
        for batch in sliced(batches, "__text", 1 << 18):
            data, offsets = byte_texts(batch.column("__text"))
            z = log_odds(bags(data, offsets, settings), weight, bias, level, settings, batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            score[np.isneginf(z)] = 0.0
            columns = [*batch.columns[:-1], pa.array(score), pa.array((score >= settings.threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    scored = named.mapInArrow(run, StructType(fields))
    return scored.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)], "toxic_score", "toxic_predicted")
