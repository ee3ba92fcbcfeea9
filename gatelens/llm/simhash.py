"""SimHash near-duplicates: one-wildcard variants of two segments as equality keys, then verification.

A fingerprint has 64 bits; two that differ in at most two bits differ in at most one bit in one of the two 32-bit
segments. Every distinct fingerprint is indexed under each segment with each of its bits deleted, so such a pair
shares a key. Keys are grouped, never cross-joined: a key with two members gives a pair that is verified; the members
of a key with more (a crowded one) are linked through deletion variants of the whole fingerprint, of which two
fingerprints share one exactly when they differ in at most two bits, each linked to the least member of its variant.
So no group of any size is turned into all its pairs, and no link of the graph's components is lost.

Results: null and empty texts, and texts of white space, have fingerprint zero and link like any other; texts with
fewer words than a shingle are one shingle. Repeated rows keep one output row each; a null id keeps its row and takes
the component's smallest id that is not null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.lineage import cut
from gatelens.llm.common import two_columns


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[at:at + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, bits long): a bit is 1 if set in over half of the shingles' XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            bits = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "bits"])

    return docs.mapInArrow(run, "doc_id long, bits long")


def links(bits: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, between distinct fingerprints (column ``bits``) whose graph has the components asked for."""
    low = F.lit(0xFFFFFFFF)
    bit = F.expr("shiftleft(1L, j)")
    half = F.when(F.col("j") < 32, F.col("bits").bitwiseAND(low)).otherwise(F.col("bits").bitwiseAND(F.lit(-1 << 32)))
    keyed = (bits.select("bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
             .select("bits", F.col("j").cast("byte").alias("j"), half.bitwiseAND(F.bitwise_not(bit)).alias("rest")))
    keys = cut(keyed.groupBy("j", "rest").agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("v"), F.max("bits").alias("u"))
               .where("n > 1"))
    pairs = keys.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    # merged whatever the size, so that a plan that is cheap on little data holds on much; skewed keys are split there
    crowded = cut(keyed.join(keys.where("n > 2").select("j", "rest").hint("merge"), ["j", "rest"]).select("bits").distinct())
    near = (crowded.select("bits", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("j"))
            .select("bits", F.when(F.col("j") < 0, F.col("bits")).otherwise(F.col("bits").bitwiseXOR(bit)).alias("variant")))
    least = near.groupBy("variant").agg(F.min("bits").alias("v"), F.max("bits").alias("u")).where("u > v")
    stars = near.join(least.select("variant", "v"), "variant").where("bits > v").select(F.col("bits").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable. ``edges`` has u > v.

    Alternating star rounds: each node hangs its larger neighbours on its least neighbour, then its smaller ones; the
    number of rounds follows the logarithm of the size, not the length of a chain. Each round is a written table.
    """
    edges, seen = cut(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(least.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): n_links is the number of other texts' rows in the component."""
    marked = cut(fingerprints(two_columns(docs, id_col, text_col), shingle, seed))
    each = cut(marked.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    rooted = components(links(each.select("bits")))
    each = each.join(rooted.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    groups = each.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("all"))
    each = each.join(groups, "root").select("bits", "component_id", (F.col("all") - 1).alias("n_links"))
    return (marked.join(each, "bits")
            .select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id", "n_links"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without the near-duplicates of another row: the row with a component's smallest id stays.

    Of rows that share an id one stays. Rows without an id can't be named as duplicates; all of them stay.
    """
    grouped = near_duplicates(docs, id_col, text_col, shingle, seed)
    kept = grouped.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    return named.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
