"""Mixing sources to target weights along a curriculum that changes with training time.

Sources share the corpus' total size by weight; no source is taken more than ``repeats`` times, and what it cannot
give is shared again by weight (water-filling). Within a source, documents stand in a fixed pseudo-random order (md5 of
the id). A source's target is met by whole passes over it and a partial one: the documents in front of the first that does not fit
whole. What is then missing is filled from further copies, largest documents first, each as often as it still fits and no
document more than ``repeats`` times in all. So a source stays below its target by less than its smallest document that has
copies left, and reaches it if sizes allow.

Time runs from 0 to 1. A source's weight at time t is its weight times 1 + slope * (2t - 1); the integral of that is
its cumulative demand, and a document whose words end at share u of the source's taken words is due where the
integral reaches u: t = 2u / (1 - slope + sqrt((1 - slope)^2 + 4 slope u)). Documents are range-sorted by that time.

Running sums are block-wise (4096 blocks of the order in each source), so a hot source is spread over all tasks; one row per
source meets in one task (sources are few by contract), and one row per source and distinct size in the task that fills the gap. Results: null texts have size 0; a null source is a source, ordered last;
repeated rows count each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.blocks import running_total
from gatelens.functions.lineage import cut
from gatelens.llm.common import WORD


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(source, source_size) to (source, number, source_size, weight, target): one row per source."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = (sizes.withColumn("number", F.row_number().over(everything) - 1)
               .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
               .withColumn("cap", F.col("source_size") * repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the first source whose cap is not below its share, were all before it capped, sets the level
    stepped = (weighed.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(up_to), F.lit(0)))
                                  / F.sum("weight").over(from_here))
               .withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))))
    level = F.first("level", ignorenulls=True).over(all_rows)
    return (stepped.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))))
            .select("source", "number", "source_size", "weight", "target"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = (1, 2, 3), slopes: tuple[float, ...] = (-0.5, 0.0, 0.5), repeats: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken, due, text_hash.

    ``due`` holds the training time of each copy; ``text_hash`` tells rows with one id apart.
    """
    # the pattern counts what the word pattern matches without building the matches
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                            F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("text_hash")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, repeats)
    named = (sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("text_hash").cast("string"))))))
    summed = running_total(named, ["number"], F.substring("order", 1, 3),
                           [F.col("order"), F.col("doc_id"), F.col("size"), F.col("text_hash")], F.col("size"), "upto")
    quota = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    placed = cut(summed.withColumn("passes", passes).withColumn("rest", quota - F.col("passes") * F.col("source_size"))
                 .withColumn("base", (F.col("passes") + (F.col("upto") <= F.col("rest")).cast("int")).cast("int"))
                 .withColumn("spare", F.when(F.col("size") > 0, F.greatest(F.lit(repeats) - F.col("base"), F.lit(0))).otherwise(0)))
    gaps = placed.groupBy("number").agg((F.max(quota) - F.sum(F.col("size") * F.col("base"))).alias("gap"))
    sizes = placed.where("spare > 0").groupBy("number", "size").agg(F.sum("spare").alias("units"))
    fills = sizes.join(gaps, "number").where("size <= gap").groupBy("number").applyInArrow(_filled_gap, "number int, size long, units long")
    filled = placed.join(fills.withColumnRenamed("units", "extra"), ["number", "size"], "left_semi")
    spared = running_total(filled, ["number", "size"], F.substring("order", 1, 3), [F.col("order"), F.col("doc_id"), F.col("text_hash")], F.col("spare"), "spared")
    more = (spared.join(fills.withColumnRenamed("units", "extra"), ["number", "size"])
            .withColumn("more", F.greatest(F.least(F.col("extra") - F.col("spared") + F.col("spare"), F.col("spare")), F.lit(0)).cast("int")))
    kept = placed.join(fills.select("number", "size"), ["number", "size"], "left_anti").withColumn("more", F.lit(0))
    chosen = more.select(*kept.columns).unionByName(kept).withColumn("copies", F.col("base") + F.col("more"))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("number") % len(slopes) + 1).cast("int"))
    due = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: _time(
        F.least(F.lit(1.0), (c * F.col("source_size") + F.col("upto")) / F.greatest(quota, F.lit(1))), slope)))
    planned = chosen.withColumn("due", due).withColumn("taken", F.col("size") * F.col("copies"))
    return planned.select("doc_id", "size", "source", "source_size", "target", "copies", "taken", "due", "text_hash")


def _filled_gap(t: pa.Table) -> pa.Table:
    """How many units of each size fill a source's gap: the largest first, each as often as it fits and there are copies."""
    left, out = t["gap"][0].as_py(), []
    for size, units in sorted(zip(t["size"].to_pylist(), t["units"].to_pylist()), reverse=True):
        n = min(units, left // size)
        if n > 0:
            out.append((size, n))
            left -= n * size
    return pa.table({"number": pa.array([t["number"][0].as_py()] * len(out), pa.int32()), "size": pa.array([s for s, _ in out], pa.int64()),
                     "units": pa.array([n for _, n in out], pa.int64())})


def _time(u, slope):
    return 2 * u / (1 - slope + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The training set: ``docs`` rows as often as the mix takes them, range-sorted by training time.

    Plan and texts meet by id; rows that share id and text are numbered on both sides, so that each gets one plan row.
    """
    def numbered(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))

    names = [f"__{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)],
                       F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash"), F.col(source_col).cast("string").alias("__s"))
    plan = (curriculum(docs, id_col, text_col, source_col, **settings).where("copies > 0")
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("source").alias("__s"), "due"))
    keys = ["__id", "__hash", "__s"]
    a, b = numbered(rows, *keys), numbered(plan, *keys).toDF("__pid", "__phash", "__ps", "due", "__pn")
    met = a.join(b, F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__hash") == F.col("__phash"))
                 & F.col("__s").eqNullSafe(F.col("__ps")) & (F.col("__n") == F.col("__pn")))
    timed = met.select(*names, F.explode("due").alias("__due"))
    id_name = names[docs.columns.index(id_col)]
    ordered = timed.repartitionByRange("__due", id_name).sortWithinPartitions("__due", id_name)
    return ordered.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
