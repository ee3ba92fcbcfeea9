"""Interactions, cut pressure, spans and entangling runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.constants import ENTANGLING, THREE_QUBIT, TWO_QUBIT
from gatelens.functions.blocks import position, running_total
from gatelens.functions.exprs import at_least_one, d

RUN_BLOCK = 65_536


def interactions(gates: DataFrame) -> DataFrame:
    """(file, a, b) and ``seq`` if the gates carry it. A 2q gate gives its first two qubits, a 3q gate all pairs."""
    q = F.col("qubits")
    first_two = F.array(F.struct(q[0].alias("a"), F.element_at(q, 2).alias("b")))
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.size(q) - 1), lambda i: F.transform(
        F.slice(q, i + 1, F.size(q)), lambda b: F.struct(F.element_at(q, i).alias("a"), b.alias("b")))))
    pairs = F.when(F.col("name").isin(TWO_QUBIT), first_two).when(F.col("name").isin(THREE_QUBIT), each)
    keep = [c for c in ("file", "seq") if c in gates.columns]
    many = gates.where(F.col("name").isin(ENTANGLING) & (F.size("qubits") >= 2))
    return many.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.a", "p.b")


def interaction_graph(inter: DataFrame) -> DataFrame:
    """Edges (file, u, v, weight) with u <= v; multiplicity is summed before the shuffle."""
    return inter.groupBy("file", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(
        F.count(F.lit(1)).alias("weight"))


def crossing_profile(spans: DataFrame, lo: str, hi: str, weight: Column, spine: DataFrame) -> DataFrame:
    """(file, cut, pressure) for cut = 1..n-1: total weight of the spans with lo < cut <= hi, zeros included.

    Each span adds +w at lo+1 and -w at hi+1, so the work is linear in edges plus cuts. Rows per circuit are
    bounded by its qubit count because the steps are summed by position before the running total.
    ``spine`` is (file, n_qubits).
    """
    def step(cut: Column, size: Column, is_cut: bool = False) -> Column:
        return F.struct(cut.cast("int").alias("cut"), size.cast("long").alias("step"), F.lit(is_cut).alias("is_cut"))

    steps = spans.select("file", F.explode(F.array(step(F.col(lo) + 1, weight), step(F.col(hi) + 1, -weight))).alias("s"))
    cuts = spine.where(F.col("n_qubits") > 1).select("file", F.explode(
        F.transform(F.sequence(F.lit(1), F.col("n_qubits").cast("int") - 1), lambda c: step(c, F.lit(0), True))).alias("s"))
    summed = steps.unionByName(cuts).groupBy("file", "s.cut").agg(
        F.sum("s.step").alias("step"), F.max("s.is_cut").alias("is_cut"))
    run = Window.partitionBy("file").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (summed.withColumn("pressure", F.sum("step").over(run)).where("is_cut")
            .select("file", "cut", "pressure"))


def cut_pressure(edges: DataFrame, spine: DataFrame) -> DataFrame:
    """Cut-pressure statistics over all n-1 cuts; zeros for circuits of at most one qubit.

    Works on weighted edges, which carry the same information as single gates.
    """
    gates = crossing_profile(edges, "u", "v", F.col("weight"), spine)
    x = F.col("pressure")
    stats = gates.groupBy("file").agg(
        F.max(x).alias("mx"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sum(x).alias("total"),
        F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0)).alias("xlog"),
        F.count(F.when(x > 0, True)).alias("active"), F.count(F.lit(1)).alias("cuts"))
    total = d(F.col("total"))
    out = stats.select(
        "file", d(F.col("mx")).alias("max_cut_pressure"), F.col("mean").alias("mean_cut_pressure"),
        F.col("std").alias("std_cut_pressure"), total.alias("sum_cut_pressure"),
        F.when(total > 0, F.greatest(F.log2(total) - F.col("xlog") / total, F.lit(0.0))).otherwise(0.0)
        .alias("cut_pressure_entropy"),
        d(F.col("active")).alias("n_active_cuts"), (d(F.col("active")) / F.col("cuts")).alias("cut_pressure_frac_active"))
    return spine.select("file").join(out, "file", "left").na.fill(0.0)


def linear_cut_metrics(edges: DataFrame, spine: DataFrame) -> DataFrame:
    """Most distinct edges and most gates over one cut."""
    both = crossing_profile_pair(edges, spine)
    out = both.groupBy("file").agg(d(F.max("edge_cross")).alias("edge_cutwidth_natural"),
                                   d(F.max("gate_cross")).alias("entangling_cutwidth_natural"))
    return spine.select("file").join(out, "file", "left").na.fill(0.0)


def crossing_profile_pair(edges: DataFrame, spine: DataFrame) -> DataFrame:
    """(file, cut, edge_cross, gate_cross) at the cuts where an edge starts or ends; one pass for both counts."""
    def step(at: Column, sign: int) -> Column:
        return F.struct((at + 1).alias("cut"), F.lit(sign).cast("long").alias("e"), (F.col("weight") * sign).alias("g"))
    steps = edges.select("file", F.explode(F.array(step(F.col("u"), 1), step(F.col("v"), -1))).alias("s"))
    at_cut = steps.groupBy("file", "s.cut").agg(F.sum("s.e").alias("e"), F.sum("s.g").alias("g"))
    run = Window.partitionBy("file").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at_cut.select("file", "cut", F.sum("e").over(run).alias("edge_cross"), F.sum("g").over(run).alias("gate_cross"))


SPAN_PROBS = [0.25, 0.5, 0.75, 0.9]


def gate_span(edges: DataFrame, spine: DataFrame) -> DataFrame:
    """Statistics of |a - b| over interactions; a circuit without any keeps five values and 13 NULLs.

    Spans are whole numbers below n, so they are counted per value first and ``percentile`` sees few rows.
    """
    spans = edges.groupBy("file", (F.col("v") - F.col("u")).alias("s")).agg(F.sum("weight").alias("w"))
    spans = spans.join(spine.select("file", "n_qubits"), "file")
    s, w = F.col("s"), F.col("w")
    agg = spans.groupBy("file", "n_qubits").agg(
        F.max(s).alias("mx"), F.sum(w).alias("m"), F.sum(s * w).alias("sx"), F.sum(s * s * w).alias("sxx"),
        F.percentile(s, F.array(*[F.lit(p) for p in SPAN_PROBS]), w).alias("q"),
        F.sum(F.when(s == 1, w).otherwise(0)).alias("near"),
        F.sum(F.when(s > F.floor(F.col("n_qubits") / 4), w).otherwise(0)).alias("far"))
    m, norm = F.col("m"), F.greatest(F.col("n_qubits") - 1, F.lit(1))
    mean, square = F.col("sx") / m, F.col("sxx") / m
    big = lambda c: F.col(c).cast("decimal(38,0)")
    std = F.sqrt((big("m") * big("sxx") - big("sx") * big("sx")).cast("double")) / m
    out = agg.select(
        "file", d(F.col("mx")).alias("max_gate_span"), mean.alias("mean_gate_span"), std.alias("std_gate_span"),
        *[F.col("q")[i].alias(f"span_p{int(p * 100)}") for i, p in enumerate(SPAN_PROBS)],
        (mean / norm).alias("mean_gate_span_norm"), (std / norm).alias("std_gate_span_norm"),
        (F.col("q")[3] / norm).alias("span_q90_norm"),
        *[(F.col("q")[i] / norm).alias(f"span_p{int(p * 100)}_norm") for i, p in enumerate(SPAN_PROBS)],
        (F.col("near") / m).alias("frac_nearest_neighbor"), (F.col("far") / m).alias("frac_long_range"),
        square.alias("connectivity_strain"), (square / (norm * norm)).alias("connectivity_strain_norm"))
    none = {"max_gate_span": 0.0, "mean_gate_span": 0.0, "std_gate_span": 0.0, "frac_nearest_neighbor": 1.0,
            "frac_long_range": 0.0}
    return spine.select("file").join(out, "file", "left").na.fill(none)


def entangling_runs(gates: DataFrame, dense: bool = False) -> DataFrame:
    """Run statistics of consecutive 2q/3q gates.

    A run is a constant difference between a gate's position and its rank among entangling gates. Both running
    counts go block by block, so no circuit is scanned in one task. ``dense``: ``seq`` already counts 1, 2, 3...;
    otherwise it is any whole-number order (line numbers), taken in blocks of 65,536.
    """
    flagged = gates.select("file", "seq", F.col("name").isin(ENTANGLING).cast("long").alias("ent"))
    block = F.floor(F.col("seq") / RUN_BLOCK)
    if not dense:
        flagged = position(flagged, ["file"], block, ["seq"], "pos").drop("seq").withColumnRenamed("pos", "seq")
    ranked = running_total(flagged, ["file"], F.floor(F.col("seq") / RUN_BLOCK), ["seq"], F.col("ent"), "rank")
    # one partial aggregate serves both: runs of entangling gates, and the count of the other gates (island NULL)
    island = F.when(F.col("ent") == 1, F.col("seq") - F.col("rank"))
    runs = ranked.groupBy("file", island.alias("island")).agg(F.count(F.lit(1)).alias("n"))
    is_run, n = F.col("island").isNotNull(), F.col("n")
    agg = runs.groupBy("file").agg(
        F.sum(n).alias("total"), F.sum(F.when(is_run, n).otherwise(0)).alias("ent"),
        F.count(F.when(is_run, True)).alias("layers"), F.max(F.when(is_run, n)).alias("mx"),
        F.avg(F.when(is_run, n)).alias("mean"), F.stddev_pop(F.when(is_run, n)).alias("std"))
    return agg.select(
        "file", d(F.col("ent")).alias("n_entangling_gates"), d(F.col("layers")).alias("n_entangling_layers"),
        (F.col("ent") / at_least_one(F.col("total"))).alias("entangling_gate_ratio"),
        F.coalesce(F.try_divide("ent", "layers"), F.lit(0.0)).alias("entangling_gates_per_layer"),
        *[F.coalesce(d(F.col(c)), F.lit(0.0)).alias(f"entangling_run_{name}")
          for c, name in (("mx", "max"), ("mean", "mean"), ("std", "std"))])
