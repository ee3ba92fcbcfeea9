"""Interaction-graph metrics that need no iteration.

Input is ``edges`` (file, u, v, weight) with multiplicities already summed and ``spine`` (file, n_qubits).
Per circuit there are at most n(n-1)/2 edges and n nodes, whatever its gate count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.exprs import d

WORD = 63  # neighbours per bitset word


def nodes(spine: DataFrame) -> DataFrame:
    """(file, node) for every qubit, isolated ones included."""
    return spine.where(F.col("n_qubits") > 0).select(
        "file", F.explode(F.sequence(F.lit(0), F.col("n_qubits").cast("int") - 1)).alias("node"))


def both_ends(edges: DataFrame) -> DataFrame:
    """(file, node, other, weight): every edge seen from both ends."""
    end = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    return edges.select("file", F.explode(F.array(end("u", "v"), end("v", "u"))).alias("e"), "weight").select(
        "file", "e.node", "e.other", "weight")


def degrees(edges: DataFrame, spine: DataFrame) -> DataFrame:
    """(file, node, deg, wdeg) with zeros for isolated qubits; one shuffle of edge ends plus spine."""
    ends = both_ends(edges).select("file", "node", F.lit(1).cast("long").alias("d"), "weight")
    zero = nodes(spine).select("file", "node", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("weight"))
    return ends.unionByName(zero).groupBy("file", "node").agg(F.sum("d").alias("deg"), F.sum("weight").alias("wdeg"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """(file, node, deg) of the qubits that have edges, for metrics to which isolated qubits add nothing."""
    return both_ends(edges).groupBy("file", "node").agg(F.count(F.lit(1)).alias("deg"))


def degree_stats(deg: DataFrame, spine: DataFrame) -> DataFrame:
    """Distribution of degree and weighted degree over all qubits, and the degree entropy."""
    out: list[Column] = []
    quart = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    for c, s in (("deg", "degree"), ("wdeg", "wdegree")):
        q = F.percentile(c, quart)
        out += [d(F.max(c)).alias(f"graph_max_{s}"), F.avg(c).alias(f"graph_mean_{s}"),
                F.stddev_pop(c).alias(f"graph_std_{s}"), d(F.min(c)).alias(f"graph_min_{s}"),
                q[1].alias(f"graph_median_{s}"), q[0].alias(f"graph_p25_{s}"), q[2].alias(f"graph_p75_{s}")]
    return spine.select("file").join(deg.groupBy("file").agg(*out), "file", "left").na.fill(0.0)


def degree_entropy(deg: DataFrame, spine: DataFrame) -> DataFrame:
    """-sum p log2 p with p = degree share."""
    x, total = F.col("deg"), F.sum("deg")
    xlog = F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    e = F.when(total > 0, F.greatest(F.log2(F.greatest(total, F.lit(1))) - xlog / F.greatest(total, F.lit(1)), F.lit(0.0)))
    agg = deg.groupBy("file").agg(e.alias("graph_degree_entropy"))
    return spine.select("file").join(agg, "file", "left").na.fill(0.0)


def edge_totals(edges: DataFrame, spine: DataFrame) -> DataFrame:
    """Edge count, density, sparsity, edge-weight maximum and mean, natural span sums."""
    agg = edges.groupBy("file").agg(F.count(F.lit(1)).alias("m"), F.max("weight").alias("mx"), F.avg("weight").alias("av"))
    n = F.col("n_qubits")
    possible = F.greatest(n * (n - 1) / 2, F.lit(1.0))
    full = spine.select("file", "n_qubits").join(agg, "file", "left").na.fill(0)
    return full.select("file", d(F.col("m")).alias("graph_n_edges"), (F.col("m") / possible).alias("graph_density"),
                       (1.0 - F.col("m") / possible).alias("graph_sparsity"), d(F.col("mx")).alias("graph_max_edge_weight"),
                       F.col("av").alias("graph_mean_edge_weight"))


def neighbour_words(edges: DataFrame) -> DataFrame:
    """(file, node, word, bits): neighbour sets as bitset words, a self-loop left out."""
    ends = both_ends(edges).where(F.col("node") != F.col("other"))
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), other % {WORD})")
    return ends.groupBy("file", "node", F.floor(F.col("other") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(file, u, v, common): neighbours shared by the ends of each edge.

    Bitsets are ANDed word by word, so no pair of neighbours is ever emitted, not even at a hub.
    """
    words = neighbour_words(edges)
    left = edges.where("u <> v").select("file", "u", "v").join(
        words.select("file", F.col("node").alias("u"), "word", F.col("bits").alias("ub")), ["file", "u"])
    both = left.join(words.select("file", F.col("node").alias("v"), "word", F.col("bits").alias("vb")), ["file", "v", "word"])
    return both.groupBy("file", "u", "v").agg(F.sum(F.bit_count(F.col("ub").bitwiseAND(F.col("vb")))).alias("common"))


def avg_clustering(edges: DataFrame, deg: DataFrame, spine: DataFrame) -> DataFrame:
    """E5: mean local clustering over all qubits; qubits of degree below 2 count as 0."""
    shared = common_neighbours(edges)
    end = lambda c: F.struct(F.col(c).alias("node"), "common")
    per_node = (shared.select("file", F.explode(F.array(end("u"), end("v"))).alias("e"))
                .groupBy("file", "e.node").agg(F.sum("e.common").alias("twice")))
    local = per_node.join(deg, ["file", "node"]).where("deg >= 2").select(
        "file", (F.col("twice") / (F.col("deg") * (F.col("deg") - 1))).alias("c"))
    total = local.groupBy("file").agg(F.sum("c").alias("c"))
    return spine.select("file", "n_qubits").join(total, "file", "left").select(
        "file", F.coalesce(F.col("c") / F.col("n_qubits"), F.lit(0.0)).alias("graph_avg_clustering"))


def topology_flags(edges: DataFrame, deg: DataFrame, spine: DataFrame) -> DataFrame:
    """Nearest-neighbour, star and all-to-all flags as 0/1. ``deg`` may leave out isolated qubits."""
    per_file = edges.groupBy("file").agg(F.count(F.lit(1)).alias("m"), F.bool_and(F.col("v") - F.col("u") == 1).alias("nn"))
    top = deg.groupBy("file").agg(F.max("deg").alias("top"))
    full = spine.select("file", "n_qubits").join(per_file, "file", "left").join(top, "file", "left").na.fill(0)
    n, m = F.col("n_qubits"), F.col("m")
    flag = lambda c, name: F.coalesce(c, F.lit(False)).cast("double").alias(name)
    return full.select("file", flag(F.col("nn"), "is_nearest_neighbor"),
                       flag((n >= 3) & (m > 0) & (F.col("top") >= (n - 1) * 0.8), "is_star_topology"),
                       flag((n > 2) & (m >= n * (n - 1) / 2 * 0.8), "is_all_to_all"))


# ------------------------------------------------------------------ metrics of a linear order

def natural_order(edges: DataFrame) -> DataFrame:
    """(file, lo, hi): edge ends as positions in the natural order, self-loops left out."""
    return edges.where("u <> v").select("file", F.col("u").alias("lo"), F.col("v").alias("hi"))


def ordered_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(file, lo, hi) under an order given as (file, node, pos)."""
    pu = order.select("file", F.col("node").alias("u"), F.col("pos").alias("pu"))
    pv = order.select("file", F.col("node").alias("v"), F.col("pos").alias("pv"))
    placed = edges.where("u <> v").join(pu, ["file", "u"]).join(pv, ["file", "v"])
    return placed.select("file", F.least("pu", "pv").alias("lo"), F.greatest("pu", "pv").alias("hi"))


def bandwidth(placed: DataFrame, spine: DataFrame, suffix: str) -> DataFrame:
    """Longest edge and sum of edge lengths."""
    agg = placed.groupBy("file").agg(d(F.max(F.col("hi") - F.col("lo"))).alias(f"graph_bandwidth_{suffix}"),
                                     d(F.sum(F.col("hi") - F.col("lo"))).alias(f"graph_linear_arrangement_{suffix}"))
    return spine.select("file").join(agg, "file", "left").na.fill(0.0)


def cutwidth(placed: DataFrame, spine: DataFrame, suffix: str) -> DataFrame:
    """Most edges over one gap of the order."""
    # a gap where no edge starts or ends has the count of the gap before it, so only the others are looked at
    step = lambda at, size: F.struct((F.col(at) + 1).cast("int").alias("cut"), F.lit(size).cast("long").alias("step"))
    steps = placed.select("file", F.explode(F.array(step("lo", 1), step("hi", -1))).alias("s"))
    run = Window.partitionBy("file").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    profile = steps.groupBy("file", "s.cut").agg(F.sum("s.step").alias("step")).select("file", "cut", F.sum("step").over(run).alias("pressure"))
    inside = profile.join(spine.select("file", "n_qubits"), "file").where(F.col("cut") < F.col("n_qubits"))
    agg = inside.groupBy("file").agg(d(F.max("pressure")).alias(f"graph_cutwidth_{suffix}"))
    return spine.select("file").join(agg, "file", "left").na.fill(0.0)


def _halves(placed: DataFrame, spine: DataFrame) -> DataFrame:
    """Edges with the side of each end: the first ceil(n/2) positions against the rest."""
    mid = F.ceil(F.col("n_qubits") / 2)
    return placed.join(spine.select("file", "n_qubits"), "file").select(
        "file", "lo", "hi", (F.col("lo") >= mid).alias("lo_far"), (F.col("hi") >= mid).alias("hi_far"))


def balanced_separator(placed: DataFrame, spine: DataFrame) -> DataFrame:
    """Smaller set of boundary qubits of the midpoint bisection. ``lo`` is always on the near side of a cut edge."""
    crossing = _halves(placed, spine).where(F.col("lo_far") != F.col("hi_far"))
    end = lambda c: F.struct(F.lit(c).alias("side"), F.col(c).alias("node"))
    boundary = crossing.select("file", F.explode(F.array(end("lo"), end("hi"))).alias("e")).groupBy("file", "e.side", "e.node").count()
    sides = boundary.groupBy("file").agg(F.count(F.when(F.col("side") == "lo", 1)).alias("a"),
                                         F.count(F.when(F.col("side") == "hi", 1)).alias("b"))
    return spine.select("file").join(
        sides.select("file", d(F.least("a", "b")).alias("graph_min_balanced_separator")), "file", "left").na.fill(0.0)


def cut_conductance(placed: DataFrame, spine: DataFrame) -> DataFrame:
    """Cut edges over the smaller volume of the midpoint bisection."""
    far = F.col("lo_far").cast("int") + F.col("hi_far").cast("int")
    agg = _halves(placed, spine).groupBy("file").agg(
        F.count(F.when(F.col("lo_far") != F.col("hi_far"), 1)).alias("cut"), F.sum(2 - far).alias("near"), F.sum(far).alias("far"))
    value = F.coalesce(F.try_divide("cut", F.least("near", "far")), F.lit(0.0))
    return spine.select("file").join(agg.select("file", value.alias("graph_conductance_best_cut")), "file", "left").na.fill(0.0)


def recursive_bisection(placed: DataFrame, spine: DataFrame, max_depth: int = 10) -> DataFrame:
    """Largest and mean cut over recursive halvings of the position interval.

    At depth k the cell of position p is floor(p * 2^k / n). A part with an inner edge is split once; the edges whose
    ends part ways there are its cut. Each edge lies inside one part per depth until it is cut, so it is exploded to
    at most ``max_depth`` rows, which are pre-aggregated per part.
    """
    cell = lambda c, k: F.floor(F.col(c) * F.pow(F.lit(2.0), k) / F.col("n_qubits"))
    withn = placed.join(spine.select("file", "n_qubits"), "file")
    levels = F.filter(F.sequence(F.lit(0), F.lit(max_depth - 1)), lambda k: cell("lo", k) == cell("hi", k))
    inside = withn.select("file", "lo", "hi", "n_qubits", F.explode(levels).alias("k"))
    parts = inside.groupBy("file", "k", cell("lo", F.col("k")).alias("part")).agg(
        F.count(F.when(cell("lo", F.col("k") + 1) != cell("hi", F.col("k") + 1), 1)).alias("cut"))
    agg = parts.groupBy("file").agg(d(F.max("cut")).alias("graph_recursive_bisection_max_cut"),
                                    F.avg("cut").alias("graph_recursive_bisection_avg_cut"))
    return spine.select("file").join(agg, "file", "left").na.fill(0.0)
