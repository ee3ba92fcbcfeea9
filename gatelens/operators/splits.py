"""Group-aware splits, stored by row key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.constants import RECOMMENDED_TEST
from gatelens.functions.blocks import position
from gatelens.functions.joins import BOUND, join_salted
from gatelens.functions.lineage import cut

BUCKET_DIGITS = 3


def _hashed(groups: DataFrame, group: str, salt: str = "") -> DataFrame:
    h = F.md5(F.concat(F.col(group).cast("string"), F.lit(salt)))
    return groups.withColumn("h", h)


def _bucket():
    """Order-preserving block of the hash: its first hex digits as a number."""
    return F.conv(F.substring("h", 1, BUCKET_DIGITS), 16, 10).cast("long")


def greedy_runs(sizes: dict[int, int], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, last, cycle): groups of one size, numbered from 0, go round the folds of ``cycle``.

    Largest size first, each group into the fold with the fewest rows (the first of several). Groups of one size visit the folds
    that are within one size of the least in a fixed order until they reach the next fold, so a size takes few runs.
    """
    loads, out = [0] * k, []
    for n in sorted(sizes, reverse=True):
        done = 0
        while done < sizes[n]:
            order = sorted(range(k), key=lambda j: (loads[j], j))
            active = [j for j in order if loads[j] < loads[order[0]] + n]
            rounds = (loads[order[len(active)]] - loads[order[0]]) // n if len(active) < k else sizes[n]
            last = min(sizes[n], done + len(active) * rounds)
            out.append((n, done, last, active))
            for i, j in enumerate(active):
                loads[j] += n * ((last - done) // len(active) + (i < (last - done) % len(active)))
            done = last
    return out


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """K1: (group, n, fold): largest group first into the fold with the fewest rows, over k folds, or as many as there are groups.

    Only the histogram of sizes reaches the driver (at most the square root of twice the rows). Groups of one size are ranked in
    blocks of their hash, so not even a billion equal groups are sorted in one task.
    """
    sizes = cut(_hashed(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group))
    histogram = {r["n"]: r["c"] for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    runs = greedy_runs(histogram, max(1, min(k, sum(histogram.values()))))
    lines = df.sparkSession.createDataFrame(runs, "n long, first long, last long, cycle array<int>")
    ranked = position(sizes, ["n"], _bucket(), ["h", group], "rank").withColumn("rank", F.col("rank") - 1)
    met = ranked.join(F.broadcast(lines), "n") if len(runs) <= BOUND else join_salted(ranked, lines, ["n"])
    seat = F.pmod(F.col("rank") - F.col("first"), F.size("cycle")) + 1
    return met.where("rank >= first AND rank < last").select(group, "n", F.element_at("cycle", seat.cast("int")).alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """K1: the rows with their test fold."""
    return join_salted(df, group_folds(df, group, k).drop("n"), [group])


def group_holdout(df: DataFrame, group: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """K2: (group, is_val): ceil(frac * groups) groups by hash order; none when there are fewer than three groups."""
    groups = _hashed(df.select(group).distinct(), group, f"#{seed}").withColumn("__all", F.lit(0))
    ranked = position(groups, ["__all"], _bucket(), ["h", group], "rank")
    total = groups.agg(F.count(F.lit(1))).scalar()
    take = ranked.select(group, "rank", total.alias("total"))
    return take.select(group, ((F.col("total") >= 3) & (F.col("rank") <= F.ceil(F.col("total") * frac))).alias("is_val"))


def label_coverage(folded: DataFrame, group: str, label: str) -> DataFrame:
    """K3: (fold, ok): every label of several groups occurs in train and test, a label of one group in test."""
    seen = folded.groupBy("fold", label, group).agg(F.count(F.lit(1)).alias("n"))
    labels = seen.groupBy(label).agg(F.count(F.lit(1)).alias("groups"), F.sort_array(F.collect_set("fold")).alias("folds"))
    folds = folded.agg(F.sort_array(F.collect_set("fold"))).scalar()
    # a label is in the train part of fold f iff it occurs in another fold (groups stay whole)
    checks = labels.select("groups", "folds", F.explode(folds).alias("fold"))
    in_test = F.array_contains("folds", F.col("fold"))
    in_train = F.size("folds") > in_test.cast("int")
    ok = F.when(F.col("groups") > 1, in_test & in_train).otherwise(in_test)
    return checks.groupBy("fold").agg(F.bool_and(ok).alias("ok"))


def balanced_folds(folded: DataFrame, group: str, label: str) -> DataFrame:
    """K3: the rows of accepted folds; raises when no fold is acceptable."""
    good = [r.fold for r in label_coverage(folded, group, label).where("ok").collect()]
    if not good:
        raise ValueError("no fold satisfies the label coverage; use fewer folds or other groups")
    return folded.where(F.col("fold").isin(good))


def group_roles(df: DataFrame, group: str, k: int = 5, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """(group, fold, role): per fold its test groups, and the other groups in train or validation.

    Validation groups of a fold are the ceil(frac * g) first of its g train groups by salted hash. All folds are ranked
    together in one pass over the groups.
    """
    groups = group_folds(df, group, k).drop("n")
    folds = F.explode(F.sequence(F.lit(0), groups.agg(F.coalesce(F.max("fold"), F.lit(0))).scalar())).alias("fold")
    each = groups.withColumnRenamed("fold", "own").select(group, "own", folds)
    train = _hashed(each.where("own <> fold").withColumn("salt", F.col("fold") + seed), group)
    train = train.withColumn("h", F.md5(F.concat(F.col(group).cast("string"), F.lit("#"), F.col("salt").cast("string"))))
    ranked = position(train, ["fold"], _bucket(), ["h", group], "rank")
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("g"))
    role = F.when((F.col("g") >= 3) & (F.col("rank") <= F.ceil(F.col("g") * frac)), "val").otherwise("train")
    parts = ranked.join(F.broadcast(sizes), "fold").select(group, "fold", role.alias("role"))  # one row per fold
    return parts.unionByName(each.where("own = fold").select(group, "fold", F.lit("test").alias("role")))


def build_splits(df: DataFrame, key: str, group: str, k: int = 5, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """K4: (row_key, fold, role). Per fold its test rows, and the other rows in train or validation by group."""
    return join_salted(df.select(F.col(key).alias("row_key"), group), group_roles(df, group, k, frac, seed), [group]).select("row_key", "fold", "role")


def eval_labels_by_fold(rows: DataFrame, label: str) -> DataFrame:
    """K5: (fold, ok) over rows with fold and role: every validation label of the fold occurs in its train rows."""
    has = lambda role: F.count(F.when(F.col("role") == role, 1))
    seen = rows.groupBy("fold", label).agg(has("train").alias("t"), has("val").alias("v"))
    return seen.where("v > 0").groupBy("fold").agg(F.bool_and(F.col("t") > 0).alias("ok"))


def eval_labels_ok(train: DataFrame, val: DataFrame, label: str) -> bool:
    """K5: whether validation rows exist and carry only labels that were trained on."""
    rows = train.select(label, F.lit("train").alias("role")).unionByName(val.select(label, F.lit("val").alias("role")))
    found = eval_labels_by_fold(rows.withColumn("fold", F.lit(0)), label).first()
    return found is not None and found.ok


def named_split(df: DataFrame, test_files: list[str] = RECOMMENDED_TEST) -> DataFrame:
    """K6: adds role = test for the named files, else train."""
    return df.withColumn("role", F.when(F.col("file").isin(test_files), "test").otherwise("train"))
