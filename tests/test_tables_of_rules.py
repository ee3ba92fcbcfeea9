"""Rule tables, greedy folds and Gram matrices against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatelens.constants import FAMILY_RULES
from gatelens.operators import family, report, selection, splits

TRAITS = "file long, names array<string>, n_types int, n_qregs int, is_all_to_all double, is_nearest_neighbor double, is_star_topology double, long_range_only boolean"


def circuits(spark, seed, names, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = rng.sample(names, rng.randint(1, 6))
        rows.append((i, own, len(own), rng.randint(1, 3), *[float(rng.random() < 0.5) for _ in range(3)], rng.random() < 0.5))
    return rows, spark.createDataFrame(rows, TRAITS)


def by_hand(rules, row):
    _, names, types, qregs, dense, near, star, far = row
    checks = {None: True, "qregs>=2": qregs >= 2, "qregs>=3": qregs >= 3, "all_to_all": dense > 0.5, "nearest_neighbor": near > 0.5, "star": star > 0.5, "long_range_only": far}
    for fam, required, any_of, forbidden, most, check in rules:
        if (set(required) <= set(names) and (not any_of or set(any_of) & set(names)) and not set(forbidden) & set(names)
                and (most is None or types <= most) and checks[check]):
            return fam
    return None


def test_built_in_rules(spark):
    names = sorted({g for r in FAMILY_RULES for c in r[1:4] for g in c} | {"other"})
    rows, df = circuits(spark, 1, names, 2000)
    got = {r["file"]: r["f"] for r in df.select("file", family.classify_rules().alias("f")).collect()}
    assert got == {r[0]: by_hand(FAMILY_RULES, r) for r in rows} and len(set(got.values())) > 8


def test_rules_of_a_caller(spark):
    names = [f"g{i}" for i in range(64)]
    rules = [("first", ("g63",), (), ("g0",), None, None), ("second", (), ("g1", "g62"), (), 4, "star"), ("third", (), tuple(names), (), None, None)]
    rows, df = circuits(spark, 2, [*names, "more"])
    table = family.rule_table(spark, rules)
    got = {r["file"]: r["f"] for r in df.select("file", family.classify_rules(table).alias("f")).collect()}
    assert got == {r[0]: by_hand(rules, r) for r in rows} and {"first", "second", "third"} <= set(got.values())
    assert df.select(family.classify_combined(rules=family.rule_table(spark, [])).alias("f")).where("f IS NULL").count() == 0
    with pytest.raises(ValueError, match="64 gates"):
        family.classify_rules(family.rule_table(spark, [("x", tuple(f"g{i}" for i in range(65)), (), (), None, None)]))
    with pytest.raises(ValueError, match="unknown checks"):
        family.classify_rules(family.rule_table(spark, [("x", (), (), (), None, "no such")]))


@pytest.mark.parametrize("seed", range(6))
def test_greedy_runs(seed):
    rng = random.Random(seed)
    sizes = {rng.choice([1, 2, 3, 7, 40, 1000]): rng.randint(1, 60) for _ in range(4)}
    k = rng.randint(1, 6)
    loads, want = [0] * k, []
    for n in sorted(sizes, reverse=True):
        for i in range(sizes[n]):
            j = min(range(k), key=lambda f: (loads[f], f))
            loads[j] += n
            want.append((n, i, j))
    got = [(n, i, cycle[(i - first) % len(cycle)]) for n, first, last, cycle in splits.greedy_runs(sizes, k) for i in range(first, last)]
    assert sorted(got) == sorted(want)
    many = splits.greedy_runs({10 ** 9: 1, 1: 10 ** 12}, 5)  # a giant group and very many small ones take few runs
    assert len(many) < 20 and sum(last - first for _, first, last, _ in many) == 10 ** 12 + 1


def test_skewed_groups(spark):
    rows = [(i, 0 if i < 500 else i % 37 + 1) for i in range(1000)]
    folds = {r["grp"]: (r["n"], r["fold"]) for r in splits.group_folds(spark.createDataFrame(rows, "id long, grp long"), "grp", 5).collect()}
    loads = [sum(n for n, f in folds.values() if f == k) for k in range(5)]
    assert max(loads) == 500 and max(sorted(loads)[:-1]) - min(loads) <= 14 and sum(loads) == 1000


def test_wide_correlations(spark, monkeypatch):
    from gatelens.functions import gram
    monkeypatch.setattr(gram, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 198)) + 1e6
    x[:, 1] = x[:, 0] * -2
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 2], x[:, 3] = 7.5, np.nan
    names = [f"c{i}" for i in range(198)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(7)
    got = {(r["a"], r["b"]): r["r"] for r in report.correlation_matrix(df, names).collect()}
    want = pd.DataFrame(x, columns=names).corr()
    assert len(got) == 197 * 198 // 2 and got["c0", "c2"] is None and got["c0", "c1"] == pytest.approx(-1)
    assert all(r == pytest.approx(want.loc[a, b], abs=1e-6) for (a, b), r in got.items() if "c2" not in (a, b))
    scores = {r["feature"]: r["score"] for r in selection.correlation_scores(df, names, {"t": F.col("c5")}).collect()}
    assert scores["c2"] == scores["c3"] == 0.0 and scores["c9"] == pytest.approx(abs(want.loc["c9", "c5"]), abs=1e-6)
