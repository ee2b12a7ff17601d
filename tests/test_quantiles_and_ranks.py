"""Order statistics, the rank matrix and ablation contrasts against plain versions."""

import random

import numpy as np
import pytest

from quillon.operators import quantiles as Q
from quillon.operators.gram import rank_pairs
from quillon.plans import compare as C
from quillon.plans import leaderboard as L


def values(kind, n=3000):
    rng = random.Random(5)
    made = {
        "spread": lambda i: rng.gauss(0, 1) * 10 ** rng.randrange(-200, 200), "ties": lambda i: float(rng.randrange(3)), "one": lambda i: 7.5, "hot": lambda i: 4.0 if rng.random() < 0.6 else rng.random(), "ends": lambda i: rng.choice([float("-inf"), float("inf"), 0.0, -0.0, 1e-300])
    }
    return [made[kind](i) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "hot", "ends"])
def test_order_statistics(spark, monkeypatch, kind):
    monkeypatch.setattr(Q, "CUTS", 4)
    v = values(kind)
    df = spark.createDataFrame([("k", x) for x in v] + [("k", None), ("k", float("nan")), (None, 2.0)], "k string, v double").repartition(5)
    ranks = [0, 1, 17, 1499, 1500, 2998, 2999]
    got = Q.order_statistics(df, ["k"], "v", {("k",): ranks, (None,): [0]})
    assert got == {("k",): {r: sorted(v)[r] for r in ranks}, (None,): {0: 2.0}}


@pytest.mark.parametrize("n", [1, 2, 5, 100])
def test_quantiles(spark, n):
    v = values("hot", n)
    shares = [0.0, 0.025, 0.5, 0.75, 1.0]
    row = Q.quantiles(spark.createDataFrame([(x,) for x in v], "v double"), [], "v", shares).first()
    assert row["n"] == n and row["quantiles"] == pytest.approx(np.quantile(v, shares).tolist())
    assert Q.quantiles(spark.createDataFrame([(None,)], "v double"), [], "v", shares).collect() == []


def midranks(x):
    x = np.array(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_rank_pairs(spark):
    rng = np.random.default_rng(2)
    rows, cols = [], {}
    for g in ("u", None):
        base = rng.integers(0, 30, 80).astype(float)
        made = {"a": base, "b": base**3, "c": -base, "d": rng.normal(size=80), "e": np.where(np.arange(80) % 3 == 0, np.nan, rng.normal(size=80)), "f": np.where(np.arange(80) % 3 == 0, np.nan, base), "k": np.ones(80), "z": np.where(np.arange(80) < 2, 1.0, np.nan)}
        for name, x in made.items():
            cols[g, name] = x
            rows += [(g, f"q{i}", name, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    got = {(r["view"], r["a"], r["b"]): r for r in rank_pairs(spark.createDataFrame(rows, "view string, qid string, signal string, score double"), ["view"]).collect()}
    names = sorted({n for _, n in cols})
    assert len(got) == 2 * len(names) * (len(names) + 1) // 2
    for (g, a, b), r in got.items():
        both = ~np.isnan(cols[g, a]) & ~np.isnan(cols[g, b])
        x, z = midranks(cols[g, a][both]), midranks(cols[g, b][both])
        assert r["n"] == both.sum()
        assert r["same"] == bool((x == z).all()) and r["reversed"] == bool((x + z == both.sum() + 1).all())
        want = None if x.std() * z.std() == 0 else np.corrcoef(x, z)[0, 1]
        assert r["rho"] == (None if want is None else pytest.approx(want))
    assert got["u", "a", "b"]["rho"] == 1.0 and got["u", "a", "c"]["rho"] == -1.0 and got["u", "e", "f"]["n"] == 53


def test_restatements_are_found(spark):
    rows = [(f"q{i}", s, float(v)) for i in range(40) for s, v in (("a", i % 9), ("b", -(i % 9)), ("c", i * 7 % 11))]
    m = L.M.spearman_matrix(spark.createDataFrame(rows, "qid string, signal string, score double")).cache()
    assert [(r["a"], r["b"], r["direction"]) for r in C.duplicate_pairs(m).where("rank_equivalent").collect()] == [("a", "b", "reversed")]
    assert C.independent_signals(m).first()[0] == 2
    assert C.spearman_between(m, "b", "a") == -1.0
    with pytest.raises(KeyError):
        C.spearman_between(m, "a", "x")


def test_ablation_differences_come_from_paired_contrasts(spark):
    rng = np.random.default_rng(8)
    y = rng.random(60) < 0.5
    rows = [(level, f"q{i}", bool(y[i]), s, float(rng.normal() + y[i] * level / 3 + k)) for level in (1, 2, 4) for k, s in enumerate("st") for i in range(60)]
    df = spark.createDataFrame(rows, "level int, qid string, y boolean, signal string, score double")
    got = L.ablation_differences(df, [4, 1, 2], L.Options(resamples=40, seed=3)).collect()
    assert {(r["signal"], r["low"], r["high"]) for r in got} == {(s, *p) for s in "st" for p in ((1, 2), (2, 4), (1, 4))}
    for r in got:
        pair = df.where((df.signal == r["signal"]) & df.level.isin(r["low"], r["high"])).withColumn("signal", df.level.cast("string"))
        one = L.R.paired_auroc_diff(pair, str(r["high"]), 40, 3).first()
        assert (r["delta"], r["ci_low"], r["p_value"], r["n_paired"]) == (pytest.approx(one["delta"]), pytest.approx(one["ci_low"]), pytest.approx(one["p_value"]), 60)
    family = sorted((r["p_value"], f"{r['signal']}:{r['low']}:{r['high']}", r["p_holm"]) for r in got)
    top = 0.0
    for i, (p, _, adjusted) in enumerate(family):
        top = max(top, (len(family) - i) * p)
        assert adjusted == pytest.approx(min(1.0, top))
