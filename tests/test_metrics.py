import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import labels as A
from quillon.operators import metrics as M
from quillon.operators import resample as R

SCHEMA = "qid string, stratum string, row_pos long, signal string, score double, y boolean"


def table(spark, scores, y, signal="s", stratum=None):
    rows = [(f"q{i:04d}", stratum[i] if stratum else "all", i, signal, None if s is None else float(s), bool(t)) for i, (s, t) in enumerate(zip(scores, y, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def auroc(spark, scores, y):
    row = M.auroc(table(spark, scores, y), ["signal"]).first()
    return row["auroc"] if row else None


@pytest.mark.parametrize(
    "s,y,want",
    [([0.1, 0.5, 0.7, 0.9], [0, 1, 0, 1], 0.75), ([0.1, 0.5, 0.7, 0.9, float("nan")], [0, 1, 0, 1, 1], 0.75), ([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0), ([1, 1], [0, 1], 0.5), ([2, 2, 2], [1, 0, 1], 0.5), ([0.9, 0.1], [0, 1], 0.0), ([1, 2], [1, 1], None), ([1, 1, 1, 2, 2, 3], [1, 0, 1, 0, 1, 0], 2.5 / 9)],
)
def test_auroc(spark, s, y, want):
    got = auroc(spark, s, y)
    assert got == (pytest.approx(want) if want is not None else None)


def test_auroc_against_pairs_and_spread(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 40, 300) / 7, rng.random(300) < 0.3
    pos, neg = s[y], s[~y]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert auroc(spark, s, y) == pytest.approx(want)
    assert M.auroc(table(spark, s, y), ["signal"], spread=7).first()["auroc"] == pytest.approx(want)


def test_average_precision(spark):
    assert M.average_precision(table(spark, [3, 2, 1], [1, 0, 1]), ["signal"]).first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert M.average_precision(table(spark, [3, 2], [0, 0]), ["signal"]).first()["average_precision"] is None


def test_risk_coverage(spark):
    df = table(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1])
    assert [r["risk"] for r in M.risk_coverage(df, ["signal"]).orderBy("k").collect()] == pytest.approx([0, 0, 1 / 3, 1 / 2])
    assert M.aurc(df, ["signal"]).first()["aurc"] == pytest.approx(0.208333, abs=1e-6)
    ten = table(spark, range(10), [0] * 8 + [1] * 2)
    assert M.aurc(ten, ["signal"], 0.9).first()["coverage_at_target"] == pytest.approx(0.8)
    assert M.risk_coverage(table(spark, [1, 2], [1, 1]), ["signal"]).count() == 0


def test_ece(spark):
    df = table(spark, [0.1] * 4 + [0.9] * 4, [1, 0, 0, 0, 1, 1, 1, 0])
    assert M.ece(df, ["signal"], 10).first()["ece"] == pytest.approx(0.15)
    bins = {r["bin"]: r["n"] for r in M.ece_bins(table(spark, [1.0, 0.0, 0.1], [1, 0, 0]), ["signal"], 10).collect()}
    assert bins[9] == 1 and bins[0] == 2 and len(bins) == 10


def test_platt(spark):
    flat = M.fit_platt(table(spark, [5] * 10, [1] * 3 + [0] * 7), ["signal"]).first()
    assert flat["a"] == 0 and 1 / (1 + np.exp(-flat["b"])) == pytest.approx(0.3)
    rng = np.random.default_rng(2)
    s = rng.normal(size=400)
    y = rng.random(400) < 1 / (1 + np.exp(-(1.5 * s - 0.5)))
    df = table(spark, s, y)
    fit = M.fit_platt(df, ["signal"]).first()
    p = 1 / (1 + np.exp(-(fit["a"] * s + fit["b"])))
    assert abs((p - y).sum()) < 1e-4 and abs(((p - y) * s).sum()) < 1e-4
    assert M.apply_platt(df, M.fit_platt(df, ["signal"]), ["signal"]).agg(F.avg("score")).first()[0] == pytest.approx(y.mean(), abs=1e-6)


def test_spearman(spark):
    a = table(spark, [1, 2, 3, 4], [0, 1, 0, 1], "a").unionByName(table(spark, [10, 20, 30, 40], [0, 1, 0, 1], "b")).unionByName(table(spark, [4, 3, 2, 1], [0, 1, 0, 1], "c")).unionByName(table(spark, [1, 1, 1, 1], [0, 1, 0, 1], "d")).unionByName(table(spark, [1, 2, None, None], [0, 1, 0, 1], "e"))
    rho = {(r["a"], r["b"]): r["rho"] for r in M.spearman_matrix(a).collect()}
    assert rho["a", "b"] == pytest.approx(1) and rho["a", "c"] == pytest.approx(-1) and rho["a", "d"] is None and rho["a", "e"] is None
    same = {(r["a"], r["b"]): (r["same"], r["reversed"]) for r in M.rank_identity(a).collect()}
    assert same["a", "b"] == (True, False) and same["a", "c"] == (False, True)


def test_stratified(spark):
    df = table(spark, [0.9, 0.8, 0.7, 0.1, 0.9, 0.1, 0.8, 0.2], [1, 1, 1, 0, 1, 1, 0, 0], stratum=list("aaaabbbb"))
    assert R.stratified_auroc(df, "stratum").first()["auroc"] == pytest.approx(0.75)
    out = R.bootstrap_stratified(df, "stratum", 50, 1).first()
    assert out["weights"] == {"a": 4, "b": 4} and out["ci_low"] <= 0.75 <= out["ci_high"]


def test_bootstrap_brackets_point_and_is_stable(spark):
    rng = np.random.default_rng(3)
    y = rng.random(120) < 0.5
    df = table(spark, rng.normal(size=120) + y, y)
    a, b = R.bootstrap_auroc(df, 100, 7).first(), R.bootstrap_auroc(df.repartition(7), 100, 7).first()
    assert a == b and a["ci_low"] < a["auroc"] < a["ci_high"] and a["resamples"] == 100
    one_class = R.bootstrap_auroc(table(spark, [1, 2], [1, 1]), 10, 7).first()
    assert one_class["ci_low"] is None and one_class["resamples"] == 0


def test_singleton_clusters_widen_only_when_rows_repeat(spark):
    rng = np.random.default_rng(4)
    y = rng.random(40) < 0.5
    s = rng.normal(size=40) + 0.8 * y
    twice = table(spark, np.repeat(s, 2), np.repeat(y, 2)).withColumn("cluster_id", (F.col("row_pos") / 2).cast("int"))
    width = lambda r: r["ci_high"] - r["ci_low"]
    assert width(R.bootstrap_auroc(twice, 200, 5, clusters=True).first()) > width(R.bootstrap_auroc(twice, 200, 5).first())


def test_paired_difference(spark):
    rng = np.random.default_rng(5)
    y = rng.random(150) < 0.5
    df = table(spark, rng.normal(size=150) + 2 * y, y, "good").unionByName(table(spark, rng.normal(size=150), y, "noise"))
    row = R.paired_auroc_diff(df, "good", 200, 1).first()
    assert row["signal"] == "noise" and row["delta"] < -0.2 and row["p_value"] < 0.05 and row["n_paired"] == 150


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.001), (1, 0.01), (2, 0.02), (3, 0.5), (4, None)], "position int, p_value double")
    got = {r["position"]: (r["p_holm"], r["significant_p_holm"]) for r in R.holm(df).collect()}
    assert [got[i][0] for i in range(4)] == pytest.approx([0.004, 0.03, 0.04, 0.5]) and [got[i][1] for i in range(5)] == [True, True, True, False, False] and got[4][0] is None


def test_kappa(spark):
    pairs = [("c", "c")] * 8 + [("i", "c")] * 2 + [("c", "i")] * 3 + [("i", "i")] * 7
    row = A.cohens_kappa(spark.createDataFrame(pairs, ["a", "b"]), "a", "b").first()
    assert (row["observed"], row["expected"], row["kappa"]) == pytest.approx((0.75, 0.5, 0.5))
    unanimous = A.cohens_kappa(spark.createDataFrame([("c", "c")] * 5, ["a", "b"]), "a", "b").first()
    assert unanimous["kappa"] is None and not unanimous["trustworthy"]


def test_rule_accuracy(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], ["p", "a"])
    row = M.rule_accuracy(df, F.col("p"), F.col("a")).first()
    assert (row["precision"], row["recall"]) == (0.5, 0.5)
