"""Fixed-size draws and what is computed from them, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import draws as D
from quillon.operators import resample as R

SCORES = "qid string, stratum string, cluster_id long, signal string, score double, y boolean, z boolean"
SEED, TIMES = 11, 60


def table(spark, n=90, seed=4, missing=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = bool(rng.random() < 0.4)
        for s, name in enumerate(("a", "b", "c")):
            score = float(np.round(rng.normal() + y * s / 2, 1))
            rows.append((f"q{i}", f"s{i % 3}", i // 2, name, None if missing and name == "c" and i % 10 == 0 else score, y, bool(y ^ (i % 9 == 0))))
    return spark.createDataFrame(rows, SCORES)


def plain(keys, resamples=TIMES, seed=SEED):
    """Counts of each unit of a class in each resample: all arrivals in the order of time, the first n taken."""
    from hashlib import md5

    n = len(keys)
    h = np.array([np.frombuffer(md5(f"{seed}:{k}".encode()).digest(), ">u8") for k in keys]).astype(np.uint64).reshape(n, 2)
    k, place, time = D.arrivals(h, n.bit_length() - 1, np.arange(resamples, dtype=np.uint64))
    out = k.astype(int)
    for r in range(resamples):
        mine = np.flatnonzero(place % resamples == r)
        for j in mine[np.argsort(time[mine])][: n - out[:, r].sum()]:
            out[place[j] // resamples, r] += 1
    return dict(zip(keys, out, strict=True))


def drawn(rows, unit=0, cls=lambda r: r["y"], seed=SEED):
    out = {}
    for c in (True, False):
        keys = list(dict.fromkeys(r[unit] for r in rows if bool(cls(r)) == c))
        out |= plain(keys, seed=seed) if keys else {}
    return out


def auroc(pairs):
    """From (score, y, weight)."""
    pos, neg = [(s, w) for s, y, w in pairs if y], [(s, w) for s, y, w in pairs if not y]
    total = sum(w for _, w in pos) * sum(w for _, w in neg)
    return sum(w * v * ((s > t) + (s == t) / 2) for s, w in pos for t, v in neg) / total if total else None


def precision(pairs):
    total, out = sum(w for _, y, w in pairs if y), 0.0
    for s in {s for s, *_ in pairs}:
        tp, all_ = sum(w for t, y, w in pairs if y and t >= s), sum(w for t, _, w in pairs if t >= s)
        out += sum(w for t, y, w in pairs if y and t == s) * tp / all_ if all_ else 0
    return out / total if total else None


def rated(df, signal):
    return [r for r in df.collect() if r["signal"] == signal and r["score"] is not None]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 400])
def test_a_draw_has_the_size_of_its_class_and_is_uniform(n):
    counts = np.array(list(plain([f"u{i}" for i in range(n)], 400, 5).values()))
    assert (counts.sum(axis=0) == n).all()
    mean, spread = counts.mean(), counts.var()
    assert mean == 1 and abs(spread - (1 - 1 / n)) < 0.1
    assert abs(counts.mean(axis=1) - 1).max() < 6 / 20 + 1e-9
    if n == 50:
        together = np.cov(counts)[np.triu_indices(n, 1)].mean()
        assert abs(together + 1 / n) < 0.003  # draws of one class exclude each other


def test_sizes_are_exact_on_any_partitioning(spark, monkeypatch):
    for times in (1 << 20, 0):  # gathered times, and histograms down to single arrivals
        monkeypatch.setattr(D, "_TIMES", times)
        for parts in (1, 7):
            df = spark.range(500).select(F.lit(1).cast("long").alias("gid"), (F.col("id") % 5 == 0).alias("cls"), D.unit_hash(SEED, F.col("id"))
                .alias("h")).repartition(parts)
            got = D.draws_of(df, D.classes(df), TIMES)
            rows = df.collect()
            h = np.array([np.frombuffer(bytes(r["h"]), ">u8") for r in rows]).astype(np.uint64)
            cls = np.array([r["cls"] for r in rows], int)
            w = got.weights(np.ones(500, np.int64), cls, h)
            assert (w[cls == 1].sum(axis=0) == 100).all() and (w[cls == 0].sum(axis=0) == 400).all()
            want = plain([str(i) for i in range(500) if i % 5 == 0])
            by = {bytes(r["h"]): x for r, x in zip(rows, w, strict=True)}
            one = df.where("cls").select("h").collect()
            assert sorted(tuple(by[bytes(r["h"])]) for r in one) == sorted(tuple(x) for x in want.values())


@pytest.mark.parametrize("most", [8 << 20, 1])
def test_auroc_and_precision_draws(spark, monkeypatch, most):
    monkeypatch.setattr(R, "_MOST", most)
    df = table(spark).repartition(5)
    roc = {(r["signal"], r["r"]): r["auroc"] for r in R.auroc_draws(df, TIMES, SEED, ["signal"]).collect()}
    ap = {} if most == 1 else {(r["signal"], r["r"]): r["average_precision"] for r in R.average_precision_draws(df, TIMES, SEED, ["signal"]).collect()}
    for signal in ("a", "c"):
        rows = rated(df, signal)
        w = drawn(rows)
        for r in range(TIMES):
            pairs = [(x["score"], x["y"], int(w[x["qid"]][r])) for x in rows]
            assert roc[signal, r] == pytest.approx(auroc(pairs))
            assert most == 1 or ap[signal, r] == pytest.approx(precision(pairs))


def test_precision_in_blocks_over_ties_that_cross_partitions(spark, monkeypatch):
    monkeypatch.setattr(R, "_MOST", 8 * 9 * 7)
    df = table(spark, missing=False).withColumn("score", F.floor(F.col("score") / 2).cast("double"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        ap = {(r["signal"], r["r"]): r["average_precision"] for r in R.average_precision_draws(df, 13, SEED, ["signal"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = rated(df, "b")
    w = drawn(rows)
    assert len(ap) == 39
    for r in range(13):
        assert ap["b", r] == pytest.approx(precision([(x["score"], x["y"], int(w[x["qid"]][r])) for x in rows]))


def test_clusters_within_their_majority_class(spark):
    df = table(spark, missing=False)
    got = {r["r"]: r["auroc"] for r in R.auroc_draws(df.where("signal = 'b'"), TIMES, SEED, ["signal"], "cluster_id", clusters=True).collect()}
    rows = rated(df, "b")
    votes = {}
    for x in rows:
        votes.setdefault(x["cluster_id"], []).append(x["y"])
    w = drawn(rows, "cluster_id", lambda x: np.mean(votes[x["cluster_id"]]) >= 0.5)
    for r in range(TIMES):
        assert got[r] == pytest.approx(auroc([(x["score"], x["y"], int(w[x["cluster_id"]][r])) for x in rows]))


def test_single_clusters_are_rows_and_one_sided_ones_fall_back(spark):
    df = table(spark, missing=False).where("signal = 'b'")
    rows = {r["r"]: r["auroc"] for r in R.auroc_draws(df, TIMES, SEED, ["signal"]).collect()}
    alone = df.withColumn("cluster_id", F.col("qid"))
    assert rows == {r["r"]: r["auroc"] for r in R.auroc_draws(alone, TIMES, SEED, ["signal"], "cluster_id", clusters=True).collect()}
    one = df.withColumn("cluster_id", F.lit(1))
    assert rows == {r["r"]: r["auroc"] for r in R.auroc_draws(one, TIMES, SEED, ["signal"], "cluster_id", clusters=True).collect()}


def test_contrasts_pair_their_rows(spark):
    df = table(spark)
    got = {r["contrast"]: r for r in R.contrast_tests(df, [("ab", "a", "b"), ("ca", "c", "a"), ("ba", "b", "a"), ("xa", "x", "a")], TIMES, SEED).collect()}
    assert set(got) == {"ab", "ca", "ba"} and got["ab"]["delta"] == -got["ba"]["delta"] and got["ca"]["n_paired"] == 81
    a, c = ({r["qid"]: r for r in rated(df, s)} for s in "ac")
    both = [a[q] for q in a if q in c]
    w = drawn(both)
    d = [auroc([(c[x["qid"]]["score"], x["y"], int(w[x["qid"]][r])) for x in both]) - auroc([(x["score"], x["y"], int(w[x["qid"]][r])) for x in both]) for r in range(TIMES)]
    assert (got["ca"]["ci_low"], got["ca"]["ci_high"]) == pytest.approx(tuple(np.quantile(d, [0.025, 0.975])))
    tail = sum(x <= 0 for x in d) if got["ca"]["delta"] >= 0 else sum(x >= 0 for x in d)
    assert got["ca"]["p_value"] == pytest.approx(min(1, 2 * (tail + 1) / (TIMES + 1)))


def test_label_delta_draws_within_the_new_classes(spark):
    df = table(spark)
    row = R.label_delta(df, "y", "z", TIMES, SEED).where("signal = 'c'").first()
    rows = rated(df, "c")
    w = drawn(rows, cls=lambda r: r["z"])
    of = lambda r, y: auroc([(x["score"], x[y], int(w[x["qid"]][r])) for x in rows])
    assert (row["ci_low"], row["ci_high"]) == pytest.approx(tuple(np.quantile([of(r, "z") - of(r, "y") for r in range(TIMES)], [0.025, 0.975])))


def test_stratified_draws_from_all_rows(spark):
    df = table(spark)
    got = {r["signal"]: r for r in R.bootstrap_stratified(df, "stratum", TIMES, SEED).collect()}
    rows = [r for r in df.collect() if r["signal"] == "c"]
    w, means = {}, []
    for s in ("s0", "s1", "s2"):
        w |= drawn([r for r in rows if r["stratum"] == s])
    for r in range(TIMES):
        parts = [(auroc([(x["score"], x["y"], int(w[x["qid"]][r])) for x in rows if x["stratum"] == s and x["score"] is not None]), 30) for s in ("s0", "s1", "s2")]
        known = [(v, n) for v, n in parts if v is not None]
        means.append(sum(v * n for v, n in known) / sum(n for _, n in known))
    assert (got["c"]["ci_low"], got["c"]["ci_high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    one = R.bootstrap_stratified(df.withColumn("y", F.col("y") & (F.col("stratum") != "s0")), "stratum", 5, SEED).collect()
    assert all(r["ci_low"] is None and r["resamples"] == 0 for r in one)


def test_kappa_and_rules_resample_all_rows(spark):
    df = table(spark, missing=False).where("signal = 'a'").select("qid", F.col("y").cast("string").alias("a"), F.col("z").cast("string").alias("b"))
    got = {(r["r"], r["a"], r["b"]): r["w"] for r in R.weighted_counts(df, TIMES, SEED, ["a", "b"]).collect()}
    rows = df.collect()
    w = plain([r["qid"] for r in rows])
    for r in range(TIMES):
        want = {}
        for x in rows:
            want[x["a"], x["b"]] = want.get((x["a"], x["b"]), 0) + int(w[x["qid"]][r])
        assert {k[1:]: v for k, v in got.items() if k[0] == r} == {k: v for k, v in want.items() if v}
        assert sum(want.values()) == len(rows)


def test_sides_of_groups_that_share_a_task_stay_in_order(spark):
    """Groups that begin and end within one batch of rows give what each gives alone."""
    df = table(spark, n=400, missing=False).withColumn("old", F.col("z"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        whole = {tuple(r) for r in R.auroc_draws(df, 3000, SEED, ["signal"], labels=["old", "y"]).select("signal", "label", "r", "auroc").collect()}
        alone = {tuple(r) for s in ("a", "b", "c") for r in R.auroc_draws(df.where(F.col("signal") == s), 3000, SEED, ["signal"], labels=["old", "y"]).select("signal", "label", "r", "auroc").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert whole == alone and len(whole) == 3 * 2 * 3000


def test_arrivals_are_those_of_plain_arithmetic():
    """Counts and times by the generator's definition, one number at a time, for small and large classes and any resamples."""
    def splitmix(x):
        x = (x ^ x >> 30) * D.FIRST % 2**64
        x = (x ^ x >> 27) * D.SECOND % 2**64
        return x ^ x >> 31

    h = np.random.default_rng(2).integers(0, 2**63, (5, 2), dtype=np.uint64)
    for power, some in ((0, range(40)), (4, range(3, 90)), (18, [0, 7, 8, 1000, *range(2000, 2300)])):
        before, inside = D.limits(power)
        k, place, time = D.arrivals(h, power, np.array(some, np.uint64))
        found = {}
        for i, (a, b) in enumerate(h.tolist()):
            for j, r in enumerate(some):
                m = splitmix((a + D.GOLDEN * (r + 1)) % 2**64)
                assert k[i, j] == sum(x <= m >> 32 for x in before)
                found[i * len(some) + j] = [splitmix((b + D.GOLDEN * (D.STRIDE * r + n + 1)) % 2**64) >> 2 for n in range(sum(x <= m % 2**32 for x in inside))]
        got = {p: [] for p in found}
        for p, t in zip(place.tolist(), time.tolist(), strict=True):
            got[p].append(t)
        assert got == found
        again = D.arrivals(h, power, np.array(some, np.uint64), only_inside=True)
        assert again[0] is None and (again[1] == place).all() and (again[2] == time).all()


def test_clusters_are_read_once(spark, monkeypatch):
    """The rows of clusters are stored before the search for last arrivals reads them again and again."""
    seen = []
    search = R.draws_of
    monkeypatch.setattr(R, "draws_of", lambda units, *a: seen.append(units._jdf.queryExecution().optimizedPlan().toString()) or search(units, *a))
    R.bootstrap_auroc(table(spark), TIMES, SEED, clusters=True)
    assert seen and all("Join" not in p and "Aggregate" not in p for p in seen)
