"""Metrics over long score tables: keys, score, y, row_pos. Rows without a usable score or label do not count.

Rank statistics are computed on the histogram of distinct scores, which map-side
aggregation makes small before anything is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.quantiles import quantiles
from quillon.operators.ranges import checkpointed, running_sums
from quillon.schema import usable

#: Distinct scores of one key that one task sums.
MOST_SCORES = 1_000_000


def rated(df: DataFrame) -> DataFrame:
    return df.where(usable(F.col("score")) & F.col("y").isNotNull())


def histogram(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, score, pos, neg): mergeable state of every rank statistic."""
    w = F.lit(1) if weight is None else weight
    return rated(df).groupBy(*keys, "score").agg(F.sum(F.when(F.col("y"), w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y"), 0).otherwise(w)).alias("neg"))


def stored(hist: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """A histogram in the shared folder, and into how many ranges its largest key is to be cut."""
    hist = checkpointed(hist)
    most = hist.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return hist, -(-most // MOST_SCORES)


def running(hist: DataFrame, keys: list[str], columns: list[str], *, descending: bool = False, spread: int | None = None) -> DataFrame:
    """Add ``<column>_before``: sums over scores that come earlier within the keys.

    The histogram is checkpointed and its rows are counted. Keys of more than
    ``MOST_SCORES`` distinct scores are cut at approximate quantiles into ranges
    of about as many, so that no task sums more; the range totals are a row per
    key and range. A given ``spread`` is the number of ranges, without a count.
    """
    if spread is None:
        hist, spread = stored(hist, keys)
    order = F.desc("score") if descending else F.asc("score")
    zero = F.lit(0)
    if spread <= 1:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return hist.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), zero) for c in columns})
    placed = _placed(hist, keys, spread)
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    outer = Window.partitionBy(*keys).orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(outer), zero).alias(f"_{c}") for c in columns])
    inner = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = _join(placed, starts, [*keys, "_range"])
    return both.withColumns({f"{c}_before": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inner), zero) for c in columns}).drop("_range", *[f"_{c}" for c in columns])


def running_max(hist: DataFrame, keys: list[str], column: str, name: str, *, spread: int) -> DataFrame:
    """Add the largest value of a column so far, by ascending score, summed up range by range as in ``running``."""
    placed = _placed(hist, keys, spread)
    tops = placed.groupBy(*keys, "_range").agg(F.max(column).alias("_top"))
    outer = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select(*keys, "_range", F.max("_top").over(outer).alias("_top"))
    inner = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    both = _join(placed, starts, [*keys, "_range"])
    return both.withColumn(name, F.greatest("_top", F.max(column).over(inner))).drop("_range", "_top")


def _placed(hist: DataFrame, keys: list[str], spread: int) -> DataFrame:
    """Add ``_range``: which of ``spread`` ranges of its key's scores, cut at approximate quantiles, a score is in."""
    cuts = hist.groupBy(*keys).agg(F.percentile_approx("score", [i / spread for i in range(1, spread)], 1000).alias("_cuts"))
    return _join(hist, cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join that lets null keys meet."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return a.alias("l").join(b.alias("r"), on).select("l.*", *[f"r.`{c}`" for c in b.columns if c not in keys])


def auroc_from(hist: DataFrame, keys: list[str], *, spread: int | None = None) -> DataFrame:
    """AUROC with ties at one half; null where a class is empty."""
    u = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return (
        running(hist, keys, ["neg"], spread=spread)
        .groupBy(*keys)
        .agg((F.sum("pos") + F.sum("neg")).cast("long").alias("n"), F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"), F.try_divide(u, F.when(pairs > 0, pairs)).alias("auroc"))
    )


def auroc(df: DataFrame, keys: list[str], *, spread: int | None = None) -> DataFrame:
    return auroc_from(histogram(df, keys), keys, spread=spread)


def midranks(df: DataFrame, keys: list[str], value: str, name: str = "midrank") -> DataFrame:
    """1-based ranks, ties at their mean: running counts over the distinct values, joined back."""
    hist = df.groupBy(*keys, F.col(value).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    ranks = running(hist, keys, ["n"]).select(*keys, F.col("score").alias(value), (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
    return _join(df, ranks, [*keys, value])


def precision_recall(df: DataFrame, keys: list[str], *, spread: int | None = None) -> DataFrame:
    """One operating point per distinct score, highest first."""
    hist = histogram(df, keys)
    h = _join(running(hist, keys, ["pos", "neg"], descending=True, spread=spread), hist.groupBy(*keys).agg(F.sum("pos").alias("_total")), keys)
    total = F.col("_total")
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    return h.select(*keys, "score", (tp / (tp + fp)).alias("precision"), F.try_divide(tp.cast("double"), total).alias("recall"), F.try_divide(F.col("pos_before").cast("double"), total).alias("recall_before"))


def average_precision_from(hist: DataFrame, keys: list[str], *, spread: int | None = None) -> DataFrame:
    h = running(hist, keys, ["pos", "neg"], descending=True, spread=spread)
    tp = F.col("pos_before") + F.col("pos")
    part = F.col("pos") * tp / (tp + F.col("neg_before") + F.col("neg"))
    return h.groupBy(*keys).agg(F.try_divide(F.sum(part), F.sum("pos").cast("double")).alias("average_precision"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Step-wise average precision; null without positives."""
    return average_precision_from(histogram(df, keys), keys)


def risk_coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Error rate among the k rows of lowest score, for every k; ties keep row order. Nothing for keys of one class."""
    rows = rated(df).withColumn("_y", F.col("y").cast("int"))
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate")).where("rate > 0 and rate < 1")
    placed = _join(running_sums(rows.select(*keys, "score", "row_pos", "_y"), keys, ["score", "row_pos"], ["_y"]), whole, keys)
    return placed.select(*keys, F.col("k").cast("long").alias("k"), (F.col("k") / F.col("n")).alias("coverage"), (F.col("_y_so_far") / F.col("k")).alias("risk"), F.col("rate").alias("base_rate"))


def aurc(df: DataFrame, keys: list[str], target: float = 0.9) -> DataFrame:
    """Mean risk, base rate, and the largest coverage whose risk is within 1 - target (null if none is)."""
    within = F.col("risk") <= F.lit(1.0) - F.lit(float(target))
    return risk_coverage(df, keys).groupBy(*keys).agg(F.avg("risk").alias("aurc"), F.max("base_rate").alias("base_rate"), F.max(F.when(within, F.col("coverage"))).alias("coverage_at_target"))


def ece_bins(df: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Equal-width bins (lo, hi], 0 in the first; empty bins are there with null means."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)]) if bins > 1 else F.array().cast("array<double>")
    placed = rated(df).withColumns({"p": p}).withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("p"))))
    sums = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("y").cast("double")).alias("accuracy"))
    grid = sums.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(sums, [*keys, "bin"], "left").fillna(0, ["n"])
    return full.withColumn("center", (F.col("bin") + 0.5) / bins)


def ece(df: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))
    return ece_bins(df, keys, bins).groupBy(*keys).agg(F.try_divide(F.sum(gap), F.sum("n").cast("double")).alias("ece"))


def fit_platt(df: DataFrame, keys: list[str], *, most_steps: int = 200, tolerance: float = 1e-9, ridge: float = 1e-9) -> DataFrame:
    """(keys, a, b) of P = sigmoid(a * score + b) by Newton steps on standardized scores.

    A step is one aggregate of five sums for all keys at once; the rows never
    leave the executors. A constant score gets a = 0 and the clipped base rate.
    """
    spark = df.sparkSession
    base = rated(df).select(*keys, "score", F.col("y").cast("double").alias("y")).cache()
    stats = base.groupBy(*keys).agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.avg("y").alias("rate")).collect()  # a row per key
    state = {}
    for r in stats:
        rate = min(max(r["rate"], 1e-6), 1 - 1e-6)
        flat = not r["s"] or r["s"] < 1e-12
        state[tuple(r[k] for k in keys)] = {"m": r["m"], "s": 1.0 if flat else r["s"], "a": 0.0, "b": _logit(rate) if flat else 0.0, "done": flat}
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    head = f"{kinds}, " if keys else ""
    for _ in range(most_steps):
        open_ = {k: v for k, v in state.items() if not v["done"]}
        if not open_:
            break
        at = spark.createDataFrame([(*k, v["m"], v["s"], v["a"], v["b"]) for k, v in open_.items()], f"{head}m double, s double, a double, b double")
        z = (F.col("score") - F.col("m")) / F.col("s")
        logit = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("a") * z + F.col("b")))
        p = 1.0 / (1.0 + F.exp(-logit))
        w, e = F.greatest(p * (1.0 - p), F.lit(1e-12)), p - F.col("y")
        sums = _join(base, at, keys).groupBy(*keys).agg(
            F.sum(e * z).alias("ga"), F.sum(e).alias("gb"), F.sum(w * z * z).alias("haa"), F.sum(w * z).alias("hab"), F.sum(w).alias("hbb")
        )
        for r in sums.collect():  # five numbers per key
            v = state[tuple(r[k] for k in keys)]
            haa, hbb = r["haa"] + ridge, r["hbb"] + ridge
            det = haa * hbb - r["hab"] ** 2
            da, db = (hbb * r["ga"] - r["hab"] * r["gb"]) / det, (haa * r["gb"] - r["hab"] * r["ga"]) / det
            v["a"], v["b"] = v["a"] - da, v["b"] - db
            v["done"] = max(abs(da), abs(db)) < tolerance
    base.unpersist()
    rows = [(*k, v["a"] / v["s"], v["b"] - v["a"] * v["m"] / v["s"]) for k, v in state.items()]
    return spark.createDataFrame(rows, f"{head}a double, b double")


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def apply_platt(df: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Replace scores by calibrated probabilities."""
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("a") * F.col("score") + F.col("b")))
    return _join(df, fitted, keys).withColumn("score", 1.0 / (1.0 + F.exp(-z))).drop("a", "b")


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null for a constant column."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))


def spearman_matrix(df: DataFrame, keys: list[str] | None = None, least: int = 3) -> DataFrame:
    """(keys, a, b, n, rho) over rows that both signals have, ranked within the pair; null below ``least`` rows or for a constant."""
    from quillon.operators.gram import rank_pairs

    keys = keys or []
    return rank_pairs(df, keys).select(*keys, "a", "b", "n", F.when(F.col("n") >= least, F.col("rho")).alias("rho"))


def rank_identity(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, a, b, same, reversed): exact tests on ranks, free of rounding."""
    from quillon.operators.gram import rank_pairs

    return rank_pairs(df, keys).select(*(keys or []), "a", "b", "same", "reversed")


def _line(v: str, g: str) -> list[Column]:
    """Least squares of v on g within a group: slope (0 on a constant g) and means."""
    slope = F.coalesce(F.try_divide(F.covar_pop(v, g), F.nullif(F.var_pop(g), F.lit(0.0))), F.lit(0.0))
    return [slope.alias(f"{v}_slope"), F.avg(v).alias(f"{v}_mean")]


def residual_ranks(df: DataFrame, keys: list[str], values: dict[str, str], given: str) -> DataFrame:
    """Ranks of each of ``values`` (by result name) less their least-squares line on ranks of ``given``."""
    ranked = midranks(df, keys, given, "_g")
    for name, value in values.items():
        ranked = midranks(ranked, keys, value, f"_{name}")
    ranked = checkpointed(ranked)
    lines = ranked.groupBy(*keys).agg(F.avg("_g").alias("_g_mean"), *[c for name in values for c in _line(f"_{name}", "_g")])
    rest = {name: F.col(f"_{name}") - F.col(f"_{name}_mean") - F.col(f"_{name}_slope") * (F.col("_g") - F.col("_g_mean")) for name in values}
    return _join(ranked, lines, keys).select(*df.columns, *[c.alias(name) for name, c in rest.items()])


def partial_spearman(df: DataFrame, keys: list[str], x: str, z: str, given: str, least: int = 5) -> DataFrame:
    """Spearman of the rank residuals of x and z given a third column."""
    ok = checkpointed(df.where(usable(F.col(x)) & usable(F.col(z)) & usable(F.col(given))).select(*keys, F.col(x).alias("_1"), F.col(z).alias("_2"), F.col(given).alias("_3")))
    left = residual_ranks(ok, keys, {"ex": "_1", "ez": "_2"}, "_3").select(*keys, F.round("ex", 9).alias("ex"), F.round("ez", 9).alias("ez"))
    ranked = midranks(midranks(checkpointed(left), keys, "ex", "rx"), keys, "ez", "rz")
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("rx", "rz").alias("partial_rho"))
    return out.withColumn("partial_rho", F.when(F.col("n") >= least, F.col("partial_rho")))


def strata_auroc(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """AUROC at or below and above the median length of each key; ties go below."""
    med = quantiles(rated(df), keys, length, [0.5]).select(*keys, F.col("quantiles")[0].alias("_median"))
    placed = _join(df, med, keys).withColumn("length_stratum", F.when(F.col(length) <= F.col("_median"), "at_or_below").otherwise("above"))
    return auroc(placed, [*keys, "length_stratum"])


def rule_accuracy(df: DataFrame, predicted: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    """Precision and recall of a rule on rows where both sides are known."""
    both = df.where(predicted.isNotNull() & actual.isNotNull()).withColumns({"_p": predicted, "_a": actual})
    counts = both.groupBy(*(keys or [])).agg(
        F.count_if(F.col("_p") & F.col("_a")).alias("tp"), F.count_if(F.col("_p") & ~F.col("_a")).alias("fp"), F.count_if(~F.col("_p") & F.col("_a")).alias("fn"), F.count(F.lit(1)).alias("n")
    )
    return counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of finite values by weight; groups without a value do not count."""
    ok = df.where(usable(F.col(value)))
    return ok.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double")).alias(value))


def class_counts(df: DataFrame, by: str) -> DataFrame:
    """Rows and classes by group and over all (null group), in one pass."""
    return df.groupingSets([[by], []], by).agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("n_incorrect"), F.count_if(~F.col("y")).alias("n_correct"), F.avg(F.col("y").cast("double")).alias("base_rate"))


def modal_share(df: DataFrame, value: Column) -> DataFrame:
    """Most frequent value (the smallest of several) and its share."""
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("v", F.struct(F.col("n"), -F.col("v"))).alias("modal_value"), (F.max("n") / F.sum("n")).alias("modal_share"), F.count(F.lit(1)).alias("n_distinct"))
