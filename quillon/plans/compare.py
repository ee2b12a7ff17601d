"""Run comparison, audits of stored results, agreement with people, figure data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.operators import resample as R
from quillon.operators.labels import cohens_kappa
from quillon.operators.runs import first_stops


def compare_signals(left: DataFrame, right: DataFrame) -> DataFrame:
    """All signals of two runs (signal, auroc, ci_low, ci_high): difference, overlap, identity; ordered by the left AUROC."""
    cols = ("auroc", "ci_low", "ci_high")
    l = left.select("signal", *[F.col(c).alias(f"left_{c}") for c in cols], F.lit(True).alias("_l"))
    r = right.select("signal", *[F.col(c).alias(f"right_{c}") for c in cols], F.lit(True).alias("_r"))
    both = l.join(r, "signal", "full_outer")
    overlap = (F.col("left_ci_low") <= F.col("right_ci_high")) & (F.col("right_ci_low") <= F.col("left_ci_high"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    out = both.withColumns({"in_left": F.col("_l").isNotNull(), "in_right": F.col("_r").isNotNull(), "delta": F.col("right_auroc") - F.col("left_auroc"), "intervals_overlap": overlap})
    return out.withColumn("identical", same & F.col("in_left") & F.col("in_right")).drop("_l", "_r").orderBy(F.desc_nulls_last("left_auroc"), "signal")


def count_differences(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count(F.lit(1)).alias("n_signals"), F.count_if(~F.col("identical")).alias("n_differ"), F.count_if(~(F.col("in_left") & F.col("in_right"))).alias("n_one_sided"))


def run_summary(rows: DataFrame, labels: DataFrame, intervals: DataFrame) -> DataFrame:
    """Facts of a run on one row: sizes, classes, digest, resamples."""
    from quillon.operators.datasets import row_set_digest

    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("n_incorrect"), F.count_if(~F.col("y")).alias("n_correct"))
    other = labels.agg(F.count_if(F.col("label") == "ambiguous").alias("n_ambiguous"), F.count_if(F.col("label") == "abstain").alias("n_abstain"))
    return counts.crossJoin(F.broadcast(other)).crossJoin(F.broadcast(row_set_digest(rows))).crossJoin(F.broadcast(intervals.agg(F.max("resamples").alias("resamples"))))  # one row each


def duplicate_pairs(matrix: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs of signals (all, or the asked ones) with whether their ranks are the same or reversed."""
    asked = matrix.where("a <> b") if pairs is None else matrix.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_semi")
    return asked.withColumns({"rank_equivalent": F.coalesce(F.abs("rho") == 1.0, F.lit(False)), "direction": F.when(F.col("rho") > 0, "same").when(F.col("rho") < 0, "reversed")})


def independent_signals(matrix: DataFrame) -> DataFrame:
    """How many signals are left when each restatement of an earlier one is dropped."""
    dup = matrix.where("a < b and abs(rho) = 1").select("b").distinct()
    names = matrix.where("a = b").select("a")
    return names.join(dup, names.a == dup.b, "left_anti").agg(F.count(F.lit(1)).alias("n_independent"))


def spearman_between(matrix: DataFrame, a: str, b: str) -> float | None:
    """A stored coefficient; an unknown name raises."""
    lo, hi = sorted((a, b))
    row = matrix.where((F.col("a") == lo) & (F.col("b") == hi)).select("rho").first()
    if row is None:
        raise KeyError(f"no coefficient for {a!r} and {b!r}")
    return row[0]


def analytic_intervals(board: DataFrame, level: float = 0.95) -> DataFrame:
    """Analytic intervals of AUROCs (auroc, n_pos, n_neg): excludes chance, leaves [0, 1], margin, chance p."""
    ok = F.col("auroc").isNotNull() & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    out = board.withColumn("_h", F.when(ok, N.hanley_mcneil(F.col("auroc"), F.col("n_pos"), F.col("n_neg"), level)))
    out = out.withColumns({"se": F.col("_h.se"), "analytic_low": F.col("_h.low"), "analytic_high": F.col("_h.high")}).drop("_h")
    return out.withColumns(
        {
            "excludes_chance": (F.col("analytic_low") > 0.5) | (F.col("analytic_high") < 0.5),
            "out_of_range": (F.col("analytic_low") < 0) | (F.col("analytic_high") > 1),
            "margin": F.greatest(F.col("analytic_low") - 0.5, 0.5 - F.col("analytic_high")),
            "chance_p": N.chance_p_value(F.col("auroc"), F.col("se")),
        }
    )


def holm_comparison(tests: DataFrame, dropped: list[str], alpha: float = 0.05) -> DataFrame:
    """Verdicts of the whole family and of the family without restatements, side by side."""
    whole = R.holm(tests, position="signal", name="p_full", alpha=alpha)
    part = R.holm(tests.where(~F.col("signal").isin(dropped) if dropped else F.lit(True)), position="signal", name="p_distinct", alpha=alpha)
    both = whole.join(part.select("signal", "p_distinct", "significant_p_distinct"), "signal", "left")
    return both.withColumns({"dropped": F.col("signal").isin(dropped) if dropped else F.lit(False), "verdict_changed": F.coalesce(F.col("significant_p_full") != F.col("significant_p_distinct"), F.lit(False))})


def method_agreement(board: DataFrame) -> DataFrame:
    """Endpoint gaps between analytic and bootstrap intervals."""
    gap = F.greatest(F.abs(F.col("analytic_low") - F.col("ci_low")), F.abs(F.col("analytic_high") - F.col("ci_high")))
    boot = (F.col("ci_low") > 0.5) | (F.col("ci_high") < 0.5)
    return board.where("analytic_low is not null and ci_low is not null").agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.count_if(boot != F.col("excludes_chance")).alias("n_disagree"))


VALID_HUMAN = ("correct", "incorrect", "ambiguous", "abstain")
MACHINE_COLUMNS = ("heuristic_verdict", "judge_primary_verdict", "judge_secondary_verdict", "machine_label")


def human_label(column: str = "human_label") -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))


def machine_agreement(sample: DataFrame, machine: list[str] | None = None) -> DataFrame:
    """Kappa of people with every machine column, over rows that both decide."""
    columns = [c for c in (machine or MACHINE_COLUMNS) if c in sample.columns]
    ok = sample.withColumn("human", human_label()).where(F.col("human").isin(*VALID_HUMAN))
    rows = ok.unpivot(["qid", "human"], columns, "machine", "verdict").withColumn("verdict", F.lower(F.trim(F.coalesce("verdict", F.lit("")))))
    return cohens_kappa(rows.where(F.col("verdict").isin(*VALID_HUMAN)), "human", "verdict", ["machine"])


def disagreements(sample: DataFrame, machine: str = "machine_label") -> DataFrame:
    return sample.where(human_label().isin(*VALID_HUMAN) & (human_label() != F.lower(F.trim(machine)))).select("qid")


def human_report(sample: DataFrame, machine: str = "machine_label") -> DataFrame:
    """Coverage, invalid labels, base and error rate, and the ceiling that the errors put on any AUROC."""
    h = human_label()
    valid, decided = h.isin(*VALID_HUMAN), h.isin("correct", "incorrect")
    told = F.lower(F.trim(machine))
    both = decided & told.isin("correct", "incorrect")
    row = sample.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_labelled"), F.count_if((h != "") & ~valid).alias("n_invalid"),
        F.array_sort(F.collect_list(F.when((h != "") & ~valid, F.col("qid")))).alias("invalid_qids"),
        F.avg(F.when(decided, (h == "incorrect").cast("double"))).alias("base_rate"), F.avg(F.when(both, (h != told).cast("double"))).alias("error_rate"),
    )
    return row.withColumns({"coverage": F.try_divide("n_labelled", "n_rows"), "oracle_ceiling": N.oracle_ceiling(F.col("error_rate"), F.col("base_rate")), "usable": F.col("n_labelled") > 0})


def tension_band(board: DataFrame) -> DataFrame:
    """Signals whose interval overlaps the leader's."""
    lead = board.where("rank = 1").select(F.col("ci_low").alias("lo"), F.col("ci_high").alias("hi"))
    return board.crossJoin(F.broadcast(lead)).agg(F.count_if((F.col("ci_low") <= F.col("hi")) & (F.col("lo") <= F.col("ci_high"))).alias("n_overlapping"), F.count(F.lit(1)).alias("n"))  # one row


def reliability_points(bins: DataFrame) -> DataFrame:
    """Bins that can be drawn: not empty, both means finite."""
    return bins.where("n > 0 and confidence is not null and accuracy is not null")


def figure_panels(board: DataFrame, most: int = 12) -> DataFrame:
    """Rows of a leaderboard figure, best first."""
    return board.where("auroc is not null").orderBy("rank").limit(most)


def score_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """Counts by signal, class and equal-width bin, for distribution figures."""
    span = scores.where("score is not null").groupBy("signal").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("score") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0)))).cast("int")
    return scores.where("score is not null and y is not null").join(F.broadcast(span), "signal").groupBy("signal", "y", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # a row per signal


def recovered_verdicts(sample: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Second verdicts looked up in the response table, and whether both judges agree."""
    from quillon.functions.text import parse_verdict

    found = sample.withColumn("key", key).join(cache.select("key", "value"), "key", "left").withColumn("recovered", parse_verdict(F.col("value")))
    return found.withColumn("agrees", F.col("recovered") == F.col("judge_primary_verdict")).drop("key", "value")


def consecutive_failures(replies: DataFrame, order: str, most: int = 5) -> DataFrame:
    """Where a run of failed calls first reaches the limit, by judge: the place at which asking stops."""
    return first_stops(replies, order, most)
