"""Validity gates: recorded, never raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the gates.
MIN_PER_CLASS = 30
MAX_ABSTENTION_RATE = 0.10
MIN_HUMAN_LABEL_COVERAGE = 0.80
MIN_PROTOCOL_COVERAGE = 0.50
RANDOM_SIGNAL = "t_random"


def _gate(name: str, passed: Column, observed: Column, requirement: str) -> list[Column]:
    return [F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), observed.cast("string").alias("observed"), F.lit(requirement).alias("requirement")]


def random_baseline(intervals: DataFrame) -> DataFrame:
    """The interval of the random signal holds one half; an absent or undefined one fails."""
    row = intervals.where(F.col("signal") == RANDOM_SIGNAL).agg(F.max("auroc").alias("p"), F.max("ci_low").alias("lo"), F.max("ci_high").alias("hi"))
    seen = F.coalesce(F.format_string("AUROC %.3f [%.3f, %.3f]", "p", "lo", "hi"), F.lit("undefined"))
    return row.select(*_gate("random_baseline_ci_contains_chance", (F.col("lo") <= 0.5) & (F.col("hi") >= 0.5), F.when(F.col("lo").isNull(), "undefined").otherwise(seen), f"{RANDOM_SIGNAL} interval contains 0.50"))


def class_balance(rows: DataFrame) -> DataFrame:
    row = rows.agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    return row.select(*_gate("minimum_rows_per_class", F.least("p", "n") >= MIN_PER_CLASS, F.format_string("%d incorrect, %d correct", "p", "n"), f">= {MIN_PER_CLASS} rows in each class"))


def abstention(labels: DataFrame) -> DataFrame:
    row = labels.agg(F.count_if(F.col("label") == "abstain").alias("k"), F.count(F.lit(1)).alias("n"))
    return row.select(*_gate("abstention_rate_below_ceiling", F.try_divide("k", "n") < MAX_ABSTENTION_RATE, F.format_string("%d/%d", "k", "n"), f"< {MAX_ABSTENTION_RATE:.2f} of scored rows"))


def per_dataset(rows: DataFrame, by: str = "dataset") -> DataFrame:
    each = rows.groupBy(by).agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    told = F.array_join(F.array_sort(F.collect_list(F.format_string("%s %d/%d", by, "p", "n"))), "; ")
    row = each.agg(F.bool_and(F.least("p", "n") >= MIN_PER_CLASS).alias("ok"), told.alias("seen"))
    return row.select(*_gate("per_dataset_class_counts", F.col("ok"), F.col("seen"), f">= {MIN_PER_CLASS} rows in each class of each dataset"))


def coverage(rows: DataFrame | None, name: str, least: float, filled: Column, spark) -> DataFrame:
    """Share of filled rows of a file for people; an absent file fails."""
    if rows is None:
        return spark.range(1).select(*_gate(name, F.lit(False), F.lit("file absent"), f">= {least:.2f} labelled"))
    row = rows.agg(F.avg(filled.cast("double")).alias("c"))
    return row.select(*_gate(name, F.col("c") >= least, F.format_string("coverage %.3f", F.coalesce("c", F.lit(0.0))), f">= {least:.2f} labelled"))


def evaluate(rows: DataFrame, labels: DataFrame, intervals: DataFrame, *, protocol: DataFrame | None = None, fuzzy: DataFrame | None = None, by: str = "dataset") -> DataFrame:
    """All gates, one row each."""
    spark = rows.sparkSession
    filled = F.trim(F.coalesce("human_label", F.lit(""))) != ""
    parts = [
        random_baseline(intervals),
        class_balance(rows),
        abstention(labels),
        per_dataset(rows, by),
        coverage(protocol, "labeling_protocol_validated", MIN_PROTOCOL_COVERAGE, filled, spark),
        coverage(fuzzy, "human_label_coverage", MIN_HUMAN_LABEL_COVERAGE, filled, spark),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(gates: DataFrame) -> DataFrame:
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return gates.agg(F.bool_and("passed").alias("all_passed"), failed.alias("failed"), F.bool_and("passed").alias("ranking_publishable"))


def pilot_gate(labels: DataFrame, low: float = 0.25, high: float = 0.65) -> DataFrame:
    """Counts, error rate of decided rows, and whether the set is hard enough and not too hard."""
    row = labels.agg(*[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in ("correct", "incorrect", "ambiguous", "abstain")], F.count(F.lit(1)).alias("n"))
    rate = F.try_divide("n_incorrect", F.col("n_incorrect") + F.col("n_correct"))
    inside = (rate >= low) & (rate <= high)
    advice = F.when(rate.isNull(), "no decided rows").when(inside, "proceed").when(rate < low, "too easy: make the set harder").otherwise("too hard: make the set easier")
    return row.withColumns({"error_rate": rate, "in_band": F.coalesce(inside, F.lit(False)), "recommendation": advice})


def frozen_set(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Digest of the analysed ids, after uniqueness and column checks."""
    from quillon.operators.datasets import row_set_digest
    from quillon.schema import assert_unique, require_columns

    return row_set_digest(assert_unique(require_columns(rows, "qid", *columns), "qid"))
