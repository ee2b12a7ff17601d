"""A run as its configuration states it: the question set, the signals and every table of the analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numeric import hash_share
from quillon.operators import datasets as D
from quillon.operators import resample as R
from quillon.operators import signals as S
from quillon.plans import compare as C
from quillon.plans import gates as G
from quillon.plans import leaderboard as L
from quillon.sources.config import Config

VIEWS = ("primary", "with_abstentions")


def settings(config: Config) -> S.Settings:
    s = config.signals
    return S.Settings(length_penalty_alpha=s.length_penalty_alpha, perplexity_clamp=s.perplexity_clamp, verbal_confidence_max=s.verbal_confidence_max, seed=config.dataset_seed)


def options(config: Config) -> L.Options:
    a = config.analysis
    return L.Options(resamples=a.bootstrap_resamples, seed=a.bootstrap_seed, level=a.ci_level, bins=a.ece_bins, target=a.target_accuracy, gap=a.min_meaningful_auroc_gap, alpha=a.holm_alpha, cluster_bootstrap=a.cluster_bootstrap)


def questions(config: Config, raw: dict[str, DataFrame]) -> DataFrame:
    """The mix of sources, drawn with the set's seed, checked against the few-shot exemplars."""
    d, mix = config.difficulty, config.dataset_mix
    asked = {
        "popqa": {"relations": list(d.popqa_relations) if d.popqa_relations else None, "popularity_quantile": d.popqa_popularity_quantile, "allow_inverse": d.allow_inverse_relations, "drop_gold_in_question": d.drop_gold_in_question},
        "triviaqa": {"easy_only": d.triviaqa_easy_only, "least_aliases": d.triviaqa_min_aliases, "drop_gold_in_question": d.drop_gold_in_question},
    }
    out = D.build_mix(raw, {"popqa": mix.popqa, "triviaqa": mix.triviaqa, "simpleqa": mix.simpleqa}, config.dataset_seed, asked)
    return D.assert_disjoint(out, [q for q, _ in config.few_shot.pairs]) if config.few_shot.enabled else out


def analyse(config: Config, signals: DataFrame, labels: DataFrame, context: DataFrame | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the analysis, each with its view: board (metrics, intervals, rank), significance, calibration, by_dataset, gates and verdict.

    ``context`` holds ``dataset`` and, for clusters, ``cluster_id`` by qid. The
    calibration is fitted on the hash split that the configuration asks for.
    """
    o = options(config)
    names = names or [s.name for s in S.catalog() if s.name in signals.columns]
    rows = L.views(L.analysis_rows(signals, labels, context), o.abstain_as)
    keep = [c for c in ("dataset", "cluster_id") if c in rows.columns]
    long = L.long_form(rows, names, *keep)
    tables: dict[str, list[DataFrame]] = {}
    train = hash_share(F.lit(str(config.split.seed)), F.col("qid")) < config.split.train_fraction
    for view in VIEWS:
        scores = long.where(F.col("view") == view)
        ends = R.bootstrap_auroc(scores, o.resamples, o.seed, level=o.level, clusters=o.cluster_bootstrap).select("signal", "ci_low", "ci_high", "resamples")
        precision = R.bootstrap_average_precision(scores, o.resamples, o.seed, level=o.level, clusters=o.cluster_bootstrap).select("signal", F.col("ci_low").alias("ap_low"), F.col("ci_high").alias("ap_high"))
        board = L.ranked(L.metrics_table(scores, [], o).join(ends, "signal", "left").join(precision, "signal", "left"), [])
        made = {"board": C.analytic_intervals(board, o.level), "verdict": L.verdict(board, o.gap), "calibration": L.calibration_table(scores, train, [], o)}
        if not board.isEmpty():
            made["significance"] = L.significance(scores, board, o)
        if "dataset" in keep:
            made["by_dataset"] = R.bootstrap_by_stratum(scores, "dataset", o.resamples, o.seed, level=o.level)
            one = scores.select("qid", "y", "dataset").distinct()
            made["gates"] = G.evaluate(one, labels, ends.join(board.select("signal", "auroc"), "signal"))
        for name, table in made.items():
            tables.setdefault(name, []).append(table.withColumn("view", F.lit(view)))
    return {name: parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] for name, parts in tables.items()}
