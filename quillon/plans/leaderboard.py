"""The leaderboard: every metric of every signal for both views of a run, as tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import metrics as M
from quillon.operators import resample as R
from quillon.operators import signals as S
from quillon.operators.gram import rank_pairs
from quillon.operators.ranges import checkpointed, rank_within
from quillon.schema import one_to_one


@dataclass(frozen=True)
class Options:
    resamples: int = 1000
    seed: int = 987654321
    level: float = 0.95
    bins: int = 15
    target: float = 0.9
    gap: float = 0.02
    alpha: float = 0.05
    abstain_as: str = "negative"
    cluster_bootstrap: bool = False


def analysis_rows(signals: DataFrame, labels: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Signals with labels, one to one, and what else is known of a row (dataset, question, answer)."""
    out = one_to_one(signals, labels.select("qid", "label", "source"), "qid")
    return out if context is None else out.join(context, "qid", "left")


def views(rows: DataFrame, abstain_as: str = "negative") -> DataFrame:
    """Each row in the views it belongs to: primary (no ambiguous, no abstained), with_abstentions (no ambiguous).

    An abstention counts as not wrong unless ``abstain_as`` is "positive".
    """
    kept = rows.where("label <> 'ambiguous'")
    view = F.explode(F.when(F.col("label") == "abstain", F.array(F.lit("with_abstentions"))).otherwise(F.array(F.lit("primary"), F.lit("with_abstentions"))))
    y = F.when(F.col("label") == "abstain", F.lit(abstain_as == "positive")).otherwise(F.col("label") == "incorrect")
    return kept.withColumns({"view": view, "y": y})


def long_form(rows: DataFrame, signals: list[str], *keep: str) -> DataFrame:
    """The score table; ``row_pos`` orders rows by id for statistics that depend on the order of ties."""
    base = rank_within(rows, F.col("view"), ["qid"], "row_pos") if "row_pos" not in rows.columns else rows
    return S.long_scores(base, keep=["view", "qid", "row_pos", "y", *keep], signals=signals)


def ranking(scores: DataFrame, keys: list[str], registry: DataFrame | None = None) -> DataFrame:
    """Signals by AUROC, best first; ties in the order of registration (else by name)."""
    return ranked(M.auroc(scores, [*keys, "signal"]), keys, registry)


def ranked(board: DataFrame, keys: list[str], registry: DataFrame | None = None) -> DataFrame:
    """A board of AUROCs with ``rank``; undefined ones go."""
    board = board.where("auroc is not null")
    if registry is not None:
        board = board.join(F.broadcast(registry.select("signal", "position")), "signal", "left")  # a row per signal
    tie = [F.col("position").asc_nulls_last()] if registry is not None else []
    w = Window.partitionBy(*keys).orderBy(F.desc("auroc"), *tie, "signal")
    return board.withColumn("rank", F.row_number().over(w)).drop("position")


def metrics_table(scores: DataFrame, keys: list[str], options: Options = Options()) -> DataFrame:
    """AUROC, AP, AURC and coverage at the target for every key, side by side; one stored histogram serves the first two."""
    by = [*keys, "signal"]
    hist, spread = M.stored(M.histogram(scores, by), by)
    out = M.auroc_from(hist, by, spread=spread)
    for part in (M.average_precision_from(hist, by, spread=spread), M.aurc(scores, by, options.target)):
        out = out.join(part, by, "left")
    return out


def calibration_table(scores: DataFrame, train: Column, keys: list[str], options: Options = Options()) -> DataFrame:
    """ECE on held-out rows after Platt scaling fitted on the train rows."""
    by = [*keys, "signal"]
    fitted = M.fit_platt(scores.where(train), by)
    return M.ece(M.apply_platt(scores.where(~train), fitted, by), by, options.bins)


#: Signals whose oriented score plus one is a probability of being wrong.
PROBABILITIES = ("c_p_true_plain", "c_p_true_with_samples", "c_verbal_confidence")


def raw_calibration(scores: DataFrame, keys: list[str], options: Options = Options()) -> DataFrame:
    """ECE before scaling, for the signals that are probabilities."""
    return M.ece(scores.where(F.col("signal").isin(*PROBABILITIES)).withColumn("score", 1.0 + F.col("score")), [*keys, "signal"], options.bins)


def distinct_ranking(scores: DataFrame, ranked: DataFrame, registry: DataFrame) -> DataFrame:
    """The ranking with ``dropped`` for declared restatements of another ranked signal.

    Identity is tested on ranks. A declared pair that differs on three rows or
    more is a broken declaration and raises in ``assert_declared``.
    """
    same = rank_pairs(scores)
    declared = registry.where("rank_equivalent_to is not null").select("signal", F.col("rank_equivalent_to").alias("of"))
    a, b = F.least("signal", "of"), F.greatest("signal", "of")
    found = declared.withColumns({"a": a, "b": b}).join(same, ["a", "b"], "left")
    told = found.select("signal", F.coalesce((F.col("same") | F.col("reversed")) & (F.col("n") >= 3), F.lit(False)).alias("dropped"), (F.col("n") >= 3).alias("testable"))
    return ranked.join(F.broadcast(told), "signal", "left").fillna(False, ["dropped", "testable"])  # a row per signal


def assert_declared(distinct: DataFrame) -> DataFrame:
    from quillon.schema import ContractError

    bad = distinct.where("testable and not dropped").select("signal").limit(3).collect()
    if bad:
        raise ContractError(f"declared as restatements, but not: {[r[0] for r in bad]}")
    return distinct


def significance(scores: DataFrame, ranked: DataFrame, options: Options = Options(), reference: str | None = None) -> DataFrame:
    """Paired tests of all signals against the leader, Holm-adjusted over all and over the distinct ones."""
    leader = reference or ranked.where("rank = 1").select("signal").first()[0]
    tests = R.paired_auroc_diff(scores, leader, options.resamples, options.seed, level=options.level)
    place = ranked.select("signal", F.col("rank").alias("position"), *([F.col("dropped")] if "dropped" in ranked.columns else [F.lit(False).alias("dropped")]))
    rows = R.holm(tests.join(place, "signal"), name="p_holm", alpha=options.alpha)
    distinct = R.holm(rows.where("not dropped").select("signal", "p_value", "position"), name="p_holm_distinct", alpha=options.alpha)
    return rows.join(distinct.select("signal", "p_holm_distinct", "significant_p_holm_distinct"), "signal", "left").withColumn("reference", F.lit(leader))


def verdict(board: DataFrame, gap: float = 0.02) -> DataFrame:
    """Leader and runner-up, and whether the leader wins: intervals apart and a gap that matters."""
    w = Window.orderBy("rank")  # a row per signal
    nxt = board.withColumns({"runner_up": F.lead("signal").over(w), "next_auroc": F.lead("auroc").over(w), "next_high": F.lead("ci_high").over(w)}).where("rank = 1")
    apart = F.coalesce(F.col("ci_low") > F.col("next_high"), F.lit(False))
    wide = F.coalesce(F.col("auroc") - F.col("next_auroc") >= gap, F.lit(False))
    return nxt.select(F.col("signal").alias("leader"), "auroc", "runner_up", "next_auroc", apart.alias("intervals_disjoint"), wide.alias("gap_meaningful"), (apart & wide).alias("has_winner"))


def pareto(board: DataFrame) -> DataFrame:
    """Signals that no cheaper one matches (cost_multiplier, auroc)."""
    w = Window.orderBy("cost_multiplier", F.desc("auroc"), "signal").rowsBetween(Window.unboundedPreceding, -1)  # a row per signal
    return board.where("auroc is not null").withColumn("best_cheaper", F.max("auroc").over(w)).where("best_cheaper is null or auroc > best_cheaper").drop("best_cheaper")


def length_confound(scores: DataFrame, leader: str, length: str = "t_answer_length", question_length: str = "t_question_length", floor: float = 0.55) -> DataFrame:
    """Whether the leader still ranks within length strata, and its correlation with length."""
    wide = scores.where(F.col("signal").isin(leader, length, question_length)).groupBy("qid", "y").pivot("signal", sorted({leader, length, question_length})).agg(F.first("score"))
    strata = M.strata_auroc(wide.select("qid", "y", F.col(leader).alias("score"), F.col(length).alias("length")), [], "length")
    rho = M.spearman_matrix(scores.where(F.col("signal").isin(leader, length))).where("a <> b").agg(F.max("rho").alias("rho_with_length"))
    worst = strata.agg(F.min("auroc").alias("worst_stratum_auroc"), F.count_if(F.col("auroc").isNull()).alias("undefined_strata"))
    out = worst.crossJoin(F.broadcast(rho))  # one row each
    return out.select(F.lit(leader).alias("leader"), F.lit(leader == length).alias("leader_is_length"), "rho_with_length", "worst_stratum_auroc", F.coalesce((F.col("worst_stratum_auroc") > floor) & (F.col("undefined_strata") == 0), F.lit(False)).alias("survives"))


def partner(matrix: DataFrame, ranked: DataFrame, most: float = 0.999) -> DataFrame:
    """The best-ranked signal that is no monotone restatement of the leader, and who is skipped on the way."""
    leader = ranked.where("rank = 1").select(F.col("signal").alias("leader"))
    both = matrix.select("a", "b", "rho").unionByName(matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho")).distinct()
    rest = ranked.where("rank > 1").select("signal", "rank").crossJoin(F.broadcast(leader))  # one row
    told = rest.join(both, (F.col("leader") == F.col("a")) & (F.col("signal") == F.col("b")), "left").withColumn("redundant", F.coalesce(F.abs("rho") >= most, F.lit(False)))
    first = F.min(F.when(~F.col("redundant"), F.col("rank")))
    return told.groupBy("leader").agg(F.min_by("signal", F.when(~F.col("redundant"), F.col("rank"))).alias("partner"), first.alias("partner_rank"), F.count_if("redundant").alias("n_redundant"))


def logistic_cv(df: DataFrame, x: list[str], *, folds: int = 5, seed: int = 31337, steps: int = 25, tolerance: float = 1e-8, l2: float = 1e-3) -> DataFrame:
    """Out-of-fold scores of a logistic regression on standardized columns, fitted by Newton steps.

    All folds step together: a step is one aggregate of gradient and curvature
    per fold over rows that stay where they are, and some eight steps settle it.
    """
    from quillon.operators.datasets import stratified_folds

    spark = df.sparkSession
    base = checkpointed(stratified_folds(df.select("qid", "y", *x), folds, seed))
    copies = base.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    train = copies.where("fold <> held")
    stats = {r["held"]: r for r in train.groupBy("held").agg(F.count(F.lit(1)).alias("n"), *[a for c in x for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).collect()}
    weights = {h: np.zeros(len(x) + 1) for h in stats}
    shape = f"_h int, {', '.join(f'm{i} double, s{i} double, w{i + 1} double' for i in range(len(x)))}, w0 double"

    def placed(rows: DataFrame, held: str) -> DataFrame:
        """Each row with its terms z1.. and their sum v under the fold's weights; there is a row of these per fold."""
        told = [(h, *[float(v) for i, c in enumerate(x) for v in (s[f"m_{c}"], s[f"s_{c}"] or 1.0, weights[h][i + 1])], float(weights[h][0])) for h, s in stats.items()]
        both = rows.join(F.broadcast(spark.createDataFrame(told, shape)), F.col(held) == F.col("_h"))
        both = both.withColumns({f"z{i + 1}": (F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(x)})
        v = sum((F.col(f"z{i + 1}") * F.col(f"w{i + 1}") for i in range(len(x))), F.col("w0"))
        return both.withColumn("p", 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), v)))))

    terms = [F.lit(1.0), *[F.col(f"z{i + 1}") for i in range(len(x))]]
    k = len(terms)
    for _ in range(steps):
        e, curve = F.col("p") - F.col("y").cast("double"), F.col("p") * (1.0 - F.col("p"))
        sums = [F.sum(e * t).alias(f"g{i}") for i, t in enumerate(terms)] + [F.sum(curve * terms[i] * terms[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        largest = 0.0
        for r in placed(train, "held").groupBy("held").agg(*sums).collect():  # a row per fold
            n, w = stats[r["held"]]["n"], weights[r["held"]]
            gradient = np.array([r[f"g{i}"] / n for i in range(k)]) + l2 * w
            hessian = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] / n for j in range(k)] for i in range(k)]) + l2 * np.eye(k)
            step = np.linalg.solve(hessian, gradient)
            weights[r["held"]] = w - step
            largest = max(largest, float(np.abs(step).max()))
        if largest < tolerance:
            break
    return placed(base, "fold").select("qid", "y", "fold", F.col("p").alias("score"))


def combination(scores: DataFrame, first: str, second: str, *, gap: float = 0.02, **options) -> DataFrame:
    """Cross-validated AUROC of two signals together against the better of them on the same rows."""
    wide = M.rated(scores).where(F.col("signal").isin(first, second)).groupBy("qid", "y").pivot("signal", [first, second]).agg(F.first("score")).dropna()
    oof = logistic_cv(wide, [first, second], **options)
    single = M.auroc(wide.unpivot(["qid", "y"], [first, second], "signal", "score"), ["signal"]).agg(F.max("auroc").alias("best_single_auroc"), F.max_by("signal", "auroc").alias("best_single_name"))
    both = M.auroc(oof, []).select("n", F.col("n_pos").alias("n_incorrect"), F.col("auroc").alias("cross_validated_auroc")).crossJoin(F.broadcast(single))  # one row each
    better = F.col("cross_validated_auroc") - F.col("best_single_auroc")
    return both.withColumns({"improvement": better, "beats_best_single": better > gap})


def confidence_health(signals: DataFrame, column: str = "c_verbal_confidence", constant: float = 0.95) -> DataFrame:
    """Parse failures, spread and modal share of the confidence put into words, in its own units."""
    p = -F.col(column)
    value = F.bround(p, 4)
    modal = M.modal_share(signals, value)
    base = signals.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("n_parse_failures"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"))
    out = base.crossJoin(F.broadcast(modal))  # one row each
    return out.withColumns({"parse_failure_rate": F.try_divide("n_parse_failures", "n"), "effectively_constant": F.coalesce(F.col("modal_share") >= constant, F.lit(False))})


# Extra model calls per question by family; family B needs one call a sample.
EXTRA_CALLS = {"A": 0.0, "C": 1.0, "T": 0.0}


def cost_table(registry: DataFrame, n_samples: int, *, greedy_tokens: float | None = None, sample_tokens: float | None = None, generate_s: float | None = None, family_b_s: float | None = None) -> DataFrame:
    """Extra calls, tokens and seconds of each signal over the one greedy answer."""
    extra = F.when(F.col("family") == "B", F.lit(float(n_samples)))
    for family, calls in EXTRA_CALLS.items():
        extra = extra.when(F.col("family") == family, F.lit(calls))
    tokens = F.when(F.col("family") == "B", F.lit(n_samples * sample_tokens if sample_tokens is not None else None).cast("double")).when(F.col("family").isin("A", "T"), F.lit(0.0))
    seconds = F.lit(generate_s).cast("double") * extra + F.when(F.col("family") == "B", F.coalesce(F.lit(family_b_s).cast("double"), F.lit(0.0))).otherwise(0.0)
    base = F.lit(greedy_tokens).cast("double")
    return registry.select("signal", "family", (1.0 + extra).alias("cost_multiplier"), extra.alias("extra_model_calls"), tokens.alias("extra_tokens"), (1.0 + F.try_divide(tokens, base)).alias("token_multiplier"), seconds.alias("extra_seconds"))


def token_means(generations: DataFrame) -> DataFrame:
    """Mean prompt plus completion tokens of greedy answers and of samples; generations without counts do not count."""
    total = lambda g: g["prompt_tokens"] + g["completion_tokens"]
    kinds = F.explode(F.concat(F.array(F.struct(F.lit("greedy").alias("kind"), total(F.col("greedy")).alias("tokens"))), F.transform(F.coalesce("samples", F.array()), lambda s: F.struct(F.lit("sample").alias("kind"), total(s).alias("tokens")))))
    return generations.select(kinds.alias("k")).select("k.*").where("tokens is not null").groupBy("kind").agg(F.avg("tokens").alias("mean_tokens"), F.count(F.lit(1)).alias("n"))


def ablation(rows: DataFrame, levels: list[int], greedy: str = "greedy_norm", samples: str = "samples_norm") -> DataFrame:
    """Sample-set signals on the first N samples for every N: (level, qid, signal, score), oriented."""
    level = F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")
    first = rows.select("*", level).withColumn("_s", F.slice(samples, F.lit(1), F.col("level")))
    none = F.array().cast("array<int>")
    raw = {k: v for k, v in S.family_b(F.col(greedy), F.col("_s"), none, none).items() if "entropy" not in k}
    keep = [c for c in rows.columns if c not in (greedy, samples)]
    return first.select("level", *keep, *S.orient(raw)).unpivot(["level", *keep], list(raw), "signal", "score")


def ablation_differences(scores: DataFrame, levels: list[int], options: Options = Options()) -> DataFrame:
    """Paired tests of each level against the largest, and of neighbours, for each signal; Holm over all.

    All contrasts are taken from one table of draws (``resample.contrast_tests``).
    """
    levels = sorted(levels)
    names = [r[0] for r in scores.select("signal").distinct().orderBy("signal").collect()]  # a row per signal
    arm = lambda name, level: f"{name}@{level}"
    asked = {f"{name}:{low:06d}:{high:06d}": (name, low, high) for low, high in sorted({*zip(levels, levels[1:], strict=False), *((x, levels[-1]) for x in levels[:-1])}) for name in names}
    arms = scores.where(F.col("level").isin(levels)).withColumn("signal", F.concat_ws("@", "signal", "level"))
    tests = R.contrast_tests(arms, [(key, arm(name, low), arm(name, high)) for key, (name, low, high) in asked.items()], options.resamples, options.seed, level=options.level)
    part = F.split("contrast", ":")
    placed = tests.withColumns({"signal": part[0], "low": part[1].cast("int"), "high": part[2].cast("int"), "position": F.col("contrast")})
    return R.holm(placed.select("signal", "low", "high", "delta", "ci_low", "ci_high", "p_value", "n_paired", "position"), alpha=options.alpha).drop("position")


def agreement_with_main(top: DataFrame, main: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Largest difference between the full-sample ablation and the main pass, by signal."""
    both = top.alias("t").join(main.alias("m"), ["qid", "signal"]).select("signal", F.abs(F.col("t.score") - F.col("m.score")).alias("d"), (F.col("t.score").isNull() != F.col("m.score").isNull()).alias("odd"))
    return both.groupBy("signal").agg(F.max("d").alias("max_abs_diff"), F.count_if("odd").alias("n_one_sided")).withColumn("agrees", (F.coalesce("max_abs_diff", F.lit(0.0)) < tolerance) & (F.col("n_one_sided") == 0))


def batch_invariance(runs: DataFrame, key: str = "qid", width: str = "width") -> DataFrame:
    """Answers and first-token log-probabilities at each batch width against width 1 (or pass against pass)."""
    base = runs.where(F.col(width) == 1).select(key, F.col("text").alias("_text"), F.col("first_logprob").alias("_lp"))
    both = runs.where(F.col(width) != 1).join(base, key)
    return both.groupBy(width).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("text") != F.col("_text")).cast("double")).alias("text_mismatch_rate"), F.avg((T.normalize("text") != T.normalize("_text")).cast("double")).alias("answer_mismatch_rate"), F.max(F.abs(F.col("first_logprob") - F.col("_lp"))).alias("max_first_token_diff"))


def rule_decomposition(scores: DataFrame, label_sets: DataFrame) -> DataFrame:
    """AUROC of every signal under every label set (label_set, qid, label), with the rows each set decides."""
    y = label_sets.where(F.col("label").isin("correct", "incorrect")).select("label_set", "qid", (F.col("label") == "incorrect").alias("y"))
    return M.auroc(scores.select("qid", "signal", "score").join(y, "qid"), ["label_set", "signal"])


def power_block(label_sets: DataFrame, a: str, b: str) -> DataFrame:
    """Rows on which two label sets differ; none means that no comparison of them can show anything."""
    one = label_sets.where(F.col("label_set") == a).select("qid", F.col("label").alias("x"))
    two = label_sets.where(F.col("label_set") == b).select("qid", F.col("label").alias("z"))
    return one.join(two, "qid").agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("x") != F.col("z")).alias("n_differ")).withColumn("no_power", F.col("n_differ") == 0)


def length_audit(wide: DataFrame, signals: list[str], length: str, keys: list[str]) -> DataFrame:
    """Per signal: Spearman with y, the same given length, and AUROC within length strata."""
    scores = checkpointed(wide.unpivot([*keys, "qid", "y", length], signals, "signal", "score").withColumn("_y", F.col("y").cast("double")))
    by = [*keys, "signal"]
    ok = M.rated(scores)
    raw = M.midranks(M.midranks(ok, by, "score", "rx"), by, "_y", "ry").groupBy(*by).agg(M.pearson("rx", "ry").alias("rho"))
    part = M.partial_spearman(scores, by, "score", "_y", length)
    strata = M.strata_auroc(scores, by, length).groupBy(*by).pivot("length_stratum", ["at_or_below", "above"]).agg(F.first("auroc"))
    return raw.join(part, by, "left").join(strata, by, "left")
