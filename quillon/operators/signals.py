"""Signals: 27 scalar columns per answered question, and the catalog that registers them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.functions import text as T
from quillon.schema import ContractError, finite


@dataclass(frozen=True)
class Signal:
    name: str
    family: str
    orientation: str
    rank_equivalent_to: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Settings:
    """Knobs of the signal definitions."""

    length_penalty_alpha: float = 0.6
    perplexity_clamp: float = 20.0
    verbal_confidence_max: int = 100
    seed: int = 0


_CATALOG: dict[str, Signal] = {}


def register(signal: Signal) -> Signal:
    """Add a signal; a name is registered once."""
    if signal.name in _CATALOG:
        raise ContractError(f"{signal.name} is registered already")
    if signal.orientation not in ("risk", "confidence"):
        raise ContractError(f"{signal.orientation!r} is no orientation")
    _CATALOG[signal.name] = signal
    return signal


# The registered names, in registration order, with family and orientation.
for _name, _way, _twin, _what in [
    ("a_mean_logprob", "confidence", None, "mean token log-probability"),
    ("a_min_logprob", "confidence", None, "smallest token log-probability"),
    ("a_total_logprob", "confidence", None, "sum of token log-probabilities"),
    ("a_length_normalized_logprob", "confidence", None, "sum over a length penalty"),
    ("a_perplexity", "risk", "a_mean_logprob", "exponential of the mean, clamped"),
    ("a_first_token_logprob", "confidence", None, "log-probability of the first token"),
    ("a_mean_top5_entropy", "risk", None, "mean entropy of the alternatives"),
    ("a_max_top5_entropy", "risk", None, "largest entropy of the alternatives"),
    ("a_first_token_margin", "confidence", None, "first less second probability at the first token"),
    ("b_disagreement_rate", "risk", None, "share of samples that differ from the greedy answer"),
    ("b_distinct_count", "risk", None, "different answers, greedy included"),
    ("b_distinct_fraction", "risk", "b_distinct_count", "different answers per answer"),
    ("b_mean_pairwise_f1", "confidence", None, "mean token F1 of answer pairs"),
    ("b_semantic_entropy", "risk", None, "entropy over meaning clusters"),
    ("b_semantic_entropy_normalized", "risk", "b_semantic_entropy", "the same over its maximum"),
    ("b_disagreement_rate_samples_only", "risk", None, "share of samples outside the plurality"),
    ("b_distinct_count_samples_only", "risk", None, "different samples"),
    ("b_distinct_fraction_samples_only", "risk", "b_distinct_count_samples_only", "different samples per sample"),
    ("b_mean_pairwise_f1_samples_only", "confidence", None, "mean token F1 of sample pairs"),
    ("b_semantic_entropy_samples_only", "risk", None, "entropy over clusters of samples"),
    ("b_semantic_entropy_normalized_samples_only", "risk", "b_semantic_entropy_samples_only", "the same over its maximum"),
    ("c_p_true_plain", "confidence", None, "P(True) of the answer"),
    ("c_p_true_with_samples", "confidence", None, "P(True) with samples shown"),
    ("c_verbal_confidence", "confidence", None, "confidence put into words"),
    ("t_answer_length", "risk", None, "tokens of the answer"),
    ("t_question_length", "risk", None, "tokens of the question"),
    ("t_random", "risk", None, "a number that knows nothing"),
]:
    register(Signal(_name, _name[0].upper(), _way, _twin, _what))


def get_signal(name: str) -> Signal:
    if name not in _CATALOG:
        raise ContractError(f"{name!r} is not registered; known are {sorted(_CATALOG)}")
    return _CATALOG[name]


def catalog() -> list[Signal]:
    return list(_CATALOG.values())


def catalog_table(spark: SparkSession) -> DataFrame:
    rows = [(i, s.name, s.family, s.orientation, s.rank_equivalent_to, s.description) for i, s in enumerate(catalog())]
    return spark.createDataFrame(rows, "position int, signal string, family string, orientation string, rank_equivalent_to string, description string")


def family_a(tokens: Column, s: Settings = Settings()) -> dict[str, Column]:
    """Raw values from the answer tokens (array of token, logprob, top_logprobs); an empty span measures nothing."""
    lps = F.transform(tokens, lambda t: t["logprob"])
    n = F.size(lps)
    some = F.coalesce(n > 0, F.lit(False))
    total = N.total(lps)
    entropies = F.transform(tokens, lambda t: N.token_entropy(t["top_logprobs"]))
    first = F.get(tokens, F.lit(0))
    raw = {
        "a_mean_logprob": total / n,
        "a_min_logprob": F.array_min(lps),
        "a_total_logprob": total,
        "a_length_normalized_logprob": total / N.length_penalty(n, s.length_penalty_alpha),
        "a_perplexity": N.perplexity(total / n, s.perplexity_clamp),
        "a_first_token_logprob": F.get(lps, F.lit(0)),
        "a_mean_top5_entropy": N.total(entropies) / n,
        "a_max_top5_entropy": F.array_max(entropies),
        "a_first_token_margin": N.top_margin(first["top_logprobs"]),
    }
    return {k: F.when(some, v) for k, v in raw.items()}


def plurality_share(normalized: Column) -> Column:
    """Share of the most frequent element."""
    counts = F.transform(F.array_distinct(normalized), lambda u: F.size(F.filter(normalized, lambda v: v == u)))
    return F.array_max(counts) / F.size(normalized)


def _spread(all_: Column, sizes: Column, suffix: str) -> dict[str, Column]:
    n = F.size(all_)
    h = N.cluster_entropy(sizes)
    return {
        f"b_distinct_count{suffix}": T.count_distinct(all_).cast("double"),
        f"b_distinct_fraction{suffix}": T.count_distinct(all_) / n,
        f"b_mean_pairwise_f1{suffix}": T.mean_pairwise_f1(all_),
        f"b_semantic_entropy{suffix}": h,
        f"b_semantic_entropy_normalized{suffix}": F.when(n > 1, h / F.ln(n)),
    }


def family_b(greedy: Column, samples: Column, sizes: Column, sizes_samples: Column) -> dict[str, Column]:
    """Raw values from the normalized greedy answer and samples and from the cluster sizes of both sets."""
    some = F.coalesce(F.size(samples) > 0, F.lit(False))
    raw = {"b_disagreement_rate": F.size(F.filter(samples, lambda x: x != greedy)) / F.size(samples)}
    raw |= _spread(F.concat(F.array(greedy), samples), sizes, "")
    raw |= {"b_disagreement_rate_samples_only": 1.0 - plurality_share(samples)}
    raw |= _spread(samples, sizes_samples, "_samples_only")
    return {k: F.when(some, v) for k, v in raw.items()}


def family_c(plain: Column, with_samples: Column, verbal: Column) -> dict[str, Column]:
    return {"c_p_true_plain": plain["p_true"], "c_p_true_with_samples": with_samples["p_true"], "c_verbal_confidence": verbal}


def random_signal(qid: Column, seed: int, *, exact: bool = False) -> Column:
    """A number in [0, 1) from a hash of seed and id; ``exact`` seeds numpy's generator with the hash."""
    if not exact:
        return N.hash_share(F.lit(str(seed)), qid)

    @F.pandas_udf("double")
    def draw(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda x: float(np.random.default_rng(np.uint64(int(x))).random()), na_action="ignore")

    return draw(N.hash_u64(F.lit(str(seed)), qid).cast("string"))


def family_t(qid: Column, question: Column, answer: Column, s: Settings = Settings(), *, exact: bool = False) -> dict[str, Column]:
    length = lambda c: F.coalesce(F.size(T.tokens(c)), F.lit(0)).cast("double")
    return {"t_answer_length": length(answer), "t_question_length": length(question), "t_random": random_signal(qid, s.seed, exact=exact)}


def orient(raw: dict[str, Column]) -> list[Column]:
    """Registered values as they are exported: finite or null, higher meaning likelier wrong."""
    return [N.oriented(finite(v.cast("double")), get_signal(k).orientation).alias(k) for k, v in raw.items()]


def score_act(generations: DataFrame, settings: Settings = Settings(), *, exact: bool = False) -> DataFrame:
    """Families A, C and T in one narrow projection of the generations table."""
    raw = family_a(F.col("greedy.answer_token_logprobs"), settings)
    raw |= family_c(F.col("verify_plain"), F.col("verify_with_samples"), F.col("verbal_confidence"))
    raw |= family_t(F.col("qid"), F.col("question"), F.col("greedy_answer"), settings, exact=exact)
    return generations.select("qid", *orient(raw))


def assemble(qids: DataFrame, *parts: DataFrame) -> DataFrame:
    """All registered columns in catalog order; what no part holds is null, and so are rows a part lacks."""
    from quillon.schema import assert_unique

    out = assert_unique(qids.select("qid"), "qid")
    for part in parts:
        out = out.join(assert_unique(part, "qid"), "qid", "left")
    return out.select("qid", *[(F.col(s.name) if s.name in out.columns else F.lit(None)).cast("double").alias(s.name) for s in catalog()])


def assert_coverage(columns: list[str]) -> None:
    """Every scored column is registered and every registered signal is there."""
    names = {c for c in columns if c[:2] in ("a_", "b_", "c_", "t_")}
    if odd := sorted(names ^ set(_CATALOG)):
        raise ContractError(f"signals and catalog differ in {odd}")


def long_scores(wide: DataFrame, *, keep: list[str], signals: list[str] | None = None) -> DataFrame:
    """One row per (row, signal): the form that all metrics take."""
    names = signals or [s.name for s in catalog() if s.name in wide.columns]
    return wide.unpivot(keep, names, "signal", "score")


SignalFunction = Callable[[DataFrame], Column]


def add_signals(df: DataFrame, functions: dict[str, SignalFunction]) -> DataFrame:
    """Plug-in signals: registered names computed by functions of the table."""
    return df.select("*", *orient({k: f(df) for k, f in functions.items()}))
