"""Table schemas and the contracts that tables must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "struct<token: string, logprob: double, top_logprobs: map<string, double>>"
GENERATION = (
    f"struct<text: string, answer_token_logprobs: array<{TOKEN}>, is_greedy: boolean, seed: decimal(20,0), temperature: double, "
    "prompt_tokens: int, completion_tokens: int, latency_s: double>"
)
VERIFICATION = "struct<p_true: double, true_token: string, false_token: string, raw_text: string, parse_failed: boolean>"
QUESTIONS = "qid string, dataset string, question string, gold_answers array<string>"
GENERATIONS = (
    f"{QUESTIONS}, greedy {GENERATION}, samples array<{GENERATION}>, greedy_text string, greedy_answer string, sample_answers array<string>, "
    f"verify_plain {VERIFICATION}, verify_with_samples {VERIFICATION}, verbal_confidence double, verbal_confidence_raw string, latency_s double"
)
LABELS = "qid string, label string, source string, judge_raw string, judge_primary_verdict string, judge_secondary_verdict string"
SCORES = "view string, stratum string, qid string, row_pos long, cluster_id long, signal string, score double, y boolean"
LABEL_VALUES = ("correct", "incorrect", "ambiguous", "abstain")
LABEL_SOURCES = ("exact_match", "judge_primary", "judge_secondary", "heuristic_fuzzy", "heuristic_unresolved", "human")


class ContractError(ValueError):
    """A table breaks a declared contract."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"missing columns {missing}; there are {df.columns}")
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raise if a key repeats. One aggregate; the rows stay where they are."""
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if again:
        raise ContractError(f"{keys} is not unique, e.g. {[tuple(r)[:-1] for r in again]}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join two tables that both have unique keys."""
    return assert_unique(left, key).join(assert_unique(right, key), key, how)


def finite(x: Column) -> Column:
    """The value, or null for NaN and infinities: null is the one encoding of "not measured"."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def usable(x: Column) -> Column:
    """True where a score is a finite number."""
    return F.coalesce(finite(x).isNotNull(), F.lit(False))


def assert_questions(df: DataFrame, normalized: Column) -> DataFrame:
    """Questions have text and answers, unique ids and unique normalized texts."""
    require_columns(df, "qid", "dataset", "question", "gold_answers")
    bad = df.where((F.trim("question") == "") | F.col("question").isNull() | (F.size("gold_answers") < 1)).limit(1).collect()
    if bad:
        raise ContractError(f"question {bad[0]['qid']!r} is blank or has no answers")
    assert_unique(df, "qid")
    assert_unique(df.select(normalized.alias("normalized_question")), "normalized_question")
    return df


def assert_subset(names: list[str], known: list[str], what: str) -> None:
    if unknown := sorted(set(names) - set(known)):
        raise ContractError(f"unknown {what} {unknown}; known are {sorted(known)}")
