"""Numeric functions as Spark expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions.bind import let


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def top_probs(logprobs: Column) -> Column:
    """Probabilities of a token's alternatives, renormalized, largest first."""

    def shares(raw: Column) -> Column:
        return let(total(raw), lambda z: F.sort_array(F.transform(raw, lambda x: x / z), asc=False))

    def scaled(values: Column) -> Column:
        return let(F.array_max(values), lambda top: let(F.transform(values, lambda x: F.exp(x - top)), shares))

    return let(F.map_values(logprobs), scaled)


def entropy(probs: Column) -> Column:
    """Shannon entropy in nats; 0 of nothing."""
    return F.aggregate(probs, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0)))


def token_entropy(logprobs: Column) -> Column:
    return F.when(F.coalesce(F.size(logprobs), F.lit(0)) < 1, F.lit(0.0)).otherwise(entropy(top_probs(logprobs)))


def top_margin(logprobs: Column) -> Column:
    """Largest probability less the second; null without alternatives."""
    gap = let(top_probs(logprobs), lambda p: F.get(p, F.lit(0)) - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)))
    return F.when(F.size(logprobs) > 0, gap)


def length_penalty(n: Column, alpha: float) -> Column:
    return F.pow((F.lit(5.0) + n) / F.lit(6.0), F.lit(float(alpha)))


def perplexity(mean_logprob: Column, clamp: float) -> Column:
    """exp(-mean), the exponent held at ``clamp``; null stays null."""
    return F.when(mean_logprob.isNotNull(), F.exp(F.least(-mean_logprob, F.lit(float(clamp)))))


def cluster_entropy(sizes: Column) -> Column:
    """Entropy of a partition by its cluster sizes; null without clusters."""
    n = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(sizes) > 0, let(n, lambda n: entropy(F.transform(sizes, lambda x: x / n))))


def p_true(true_logprob: Column, false_logprob: Column) -> Column:
    """Share of True among two log-probabilities, without overflow; null if either is missing."""
    top = F.greatest(true_logprob, false_logprob)
    t, f = F.exp(true_logprob - top), F.exp(false_logprob - top)
    return F.when(true_logprob.isNotNull() & false_logprob.isNotNull(), t / (t + f))


def z_value(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def hanley_mcneil(auc: Column, n_pos: Column, n_neg: Column, level: float = 0.95) -> Column:
    """struct<se, low, high>: analytic interval of an AUROC, the variance taken on the side above one half."""
    a = F.greatest(auc, 1.0 - auc)
    q1, q2 = a / (2.0 - a), 2.0 * a * a / (1.0 + a)
    var = F.try_divide(a * (1.0 - a) + (n_pos - 1.0) * (q1 - a * a) + (n_neg - 1.0) * (q2 - a * a), n_pos * n_neg * F.lit(1.0))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    half = z_value(level) * se
    return F.struct(se.alias("se"), (auc - half).alias("low"), (auc + half).alias("high"))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function; Spark has none."""
    return x.map(math.erfc, na_action="ignore")


def chance_p_value(auc: Column, se: Column, comparisons: int = 1) -> Column:
    """Two-sided p of an AUROC against one half, Bonferroni-corrected for ``comparisons``."""
    return F.least(F.lit(1.0), erfc(F.try_divide(F.abs(auc - 0.5), se) / math.sqrt(2)) * float(comparisons))


def wilson(k: Column, n: Column, level: float = 0.95) -> Column:
    """struct<low, high>: Wilson score interval, exactly 0 and 1 at the ends; null for n = 0."""
    z = z_value(level)
    p, d = F.try_divide(k * 1.0, n * 1.0), 1.0 + F.try_divide(F.lit(z * z), n * 1.0)
    mid = (p + F.try_divide(F.lit(z * z / 2), n * 1.0)) / d
    half = z * F.sqrt(F.try_divide(p * (1.0 - p), n * 1.0) + F.try_divide(F.lit(z * z / 4), n * n * 1.0)) / d
    low = F.when(k == 0, F.lit(0.0)).otherwise(mid - half)
    high = F.when(k == n, F.lit(1.0)).otherwise(mid + half)
    return F.struct(F.when(n > 0, low).alias("low"), F.when(n > 0, high).alias("high"))


def oracle_ceiling(error: Column, base_rate: Column) -> Column:
    """Best AUROC a perfect score can reach when labels are wrong at rate ``error``; null outside [0, 1]."""
    e, b = error * 1.0, base_rate * 1.0
    seen_pos, seen_neg = b * (1.0 - e) + (1.0 - b) * e, b * e + (1.0 - b) * (1.0 - e)
    hit, miss = F.try_divide(b * (1.0 - e), seen_pos), F.try_divide(b * e, seen_neg)
    return F.when((e >= 0) & (e <= 1) & (b > 0) & (b < 1), 0.5 + (hit - miss) / 2.0)


def oriented(x: Column, orientation: str) -> Column:
    """Higher means likelier wrong: confidences change sign."""
    return -x if orientation == "confidence" else x


def hash_u64(*parts: Column) -> Column:
    """First 64 bits of SHA-256 as an unsigned whole number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_share(*parts: Column) -> Column:
    """The same hash as a number in [0, 1): a sample that does not depend on row order."""
    return hash_u64(*parts).cast("double") / F.lit(18446744073709551616.0)


def hash_index(*parts: Column) -> Column:
    """A non-negative long from md5, equal in every SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")
