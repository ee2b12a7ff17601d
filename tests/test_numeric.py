import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import numeric as N
from quillon.operators import signals as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def probs(*p):
    return F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(len(p))]), F.array(*[F.lit(math.log(x)) for x in p]))


def test_entropy_and_margin(spark):
    assert one(spark, N.token_entropy(probs(0.7, 0.2, 0.1))) == pytest.approx(0.8018185525, abs=1e-9)
    assert one(spark, N.token_entropy(probs(0.35, 0.1, 0.05))) == pytest.approx(0.8018185525, abs=1e-9)
    assert one(spark, N.token_entropy(probs(*[0.25] * 4))) == pytest.approx(math.log(4))
    assert one(spark, N.top_margin(probs(0.7, 0.2, 0.1))) == pytest.approx(0.5)
    assert one(spark, N.top_margin(probs(1.0))) == pytest.approx(1.0)
    empty = F.expr("cast(map() as map<string, double>)")
    assert one(spark, N.token_entropy(empty)) == 0.0
    assert one(spark, N.top_margin(empty)) is None


def test_family_a(spark):
    tokens = F.array(*[F.struct(F.lit(str(x)).alias("token"), F.lit(x).alias("logprob"), probs(0.7, 0.3).alias("top_logprobs")) for x in (-0.1, -0.9, -2.0)])
    raw = S.family_a(tokens)
    row = spark.range(1).select(*[v.alias(k) for k, v in raw.items()]).first()
    assert row["a_total_logprob"] == pytest.approx(-3) and row["a_mean_logprob"] == pytest.approx(-1) and row["a_min_logprob"] == -2
    assert row["a_perplexity"] == pytest.approx(math.e)
    assert row["a_length_normalized_logprob"] == pytest.approx(-3 / (8 / 6) ** 0.6)
    out = spark.range(1).select(*S.orient(raw)).first()
    assert out["a_total_logprob"] == pytest.approx(3) and out["a_perplexity"] == pytest.approx(math.e)


def test_empty_span_measures_nothing(spark):
    none = F.expr("cast(array() as array<struct<token:string,logprob:double,top_logprobs:map<string,double>>>)")
    assert set(spark.range(1).select(*S.orient(S.family_a(none))).first()) == {None}


def test_perplexity_is_clamped(spark):
    assert one(spark, N.perplexity(F.lit(-800.0), 20.0)) == pytest.approx(math.exp(20))
    assert one(spark, N.perplexity(F.lit(None).cast("double"), 20.0)) is None


def test_cluster_entropy(spark):
    sizes = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, N.cluster_entropy(sizes(4, 2))) == pytest.approx(0.6365141683)
    assert one(spark, N.cluster_entropy(sizes(3, 2, 1))) == pytest.approx(1.0114042647)
    assert one(spark, N.cluster_entropy(F.expr("cast(array() as array<int>)"))) is None


def test_p_true(spark):
    assert one(spark, N.p_true(F.lit(-1.0), F.lit(-2.0))) == pytest.approx(0.7310585786)
    assert one(spark, N.p_true(F.lit(-700.0), F.lit(-700.0))) == pytest.approx(0.5)
    assert one(spark, N.p_true(F.lit(None).cast("double"), F.lit(-1.0))) is None


def test_wilson(spark):
    w = one(spark, N.wilson(F.lit(0), F.lit(10)))
    assert w["low"] == 0.0 and 0.2 < w["high"] < 0.35
    assert one(spark, N.wilson(F.lit(10), F.lit(10)))["high"] == 1.0
    assert one(spark, N.wilson(F.lit(0), F.lit(0)))["low"] is None


@pytest.mark.parametrize("e,b,want", [(0.0, 0.5, 1.0), (0.5, 0.5, 0.5), (0.1, 0.5, 0.9), (1.5, 0.5, None)])
def test_oracle_ceiling(spark, e, b, want):
    got = one(spark, N.oracle_ceiling(F.lit(e), F.lit(b)))
    assert got == (pytest.approx(want) if want is not None else None)


def test_hanley_mcneil_mirrors(spark):
    up, down = (one(spark, N.hanley_mcneil(F.lit(a), F.lit(36), F.lit(54))) for a in (0.63, 0.37))
    assert up["low"] == pytest.approx(1 - down["high"]) and up["high"] == pytest.approx(1 - down["low"])


def test_erfc_and_hash(spark):
    assert one(spark, N.erfc(F.lit(0.5))) == pytest.approx(math.erfc(0.5))
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7:q1").digest()[:8], "big")
    assert int(one(spark, N.hash_u64(F.lit("7"), F.lit("q1")))) == want
    assert one(spark, S.random_signal(F.lit("q1"), 7, exact=True)) == np.random.default_rng(np.uint64(want)).random()


def test_orientation_table():
    want_confidence = {"a_mean_logprob", "a_min_logprob", "a_total_logprob", "a_length_normalized_logprob", "a_first_token_logprob", "a_first_token_margin", "b_mean_pairwise_f1", "b_mean_pairwise_f1_samples_only", "c_p_true_plain", "c_p_true_with_samples", "c_verbal_confidence"}
    assert {s.name for s in S.catalog() if s.orientation == "confidence"} == want_confidence
    assert len(S.catalog()) == 27
    with pytest.raises(ValueError):
        S.get_signal("nope")
