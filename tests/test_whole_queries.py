"""Registered queries over whole tables, against brute force."""

from collections import Counter

import pytest

from quillon.catalog import QUERIES, table
from quillon.catalog.ranking import SIGNALS, scores
from quillon.functions import text as T
from quillon.operators import resample as R

SF = "/root/testdata/sf0.001"


def holm(ps):
    """By key, from (key, p); keys may repeat with the same p."""
    top, out = 0.0, {}
    for i, (p, k) in enumerate(sorted((p, k) for k, p in ps)):
        if k in out:
            continue  # the first of equal p-values has the largest product
        top = max(top, (len(ps) - i) * p)
        out[k] = min(1.0, top)
    return out


def test_holm_of_all_lines(spark):
    lines = [tuple(r) for r in table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber").collect()]
    keys = [k * 10 + line for k, line in lines]
    want = holm([(k * 10 + line, (k + 7 * line) % 997 / 9970.0) for k, line in lines])
    rows = QUERIES["holm_adjust"](spark, SF).collect()
    got = {r["k"]: (r["p_holm"], r["significant"]) for r in rows}
    assert sorted(r["k"] for r in rows) == sorted(keys) and max(keys) > 400
    assert got == {k: (pytest.approx(v, abs=1e-8), v <= 0.05) for k, v in want.items()}


def test_holm_by_ranges(spark):
    ps = {i: (i * i % 211) ** 2 / 2e7 for i in range(400)}
    df = spark.createDataFrame([*ps.items(), (400, None)], "position int, p_value double")
    got = {r["position"]: r["p_holm"] for r in R.holm(df, spread=8).collect()}
    assert got == {k: pytest.approx(v) for k, v in holm(ps.items()).items()} | {400: None}


def test_all_unlabelled_and_shared_texts(spark):
    texts = {r[0]: r[1] for r in table(spark, SF, "documents").select("doc_id", T.normalize("text")).collect()}
    labelled = {r[0] for r in table(spark, SF, "labels").select("doc_id").collect()}
    assert sorted(r[0] for r in QUERIES["resume_antijoin"](spark, SF).collect()) == sorted(texts.keys() - labelled)
    other = {n for d, n in texts.items() if d not in labelled}
    assert sorted(r[0] for r in QUERIES["few_shot_disjoint"](spark, SF).collect()) == sorted(d for d, n in texts.items() if d in labelled and n in other and n is not None)


def test_points_of_all_signals(spark):
    rows = [r for r in scores(spark, SF).select("signal", "score", "y").collect() if r["score"] is not None and r["y"] is not None]
    want = {}
    for signal in SIGNALS:
        own = [(r["score"], r["y"]) for r in rows if r["signal"] == signal]
        pos = sum(y for _, y in own)
        for s in {s for s, _ in own}:
            above = Counter(y for x, y in own if x >= s)
            want[signal, round(s, 9)] = (pytest.approx(above[True] / above.total(), abs=1e-8), pytest.approx(above[True] / pos, abs=1e-8))
    got = QUERIES["precision_recall_points"](spark, SF).collect()
    assert {(r["signal"], r["score"]): (r["precision"], r["recall"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["few_shot_disjoint", "ambiguous_group_antijoin"])
def test_texts_are_normalized_once(spark, name):
    """What meets is a stored digest; texts neither meet nor are normalized again by the joins."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "text" not in plan
