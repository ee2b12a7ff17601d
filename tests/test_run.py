"""A configured run from question files to the tables of the analysis."""

import dataclasses

import numpy as np
import pytest

from quillon import schema
from quillon.operators import metrics as M
from quillon.operators import resample as R
from quillon.plans import run
from quillon.sources import config as C


def configured(**changes):
    model = C.Model(backend="local_transformers", name="m")
    made = C.Config(
        run_name="t", model_under_test=model, greedy=C.Greedy(), sampling=C.Sampling(), nli=C.NLI(), dataset_mix=C.Mix(popqa=3, triviaqa=2), pilot_gate=C.PilotGate(),
        judges=C.Judges(primary=dataclasses.replace(model, name="p"), secondary=dataclasses.replace(model, name="s")), split=C.Split(), analysis=C.Analysis(bootstrap_resamples=100),
        prompts=C.Prompts("s", "{question}", "{question}{answer}", "{question}{answer}{samples}", "{question}"),
    )
    return dataclasses.replace(made, **changes)


def test_questions_follow_the_configuration(spark):
    shape = "id string, subj string, prop string, obj string, s_pop string, o_pop string, question string, possible_answers string"
    pop = spark.createDataFrame([(str(i), f"s{i}", "occupation" if i % 2 else "author", "o", str(i), "1", f"What is number {i}?", '["a"]') for i in range(12)], shape)
    trivia = spark.createDataFrame([(f"Who is {i}?", f"t{i}", ("x", [], []), i) for i in range(5)], "question string, question_id string, answer struct<value: string, aliases: array<string>, normalized_aliases: array<string>>, src_pos long")
    raw = {"popqa": pop, "triviaqa": trivia}
    got = run.questions(configured(difficulty=C.Difficulty(popqa_relations=("occupation",), popqa_popularity_quantile=0.5)), raw).collect()
    assert sum(r["dataset"] == "triviaqa" for r in got) == 2
    assert sorted(r["qid"] for r in got if r["dataset"] == "popqa") == ["popqa-11", "popqa-7", "popqa-9"]
    shots = C.FewShot(enabled=True, pairs=(("what is number 7", "x"),))
    with pytest.raises(schema.ContractError):
        run.questions(configured(few_shot=shots, difficulty=C.Difficulty(popqa_relations=("occupation",), popqa_popularity_quantile=0.5)), raw)


def test_tables_of_a_run(spark):
    rng = np.random.default_rng(6)
    rows, labels, context = [], [], []
    for i in range(160):
        wrong = bool(rng.random() < 0.45)
        label = "abstain" if i % 17 == 0 else "ambiguous" if i % 23 == 0 else "incorrect" if wrong else "correct"
        rows.append((f"q{i:03d}", float(rng.normal() + wrong), float(rng.normal()), float(rng.random())))
        labels.append((f"q{i:03d}", label, "exact_match"))
        context.append((f"q{i:03d}", f"d{i % 2}"))
    signals = spark.createDataFrame(rows, "qid string, a_mean_logprob double, t_answer_length double, t_random double")
    config = configured()
    out = run.analyse(config, signals, spark.createDataFrame(labels, "qid string, label string, source string"), spark.createDataFrame(context, "qid string, dataset string"))
    assert set(out) == {"board", "verdict", "calibration", "significance", "by_dataset", "gates"}
    board = {(r["view"], r["signal"]): r for r in out["board"].collect()}
    assert len(board) == 6 and board["primary", "a_mean_logprob"]["rank"] == 1
    kept = [(r, lab) for r, lab in zip(rows, labels, strict=True) if lab[1] in ("correct", "incorrect")]
    score = spark.createDataFrame([(r[0], "a_mean_logprob", r[1], lab[1] == "incorrect") for r, lab in kept], "qid string, signal string, score double, y boolean")
    one, ends = M.auroc(score, ["signal"]).first(), R.bootstrap_auroc(score, 100, config.analysis.bootstrap_seed).first()
    got = board["primary", "a_mean_logprob"]
    assert (got["auroc"], got["n"], got["ci_low"], got["ci_high"]) == pytest.approx((one["auroc"], len(kept), ends["ci_low"], ends["ci_high"]))
    assert got["ap_low"] < got["average_precision"] < got["ap_high"] and got["analytic_low"] < got["auroc"]
    tests = out["significance"].collect()
    assert len(tests) == 4 and all(r["p_holm"] >= r["p_value"] for r in tests)
    gates = {(r["view"], r["name"]): r["passed"] for r in out["gates"].collect()}
    assert len(gates) == 12 and gates["primary", "minimum_rows_per_class"] and not gates["primary", "human_label_coverage"]
    assert {(r["view"], r["dataset"]) for r in out["by_dataset"].collect()} == {(v, d) for v in run.VIEWS for d in ("d0", "d1")}
