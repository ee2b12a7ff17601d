"""Tables that a run reads and writes: question files, samples for people, results, timings, nested rows."""

import json

import pytest
from pyspark.sql import functions as F

from quillon import schema
from quillon.operators import datasets as D
from quillon.plans import compare as C
from quillon.sources import tables as T


def test_trivia_rows_keep_their_place(spark, tmp_path):
    answer = "struct<value: string, aliases: array<string>, normalized_aliases: array<string>>"
    rows = [("Q one?", "q1", ("Paris", ["paris ", "City of Light"], ["paris"])), ("Q two?", "q2", ("x", None, None)), ("again", "q1", ("Lyon", [], [])), (" ", "q3", ("y", [], []))]
    spark.createDataFrame(rows, f"question string, question_id string, answer {answer}").coalesce(1).write.parquet(str(tmp_path / "t"))
    raw = T.read_triviaqa(spark, str(tmp_path / "t"))
    assert [r["question_id"] for r in raw.orderBy("src_pos").collect()] == ["q1", "q2", "q1", "q3"]
    got = {r["qid"]: (r["question"], r["gold_answers"]) for r in D.triviaqa_questions(raw).collect()}
    assert got == {"triviaqa-q1": ("Q one?", ["Paris", "paris", "City of Light"]), "triviaqa-q2": ("Q two?", ["x"])}


def test_samples_for_people_come_back(spark, tmp_path):
    rows = [("b", 'say "x", then\nstop', ""), ("a", " plain ", None), ("c", "é;,", "correct")]
    T.write_csv(spark.createDataFrame(rows, "qid string, text string, human_label string"), str(tmp_path / "s"), "qid")
    got = T.read_validation_csv(spark, str(tmp_path / "s"), "qid", "human_label").collect()
    assert [(r["qid"], r["text"], r["human_label"]) for r in got] == [("a", " plain ", ""), ("b", 'say "x", then\nstop', ""), ("c", "é;,", "correct")]
    with pytest.raises(schema.ContractError):
        T.read_validation_csv(spark, str(tmp_path / "s"), "verdict")


def test_results_are_read_with_and_without_a_schema(spark, tmp_path):
    T.write_results(str(tmp_path / "r"), metrics=spark.createDataFrame([("a", 0.5), ("b", float("nan"))], "signal string, auroc double"))
    got = T.read_results(spark, str(tmp_path / "r")).select(F.explode("metrics").alias("m")).select("m.*").collect()
    assert {r["signal"]: r["auroc"] for r in got} == {"a": 0.5, "b": None}
    typed = T.read_results(spark, str(tmp_path / "r"), "metrics array<struct<signal: string, auroc: double>>, missing string").first()
    assert typed["missing"] is None and len(typed["metrics"]) == 2


def test_timings_keep_the_latest_of_each_stage(spark):
    old = spark.createDataFrame([("generate", 1.0), ("label", 2.0)], "stage string, seconds double")
    new = spark.createDataFrame([("label", 5.0), ("score", 3.0)], "stage string, seconds double")
    assert {r["stage"]: r["seconds"] for r in T.merge_timings(old, new).collect()} == {"generate": 1.0, "label": 5.0, "score": 3.0}
    assert T.merge_timings(None, new).count() == 2


def test_nested_rows_as_json_and_back(spark):
    token = {"token": "a", "logprob": -0.5, "top_logprobs": {"a": -0.5, "b": None}}
    made = {"text": "a", "answer_token_logprobs": [token], "is_greedy": True, "seed": 2**63 + 5, "temperature": 0.0, "prompt_tokens": 3, "completion_tokens": 1, "latency_s": None}
    df = spark.createDataFrame([("q", json.dumps(made), json.dumps([made, made]), json.dumps(["x"]))], "qid string, greedy string, samples string, gold_answers string")
    row = T.parse_generations(df).first()
    assert row["greedy"]["seed"] == 2**63 + 5 and row["greedy"]["answer_token_logprobs"][0]["top_logprobs"] == {"a": -0.5, "b": None}
    assert len(row["samples"]) == 2 and row["gold_answers"] == ["x"]
    again = json.loads(T.json_rows(T.parse_generations(df)).first()["value"])
    assert again["greedy"]["latency_s"] is None and again["greedy"]["text"] == "a"


def test_a_mix_of_sources(spark):
    shape = "id string, subj string, prop string, obj string, s_pop string, o_pop string, question string, possible_answers string"
    pop = spark.createDataFrame([(str(i), f"s{i}", "occupation", "o", str(i * 10), "1", f"What is {i}?", '["a", "b"]') for i in range(6)], shape)
    kind = "question string, question_id string, answer struct<value: string, aliases: array<string>, normalized_aliases: array<string>>, src_pos long"
    trivia = spark.createDataFrame([(f"Who is {i}?", f"t{i}", ("x", [], []), i) for i in range(5)], kind)
    got = D.build_mix({"popqa": pop, "triviaqa": trivia}, {"popqa": 4, "triviaqa": 2, "none": 0}, 3).collect()
    assert sorted(r["dataset"] for r in got) == ["popqa"] * 4 + ["triviaqa"] * 2
    with pytest.raises(schema.ContractError):
        D.build_mix({}, {"none": 2}, 3)
    with pytest.raises(schema.ContractError):
        D.build_mix({"popqa": pop}, {"popqa": 0}, 3)


def test_tension_band_and_panels(spark):
    board = spark.createDataFrame([("a", 1, 0.9, 0.8, 0.95), ("b", 2, 0.85, 0.7, 0.9), ("c", 3, 0.6, 0.5, 0.7), ("d", 4, None, None, None)], "signal string, rank int, auroc double, ci_low double, ci_high double")
    assert tuple(C.tension_band(board).first()) == (2, 4)
    assert [r["signal"] for r in C.figure_panels(board, 2).collect()] == ["a", "b"]
