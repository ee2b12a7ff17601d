import json

import pytest
from pyspark.sql import functions as F

from quillon import inference
from quillon.operators import metrics as M
from quillon.plans import compare as C
from quillon.plans import gates as G
from quillon.plans import leaderboard as L
from quillon.sources import config
from quillon.sources import tables as T
from quillon.sources.cache import ResponseTable, response_key
from quillon.streaming import incremental as I


def test_text_table(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('id\tsubj\tprop\tobj\ts_pop\to_pop\tquestion\tpossible_answers\n1\ta\tb\tc\t\t5\tq?\t"[""x"", ""y""]"\n')
    row = T.read_popqa(spark, str(tmp_path / "p.tsv")).first()
    assert row["s_pop"] == "" and json.loads(row["possible_answers"]) == ["x", "y"]


def test_checkpoints(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    assert T.read_checkpoint(spark, path) is None
    T.write_checkpoint(spark.range(3), path)
    T.write_checkpoint(spark.range(5), path)
    assert T.read_checkpoint(spark, path).count() == 5
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "qid string, v int")
    T.append_checkpoint(rows, str(tmp_path / "d"))
    assert T.append_checkpoint(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), str(tmp_path / "d")).count() == 3


def test_results_are_json_safe(spark, tmp_path):
    df = spark.createDataFrame([("s", float("nan"), 1.0)], "signal string, auroc double, x double")
    assert json.loads(T.results_json(board=df)) == {"board": [{"signal": "s", "auroc": None, "x": 1.0}]}


def test_response_table(spark, tmp_path):
    table = ResponseTable(spark, str(tmp_path / "cache"))
    prompts = spark.createDataFrame([("hi", 1), ("ho", 2)], "prompt string, seed int").withColumn("key", response_key(F.col("prompt"), F.col("seed")))
    make = lambda: inference.Scripted({"hi": "there"})
    out = {r["value"] for r in inference.complete_cached(prompts, table, make, name="t1").collect()}
    assert out == {"there", "UNKNOWN"}
    have, missing = table.lookup(prompts)
    assert have.count() == 2 and missing.count() == 0


def test_config_checks():
    with pytest.raises(config.ConfigError):
        config.Greedy(temperature=0.5)
    with pytest.raises(config.ConfigError):
        config.Sampling(n_samples=3)
    with pytest.raises(config.ConfigError):
        config.Split(train_fraction=0.9)
    with pytest.raises(config.ConfigError):
        config._made(config.Mix, {"popqa": 1, "odd": 2}, "mix")
    with pytest.raises(config.ConfigError):
        config.Model("openai_compatible", "m", generation_batch_size=4)


def labelled(spark):
    rows = [(f"q{i}", ["correct", "incorrect", "ambiguous", "abstain"][i % 4], "exact_match", "ab"[i % 2], float(i)) for i in range(16)]
    return spark.createDataFrame(rows, "qid string, label string, source string, dataset string, a_mean_logprob double")


def test_views(spark):
    v = L.views(labelled(spark))
    got = {(r["view"], r["y"]): r["n"] for r in v.groupBy("view", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("primary", False): 4, ("primary", True): 4, ("with_abstentions", False): 8, ("with_abstentions", True): 4}
    positive = L.views(labelled(spark), "positive").where("view = 'with_abstentions' and y").count()
    assert positive == 8
    scores = L.long_form(v, ["a_mean_logprob"])
    assert M.auroc(scores, ["view", "signal"]).count() == 2


def test_gates(spark):
    v = L.views(labelled(spark)).where("view = 'primary'")
    none = spark.createDataFrame([], "signal string, auroc double, ci_low double, ci_high double")
    gates = G.evaluate(v, labelled(spark), none)
    assert gates.count() == 6 and not any(r["passed"] for r in gates.collect())
    assert not G.summary(gates).first()["ranking_publishable"]
    ok = spark.createDataFrame([("t_random", 0.5, 0.4, 0.6)], none.schema)
    assert G.random_baseline(ok).first()["passed"]
    assert G.pilot_gate(labelled(spark)).first()["in_band"]


def test_compare_and_verdict(spark):
    kind = "signal string, auroc double, ci_low double, ci_high double"
    a = spark.createDataFrame([("x", 0.8, 0.7, 0.9), ("y", 0.6, 0.5, 0.7)], kind)
    b = spark.createDataFrame([("x", 0.8, 0.7, 0.9), ("z", 0.6, 0.5, 0.7)], kind)
    rows = {r["signal"]: r for r in C.compare_signals(a, b).collect()}
    assert rows["x"]["identical"] and not rows["y"]["in_right"] and rows["z"]["delta"] is None
    assert tuple(C.count_differences(C.compare_signals(a, b)).first()) == (3, 2, 2)
    board = a.withColumn("rank", F.when(F.col("signal") == "x", 1).otherwise(2))
    assert not L.verdict(board).first()["has_winner"]


def test_breaker(spark):
    rows = spark.createDataFrame([("j", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0])], "judge string, at int, failed int").withColumn("failed", F.col("failed") == 1)
    assert C.consecutive_failures(rows, "at", 3).first()["stopped_at"] == 5


def test_stream_windows_and_histogram(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    ev = [(i, t0 + dt.timedelta(minutes=i), "a", 1.0) for i in range(30)]
    df = spark.createDataFrame([*ev, ev[0]], "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "ev"))
    q = I.window_counts(I.event_stream(spark, str(tmp_path / "ev"), df.schema), late="1 minute").writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("w").collect()
    assert got and all(r["n"] == 5 for r in got)
    rows = [(f"q{i}", "s", float(i % 5), i % 2 == 0) for i in range(20)]
    kind = "qid string, signal string, score double, y boolean"
    for part in range(2):
        spark.createDataFrame(rows[part::2], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "sc"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sc"))
    I.incremental_leaderboard(stream, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    want = M.auroc(spark.createDataFrame(rows, kind), ["signal"]).first()
    assert I.leaderboard(spark, str(tmp_path / "state")).first()["auroc"] == pytest.approx(want["auroc"])


def test_logistic_and_partner(spark):
    rows = [(f"q{i}", i % 3 == 0, float(i % 3 == 0) + (i % 7) / 10, float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "qid string, y boolean, a double, b double")
    assert M.auroc(L.logistic_cv(df, ["a", "b"], folds=3, steps=5), []).first()["auroc"] > 0.9


def test_checkpoint_survives_a_crash_between_renames(spark, tmp_path):
    import shutil

    path = str(tmp_path / "stage")
    T.write_checkpoint(spark.range(3), path)
    shutil.move(path, path + ".old")  # the writer died after the first rename
    assert T.read_checkpoint(spark, path).count() == 3
    shutil.move(path, path + ".old")
    T.write_checkpoint(spark.range(5), path)
    assert T.read_checkpoint(spark, path).count() == 5 and not (tmp_path / "stage.old").exists()
    for f in (tmp_path / "stage").glob("*.parquet"):
        f.write_bytes(b"PAR1 broken")
    for f in (tmp_path / "stage").glob(".*.crc"):
        f.unlink()
    assert T.read_checkpoint(spark, path) is None
    with pytest.raises(Exception):
        T.read_checkpoint(spark, path, strict=True)
