"""Batch logs, stored responses, row-set trees and exact sums."""

import gzip
import hashlib
import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import merkle
from quillon.operators.exact import exact_sums
from quillon.sources import delta, responses
from quillon.sources import tables as T


def total(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def bytes_below(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_log_of_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "FAN_IN", 3)
    log = delta.DeltaLog(spark, str(tmp_path / "log"), total)
    assert log.read() is None and log.last() == -1
    batch = lambda i: spark.createDataFrame([(f"k{i % 4}", i), ("all", 1)], "k string, n long").coalesce(1)
    for i in range(14):
        assert log.append(batch(i), i)
        assert not log.append(batch(i), i)  # delivered again
    assert log.segments() == [(0, 8), (9, 11), (12, 12), (13, 13)]
    want = {"all": 14} | {f"k{j}": sum(i for i in range(14) if i % 4 == j) for j in range(4)}
    assert {r["k"]: r["n"] for r in log.read().collect()} == want
    # a merge that died before it deleted what it took in
    part = tmp_path / "log" / "9-9"
    batch(9).write.parquet(str(part))
    assert log.segments()[1] == (9, 11) and {r["k"]: r["n"] for r in log.read().collect()} == want
    batch(1).write.parquet(str(tmp_path / "log" / "11-12"))
    with pytest.raises(delta.CorruptLog):
        log.read()


def test_a_batch_writes_its_own_rows_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "FAN_IN", 99)
    log = delta.DeltaLog(spark, str(tmp_path / "log"), total)
    log.append(spark.range(20000).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("n")), 0)
    before = bytes_below(tmp_path)
    log.append(spark.createDataFrame([("x", 1)], "k string, n long").coalesce(1), 1)
    assert bytes_below(tmp_path) - before < 5000 < before


def test_what_cannot_be_read_raises(spark, tmp_path):
    log = delta.DeltaLog(spark, str(tmp_path / "log"), total)
    log.append(spark.createDataFrame([("x", 1)], "k string, n long").coalesce(1), 0)
    for p in (tmp_path / "log" / "0-0").glob("part-*"):
        p.write_bytes(b"no parquet")
    with pytest.raises(Exception, match="cannot be read|Parquet|FAILED_READ_FILE|CANNOT_READ_FILE"):
        log.read().collect()
    stage = tmp_path / "stage"
    T.append_checkpoint(spark.createDataFrame([("a",)], "qid string").coalesce(1), str(stage))
    for p in stage.glob("part-*"):
        p.write_bytes(b"no parquet")
    with pytest.raises(Exception, match="Parquet|FAILED_READ_FILE|CANNOT_READ_FILE|cannot be read|read"):
        T.append_checkpoint(spark.createDataFrame([("b",)], "qid string"), str(stage))


def test_stored_responses(spark, tmp_path):
    root = tmp_path / "cache"
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(12)]
    for i, key in enumerate(keys):
        place = root / key[:2] / key[2:4]
        place.mkdir(parents=True, exist_ok=True)
        raw = gzip.compress(json.dumps({"_v": 2 if i == 3 else 1, "text": f"é{i}"}).encode())
        (place / f"{key}.json.gz").write_bytes(b"junk" if i == 1 else raw[:-9] if i == 2 else gzip.compress(b"[1]") if i == 4 else raw)
    (root / keys[0][:2] / "note.txt").write_text("no entry")
    got = {r["key"]: json.loads(r["entry"]) for r in responses.read_responses(spark, str(root)).collect()}
    assert got == {k: {"text": f"é{i}"} for i, k in enumerate(keys) if i not in (1, 2, 3, 4)}
    asked = [keys[0], keys[2], "0" * 64]
    some = responses.read_responses(spark, str(root), asked)
    assert [r["key"] for r in some.collect()] == [keys[0]]
    assert some.rdd.getNumPartitions() <= 3
    wanted = spark.createDataFrame([(k,) for k in [*keys, "0" * 64]], "key string")
    assert tuple(responses.cache_counts(responses.read_responses(spark, str(root), misses=True), wanted).first()) == (8, 5)
    assert responses.read_responses(spark, str(tmp_path / "none")).collect() == []


def test_responses_are_written_once(spark, tmp_path):
    root = str(tmp_path / "cache")
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), json.dumps({"n": i})) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, entry string")
    assert all(r["added"] for r in responses.write_responses(df, root).collect())
    again = spark.createDataFrame([(k, json.dumps({"n": -1})) for k, _ in rows], "key string, entry string")
    assert not any(r["added"] for r in responses.write_responses(again, root).collect())
    assert {r["key"]: json.loads(r["entry"]) for r in responses.read_responses(spark, root).collect()} == {k: json.loads(e) for k, e in rows}
    assert not list(Path(root).rglob("*.staged"))


def ids(spark, some):
    return spark.createDataFrame([(str(i),) for i in some], "qid string")


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_trees(spark, depth):
    a = ids(spark, [*range(300), 7])
    same = merkle.root(a.repartition(9), depth=depth).first()
    assert same == merkle.root(a.orderBy(F.desc("qid")), depth=depth).first() and same["n"] == 301
    b = ids(spark, [*range(5, 300), 7, 1000])
    assert merkle.root(b, depth=depth).first()["digest"] != same["digest"]
    got = {r["qid"]: (r["in_a"], r["in_b"]) for r in merkle.difference(a, b, depth=depth).collect()}
    assert got == {**{str(i): (1, 0) for i in range(5)}, "1000": (0, 1)}
    assert merkle.difference(a, a, depth=depth).collect() == []
    assert merkle.root(ids(spark, []), depth=depth).first()["n"] == 0
    assert {r["qid"] for r in merkle.difference(ids(spark, []), ids(spark, [1]), depth=depth).collect()} == {"1"}
    told = merkle.verify(merkle.proofs(merkle.tree(a, depth=depth), ids(spark, [3, 250]))).collect()
    assert len(told) == 2 and {r["root"] for r in told} == {same["digest"]} and all(len(r["siblings"]) == depth for r in told)


def test_only_differing_leaves_are_looked_into(spark):
    a, b = ids(spark, range(2000)), ids(spark, [i for i in range(2000) if i != 77])
    leaves = merkle.differing_leaves(merkle.tree(a, depth=2), merkle.tree(b, depth=2)).collect()
    assert [r["path"] for r in leaves] == [hashlib.sha256(b"77").hexdigest()[:2]]


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_sums(spark, parts):
    rng = random.Random(1)
    rows = [("mixed", rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30)) for _ in range(2000)]
    rows += [("cancel", x) for x in (1e308, 1e-320, -1e308, 5e-324, 1.0, -1.0)] + [("tenths", 0.1)] * 10 + [("big", 1.7e308)] * 3 + [("none", None), ("none", float("nan")), ("none", float("inf")), (None, 2.5)]
    rng.shuffle(rows)
    got = {r["k"]: (r["n"], r["total"]) for r in exact_sums(spark.createDataFrame(rows, "k string, x double").repartition(parts), ["k"], "x").collect()}
    by = lambda k: [x for j, x in rows if j == k and x is not None and math.isfinite(x)]
    assert got == {k: (len(by(k)), math.fsum(by(k)) if k != "big" else math.inf) for k in ("mixed", "cancel", "tenths", "none", None, "big")}
