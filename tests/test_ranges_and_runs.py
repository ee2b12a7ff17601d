"""Running sums and runs over range partitions and streams, against plain loops."""

import random

import pytest

from quillon.operators.ranges import running_sums
from quillon.operators.runs import first_stops, stops_of_stream


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_running_sums(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, "c"]), i, rng.choice([None, 1, 2, 3]), rng.random()) for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["i"]: r for r in running_sums(spark.createDataFrame(rows, "key string, i long, whole int, part double").repartition(3), ["key"], ["i"], ["whole", "part"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 500
    for key in {r[0] for r in rows}:
        k = whole = part = 0
        for r in sorted(x for x in rows if x[0] == key) if key else [x for x in rows if x[0] is None]:
            k, whole, part = k + 1, whole + (r[2] or 0), part + r[3]
            assert (got[r[1]]["k"], got[r[1]]["whole_so_far"]) == (k, whole) and got[r[1]]["part_so_far"] == pytest.approx(part)
    assert running_sums(spark.createDataFrame([], "key string, i long, whole int"), ["key"], ["i"], ["whole"]).collect() == []


def plain(rows, most):
    out = {}
    for judge in {r[0] for r in rows}:
        run = 0
        for _, at, failed in sorted((r for r in rows if r[0] == judge), key=lambda r: r[1]):
            run = run + 1 if failed else 0
            if run >= most and judge not in out:
                out[judge] = at
    return out


def calls(seed, n=600):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "x", "y"]), i, rng.choice([True, True, False, None])) for i in range(n)]
    return rows + [("never", n + i, False) for i in range(5)] + [("always", 2 * n + i, True) for i in range(40)] + [("one", 3 * n, True)]


@pytest.mark.parametrize("most", [1, 2, 7, 25])
@pytest.mark.parametrize("parts", [1, 16])
def test_first_stops(spark, most, parts):
    rows = calls(most)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["judge"]: r["stopped_at"] for r in first_stops(spark.createDataFrame(rows, "judge string, at long, failed boolean").repartition(5), "at", most).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain(rows, most)


def test_stops_of_a_stream_that_restarts(spark, tmp_path):
    rows = calls(9, 90)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shape = "judge string, at long, failed boolean"
    for i in range(3):
        spark.createDataFrame(rows[i * 50 : (i + 1) * 50 if i < 2 else None], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        q = stops_of_stream(stream, "at", 4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r["judge"], r["stopped_at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(plain(rows, 4).items())
