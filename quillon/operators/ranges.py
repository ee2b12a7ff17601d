"""Order over the whole cluster: range partitions, row numbers and running sums without one task that sees all rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Where none is named, a session whose tasks all run in this machine (tests, a
    laptop) gets a fresh local folder; any other session is refused, as its
    executors would not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: any column type, partitions and their order stay as they are."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint()


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_sorted(df: DataFrame, order: list) -> DataFrame:
    """Range-partition and sort ``df``, then checkpoint it."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return checkpointed(df.repartitionByRange(partitions_for(df.sparkSession), *cols).sortWithinPartitions(*cols))


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add a 0-based row number over a global order without one task seeing all rows.

    Each range partition numbers its own rows; what is gathered is one count
    per partition, whatever the number of rows.
    """
    spark = df.sparkSession
    stored = range_sorted(df, order)
    counts = {r[0]: r[1] for r in stored.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    before, rows = 0, [(-1, 0)]
    for pid in sorted(counts):
        rows.append((pid, before))
        before += counts[pid]
    offsets = spark.createDataFrame(rows, "_pid int, _before long")  # a row per partition
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored.withColumns({"_pid": F.spark_partition_id(), "_inside": inside})
    return numbered.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_before") + F.col("_inside")).drop("_pid", "_before", "_inside")


def rank_within(df: DataFrame, group: Column, order: list, name: str = "rank") -> DataFrame:
    """Add a 0-based row number within groups, of which there are few: the global number less the group's first."""
    ranked = global_rank(df.withColumn("_group", group), ["_group", *order], "_at")
    first = ranked.groupBy("_group").agg(F.min("_at").alias("_first"))  # a row per group
    return ranked.join(first.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g"))).withColumn(name, F.col("_at") - F.col("_first")).drop("_group", "_g", "_at", "_first")


def _cells(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    return [pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in columns]


def _starts(gid: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])


def _edges(columns: list[str]):
    """Of a sorted partition: its first and last key, and the sums of the last key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        sums: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column("_gid").to_numpy()
            first = int(gid[0]) if first is None else first
            at = _starts(gid)[-1]
            fresh = [x[at:].sum() for x in _cells(batch, columns)]
            sums = [a + b for a, b in zip(sums, fresh, strict=True)] if at == 0 and gid[0] == last else fresh
            last = int(gid[-1])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([last]), *[pa.array([x]) for x in sums]], names=["part", "first", "last", *[f"s{i}" for i in range(len(sums))]])

    return run


def _inside(columns: list[str], names: list[str], before: dict[int, tuple[int, list]]):
    """Running sums of a sorted partition's rows, from what its first key has in earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carry = before.get(TaskContext.get().partitionId(), (None, []))
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column("_gid").to_numpy()
            at = _starts(gid)
            sizes = np.diff(np.r_[at, len(gid)])
            out = []
            for i, x in enumerate(_cells(batch, columns)):
                total = np.cumsum(x)
                base = np.r_[0, total[at[1:] - 1]]
                base[0] -= carry[i] if gid[0] == key else 0
                out.append(total - np.repeat(base, sizes))
            key, carry = int(gid[-1]), [x[-1] for x in out]
            kept = [i for i, n in enumerate(batch.schema.names) if n not in ("_gid", "_one")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[pa.array(x) for x in out]], names=[*[batch.schema.names[i] for i in kept], *names])

    return run


def running_sums(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add ``k``, the 1-based place of a row within its keys by a total order, and ``<column>_so_far``, the sum up to and with it (nulls add nothing).

    One shuffle: rows are range-partitioned and sorted, and a task sums them where
    they lie. Only the first key of a partition can have rows in an earlier one, so
    what is carried is one row per partition.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    typed = {c: F.col(c).cast("long" if df.schema[c].dataType.simpleString() in whole else "double") for c in columns}
    stored = range_sorted(df.withColumns({**typed, "_one": F.lit(1).cast("long"), "_gid": F.xxhash64(F.lit(0), *keys)}), [*keys, *order])
    sums = ["_one", *columns]
    kinds = [stored.schema[c].dataType.simpleString() for c in sums]
    told = stored.select("_gid", *sums).mapInArrow(_edges(sums), ", ".join(["part int, first long, last long", *[f"s{i} {k}" for i, k in enumerate(kinds)]])).collect()  # a row per partition
    before: dict[int, tuple[int, list]] = {}
    key, carry = None, [0] * len(sums)
    for r in sorted(told, key=lambda r: r["part"]):
        if r["first"] == key:
            before[r["part"]] = (key, carry)
        own = [r[f"s{i}"] for i in range(len(sums))]
        carry = [a + b for a, b in zip(carry, own, strict=True)] if r["last"] == key else own
        key = r["last"]
    names = ["k", *[f"{c}_so_far" for c in columns]]
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name not in ("_gid", "_one")], *[f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)]])
    return stored.mapInArrow(_inside(sums, names, before), shape)
