"""What several operators share: scratch tables in the cluster's shared folder, global ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.ranges import checkpointed, global_rank, partitions_for, range_sorted, scratch_root

__all__ = ["checkpointed", "drop_materialized", "global_rank", "materialize", "partitions_for", "range_sorted", "scratch_path", "scratch_root"]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut at a table that outlives any executor, and the plan
    that follows sees the table's true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a scratch table that no later plan reads."""
    spark = df.sparkSession
    root = f"{scratch_root(spark)}/quillon/".split("://")[-1]
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if root in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
