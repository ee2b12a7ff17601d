"""Content-addressed responses as a partitioned table: bulk lookup of what is there, append of what was missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import read_checkpoint


def response_key(*parts: Column) -> Column:
    """SHA-256 over every field that may change a response."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"k{i:02d}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def judge_key(rubric: str, model: Column, qid: Column, answer: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.sha2(F.lit(rubric), 256), model, qid, answer), 256)


class ResponseTable:
    """(key, value) rows below a path, partitioned by the key's first two digits."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        found = read_checkpoint(self.spark, self.path)
        if found is None:
            return self.spark.createDataFrame([], "key string, value string")
        return found.select("key", "value").dropDuplicates(["key"])

    def lookup(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The wanted rows with their value, and those without."""
        have = self.read()
        return wanted.join(have, "key"), wanted.join(have, "key", "left_anti")

    def put(self, rows: DataFrame) -> None:
        fresh = rows.select("key", "value").dropDuplicates(["key"]).join(self.read().select("key"), "key", "left_anti")
        fresh.withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(self.path)
