"""Readers and writers of the tables that a run is made of."""

from __future__ import annotations

import json
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import schema
from quillon.schema import require_columns


def read_text_table(spark: SparkSession, path: str, columns: list[str], *, sep: str = "\t") -> DataFrame:
    """A delimited file with a header, every column text; an empty field is an empty text, doubled quotes are quotes."""
    df = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path)
    return require_columns(df, *columns).na.fill("")


def read_popqa(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path, ["id", "subj", "prop", "obj", "s_pop", "o_pop", "question", "possible_answers"])


def read_triviaqa(spark: SparkSession, path: str) -> DataFrame:
    """Question, id and answer struct, and where each row stands in the source."""
    kind = "question string, question_id string, answer struct<value: string, aliases: array<string>, normalized_aliases: array<string>>"
    df = spark.read.schema(kind).parquet(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return df.select("question", "question_id", "answer", at.alias("src_pos"))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_checkpoint(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame | None:
    """A stored stage, or None if it is missing or empty; an unreadable one is None too, or raises with ``strict``.

    A writer that died between its two renames left the stage beside its place:
    it is put back first.
    """
    p, fs = _path(spark, path)
    if not fs.exists(p):
        old, _ = _path(spark, path.rstrip("/") + ".old")
        if not fs.exists(old) or not fs.rename(old, p):
            return None
    try:
        df = spark.read.parquet(path)
        return None if df.isEmpty() else df
    except Exception as e:  # a truncated footer surfaces as a job failure
        if not strict and (isinstance(e, AnalysisException) or "parquet" in str(e).lower()):
            return None
        raise


def write_checkpoint(df: DataFrame, path: str) -> None:
    """Replace a stage by writing beside it and renaming: the stage is at its place or, for a moment, beside it as ``.old``, never in part.

    What an earlier writer left beside its place is put back before.
    """
    spark = df.sparkSession
    target, fs = _path(spark, path)
    staged, _ = _path(spark, path.rstrip("/") + ".staged")
    old, _ = _path(spark, path.rstrip("/") + ".old")
    df.write.mode("overwrite").parquet(staged.toString())
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {target} to {old}")
    if not fs.rename(staged, target):
        raise OSError(f"cannot move {staged} to {target}")
    fs.delete(old, True)


def append_checkpoint(df: DataFrame, path: str, key: str = "qid") -> DataFrame:
    """Add the rows whose key is not stored yet; a repeated run adds nothing, a stage that cannot be read raises."""
    spark = df.sparkSession
    done = read_checkpoint(spark, path, strict=True)
    fresh = df if done is None else df.join(done.select(key), key, "left_anti")
    fresh.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def read_validation_csv(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return require_columns(df, *columns).na.fill("")


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """One ordered file for people to fill in: labelling samples hold hundreds of rows."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_results(spark: SparkSession, path: str, kind: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(kind) if kind is not None else reader).json(path)


def json_safe(value):
    """Nested results with NaN and infinities as null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    return value


def results_json(**tables: DataFrame) -> str:
    """A results document of small result tables, keys sorted."""
    body = {name: [json_safe(r.asDict(True)) for r in df.collect()] for name, df in tables.items()}  # a row per signal or gate
    return json.dumps(body, sort_keys=True, allow_nan=False, default=str)


def write_results(path: str, **tables: DataFrame) -> None:
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(results_json(**tables),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Every row as JSON, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def parse_generations(df: DataFrame) -> DataFrame:
    """Nested columns of a generations table stored as JSON texts."""
    kinds = {"greedy": schema.GENERATION, "samples": f"array<{schema.GENERATION}>", "verify_plain": schema.VERIFICATION, "verify_with_samples": schema.VERIFICATION, "gold_answers": "array<string>", "sample_answers": "array<string>"}
    return df.withColumns({c: F.from_json(c, k) for c, k in kinds.items() if c in df.columns and dict(df.dtypes)[c] == "string"})


def merge_timings(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Per-stage timings, the latest of each stage."""
    if old is None:
        return new
    return old.join(new.select("stage"), "stage", "left_anti").unionByName(new)
