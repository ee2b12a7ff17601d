"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, mixing.

Every stage takes what its predecessor kept, as a table with the columns of
``documents``, and all but the last return such a table. Further columns come
through whatever their names; ``n_chars`` may be missing. Texts that are null or
empty are judged like any other by the classifier and pass the other stages
unchanged; of rows that repeat an id all go or stay together in ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.decontaminate import find_contamination
from quillon.llm.line_dedup import remove_repeated_lines
from quillon.llm.mixing import mix_sources
from quillon.llm.near_dedup import near_duplicates
from quillon.llm.quality import score_quality, train
from quillon.llm.shared import materialize
from quillon.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(f: Stage) -> Stage:
    """A stage whose executors have the package."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return run_stage


def _packed(docs: DataFrame) -> DataFrame:
    """Id and text for an operator, and the other columns as they were in one struct, so that no name can clash and no text goes twice."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("as_it_was"))


def _unpacked(found: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the input, in order."""
    return found.select(*[F.col("text") if c == "text" else changed.get(c, F.col(f"as_it_was.`{c}`")).alias(c) for c in columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(score_quality(_packed(docs), model).where("score >= 0.7"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of three or more lines, or of 50 or more words in fewer lines, are deleted from the texts; ``n_chars`` follows."""
    kept = remove_repeated_lines(_packed(docs), min_lines=3)
    n_chars = F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("as_it_was.n_chars")) if "n_chars" in docs.columns else F.lit(None)
    return _unpacked(kept, docs.columns, n_chars=n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(materialize(gone, "near-gone"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = find_contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, keep_columns=True)
    return _unpacked(found.where("n_hit = 0"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document that is left."""
    return mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", _shipped(quality_filter)),
    ("line_dedup", _shipped(line_dedup)),
    ("near_dedup", _shipped(near_dedup)),
    ("decontamination", _shipped(decontaminate)),
    ("mixing", _shipped(mixing)),
]

#: Boosted trees are not expressible in SQL; the stages are tested one by one against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
