"""Meaning clusters of answer sets: pair extraction, pluggable scoring, greedy and exhaustive clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.bind import let
from quillon.functions.numeric import wilson

#: Scores (premise, hypothesis) pairs; a model loaded once per worker, or a scripted table.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def answer_pairs(df: DataFrame, answers: str, key: str = "qid") -> DataFrame:
    """Different ordered pairs of normalized answers within a row, each once in the whole table."""
    x = df.select(key, F.array_distinct(answers).alias("xs"))
    return (
        x.select(F.explode("xs").alias("premise"), "xs")
        .select("premise", F.explode("xs").alias("hypothesis"))
        .where("premise <> hypothesis")
        .distinct()
    )


def score_pairs(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """(premise, hypothesis, entail) by a batched model; equal answers never reach it."""
    return pairs.mapInPandas(scorer, "premise string, hypothesis string, entail double")


def attach_scores(df: DataFrame, scored: DataFrame, answers: str, key: str = "qid") -> DataFrame:
    """Give each row a map from "i,j" positions of its answers to the entailment score."""
    placed = df.select(key, F.posexplode(answers).alias("i", "premise"))
    other = df.select(key, F.posexplode(answers).alias("j", "hypothesis"))
    pairs = placed.join(other, key).where("i <> j and premise <> hypothesis").join(scored, ["premise", "hypothesis"])
    maps = pairs.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "i", "j"), "entail"))).alias("entailment"))
    return df.join(maps, key, "left")


def _linked(answers: Column, scores: Column, threshold: float) -> Callable[[Column, Column], Column]:
    """Whether two positions mean the same: equal texts, or entailment both ways."""

    def linked(i: Column, j: Column) -> Column:
        way = lambda a, b: F.coalesce(F.try_element_at(scores, F.concat_ws(",", a, b)), F.lit(0.0)) >= threshold
        return (F.get(answers, i) == F.get(answers, j)) | (way(i, j) & way(j, i))

    return linked


def cluster_exhaustive(answers: Column, scores: Column, threshold: float = 0.5) -> Column:
    """Cluster number of each answer: connected components over all pairs, numbered by their smallest position.

    Closure by repeated smallest-label passes inside the row; answer sets are
    short, so no shuffle is needed.
    """
    n = F.size(answers)
    at = F.sequence(F.lit(0), n - 1)
    linked = _linked(answers, scores, threshold)
    neighbours = F.transform(at, lambda i: F.filter(at, lambda j: (i == j) | linked(i, j)))

    def closed(around: Column) -> Column:
        once = lambda labels, _: F.transform(around, lambda near: F.array_min(F.transform(near, lambda j: F.get(labels, j))))
        return F.aggregate(at, at, once)

    return F.when(n > 0, let(neighbours, closed)).otherwise(F.array().cast("array<int>"))


def cluster_greedy(answers: Column, scores: Column, threshold: float = 0.5) -> Column:
    """Cluster number of each answer in one pass: an equal representative, else the first that entails both ways, else a new cluster."""
    n = F.size(answers)
    linked = _linked(answers, scores, threshold)

    def place(labels: Column, i: Column) -> Column:
        representatives = F.filter(F.sequence(F.lit(0), F.greatest(F.size(labels) - 1, F.lit(0))), lambda j: F.get(labels, j) == j)
        same = F.filter(representatives, lambda j: F.get(answers, j) == F.get(answers, i))
        near = F.filter(representatives, lambda j: linked(j, i))
        return F.concat(labels, F.array(F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0)), i)))

    start = F.array(F.lit(0))
    rest = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n > 0, F.aggregate(rest, start, place)).otherwise(F.array().cast("array<int>"))


def cluster_sizes(labels: Column) -> Column:
    return F.transform(F.array_distinct(labels), lambda u: F.size(F.filter(labels, lambda v: v == u)))


def cluster(answers: Column, scores: Column, method: str = "exhaustive", threshold: float = 0.5) -> Column:
    return {"exhaustive": cluster_exhaustive, "greedy": cluster_greedy}[method](answers, scores, threshold)


def same_partition(a: Column, b: Column) -> Column:
    """Whether two label arrays part the positions alike, whatever the labels' names."""
    first = lambda labels: F.transform(labels, lambda u: F.array_position(labels, u))
    return first(a) == first(b)


def clustering_audit(df: DataFrame, a: str, b: str, audited: Column, level: float = 0.95) -> DataFrame:
    """How often two clusterings of the audited rows differ, with a Wilson interval."""
    differs = F.count_if(~same_partition(F.col(a), F.col(b)))
    row = df.where(audited).agg(F.count(F.lit(1)).alias("n_audited"), differs.alias("n_differ"))
    return row.withColumn("ci", wilson(F.col("n_differ"), F.col("n_audited"), level)).select("n_audited", "n_differ", F.expr("try_divide(n_differ, n_audited)").alias("rate"), F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"))
