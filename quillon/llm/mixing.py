"""Mix sources to target weights.

Every document gets a hash-random key; within its source the documents are
range-sorted by that key, distributed prefix sums of word counts say where each
one lies, and the source's budget cuts the order: whole epochs first, then the
prefix that fits, the document at the cut giving only the words that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import global_rank, materialize, range_sorted


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, source: str, cycle: int) -> DataFrame:
    """Weigh sources 1..cycle, repeating, by code point order of their names, null last."""
    ranked = global_rank(sources, [F.col(source).asc_nulls_last()], "_rank")
    return ranked.withColumn("weight", (F.col("_rank") % cycle + 1).cast("double")).drop("_rank")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table of (source_size, weight).

    The total budget is ``share`` of all sizes. A source whose weighted part
    exceeds ``max_epochs`` times its size is held there and the excess is
    reshared by weight among the others, until none is above. Each round is
    one aggregate of one row over the source table.
    """
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, held_before = 0.0, -1
    while True:
        above = cap < F.col("weight") * F.lit(level)
        held, held_size, weight = sources.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if held == held_before or not weight:
            break
        held_before, level = held, max(level, (total - held_size) / weight)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _prefix_sums(start: dict[int, float]):
    """Running size before each row within its source; rows arrive sorted, one partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, carried, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                carried, first = start.get(batch.column("_pid")[0].as_py(), 0), False
                source = batch.column("_sid")[0].as_py()
            sid = batch.column("_sid").to_numpy(zero_copy_only=False)
            size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(size)
            heads = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
            base = np.repeat(np.r_[0, total[heads[1:] - 1]], np.diff(np.r_[heads, len(sid)]))
            before = total - size - base
            if sid[0] == source:
                before[: heads[1] if len(heads) > 1 else len(sid)] += carried
            source, carried = sid[-1].item(), int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_sid"), batch.column("size"), pa.array(before)],
                names=["_row", "_sid", "size", "_before"],
            )

    return run


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: DataFrame | None = None,
    weight_cycle: int = 3,
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """Return per document: id, ``size``, ``source_size``, ``target``, ``taken``.

    ``weights`` may give (source, weight); otherwise sources weigh
    1..``weight_cycle`` by name. A null source is a source of its own, a null
    or empty text has size 0 and gives no words, repeated rows each count, an
    empty table gives an empty result, and other columns are ignored. The same
    input and seed give the same result: ties of the random key fall back to
    the id, then the size, so rows that tie still are interchangeable.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(F.col(id_col).alias("_row"), F.col(source_col).cast("string").alias("_source"), word_count(F.col(text_col)).alias("size")),
        "mix-sizes",
    )
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cyclic_weights(sources, "_source", weight_cycle)
    else:
        w = weights.select(F.col(source_col).cast("string").alias("_w_source"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(w, F.col("_source").eqNullSafe(F.col("_w_source")), "left").drop("_w_source").fillna(0.0, ["weight"])
    sid = F.xxhash64(F.col("_source").isNull(), F.col("_source"))
    sources = materialize(sources.withColumn("_sid", sid), "mix-sources")
    plan = water_fill(sources, share, max_epochs).select("_sid", "source_size", "target")

    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_row").cast("string"), F.lit("")))), 1, 15), 16, 10)
    ranged = range_sorted(
        sized.select("_row", sid.alias("_sid"), key.cast("long").alias("_key"), "size"), ["_sid", "_key", "_row", "size"]
    ).withColumn("_pid", F.spark_partition_id())
    # sums by (range partition, source); only a partition's first source can have begun before it
    parts = ranged.groupBy("_pid", "_sid").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_sid").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).groupBy("_pid").agg(F.min_by("_start", "_sid"))
    start = dict(starts.collect())  # one number per range partition
    out = ranged.mapInArrow(_prefix_sums(start), "_row long, _sid long, size long, _before long").join(plan, "_sid")
    placed = out.withColumn("_budget", F.floor("target").cast("long")).withColumn("_epochs", F.expr("coalesce(_budget div nullif(source_size, 0), 0)"))
    left = F.col("_budget") - F.col("_epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before")))
    taken = (F.col("_epochs") * F.col("size") + part).cast("long")
    return placed.select(F.col("_row").alias(id_col), "size", "source_size", "target", taken.alias("taken"))
