"""Sums of doubles that are rounded once, whatever the order and the partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = 53


def _by_exponent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each number is a whole multiple of a power of two: multiples are added up by power, without loss."""
    found: dict[tuple[int, int], int] = {}
    for batch in batches:
        gid, x = batch.column("gid").to_numpy(), batch.column("x").to_numpy()
        share, power = np.frexp(x)
        whole = (share * 2.0**_BITS).astype(np.int64)
        pairs, at = np.unique(np.stack([gid, power.astype(np.int64)], axis=1), axis=0, return_inverse=True)
        at = at.reshape(-1)
        low, high = whole & 0xFFFFFFFF, whole >> 32  # sums of halves fit a long for two thousand million rows
        sums = [np.zeros(len(pairs), np.int64) for _ in range(2)]
        for total, part in zip(sums, (low, high), strict=True):
            np.add.at(total, at, part)
        for (g, e), a, b in zip(pairs.tolist(), sums[0].tolist(), sums[1].tolist(), strict=True):
            found[g, e] = found.get((g, e), 0) + a + (b << 32)
    rows = [(g, e, Decimal(v)) for (g, e), v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.decimal128(38, 0))], names=["gid", "power", "whole"])


def _rounded(table: pa.Table) -> pa.Table:
    total = Fraction(0)
    for power, whole in zip(table.column("power").to_pylist(), table.column("whole").to_pylist(), strict=True):  # at most 2,100 powers
        shift = power - _BITS
        total += Fraction(int(whole) << max(shift, 0), 1 << max(-shift, 0))
    try:
        value = float(total)  # division of whole numbers rounds correctly
    except OverflowError:
        value = math.inf if total > 0 else -math.inf
    return pa.table({"gid": table.column("gid")[:1], "total": pa.array([value])})


def exact_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, total): the sum of the finite numbers of each key, as if added without rounding and rounded at the end.

    The same bits on any order and partitioning. Nulls, NaN and infinities do not
    count; a key without numbers has a sum of 0. A task leaves a number per key
    and power of two.
    """
    x = F.col(value).cast("double")
    rows = df.select(*keys, F.xxhash64(F.lit(0), *keys).alias("gid"), F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias("x"))
    names = rows.groupBy(*keys, "gid").agg(F.count("x").alias("n"))
    parts = rows.where("x is not null").select("gid", "x").mapInArrow(_by_exponent, "gid long, power int, whole decimal(38,0)")
    sums = parts.groupBy("gid", "power").agg(F.sum("whole").alias("whole")).groupBy("gid").applyInArrow(_rounded, "gid long, total double")
    return names.join(sums, "gid", "left").select(*keys, "n", F.coalesce("total", F.lit(0.0)).alias("total"))
