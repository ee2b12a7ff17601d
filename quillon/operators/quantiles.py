"""Exact order statistics and quantiles without one task that sees all values.

The place of each wanted rank is narrowed down by counts: sampled quantiles of the
values that are still possible cut them into bins, whose exact counts say in which
one the rank lies. A cut itself is a bin of its own, so ties end the search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cuts of a round; a round leaves about one row in as many.
CUTS = 32


def _matches(keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[tuple, list[int]]) -> dict[tuple, dict[int, float]]:
    """Values at 0-based ranks among the numbers of each key (there are few keys; nulls and NaN are no numbers).

    A round is two aggregates over a scan of keys and value; what is gathered is
    a row per key and bin.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    kinds = "".join(f", `_{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    found: dict[tuple, dict[int, float]] = {k: {} for k in ranks}
    # an open interval of values, the rows before it, and the ranks that lie in it
    open_ = [(key, None, None, 0, sorted(set(r))) for key, r in ranks.items() if r]
    while open_:
        told = spark.createDataFrame([(i, lo, hi, *key) for i, (key, lo, hi, *_) in enumerate(open_)], f"_i int, _lo double, _hi double{kinds}")
        inside = rows.join(F.broadcast(told), _matches(keys) & (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi"))))  # a row per interval
        at = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
        cuts = F.broadcast(inside.groupBy("_i").agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", at, 20 * CUTS))).alias("_cuts")))
        bin_ = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        counted = inside.select("_i", "_v").join(cuts, "_i").groupBy("_i", "_cuts", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("n"))
        by: dict[int, list] = {}
        for r in counted.collect():
            by.setdefault(r["_i"], []).append(r)
        rest = []
        for i, (key, lo, hi, before, wanted) in enumerate(open_):
            for r in sorted(by.get(i, []), key=lambda r: r["_bin"]):
                mine = [k for k in wanted if before <= k < before + r["n"]]
                place, tie = divmod(r["_bin"], 2)
                if tie:
                    found[key] |= {k: r["_cuts"][place] for k in mine}
                elif mine:
                    rest.append((key, r["_cuts"][place - 1] if place else lo, r["_cuts"][place] if place < len(r["_cuts"]) else hi, before, mine))
                before += r["n"]
        open_ = rest
    return found


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, quantiles): exact quantiles of the numbers of each key, between neighbours by linear interpolation."""
    spark = df.sparkSession
    number = F.col(value).cast("double")
    counts = df.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys).count().collect()  # a row per key
    size = {tuple(r[:-1]): r[-1] for r in counts if r[-1]}
    found = order_statistics(df, keys, value, {key: [k for q in shares for k in (int((n - 1) * q), min(n - 1, int((n - 1) * q) + 1))] for key, n in size.items()})
    rows = []
    for key, n in size.items():
        out = []
        for q in shares:
            k = int((n - 1) * q)
            lo, hi = found[key][k], found[key][min(n - 1, k + 1)]
            part = (n - 1) * q - k
            out.append(lo if part == 0 or lo == hi else lo + (hi - lo) * part)
        rows.append((*key, n, out))
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return spark.createDataFrame(rows, f"{kinds}n long, quantiles array<double>")
