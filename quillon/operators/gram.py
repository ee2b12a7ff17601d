"""Rank correlations of many signals from one distributed Gram matrix.

A pair of signals is ranked within the rows that both have. Rows of equal
missingness are counted together, which tells for which pairs those rows are the
same: a signal is ranked once for each distinct set of rows, not once for each
pair. Ranks then meet by row as vectors, and tasks turn their vectors into
matrices of products that are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.metrics import midranks
from quillon.operators.ranges import checkpointed
from quillon.schema import usable


def _products(sizes: list[int]):
    """Sums of products of centred ranks, and which ranks are the same or reversed throughout, by group and set of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            gid, of, lengths = (batch.column(c).to_numpy() for c in ("gid", "rows", "n"))
            flat = batch.column("ranks").flatten().to_numpy()
            starts = np.r_[0, np.cumsum(np.array(sizes)[of])]
            for g, s in np.unique(np.stack([gid, of], axis=1), axis=0).tolist():
                mine = np.flatnonzero((gid == g) & (of == s))
                x = 2 * flat[starts[mine][:, None] + np.arange(sizes[s])] - (lengths[mine] + 1)[:, None]  # whole numbers around zero
                same = np.array([(x[:, [i]] == x).all(axis=0) for i in range(sizes[s])])
                turned = np.array([(x[:, [i]] == -x).all(axis=0) for i in range(sizes[s])])
                state = found.setdefault((g, s), [0, np.zeros((sizes[s], sizes[s])), True, True])
                state[0] += len(mine)
                state[1] += x.T @ x
                state[2], state[3] = state[2] & same, state[3] & turned
        yield _told(found)

    return run


def _told(found: dict) -> pa.RecordBatch:
    columns = [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int32()), pa.array([v[0] for v in found.values()], pa.int64())]
    columns += [pa.array([np.asarray(v[i]).tobytes() for v in found.values()], pa.binary()) for i in (1, 2, 3)]
    return pa.RecordBatch.from_arrays(columns, names=["gid", "rows", "n", "products", "same", "turned"])


def _summed(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()  # a matrix per task
    state = [sum(r["n"] for r in rows), sum(np.frombuffer(r["products"]) for r in rows), *[np.logical_and.reduce([np.frombuffer(r[c], bool) for r in rows]) for c in ("same", "turned")]]
    return pa.Table.from_batches([_told({(rows[0]["gid"], rows[0]["rows"]): state})])


_STATE = "gid long, rows int, n long, products binary, same binary, turned binary"


def rank_pairs(scores: DataFrame, keys: list[str] | None = None, *, row: str = "qid") -> DataFrame:
    """(keys, a, b, n, rho, same, reversed) of all pairs a <= b of signals, over rows that both have.

    ``rho`` is Spearman's coefficient (null for a constant); ``same`` and
    ``reversed`` compare the ranks themselves, free of rounding.
    """
    keys = keys or []
    spark = scores.sparkSession
    ok = scores.where(usable(F.col("score")))
    names = [r[0] for r in ok.select("signal").distinct().orderBy("signal").collect()]  # a row per signal
    shape = ", ".join([*[f"`{k}` {scores.schema[k].dataType.simpleString()}" for k in keys], "a string, b string, n long, rho double, same boolean, reversed boolean"])
    if not names:
        return spark.createDataFrame([], shape)
    wide = ok.groupBy(*keys, row).agg(F.map_from_entries(F.collect_list(F.struct("signal", F.col("score").cast("double").alias("score")))).alias("m"))  # a score per signal
    wide = checkpointed(wide)
    has = [F.coalesce(F.map_contains_key("m", F.lit(s)), F.lit(False)) for s in names]
    mask = F.concat(*[F.when(h, "1").otherwise("0") for h in has])
    masks = wide.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, row).cast("decimal(38,0)")).alias("h"))
    pair = F.transform(F.filter(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.substring("mask", i, F.lit(1)) == "1"), lambda i: i - 1)
    both = masks.select("n", "h", F.explode(pair).alias("i"), pair.alias("js")).select("n", "h", "i", F.explode("js").alias("j")).where("i <= j")
    sizes = {(r["i"], r["j"]): (r["n"], r["h"]) for r in both.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).collect()}  # a row per pair
    # sets of rows, each named by the first pair it belongs to, and the signals that are ranked in it
    sets: dict[tuple, int] = {}
    first: list[tuple[int, int]] = []
    columns: list[set[int]] = []
    for p in sorted(sizes, key=lambda p: (p[0] != p[1], p)):
        if sizes[p] not in sets:
            sets[sizes[p]] = len(first)
            first.append(p)
            columns.append(set())
        columns[sets[sizes[p]]] |= set(p)
    places = [sorted(c) for c in columns]
    jobs = [(s, i) for s, c in enumerate(places) for i in c]
    each = F.filter(F.array(*[F.when(has[first[s][0]] & has[first[s][1]], F.struct(F.lit(s).alias("rows"), F.lit(i).alias("i"), F.element_at("m", F.lit(names[i])).alias("score"))) for s, i in jobs]), lambda x: x.isNotNull())
    long = wide.select(F.xxhash64(F.lit(0), *keys).alias("gid"), F.struct(*keys, row).alias("at"), F.explode(each).alias("x")).select("gid", "at", "x.*")
    ranked = midranks(long, ["gid", "rows", "i"], "score", "rank")
    vectors = ranked.groupBy("gid", "rows", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))), lambda x: x["rank"]).alias("ranks"))  # a rank per signal
    n = long.groupBy("gid", "rows").agg(F.countDistinct("at").alias("n"))  # a row per group and set
    sums = vectors.join(F.broadcast(n), ["gid", "rows"]).select("gid", "rows", "n", "ranks").mapInArrow(_products([len(p) for p in places]), _STATE)
    states = sums.groupBy("gid", "rows").applyInArrow(_summed, _STATE).collect()
    groups = {r["gid"]: tuple(r)[1:] for r in ok.select(F.xxhash64(F.lit(0), *keys).alias("gid"), *keys).distinct().collect()}
    told = []
    for r in states:
        c = places[r["rows"]]
        g, same, turned = (np.frombuffer(bytes(r[x]), kind).reshape(len(c), len(c)) for x, kind in (("products", float), ("same", bool), ("turned", bool)))
        for x, i in enumerate(c):
            for y, j in enumerate(c):
                if i <= j and sets[sizes[i, j]] == r["rows"]:
                    spread = float(np.sqrt(g[x, x]) * np.sqrt(g[y, y]))
                    rho = None if spread == 0 else 1.0 if same[x, y] else -1.0 if turned[x, y] else float(g[x, y] / spread)
                    told.append((*groups[r["gid"]], names[i], names[j], r["n"], rho, bool(same[x, y]), bool(turned[x, y])))
    return spark.createDataFrame(told, shape)
