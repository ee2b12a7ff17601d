"""Exact top-k search by distributed histogram selection.

Every pass scores a block of queries against all rows. The score range of each
query starts at a bound from the vectors' lengths; global histograms of the
range narrow it down to the k-th score itself. A last pass keeps what is above
it and, of the ties, the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, scratch_path

#: Queries scored together: bounds the broadcast (this many vectors) and what a task returns for each pass.
QUERY_BLOCK = 4096
BINS = 64
_EXACT = 2.0**53
FOUND = "query_id long, vec_id long, score long"
_MOST, _MASK = (1 << 63) - 1, (1 << 64) - 1


def _clean(scale: float):
    """Whole numbers of the vectors that take part, packed by Arrow batch as one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                whole = np.floor(scale * np.array(v, np.float64))
                if np.isfinite(whole).all():
                    ids.append(i)
                    rows.append(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(r) for r in rows], pa.int32()), pa.array([float(np.sqrt(r @ r)) for r in rows], pa.float64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["id", "size", "norm", "vector"],
            )

    return run


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), size)


def _scores(queries: np.ndarray, rows: np.ndarray, q_norm: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where every partial sum is exact, else by whole numbers, held within a long."""
    if not len(rows):
        return np.zeros((len(queries), 0), np.int64)
    if float(q_norm.max()) * float(norm.max()) < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    out = np.array([[int(x) for x in q] for q in queries.tolist()], object) @ np.array([[int(x) for x in r] for r in rows.tolist()], object).T
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _passes(shared: Broadcast, finish: bool, k: int):
    """Histograms of the current ranges, or what the final limits keep; both summed up per task before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = shared.value
        size, lo, width = job["size"], job["lo"], job["width"]
        counts = np.zeros((len(lo), BINS + 2), np.int64)
        best: list[list[tuple[int, int]]] = [[] for _ in lo]
        for batch in batches:
            keep = np.flatnonzero(batch.column("size").to_numpy() == size)
            for at in range(0, len(keep), 1024):
                part = batch.take(pa.array(keep[at : at + 1024]))
                ids = part.column("id").to_numpy()
                scores = _scores(job["vectors"], _matrix(part.column("vector").to_pylist(), size), job["norms"], part.column("norm").to_numpy())
                own = job["ids"][:, None] == ids[None, :]
                for q in range(len(lo)):
                    s, other = scores[q], ~own[q]
                    if finish:
                        hit = np.flatnonzero(other & (s >= lo[q]))
                        if len(hit):
                            best[q] = sorted([*best[q], *zip((-x for x in s[hit].tolist()), ids[hit].tolist(), strict=True)])[:k]
                    else:
                        # differences of longs fit an unsigned long
                        over = s.view(np.uint64) - np.uint64(lo[q] & _MASK)
                        bin_ = np.where(s < lo[q], 0, np.minimum(over // np.uint64(width[q]), np.uint64(BINS)).astype(np.int64) + 1)
                        counts[q] += np.bincount(bin_[other], minlength=BINS + 2)
        if finish:
            rows = [(int(job["ids"][q]), i, -s) for q, found in enumerate(best) for s, i in found]
            q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])
        else:
            q, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return run


def _select(rows: DataFrame, block: dict, k: int, path: str) -> None:
    """Narrow each query's range until it holds the k-th score alone, and add what reaches it to the table at ``path``."""
    spark = rows.sparkSession
    reach = [min(_MOST, int(x) + 1) for x in np.ceil(block["norms"] * block["longest"]).tolist()]
    lo, hi = [max(-_MOST - 1, -r - 1) for r in reach], reach  # the k-th score lies in [lo, hi]
    open_ = list(range(len(lo)))
    while open_:
        width = [max(1, -(-(hi[q] - lo[q] + 1) // BINS)) for q in open_]
        part = {c: v[open_] if c in ("ids", "vectors", "norms") else v for c, v in block.items()}
        shared = spark.sparkContext.broadcast(part | {"lo": [lo[q] for q in open_], "width": width})
        found = rows.mapInArrow(_passes(shared, False, k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(open_), BINS + 2), np.int64)
        for q, b, n in found.collect():  # at most QUERY_BLOCK * (BINS + 2) numbers
            counts[q, b] = n
        shared.destroy()
        rest = []
        for j, q in enumerate(open_):
            above = np.cumsum(counts[j, ::-1])[::-1]  # rows in this bin or a higher one
            good = np.flatnonzero(above[1:] >= k)
            if not len(good):  # fewer than k rows: all count
                lo[q] = -_MOST - 1
                continue
            lo[q] += int(good[-1]) * width[j]
            if good[-1] < BINS:
                hi[q] = min(hi[q], lo[q] + width[j] - 1)
            if lo[q] < hi[q]:
                rest.append(q)
        open_ = rest
    shared = spark.sparkContext.broadcast(block | {"lo": lo, "width": []})
    rows.mapInArrow(_passes(shared, True, k), FOUND).write.mode("append").parquet(path)
    shared.destroy()


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """The k best rows of each query: query_id, rank (from 1), vec_id, score.

    Queries are the ids divisible by ``every``; candidates are the rows of
    other ids and of the query's length. A component x counts as
    floor(``scale`` * x); the score is the integer inner product, held within
    a long; ties go to the smaller id. Rows with a null id, a null vector or a
    null or non-finite component take no part. Exactly repeated rows are one
    row; of rows that share an id but not a vector each is a candidate, and
    the first by vector bytes is the query. An empty table or one without
    queries gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(raw.mapInArrow(_clean(scale), "id long, size int, norm double, vector binary").dropDuplicates(["id", "vector"]), "vectors")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vector", "size", "norm")).alias("q")).select("id", "q.*")
    # hashed into blocks; a block is the only set of vectors that is gathered, and the largest that is broadcast
    n, longest = rows.agg(F.count_if(F.col("id") % every == 0), F.max("norm")).first()
    queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (QUERY_BLOCK // 2)))))), "queries")
    path, some_found = scratch_path(spark, "found"), False
    for b, size in sorted(tuple(r) for r in queries.select("block", "size").distinct().collect()):
        got = queries.where((F.col("block") == b) & (F.col("size") == size)).orderBy("id").collect()
        for at in range(0, len(got), QUERY_BLOCK):
            some = got[at : at + QUERY_BLOCK]
            block = {"ids": np.array([r["id"] for r in some]), "norms": np.array([r["norm"] for r in some]), "vectors": _matrix([bytes(r["vector"]) for r in some], size), "size": size, "longest": longest}
            _select(rows, block, k, path)
            some_found = True
    found = spark.read.schema(FOUND).parquet(path) if some_found else spark.createDataFrame([], FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows a task
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
