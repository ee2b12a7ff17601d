"""Hard-negative mining over k-means inverted lists.

A list holds the rows nearest to a centroid and its radius. By the
Cauchy-Schwarz inequality a row of it scores within |anchor| * radius of the
centroid's own score, so anchors visit lists by upper bound, leave out lists
wholly outside their window, and stop when the next bound falls strictly below
the k-th score found. All results are exact, whatever the centroids are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_materialized, global_rank, materialize, scratch_path
from .topk import _scores
from .vectors import finite, matrix, owners, packed

#: Centroids, at most: bounds what is broadcast and the state of an anchor block.
MOST_LISTS = 1024
LLOYD_STEPS = 5
#: Rows of a list that are stored as one record, about; a list of any length is spread over tasks by records.
LIST_ROWS = 256
#: Anchors searched together.
ANCHOR_BLOCK = 1024
#: Lists of the first round; each further one visits four times as many.
FIRST_LISTS = 8
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_ROWS = "id long, label long, size int, norm double, vector binary"
_FOUND = "target int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _clean(scale: float):
    """Whole numbers of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, flat = finite(batch.column("v"))
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * flat)
            of = owners(sizes)
            keep[of[~np.isfinite(whole)]] = False
            norm = np.sqrt(np.bincount(of, np.nan_to_num(whole) ** 2, len(sizes)))
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(norm), packed(whole, sizes)], names=["id", "label", "size", "norm", "vector"])
            yield out.filter(pa.array(keep))

    return run


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * (rows @ centroids.T)).argmin(axis=1)


def _cluster_sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            rows = matrix(batch.column("vector"), centroids.shape[1])
            at = _nearest(rows, centroids)
            order = np.argsort(at, kind="stable")
            there, first = np.unique(at[order], return_index=True)
            n[there] += np.diff(np.r_[first, len(at)])
            if rows.size:
                sums[there] += np.add.reduceat(rows[order], first, axis=0)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there]), pa.array([s.tobytes() for s in sums[there]], pa.binary())], names=["cluster", "n", "sums"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s) for s in table.column("sums").to_pylist())  # one vector a task
    return pa.table({"cluster": table.column("cluster")[:1], "n": pa.array([sum(table.column("n").to_pylist())]), "sums": pa.array([np.asarray(total).tobytes()], pa.binary())})


def centroids_of(rows: DataFrame, size: int, n: int, steps: int = LLOYD_STEPS) -> np.ndarray:
    """Centroids by Lloyd's steps over all rows, from distinct vectors that a hash picks; half the root of the rows, at most ``MOST_LISTS``."""
    k = max(1, min(MOST_LISTS, isqrt(n) // 2))
    picked = rows.where(F.pmod(F.xxhash64("vector"), F.lit(max(1, n // (8 * k)))) == 0).select("vector").distinct().orderBy(F.xxhash64("vector", F.lit(1)), "vector").limit(k).collect()
    start = [r["vector"] for r in picked] or [rows.agg(F.min("vector")).first()[0]]
    centroids = np.frombuffer(b"".join(map(bytes, start))).reshape(len(start), size).copy()
    for _ in range(steps if len(centroids) > 1 else 0):
        sums = rows.mapInArrow(_cluster_sums(centroids), "cluster int, n long, sums binary").groupBy("cluster").applyInArrow(_summed, "cluster int, n long, sums binary")
        for r in sums.collect():  # a row per centroid
            centroids[r["cluster"]] = np.frombuffer(bytes(r["sums"])) / r["n"]
    return centroids


def _placed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vector"), centroids.shape[1])
            at = _nearest(rows, centroids)
            away = np.sqrt(((rows - centroids[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(away)], names=[*batch.schema.names, "cluster", "away"])

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, salt, id, vector, label) become records; exactly repeated rows become one."""
    last = None
    names = ["cluster", "ids", "labels", "norm", "vectors"]
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*[batch.column(c).to_pylist() for c in ("id", "label", "vector")], strict=True))
        new = np.array([a != b for a, b in zip(key, [last, *key[:-1]], strict=True)])
        last, part = key[-1], batch.filter(pa.array(new))
        if not part.num_rows:
            continue
        cluster, salt = (part.column(c).to_numpy() for c in ("cluster", "salt"))
        cuts = np.flatnonzero(np.r_[True, (cluster[1:] != cluster[:-1]) | (salt[1:] != salt[:-1])])
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(cluster)], strict=True):
            some = part.slice(a, b - a)
            ids, labels, norms = (some.column(c).to_numpy() for c in ("id", "label", "norm"))
            out.append((int(cluster[a]), ids.tobytes(), labels.tobytes(), float(norms.max()), b"".join(some.column("vector").to_pylist())))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def inverted_lists(rows: DataFrame, size: int, n: int) -> tuple[DataFrame, DataFrame, dict]:
    """The rows with their list, the lists as records, and what is stored of each list: its centroid and radius."""
    centroids = centroids_of(rows, size, n)
    placed = materialize(rows.mapInArrow(_placed(centroids), f"{_ROWS}, cluster int, away double"), "placed")
    radii = placed.groupBy("cluster").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    stored = {r["cluster"]: r for r in radii.collect()}  # a row per list
    counts = placed.sparkSession.createDataFrame([(c, -(-r["n"] // LIST_ROWS)) for c, r in stored.items()], "cluster int, parts long")
    salted = placed.join(F.broadcast(counts), "cluster").withColumn("salt", F.pmod(F.xxhash64("id", "vector"), F.col("parts"))).select("cluster", "salt", "id", "label", "norm", "vector")
    dealt = salted.repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "id", "vector", "label")
    lists = materialize(dealt.mapInArrow(_records, "cluster int, ids binary, labels binary, norm double, vectors binary"), "lists")
    radius = np.array([stored[c]["radius"] if c in stored else -1.0 for c in range(len(centroids))])
    return placed, lists, {"centroids": centroids, "radius": radius}


def _visit(shared: Broadcast, top: int, same: bool):
    """The best rows of each target in the lists that it visits in this round, summed up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = shared.value
        row, lo, hi = job["row"], job["lo"], job["hi"]
        visits = np.unpackbits(job["visits"], axis=1, count=job["lists"]).astype(bool)
        size = job["vectors"].shape[1]
        best = (np.zeros((len(row), top), bool), np.zeros((len(row), top), np.int64), np.zeros((len(row), top), np.int64))
        for batch in batches:
            for record in batch.to_pylist():
                at = np.flatnonzero(visits[:, record["cluster"]])
                if not len(at):
                    continue
                ids, labels = (np.frombuffer(record[c], np.int64) for c in ("ids", "labels"))
                anchors, of = np.unique(row[at], return_inverse=True)
                scores = _scores(job["vectors"][anchors], np.frombuffer(record["vectors"]).reshape(len(ids), size), job["norms"][anchors], np.array([record["norm"]]))
                fits = (job["labels"][anchors][:, None] == labels[None, :]) == same
                fits &= job["ids"][anchors][:, None] != ids[None, :]
                s = scores[of]
                ok = fits[of] & (s >= lo[at][:, None]) & (s <= hi[at][:, None])
                order = np.argsort(ids, kind="stable")  # of equal scores the first is the smallest id
                _add(best, at, ok[:, order], s[:, order], ids[order], top)
        t, j = np.nonzero(best[0])
        keys = [pa.array(k[t], pa.int64()) for k in job["keys"]]
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), *keys, pa.array(best[2][t, j]), pa.array(best[1][t, j])], names=["target", "anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return run


def _add(best: tuple, at: np.ndarray, ok: np.ndarray, s: np.ndarray, ids: np.ndarray, top: int) -> None:
    """Bring the first ``top`` fitting columns of each row into the best of its target."""
    there, score, vec = best
    some = np.flatnonzero(ok.any(axis=1))
    at, ok, s = at[some], ok[some].copy(), s[some]
    each = np.arange(len(at))
    new = ([], [], [])
    for _ in range(min(top, ok.shape[1])):
        j = np.where(ok, s, _LOWEST).argmax(axis=1)
        j = np.where(ok[each, j], j, ok.argmax(axis=1))  # where the lowest score of all itself fits
        for found, x in zip(new, (ok[each, j], s[each, j], ids[j]), strict=True):
            found.append(x[:, None])
        ok[each, j] = False
    if not new[0]:
        return
    both = [np.hstack([old[at], *found]) for old, found in zip(best, new, strict=True)]
    order = np.lexsort((both[2], ~both[1], ~both[0]), axis=1)[:, :top]
    there[at], score[at], vec[at] = (np.take_along_axis(x, order, axis=1) for x in both)


def _bounds(block: dict, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """No row of a list scores outside these; a list without rows has none. Rounding is allowed for."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle, reach = block["vectors"] @ index["centroids"].T, block["norms"][:, None] * index["radius"][None, :]
        slack = 1e-9 * (block["norms"][:, None] * np.sqrt((index["centroids"] ** 2).sum(axis=1)) + np.abs(reach)) + 1
        return middle - reach - slack, middle + reach + slack


def _search(lists: DataFrame, block: dict, index: dict, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, keys: list[np.ndarray], top: int, same: bool, path: str) -> None:
    """Visit lists in rounds until no target's next bound reaches its ``top``-th score; what tasks find is added to the table at ``path``."""
    spark = lists.sparkSession
    low, high = (b[row] for b in _bounds(block, index))
    inside = ~((high < lo[:, None]) | (low > hi[:, None])) & (index["radius"] >= 0)[None, :]
    order = np.argsort(-np.minimum(high, hi[:, None].astype(float)), axis=1, kind="stable")
    least, step = lo.copy(), FIRST_LISTS
    todo, any_ = inside, False
    while todo.any():
        turn = np.take_along_axis(todo, order, axis=1)
        turn &= np.cumsum(turn, axis=1) <= step
        now = np.zeros_like(todo)
        np.put_along_axis(now, order, turn, axis=1)
        visited = np.flatnonzero(now.any(axis=0)).tolist()
        shared = spark.sparkContext.broadcast(block | {"row": row, "lo": least, "hi": hi, "keys": keys, "visits": np.packbits(now, axis=1), "lists": now.shape[1]})
        lists.where(F.col("cluster").isin(visited)).mapInArrow(_visit(shared, top, same), _FOUND).write.mode("append").parquet(path)
        shared.destroy()
        any_ = True
        for r in _ranked(spark.read.schema(_FOUND).parquet(path), top).where(F.col("rank") == top).select("target", "score").collect():  # at most a number per target
            least[r["target"]] = max(least[r["target"]], r["score"])
        todo = todo & ~now & ~(high < least[:, None])
        step *= 4
    if not any_:
        spark.createDataFrame([], _FOUND).write.parquet(path)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("target").orderBy(F.desc("score"), "vec_id")  # at most ``top`` rows a task and round
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _half(score: int, percent: int, up: bool) -> int:
    whole = score * percent
    return -(-whole // 100) if up else whole // 100


def _mine_block(lists: DataFrame, got: list, index: dict, size: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame | None:
    """What the rounds of a block of anchors have found, a few rows for each task and pair."""
    spark = lists.sparkSession
    vectors = np.frombuffer(b"".join(bytes(r["vector"]) for r in got)).reshape(len(got), size)
    block = {"vectors": vectors, "norms": np.array([r["norm"] for r in got]), "ids": np.array([r["id"] for r in got]), "labels": np.array([r["label"] for r in got])}
    every = np.arange(len(got))
    zero = np.zeros(len(got), np.int64)
    path = scratch_path(spark, "positives")
    _search(lists, block, index, every, np.full(len(got), _LOWEST), np.full(len(got), _HIGHEST), [block["ids"], zero, zero], positives, True, path)
    best = spark.read.schema(_FOUND).parquet(path)
    pairs = _ranked(best, positives).orderBy("target", "rank").collect()  # at most ``positives`` an anchor
    drop_materialized(best)
    low = [_half(r["score"], window[0], True) for r in pairs]
    high = [_half(r["score"], window[1], False) for r in pairs]
    open_ = [i for i in range(len(pairs)) if low[i] <= high[i]]
    if not open_:
        return None
    row, ids, scores = (np.array([pairs[i][c] for i in open_], np.int64) for c in ("target", "vec_id", "score"))
    keys = [block["ids"][row], ids, scores]
    path = scratch_path(spark, "negatives")
    _search(lists, block, index, row, np.array([low[i] for i in open_], np.int64), np.array([high[i] for i in open_], np.int64), keys, negatives, False, path)
    return spark.read.schema(_FOUND).parquet(path)


def mine(
    vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: float = 256.0
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the ids divisible by ``every``. An anchor's positives are its
    best ``positives`` rows of the same label and another id; for each of them
    the best ``negatives`` rows of another label and id come out whose score is
    within ``window`` percent of the positive's. A component x counts as
    floor(``scale`` * x); scores are integer inner products between vectors of
    one length, held within a long; ties go to the smaller id. Rows with a null
    id or label, a null vector or a null or non-finite component take no part.
    Exactly repeated rows are one row; of rows that share an id but not vector
    or label each is a candidate, and the first by vector bytes and label is the
    anchor. An empty table, one without anchors, and anchors without positives
    or negatives give no rows; other columns are ignored.

    Centroids come from all rows; every row is in a list. Broadcast and gathered
    are centroids, radii, and a block of anchors with their thresholds.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null")
    rows = materialize(raw.mapInArrow(_clean(scale), _ROWS), "vectors")
    result, some_found = scratch_path(spark, "mined"), False
    for size, n in sorted(tuple(r) for r in rows.groupBy("size").count().collect()):
        placed, lists, index = inverted_lists(rows.where(F.col("size") == size), size, n)
        anchors = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vector", "label", "norm", "cluster")).alias("a")).select("id", "a.*")
        # neighbours share a block, so that a block visits few lists
        ranked = materialize(global_rank(anchors, ["cluster", "id"]), "anchors")
        blocks = -(-ranked.count() // ANCHOR_BLOCK)
        for b in range(blocks):
            got = ranked.where((F.col("rank") >= b * ANCHOR_BLOCK) & (F.col("rank") < (b + 1) * ANCHOR_BLOCK)).orderBy("rank").collect()
            mined = _mine_block(lists, got, index, size, positives, negatives, window)
            if mined is not None:
                _ranked(mined, negatives).write.mode("append").parquet(result)
                drop_materialized(mined)
                some_found = True
        for table in (placed, lists, ranked):
            drop_materialized(table)
    drop_materialized(rows)
    out = spark.read.schema(f"{_FOUND}, rank int").parquet(result) if some_found else spark.createDataFrame([], f"{_FOUND}, rank int")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
