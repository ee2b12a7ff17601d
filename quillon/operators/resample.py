"""Resampling inference from weights that rows carry themselves.

A resample draws, within each class of a group, as many units as the class has,
with replacement (``operators/draws.py``); every engine and every partitioning
draws the same rows, all signals share a row's draws, and no draw is ever
shuffled: tasks turn the rows they hold into sums for all resamples at once, a
vector per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.draws import Draws, classes, draws_of, hashes, unit_hash
from quillon.operators.metrics import _join, auroc_from, average_precision_from, histogram, rated, running, running_max, usable
from quillon.operators.ranges import checkpointed, partitions_for, range_sorted

#: Resamples whose sums travel in one row.
BLOCK = 256
_CELLS = 1 << 17
#: Last arrivals that are broadcast at a time; more groups than hold as many are drawn group block by group block.
_MOST = 8 << 20


class _Ties:
    """Sorted rows of one key, put together to tie groups: the first one of all is kept apart, the last one may go on."""

    def __init__(self) -> None:
        self.head: tuple | None = None
        self.tail: tuple | None = None  # score, positives, negatives; None for none

    def add(self, scores: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> None:
        """Rows in ascending order with a vector of weights each."""
        for score, yes, drawn in zip(scores.tolist(), positive.tolist(), weights, strict=True):
            w = drawn.astype(float)
            if self.tail is None or self.tail[0] != score:
                self._close()
                self.tail = (score, w, None) if yes else (score, None, w)
            else:
                _, pos, neg = self.tail
                self.tail = (score, w if pos is None else pos + w, neg) if yes else (score, pos, w if neg is None else neg + w)

    def _close(self) -> None:
        if self.tail is not None and self.head is None:
            self.head = self.tail
        elif self.tail is not None:
            self.inner(*self.tail[1:])

    def inner(self, pos: np.ndarray | None, neg: np.ndarray | None) -> None:
        raise NotImplementedError


class _Key(_Ties):
    """Sums of one key over the sorted rows of one task: the first and the last tie group, and what lies between."""

    def __init__(self, resamples: int) -> None:
        super().__init__()
        self.pos, self.neg, self.u, self.product = (np.zeros(resamples) for _ in range(4))

    def inner(self, pos: np.ndarray | None, neg: np.ndarray | None) -> None:
        if pos is not None:
            self.u += np.multiply(pos, self.neg, out=self.product)
            self.pos += pos
        if neg is not None:
            if pos is not None:
                self.u += np.multiply(pos, neg, out=self.product) / 2
            self.neg += neg

    def rows(self) -> Iterator[tuple]:
        none = np.zeros_like(self.u)
        whole = lambda tie: (tie[0], *(none if x is None else x for x in tie[1:]))
        if self.head is not None:
            yield 0, *whole(self.head), none
            yield 1, None, self.pos, self.neg, self.u
        yield 2, *whole(self.tail), none


_SEGMENT = "gid long, side int, block int, part int, kind int, score double, pos array<double>, neg array<double>, u array<double>"


def _runs(draws: Draws, batches: Iterator[pa.RecordBatch], first: int, until: int) -> Iterator[tuple]:
    """(gid, scores, labels, weights) of runs of sorted rows of one gid, a vector of the resamples' weights for each row."""
    step = max(1, 4 * _CELLS // max(1, until - first))
    for batch in batches:
        ids, score, y, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "score", "y", "cls"))
        h = hashes(batch.column("h"))
        for at in range(0, batch.num_rows, step):
            part = slice(at, min(at + step, batch.num_rows))
            w = draws.weights(ids[part], cls[part], h[part], first, until)
            cuts = np.flatnonzero(np.r_[True, ids[part][1:] != ids[part][:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                yield int(ids[at + a]), score[at + a : at + b], y[at + a : at + b], w[a:b]


def _segments(shared: Broadcast, resamples: int, sides: int):
    """Rows sorted by (gid, score) become a few rows of sums for each group, side and block of resamples."""

    def told(gid: int, keys: dict[int, _Key]) -> pa.RecordBatch:
        part, rows = TaskContext.get().partitionId(), []
        for side, key in keys.items():
            for kind, score, *sums in key.rows():
                for b in range(0, resamples, BLOCK):
                    rows.append({"gid": gid, "side": side, "block": b, "part": part, "kind": kind, "score": score, **{n: x[b : b + BLOCK] for n, x in zip(("pos", "neg", "u"), sums, strict=True)}})
        lists = [(n, pa.list_(pa.float64())) for n in ("pos", "neg", "u")]
        kinds = pa.schema([("gid", pa.int64()), *[(n, pa.int32()) for n in ("side", "block", "part", "kind")], ("score", pa.float64()), *lists])
        return pa.RecordBatch.from_pylist(rows, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, keys = None, {}
        for g, score, y, w in _runs(shared.value, batches, 0, resamples):
            if g != gid:
                if keys:
                    yield told(gid, keys)
                gid, keys = g, {side: _Key(resamples) for side in range(sides)}
            for side, key in keys.items():
                key.add(score, y >> side & 1, w)
        if keys:
            yield told(gid, keys)

    return run


def _combined(table: pa.Table) -> pa.Table:
    """AUROCs of one group, side and block from the segments of all tasks, in the order of scores."""
    table = table.sort_by([("part", "ascending"), ("kind", "ascending")])
    col = {c: np.array(table.column(c).to_pylist(), float) for c in ("pos", "neg", "u")}
    p, n, u, tie = 0.0, 0.0, 0.0, None
    for i, (kind, score) in enumerate(zip(table.column("kind").to_pylist(), table.column("score").to_pylist(), strict=True)):
        pos, neg = col["pos"][i], col["neg"][i]
        if tie is not None and kind != 1 and tie[0] == score:
            tie = (score, tie[1] + pos, tie[2] + neg)
            continue
        if tie is not None:
            u, p, n, tie = u + tie[1] * (n + tie[2] / 2), p + tie[1], n + tie[2], None
        if kind == 1:
            u, p, n = u + col["u"][i] + pos * n, p + pos, n + neg
        else:
            tie = (score, pos, neg)
    if tie is not None:
        u, p, n = u + tie[1] * (n + tie[2] / 2), p + tie[1], n + tie[2]
    ok = p * n > 0
    value = np.where(ok, u / np.where(ok, p * n, 1), np.nan)
    first, size = table.column("block")[0].as_py(), len(value)
    return pa.table({"gid": pa.array(np.full(size, table.column("gid")[0].as_py())), "side": pa.array(np.full(size, table.column("side")[0].as_py(), np.int32)), "r": pa.array(np.arange(first, first + size)), "auroc": pa.array(value, mask=~ok)})


def _named(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``gid``, a number for its keys, and the keys of each number."""
    gid = F.xxhash64(F.lit(0), *by).alias("gid")
    return df.withColumn("gid", gid), df.select(gid, *by).distinct()


def _units(rows: DataFrame, key: str, seed: int, clusters: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with the hash and class of their unit, and the units (gid, cls, h).

    With ``clusters`` the unit is all rows of a key; its class is their majority
    (a tie is positive), and a group whose clusters are all of one class is
    drawn by row, as ``qid`` says.
    """
    if not clusters:
        rows = rows.withColumns({"h": unit_hash(seed, F.col(key)), "cls": F.col("cls").cast("int")})
        return rows, rows.select("gid", "cls", "h")
    rows = checkpointed(rows)
    votes = rows.groupBy("gid", key).agg((F.avg(F.col("cls").cast("double")) >= 0.5).cast("int").alias("_vote"))
    both = votes.groupBy("gid").agg((F.min("_vote") < F.max("_vote")).alias("_both"))
    told = votes.join(both, "gid").withColumnsRenamed({"gid": "_g", key: "_k"})
    joined = rows.join(told, (F.col("gid") == F.col("_g")) & F.col(key).eqNullSafe(F.col("_k")))
    joined = joined.withColumns({"h": F.when(F.col("_both"), unit_hash(seed, F.col(key))).otherwise(unit_hash(seed, F.col("qid"))), "cls": F.when(F.col("_both"), F.col("_vote")).otherwise(F.col("cls").cast("int"))})
    joined = checkpointed(joined)  # read again for each step of the search, as the units are
    units = joined.select("gid", "cls", "h", "_both", F.when(~F.col("_both"), F.col("qid")).alias("_row")).distinct()
    return joined.drop("_vote", "_both", "_g", "_k"), checkpointed(units.select("gid", "cls", "h"))


def _blocks(found: list[dict], resamples: int) -> Iterator[list[dict]]:
    """Groups and classes in blocks whose last arrivals can be broadcast; a group's classes stay together."""
    block, sets = [], set()
    for i, f in enumerate(found):
        if sets and len(sets | {f["set"]}) * resamples > _MOST and found[i - 1]["gid"] != f["gid"]:
            yield block
            block, sets = [], set()
        block.append(f)
        sets.add(f["set"])
    if block:
        yield block


def _drawn(rows: DataFrame, units: DataFrame, resamples: int) -> Iterator[tuple[DataFrame, Draws]]:
    """The rows with their draws; of groups that have both classes or are of one class by definition."""
    found = classes(units)
    blocks = list(_blocks(found, resamples))
    for block in blocks:
        gids = rows.sparkSession.createDataFrame([(g,) for g in {f["gid"] for f in block}], "gid long")
        yield rows if len(blocks) == 1 else rows.join(F.broadcast(gids), "gid"), draws_of(units, block, resamples)


def auroc_draws(scores: DataFrame, resamples: int, seed: int, by: list[str], key: str = "qid", *, clusters: bool = False, members: DataFrame | None = None, labels: list[str] | None = None) -> DataFrame:
    """(by, r, auroc): AUROC per resample; null where a class has no draw.

    Positives and negatives of a group are drawn separately, each as often as
    there are. ``members`` are the rows that are drawn from (by, key, y), if
    not the scored ones alone. With ``labels`` each named column gives an AUROC
    on the same draws, in the column ``label``; the last one is the class that is
    drawn within.

    Rows are range-partitioned by key and score, so a key with very many rows is
    spread over tasks and ties may cross them; a task's sums are three rows for
    each key and block of resamples, whatever the number of rows.
    """
    sides = labels or ["y"]
    rows, names = _named(rated(scores), by)
    bits = sum((F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(sides)), F.lit(0))
    keep = ["gid", F.col("score").cast("double").alias("score"), bits.cast("int").alias("y"), F.col(sides[-1]).alias("cls"), *dict.fromkeys([key, *(["qid"] if clusters else [])])]
    rows, units = _units(rows.select(*keep), key, seed, clusters)
    if not clusters:
        rows = checkpointed(rows.select("gid", "score", "y", "cls", "h"))  # read again for each step of the search
        units = rows.select("gid", "cls", "h")
    if members is not None:
        units = _units(_named(members.where(F.col("y").isNotNull()), by)[0].withColumn("cls", F.col("y")), key, seed, False)[1]
    out = None
    order = ["gid", "score", "h"]
    for some, draws in _drawn(rows.select("gid", "score", "y", "cls", "h"), units, resamples):
        shared = rows.sparkSession.sparkContext.broadcast(draws)
        ranged = some.repartitionByRange(partitions_for(rows.sparkSession), *order).sortWithinPartitions(*order)
        sums = ranged.mapInArrow(_segments(shared, resamples, len(sides)), _SEGMENT)
        found = sums.groupBy("gid", "side", "block").applyInArrow(_combined, "gid long, side int, r long, auroc double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "gid long, side int, r long, auroc double")
    told = [F.element_at(F.array(*[F.lit(c) for c in sides]), F.col("side") + 1).alias("label")] if labels else []
    return out.join(names, "gid").select(*by, *told, "r", "auroc")


def _vectors(shared: Broadcast, resamples: int):
    def told(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tolist() for x in found.values()], pa.list_(pa.int64()))], names=["cell", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        step = max(1, _CELLS // max(1, resamples))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, inverse = np.unique(part.column("cell").to_numpy(), return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                w = shared.value.weights(part.column("gid").to_numpy(), part.column("cls").to_numpy(), hashes(part.column("h")))[order].astype(np.int64)
                sums = np.add.reduceat(w, np.searchsorted(inverse[order], np.arange(len(ids))), axis=0)
                for i, x in zip(ids.tolist(), sums, strict=True):
                    found[i] = found[i] + x if i in found else x
                if len(found) * resamples > _MOST:
                    yield told(found)
                    found = {}
        if found:
            yield told(found)

    return run


def weighted_counts(df: DataFrame, resamples: int, seed: int, by: list[str], key: str = "qid") -> DataFrame:
    """(r, by, w): rows of each ``by`` in each resample of all rows, those of no draw left out; a task sums its rows first."""
    rows, names = _named(df, by)
    rows = rows.select(F.lit(0).cast("long").alias("gid"), F.lit(0).alias("cls"), F.col("gid").alias("cell"), unit_hash(seed, F.col(key)).alias("h"))
    units = rows.select("gid", "cls", "h")
    shared = df.sparkSession.sparkContext.broadcast(draws_of(units, classes(units), resamples))
    sums = rows.mapInArrow(_vectors(shared, resamples), "cell long, w array<long>")
    each = sums.select(F.col("cell").alias("gid"), F.posexplode("w").alias("r", "w")).where("w > 0").groupBy("gid", "r").agg(F.sum("w").alias("w"))
    return each.join(names, "gid").select(F.col("r").cast("long").alias("r"), *by, "w")


def _part_sums(shared: Broadcast, first: int, until: int):
    """For each group of a sorted partition: its first and last tie group, and the sums of what lies between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Key] = {}
        for g, score, y, w in _runs(shared.value, batches, first, until):
            if g not in found:
                found[g] = _Key(until - first)
            found[g].add(score, y, w)
        rows = [(g, kind, score, pos, neg) for g, key in found.items() for kind, score, pos, neg, _ in key.rows()]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), *[pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (3, 4)]]
        yield pa.RecordBatch.from_arrays(columns, names=["gid", "part", "kind", "score", "pos", "neg"])

    return run


class _Precision(_Ties):
    """Precision at each tie group between the first and the last of a partition, weighted by positives."""

    def __init__(self, tp: np.ndarray, fp: np.ndarray) -> None:
        super().__init__()
        self.tp, self.fp, self.sum = tp.copy(), fp.copy(), np.zeros_like(tp)
        self.product = np.zeros_like(tp)

    def inner(self, pos: np.ndarray | None, neg: np.ndarray | None) -> None:
        if neg is not None:
            self.fp += neg
        if pos is not None:
            self.tp += pos
            at = np.multiply(pos, self.tp, out=self.product)
            at /= np.maximum(self.tp + self.fp, 1)
            self.sum += at


def _precisions(shared: Broadcast, before: Broadcast, first: int, until: int):
    """Sums of precision of a task's partition, from what stands before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = TaskContext.get().partitionId(), before.value
        found: dict[int, _Precision] = {}
        for g, score, y, w in _runs(shared.value, batches, first, until):
            if g not in found:
                found[g] = _Precision(*known[part, g])
            found[g].add(score, y, w)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([p.sum.tolist() for p in found.values()], pa.list_(pa.float64()))], names=["gid", "precision"])

    return run


def _prefixes(rows: list, width: int) -> tuple[dict, dict]:
    """What stands before each partition's inner tie groups, and the precision that groups at partitions' edges add.

    ``rows`` are the parts' sums in the order of scores; a tie group that
    reaches over parts counts at its end.
    """
    before: dict[tuple[int, int], tuple] = {}
    edges: dict[int, list] = {}
    for r in rows:
        pos, neg = (np.frombuffer(bytes(r[c])) for c in ("pos", "neg"))
        tp, fp, tie, total = edges.get(r["gid"], (np.zeros(width), np.zeros(width), None, np.zeros(width)))
        if r["kind"] != 1 and tie is not None and tie[0] == r["score"]:
            tie = (tie[0], tie[1] + pos, tie[2] + neg)
        else:
            if tie is not None:
                tp, fp = tp + tie[1], fp + tie[2]
                total, tie = total + tie[1] * tp / np.maximum(tp + fp, 1), None
            if r["kind"] == 1:
                before[r["part"], r["gid"]] = (tp, fp)
                tp, fp = tp + pos, fp + neg
            else:
                tie = (r["score"], pos, neg)
        before.setdefault((r["part"], r["gid"]), (tp, fp))
        edges[r["gid"]] = (tp, fp, tie, total)
    ends = {}
    for g, (tp, fp, tie, total) in edges.items():
        if tie is not None:
            tp, fp = tp + tie[1], fp + tie[2]
            total = total + tie[1] * tp / np.maximum(tp + fp, 1)
        ends[g] = (total, tp)
    return before, ends


def average_precision_draws(scores: DataFrame, resamples: int, seed: int, by: list[str], key: str = "qid", *, clusters: bool = False) -> DataFrame:
    """(by, r, average_precision), undefined ones left out, in two passes over sorted rows.

    The first pass leaves the drawn positives and negatives of each range
    partition, the second starts from the sums before its partition and adds the
    precision at each tie. Resamples go in blocks, so that the partitions' sums
    can be gathered and broadcast whatever their number; no draw is ever a row.
    """
    spark = scores.sparkSession
    rows, names = _named(rated(scores), by)
    keep = ["gid", (-F.col("score").cast("double")).alias("score"), F.col("y").cast("int").alias("y"), F.col("y").alias("cls"), *dict.fromkeys([key, *(["qid"] if clusters else [])])]
    rows, units = _units(rows.select(*keep), key, seed, clusters)
    stored = range_sorted(rows.select("gid", "score", "y", "cls", "h"), ["gid", "score", "h"])
    units = units if clusters else stored.select("gid", "cls", "h")
    parts = stored.select("gid", F.spark_partition_id().alias("part")).distinct().count()  # a row per group and partition
    width = max(1, min(resamples, _MOST // max(1, parts) // 8))
    out = None
    for some, draws in _drawn(stored, units, resamples):
        shared = spark.sparkContext.broadcast(draws)
        for first in range(0, resamples, width):
            until = min(resamples, first + width)
            sums = some.mapInArrow(_part_sums(shared, first, until), "gid long, part int, kind int, score double, pos binary, neg binary").collect()  # up to _MOST numbers
            before, ends = _prefixes(sorted(sums, key=lambda r: (r["part"], r["kind"])), until - first)
            carried = spark.sparkContext.broadcast(before)
            inner = some.mapInArrow(_precisions(shared, carried, first, until), "gid long, precision array<double>")
            edges = spark.createDataFrame([(g, total.tolist(), tp.tolist()) for g, (total, tp) in ends.items()], "gid long, precision array<double>, positives array<double>")
            both = inner.withColumn("positives", F.lit(None).cast("array<double>")).unionByName(edges)
            each = both.select("gid", F.posexplode(F.arrays_zip("precision", F.coalesce("positives", F.transform("precision", lambda _: F.lit(0.0))).alias("positives"))).alias("r", "v")).groupBy("gid", "r").agg(F.sum("v.precision").alias("s"), F.sum("v.positives").alias("p"))
            found = each.where("p > 0").select("gid", (F.col("r") + first).cast("long").alias("r"), (F.col("s") / F.col("p")).alias("average_precision"))
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "gid long, r long, average_precision double")
    return out.join(names, "gid").select(*by, "r", "average_precision")


def interval(draws: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of a resampled statistic; undefined draws do not count."""
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return draws.where(F.col(value).isNotNull()).groupBy(*keys).agg(q.alias("_q"), F.count(F.lit(1)).alias("resamples")).select(*keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "resamples")


def _with_point(point: DataFrame, ci: DataFrame, keys: list[str]) -> DataFrame:
    return point.join(ci, keys, "left").fillna(0, ["resamples"])


def bootstrap_auroc(scores: DataFrame, resamples: int, seed: int, *, level: float = 0.95, clusters: bool = False) -> DataFrame:
    """Per signal: point, interval and defined resamples; with ``clusters`` whole clusters (``cluster_id``) are drawn."""
    draws = auroc_draws(scores, resamples, seed, ["signal"], "cluster_id" if clusters else "qid", clusters=clusters)
    return _with_point(auroc_from(histogram(scores, ["signal"]), ["signal"]), interval(draws, ["signal"], "auroc", level), ["signal"])


def bootstrap_average_precision(scores: DataFrame, resamples: int, seed: int, *, level: float = 0.95, clusters: bool = False) -> DataFrame:
    point = average_precision_from(histogram(scores, ["signal"]), ["signal"])
    draws = average_precision_draws(scores, resamples, seed, ["signal"], "cluster_id" if clusters else "qid", clusters=clusters)
    both = _two_classes(scores)
    return _with_point(point, interval(draws.join(both, "signal"), ["signal"], "average_precision", level), ["signal"])


def _two_classes(scores: DataFrame) -> DataFrame:
    """Signals whose rated rows are of both classes; others have no interval."""
    return rated(scores).groupBy("signal").agg(F.bool_or("y").alias("_yes"), F.bool_and("y").alias("_all")).where("_yes and not _all").select("signal")


def bootstrap_by_stratum(scores: DataFrame, stratum: str, resamples: int, seed: int, *, level: float = 0.95) -> DataFrame:
    """AUROC and interval within each stratum; ``excludes_chance`` is null where the interval is undefined."""
    keys = [stratum, "signal"]
    draws = auroc_draws(scores, resamples, seed, keys)
    out = _with_point(auroc_from(histogram(scores, keys), keys), interval(draws, keys, "auroc", level), keys)
    return out.withColumn("excludes_chance", (F.col("ci_low") > 0.5) | (F.col("ci_high") < 0.5))


def contrast_tests(scores: DataFrame, contrasts: list[tuple[str, str, str]], resamples: int, seed: int, *, level: float = 0.95, arm: str = "signal", clusters: bool = False) -> DataFrame:
    """Per contrast (name, arm, reference arm): AUROC of the arm less that of the reference on rows that both have.

    All contrasts come from one table of draws: scores meet by row once, arms
    are drawn once for each distinct set of rows that some contrast compares,
    and differences are taken resample by resample. Both sides of a contrast have
    the same draws; the p-value is the two-sided achieved level.
    """
    spark = scores.sparkSession
    unit = "cluster_id" if clusters else "qid"
    keep = ["qid", "y", *(["cluster_id"] if clusters else [])]
    wide = rated(scores).groupBy(*keep).agg(F.map_from_entries(F.collect_list(F.struct(F.col(arm).alias("arm"), F.col("score").cast("double").alias("score")))).alias("m"))  # a score per arm
    wide = checkpointed(wide)
    has = lambda name: F.coalesce(F.map_contains_key("m", F.lit(name)), F.lit(False))
    there = F.filter(F.array(*[F.when(has(a) & has(b), F.lit(i)) for i, (_, a, b) in enumerate(contrasts)]), lambda i: i.isNotNull())
    each = wide.select("qid", F.explode(there).alias("c"))
    prints = each.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("qid").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "qid").cast("decimal(38,0)")).alias("b")).collect()  # a row per contrast
    sets: dict[tuple, int] = {}
    jobs: dict[tuple, int] = {}
    told = []
    for r in sorted(prints, key=lambda r: r["c"]):
        c = r["c"]
        of = sets.setdefault((r["n"], r["a"], r["b"]), c)  # the first contrast of these rows stands for the others
        told.append((contrasts[c][0], r["n"], *[jobs.setdefault((name, of), len(jobs)) for name in contrasts[c][1:]]))
    shape = "contrast string, delta double, ci_low double, ci_high double, p_value double, n_paired long, resamples long"
    if not told:
        return spark.createDataFrame([], shape)
    arms = [F.when(has(contrasts[of][1]) & has(contrasts[of][2]), F.struct(F.lit(j).alias("job"), F.element_at("m", F.lit(name)).alias("score"))) for (name, of), j in jobs.items()]
    rows = wide.select(*keep, F.explode(F.filter(F.array(*arms), lambda x: x.isNotNull())).alias("x")).select(*keep, "x.*")
    table = F.broadcast(spark.createDataFrame(told, "contrast string, n_paired long, _a int, _b int"))  # a row per contrast

    def less(values: DataFrame, *by: str) -> DataFrame:
        a, b = (values.select(F.col("job").alias(x), *by, F.col("auroc").alias(f"{x}_value")) for x in ("_a", "_b"))
        return table.join(a, "_a").join(b, ["_b", *by]).select("contrast", *by, "n_paired", (F.col("_a_value") - F.col("_b_value")).alias("d"))

    point = less(auroc_from(histogram(rows, ["job"]), ["job"])).withColumnRenamed("d", "delta")
    drawn = checkpointed(auroc_draws(rows, resamples, seed, ["job"], unit, clusters=clusters))  # a row per arm and resample
    draws = less(drawn, "r").where("d is not null").select("contrast", "r", "d")
    tails = draws.join(point.select("contrast", "delta"), "contrast").groupBy("contrast").agg(
        F.sum(F.when(F.col("delta") >= 0, F.col("d") <= 0).otherwise(F.col("d") >= 0).cast("long")).alias("tail"), F.count(F.lit(1)).alias("total")
    )
    p = F.least(F.lit(1.0), 2.0 * (F.col("tail") + 1) / (F.col("total") + 1))
    joined = point.join(interval(draws, ["contrast"], "d", level), "contrast", "left").join(tails, "contrast", "left")
    return joined.select("contrast", "delta", "ci_low", "ci_high", p.alias("p_value"), "n_paired", F.coalesce("resamples", F.lit(0)).cast("long").alias("resamples"))


def paired_auroc_diff(scores: DataFrame, reference: str, resamples: int, seed: int, *, level: float = 0.95, clusters: bool = False) -> DataFrame:
    """Every other signal less the reference on rows that both have, on the same draws."""
    others = [r[0] for r in rated(scores).select("signal").distinct().orderBy("signal").collect() if r[0] != reference]  # a row per signal
    return contrast_tests(scores, [(s, s, reference) for s in others], resamples, seed, level=level, clusters=clusters).withColumnRenamed("contrast", "signal")


def _weighted(each: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the defined AUROCs of the strata by weight."""
    known = F.when(F.col("auroc").isNotNull(), F.col("weight"))
    return each.groupBy(*by).agg(F.try_divide(F.sum(F.col("auroc") * F.col("weight")), F.sum(known).cast("double")).alias("auroc"))


def stratified_auroc(scores: DataFrame, stratum: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of the strata's AUROCs, weighted by their numbers of rows (usable or not); undefined ones do not count."""
    keys = keys or ["signal"]
    size = scores.where(F.col("y").isNotNull()).groupBy(stratum).agg(F.countDistinct("qid").alias("weight"))
    return _weighted(auroc_from(histogram(scores, [*keys, stratum]), [*keys, stratum]).join(size, stratum), keys)


def bootstrap_stratified(scores: DataFrame, stratum: str, resamples: int, seed: int, *, level: float = 0.95) -> DataFrame:
    """Interval of the stratified AUROC on one draw for all signals.

    Positives and negatives of each stratum are drawn separately, from all its
    rows; a signal takes its usable ones. A stratum of one class leaves no
    resample defined.
    """
    base = scores.where(F.col("y").isNotNull())
    rows = base.select(stratum, "qid", "y").distinct()
    size = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("weight"), (F.bool_or("y") & ~F.bool_and("y")).alias("_both"))
    members = rows.crossJoin(F.broadcast(base.select("signal").distinct()))  # a row per signal
    each = auroc_draws(scores, resamples, seed, ["signal", stratum], members=members).join(size, stratum)
    whole = size.agg(F.bool_and("_both").alias("_whole"))
    draws = _weighted(each, ["r", "signal"]).crossJoin(F.broadcast(whole)).where("_whole")  # one row
    weights = size.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(stratum, "weight")))).alias("weights"))
    out = _with_point(stratified_auroc(scores, stratum), interval(draws, ["signal"], "auroc", level), ["signal"])
    return out.crossJoin(F.broadcast(weights))  # one row


def bootstrap_kappa(df: DataFrame, a: str, b: str, resamples: int, seed: int, *, level: float = 0.95, key: str = "qid") -> DataFrame:
    """Kappa with a percentile interval over row resamples; undefined draws do not count."""
    from quillon.operators.labels import cohens_kappa, kappa_from

    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != "") & (F.col(b) != ""))
    cells = weighted_counts(both, resamples, seed, [a, b], key).withColumnRenamed("w", "cell")
    draws = kappa_from(cells, ["r"], a, b, "cell")
    point = cohens_kappa(both, a, b)
    return point.crossJoin(F.broadcast(interval(draws, [], "kappa", level)))  # one row each


def bootstrap_rule_accuracy(df: DataFrame, predicted: Column, actual: Column, resamples: int, seed: int, *, level: float = 0.95, key: str = "qid") -> DataFrame:
    """Precision and recall of a rule with row-bootstrap intervals."""
    from quillon.operators.metrics import rule_accuracy

    both = df.where(predicted.isNotNull() & actual.isNotNull()).select(key, predicted.alias("_p"), actual.alias("_a"))
    sums = weighted_counts(both, resamples, seed, ["_p", "_a"], key).groupBy("r").agg(*[F.sum(F.when(c, F.col("w")).otherwise(0)).alias(n) for n, c in (("tp", F.col("_p") & F.col("_a")), ("fp", F.col("_p") & ~F.col("_a")), ("fn", ~F.col("_p") & F.col("_a")))])
    draws = sums.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    out = rule_accuracy(both, F.col("_p"), F.col("_a"))
    for m in ("precision", "recall"):
        ci = interval(draws, [], m, level).select(F.col("ci_low").alias(f"{m}_low"), F.col("ci_high").alias(f"{m}_high"))
        out = out.crossJoin(F.broadcast(ci))  # one row
    return out


def holm(df: DataFrame, p: str = "p_value", position: str = "position", keys: list[str] | None = None, name: str = "p_holm", alpha: float = 0.05, *, spread: int = 1) -> DataFrame:
    """Step-down adjusted p-values; nulls stay out of the family.

    With ``spread`` over 1 a large family is adjusted by that many ranges of
    p-values: equal ones share the value of their first, so the number of
    smaller ones and a running maximum over distinct p-values are enough.
    """
    keys = keys or []
    family = df.where(F.col(p).isNotNull())
    rest = df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double"))
    significant = F.coalesce(F.col(name) <= alpha, F.lit(False))
    if spread > 1:
        hist = family.groupBy(*keys, F.col(p).alias("score")).agg(F.count(F.lit(1)).alias("n"))
        sized = _join(running(hist, keys, ["n"], spread=spread), hist.groupBy(*keys).agg(F.sum("n").alias("_m")), keys)
        raw = sized.withColumn("_raw", (F.col("_m") - F.col("n_before")) * F.col("score"))
        steps = running_max(raw, keys, "_raw", "_up", spread=spread).select(*keys, F.col("score").alias(p), F.least(F.lit(1.0), F.col("_up")).alias(name))
        return _join(family, steps, [*keys, p]).unionByName(rest).withColumn(f"significant_{name}", significant)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(p, position))
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = family.withColumns({"_rn": rn, "_m": m}).withColumn("_raw", (F.col("_m") - F.col("_rn") + 1) * F.col(p))
    up = F.max("_raw").over(Window.partitionBy(*keys).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0))
    adjusted = raw.withColumn(name, F.least(F.lit(1.0), up)).drop("_rn", "_m", "_raw")
    return adjusted.unionByName(rest).withColumn(f"significant_{name}", significant)


def label_delta(scores: DataFrame, y_old: str, y_new: str, resamples: int, seed: int, *, level: float = 0.95) -> DataFrame:
    """AUROC under new labels less that under old ones, on the same draws: as many of each new class as there are."""
    both = F.col(y_old).isNotNull() & F.col(y_new).isNotNull() & usable(F.col("score"))
    rows = scores.where(both).select("qid", "signal", "score", F.col(y_old).alias("old"), F.col(y_new).alias("new"), F.col(y_new).alias("y"))
    of = lambda c: auroc_from(histogram(rows.withColumn("y", F.col(c)), ["signal"]), ["signal"]).select("signal", F.col("auroc").alias(f"auroc_{c}"))
    point = of("old").join(of("new"), "signal").withColumn("delta", F.col("auroc_new") - F.col("auroc_old"))
    drawn = auroc_draws(rows, resamples, seed, ["signal"], labels=["old", "new"])
    one = lambda c: F.max(F.when(F.col("label") == c, F.col("auroc")))
    draws = drawn.groupBy("r", "signal").agg((one("new") - one("old")).alias("delta"))
    return _with_point(point, interval(draws, ["signal"], "delta", level), ["signal"])
