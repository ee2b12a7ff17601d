"""Draws with replacement in classes of fixed size, made where the rows lie.

Each unit (a row, or a cluster of rows) has arrivals on a time axis: a Poisson
process of rate one, read from a hash of seed, unit and resample. The first n
arrivals of a class of n units fall on units that are independent and uniform:
they are n draws with replacement. So a resample is known from one number for
each class, the time of its n-th arrival, whatever the partitions are: a task
that holds a row counts the row's arrivals up to that time.

The n-th arrivals are found together for all resamples by histograms that narrow
down; arrivals before a time that surely comes first are only counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranges import partitions_for

#: Increment and multipliers of the splitmix64 generator.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Most arrivals of a unit that can be told apart by hash.
STRIDE = 256
TIME_BITS = 62
#: A class's n-th arrival falls outside the window with a probability of exp(-RISK); such a draw is undefined.
RISK = 25
_CELLS = 1 << 16  # numbers that are made at a time; they stay in a core's cache
_DENSE = 24
_NUMBERS = 1 << 21  # counts that are gathered at a time
_TIMES = 1 << 20  # arrivals that are gathered at a time


@cache
def limits(power: int) -> tuple[list[int], list[int]]:
    """For classes of 2^power units and up to twice as many: limits of 32-bit numbers for the arrivals before the window and in it.

    A number stands for as many arrivals as limits it reaches.
    """
    n = 1 << power
    before = max(0.0, 1 - math.sqrt(2 * RISK / n))
    until = (n + RISK + math.sqrt(RISK * RISK + 2 * RISK * n)) / n
    return _poisson(before), _poisson(until - before)


def _poisson(rate: float) -> list[int]:
    found, term, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += term
        limit = round(2**32 * total)
        if limit >= 2**32 or k > STRIDE:
            return found
        found.append(limit)
        k += 1
        term *= rate / k


@lru_cache(8)
def _room(units: int, resamples: int) -> tuple[np.ndarray, ...]:
    """Arrays that a task fills again and again: fresh ones cost more than the numbers in them."""
    shape = units, resamples
    return np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.empty(shape, np.uint32), np.empty(shape, bool)


@lru_cache(8)
def _steps(first: int, until: int) -> np.ndarray:
    """What the generator adds for each of some resamples in a row."""
    return np.uint64(GOLDEN) * (np.arange(first, until, dtype=np.uint64) + np.uint64(1))


def mixed(x: np.ndarray, shifted: np.ndarray | None = None) -> np.ndarray:
    """The splitmix64 finaliser, in place; ``shifted`` is room of the same shape."""
    shifted = np.empty_like(x) if shifted is None else shifted
    for shift, factor in ((30, FIRST), (27, SECOND)):
        x ^= np.right_shift(x, np.uint64(shift), out=shifted)
        x *= np.uint64(factor)
    x ^= np.right_shift(x, np.uint64(31), out=shifted)
    return x


def unit_hash(seed: int, key: Column) -> Column:
    """Sixteen bytes that a unit's draws come from; a null key counts as empty."""
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))))


def hashes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)


def _reached(x: np.ndarray, bounds: list[int], reached: np.ndarray) -> np.ndarray:
    """How many of the bounds each number reaches: those that over 1 % reach for all numbers, the others for the few that may."""
    dense = sum(b < 0.99 * 2**32 for b in bounds)
    if dense > _DENSE:
        return np.searchsorted(np.array(bounds, np.uint32), x, side="right").astype(np.uint8)
    out = np.zeros(x.shape, np.uint8)
    for b in bounds[:dense]:
        out += np.greater_equal(x, np.uint32(b), out=reached).view(np.uint8)
    if dense < len(bounds):
        at = np.flatnonzero(np.greater_equal(x, np.uint32(bounds[dense]), out=reached))
        out.reshape(-1)[at] += np.searchsorted(np.array(bounds[dense:], np.uint32), x.reshape(-1)[at], side="right").astype(np.uint8)
    return out


def arrivals(h: np.ndarray, power: int, resamples: np.ndarray, *, only_inside: bool = False) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Arrivals before the window (units x resamples; none with ``only_inside``); places (in that order) and times of those in it."""
    before, inside = limits(power)
    n = len(resamples)
    in_row = n > 0 and int(resamples[-1]) - int(resamples[0]) == n - 1  # resamples ascend
    steps = _steps(int(resamples[0]), int(resamples[0]) + n) if in_row else np.uint64(GOLDEN) * (resamples + np.uint64(1))
    z, other, half, reached = _room(len(h), n)
    mixed(np.add(h[:, :1], steps, out=z), other)
    k = None
    if not only_inside:
        np.copyto(half, np.right_shift(z, np.uint64(32), out=other), casting="unsafe")
        k = _reached(half, before, reached)
    np.copyto(half, z, casting="unsafe")  # the low half
    at = np.flatnonzero(np.greater_equal(half, np.uint32(inside[0]), out=reached))
    left, places, times = np.searchsorted(np.array(inside, np.uint32), half.reshape(-1)[at], side="right"), [], []
    row, col = np.divmod(at, max(1, n))
    start = h[row, 1] + np.uint64(GOLDEN) * (resamples[col] * np.uint64(STRIDE) + np.uint64(1))
    j = 0
    while len(at):
        places.append(at)
        times.append(mixed(start + np.uint64(GOLDEN * j % 2**64)) >> np.uint64(64 - TIME_BITS))
        j += 1
        more = left > j
        at, left, start = at[more], left[more], start[more]
    return k, np.concatenate(places) if places else at, np.concatenate(times) if times else at.astype(np.uint64)


@dataclass
class Draws:
    """The classes of some groups and the time of the last arrival that each resample takes of them."""

    of: dict[tuple[int, int], int]  # (group, class) -> row of ``last``
    power: list[int]
    last: np.ndarray  # classes x resamples

    def weights(self, gid: np.ndarray, cls: np.ndarray, h: np.ndarray, first: int = 0, until: int | None = None) -> np.ndarray:
        """How often each row is drawn in each of the resamples ``first`` to ``until``."""
        some = np.arange(first, self.last.shape[1] if until is None else until, dtype=np.uint64)
        out = np.zeros((len(gid), len(some)), np.uint8)
        kinds, which = np.unique(np.stack([gid, cls.astype(np.int64)], axis=1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        for i, (g, c) in enumerate(kinds.tolist()):
            u = self.of[g, c]
            rows = np.flatnonzero(which == i)
            last = self.last[u, first : first + len(some)]
            defined = bool((last > 0).all())
            step = max(1, _CELLS // max(1, len(some)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                k, place, time = arrivals(h[part], self.power[u], some)
                np.add.at(k.reshape(-1), place[time <= last[place % max(1, len(some))]], np.uint8(1))
                out[part] = k if defined else np.where(last > 0, k, 0)  # an undefined draw takes nothing
        return out


def _per_class(shared: dict, inside: bool):
    """Histograms of the arrivals in the current bins, or their times; both of the resamples still open."""
    bins = shared["bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            us, all_h = batch.column("u").to_numpy(), hashes(batch.column("h"))
            for u in np.unique(us).tolist():
                job = shared["jobs"][u]
                some, lo, span = job["resamples"], job["lo"], job["span"]
                width = np.maximum(span // np.uint64(bins), np.uint64(1))
                h = all_h[us == u]
                total = counts.setdefault(u, np.zeros((len(some), bins + 1), np.int64)) if not inside else None
                step = max(1, _CELLS // max(1, len(some)))
                for at in range(0, len(h), step):
                    k, place, time = arrivals(h[at : at + step], job["power"], some, only_inside=not shared["first"])
                    r = place % max(1, len(some))
                    over = time - lo[r]  # what lies below wraps around
                    hit = over < (span[r] if inside else width[r] * np.uint64(bins))
                    if inside:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hit.sum()), u, np.int32)), pa.array(r[hit].astype(np.int32)), pa.array(time[hit].astype(np.int64))], names=["u", "r", "time"])
                    else:
                        if k is not None:
                            total[:, 0] += k.sum(axis=0, dtype=np.int64)
                        np.add.at(total.reshape(-1), r[hit] * (bins + 1) + 1 + (over[hit] // width[r[hit]]).astype(np.int64), 1)
        if not inside:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], names=["u", "counts"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = 0
    for counts in table.column("counts"):
        total = total + np.frombuffer(counts.as_buffer(), np.int64)
    return pa.table({"u": table.column("u")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def classes(units: DataFrame) -> list[dict]:
    """Groups and classes of units (gid, cls, h): their sizes, and a number for each distinct set of units."""
    a, b = F.xxhash64("h"), F.xxhash64(F.lit(1), "h")
    rows = units.groupBy("gid", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(a.cast("decimal(38,0)")).alias("a"), F.sum(b.cast("decimal(38,0)")).alias("b")).collect()  # a row per group and class
    known: dict[tuple, int] = {}
    return [{"gid": r["gid"], "cls": int(r["cls"]), "n": r["n"], "set": known.setdefault((r["n"], r["a"], r["b"]), len(known))} for r in sorted(rows, key=lambda r: (r["gid"], r["cls"]))]


def draws_of(units: DataFrame, found: list[dict], resamples: int) -> Draws:
    """The last arrivals of the classes in ``found``; groups of the same units share theirs."""
    spark = units.sparkSession
    sets = {f["set"]: f for f in reversed(found)}
    index = {s: u for u, s in enumerate(sorted(sets))}
    size, power = [sets[s]["n"] for s in sorted(sets)], [sets[s]["n"].bit_length() - 1 for s in sorted(sets)]
    told = [(sets[s]["gid"], sets[s]["cls"], index[s]) for s in sorted(sets)]
    last = np.zeros((len(told), resamples), np.uint64)
    if told and resamples:
        rows = units.withColumn("cls", F.col("cls").cast("int")).join(F.broadcast(spark.createDataFrame(told, "gid long, cls int, u int")), ["gid", "cls"]).select("u", "h")
        rows = rows.repartition(partitions_for(spark), "h")  # a row stands for many draws
        step = max(1, _NUMBERS // (4 * resamples))
        for at in range(0, len(told), step):
            some = list(range(at, min(at + step, len(told))))
            _search(rows, some, size, power, last, resamples)
    return Draws({(f["gid"], f["cls"]): index[f["set"]] for f in found}, power, last)


def _search(rows: DataFrame, some: list[int], size: list[int], power: list[int], last: np.ndarray, resamples: int) -> None:
    bins = 1 << min(8, max(2, (_NUMBERS // (len(some) * resamples)).bit_length() - 1))
    whole = np.uint64(1 << TIME_BITS)
    jobs = {u: {"resamples": np.arange(resamples, dtype=np.uint64), "lo": np.zeros(resamples, np.uint64), "span": np.full(resamples, whole), "need": np.full(resamples, size[u], np.int64), "power": power[u]} for u in some}
    first, waiting = True, 0
    while jobs:
        mine = rows.where(F.col("u").isin(list(jobs)))
        if waiting <= _TIMES and not first:
            got = mine.mapInArrow(_per_class({"bins": bins, "jobs": jobs, "first": False}, True), "u int, r int, time long").toArrow()
            u_, r_, t_ = (got.column(c).to_numpy() for c in ("u", "r", "time"))
            order = np.lexsort((t_, r_, u_))
            u_, r_, t_ = u_[order], r_[order], t_[order]
            for u, job in jobs.items():
                own = u_ == u
                begin = np.searchsorted(r_[own], np.arange(len(job["resamples"])))
                last[u, job["resamples"].astype(np.int64)] = t_[own][begin + job["need"] - 1].astype(np.uint64)
            return
        counted = mine.mapInArrow(_per_class({"bins": bins, "jobs": jobs, "first": first}, False), "u int, counts binary").groupBy("u").applyInArrow(_summed, "u int, counts binary").collect()
        waiting = 0
        for row in counted:
            job = jobs[row["u"]]
            n = np.frombuffer(bytes(row["counts"]), np.int64).reshape(-1, bins + 1)
            need = job["need"] - (n[:, 0] if first else 0)
            so_far = np.cumsum(n[:, 1:], axis=1)
            defined = (need >= 1) & (so_far[:, -1] >= need)
            b = np.where(defined, (so_far < need[:, None]).sum(axis=1), 0)
            each = np.arange(len(b))
            need = need - np.where(b > 0, so_far[each, b - 1], 0)
            width = np.maximum(job["span"] // np.uint64(bins), np.uint64(1))
            lo = job["lo"] + b.astype(np.uint64) * width
            inside = n[each, b + 1]
            done = defined & (need == inside)
            last[row["u"], job["resamples"][done].astype(np.int64)] = lo[done] + width[done] - np.uint64(1)
            rest = defined & ~done
            waiting += int(inside[rest].sum())
            jobs[row["u"]] = {"resamples": job["resamples"][rest], "lo": lo[rest], "span": width[rest], "need": need[rest], "power": job["power"]}
        jobs = {u: j for u, j in jobs.items() if len(j["resamples"])}
        first = False
