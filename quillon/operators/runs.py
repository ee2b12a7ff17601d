"""Runs of failed calls by judge, over tables of any size and over streams.

The rows of a judge in one range partition are summed up as a run-length state:
the run they begin with, the run they end with, and where the limit is reached
within them. States join in order, so no task sees all rows of a judge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.ranges import range_sorted


class RunState:
    """Rows of one judge in order: ``prefix`` are the places of the run they begin with, as far as the limit needs them."""

    def __init__(self, most: int) -> None:
        self.most, self.rows, self.run, self.stop = most, 0, 0, None
        self.prefix: list = []
        self.unbroken = True

    def add(self, failed: np.ndarray, places: pa.Array) -> None:
        at = np.arange(len(failed))
        last_ok = np.maximum.accumulate(np.where(failed, -1, at))
        run = np.where(last_ok >= 0, at - last_ok, at + 1 + self.run)
        if self.stop is None and len(hit := np.flatnonzero(run >= self.most)):
            self.stop = places[int(hit[0])].as_py()
        if self.unbroken:
            ok = np.flatnonzero(~failed)
            end = int(ok[0]) if len(ok) else len(failed)
            self.prefix += places[: min(end, self.most - len(self.prefix))].to_pylist()
            self.unbroken = not len(ok)
        self.rows += len(failed)
        self.run = int(run[-1]) if len(run) else self.run


def _states(most: int):
    def told(judge: str | None, s: RunState) -> dict:
        return {"judge": judge, "part": TaskContext.get().partitionId(), "rows": s.rows, "prefix": s.prefix, "unbroken": s.unbroken, "run": s.run, "stop": s.stop}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, state, first = None, None, True
        shape = None
        for batch in batches:
            names, failed, places = batch.column("judge").to_numpy(zero_copy_only=False), batch.column("failed").to_numpy(zero_copy_only=False), batch.column("place")
            shape = shape or pa.schema([("judge", pa.string()), ("part", pa.int32()), ("rows", pa.int64()), ("prefix", pa.list_(places.type)), ("unbroken", pa.bool_()), ("run", pa.int64()), ("stop", places.type)])
            cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                if first or names[a] != judge:
                    if state is not None:
                        yield pa.RecordBatch.from_pylist([told(judge, state)], shape)
                    judge, state, first = names[a], RunState(most), False
                state.add(failed[a:b].astype(bool), places.slice(a, b - a))
        if state is not None:
            yield pa.RecordBatch.from_pylist([told(judge, state)], shape)

    return run


def _joined(most: int):
    """The first stop of a judge from the states of its partitions, in order."""

    def run(table: pa.Table) -> pa.Table:
        carried, stop = 0, None
        for r in table.sort_by("part").to_pylist():  # a row per partition
            need = max(1, most - carried)
            if len(r["prefix"]) >= need and carried + len(r["prefix"]) >= most:
                stop = r["prefix"][need - 1]
            elif r["stop"] is not None:
                stop = r["stop"]
            if stop is not None:
                break
            carried = carried + r["rows"] if r["unbroken"] else r["run"]
        names = table.column("judge")[:1]
        return pa.table({"judge": names if stop is not None else names[:0], "stopped_at": pa.array([stop] if stop is not None else [], table.schema.field("stop").type)})

    return run


def first_stops(replies: DataFrame, order: str, most: int = 5) -> DataFrame:
    """(judge, stopped_at): where a run of failed calls first reaches ``most``, by ``order``; judges without such a run have no row.

    A null ``failed`` is no failure. One shuffle by (judge, order); what meets by
    judge is a row per partition.
    """
    kind = replies.schema[order].dataType.simpleString()
    rows = replies.select(F.col("judge").cast("string").alias("judge"), F.col(order).alias("place"), F.coalesce("failed", F.lit(False)).alias("failed"))
    states = range_sorted(rows, ["judge", "place"]).mapInArrow(_states(most), f"judge string, part int, rows long, prefix array<{kind}>, unbroken boolean, run long, stop {kind}")
    return states.groupBy("judge").applyInArrow(_joined(most), f"judge string, stopped_at {kind}")


class Breaker(StatefulProcessor):
    """The run of each judge so far, and whether it has stopped; survives restarts with the query's checkpoint."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "run long, stopped boolean")

    def handleInputRows(self, key, rows, timerValues):
        run, stopped = self.state.get() if self.state.exists() else (0, False)
        if not stopped:
            batch = pd.concat(list(rows)).sort_values("place")  # a judge's rows of one trigger
            failed = batch["failed"].fillna(False).to_numpy(bool)
            at = np.arange(len(failed))
            last_ok = np.maximum.accumulate(np.where(failed, -1, at))
            runs = np.where(last_ok >= 0, at - last_ok, at + 1 + run)
            hit = np.flatnonzero(runs >= self.most)
            run, stopped = int(runs[-1]), bool(len(hit))
            self.state.update((run, stopped))
            if stopped:
                yield pd.DataFrame({"judge": [key[0]], "stopped_at": [batch["place"].iloc[int(hit[0])]]})

    def close(self) -> None:
        pass


def stops_of_stream(replies: DataFrame, order: str, most: int = 5) -> DataFrame:
    """The same as a stream of stops: a judge comes out once, in the trigger in which its run reaches ``most``.

    Rows come in order of triggers; within one they go by ``order``. Needs the
    RocksDB state store.
    """
    kind = replies.schema[order].dataType.simpleString()
    rows = replies.select("judge", F.col(order).alias("place"), "failed")
    return rows.groupBy("judge").transformWithStateInPandas(Breaker(most), f"judge string, stopped_at {kind}", "append", "None")
