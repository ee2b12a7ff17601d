"""A log of mergeable batches: what a batch writes does not depend on the history.

A segment is a folder ``<first>-<last>`` of the batches it holds; it is written
beside its place and renamed, so it is there wholly or not at all. When
``FAN_IN`` neighbours of one size are there, they are merged into one of the next
size: each row is written anew once per size, of which there are few.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN_IN = 8
_NAME = re.compile(r"^(\d+)-(\d+)$")


class CorruptLog(ValueError):
    """The log cannot be read as what its writers left."""


class DeltaLog:
    """Batches 0, 1, 2, ... of one schema below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge

    def _fs(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[tuple[int, int]]:
        """The largest segments that cover the batches, in order; what they have taken in and not yet deleted is passed over."""
        p, fs = self._fs()
        if not fs.exists(p):
            return []
        found = sorted((tuple(map(int, m.groups())) for s in fs.listStatus(p) if (m := _NAME.match(s.getPath().getName()))), key=lambda s: (s[0], -s[1]))
        out: list[tuple[int, int]] = []
        for first, last in found:
            if out and last <= out[-1][1]:
                continue
            if out and first <= out[-1][1]:
                raise CorruptLog(f"segments {out[-1]} and {(first, last)} below {self.path} overlap")
            out.append((first, last))
        return out

    def _read(self, some: list[tuple[int, int]]) -> DataFrame:
        try:
            return self.spark.read.parquet(*[f"{self.path}/{a}-{b}" for a, b in some])
        except Exception as e:
            raise CorruptLog(f"a segment below {self.path} cannot be read: {str(e)[:200]}") from e

    def read(self) -> DataFrame | None:
        """All batches, merged; None before the first one. A segment that cannot be read raises, it is never taken for none."""
        some = self.segments()
        return self.merge(self._read(some)) if some else None

    def last(self) -> int:
        some = self.segments()
        return some[-1][1] if some else -1

    def _put(self, df: DataFrame, name: str) -> None:
        staged, fs = self._fs(f".{name}.staged")
        target, _ = self._fs(name)
        df.write.mode("overwrite").parquet(staged.toString())
        if not fs.rename(staged, target):
            raise OSError(f"cannot move {staged} to {target}")

    def append(self, batch: DataFrame, number: int) -> bool:
        """Add a batch; one that is there already (a repeated delivery) adds nothing. Says whether it was added."""
        if number <= self.last():
            return False
        self._put(self.merge(batch), f"{number}-{number}")
        self._compact()
        return True

    def _compact(self) -> None:
        while True:
            some = self.segments()
            sizes = [b - a + 1 for a, b in some]
            run = next((i for i in range(len(some) - FAN_IN, -1, -1) if len({sizes[i + k] for k in range(FAN_IN)}) == 1), None)
            if run is None:
                return
            part = some[run : run + FAN_IN]
            self._put(self.merge(self._read(part)), f"{part[0][0]}-{part[-1][1]}")
            for a, b in part:
                p, fs = self._fs(f"{a}-{b}")
                fs.delete(p, True)
