"""Pluggable model calls: batches through a client that each worker makes once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    """Answers prompts with text; a scripted one stands in where no model is at hand."""

    def complete(self, prompts: list[str], seeds: list[int]) -> list[str]: ...


class Scripted:
    """Replies looked up by prompt; an unknown prompt gets the default."""

    def __init__(self, replies: dict[str, str], default: str = "UNKNOWN") -> None:
        self.replies, self.default = replies, default

    def complete(self, prompts: list[str], seeds: list[int]) -> list[str]:
        return [self.replies.get(p, self.default) for p in prompts]


_clients: dict[str, Client] = {}


def complete(prompts: DataFrame, make: Callable[[], Client], *, name: str, batch: int = 16, partitions: int | None = None) -> DataFrame:
    """Reply to (key, prompt, seed): equal requests are asked once, ``partitions`` bounds how many clients there are."""
    wanted = prompts.select("key", "prompt", F.col("seed").cast("long").alias("seed")).dropDuplicates(["key"])
    wanted = wanted.repartition(partitions) if partitions else wanted

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _clients:
            _clients[name] = make()
        for pdf in frames:
            values: list[str | None] = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    values += _clients[name].complete(part["prompt"].tolist(), part["seed"].tolist())
                except Exception:  # a failed call is recorded, not invented
                    values += [None] * len(part)
            yield pd.DataFrame({"key": pdf["key"], "value": values})

    return wanted.mapInPandas(run, "key string, value string")


def complete_cached(prompts: DataFrame, table, make: Callable[[], Client], **options) -> DataFrame:
    """Replies from the response table where it has them; the others are asked for and stored."""
    have, missing = table.lookup(prompts)
    fresh = complete(missing, make, **options).where("value is not null")
    table.put(fresh)
    return prompts.select("key").join(table.read(), "key", "left")


def question_seed(base: int, qid: Column, index: Column) -> Column:
    """Seed of one sample of one question, a hash of all three."""
    from quillon.functions.numeric import hash_u64

    return hash_u64(F.lit(str(base)), qid, index.cast("string"))
