"""Stored model responses as a data source: gzipped JSON entries, one file each, sharded by the first digits of their key.

``spark.read.format("response_cache").schema("key string, entry string").load(path)``
reads ``path/ab/cd/abcd....json.gz``; a filter on ``key`` (equality or ``in``)
leaves only the files asked for. An entry that is cut off, is no JSON or is of
another format is a miss: it gives no row, or, with ``misses`` set to true, a
row without an entry.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import zlib
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# The format number that an entry states, and the name of its field.
FORMAT, FIELD = 1, "_v"
_KEY = re.compile(r"^[0-9a-f]{64}\.json\.gz$")


class Shard(InputPartition):
    """A folder of the first level, or some asked keys of it."""

    def __init__(self, name: str, keys: list[str] | None) -> None:
        super().__init__(name)
        self.keys = keys


class ResponseReader(DataSourceReader):
    def __init__(self, path: str, misses: bool) -> None:
        self.path, self.misses = path, misses
        self.asked: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("key",):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.asked = values if self.asked is None else self.asked & values
            yield f  # Spark checks the rows that are left once more

    def partitions(self) -> list[Shard]:
        if self.asked is not None:
            by: dict[str, list[str]] = {}
            for key in self.asked:
                by.setdefault(str(key)[:2], []).append(str(key))
            return [Shard(name, keys) for name, keys in sorted(by.items())]
        store, root = _store(self.path)
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [Shard(i.base_name, None) for i in sorted(found, key=lambda i: i.base_name) if i.type == pafs.FileType.Directory and len(i.base_name) == 2]

    def read(self, partition: Shard | None):
        if partition is None:  # a source without shards
            return
        store, root = _store(self.path)
        if partition.keys is not None:
            places = [(k, f"{root}/{k[:2]}/{k[2:4]}/{k}.json.gz") for k in sorted(partition.keys) if _KEY.match(f"{k}.json.gz")]
            there = [i.type == pafs.FileType.File for i in store.get_file_info([p for _, p in places])]
            places = [p for p, ok in zip(places, there, strict=True) if ok]
        else:
            files = store.get_file_info(pafs.FileSelector(f"{root}/{partition.value}", recursive=True))
            places = [(i.base_name.removesuffix(".json.gz"), i.path) for i in sorted(files, key=lambda i: i.path) if i.type == pafs.FileType.File and _KEY.match(i.base_name)]
        for key, place in places:
            entry = _entry(store, place)
            if entry is not None or self.misses:
                yield key, entry


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _entry(store: pafs.FileSystem, place: str) -> str | None:
    try:
        with store.open_input_stream(place, compression=None) as f:
            text = gzip.decompress(f.read()).decode()
        body = json.loads(text)
    except (OSError, EOFError, zlib.error, ValueError):
        return None
    if not isinstance(body, dict) or body.get(FIELD) != FORMAT:
        return None
    return json.dumps({k: v for k, v in body.items() if k != FIELD}, sort_keys=True, ensure_ascii=False)


class ResponseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "response_cache"

    def schema(self) -> str:
        return "key string, entry string"

    def reader(self, schema) -> ResponseReader:
        return ResponseReader(self.options["path"], self.options.get("misses", "false").lower() == "true")


def read_responses(spark: SparkSession, path: str, keys: list[str] | None = None, *, misses: bool = False) -> DataFrame:
    """(key, entry): stored responses, all or those of some keys."""
    spark.dataSource.register(ResponseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("response_cache").option("misses", str(misses).lower()).load(path)
    return found if keys is None else found.where(F.col("key").isin(keys))


def write_responses(rows: DataFrame, path: str) -> DataFrame:
    """Store (key, entry) rows in that layout; a file is there wholly or not at all, what is stored stays. Returns (key, added)."""

    def put(batches):
        import pyarrow as pa

        store, root = _store(path)
        for batch in batches:
            keys, added = batch.column("key").to_pylist(), []
            for key, entry in zip(keys, batch.column("entry").to_pylist(), strict=True):
                place = f"{root}/{key[:2]}/{key[2:4]}"
                target = f"{place}/{key}.json.gz"
                added.append(_entry(store, target) is None if store.get_file_info(target).type == pafs.FileType.File else True)
                if added[-1]:
                    store.create_dir(place, recursive=True)
                    staged = f"{place}/.{key}.{os.getpid()}.staged"
                    with store.open_output_stream(staged) as f:
                        f.write(gzip.compress(json.dumps({**json.loads(entry), FIELD: FORMAT}, sort_keys=True).encode(), mtime=0))
                    store.move(staged, target)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(added, pa.bool_())], names=["key", "added"])

    return rows.select("key", "entry").dropDuplicates(["key"]).mapInArrow(put, "key string, added boolean")


def cache_counts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hits, misses) of wanted keys: absent and unreadable entries are misses."""
    have = found.where("entry is not null").select("key").distinct().withColumn("_hit", F.lit(True))
    return wanted.select("key").join(have, "key", "left").agg(F.count_if("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
