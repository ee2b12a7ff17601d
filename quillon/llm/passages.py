"""Common ground of the two passage deduplicators: selected k-mers, exact windows, removal.

A window is ``length`` consecutive words of one document. Each window is
assigned to its smallest k-mer (leftmost on ties), which depends on the
window's words alone, so equal windows are assigned to equal k-mers wherever
they stand. The windows assigned to one k-mer occurrence are consecutive; the
words they cover are its *path*. Equal paths hold equal windows. Paths and
windows are named by cryptographic digests of their words, so equal names mean
equal words; the 64-bit hashes of k-mers only select.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_materialized, materialize
from .words import Block, blocks, digests, owners, runs

_LAST = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, text): ``doc`` orders documents, null ids last; ``row`` tells texts under one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` consecutive values, by doubling."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at, size = np.where(values[a] <= values[b], a, b), size + step
    return at


def _paths(block: Block, k: int, length: int) -> tuple[np.ndarray, ...]:
    """(text, selected k-mer, its hash, lo, hi): the windows that start at words lo..hi of the block are assigned to the k-mer."""
    kmers = runs(block.hash, k)
    width = length - k + 1
    if len(kmers) < width:
        return (np.zeros(0, np.int64),) * 5
    at = _leftmost_min(kmers, width)
    owner = owners(block)
    starts = np.flatnonzero(owner[length - 1 :] == owner[: len(at)])  # windows within one text
    at, text = at[starts], owner[starts]
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])][: len(starts)])
    lo, hi = starts[head], starts[np.r_[head[1:], len(starts)] - 1] if len(head) else starts
    return text[head], at[head], kmers[at[head]], lo, hi


def path_scan(k: int, length: int, sides: bool = False) -> tuple:
    """One pass over whole texts; a row per selected k-mer occurrence, about 2 in ``length - k + 2`` words.

    ``sides`` adds a digest of the path's words from the k-mer on. Returns the function and its schema.
    """
    names = ["doc", "row", "kmer", *(["after"] if sides else []), "p1", "p2", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            for block in blocks(batch.column("text")):
                text, at, kmer, lo, hi = _paths(block, k, length)
                i, first, name = text + block.row, block.first[text], digests(block, lo, hi + length)
                after = [digests(block, at, hi + length)[:, 0]] if sides else []
                cols = [doc[i], row[i], kmer.view(np.int64), *after, name[:, 0], name[:, 1], (lo - first).astype(np.int32), (hi - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return run, ", ".join(f"{c} {'int' if c in ('lo', 'hi') else 'long'}" for c in names)


def _window_scan(length: int):
    """Digests of the windows that start at the asked words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            asked = batch.column("asked")
            for block in blocks(batch.column("text")):
                at, text = [], []
                for t in range(block.n_texts):
                    want = np.unique(np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in asked[block.row + t].as_py()]))
                    at.append(want)
                    text.append(np.full(len(want), t))
                at, text = np.concatenate(at), np.concatenate(text)
                start, i = at + block.first[text], text + block.row
                name = digests(block, start, start + length)
                cols = [doc[i], row[i], name[:, 0], name[:, 1], at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "row", "w1", "w2", "lo"])

    return run


def resolve_windows(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Of the asked windows (doc, row, lo, hi), those that an asked window of a smaller doc equals.

    Windows are compared one by one by the digests of their words; the smallest
    document of each is found by a partial aggregate, so a window of very many
    documents costs a task no more than its own rows.
    """
    wanted = asked.groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))  # bounded by the document's own words
    windows = materialize(texts.join(wanted, ["doc", "row"]).mapInArrow(_window_scan(length), "doc long, row long, w1 long, w2 long, lo int"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("w1", "w2", "first")
    found = materialize(windows.join(first, ["w1", "w2"]).where("doc > first").select("doc", "row", "lo", F.col("lo").alias("hi")), "window-copies")
    drop_materialized(windows)
    return found


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, cut = [], [], [], []
            for text, spans_ in zip(batch.column("text"), batch.column("removed"), strict=True):
                words, spans_ = text.as_py().encode().split(), spans_.as_py()
                n_words.append(len(words))
                merged: list[list[int]] = []
                if spans_:
                    for lo, hi in sorted((x["lo"], x["hi"] + length) for x in spans_):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                    rest, at = [], 0
                    for lo, hi in merged:
                        rest += words[at:lo]
                        at = hi
                    words = rest + words[at:]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
                cut.append(merged)
            cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *cols], names=["_id", "n_words", "n_removed", "kept_text", "removed_spans"])

    return run


def strip_passages(docs: DataFrame, removed: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """Cut the windows (doc, row, lo..hi) out of every document: id, n_words, n_removed, kept_text, removed_spans (word ranges)."""
    lists = removed.groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("removed"))  # bounded by the document's own words
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    joined = rows.join(lists, ["doc", "row"], "left").select("_id", "text", "removed")
    out = joined.mapInArrow(_strip(length), f"_id {kind}, n_words long, n_removed long, kept_text string, removed_spans array<array<long>>")
    return out.withColumnRenamed("_id", id_col)
