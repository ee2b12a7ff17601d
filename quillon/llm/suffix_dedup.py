"""Substring dedup by sparse suffix arrays.

Only the suffixes at content-selected minimiser positions are kept. They are
range-sorted across the cluster by their words: first the minimiser k-mer, then
the words from it on, then those before it, as far as their windows reach, each
by hash or digest in place of the alphabet; last by document. Neighbours are
compared in that order: a suffix whose neighbour has the same words to both
sides is a later copy. Where neighbours share the k-mer but not all words, the
match is extended left and right word by word, as windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .passages import keyed, path_scan, resolve_windows, strip_passages
from .shared import drop_materialized, materialize, partitions_for

_PLACED = "doc long, row long, lo int, hi int, copy boolean"
_ORDER = ["kmer", "after", "p1", "p2", "doc"]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes of one range partition: later copies, and first occurrences that have to be extended.

    What is held between batches is the last suffix and, while a k-mer has
    shown one path only, the places of that path in its first document. The
    first and the last k-mer of a partition may go on in another one, so their
    first occurrences are always extended.
    """
    last: tuple | None = None  # kmer, after, p1, p2, first document of the path
    pending: list[pa.RecordBatch] = []
    several, opening = False, True

    def told(batch: pa.RecordBatch, copy: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        chosen = [batch.column(c).filter(pa.array(keep)) for c in ("doc", "row", "lo", "hi")]
        return pa.RecordBatch.from_arrays([*chosen, pa.array(copy[keep])], names=["doc", "row", "lo", "hi", "copy"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _ORDER}
        new_kmer, new_path = np.ones(n, bool), np.ones(n, bool)
        new_kmer[1:] = col["kmer"][1:] != col["kmer"][:-1]
        new_path[1:] = np.any([col[c][1:] != col[c][:-1] for c in _ORDER[:-1]], axis=0)
        if last is not None:
            new_kmer[0], new_path[0] = col["kmer"][0] != last[0], tuple(col[c][0] for c in _ORDER[:-1]) != last[:4]
        heads = np.flatnonzero(new_path)
        path = np.cumsum(new_path)
        first = np.r_[last[4] if last is not None else 0, col["doc"][heads]][path]
        copy = col["doc"] > first
        group = np.cumsum(new_kmer)  # 0 goes on from the batch before
        paths = np.bincount(group, new_path, minlength=group[-1] + 1)
        paths[0] += 0 if last is None or new_kmer[0] else 2 if several else 1
        open_ = paths > 1
        if opening:
            open_[: 2 if last is None else 1] = True
        if pending:
            if not new_kmer[0] and open_[0]:
                yield from pending
            if group[-1] or open_[0]:
                pending = []
        if group[-1] > (1 if last is None else 0):
            opening = False
        wait = ~copy & (group == group[-1]) & ~open_[group]
        yield told(batch, copy, copy | ~copy & open_[group])
        if wait.any():
            pending.append(told(batch, copy, wait))
        several = bool(paths[-1] > 1)
        last = (*(col[c][-1] for c in _ORDER[:-1]), first[-1])
    yield from pending


def remove_repeated_suffixes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 12) -> DataFrame:
    """Remove each word covered by a ``length``-word window that also starts in a document with a smaller id.

    Returns per document: id, n_words, n_removed, kept_text and removed_spans
    (word ranges). Null and empty texts have no words; a document shorter than
    ``length`` words loses none; a null id counts as larger than any other;
    rows that repeat an id are one document for the comparison and each return
    a row; an empty table gives an empty result; other columns are ignored.
    """
    texts = keyed(docs, id_col, text_col)
    scan, schema = path_scan(k, length, sides=True)
    suffixes = materialize(texts.mapInArrow(scan, schema), "suffixes")
    ranged = suffixes.repartitionByRange(partitions_for(docs.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER)
    placed = materialize(ranged.mapInArrow(_neighbours, _PLACED), "placed")
    drop_materialized(suffixes)
    copies = placed.where("copy").drop("copy")
    parts = resolve_windows(texts, placed.where("not copy").drop("copy"), length)
    return strip_passages(docs, copies.unionByName(parts), length, id_col, text_col)
