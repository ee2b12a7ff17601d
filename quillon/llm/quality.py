"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed over whole texts, many texts at a time. Trees are
fitted on a bounded sample of labelled rows and flattened into arrays, which
all tasks walk through with numpy, all rows and trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .words import Block, blocks

#: Bytes that are counted, class by class.
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "newline": [10], "space": [9, 11, 12, 13, 32],
    "stop": b".,;:?", "bang": b"!", "quote": b"\"'()", "link": b"/@_<>=", "symbol": b"*#$%&|~^+[]{}\\`",
}
FEATURES = ["length", "words", "word_length", *_CLASSES, "distinct", "most_common", "adjacent", "pairs", "caps", "line_words", "words_with_symbols"]


def _by_class() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for i, members in enumerate(_CLASSES.values()):
        table[list(members)] = i
    return table


_CLASS = _by_class()


def statistics(block: Block) -> np.ndarray:
    """One row of ``FEATURES`` per text of the block; an empty text has zeros."""
    n, sizes, words = block.n_texts, np.diff(block.cut), np.diff(block.first)
    owner_of_byte = np.repeat(np.arange(n), sizes)
    kinds = len(_CLASSES) + 1
    counts = np.bincount(owner_of_byte * kinds + _CLASS[block.raw], minlength=n * kinds).reshape(n, kinds).astype(float)
    owner = np.repeat(np.arange(n), words)
    letters = np.concatenate([[0], np.cumsum(_CLASS[block.raw] == 0)])
    lower = np.concatenate([[0], np.cumsum((_CLASS[block.raw] == 1))])
    odd = np.concatenate([[0], np.cumsum(_CLASS[block.raw] == len(_CLASSES) - 1)])
    caps = ((letters[block.end] - letters[block.start]) > 1) & (lower[block.end] == lower[block.start])
    symbols = odd[block.end] > odd[block.start]
    same = np.zeros(len(owner), bool)
    same[1:] = (block.hash[1:] == block.hash[:-1]) & (owner[1:] == owner[:-1])
    pairs = block.hash.copy()
    pairs[1:] ^= block.hash[:-1] * np.uint64(0x9E3779B97F4A7C15)
    distinct, most, distinct_pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(n):
        a, b = block.first[t], block.first[t + 1]
        if a == b:
            continue
        h = np.sort(block.hash[a:b])
        runs = np.diff(np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]))
        distinct[t], most[t] = len(runs), runs.max()
        p = np.sort(pairs[a + 1 : b])
        distinct_pairs[t] = 1 + np.count_nonzero(p[1:] != p[:-1]) if len(p) else 1

    def per(what: np.ndarray) -> np.ndarray:
        return np.bincount(owner, what, minlength=n) / np.maximum(words, 1)

    over = np.maximum(sizes, 1)[:, None]
    cols = [
        np.log1p(sizes), np.log1p(words), per(block.end - block.start), *(counts[:, :-1] / over).T, distinct / np.maximum(words, 1), most / np.maximum(words, 1),
        per(same), distinct_pairs / np.maximum(words - 1, 1), per(caps), words / (counts[:, list(_CLASSES).index("newline")] + 1), per(symbols),
    ]
    return np.stack(cols, axis=1)


@dataclass
class Trees:
    """All trees in flat arrays; node i of feature -1 is a leaf, its children are itself."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.root, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, l2: float = 1.0) -> Trees:
    """Boost logistic loss; every split is chosen on histograms of gradients over quantile bins."""
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    base, (n, m) = float(np.log(rate_1 / (1 - rate_1))), x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) if n else np.zeros(0) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), int)
    flat, out = binned + np.arange(m) * bins, {k: [] for k in ("root", "feature", "threshold", "left", "right", "value")}
    margin = np.full(n, base)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, open_ = np.zeros(n, int), [len(out["feature"])]
        out["root"].append(open_[0])
        for k in ("feature", "threshold", "value"):
            out[k].append(0)
        out["left"].append(open_[0])
        out["right"].append(open_[0])
        node += open_[0]
        for level in range(depth + 1):
            new = []
            slot = {k: i for i, k in enumerate(open_)}
            inside = np.isin(node, open_)
            idx = np.array([slot[k] for k in node[inside]], int)
            at = (idx[:, None] * (m * bins) + flat[inside]).ravel()
            shape = (len(open_), m, bins)
            hist = [np.bincount(at, np.repeat(w[inside], m), minlength=int(np.prod(shape))).reshape(shape) for w in (g, h, np.ones(n))]
            for i, k in enumerate(open_):
                gs, hs, cs = (a[i] for a in hist)
                total_g, total_h = gs[0].sum(), hs[0].sum()
                out["value"][k] = -rate * total_g / (total_h + l2)
                if level == depth:
                    continue
                gl, hl, cl = (np.cumsum(a, axis=1)[:, :-1] for a in (gs, hs, cs))
                gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                gain[(cl < least) | (cs[0].sum() - cl < least)] = 0
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                kids = [len(out["feature"]), len(out["feature"]) + 1]
                for kid in kids:
                    for name, v in (("feature", 0), ("threshold", 0.0), ("left", kid), ("right", kid), ("value", 0.0)):
                        out[name].append(v)
                out["feature"][k], out["threshold"][k], (out["left"][k], out["right"][k]) = int(f), float(edges[f][b]), kids
                here = node == k
                node[here] = np.where(binned[here, f] <= b, kids[0], kids[1])
                new += kids
            open_ = new
            if not new:
                break
        margin += np.array(out["value"])[node]
    arrays = {k: np.array(v, float if k in ("threshold", "value") else int) for k, v in out.items()}
    return Trees(**arrays, base=base, depth=depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(b) for b in blocks(batch.column("text"))]
        if parts:
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])


def _scorer(model: Trees):
    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        parts = [model.score(statistics(b)) for b in blocks(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score.asNondeterministic()  # evaluated once, whatever the plan does with it


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Trees:
    """Fit on at most about ``max_rows`` labelled rows, chosen by a hash of the id among those that are not held out.

    Labels under a null id, null labels and labels without a document teach
    nothing; of several labels under one id the largest counts; without
    labels, or with labels of one kind, every score is the smoothed base rate.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("double")).alias("y"))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    some = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the sample is bounded by max_rows
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "_id")
    got = rows.select("text", "y").mapInArrow(_features, "x array<double>, y double").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, *, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` and ``score`` in [0, 1] (an input column of that name is replaced).

    Whole texts are scored; a null text counts as an empty one; an empty table
    gives an empty result.
    """
    return docs.withColumn("score", _scorer(model)(F.col(text_col).cast("string")))
