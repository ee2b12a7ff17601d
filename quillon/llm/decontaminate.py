"""Find benchmark passages in documents with one Aho-Corasick automaton.

The automaton holds blocks of normalised benchmark words, about half a window
long and so spaced that every window has one; words are spelled as numbers of a
few letters, so that no node has many branches. A task scans each normalised
text once; where a block is met, the words around it are compared with the
item's, as far as a window can reach, and hits are mapped to words, and those to
offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Every ASCII byte that is neither letter nor digit parts words; A-Z are lowered; other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
#: Benchmark characters that one automaton may hold (about 230 MB in a worker, at windows of ten words); a larger benchmark is scanned for in blocks of this size.
MAX_AUTOMATON_BYTES = 8 << 20
_BASE, _CANDIDATES = 64, 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class _Spelling(dict):
    """Letters of each benchmark word; the first letter is of another range than the rest, so matches begin at words. Other words have a letter of their own."""

    def __missing__(self, word: bytes) -> str:
        return "\xff"


class Seeds:
    """The automaton of some items and what is needed to extend its hits."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        block = (window + 1) // 2
        self.window, self.step = window, window - block + 1
        ids: dict[bytes, int] = {}
        flat, ends, names, seeds = [], [], [], {}
        for name, text in items:
            words = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
            if words:
                at, n = len(flat), min(block, len(words))
                for i in range(0, len(words) - n + 1, self.step) if len(words) >= window else (0,):
                    seeds.setdefault(tuple(words[i : i + n]), []).append((at + i, len(names)))
                flat += words
                names.append(name)
                ends.append(len(flat))
        self.ids, self.names = ids, names
        self.flat, self.end = np.array(flat, np.int32), np.array(ends, np.int64)
        self.begin = np.r_[0, self.end[:-1]][: len(ends)]
        digits = 1
        while _BASE**digits <= len(ids):
            digits += 1
        self.digits = digits
        self.spelling = _Spelling((w, self._letters(i)) for w, i in ids.items())
        letters = list(self.spelling.values())
        self.places, self.sizes = [np.array(x, np.int64) for x in seeds.values()], np.array([len(k) for k in seeds], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, seed in enumerate(seeds):
            self.automaton.add_word("".join(letters[w - 1] for w in seed), number)
        if seeds:
            self.automaton.make_automaton()

    def _letters(self, number: int) -> str:
        out = []
        for _ in range(self.digits):
            number, digit = divmod(number, _BASE)
            out.append(digit)
        return chr(_BASE + out[0]) + "".join(map(chr, out[1:]))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a window of an item, and the items of those windows."""
        mark, found = np.zeros(len(words) + 1, np.int64), set()
        if not (len(self.automaton) and words):
            return mark[:-1] > 0, found
        spelled = list(map(self.spelling.__getitem__, words))
        hits = list(self.automaton.iter("".join(spelled)))
        if hits:
            last = np.cumsum([len(x) for x in spelled]) - 1
            text = np.fromiter((self.ids.get(w, 0) for w in words), np.int32, len(words))
            end, seed = np.array(hits, np.int64).T
            start = np.searchsorted(last, end) + 1 - self.sizes[seed]
            several = np.array([len(self.places[k]) for k in seed.tolist()])
            for part in np.split(np.arange(len(seed)), np.flatnonzero(np.diff(np.cumsum(several) // _CANDIDATES)) + 1):
                places = np.concatenate([self.places[k] for k in seed[part].tolist()])
                at, size = np.repeat(start[part], several[part]), np.repeat(self.sizes[seed[part]], several[part])
                self._extend(text, at, size, places[:, 0], places[:, 1], mark, found)
        return np.cumsum(mark[:-1]) > 0, found

    def _extend(self, text: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, item: np.ndarray, mark: np.ndarray, found: set[str]) -> None:
        """Compare the words before and after each block with those of the item, within a window's reach."""
        begin, end, n = self.begin[item], self.end[item], len(text)
        reach = []
        for step, edge, stop in ((-1, at - 1, place - begin), (1, at + size, end - place - size)):
            own = (place - 1 if step < 0 else place + size)
            run, live = np.zeros(len(at), np.int64), np.arange(len(at))
            for k in range(self.window - 1):
                x = edge[live] + step * k
                live, x = live[ok := (x >= 0) & (x < n) & (stop[live] > k)], x[ok]
                live = live[text[x] == self.flat[own[live] + step * k]]
                if not len(live):
                    break
                run[live] += 1
            reach.append(run)
        good = reach[0] + size + reach[1] >= np.minimum(self.window, end - begin)
        np.add.at(mark, at[good] - reach[0][good], 1)
        np.add.at(mark, at[good] + size[good] + reach[1][good], -1)
        found |= {self.names[i] for i in np.unique(item[good]).tolist()}


def _offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets at which the words of ``text`` begin and end."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(raw.tobytes().translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]


def hit_runs(text: str, hit: np.ndarray) -> list[list[int]]:
    """Runs of hit words: [first word, word after the last, begin, end], the last two as offsets in the original text."""
    if not hit.any():
        return []
    begin, end = _offsets(text)
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    return [[int(a), int(b), int(begin[a]), int(end[b - 1])] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


_built: dict[int, Seeds] = {}
_FOUND = "n_words long, n_hit long, items array<string>, runs array<array<long>>"
_WIDE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.list_(pa.int64())))])


def _scanner(shared: Broadcast, n: int, key: int):
    """Scan texts with the automaton of one benchmark block."""

    @F.arrow_udf(_FOUND)
    def scan_texts(texts: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = Seeds(shared.value, n)
        rows = []
        for text in texts:
            text = text.as_py()
            words = words_of(text)
            hit, items = _built[key].scan(words)
            rows.append({"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(items), "runs": hit_runs(text, hit) if items else []})
        return pa.array(rows, _WIDE)

    return scan_texts.asNondeterministic()  # evaluated once, whatever the plan does with it


def _merge(texts: pa.Array, items: pa.Array, runs: pa.Array) -> pa.Array:
    """What several scans found in a text, as one: runs that overlap or touch are one run."""
    rows = []
    for text, names, parts in zip(texts, items, runs, strict=True):
        whole: list[list[int]] = []
        for run in sorted(parts.as_py() or []):
            if whole and run[0] <= whole[-1][1]:
                whole[-1][1], whole[-1][3] = max(whole[-1][1], run[1]), max(whole[-1][3], run[3])
            else:
                whole.append(run)
        rows.append({"n_words": len(words_of(text.as_py())), "n_hit": sum(r[1] - r[0] for r in whole), "items": sorted(set(names.as_py() or [])), "runs": whole})
    return pa.array(rows, _WIDE)


def _benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The benchmark in lists of bounded size, read one partition at a time."""
    block, size = [], 0
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for item, text in items.toLocalIterator():
        if block and size + len(text) > MAX_AUTOMATON_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    keep_columns: bool = False,
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted strings), spans (original code point offsets).

    With ``keep_columns`` the row keeps all columns of ``docs`` in place of the
    id alone (those named like a result column are replaced).

    Null or empty texts have no words and no hits; null items are skipped (an
    item with a null id counts as item ``null``); repeated documents each give
    a row; an empty benchmark hits nothing; a very long text is scanned whole.
    A benchmark above ``MAX_AUTOMATON_BYTES`` takes several automata, of which one
    is broadcast, and built in a worker, at a time. Each scan then writes a row for
    each different text that it hits and no text; the rows come back by a join on
    the text's SHA-256.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "n_hit", "items")] if keep_columns else [id_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).cast("string").alias("text"))
    blocks = _benchmark_blocks(benchmark, item_col, item_text_col)
    block, after, hits = next(blocks), next(blocks, None), []
    several = after is not None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        found = _scanner(shared, window, shared._jbroadcast.id())("text").alias("found")
        if several:
            hit = rows.select(F.sha2("text", 256).alias("key"), found).where("size(found.items) > 0").groupBy("key").agg(F.first("found").alias("found"))
            hits.append(materialize(hit, "benchmark-hits"))
            shared.destroy()
        block, after = after, next(blocks, None)
    if several:
        # a text has at most one row for each automaton
        every = reduce(DataFrame.unionByName, hits).groupBy("key").agg(F.flatten(F.collect_list("found.items")).alias("items"), F.flatten(F.collect_list("found.runs")).alias("runs"))
        rows = rows.withColumn("key", F.sha2("text", 256)).join(every, "key", "left")
        found = F.arrow_udf(_merge, _FOUND).asNondeterministic()("text", "items", "runs").alias("found")
    rows = rows.select("row", found)
    spans = F.transform("found.runs", lambda r: F.slice(r, 3, 2)).alias("spans")
    return rows.select("row.*", "found.n_words", "found.n_hit", "found.items", spans)
