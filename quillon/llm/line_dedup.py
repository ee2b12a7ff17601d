"""Line dedup by a suffix array over line ids, with DataFrame functions only.

The suffixes are the positions of lines in documents. Prefix doubling ranks
them by their first 1, 2, 4, ... lines: a suffix's next rank is the rank of the
pair (own rank, rank of the suffix as many lines later), a number in the order of
such pairs. Suffixes of equal rank form an interval whose longest common prefix
has at least that many lines; suffixes alone in their interval leave, and the
doubling ends when none is left, that is at the longest repeated run. The
depths up to ``min_lines`` that are no power of two are ranked by two overlapping
prefixes that are; those below ``min_lines`` count by their words. Every suffix
that is not the first of an interval starts a later copy as long as its deepest
interval; what such copies cover together are the maximal repeated runs, whose
lines go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import drop_materialized, global_rank, materialize

_LAST = (1 << 63) - 1
_PLACE = ["doc", "row", "pos"]


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """Replace a key by its rank among the keys that occur more than once; rows of other keys leave."""
    names = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key)
    ranks = global_rank(names, key, "_rank")
    return materialize(rows.join(ranks, key).select(*_PLACE, "words", F.col("_rank").alias("rank")), "suffixes")


def _deeper(at: DataFrame, step: int, counted: bool) -> DataFrame:
    """Suffixes ranked by their own prefix and that of the suffix ``step`` lines later."""
    later = Window.partitionBy("doc", "row").orderBy("pos").rangeBetween(step, step)
    ahead = at.withColumn("_later", F.first(F.struct("rank", "words")).over(later)).where("_later is not null")
    words = F.concat(F.slice("words", 1, step), F.col("_later.words")) if counted else F.col("words")  # one number a line, as many as the depth
    return _named(ahead.withColumns({"next": F.col("_later.rank"), "words": words}).drop("_later"), ["rank", "next"])


def suffix_intervals(lines: DataFrame, min_lines: int) -> dict[int, DataFrame]:
    """By depth, (doc, row, pos, words, rank): suffixes whose first lines, as many as the depth, occur more than once.

    They are ranked by those lines. Depths are all up to ``min_lines`` and the
    powers of two beyond, as far as anything is repeated; ``words`` has the
    number of words of each line for depths below ``min_lines``.
    """
    found = {1: _named(lines, ["l1", "l2"])}
    for d in range(2, min_lines + 1):
        known = 1 << ((d - 1).bit_length() - 1)
        found[d] = _deeper(found[known], d - known, d < min_lines)
    depth = 1 << (min_lines.bit_length() - 1)
    while not found[depth].isEmpty():
        after = _deeper(found[depth], depth, False) if 2 * depth not in found else found[2 * depth]
        depth *= 2
        found[depth] = after
    return found


def _later_copies(intervals: dict[int, DataFrame], min_lines: int, min_words: int) -> DataFrame:
    """(doc, row, pos, depth): suffixes that an earlier one shares an interval with, at the greatest such depth that counts."""
    total = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + w)
    counted = [at if d >= min_lines else at.where(total >= min_words) for d, at in intervals.items()]
    every = reduce(DataFrame.unionByName, [at.select(*_PLACE, "rank", F.lit(d).alias("depth")) for d, at in zip(intervals, counted, strict=True)])
    first = every.groupBy("depth", "rank").agg(F.min(F.struct(*_PLACE)).alias("first"))
    return every.join(first, ["depth", "rank"]).where(F.struct(*_PLACE) > F.col("first")).groupBy(*_PLACE).agg(F.max("depth").alias("depth"))


def repeated_runs(copies: DataFrame) -> DataFrame:
    """(doc, row, runs): per document the maximal runs [lo, hi) of lines that the copies (doc, row, pos, depth) cover, in order."""
    inside = Window.partitionBy("doc", "row").orderBy("pos")  # one document's lines
    reach = F.max(F.col("pos") + F.col("depth")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opened = copies.withColumn("new", F.when(F.col("pos") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(inside))
    runs = opened.groupBy("doc", "row", "run").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("depth")).alias("hi"))
    return runs.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """The lines before, between and after the runs."""
    begin = lambda i: F.when(i > 0, F.get(runs, i - 1)["hi"]).otherwise(0)
    end = lambda i: F.coalesce(F.get(runs, i)["lo"], F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i))))


def remove_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """Delete later copies of runs of at least ``min_lines`` lines or ``min_words`` words; returns every column of ``docs`` with n_lines, n_deleted.

    Lines are what ``\\n`` parts, compared whole by 128-bit hashes; a null or
    empty text has none. A line goes if a run around it also starts at an
    earlier place, in a document with a smaller id or further up in the same
    one, and has ``min_lines`` lines, or fewer that hold ``min_words`` words
    together; words are what white space parts. Shorter lone lines stay; runs
    are judged on the input. A null id counts as larger than any other. Of rows
    that repeat an id with other texts, the order among them is that of a text
    hash; rows that repeat id and text are one document and all lose the same
    lines. A very long text is one array of lines within its row and is never
    split by words. An empty table gives an empty result. Columns of the input
    named ``n_lines`` or ``n_deleted`` are replaced; any other name may be used.
    """
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(doc.alias("doc"), F.xxhash64(text).alias("row"), text.alias("t")).where("t <> ''")
    split = keyed.select("doc", "row", F.posexplode(F.split("t", "\n")).alias("pos", "l"))
    ids = split.select(*_PLACE, F.xxhash64("l").alias("l1"), F.xxhash64(F.lit(1), "l").alias("l2"), F.array(word_count(F.col("l"))).alias("words"))
    lines = materialize(ids, "lines")
    intervals = suffix_intervals(lines, min_lines)
    gone = materialize(repeated_runs(_later_copies(intervals, min_lines, min_words)), "repeated-runs")
    for table in (lines, *intervals.values()):
        drop_materialized(table)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("in"), doc.alias("doc"), F.xxhash64(text).alias("row"))
    # one plan at every size: the texts travel once, the runs are the side that is hashed
    rows = rows.join(gone.hint("shuffle_hash"), ["doc", "row"], "left")
    text = F.coalesce(F.col(f"in.`{text_col}`").cast("string"), F.lit(""))
    rows = rows.select("in", "runs", F.when(text != "", F.split(text, "\n")).otherwise(F.array()).alias("lines"))
    kept = F.when(F.col("runs").isNull(), F.col(f"in.`{text_col}`")).otherwise(F.array_join(_without(F.col("lines"), F.col("runs")), "\n"))
    deleted = F.aggregate(F.coalesce("runs", F.array()), F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    others = [kept.alias(c) if c == text_col else F.col(f"in.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return rows.select(*others, F.size("lines").cast("long").alias("n_lines"), deleted.alias("n_deleted"))
