"""Fingerprints of row sets of any size: a hash tree over ranges of key hashes.

A leaf is a range of key hashes and the digest of its sorted keys; a node above
digests its sixteen children. The root names the set on any partitioning, two
trees tell by their nodes where two sets differ, and a key is proved to be in a
set by the digests beside its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a leaf, about.
LEAF = 1000
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # the digest of nothing


def depth_for(n: int) -> int:
    """Levels below the root that leave about ``LEAF`` keys in a leaf; two trees that are compared need the same."""
    depth = 0
    while n > LEAF * 16**depth:
        depth += 1
    return depth


def _path(key: str, depth: int) -> Column:
    """First digits of the hash of a key: which leaf it belongs to."""
    return F.substring(F.sha2(F.col(key).cast("string"), 256), 1, depth) if depth else F.lit("")


def _node(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "\n"), 256)


def tree(df: DataFrame, key: str = "qid", depth: int | None = None) -> DataFrame:
    """(level, path, n, digest) of all nodes that hold keys; level 0 is the root. Null keys are no keys, a repeated one counts as often."""
    keys = df.select(F.col(key).cast("string").alias("key")).where("key is not null")
    if depth is None:
        depth = depth_for(keys.count())
    level = keys.groupBy(_path("key", depth).alias("path")).agg(F.count(F.lit(1)).alias("n"), _node(F.array_sort(F.collect_list("key"))).alias("digest"))  # about LEAF keys in a row
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("path", 1, d).alias("path")).agg(F.sum("n").alias("n"), _node(F.array_sort(F.collect_list(F.concat_ws(":", "path", "digest")))).alias("digest"))  # sixteen children
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out.select("level", "path", "n", "digest")


def root(df: DataFrame, key: str = "qid", depth: int | None = None) -> DataFrame:
    """(n, digest) of a set of keys, one row; of nothing, the digest of nothing."""
    top = tree(df, key, depth).where("level = 0")
    return top.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.lit(_EMPTY)).alias("digest"))


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths of the leaves in which two trees of the same depth differ."""
    lowest = lambda t: t.where(F.col("level") == t.agg(F.max("level")).first()[0]) if not t.isEmpty() else t
    x, z = lowest(a).select("path", F.col("digest").alias("x")), lowest(b).select("path", F.col("digest").alias("z"))
    return x.join(z, "path", "full_outer").where(~F.col("x").eqNullSafe(F.col("z"))).select("path")


def difference(a: DataFrame, b: DataFrame, key: str = "qid", depth: int | None = None) -> DataFrame:
    """(key, in_a, in_b): keys of two sets that one holds more often; only differing leaves are compared key by key."""
    if depth is None:
        depth = depth_for(max(a.count(), b.count()))
    leaves = differing_leaves(tree(a, key, depth), tree(b, key, depth))
    near = lambda df, name: df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).withColumn("path", _path(key, depth)).join(leaves, "path", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = near(a, "in_a").join(near(b, "in_b"), key, "full_outer").fillna(0, ["in_a", "in_b"])
    return both.where("in_a <> in_b")


def proofs(tree_: DataFrame, asked: DataFrame, key: str = "qid") -> DataFrame:
    """(key, leaf, siblings): for each asked key its leaf's digest and, from the leaf up, the other children of each node on its path.

    ``verify`` recomputes the root from them and the leaf's keys alone.
    """
    depth = tree_.agg(F.max("level")).first()[0] or 0
    want = asked.select(F.col(key).cast("string").alias(key)).withColumn("leaf_path", _path(key, depth))
    leaf = tree_.where(F.col("level") == depth).select(F.col("path").alias("leaf_path"), F.col("digest").alias("leaf"))
    out = want.join(leaf, "leaf_path", "left").withColumn("siblings", F.array().cast("array<array<string>>"))
    for d in range(depth, 0, -1):
        children = tree_.where(F.col("level") == d).groupBy(F.substring("path", 1, d - 1).alias("_up")).agg(F.array_sort(F.collect_list(F.concat_ws(":", "path", "digest"))).alias("_all"))
        mine = F.substring("leaf_path", 1, d)
        out = out.join(children, F.substring("leaf_path", 1, d - 1) == F.col("_up"), "left")
        others = F.filter("_all", lambda c: ~c.startswith(F.concat(mine, F.lit(":"))))
        out = out.withColumn("siblings", F.concat("siblings", F.array(others))).drop("_up", "_all")
    return out.select(key, "leaf_path", "leaf", "siblings")


def verify(proofs_: DataFrame) -> DataFrame:
    """``proofs`` with the root that each implies (null where the key's leaf is empty)."""
    steps = F.transform("siblings", lambda s, i: F.struct(s.alias("others"), i.alias("i")))
    own = lambda i, digest: F.concat_ws(":", F.substring("leaf_path", F.lit(1), F.length("leaf_path") - i), digest)
    up = F.aggregate(steps, F.col("leaf"), lambda digest, s: F.sha2(F.array_join(F.array_sort(F.concat(s["others"], F.array(own(s["i"], digest)))), "\n"), 256))
    return proofs_.withColumn("root", up)
